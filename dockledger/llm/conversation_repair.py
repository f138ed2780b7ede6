"""Conversation structure repair by depth-first branch-and-bound.

A conversation's rows, by turn, are edited at least cost until their roles' initials read `(s?(ua)+)?`: a row is kept,
given another role or deleted, and empty rows are inserted. Of the cheapest edits those whose initials (Keep, Rerole,
Delete, Insert) come first in ASCII order win.

The rows of all conversations are sorted across the cluster. A task cuts its part into segments; a conversation that
lies whole within one segment is solved there. The few that go on behind a segment or a task's border are solved segment
by segment, for each state before and after it, and put together in order: edits of a segment always end with a row's,
so no segment's audit is the beginning of another's and least audits of segments make the least audit of all.

Defined results: null role and text count as one space; null turns come first; equal turns are ordered by role and text;
equal rows are counted, not carried, so any number of them is no burden; a null conversation id is a conversation of its
own; a conversation that has only rows of zero copies gives zeros, an empty audit and an empty text. Only the named
columns are read, so others may have any name. An empty table gives an empty result. Audit and repaired text are one
string a conversation, so 2 GB at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dockledger.llm.common import null_safe, stored

SPACE = " \t\n\v\f\r"
#: Rows and characters of a segment, after which it is cut: bounds what a search holds.
ROWS, CHARS = 256, 1 << 22

START, SYSTEM, USER, ASSISTANT, END = range(5)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The state after a row with this initial; what an inserted or reroled row becomes in each state, and the state after it.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAME = ["user", "user", "assistant", "user"]
NEXT = [USER, USER, ASSISTANT, USER]
#: What the end still needs in each state.
ENDING = ["", "II", "I", ""]
LEGAL = {"su", "ua", "au"}


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by the crc32 of `conv_id:turn`, modulo 20.

    0: no copy, 1: no text, 2: no `.!?`, 3: two copies, 4: role user; nulls count as one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """The different rows, how often each is there, whether the first of them is blank, truncated or seen earlier."""
    real = F.col("copies") > 0
    rows = rows.select("conv_id", *(F.when(real, F.col(c)).alias(c) for c in ("turn", "role", "text")), "copies")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    body = F.rtrim("text", F.lit(SPACE))
    rows = rows.withColumns({"blank": body == "", "cut": ~F.right(body, F.lit(1)).isin(".", "!", "?"), "said": F.sha2(F.concat(F.sha2("role", 256), "text"), 256)})
    # what is said at more than one turn, and the first of them; a turn is null or a number
    again = rows.where("copies > 0").groupBy("conv_id", "said").agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("at_null"), F.min("turn").alias("least"))
    again = again.where("n > 1").select("conv_id", "said", F.lit(True).alias("again"), F.when(~F.col("at_null"), F.col("least")).alias("first_turn"))
    earlier = F.coalesce(F.col("again") & ~F.col("turn").eqNullSafe(F.col("first_turn")), F.lit(False))
    return null_safe(rows, again, ["conv_id", "said"]).select("conv_id", "turn", "role", "text", "copies", "blank", "cut", earlier.alias("earlier"))


def items_of(rows: list[tuple]) -> list[tuple]:
    """What the search edits: (letters when deleted, cost when deleted, initial or None where deletion is required, cost of staying)."""
    items = []
    for _, role, _, copies, blank, cut, earlier in rows:
        if copies and not blank and not earlier:
            items.append(("D", DELETE, role[:1], TRUNCATED if cut else 0))
            copies -= 1
        if copies:
            items.append(("D" * copies, DELETE * copies, None, 0))
    return items


def bounds(items: list[tuple]) -> list[list[int]]:
    """The least cost of each suffix in each state when it may end in any state: a lower bound for every ending."""
    out = [[0] * 4]
    for _, delete, initial, stay in reversed(items):
        after, row = out[-1], []
        for q in range(4):
            least = delete + after[q]
            if initial is not None:
                least = min(least, REROLE + stay + after[NEXT[q]])
                if (q, initial) in AFTER:
                    least = min(least, KEEP + stay + after[AFTER[q, initial]])
            row.append(least)
        row = [min(row[q], INSERT + row[NEXT[q]], 2 * INSERT + row[NEXT[NEXT[q]]]) for q in range(4)]
        out.append(row)
    return out[::-1]


def first_limit(items: list[tuple], lower: list[list[int]], entry: int, goal: int) -> int:
    """The cost of some edits that reach the goal: the best moves by the bounds, then what the goal lacks."""
    everything = sum(x[1] for x in items)
    if goal in (START, SYSTEM):
        return everything
    q, cost = entry, 0
    for i, (_, delete, initial, stay) in enumerate(items if goal == END else items[:-1]):
        moves = []
        for inserts in range(3):
            if initial is not None:
                moves.append((inserts * INSERT + REROLE + stay, NEXT[q]))
                if (q, initial) in AFTER:
                    moves.append((inserts * INSERT + stay, AFTER[q, initial]))
            moves.append((inserts * INSERT + delete, q))
            q = NEXT[q]
        step, q = min(moves, key=lambda m: m[0] + lower[i + 1][m[1]])
        cost += step
    if goal == END:
        return cost + INSERT * len(ENDING[q])
    while q != goal:
        q, cost = NEXT[q], cost + INSERT
    return cost + items[-1][1]


def search(items: list[tuple], entry: int, goal: int) -> tuple[int, str] | None:
    """Least (cost, audit) from state `entry` to state `goal`, or to END with the rows the ending needs; None if no way leads there.

    Moves are tried in ASCII order, so complete audits come in that order too: what reaches a node later must cost less
    than all before to be better, and the first of the cheapest is the incumbent that stays.
    """
    if not items and goal != END:
        return (0, "") if entry == goal else None
    lower = bounds(items)
    limit, incumbent, last = first_limit(items, lower, entry, goal), None, len(items)
    dominated: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, int, int, tuple | None]] = [(0, entry, 0, None)]
    while stack:
        i, q, cost, trail = stack.pop()
        if cost + lower[i][q] > limit or dominated.get((i, q), cost + 1) <= cost:
            continue
        dominated[i, q] = cost
        if i == last:
            if q == goal or (goal == END and not ENDING[q]):
                incumbent, limit = (cost, trail), cost - 1
            elif goal == END:
                stack.append((i, NEXT[q], cost + INSERT, (trail, "I")))
            continue
        letters, delete, initial, stay = items[i]
        if initial is not None:
            stack.append((i + 1, NEXT[q], cost + REROLE + stay, (trail, "R")))
            if (q, initial) in AFTER:
                stack.append((i + 1, AFTER[q, initial], cost + KEEP + stay, (trail, "K")))
        stack.append((i, NEXT[q], cost + INSERT, (trail, "I")))
        stack.append((i + 1, q, cost + delete, (trail, letters)))
    if incumbent is None:
        return None
    letters, trail = [], incumbent[1]
    while trail:
        trail, x = trail
        letters.append(x)
    return incumbent[0], "".join(reversed(letters))


def applied(rows: list[tuple], entry: int, audit: str) -> list[str]:
    """The repaired `role:text` lines that an audit makes of the rows."""
    left = (x for row in rows for x in [row] * row[3])
    out, q = [], entry
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter == "K":
            q = AFTER[q, row[1][:1]]
            out.append(f"{row[1]}:{row[2]}")
        else:
            out.append(f"{NAME[q]}:{row[2] if row else ''}")
            q = NEXT[q]
    return out


class Counts:
    """Faults, turns and role borders of rows in order; parts of a conversation add up."""

    __slots__ = ("blank", "cut", "duplicate", "first", "high", "illegal", "last", "low", "n", "turn", "turns")

    def __init__(self) -> None:
        self.n = self.blank = self.duplicate = self.cut = self.illegal = self.turns = 0
        self.low = self.high = self.turn = self.first = self.last = None

    def add(self, row: tuple) -> None:
        turn, role, _, copies, blank, cut, earlier = row
        if not copies:
            return
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.high = self.turn = turn
        fresh = not blank and not earlier
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies - fresh
        self.cut += bool(fresh and cut)
        initial = role[:1]
        self.illegal += copies - 1 + (self.n > 0 and self.last + initial not in LEGAL)
        self.n, self.last = self.n + copies, initial

    def values(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.cut, "illegal": self.illegal}


def _runs(batches: Iterator[pa.RecordBatch]):
    """(conversation, whether its first rows, whether its last rows, rows) of each segment of a task's sorted rows."""
    rows, chars, key, first = [], 0, None, True
    begun = False
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and conv != key:
                yield key, first, True, rows
                rows, chars, first = [], 0, True
            elif len(rows) >= ROWS or chars >= CHARS:
                yield key, first, False, rows
                rows, chars, first = [], 0, False
            begun, key = True, conv
            rows.append(tuple(row))
            chars += len(row[2] or "")
    if begun:
        yield key, first, True, rows


def _result_type(conv: T.DataType) -> T.StructType:
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return T.StructType([T.StructField("conv_id", conv), *(T.StructField(c, T.LongType()) for c in longs), *(T.StructField(c, T.StringType()) for c in ("audit", "repaired"))])


def _batches(records: Iterator[tuple[dict, int]], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for record, n in records:
        out.append(record)
        size += n
        if len(out) >= 1000 or size >= CHARS:
            yield pa.RecordBatch.from_pylist(out, schema=kind)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=kind)


def _segments(sorted_rows: DataFrame) -> DataFrame:
    """Results of conversations that lie whole inside a segment; the segments (part, seq, rows) of all others."""
    conv = sorted_rows.schema["conv_id"].dataType
    row = T.StructType(sorted_rows.schema.fields[1:])
    schema = T.StructType([*_result_type(conv), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("rows", T.ArrayType(row))])
    kind, names = to_arrow_schema(schema), row.names

    def records(batches: Iterator[pa.RecordBatch]):
        part, runs, seq = TaskContext.get().partitionId(), _runs(batches), 0
        here = next(runs, None)
        while here:
            following = next(runs, None)
            key, first, last, rows = here
            if first and last and seq and following:
                counts = Counts()
                for r in rows:
                    counts.add(r)
                cost, audit = search(items_of(rows), START, END)
                repaired = "\n".join(applied(rows, START, audit))
                yield {"conv_id": key, **counts.values(), "cost": cost, "audit": audit, "repaired": repaired}, len(repaired)
            else:  # the task's first and last conversation may lie in other tasks as well
                yield {"conv_id": key, "part": part, "seq": seq, "rows": [dict(zip(names, r)) for r in rows]}, sum(len(r[2] or "") for r in rows)
            here, seq = following, seq + 1

    return sorted_rows.mapInArrow(lambda batches: _batches(records(batches), kind), schema)


def _whole(segments: DataFrame) -> DataFrame:
    """Results of the conversations whose segments are given, sorted in order in each task."""
    schema = _result_type(segments.schema["conv_id"].dataType)
    kind = to_arrow_schema(schema)

    def finish(key, counts: Counts, states: dict) -> tuple[dict, int]:
        cost, _, q = min((cost + INSERT * len(ENDING[q]), rank, q) for q, (cost, rank, _) in states.items())
        trail, audits, lines = states[q][2], [ENDING[q]], ["\n".join(applied([], q, ENDING[q]))]
        while trail:
            trail, audit, text = trail
            audits.append(audit)
            lines.append(text)
        repaired = "\n".join(x for x in reversed(lines) if x)
        return {"conv_id": key, **counts.values(), "cost": cost, "audit": "".join(reversed(audits)), "repaired": repaired}, len(repaired)

    def records(batches: Iterator[pa.RecordBatch]):
        key, counts, states = None, None, None
        for batch in batches:
            for conv, rows in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rows"))):
                if states is None or conv != key:
                    if states is not None:
                        yield finish(key, counts, states)
                    key, counts, states = conv, Counts(), {START: (0, 0, None)}
                rows = [tuple(r.values()) for r in rows]
                for r in rows:
                    counts.add(r)
                items, best = items_of(rows), {}
                for q, (before, rank, _) in states.items():
                    for goal in range(4):
                        if way := search(items, q, goal):
                            best[goal] = min(best.get(goal, (float("inf"),)), (before + way[0], rank, way[1], q))
                # a smaller audit before stays smaller whatever follows, so its rank is all that is compared later
                order = sorted(best, key=lambda g: best[g][1:3])
                lines = {g: "\n".join(applied(rows, best[g][3], best[g][2])) for g in order}
                states = {g: (best[g][0], rank, (states[best[g][3]][2], best[g][2], lines[g])) for rank, g in enumerate(order)}
        if states is not None:
            yield finish(key, counts, states)

    return segments.select("conv_id", "rows").mapInArrow(lambda batches: _batches(records(batches), kind), schema)


def repair(rows: DataFrame, shown: Callable[[Column], Column] = F.col) -> DataFrame:
    """Each conversation of rows (conv_id, turn, role, text, copies) with its faults, the cheapest edits and the repaired text.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (`role:text` lines, or what
    `shown` makes of them, for instance a digest: then they are stored nowhere). Rows of no copies only make their
    conversation known.
    """
    rows = stored(faults(rows), "conversation-rows")
    head = F.substring("text", 1, 64)  # bounds of ranges need no whole texts
    rows = rows.withColumn("head", head).repartitionByRange("conv_id", "turn", "role", "head").drop("head")
    found = _segments(rows.sortWithinPartitions("conv_id", "turn", "role", "text"))
    found = stored(found.withColumn("repaired", shown("repaired")), "conversation-segments")
    open_ = found.where("rows IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return found.where("rows IS NULL").drop("part", "seq", "rows").unionByName(_whole(open_).withColumn("repaired", shown("repaired")))


ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
      lambda crc, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, b)),
      4294967295::BIGINT) AS crc
  FROM conversations),
hit AS (SELECT conv_id, turn, role, text, xor(crc, 4294967295) % 20 AS kind FROM keyed),
rows0 AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
ordered AS MATERIALIZED (
  SELECT *, left(role, 1) AS initial, rtrim(text, E' \t\n\x0b\f\r') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM rows0),
faults AS MATERIALIZED (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM ordered),
convs AS (
  SELECT c.conv_id, count(f.pos) AS n, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0) AS gaps,
    count(*) FILTER (f.fault = 'b') AS blank, count(*) FILTER (f.fault = 'd') AS duplicate,
    count(*) FILTER (f.fault = 't') AS truncated, count(*) FILTER (f.illegal) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM convs
  UNION ALL
  SELECT conv_id, pos, q, cost, audit, lines FROM (
    SELECT w.conv_id, f.pos,
      CASE move WHEN 'D' THEN p WHEN 'R' THEN CASE p WHEN 2 THEN 3 ELSE 2 END ELSE CASE f.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS q,
      w.cost + 3 * inserts + CASE move WHEN 'D' THEN 4 ELSE CASE move WHEN 'R' THEN 3 ELSE 0 END + CASE f.fault WHEN 't' THEN 3 ELSE 0 END END AS cost,
      w.audit || repeat('I', inserts) || move AS audit,
      w.lines || CASE WHEN inserts = 0 THEN [] WHEN inserts = 1 THEN CASE w.q WHEN 2 THEN ['assistant:'] ELSE ['user:'] END
          ELSE CASE w.q WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END END
        || CASE move WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE p WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text] END AS lines
    FROM (SELECT walk.*, inserts, CASE inserts WHEN 0 THEN q WHEN 1 THEN CASE q WHEN 2 THEN 3 ELSE 2 END ELSE CASE q WHEN 2 THEN 2 ELSE 3 END END AS p
          FROM walk, (VALUES (0), (1), (2)) i(inserts)) w
    JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1
    JOIN (VALUES ('D'), ('K'), ('R')) m(move)
      ON move = 'D' OR (f.fault NOT IN ('b', 'd') AND (move = 'R' OR (f.initial = 's' AND p = 0) OR (f.initial = 'u' AND p <> 2) OR (f.initial = 'a' AND p = 2))))
  QUALIFY row_number() OVER (PARTITION BY conv_id, pos, q ORDER BY cost, audit) = 1),
ends AS (
  SELECT * FROM (SELECT walk.conv_id, cost + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS cost,
    audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    lines || CASE q WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END AS lines
  FROM walk JOIN convs ON convs.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.pos = convs.n)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT convs.conv_id, gaps, blank, duplicate, truncated, illegal, ends.cost::BIGINT AS cost, ends.audit, sha256(array_to_string(ends.lines, chr(10))) AS repaired_sha256
FROM convs JOIN ends ON convs.conv_id IS NOT DISTINCT FROM ends.conv_id
"""
