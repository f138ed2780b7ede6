import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from compare import connect, duck_rows, spark_rows
from dockledger.llm import conversation_repair as cr
from dockledger.llm.queries import ORACLE, op13_conversation_repair

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("role", "text", "COPIES", "audit", "rows", "seq"))])
WORD = re.compile(r"[^\x20\x09-\x0D]")
FORM = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """The contract's damage in plain Python: conversation -> rows (turn, role, text) in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out[conv]
        if kind == 0:
            continue
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        kept += [row, row] if kind == 3 else [row]
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def fault(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = WORD.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired lines) by trying partial edits in the order of (cost, audit); no bounds."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = (i, "" if not roles else "s" if roles == "s" else roles[-1])
        if state in done:
            continue
        done.add(state)
        if i == len(rows) and FORM.fullmatch(roles):
            return cost, audit, lines
        steps = [(3, "I", i, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((4, "D", i + 1, None, None))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                steps += [(more, "K", i + 1, role, f"{role}:{text}"), *((3 + more, "R", i + 1, r, f"{r}:{text}") for r in ("user", "assistant"))]
        for more, letter, j, role, line in steps:
            now = roles if role is None else roles + (role[:1] or "?")
            if role is None or re.fullmatch(r"s?(ua)*u?", now):
                heapq.heappush(heap, (cost + more, audit + letter, j, now, lines if line is None else (*lines, line)))


def expected(rows, convs):
    out = {}
    damaged = damage(rows)
    for conv in convs:
        r = damaged.get(conv, [])
        faults = fault(r)
        turns = [t for t, _, _ in r if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(r))
        cost, audit, lines = cheapest(r, faults)
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines))
    return out


def conversations(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "yes", "A long answer!", " \t", "", None, "What?  ", "no end", "…", "Same."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "assist"])
            text = rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.random()}{rng.choice(['.', '', '! ', '?'])}"
            rows.append((conv, rng.choice([turn, turn, turn, 3 * turn, turn // 2, None]), role, text))
    rows += [(None, 1, "user", "Hm."), (None, 0, None, None), (None, None, "system", "x."), *[rows[0]] * 5]
    rng.shuffle(rows)
    return rows


def run(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA).repartition(partitions)
    out = cr.repair(cr.damaged(df)).collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


def test_repair_equals_brute_force_on_odd_rows(spark):
    rows = conversations(1, 150, 9)
    assert run(spark, rows) == expected(rows, {r[0] for r in rows})


@pytest.mark.parametrize("limit", [1, 2, 7])
def test_segments_make_the_same_whole(spark, monkeypatch, limit):
    rows = conversations(limit, 25, 40)
    monkeypatch.setattr(cr, "ROWS", limit)
    assert run(spark, rows) == expected(rows, {r[0] for r in rows})


def test_one_conversation_of_most_rows(spark):
    rng = random.Random(8)
    role = lambda: rng.choice(["user", "assistant", "system", "assistant", "user"])
    rows = [(5, t, role(), rng.choice(["Well.", "ok", f"{t}."])) for t in range(3000)] + [(5, 7, "user", "again.")] * 2000 + conversations(2, 20, 5)
    got = run(spark, rows, 8)
    assert got == expected(rows, {r[0] for r in rows})


def test_nothing_left_and_nothing_given(spark):
    lost = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = run(spark, lost)
    assert lost and set(got) == {c for c, *_ in lost} and set(got.values()) == {(0, 0, 0, 0, 0, 0, "", "")}
    assert run(spark, []) == {}


def test_search_keeps_to_every_goal():
    """All ways between two states of short random rows, against the search."""
    rng = random.Random(4)
    for _ in range(300):
        rows = [(0, rng.choice(["user", "assistant", "system", "x"]), "t", rng.choice([1, 1, 2]), rng.random() < 0.2, rng.random() < 0.3, rng.random() < 0.2) for _ in range(rng.randint(0, 4))]
        items = cr.items_of(rows)
        for entry in range(4):
            ways = {(0, "", entry, 0)}
            best = {}
            todo = list(ways)
            while todo:
                cost, audit, q, i = todo.pop()
                if i == len(items):
                    best[q] = min(best.get(q, (9**9, "")), (cost, audit))
                    continue
                letters, delete, initial, stay = items[i]
                starts = [(cost, audit, q), (cost + 3, audit + "I", cr.NEXT[q]), (cost + 6, audit + "II", cr.NEXT[cr.NEXT[q]])]
                for c, a, p in starts:
                    todo.append((c + delete, a + letters, p, i + 1))
                    if initial is not None:
                        todo.append((c + 3 + stay, a + "R", cr.NEXT[p], i + 1))
                        if (p, initial) in cr.AFTER:
                            todo.append((c + stay, a + "K", cr.AFTER[p, initial], i + 1))
            assert {g: cr.search(items, entry, g) for g in range(4)} == {g: best.get(g) for g in range(4)}


def test_query_gives_the_contract(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = op13_conversation_repair(spark, sf)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = expected(rows, {r[0] for r in rows})
    assert {r.conv_id: tuple(r)[1:] for r in out.collect()} == {c: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest()) for c, v in want.items()}
    assert sum(v[5] for v in want.values()) > 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(op13_conversation_repair(spark, sf)) == duck_rows(connect(sf), ORACLE["op13_conversation_repair"])
