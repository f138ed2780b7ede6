"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the mean number of its copies in the mix. Among all rates with which each source has its
target of words, the rates nearest to one (in relative entropy) are min(most, exp(tilt * size / unit)); the tilt of
a source is where the derivative of its convex dual is zero. Newton steps find all tilts at once: each step is one
aggregate over the table (source, size, number of documents), which is far smaller than the documents. The rates are
then rounded to whole copies so that a source misses its target by a few words.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dockledger.llm.common import WORD, fresh, stored

#: Rates are rounded to this fraction before copies are dealt, so sums are exact in any order.
UNIT = 1_000_000
STEPS = 80
#: Parts in which the documents of one source and size are numbered.
SALTS = 1024
#: Rounds in which a document of each source gets one copy more or less to meet the target.
CORRECTIONS = 3
#: Width of the ranges of sizes over which running sums are made in two levels.
SIZE_RANGE = 256
RESULT = {"size", "source_size", "target", "rate", "copies", "taken"}


def word_count(text) -> F.Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the total by weight; none above `most` times its size, the excess goes to the others by weight."""
    total, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = Fraction(total)
    exact = [Fraction(w) for w in weights]
    while open_:
        weight = sum(exact[i] for i in open_)
        full = {i for i in open_ if weight == 0 or left * exact[i] >= Fraction(most) * sizes[i] * weight}
        if not full:
            for i in open_:
                out[i] = float(left * exact[i] / weight)
            break
        for i in full:
            out[i] = float(Fraction(most) * sizes[i]) if weight else 0.0
            left -= Fraction(most) * sizes[i]
        open_ -= full
    return out


def tilts(hist: DataFrame, size: dict[int, int], target: dict[int, float], most: float) -> dict[int, float]:
    """The tilt of each source: Newton steps on the dual, kept inside a bracket that halves when a step leaves it.

    hist: (sid, size, n). Sums are decimals, so they do not depend on the order of tasks.
    """
    stats = {r.sid: r for r in hist.filter("size > 0").groupBy("sid").agg(
        F.min("size").alias("least"), F.max("size").alias("largest"), F.sum("n").alias("n")).collect()}
    unit = {s: size[s] / stats[s].n for s in stats}
    # At the upper end the smallest document has the highest rate already.
    high = {s: math.log(most) * unit[s] / stats[s].least if most > 1 else 0.0 for s in stats}
    found = {s: high[s] for s in stats if target[s] >= most * size[s]}
    found |= {s: 0.0 for s in stats if s not in found and target[s] == size[s]}
    found |= {s: -math.inf for s in stats if target[s] <= 0}
    low = {s: -700.0 * unit[s] / stats[s].least for s in stats}
    at = {s: 0.0 for s in stats if s not in found}
    for _ in range(STEPS):
        if not at:
            break
        rows = [(s, at[s] / unit[s], 1 / unit[s]) for s in at]
        step = F.broadcast(hist.sparkSession.createDataFrame(rows, "sid int, slope double, scale double"))
        rate = F.exp(F.least(F.col("slope") * F.col("size"), F.lit(math.log(most))))
        free = F.col("slope") * F.col("size") < math.log(most)
        words = F.col("n").cast("double") * F.col("size")
        sums = hist.join(step, "sid").groupBy("sid").agg(
            F.sum((words * rate).cast("decimal(38,9)")).alias("got"),
            F.sum(F.when(free, words * rate * F.col("size") * F.col("scale")).otherwise(0.0).cast("decimal(38,9)"))
            .alias("slope"),
        )
        for r in sums.collect():
            s, miss = r.sid, float(r.got) - target[r.sid]
            if abs(miss) <= 1e-9 * target[s]:
                found[s] = at.pop(s)
                continue
            low[s], high[s] = (at[s], high[s]) if miss < 0 else (low[s], at[s])
            slope = float(r.slope)
            newton = at[s] - miss / slope if slope > 0 else math.inf
            nearer = newton if low[s] < newton < high[s] else (low[s] + high[s]) / 2
            if nearer == at[s] or high[s] - low[s] <= 1e-15 * max(1.0, abs(low[s])):
                found[s] = at.pop(s)
            else:
                at[s] = nearer
    found |= at
    return {s: found[s] / unit[s] if math.isfinite(found[s]) else -math.inf for s in found}


def _corrected(cells: DataFrame, sid: str, at: str, goal: dict[int, float], most: float) -> DataFrame:
    """Adds shift: -1, 0 or 1 copies for the first document of a cell.

    Rounding leaves a source up to one long document from its target. In each round the cell of each source whose
    size is nearest to what is missing or too much gets a shift, if that helps and its first document stays in range.
    """
    half = UNIT // 2
    passed = F.floor((F.col("before") + F.col("part") * F.col("n") + half) / UNIT) - F.floor((F.col("before") + half) / UNIT)
    whole = F.floor(F.col("units") / UNIT)
    first = whole + F.floor((F.col("before") + F.col("part") + half) / UNIT) - F.floor((F.col("before") + half) / UNIT)
    cells = cells.withColumn("shift", F.lit(0))
    for _ in range(CORRECTIONS):
        taken = F.sum(F.col(at) * (whole * F.col("n") + passed + F.col("shift")))
        rows = [(r[0], goal[r[0]] - float(r[1])) for r in cells.groupBy(sid).agg(taken).collect()]
        miss = cells.sparkSession.createDataFrame(rows, f"{sid} int, miss double")
        near = cells.join(F.broadcast(miss), sid).withColumn("sign", F.signum("miss").cast("int"))
        after = F.abs(F.col("miss") - F.col("sign") * F.col(at))
        fits = (F.col("shift") == 0) & (first + F.col("sign")).between(0, int(most)) & (after < F.abs("miss"))
        best = near.filter(fits).groupBy(sid).agg(F.min(F.struct(after.alias("after"), F.col(at), F.col("sign"))).alias("b"))
        picked = [(r[0], r.b[1], r.b[2]) for r in best.collect()]  # at most one cell a source
        found = cells.sparkSession.createDataFrame(picked, f"{sid} int, {at} long, more int")
        cells = cells.join(F.broadcast(found), [sid, at], "left").withColumn(
            "shift", F.col("shift") + F.coalesce("more", F.lit(0))
        ).drop("more")
    return cells


def mix_sources(
    docs: DataFrame, weights=(1.0, 2.0, 3.0), most: float = 3.0, text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """The columns `carry` of docs (default: all), then size, source_size, target, rate, copies, taken (copies x size).

    Sources are ordered by code point, null last, and get the weights in turn; their number bounds what the driver
    holds (one row a source), and every document counts. A null or empty text has size 0, rate 1 and takes nothing.
    A source without words has target 0. Rows with equal doc_id or text are rounded each for itself. Columns of docs
    with the name of a result column are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULT]
    sid, at, salt, row, name = (fresh(docs, f"mix_{x}") for x in ("sid", "size", "salt", "row", "source"))
    sized = docs.select(
        *(docs[c] for c in carry),
        docs["source"].alias(name),
        word_count(docs[text]).alias(at),
        F.xxhash64(docs["doc_id"], docs[text]).alias(row),
        docs["doc_id"].alias(f"{row}_id"),
    )
    per_source = stored(sized.groupBy(name, at).agg(F.count("*").alias("n")), "mix-sizes")
    sources = sorted(
        ((r[0], int(r[1])) for r in per_source.groupBy(name).agg(F.sum(F.col(at) * F.col("n"))).collect()),
        key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")),
    )
    size = {i: words for i, (_, words) in enumerate(sources)}
    shares = list(itertools.islice(itertools.cycle(weights), len(sources)))
    goal = dict(enumerate(targets(list(size.values()), shares, most)))
    numbered = spark.createDataFrame(
        [(source, i, size[i], goal[i]) for i, (source, _) in enumerate(sources)],
        f"{name}_r string, {sid} int, source_size long, target double",
    )

    def with_source(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(numbered), df[name].eqNullSafe(numbered[f"{name}_r"])).drop(f"{name}_r")

    hist = with_source(per_source).select(sid, at, "n")
    tilt = tilts(hist.toDF("sid", "size", "n"), size, goal, most)
    slopes = spark.createDataFrame([(i, tilt.get(i, 0.0)) for i in size], f"{sid} int, slope double")
    tilted = F.exp(F.least(F.col("slope") * F.col(at), F.lit(math.log(most))))
    hist = hist.join(F.broadcast(slopes), sid).withColumn("rate", F.when(F.col(at) == 0, 1.0).otherwise(tilted))
    hist = hist.withColumn("units", F.round(F.col("rate") * UNIT).cast("long"))
    hist = hist.withColumn("part", F.col("units") % UNIT).withColumn("sum", F.col("part") * F.col("n"))
    # Running sum of the fractions over the sizes of a source, in two levels so that no window spans a whole source.
    hist = hist.withColumn("range", F.floor(F.col(at) / SIZE_RANGE))
    ranges = hist.groupBy(sid, "range").agg(F.sum("sum").alias("range_sum"))
    ranges = ranges.withColumn(
        "before_range", F.sum("range_sum").over(W.partitionBy(sid).orderBy("range")) - F.col("range_sum")
    )
    inside = W.partitionBy(sid, "range").orderBy(at)
    cells = hist.join(ranges, [sid, "range"]).select(
        sid, at, "rate", "units", "part",
        (F.col("before_range") + F.sum("sum").over(inside) - F.col("sum")).alias("before"),
    )
    cells = _corrected(stored(cells.join(hist.select(sid, at, "n"), [sid, at]), "mix-cells"), sid, at, goal, most)
    # A cell is a source and a size; its documents are numbered by salt, then by document, so no cell is one group.
    sized = with_source(sized).withColumn(salt, F.pmod(F.col(row), F.lit(SALTS)).cast("int"))
    salted = sized.groupBy(sid, at, salt).agg(F.count("*").alias("m"))
    salted = salted.withColumn("earlier", F.sum("m").over(W.partitionBy(sid, at).orderBy(salt)) - F.col("m"))
    salted = salted.join(cells, [sid, at]).select(
        sid, at, salt, "rate", "units", "part", "shift", "earlier", (F.col("before") + F.col("part") * F.col("earlier")).alias("before")
    )
    number = F.row_number().over(W.partitionBy(sid, at, salt).orderBy(F.col(f"{row}_id").asc_nulls_last(), row))
    dealt = sized.join(salted, [sid, at, salt]).withColumn("number", number.cast("long"))
    upto = F.col("before") + F.col("part") * F.col("number") + UNIT // 2
    extra = F.floor(upto / UNIT) - F.floor((upto - F.col("part")) / UNIT)
    first = (F.col("earlier") == 0) & (F.col("number") == 1)
    copies = (F.floor(F.col("units") / UNIT) + extra + F.when(first, F.col("shift")).otherwise(0)).cast("long")
    return dealt.select(
        *carry, F.col(at).alias("size"), "source_size", "target", "rate",
        copies.alias("copies"), (copies * F.col(at)).alias("taken"),
    )
