"""Joins and numbering that stay balanced when keys hold very many rows.

Keys with more than `HEAVY_ROWS` rows are counted exactly when a table is stored, and kept in a small table beside it:
key, rows. A join deals the rows of such a key over salts in proportion to their number; numbering gives such a group
to many tasks. The limit is a number of rows that one task can hold, so it does not move with the size of the tables,
and there is no limit to the number of heavy keys. Results are always the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dockledger.functions.storage import stored

HEAVY_ROWS = 2_000_000
SALT_ROWS = 500_000  # rows of a heavy key for each salt
BROADCAST_KEYS = 500_000  # heavy keys up to this number are broadcast, about 50 bytes each
STAND_INS = 1 << 20  # stand-in keys over which rows without a key spread
_SEPARATOR = "\u0000"


class HeavyKeys:
    """The heavy keys of one key of a table: a DataFrame (key, rows) and how many there are."""

    def __init__(self, keys: DataFrame, count: int, heavy_rows: int = HEAVY_ROWS) -> None:
        self.keys, self.count = keys, count
        self.salt_rows = max(1, min(SALT_ROWS, heavy_rows))

    def salts(self, key: str, salts: str) -> DataFrame:
        """Key and number of salts, broadcast only while their number is small."""
        named = self.keys.select(F.col("key").alias(key), F.ceil(F.col("rows") / self.salt_rows).cast("int").alias(salts))
        return F.broadcast(named) if self.count <= BROADCAST_KEYS else named

    def trimmed(self) -> HeavyKeys:
        """The same for a key from which blanks are cut off."""
        keys = self.keys.groupBy(F.trim("key").alias("key")).agg(F.sum("rows").alias("rows"))
        return HeavyKeys(keys, self.count, self.salt_rows)

    def through(self, pairs: DataFrame) -> HeavyKeys:
        """The same for another key that goes with this one: pairs of (key, other)."""
        found = pairs.join(self.salts("key", "_salts"), "key").groupBy(F.col("other").alias("key"))
        rows = found.agg((F.sum("_salts") * self.salt_rows).alias("rows"))
        return HeavyKeys(rows, self.count, self.salt_rows)


def count_heavy_keys(df: DataFrame, columns: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Every key of the columns with more rows than the limit: key, rows. Rows without a key do not count."""
    keys = df.select(joined_key(columns).alias("key")).filter(F.col("key").isNotNull())
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > heavy_rows)


def joined_key(columns: Sequence[str]) -> Column:
    """One text for the key columns; NULL if one of them is."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    return F.concat(*[part for name in columns for part in (F.lit(_SEPARATOR), F.col(name).cast("string"))])


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    spread_by: Sequence[str],
    hot: HeavyKeys | None = None,
    blank_matches: bool = True,
) -> DataFrame:
    """Equi-join whose left side may have heavy, missing or blank keys.

    Left rows without a key match nothing, yet would all meet in one task: they get
    a stand-in key by a hash of `spread_by`, which starts with a NUL character that no
    real key has. The rows of a heavy key are dealt over its salts, and the right
    rows of that key go to each of them. The result has the left columns and the
    right columns that are not keys.
    """
    if hot is None and blank_matches and how in ("inner", "left_semi"):
        return left.join(right, list(on), how)  # Spark drops left rows without a key before the shuffle
    first, rest = on[0], list(on[1:])
    key = F.col(first).cast("string").alias("_key")
    unmatched = F.col(first).isNull()
    if not blank_matches:
        unmatched = unmatched | (F.col(first) == "")
    if how in ("left", "left_anti"):
        # As many as spread over any number of tasks; the texts themselves would be shuffled twice.
        stand_in = F.concat(F.lit(_SEPARATOR), F.pmod(F.xxhash64(*spread_by), F.lit(STAND_INS)).cast("string"))
        left_columns = [F.when(unmatched, stand_in).otherwise(F.col(first).cast("string")).alias("_key")]
    else:
        left_columns = [key]
        if not blank_matches:
            left = left.filter(~unmatched)
    right_columns = [key, *[name for name in right.columns if name != first]]
    join_on = ["_key", *rest]
    columns = left.columns
    # Where the key that is joined tells the text it was made of, that text is not shuffled beside it.
    told = how in ("left", "left_anti") and blank_matches and hot is None and isinstance(left.schema[first].dataType, StringType)
    left, right = left.select("*", *left_columns), right.select(*right_columns)
    if told and first not in spread_by:
        found = left.drop(first).join(right, join_on, how)
        text = F.when(~F.col("_key").startswith(_SEPARATOR), F.col("_key")).alias(first)
        added = [] if how == "left_anti" else [c for c in right_columns[1:] if c not in rest]
        return found.select(*[text if c == first else c for c in columns], *added)
    if hot is not None:
        known = hot.salts("_heavy", "_salts")
        left = left.withColumn("_joined", joined_key(on)).join(known, F.col("_joined") == F.col("_heavy"), "left")
        dealt = F.pmod(F.xxhash64(*spread_by), F.coalesce("_salts", F.lit(1))).cast("int")
        left = left.withColumn("_salt", dealt).drop("_joined", "_heavy", "_salts")
        right = right.withColumn("_joined", joined_key(join_on)).join(known, F.col("_joined") == F.col("_heavy"), "left")
        every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
        right = right.withColumn("_salt", F.explode(every)).drop("_joined", "_heavy", "_salts")
        join_on.append("_salt")
    return left.join(right, join_on, how).drop("_key", "_salt")


def fan_out_join(
    one: DataFrame,
    many: DataFrame,
    key: str,
    *,
    spread_by: Sequence[str],
    hot: HeavyKeys | None = None,
    missing_by: Sequence[str] = (),
) -> DataFrame:
    """Left join of documents with their lines, where one document may hold most lines.

    `spread_by` tells lines of one document apart; `missing_by` tells documents apart
    whose key may be NULL.
    """

    def join(one: DataFrame, many: DataFrame) -> DataFrame:
        return skew_join(one, many, [key], spread_by=missing_by) if missing_by else one.join(many, key, "left")

    if hot is None:
        return join(one, many)
    known = hot.salts(key, "_salts").select(key)
    one_hot, many_hot = one.join(known, key, "left_semi"), many.join(known, key, "left_semi")
    dealt = skew_join(many_hot, one_hot, [key], "inner", spread_by=spread_by, hot=hot)
    lonely = one_hot.join(many_hot.select(key).distinct(), key, "left_anti")
    cold = join(one.join(known, key, "left_anti"), many.join(known, key, "left_anti"))
    return cold.unionByName(dealt).unionByName(lonely, allowMissingColumns=True)


def with_group_min(
    df: DataFrame, group: Sequence[str], value: Column, name: str, *, spread_by: Sequence[str], hot: HeavyKeys | None = None
) -> DataFrame:
    """Adds the smallest value of each row's group."""
    if hot is None:
        return df.withColumn(name, F.min(value).over(Window.partitionBy(*group)))
    smallest = df.groupBy(*group).agg(F.min(value).alias(name))
    return skew_join(df, smallest, group, "left", spread_by=spread_by, hot=hot)


def number_within(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    *,
    hot: HeavyKeys | None = None,
    last: str | None = None,
) -> DataFrame:
    """Numbers the rows of each group 1..n in order; `last` flags the row numbered n.

    Heavy groups are range-partitioned, so that many tasks share one group, and stored in the shared folder, since the
    ranges belong to one run. Their rows are numbered within (group, range), plus the rows of earlier ranges.
    """
    window = Window.partitionBy(*group).orderBy(*order)

    def in_window(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(name, F.row_number().over(window).cast("long"))
        return rows if last is None else rows.withColumn(last, F.lead(F.lit(1)).over(window).isNull())

    if hot is None:
        return in_window(df)
    known = hot.salts("_heavy", "_salts")
    marked = df.withColumn("_joined", joined_key(group)).join(known, F.col("_joined") == F.col("_heavy"), "left")
    marked = marked.withColumn("_is_heavy", F.col("_heavy").isNotNull()).drop("_joined", "_heavy", "_salts")
    ranged = marked.filter("_is_heavy").drop("_is_heavy").repartitionByRange(*group, *order)
    ranged = stored(ranged.withColumn("_range", F.spark_partition_id()), "numbered")
    runs = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    runs = runs.withColumn("_all", F.sum("_rows").over(Window.partitionBy(*group))).drop("_rows")
    within = Window.partitionBy(*group, "_range").orderBy(*order)
    numbered = ranged.withColumn("_nth", F.row_number().over(within)).join(runs, [*group, "_range"])
    numbered = numbered.withColumn(name, (F.col("_nth") + F.col("_before")).cast("long"))
    if last is not None:
        numbered = numbered.withColumn(last, F.col(name) == F.col("_all"))
    numbered = numbered.drop("_range", "_nth", "_before", "_all")
    return in_window(marked.filter(~F.col("_is_heavy")).drop("_is_heavy")).unionByName(numbered)
