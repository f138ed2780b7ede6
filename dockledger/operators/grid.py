"""Filters, orders and edits of the rows shown in a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.functions.columns import contains_any
from dockledger.functions.skew import skew_join


def grid_filter_sort(df: DataFrame, filters: dict[str, str], order: list[tuple[str, bool]]) -> DataFrame:
    """Text filters per column (contains, regardless of case), then columns with True for ascending."""
    for column, text in filters.items():
        df = df.filter(contains_any([F.col(column).cast("string")], text, ignore_case=True))
    return df.orderBy(*[F.asc(column) if ascending else F.desc(column) for column, ascending in order])


def bulk_status_change(detail: DataFrame, keys: DataFrame, status: str) -> DataFrame:
    """Edits for all shown detail rows, with the status changed on the selected ones.

    `keys` selects rows by `receipt_no` and `line_seq`. Rows without an item are headers
    without lines; there is nothing to edit in them. `seq` is the row's line sequence, as a number.
    """
    chosen = keys.select("receipt_no", "line_seq").distinct().withColumn("chosen", F.lit(True))
    rows = detail.filter(F.col("item_code").isNotNull())
    rows = skew_join(rows, chosen, ["receipt_no", "line_seq"], spread_by=["line_seq", "item_code"])
    return rows.select(
        F.col("line_seq").try_cast("long").alias("seq"),
        "receipt_no",
        "item_code",
        "qty",
        F.when(F.col("chosen"), F.lit(status)).otherwise(F.col("status")).alias("status"),
    )
