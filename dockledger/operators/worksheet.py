"""Receiving worksheets: from purchase-order lines to registration lines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.functions.columns import DEFAULT_UNIT, OPEN, compact_date, month_code, month_label, text_or, typed_quantity
from dockledger.functions.skew import HeavyKeys, number_within, skew_join
from dockledger.sources.requests import DEFAULT_STORE

DEFAULT_DELIVERY = 10

_COLUMNS = [
    "po_no", "item_group", "item_code", "part_no", "item_name", "month", "ordered_qty", "received_qty",
    "needed_qty", "delivery_qty", "provisional_qty", "unit", "po_line_key",
]


def _day(as_of: dt.date | str) -> Column:
    return F.lit(as_of).cast("date")


def receiving_worksheet(status_rows: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Worksheet rows from `po_line_status`. The delivery quantity is text: it is typed over."""
    ordered, received = F.coalesce("ordered_qty", F.lit(0.0)), F.coalesce("received_qty", F.lit(0.0))
    return status_rows.select(
        "po_no", "item_group", "item_code", "part_no", "item_name",
        month_code(_day(as_of)).alias("month"),
        ordered.alias("ordered_qty"),
        received.alias("received_qty"),
        (ordered - received).alias("needed_qty"),
        F.lit(str(DEFAULT_DELIVERY)).alias("delivery_qty"),
        F.coalesce("provisional_qty", F.lit(0.0)).alias("provisional_qty"),
        text_or("unit", DEFAULT_UNIT).alias("unit"),
        "po_line_key",
    )


def worksheet_add_items(worksheet: DataFrame, items: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Adds rows for items picked by hand: `po_no` plus the columns of `item_search`.

    They have no PO line, and an item that is on the worksheet already is added again.
    """
    nothing = F.lit(0.0)
    added = items.select(
        "po_no", text_or("item_group", "").alias("item_group"), "item_code", "part_no", "item_name",
        month_code(_day(as_of)).alias("month"),
        nothing.alias("ordered_qty"), nothing.alias("received_qty"), nothing.alias("needed_qty"),
        F.lit(str(DEFAULT_DELIVERY)).alias("delivery_qty"),
        nothing.alias("provisional_qty"),
        text_or("unit_code", "").alias("unit"),
        F.lit(None).cast("string").alias("po_line_key"),
    )
    return worksheet.select(*_COLUMNS).unionByName(added)


def worksheet_remove_items(worksheet: DataFrame, codes: DataFrame, hot: HeavyKeys | None = None) -> DataFrame:
    """Drops all rows of the given item codes; with a `po_no` column, only on that worksheet."""
    keys = [c for c in ("item_code", "po_no") if c in codes.columns]
    return skew_join(
        worksheet, codes.select(*keys).distinct(), keys, "left_anti", spread_by=["po_no", "po_line_key"], hot=hot
    )


def submit_lines(worksheet: DataFrame, requests: DataFrame, as_of: dt.date | str, hot: HeavyKeys | None = None) -> DataFrame:
    """Registration lines of the worksheet rows with a delivery quantity above 0.

    `requests` has `po_no`, `supplier_code`, `due_date` (date), `contact_name`,
    `contact_phone`: one request per purchase order. Rows without an item (an order
    without lines) cannot be registered. `hot` lists purchase orders with very many lines.
    """
    lines = worksheet.withColumn("qty", typed_quantity("delivery_qty"))
    lines = lines.filter((F.col("qty") > 0) & F.col("item_code").isNotNull())
    lines = lines.withColumn("po_line_key", F.coalesce("po_line_key", F.lit("")))
    # Hand-added rows of one item differ in quantity and month, or give equal lines.
    lines = number_within(lines, ["po_no"], ["po_line_key", "item_code", "qty", "month"], "seq", hot=hot)
    lines = skew_join(lines, requests, ["po_no"], "inner", spread_by=["seq"], hot=hot)
    return lines.select(
        F.col("po_no").alias("request_id"),
        F.col("seq").cast("int").alias("seq"),
        F.lit("").alias("receipt_no"),
        compact_date("due_date").alias("due_date"),
        "supplier_code",
        text_or("contact_name", "").alias("contact_name"),
        text_or("contact_phone", "").alias("contact_phone"),
        F.lit(DEFAULT_STORE).alias("store_code"),
        F.lit("").alias("memo"),
        "po_no",
        F.lit(OPEN).alias("status"),
        "item_code",
        "po_line_key",
        "qty",
        text_or("month", "").alias("month"),
    )


def month_options(days: DataFrame, as_of: str, before: int = 5, after: int = 5) -> DataFrame:
    """For each day of a column, the months that can be chosen around it."""
    offset = F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")
    months = days.select(F.col(as_of).alias("as_of")).distinct().select("as_of", offset)
    months = months.select("as_of", month_code(F.add_months(F.trunc("as_of", "MM"), F.col("offset"))).alias("month"))
    return months.withColumn("label", month_label("month"))


def default_window(as_of: dt.date, days: int) -> tuple[dt.date, dt.date]:
    """First and last day of a screen's default range: 7 days for the picker, 30 for the histories."""
    return as_of - dt.timedelta(days=days), as_of
