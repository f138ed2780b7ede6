"""Delivery sheets: the numbered, padded lines of provisional receipts and their totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockledger.functions.columns import DEFAULT_UNIT, NO_TEXT, long_date, quantity_text, text_or
from dockledger.functions.skew import fan_out_join, number_within, skew_join
from dockledger.operators.blocks import item_with_unit, number_order
from dockledger.tables import Tables, no_quantity

ROWS_PER_SHEET = 15
ROWS_PER_PART = 1000


def _sheet_rows(t: Tables, receipts: DataFrame | None) -> DataFrame:
    """Lines of the receipts; a receipt without lines has one row without item."""
    headers, lines = t.prov_header.select("receipt_no"), t.prov_line
    hot = t.hot("prov_line", "receipt_no")
    if receipts is not None:
        wanted = receipts.select(F.trim("receipt_no").alias("receipt_no")).distinct()
        headers = headers.join(wanted, "receipt_no", "left_semi")
        lines = skew_join(lines, wanted, ["receipt_no"], "left_semi", spread_by=["line_seq"], hot=hot)
    lines = lines.select("receipt_no", "line_seq", "item_code", "qty")
    return fan_out_join(headers, lines, "receipt_no", spread_by=["line_seq"], hot=hot)


def delivery_sheet(t: Tables, receipts: DataFrame | None = None, rows: int = ROWS_PER_SHEET) -> DataFrame:
    """Rows of each sheet, numbered by line sequence and filled up with empty rows to `rows`.

    Longer receipts are not cut. The last line of a short receipt also yields its
    empty rows, so the filling needs no join and never repeats a long receipt.
    """
    hot = t.hot("prov_line", "receipt_no")
    lines = number_within(
        _sheet_rows(t, receipts), ["receipt_no"], [*number_order("line_seq"), "item_code", "qty"], "line_no", hot=hot, last="is_last"
    )
    units = item_with_unit(t).select("item_code", "item_name", "unit")
    lines = skew_join(
        lines, units, ["item_code"], spread_by=["receipt_no", "line_no"], hot=t.hot("prov_line", "item_code")
    )
    short = F.col("is_last") & (F.col("line_no") < rows)
    numbers = F.when(short, F.sequence("line_no", F.lit(rows).cast("long"))).otherwise(F.array("line_no"))
    padded = lines.withColumn("sheet_row", F.explode(numbers))
    filled = F.col("sheet_row") == F.col("line_no")
    qty = F.coalesce("qty", no_quantity())
    return padded.select(
        "receipt_no",
        F.col("sheet_row").alias("line_no"),
        F.when(filled, text_or("item_code", NO_TEXT)).alias("item_code"),
        F.when(filled, text_or("item_name", NO_TEXT)).alias("item_name"),
        F.when(filled, qty).alias("qty"),
        F.when(filled, quantity_text(qty)).alias("qty_text"),
        F.when(filled, text_or("unit", DEFAULT_UNIT)).alias("unit"),
    )


def delivery_sheet_totals(t: Tables, receipts: DataFrame | None = None) -> DataFrame:
    """The total row of each sheet."""
    total = _sheet_rows(t, receipts).groupBy("receipt_no").agg(F.sum(F.coalesce("qty", no_quantity())).alias("total_qty"))
    return total.withColumn("total_text", quantity_text("total_qty"))


def delivery_sheet_with_totals(t: Tables, receipts: DataFrame | None = None, rows: int = ROWS_PER_SHEET) -> DataFrame:
    """The rows of each sheet and behind them its total row, in one pass: grouping sets over (receipt, row) and (receipt).

    The total row has no line number and no item; it is added up in each task before the shuffle, so a very long receipt
    is no burden.
    """
    row = ["receipt_no", "line_no", "item_code", "item_name", "unit"]
    lines = delivery_sheet(t, receipts, rows).select(*row, "qty")
    sums = lines.groupingSets([[F.col(c) for c in row], [F.col("receipt_no")]], *row)
    both = sums.agg(F.sum("qty").alias("qty"), F.grouping("line_no").alias("is_total"))
    return both.select(
        "receipt_no", "line_no", (F.col("is_total") == 1).alias("is_total"), "item_code", "item_name", "qty",
        quantity_text("qty").alias("qty_text"), "unit",
    )


def delivery_sheet_header(history: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Head of the sheet printed for each row of the receipt history."""
    return history.select(
        "receipt_no",
        text_or("po_no", NO_TEXT).alias("po_no"),
        F.coalesce(F.col("due_date").cast("string"), F.lit(NO_TEXT)).alias("due_date"),
        long_date(F.lit(as_of).cast("date")).alias("printed_on"),
    )


def delivery_sheet_nested(
    t: Tables, receipts: DataFrame | None = None, rows: int = ROWS_PER_SHEET, rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """Sheets with their rows as sorted arrays, and on every part the receipt's total and number of parts.

    A receipt of more than `rows_per_part` rows gives several parts, numbered from 1,
    so that no array grows with the receipt. One part is the usual case.
    """
    lines = delivery_sheet(t, receipts, rows).drop("qty_text")
    part = (F.floor((F.col("line_no") - 1) / rows_per_part) + 1).cast("long")
    line = F.struct("line_no", "item_code", "item_name", "qty", "unit")
    hot = t.hot("prov_line", "receipt_no")
    if hot is None:
        lines = lines.repartition("receipt_no")  # one shuffle for the parts and what they are told of the receipt
    parts = lines.groupBy("receipt_no", part.alias("part")).agg(
        F.sort_array(F.collect_list(line)).alias("lines"), F.sum("qty").alias("part_qty")
    )
    if hot is None:
        sheet = Window.partitionBy("receipt_no")
        told = {"total_qty": F.sum("part_qty").over(sheet), "part_count": F.max("part").over(sheet)}
        return parts.withColumns(told).withColumn("total_text", quantity_text("total_qty"))
    whole = parts.groupBy("receipt_no").agg(
        F.sum("part_qty").alias("total_qty"), F.max("part").alias("part_count")
    )
    return parts.join(whole, "receipt_no").withColumn("total_text", quantity_text("total_qty"))
