"""The read queries, for all suppliers and documents at once or for a selection.

A supplier or date filter sits on document headers, and Catalyst does not carry it
below the per-document aggregates, so the lines are restricted to the selected
documents first (`_lines_of`). That is exact: every such aggregate is per document.

A selection is settled step by step while its plan is built: the selected headers, then their lines, are stored in the
shared folder. Spark then knows their true size and sends a small selection to where a fact table is read, instead of
shuffling the table to the selection; a large one is joined by shuffle as usual. Queries over everything, and those
with `narrow=False`, run nothing before they are asked for rows.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockledger.functions.columns import (
    CLOSED,
    OPEN,
    PICKER_SEPARATOR,
    SUMMARY_SEPARATOR,
    compact_date,
    contains_any,
    equals,
    has_status,
    item_summary,
    rolled_status,
    status_code,
)
from dockledger.functions.skew import STAND_INS, HeavyKeys, fan_out_join, skew_join, with_group_min
from dockledger.functions.storage import stored
from dockledger.operators import blocks, search_index
from dockledger.tables import Tables

Day = dt.date | str | None
ITEM_TEXTS = ["item_code", "part_no", "item_name"]


def _selected(headers: DataFrame, supplier: Any, date: str | None = None, lo: Day = None, hi: Day = None) -> DataFrame:
    if supplier is not None:
        headers = headers.filter(F.col("supplier_code") == supplier)
    if lo is not None:
        headers = headers.filter(F.col(date) >= F.lit(lo).cast("date"))
    if hi is not None:
        headers = headers.filter(F.col(date) <= F.lit(hi).cast("date"))
    return headers


def _lines_of(
    lines: DataFrame, headers: DataFrame, document: str, restrict: bool, hot: HeavyKeys | None
) -> DataFrame:
    if not restrict:
        return lines
    chosen = skew_join(lines, headers.select(document), [document], "left_semi", spread_by=["line_seq"], hot=hot)
    return stored(chosen, "selected-lines")


def _settled(selection: DataFrame, restrict: bool) -> DataFrame:
    return stored(selection, "selected") if restrict else selection


def item_search(
    t: Tables,
    search: str = "",
    item_type: str | None = None,
    type_prefix: str = blocks.BOUGHT_TYPES,
    mode: str = "literal",
    ordered: bool = True,
    index: DataFrame | None = None,
) -> DataFrame:
    """Items of the bought types whose code, part number or name contains the text.

    `index` is a table of `search_index.build` over these three columns: then only the items that it points to are
    looked at, with the same result. Wildcards cannot be looked up.
    """
    types = blocks.code_by_group(t, blocks.ITEM_TYPE_GROUP)
    types = types.select(F.col("code").alias("item_type"), F.col("name").alias("item_type_name"))
    items = t.item.filter(F.col("item_type").startswith(type_prefix))
    if index is not None and mode == "literal":
        items = search_index.search(items, index, search, ITEM_TEXTS)
    else:
        items = items.filter(contains_any(ITEM_TEXTS, search, mode))
    if item_type:
        items = items.filter(F.col("item_type") == item_type)
    found = blocks.with_code_name(items, types, "item_type", "item_code").select(
        "item_code", "part_no", "item_name", "item_group", "item_type", "item_type_name", "unit_code"
    )
    # The item code only breaks ties, and lets the few types spread over many sort tasks.
    return found.orderBy("item_type", "item_code") if ordered else found


def item_by_code(t: Tables, codes: DataFrame) -> DataFrame:
    """Items whose code or part number equals a searched code; `codes` has one column `code`."""
    wanted = codes.select(F.trim("code").alias("code")).filter(F.col("code").isNotNull()).distinct()
    found = ["code", "item_code", "part_no", "item_name", "item_type", "item_group"]
    by_code = t.item.withColumn("code", F.col("item_code")).join(wanted, "code").select(*found)
    # An item found by its code is not listed again for an equal part number.
    others = t.item.filter(~F.col("part_no").eqNullSafe(F.col("item_code"))).withColumn("code", F.col("part_no"))
    by_part = skew_join(others, wanted, ["code"], "inner", spread_by=["item_code"], hot=t.hot("item", "part_no"))
    return by_code.unionByName(by_part.select(*found))


def item_type_list(t: Tables, type_prefix: str = blocks.BOUGHT_TYPES, ordered: bool = True) -> DataFrame:
    types = blocks.code_by_group(t, blocks.ITEM_TYPE_GROUP).filter(F.col("code").startswith(type_prefix))
    return types.orderBy("code", "name") if ordered else types


def po_picker(
    t: Tables,
    supplier: Any = None,
    date_from: Day = None,
    date_to: Day = None,
    search: str = "",
    separator: str = PICKER_SEPARATOR,
    mode: str = "literal",
    ordered: bool = True,
) -> DataFrame:
    """Purchase orders whose number, or any of whose lines' item, contains the text."""
    restrict = any(x is not None for x in (supplier, date_from, date_to))
    headers = _settled(_selected(t.po_header, supplier, "po_date", date_from, date_to), restrict)
    lines = _lines_of(t.of_supplier("po_line", supplier), headers, "po_no", restrict, t.hot("po_line", "po_no"))
    by_number = contains_any(["po_no"], search, mode)
    if search:
        names = t.item.filter(contains_any(["item_name"], search, mode))
        names = names.select(F.trim("item_code").alias("item")).distinct().withColumn("named", F.lit(True))
        hot = t.hot("po_line", "item_code")
        marked = lines.withColumn("item", F.trim("item_code"))
        marked = skew_join(marked, names, ["item"], spread_by=["po_no", "line_seq"], hot=hot and hot.trimmed())
        hit = F.col("named").isNotNull() | contains_any(["item_code"], search, mode)
        summary = _lines_with_hits(marked, hit)
        picked = headers.join(summary, "po_no", "left").filter(by_number | (F.col("hits") > 0))
    else:
        picked = headers.join(blocks.first_item(lines, "po_no"), "po_no", "left").filter(by_number)
    named = blocks.trim_join_items(
        picked, "first_item_code", t, spread_by=["po_no"], hot=t.hot("po_line", "item_code")
    )
    result = named.select(
        "po_no",
        item_summary("line_count", "item_name", "first_item_code", separator).alias("item_summary"),
        "po_date",
    )
    return result.orderBy(F.desc("po_no")) if ordered else result


def _lines_with_hits(lines: DataFrame, hit: Column) -> DataFrame:
    """First item and line count per purchase order, with the number of lines that match a search."""
    per_po = lines.groupBy("po_no").agg(
        F.min(F.struct(F.length("line_seq").alias("digits"), "line_seq", "item_code")).alias("first"),
        F.count(F.lit(1)).alias("line_count"),
        F.sum(F.when(hit, 1).otherwise(0)).alias("hits"),
    )
    return per_po.select("po_no", F.col("first.item_code").alias("first_item_code"), "line_count", "hits")


def _po_lines(
    t: Tables, supplier: Any, pos: DataFrame | None, number: str | None, mode: str
) -> tuple[DataFrame, DataFrame, bool]:
    headers = _selected(t.po_header, supplier)
    if number is not None:
        headers = headers.filter(equals("po_no", number.strip(), mode))
    if pos is not None:
        headers = headers.join(pos.select(F.trim("po_no").alias("po_no")).distinct(), "po_no", "left_semi")
    restrict = any(x is not None for x in (supplier, pos, number))
    headers = _settled(headers, restrict)
    lines = t.of_supplier("po_line", supplier)
    return headers, _lines_of(lines, headers, "po_no", restrict, t.hot("po_line", "po_no")), restrict


def _of_keys(
    lines: DataFrame, keys: DataFrame, restrict: bool, spread_by: list[str], hot: HeavyKeys | None
) -> DataFrame:
    """Lines of the selected PO lines only; all lines of a key stay, whoever's they are."""
    if not restrict:
        return lines
    keys = keys.select("po_line_key").distinct()
    return skew_join(lines, keys, ["po_line_key"], "left_semi", spread_by=spread_by, hot=hot)


_RECEIPT_ID = ["actual_no", "item_code", "qty"]
_PROV_ID = ["receipt_no", "line_seq"]


def po_line_status(
    t: Tables,
    supplier: Any = None,
    pos: DataFrame | None = None,
    number: str | None = None,
    mode: str = "literal",
    narrow: bool = True,
) -> DataFrame:
    """Every PO line with what was ordered, received, is outstanding and was announced.

    One row per PO line; a header without lines gives one row. `pos` selects
    purchase orders by its column `po_no`, `number` one by its number, or several
    where `mode="pattern"` gives it wildcards. `narrow` adds up quantities for the
    selected lines only; a selection of most orders is faster without.
    """
    return _line_status(t, _po_lines(t, supplier, pos, number, mode), narrow)


def _line_status(
    t: Tables, selection: tuple[DataFrame, DataFrame, bool], narrow: bool, with_receipts: bool = False
) -> DataFrame:
    headers, lines, restrict = selection
    restrict = restrict and narrow
    hot_pos, hot_items = t.hot("po_line", "po_no"), t.hot("po_line", "item_code")
    receipts = _of_keys(t.receipt_line, lines, restrict, _RECEIPT_ID, t.hot("receipt_line", "po_line_key"))
    announced = _of_keys(t.prov_line, lines, restrict, _PROV_ID, t.hot("prov_line", "po_line_key"))
    lines = lines.select("po_no", "po_line_key", "item_code", "status", "qty")
    rows = _lines_with_quantities if _no_heavy_lines(t) else _lines_by_join
    rows = rows(lines, receipts, announced)
    if with_receipts:
        rows = _with_receipts(t, rows, receipts)
    rows = fan_out_join(headers.select("po_no", "po_date"), rows.drop("_line_key"), "po_no", spread_by=["balance_key"], hot=hot_pos)
    spread_by = ["po_no", "balance_key"]
    rows = skew_join(rows, blocks.item_with_unit(t), ["item_code"], spread_by=spread_by, hot=hot_items)
    return rows.select(
        "po_no", "po_date", "item_code", "status", "part_no", "item_name", "item_group",
        "ordered_qty", "received_qty", "outstanding_qty", "provisional_qty", "unit",
        F.col("balance_key").alias("po_line_key"),
    )


def _no_heavy_lines(t: Tables) -> bool:
    return all(t.hot(table, "po_line_key") is None for table in ("po_line", "receipt_line", "prov_line"))


def _lines_with_quantities(lines: DataFrame, receipts: DataFrame, announced: DataFrame) -> DataFrame:
    """Each line with every balance of its key and what is announced of its item: all lines meet by key in one shuffle."""
    spread = F.concat(F.lit("\u0000\u0000"), F.concat_ws("\u0000", "po_no", "item_code"))
    keyed = F.col("po_line_key").isNotNull()
    # A key starts with its order's number, which is then not sent beside it.
    own = F.startswith("po_line_key", "po_no")
    shown = lines.select(
        F.when(keyed, blocks.meeting_key()).otherwise(spread).alias("_line_key"), "item_code", "qty",
        F.when(keyed, blocks.ORDERED).otherwise(blocks.SHOWN).alias("_kind"), F.lit(True).alias("_shown"), "status",
        F.when(own & (F.col("po_line_key") != ""), F.length("po_no")).alias("_digits"),
        F.when(~F.coalesce(own, F.lit(False)) | (F.col("po_line_key") == ""), F.col("po_no")).alias("_po_no"),
    )
    other = blocks.tagged(receipts, blocks.RECEIVED).unionByName(blocks.tagged(announced, blocks.ANNOUNCED))
    met = blocks.meet(shown.unionByName(other, allowMissingColumns=True), "_line_key").filter("_shown")
    rows = met.select("*", F.explode_outer("balances").alias("balance"))
    return rows.select(
        "_line_key", "item_code", "status", F.coalesce("_po_no", F.expr("left(_line_key, _digits)")).alias("po_no"),
        F.when(F.col("balance").isNotNull(), blocks.met_key("_line_key")).alias("balance_key"),
        "balance.ordered_qty", "balance.received_qty", "balance.outstanding_qty", F.col("announced").alias("provisional_qty"),
    )


def _lines_by_join(lines: DataFrame, receipts: DataFrame, announced: DataFrame) -> DataFrame:
    """The same where single keys hold very many lines."""
    balance = blocks.quantities(lines, receipts, announced).filter(F.col("ordered_qty").isNotNull())
    balance = balance.select(F.col("po_line_key").alias("balance_key"), F.col("item_code").alias("balance_item"), "ordered_qty", "received_qty", "outstanding_qty", "provisional_qty")
    # One key for all that is joined to the lines: they are shuffled by it once. A line without a key has one of its own.
    spread = F.concat(F.lit("\u0000"), F.concat_ws("\u0000", "po_no", "item_code"))
    rows = lines.select("po_no", "item_code", "status", F.coalesce("po_line_key", spread).alias("_line_key"))
    rows = rows.join(balance.withColumn("_line_key", F.col("balance_key")), "_line_key", "left")
    # Different lines can have the same glued key: what is announced is of the line's own item, the balance of the key.
    same = F.when(F.col("balance_item") == F.col("item_code"), F.col("provisional_qty"))
    return rows.withColumn("provisional_qty", F.max(same).over(Window.partitionBy("_line_key", "item_code"))).drop("balance_item")


def _with_receipts(t: Tables, rows: DataFrame, receipts: DataFrame) -> DataFrame:
    """Each line once for every actual receipt of it and each of that receipt's headers, once if there is none."""
    hot = t.hot("receipt_line", "po_line_key")
    actual = receipts.select(F.col("po_line_key").alias("_line_key"), "actual_no", F.col("item_code").alias("_item"), F.col("qty").alias("_qty"))
    rows = fan_out_join(rows, actual, "_line_key", spread_by=["actual_no", "_item", "_qty"], hot=hot)
    headers = t.receipt_header.select("actual_no")
    hot = t.hot("receipt_line", "actual_no")
    return skew_join(rows, headers, ["actual_no"], spread_by=["_line_key"], hot=hot).drop("actual_no", "_item", "_qty")


def po_line_status_raw(
    t: Tables,
    supplier: Any = None,
    pos: DataFrame | None = None,
    number: str | None = None,
    mode: str = "literal",
    narrow: bool = True,
) -> DataFrame:
    """`po_line_status` with each line repeated once per actual receipt of it.

    This is the row count of the source query, which joins receipts without showing
    them. Its quantities repeat as well, so sums over it are wrong.
    """
    return _line_status(t, _po_lines(t, supplier, pos, number, mode), narrow, with_receipts=True)


def receipt_history(
    t: Tables,
    supplier: Any = None,
    date_from: Day = None,
    date_to: Day = None,
    status: str | None = "all",
    search: str = "",
    summary_scope: str = "receipt_first",
    mode: str = "literal",
    ordered: bool = True,
    narrow: bool = True,
) -> DataFrame:
    """Provisional receipts, one row per receipt and purchase order it delivers for.

    Lines without a PO line form a row without PO number. With `receipt_first` only
    the row that holds the receipt's first line has a summary, as in the source
    query; with `group_first` every row summarises its own first line. `narrow`
    reads only the order lines that the selected receipts touch.
    """
    if summary_scope not in ("receipt_first", "group_first"):
        raise ValueError(f"unknown summary scope {summary_scope!r}")
    restrict = any(x is not None for x in (supplier, date_from, date_to))
    headers = _settled(_selected(t.prov_header, supplier, "due_date", date_from, date_to), restrict)
    hot = t.hot("prov_line", "receipt_no")
    lines = _lines_of(t.of_supplier("prov_line", supplier), headers, "receipt_no", restrict, hot)
    restrict = restrict and narrow
    # The outer join and the roll-up would shuffle every order line; the semi-joins keep those of the selection.
    po_lines = _of_keys(t.po_line, lines, restrict, ["line_seq", "item_code"], None).select("po_line_key", "po_no")
    po_lines = _settled(po_lines, restrict)
    orders = po_lines.select("po_no").distinct() if restrict else po_lines
    po_all = _lines_of(t.po_line, orders, "po_no", restrict, t.hot("po_line", "po_no"))
    # The status of the order comes with its lines; joined to the rows of the result, it would shuffle them once more.
    rolled = F.when(F.col("status") == OPEN, OPEN).otherwise(CLOSED)  # in alphabetical order: open if one line is
    po_all = po_all.select("po_no", "po_line_key", "status")
    po_lines = with_group_min(po_all, ["po_no"], rolled, "po_status", spread_by=["po_line_key"], hot=t.hot("po_line", "po_no"))
    of_orders = skew_join(
        lines, po_lines.drop("status"), ["po_line_key"],
        spread_by=_PROV_ID, hot=t.hot("prov_line", "po_line_key"), blank_matches=False,
    )
    if hot is None:
        # By receipt at once: its groups, the comparison of their first lines and its header then need no other shuffle.
        of_orders = of_orders.repartition("receipt_no")
    groups = of_orders.groupBy("receipt_no", "po_no").agg(
        F.min(F.struct(F.length("line_seq").alias("digits"), "line_seq", "item_code")).alias("first"),
        F.count(F.lit(1)).alias("line_count"),
        F.max("updated_on").alias("last_update"),
        rolled_status("status").alias("status"),
        F.max("po_status").alias("po_status"),
    )
    if summary_scope == "receipt_first":
        # Ranking is over the receipt, grouping over (receipt, PO): compare the first lines.
        groups = with_group_min(
            groups, ["receipt_no"], F.col("first"), "receipt_first", spread_by=["receipt_no", "po_no"], hot=hot
        )
        is_first = F.col("first") == F.col("receipt_first")
        groups = groups.withColumn("first_item_code", F.when(is_first, F.col("first.item_code")))
    else:
        groups = groups.withColumn("first_item_code", F.col("first.item_code"))
    groups = groups.filter(has_status("status", status))
    spread = ["receipt_no", "po_no"]
    dates = headers.select("receipt_no", "due_date", "saved_on")
    rows = skew_join(groups, dates, ["receipt_no"], "inner", spread_by=spread, hot=hot)
    named = blocks.trim_join_items(
        rows, "first_item_code", t, spread_by=spread, hot=t.hot("prov_line", "item_code")
    )
    if search:
        named = named.filter(contains_any(["receipt_no", "po_no", "item_name"], search, mode))
    result = named.select(
        "receipt_no",
        "due_date",
        "po_no",
        compact_date("saved_on").alias("saved_on"),
        compact_date("last_update").alias("last_update"),
        item_summary("line_count", "item_name", "first_item_code", SUMMARY_SEPARATOR).alias("item_summary"),
        "status",
        "po_status",
    )
    return result.orderBy(F.desc("receipt_no"), F.desc("po_no")) if ordered else result


def _with_balances(quantities: DataFrame) -> DataFrame:
    """Open provisional quantity of each key and item, with the balances of the key: one for each item ordered under it.

    Of the blank key there is no balance; its many items are kept apart.
    """
    blank = F.coalesce(F.col("po_line_key") == "", F.lit(True))
    apart = F.when(blank, F.concat(F.lit("\u0000"), F.coalesce("item_code", F.lit("")))).otherwise(F.col("po_line_key"))
    balance = F.struct(F.col("po_line_key").alias("balance_key"), "ordered_qty", "outstanding_qty")
    of_key = F.collect_list(F.when(F.col("ordered_qty").isNotNull() & ~blank, balance))
    found = quantities.withColumn("_key", apart).withColumn("balances", of_key.over(Window.partitionBy("_key")))
    return found.select("po_line_key", "item_code", "open_provisional_qty", "balances")


def _details_by_join(rows: DataFrame, found: DataFrame, hot: HeavyKeys | None) -> DataFrame:
    """Lines with every balance of their key and the open quantity of key and item, where single keys hold very many lines."""
    item = F.coalesce("item_code", F.lit("\u0000"))
    rows, found = rows.withColumn("_item", item).drop("item_code"), found.withColumn("_item", item).drop("item_code")
    rows = skew_join(rows, found, ["po_line_key", "_item"], spread_by=_PROV_ID, hot=hot)
    rows = rows.withColumn("item_code", F.when(F.col("_item") != "\u0000", F.col("_item"))).drop("_item")
    rows = rows.withColumn("open_provisional_qty", F.when(F.col("item_code").isNotNull(), F.col("open_provisional_qty")))
    return rows.select("*", F.explode_outer("balances").alias("balance")).select("*", "balance.*")


def _details_with_quantities(rows: DataFrame, po_lines: DataFrame, receipts: DataFrame, announced: DataFrame) -> DataFrame:
    """The same: all lines meet by key in one shuffle."""
    spread = F.concat(F.lit("\u0000\u0000"), F.pmod(F.xxhash64(*_PROV_ID), F.lit(STAND_INS)).cast("string"))
    shown = rows.select(
        F.coalesce(blocks.meeting_key(), spread).alias("_line_key"), "item_code", "qty", F.lit(blocks.SHOWN).alias("_kind"),
        F.lit(True).alias("_shown"), "status", "receipt_no", "due_date", "line_seq",
    )
    ordered = blocks.tagged(po_lines, blocks.ORDERED, no_item=True).unionByName(blocks.tagged(receipts, blocks.RECEIVED))
    # Of the blank key there is no balance.
    other = ordered.filter(~F.col("_line_key").startswith("\u0000"))
    other = other.unionByName(blocks.tagged(announced.filter(F.col("status") == OPEN), blocks.ANNOUNCED))
    met = blocks.meet(shown.unionByName(other, allowMissingColumns=True), "_line_key").filter("_shown")
    met = met.withColumnRenamed("announced", "open_provisional_qty").select("*", F.explode_outer("balances").alias("balance"))
    return met.select("*", F.when(F.col("balance").isNotNull(), F.col("_line_key")).alias("balance_key"), "balance.*")


def receipt_detail(
    t: Tables,
    supplier: Any = None,
    receipts: DataFrame | None = None,
    number: str | None = None,
    mode: str = "literal",
    status: str | None = "all",
    narrow: bool = True,
) -> DataFrame:
    """Lines of provisional receipts with ordered, outstanding and open announced quantity.

    A header without lines gives one row. `receipts` selects receipts by its column
    `receipt_no`; any number of them is one job. `number` selects all receipts whose
    number contains it. `narrow` is as in `po_line_status`.
    """
    headers = _selected(t.prov_header, supplier)
    if number is not None:
        headers = headers.filter(contains_any(["receipt_no"], number.strip(), mode))
    if receipts is not None:
        wanted = receipts.select(F.trim("receipt_no").alias("receipt_no")).distinct()
        headers = headers.join(wanted, "receipt_no", "left_semi")
    restrict = any(x is not None for x in (supplier, receipts, number))
    headers = _settled(headers, restrict and narrow)
    hot = t.hot("prov_line", "receipt_no")
    hot_keys, hot_pairs = t.hot("prov_line", "po_line_key"), t.hot("prov_line", "po_line_key", "item_code")
    lines = t.of_supplier("prov_line", supplier)
    if restrict:
        lines = skew_join(lines, headers.select("receipt_no"), ["receipt_no"], "left_semi", spread_by=["line_seq"], hot=hot)
    lines = _settled(lines.drop("updated_on"), restrict and narrow)
    rows = fan_out_join(headers.select("receipt_no", "due_date"), lines, "receipt_no", spread_by=["line_seq"], hot=hot)
    if status_code(status) is not None:
        rows = rows.filter(has_status("status", status))
    restrict = restrict and narrow
    po_lines = _of_keys(t.po_line, lines, restrict, ["line_seq", "item_code"], None)
    received = _of_keys(t.receipt_line, lines, restrict, _RECEIPT_ID, t.hot("receipt_line", "po_line_key"))
    announced = _of_keys(t.prov_line, lines, restrict, _PROV_ID, hot_keys)
    if _no_heavy_lines(t):
        rows = _details_with_quantities(rows, po_lines, received, announced)
    else:
        rows = _details_by_join(rows, _with_balances(blocks.quantities(po_lines, received, announced)), hot_pairs)
    units = blocks.item_with_unit(t).select("item_code", "item_name", "unit")
    rows = skew_join(rows, units, ["item_code"], spread_by=_PROV_ID, hot=t.hot("prov_line", "item_code"))
    return rows.select(
        "receipt_no", "due_date", "line_seq", "item_code", "qty", "status", "item_name", "unit",
        "ordered_qty", "outstanding_qty", F.col("balance_key").alias("po_line_key"), "open_provisional_qty",
    )


def po_history(
    t: Tables,
    supplier: Any = None,
    date_from: Day = None,
    date_to: Day = None,
    status: str | None = "all",
    search: str = "",
    mode: str = "literal",
    ordered: bool = True,
) -> DataFrame:
    """Purchase orders with first item, line count, first line's delivery date and status.

    Orders without lines have no status and are dropped, also when all are asked for.
    """
    restrict = any(x is not None for x in (supplier, date_from, date_to))
    headers = _settled(_selected(t.po_header, supplier, "po_date", date_from, date_to), restrict)
    lines = _lines_of(t.of_supplier("po_line", supplier), headers, "po_no", restrict, t.hot("po_line", "po_no"))
    rolled = blocks.first_item(lines, "po_no", "delivery_date").filter(has_status("status", status))
    rows = headers.select("po_no", "po_date").join(rolled, "po_no")
    rows = blocks.trim_join_items(rows, "first_item_code", t, spread_by=["po_no"], hot=t.hot("po_line", "item_code"))
    if search:
        rows = rows.filter(contains_any(["po_no", "item_name"], search, mode))
    result = rows.select(
        "po_no",
        "po_date",
        "delivery_date",
        item_summary("line_count", "item_name", "first_item_code", SUMMARY_SEPARATOR).alias("item_summary"),
        "status",
    )
    return result.orderBy(F.desc("po_no")) if ordered else result
