"""Every operator as a query over the whole test data, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.functions import columns as c
from dockledger.functions.skew import skew_join
from dockledger.functions.storage import shared_folder, stored
from dockledger.operators import blocks, grid, search_index, sheet, worksheet, writes
from dockledger.plans import exports, reads, versions
from dockledger.sources import requests
from dockledger.sources.sample import sample_tables
from dockledger.tables import Tables

DUE = ("1996-12-20", "1997-12-28")
YEAR = ("1997-01-01", "1997-12-31")
AS_OF = "1997-07-15"
SEARCH = "red"

ON_TABLES: dict[str, Callable[[Tables], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Registers a function of the tables under its name."""
    return query_reading()(make)


def query_reading(again: str = "") -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """The same for a query that reads tables of lines more than once: the step they are derived by runs once."""

    def register(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        ON_TABLES[make.__name__] = make
        QUERIES[make.__name__] = lambda spark, sf_dir: make(sample_tables(spark, sf_dir, again))
        return make

    return register


# Reads

@query
def code_by_group(t: Tables) -> DataFrame:
    return blocks.code_by_group(t, "QNTY_CODE")


@query
def item_search(t: Tables) -> DataFrame:
    return reads.item_search(t, SEARCH)


@query
def item_search_all(t: Tables) -> DataFrame:
    return reads.item_search(t)


@query
def item_search_type(t: Tables) -> DataFrame:
    return reads.item_search(t, "r%d", item_type="21", mode="pattern")


@query
def item_search_indexed(t: Tables) -> DataFrame:
    """The item search by the pieces of its text."""
    return reads.item_search(t, SEARCH, index=search_index.build(t.item, "item_code", reads.ITEM_TEXTS))


@query
def item_search_indexed_short(t: Tables) -> DataFrame:
    """The same for a text shorter than a piece."""
    return reads.item_search(t, SEARCH[:2], index=search_index.build(t.item, "item_code", reads.ITEM_TEXTS))


@query
def item_by_code(t: Tables) -> DataFrame:
    """Looks up the code of every ordered item and every part number."""
    codes = t.po_line.select(F.col("item_code").alias("code")).unionByName(t.item.select(F.col("part_no").alias("code")))
    return reads.item_by_code(t, codes)


@query
def item_type_list(t: Tables) -> DataFrame:
    return reads.item_type_list(t)


@query
def po_picker(t: Tables) -> DataFrame:
    return reads.po_picker(t, search=SEARCH)


@query
def po_picker_all(t: Tables) -> DataFrame:
    return reads.po_picker(t)


@query
def po_picker_year(t: Tables) -> DataFrame:
    return reads.po_picker(t, date_from=YEAR[0], date_to=YEAR[1], search=SEARCH, separator=c.SUMMARY_SEPARATOR)


@query_reading("shipments")
def po_line_status(t: Tables) -> DataFrame:
    return reads.po_line_status(t)


@query_reading("shipments")
def po_line_status_raw(t: Tables) -> DataFrame:
    return reads.po_line_status_raw(t)


@query
def po_line_status_supplier(t: Tables) -> DataFrame:
    return reads.po_line_status(t, supplier=7)


@query
def receipt_history(t: Tables) -> DataFrame:
    return reads.receipt_history(t)


@query
def receipt_history_open(t: Tables) -> DataFrame:
    return reads.receipt_history(t, status="N")


@query
def receipt_history_search(t: Tables) -> DataFrame:
    return reads.receipt_history(t, search=SEARCH)


@query
def receipt_history_range(t: Tables) -> DataFrame:
    """Receipts due in the days around two turns of a year."""
    return reads.receipt_history(t, date_from=DUE[0], date_to=DUE[1])


@query
def receipt_history_year(t: Tables) -> DataFrame:
    return reads.receipt_history(t, date_from=YEAR[0], date_to=YEAR[1], summary_scope="group_first")


@query
def receipt_history_supplier(t: Tables) -> DataFrame:
    return reads.receipt_history(t, supplier=7)


@query_reading("numbered")
def receipt_detail(t: Tables) -> DataFrame:
    return reads.receipt_detail(t)


@query_reading("numbered")
def receipt_detail_open(t: Tables) -> DataFrame:
    return reads.receipt_detail(t, status="N")


@query_reading("numbered")
def receipt_detail_batch(t: Tables) -> DataFrame:
    """Details of every receipt that is not closed, which is most of them."""
    status = blocks.status_rollup(t.prov_line, "receipt_no")
    return reads.receipt_detail(t, receipts=status.filter(F.col("status") == c.OPEN), narrow=False)


@query_reading("numbered")
def receipt_detail_closed(t: Tables) -> DataFrame:
    """Details of the few closed receipts."""
    status = blocks.status_rollup(t.prov_line, "receipt_no")
    return reads.receipt_detail(t, receipts=status.filter(F.col("status") == c.CLOSED))


@query
def po_history(t: Tables) -> DataFrame:
    return reads.po_history(t)


@query
def po_history_closed(t: Tables) -> DataFrame:
    return reads.po_history(t, status="Y")


@query
def po_history_search(t: Tables) -> DataFrame:
    return reads.po_history(t, date_from=YEAR[0], date_to=YEAR[1], search=SEARCH)


# Building blocks

@query
def first_item_per_po(t: Tables) -> DataFrame:
    return blocks.first_item(t.po_line, "po_no").drop("status")


@query
def item_summary(t: Tables) -> DataFrame:
    rolled = blocks.first_item(t.po_line, "po_no")
    hot = t.hot("po_line", "item_code")
    named = blocks.trim_join_items(rolled, "first_item_code", t, spread_by=["po_no"], hot=hot)
    return named.select("po_no", c.item_summary("line_count", "item_name", "first_item_code").alias("item_summary"))


@query
def po_status_rollup(t: Tables) -> DataFrame:
    return blocks.status_rollup(t.po_line, "po_no")


@query
def ordered_qty(t: Tables) -> DataFrame:
    return blocks.ordered_qty(t.po_line)


@query
def received_qty(t: Tables) -> DataFrame:
    return blocks.received_qty(t.receipt_line)


@query
def po_line_balance(t: Tables) -> DataFrame:
    return blocks.po_line_balance(t.po_line, t.receipt_line)


@query
def cumulative_provisional(t: Tables) -> DataFrame:
    return blocks.cumulative_provisional(t.prov_line)


@query
def item_with_unit(t: Tables) -> DataFrame:
    return blocks.item_with_unit(t)


@query
def trim_join_items(t: Tables) -> DataFrame:
    lines = t.po_line.select("po_no", "line_seq", "item_code")
    hot = t.hot("po_line", "item_code")
    return blocks.trim_join_items(lines, "item_code", t, spread_by=["po_no", "line_seq"], hot=hot)


@query
def receipt_history_by_month(t: Tables) -> DataFrame:
    """The receipt history written by month and read back."""
    history = stored(reads.receipt_history(t, ordered=False), "history")  # read twice to be written
    path = f"{shared_folder(history.sparkSession)}/history-{uuid.uuid4().hex}"
    exports.write_by_month(history, path, "due_date")
    schema = T.StructType([*history.schema.fields, T.StructField("month", T.StringType())])
    return history.sparkSession.read.schema(schema).parquet(path)


# Worksheets

def _worksheet(t: Tables) -> DataFrame:
    return worksheet.receiving_worksheet(reads.po_line_status(t), AS_OF)


def _first_items(t: Tables) -> DataFrame:
    """The first item of every purchase order."""
    return blocks.first_item(t.po_line, "po_no").select("po_no", F.trim("first_item_code").alias("item_code"))


@query
def receiving_worksheet(t: Tables) -> DataFrame:
    return _worksheet(t)


@query
def worksheet_add_items(t: Tables) -> DataFrame:
    """Every worksheet with its order's first item added by hand."""
    found = reads.item_search(t, ordered=False)
    hot = t.hot("po_line", "item_code")
    picked = skew_join(_first_items(t), found, ["item_code"], "inner", spread_by=["po_no"], hot=hot)
    return worksheet.worksheet_add_items(_worksheet(t), picked, AS_OF)


@query_reading("lines")
def worksheet_remove_items(t: Tables) -> DataFrame:
    """Every worksheet without its order's first item."""
    return worksheet.worksheet_remove_items(_worksheet(t), _first_items(t))


def _registrations(t: Tables) -> DataFrame:
    """One request per purchase order, due on the order's day."""
    orders = t.po_header.select(
        "po_no",
        "supplier_code",
        F.col("po_date").alias("due_date"),
        F.concat(F.lit("D"), F.col("supplier_code").cast("string")).alias("contact_name"),
        F.lit("").alias("contact_phone"),
    )
    needed = F.col("needed_qty").cast("long").cast("string")
    typed = _worksheet(t).withColumn("delivery_qty", F.when(F.col("needed_qty") == 0, "none").otherwise(needed))
    return worksheet.submit_lines(typed, orders, AS_OF, hot=t.hot("po_line", "po_no"))


@query
def submit_lines(t: Tables) -> DataFrame:
    """Registration of all that is outstanding; the typed quantities include text and negatives."""
    return _registrations(t)


@query
def month_options(t: Tables) -> DataFrame:
    return worksheet.month_options(t.po_header, "po_date")


@query
def status_label(t: Tables) -> DataFrame:
    """Labels of the status of every document of either kind; empty orders have none."""
    headers = t.po_header.select("po_no")
    rolled = headers.join(blocks.status_rollup(t.po_line, "po_no"), "po_no", "left")
    return rolled.select(
        "po_no",
        "status",
        c.status_label("status", "closed").alias("label_closed"),
        c.status_label("status", "open").alias("label_open"),
        c.status_label("status", "value").alias("label_value"),
    )


@query_reading("numbered")
def bulk_status_change(t: Tables) -> DataFrame:
    """Closes all lines that were never updated."""
    keys = t.prov_line.filter(F.col("updated_on").isNull())
    return grid.bulk_status_change(t.prov_line, keys, c.CLOSED)


@query
def grid_filter_sort(t: Tables) -> DataFrame:
    history = reads.po_history(t, ordered=False)
    return grid.grid_filter_sort(history, {"item_summary": "BLUE", "status": "n"}, [("po_date", False), ("po_no", True)])


# Sheets

@query
def delivery_sheet(t: Tables) -> DataFrame:
    return sheet.delivery_sheet(t)


@query
def delivery_sheet_totals(t: Tables) -> DataFrame:
    return sheet.delivery_sheet_totals(t)


@query
def delivery_sheet_with_totals(t: Tables) -> DataFrame:
    return sheet.delivery_sheet_with_totals(t)


@query
def delivery_sheet_header(t: Tables) -> DataFrame:
    return sheet.delivery_sheet_header(reads.receipt_history(t, ordered=False), AS_OF)


@query
def delivery_sheet_nested(t: Tables) -> DataFrame:
    """The nested sheets with their rows as text."""
    row = lambda x: F.concat_ws("|", x["line_no"], F.coalesce(x["item_code"], F.lit("")), x["qty"].cast("long"))
    nested = sheet.delivery_sheet_nested(t)
    rows = F.array_join(F.transform("lines", row), ";")
    return nested.withColumn("lines", rows)


# Writes

def _request_documents(t: Tables) -> DataFrame:
    """Request documents for all PO lines; documents of 100 lines, since the test data has orders of any length."""
    part = F.floor(F.col("line_seq").cast("long") / 100).alias("part")
    item = F.struct(
        F.col("line_seq"),
        F.col("item_code").alias("itemCode"),
        F.col("po_line_key").alias("ordrDetl"),
        F.col("qty").alias("gaipQnty"),
        F.date_format("delivery_date", "yyyyMM").alias("gaipYmmm"),
    )
    orders = t.po_line.groupBy("po_no", part).agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.max("delivery_date").alias("due")
    )
    payload = F.to_json(F.struct(
        F.date_format("due", "yyyyMMdd").alias("ipgoDate"),
        F.concat(F.lit(" "), F.col("po_no")).alias("ordrNumb"),
        F.lit("").alias("userName"),
        F.lit(c.OPEN).alias("statType"),
        "items",
    ))
    return orders.select(
        F.concat("po_no", F.lit("/"), F.col("part").cast("string")).alias("request_id"),
        payload.alias("payload"),
        F.concat(F.lit("10.0.0.1, "), F.col("po_no")).alias("forwarded_for"),
    )


@query
def explode_requests(t: Tables) -> DataFrame:
    return requests.explode_requests(_request_documents(t))


def _odd_documents(t: Tables) -> DataFrame:
    """A document for each order; each has one of eleven faults, or none and its quantity as a number or as text."""
    kind = F.pmod(F.substring("po_no", 2, 20).cast("long"), F.lit(13))
    head = '{"ipgoDate":"%s","custCode":"7","userName":"Kim","ordrNumb":"S1"'
    item = '{"itemCode":"P1","ordrDetl":"",%s"gaipQnty":%s}'
    day = head % "19970715"
    texts = [
        day, day.replace('"custCode":"7",', "") + ',"items":[' + item % ("", "1") + "]}", day + "}", day + ',"items":[]}',
        day + ',"items":[' + (item % ("", "1")).replace('"itemCode":"P1",', "") + "]}",
        day + ',"items":[' + (item % ("", "1")).replace(',"gaipQnty":1', "") + "]}",
        day + ',"items":[' + item % ("", '"abc"') + "]}", head % "20301301" + ',"items":[' + item % ("", "1") + "]}",
        day.replace('"userName":"Kim",', "") + ',"items":[]}', day + ',"items":[' + item % ("", "5") + "]}",
        day + ',"items":[' + item % ("", '"5"') + "]}",
        day + ',"items":[' + (item % ("", "1")).replace('"P1"', '" "') + "]}", None,
    ]
    payload = F.element_at(F.array(*[F.lit(text) for text in texts]), (kind + 1).cast("int"))
    return t.po_header.select(F.col("po_no").alias("request_id"), payload.alias("payload"))


@query
def register_rejected(t: Tables) -> DataFrame:
    return requests.rejected_requests(_odd_documents(t)).drop("payload")


@query
def register_accepted(t: Tables) -> DataFrame:
    accepted = requests.explode_requests(requests.accepted_requests(_odd_documents(t)))
    return accepted.select("request_id", "seq", "due_date", "item_code", "qty")


@query
def request_outcomes(t: Tables) -> DataFrame:
    """What every one of the documents is answered: number and count, or the reason why not."""
    documents = _odd_documents(t)
    items = requests.explode_requests(requests.accepted_requests(documents))
    rejected = requests.rejected_requests(documents).select("request_id", "reason")
    return versions.outcomes(writes.register_receipts(t, items, as_of=AS_OF), rejected)


def _odd_edits(t: Tables) -> DataFrame:
    """A document for each receipt, on its first line's item; each has one of ten faults, or none."""
    kind = F.pmod(F.substring("receipt_no", 2, 20).cast("long"), F.lit(11))
    fit = '{"itemCode":"ITEM","gaipQnty":7,"statType":"Y"}'
    items = [
        fit.replace('"itemCode":"ITEM",', ""), fit.replace("ITEM", " "), fit.replace('"gaipQnty":7,', ""), fit.replace("7", '"abc"'),
        fit.replace(',"statType":"Y"', ""), f"{fit},null", f"{fit},{fit.replace('7', 'null')}", fit, fit,
    ]
    texts = ["{", "{}", *[f'{{"items":[{x}]}}' for x in items]]
    first = blocks.first_item(t.prov_line, "receipt_no").withColumn("kind", kind)
    payload = F.replace(F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("kind") + 1).cast("int")), F.lit("ITEM"), F.trim("first_item_code"))
    sent_to = F.when(F.col("kind") == 9, F.lit(" ")).otherwise(F.col("receipt_no"))
    return first.select(F.col("receipt_no").alias("request_id"), sent_to.alias("receipt_no"), payload.alias("payload"))


@query
def rejected_edits(t: Tables) -> DataFrame:
    return requests.rejected_edits(_odd_edits(t))


@query_reading("numbered")
def edit_outcomes(t: Tables) -> DataFrame:
    """What every edit document is answered: the number of lines it changes, or the reason why not."""
    documents = stored(_odd_edits(t), "edit-documents")
    accepted = stored(requests.explode_edits(requests.accepted_edits(documents)), "edits")
    return versions.edit_outcomes(t, accepted, requests.rejected_edits(documents))


@query
def rejected_deletes(t: Tables) -> DataFrame:
    """A delete document for each receipt; five of seven are refused."""
    kind = F.pmod(F.substring("receipt_no", 2, 20).cast("long"), F.lit(7))
    texts = ['{"ipgoNumbs":["X"]', "{}", '{"ipgoNumbs":[]}', '{"ipgoNumbs":["X"," "]}', '{"ipgoNumbs":[null]}', '{"ipgoNumbs":["X"]}', '{"ipgoNumbs":["X","Y"]}']
    payload = F.element_at(F.array(*[F.lit(x) for x in texts]), (kind + 1).cast("int")).alias("payload")
    return requests.rejected_deletes(t.prov_header.select(F.col("receipt_no").alias("request_id"), payload))


def _edit_documents(t: Tables) -> DataFrame:
    """A document for each provisional line, with two edits of its item."""
    def item(more: int, status: str) -> Column:
        code = F.concat("item_code", F.lit(" ")).alias("itemCode")
        return F.struct(code, (F.col("qty") + more).alias("gaipQnty"), F.lit(status).alias("statType"))

    items = F.array(item(1, c.OPEN), item(2, c.CLOSED)).alias("items")
    return t.prov_line.select(
        F.concat("receipt_no", F.lit("/"), F.col("line_seq")).alias("request_id"),
        F.concat("receipt_no", F.lit(" ")).alias("receipt_no"),
        F.to_json(F.struct(items)).alias("payload"),
    )


@query
def explode_edits(t: Tables) -> DataFrame:
    return requests.explode_edits(_edit_documents(t)).select("seq.*", "receipt_no", "item_code", "qty", "status")


@query
def explode_deletes(t: Tables) -> DataFrame:
    """A document for each receipt: its number, and one that does not exist."""
    numbers = F.array("receipt_no", F.concat(F.lit("X"), F.col("receipt_no"))).alias("ipgoNumbs")
    raw = t.prov_header.select(F.col("receipt_no").alias("request_id"), F.to_json(F.struct(numbers)).alias("payload"))
    return requests.explode_deletes(raw)


def _register(t: Tables) -> writes.Registration:
    requested = stored(_registrations(t), "requested-items")  # grouped and numbered
    return writes.register_receipts(t, requested, as_of=AS_OF, settle=True)


@query_reading("lines")
def register_receipts(t: Tables) -> DataFrame:
    return _register(t).lines


@query_reading("lines")
def register_receipts_headers(t: Tables) -> DataFrame:
    new = _register(t)
    return new.headers.join(new.contacts, "receipt_no")


@query_reading("lines")
def register_receipts_summary(t: Tables) -> DataFrame:
    return _register(t).summary


def _edits(t: Tables) -> DataFrame:
    """For every receipt, two edits of its first line's item; the second one counts."""
    first = blocks.first_item(t.prov_line, "receipt_no", "qty")
    seq = F.explode(F.sequence(F.lit(1), F.lit(2))).alias("seq")
    edits = first.select("receipt_no", "first_item_code", "qty", seq)
    return edits.select(
        "seq",
        "receipt_no",
        F.concat(F.col("first_item_code"), F.lit(" ")).alias("item_code"),
        (F.col("qty") + F.col("seq")).alias("qty"),
        F.when(F.col("seq") == 1, c.OPEN).otherwise(c.CLOSED).alias("status"),
    )


@query_reading("numbered")
def edit_receipt_lines(t: Tables) -> DataFrame:
    return writes.edit_receipt_lines(t, _edits(t))


@query_reading("numbered")
def edit_match_count(t: Tables) -> DataFrame:
    return writes.edit_match_count(t, stored(_edits(t), "edits"))


def _deletes(t: Tables) -> DataFrame:
    """All closed receipts, and one id that does not exist for each supplier with orders."""
    closed = blocks.status_rollup(t.prov_line, "receipt_no").filter(F.col("status") == c.CLOSED).select("receipt_no")
    unknown = t.po_header.select(F.concat(F.lit("X"), F.col("supplier_code").cast("string")).alias("receipt_no"))
    return closed.unionByName(unknown.distinct())


@query
def delete_receipts(t: Tables) -> DataFrame:
    return writes.delete_receipts(t, _deletes(t)).prov_line


@query
def delete_receipts_counts(t: Tables) -> DataFrame:
    return writes.delete_counts(t, _deletes(t))
