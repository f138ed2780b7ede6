"""Hand-made rows with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dockledger.functions import columns as c
from dockledger.operators import blocks, grid, sheet, worksheet, writes
from dockledger.plans import reads
from dockledger.sources.loading import conform
from dockledger.sources.loading import load_jdbc
from dockledger.sources.requests import explode_edits, explode_requests, rejected_requests
from dockledger.tables import LAYOUTS, Tables


def day(text):
    return dt.date.fromisoformat(text)


ROWS = {
    "item": [
        ("A1", "PN-1", "red bolt", "metal", "21", "Q1"),
        ("A2", "PN-2", "nut_50%", "metal", "22", "Q9"),
        ("A3", "PN-3", "machine", "plant", "11", "Q1"),
        ("A5", "A1", "washer", None, "29", None),
    ],
    "code": [
        ("item_gubn", "11", "product"), ("item_gubn", "21", "raw"), ("item_gubn", "22", "sub"),
        ("QNTY_CODE", "Q1", "EA"),
    ],
    "po_header": [
        ("S1", "7", day("2026-07-01")), ("S2", "7", day("2026-07-31")), ("S3", "7", day("2026-07-15")),
        ("S4", "8", day("2026-07-15")),
    ],
    "po_line": [
        ("S1", "0001", "A1", 10.0, day("2026-08-01"), "N"),
        ("S1", "0002", "A2", 5.0, day("2026-08-02"), "Y"),
        ("S1", "0003", " A1", 4.0, day("2026-08-03"), "Y"),
        ("S2", "0001", "A4", 3.0, day("2026-08-04"), "Y"),
        ("S4", "0001", "A3", None, day("2026-08-05"), None),
    ],
    "receipt_header": [("I1", "1"), ("I2", "1")],
    "receipt_line": [
        ("S10001", "A1", 4.0, "I1"), ("S10001", "A1", 8.0, "I2"), ("S10002", "A3", 5.0, "I1"),
    ],
    "prov_header": [
        ("G1", "7", day("2026-07-20"), day("2026-07-27")), ("G2", "7", day("2026-07-20"), day("2026-07-28")),
        ("G3", "7", day("2026-07-20"), day("2026-07-27")),
    ],
    "prov_line": [
        ("G1", "0001", "S20001", "A4", 3.0, "Y", None),
        ("G1", "0002", "S10001", "A1", 2.0, "N", day("2026-07-21")),
        ("G1", "0003", "S10002", "A2", 1.0, "Y", day("2026-07-22")),
        ("G2", "0001", "", "A1", 6.0, "N", None),
        ("G2", "0002", "S40001", "A3", 7.0, None, None),
        ("G2", "0003", "", "A1", 1.0, "Y", None),
    ],
    "prov_contact": [("G1", "Kim", "010"), ("G2", "Lee", "011"), ("G3", "Park", "")],
}


@pytest.fixture(scope="module")
def t(spark):
    return Tables({
        name: conform(spark.createDataFrame(rows, LAYOUTS[name].schema), name, clean=True) for name, rows in ROWS.items()
    })


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_receipt_over_two_orders_has_its_summary_on_the_first_lines_order(t):
    found = rows(reads.receipt_history(t).filter("receipt_no = 'G1'"), "po_no", "item_summary", "status", "po_status")
    assert found == [("S1", None, "N", "N"), ("S2", "A4", "Y", "Y")]
    own = reads.receipt_history(t, summary_scope="group_first").filter("receipt_no = 'G1'")
    assert rows(own, "po_no", "item_summary") == [("S1", "red bolt 외 1건"), ("S2", "A4")]


def test_lines_without_order_form_a_group_without_number(t):
    found = rows(reads.receipt_history(t).filter("receipt_no = 'G2'"), "po_no", "item_summary", "status", "po_status")
    assert found == [("S4", None, "Y", "Y"), (None, "red bolt 외 1건", "N", None)]


def test_dates_of_the_history(t):
    found = rows(reads.receipt_history(t).filter("po_no = 'S1'"), "due_date", "saved_on", "last_update")
    assert found == [(day("2026-07-27"), "20260720", "20260722")]


def test_headers_without_lines_are_missing_from_histories_only(t):
    assert "G3" not in [r[0] for r in rows(reads.receipt_history(t), "receipt_no")]
    assert "S3" not in [r[0] for r in rows(reads.po_history(t), "po_no")]
    assert ("S3", None, day("2026-07-15")) in rows(reads.po_picker(t), "po_no", "item_summary", "po_date")
    assert ("G3", None, None) in rows(reads.receipt_detail(t), "receipt_no", "item_code", "po_line_key")
    assert ("S3", None, None) in rows(reads.po_line_status(t), "po_no", "item_code", "po_line_key")


def test_order_history(t):
    found = rows(reads.po_history(t), "po_no", "item_summary", "delivery_date", "status")
    assert found == [
        ("S1", "red bolt 외 2건", day("2026-08-01"), "N"),
        ("S2", "A4", day("2026-08-04"), "Y"),
        ("S4", "machine", day("2026-08-05"), "Y"),
    ]
    assert rows(reads.po_history(t, status="종결"), "po_no") == [("S2",), ("S4",)]
    with pytest.raises(ValueError, match="unknown status"):
        reads.po_history(t, status="maybe")


def test_both_ends_of_a_date_range_count(t):
    july = {"date_from": "2026-07-01", "date_to": "2026-07-31"}
    assert [r[0] for r in rows(reads.po_picker(t, supplier="7", **july), "po_no")] == ["S1", "S2", "S3"]
    assert [r[0] for r in rows(reads.po_picker(t, supplier="7", date_from="2026-07-02", **{"date_to": "2026-07-30"}), "po_no")] == ["S3"]
    assert len(rows(reads.receipt_history(t, date_from="2026-07-28", date_to="2026-07-28"), "receipt_no")) == 2


def test_picker_searches_every_line_but_the_history_only_the_first(t):
    assert rows(reads.po_picker(t, search="nut"), "po_no", "item_summary") == [("S1", "red bolt     외 2건")]
    assert rows(reads.po_history(t, search="nut"), "po_no") == []
    assert rows(reads.po_picker(t, search="A4"), "po_no") == [("S2",)]


def test_search_text_is_literal_unless_asked(t):
    assert rows(reads.item_search(t, "t_5"), "item_code") == [("A2",)]
    assert rows(reads.item_search(t, "r%t"), "item_code") == []
    assert rows(reads.item_search(t, "r%t", mode="pattern"), "item_code") == [("A1",)]
    assert rows(reads.item_search(t, "[rx]ed b_lt", mode="pattern"), "item_code") == [("A1",)]
    assert rows(reads.item_search(t, "[^r]ed", mode="pattern"), "item_code") == []


def test_item_search_keeps_bought_types(t):
    found = rows(reads.item_search(t), "item_code", "item_type_name", "unit_code")
    assert found == [("A1", "raw", "Q1"), ("A2", "sub", "Q9"), ("A5", None, None)]
    assert rows(reads.item_search(t, item_type="22"), "item_code") == [("A2",)]


def test_item_by_code_or_part_number(spark, t):
    codes = spark.createDataFrame([("A1 ",), ("PN-3",), ("A1",), ("none",)], "code string")
    assert rows(reads.item_by_code(t, codes), "code", "item_code") == [("A1", "A1"), ("A1", "A5"), ("PN-3", "A3")]


def test_line_status(t):
    status = reads.po_line_status(t)
    assert rows(status, "po_line_key", "ordered_qty", "received_qty", "outstanding_qty", "provisional_qty") == [
        ("S10001", 10.0, 12.0, -2.0, 2.0),
        ("S10002", 5.0, 0.0, 5.0, 1.0),
        ("S10003", 4.0, 0.0, 4.0, None),
        ("S20001", 3.0, 0.0, 3.0, 3.0),
        ("S40001", 0.0, 0.0, 0.0, 7.0),
        (None, None, None, None, None),
    ]
    # Another type keeps its row without name; a leading blank is another code; a unit without name is its code.
    assert rows(status, "po_line_key", "item_name", "unit") == [
        ("S10001", "red bolt", "EA"), ("S10002", "nut_50%", "Q9"), ("S10003", None, None),
        ("S20001", None, None), ("S40001", None, None), (None, None, None),
    ]


def test_raw_line_status_repeats_lines_per_receipt(t):
    assert [r[0] for r in rows(reads.po_line_status_raw(t), "po_line_key")] == [
        "S10001", "S10001", "S10002", "S10003", "S20001", "S40001", None,
    ]


def test_detail_counts_open_announcements_only(t):
    found = rows(reads.receipt_detail(t), "receipt_no", "line_seq", "outstanding_qty", "po_line_key", "open_provisional_qty")
    assert found == [
        ("G1", "0001", 3.0, "S20001", None),
        ("G1", "0002", -2.0, "S10001", 2.0),
        ("G1", "0003", 5.0, "S10002", None),
        ("G2", "0001", None, None, 6.0),
        ("G2", "0002", 0.0, "S40001", None),
        ("G2", "0003", None, None, 6.0),
        ("G3", None, None, None, None),
    ]
    assert rows(reads.receipt_detail(t, status="N"), "line_seq") == [("0001",), ("0002",)]


def test_selection_does_not_change_rows(spark, t):
    wanted = spark.createDataFrame([(" G1 ",), ("G9",)], "receipt_no string")
    columns = reads.receipt_detail(t).columns
    expected = rows(reads.receipt_detail(t).filter("receipt_no = 'G1'"), *columns)
    for narrow in (True, False):
        assert rows(reads.receipt_detail(t, receipts=wanted, narrow=narrow), *columns) == expected
    orders = spark.createDataFrame([("S1",)], "po_no string")
    status = reads.po_line_status(t)
    for narrow in (True, False):
        found = rows(reads.po_line_status(t, pos=orders, narrow=narrow), *status.columns)
        assert found == rows(status.filter("po_no = 'S1'"), *status.columns)


def test_document_numbers(t):
    assert rows(reads.po_line_status(t, number=" S2 "), "po_no") == [("S2",)]
    assert rows(reads.po_line_status(t, number="S_"), "po_no") == []
    assert rows(reads.po_line_status(t, number="S[24]", mode="pattern"), "po_no") == [("S2",), ("S4",)]
    assert rows(reads.po_line_status(t, number="%", mode="pattern"), "po_no") == rows(reads.po_line_status(t), "po_no")
    assert {r[0] for r in rows(reads.receipt_detail(t, number="2"), "receipt_no")} == {"G2"}
    assert {r[0] for r in rows(reads.receipt_detail(t, number="G"), "receipt_no")} == {"G1", "G2", "G3"}


def test_trailing_blanks_go_on_load_and_leading_ones_only_in_summaries(spark):
    raw = spark.createDataFrame([("A1  ", " P1 ", "n", "g", "21 ", "Q1")], LAYOUTS["item"].schema)
    assert rows(conform(raw, "item", clean=True), "item_code", "part_no", "item_type") == [("A1", " P1", "21")]


def test_source_columns_and_date_spellings(spark):
    raw = spark.createDataFrame(
        [("G1", "7", "20260727", "2026-07-28T09:30"), ("G2", "7", "bad", None)],
        "ipgo_numb string, cust_code string, in_date string, ipgo_date string",
    )
    found = conform(raw, "prov_header", source_names=True, clean=True)
    assert rows(found, "receipt_no", "saved_on", "due_date") == [
        ("G1", day("2026-07-27"), day("2026-07-28")), ("G2", None, None),
    ]


def test_worksheet_rows(spark, t):
    sheet_rows = worksheet.receiving_worksheet(reads.po_line_status(t), "2026-08-15")
    first = rows(sheet_rows.filter("po_line_key = 'S10001'"), "needed_qty", "delivery_qty", "provisional_qty", "month", "unit")
    assert first == [(-2.0, "10", 2.0, "202608", "EA")]
    items = spark.createDataFrame([("S2", "A1")], "po_no string, item_code string")
    items = items.join(reads.item_search(t), "item_code")
    more = worksheet.worksheet_add_items(worksheet.worksheet_add_items(sheet_rows, items, "2026-08-15"), items, "2026-08-15")
    assert rows(more.filter("po_no = 'S2' and item_code = 'A1'"), "needed_qty", "unit", "po_line_key") == [
        (0.0, "Q1", None), (0.0, "Q1", None),
    ]
    codes = spark.createDataFrame([("A1",)], "item_code string")
    assert "A1" not in [r[0] for r in rows(worksheet.worksheet_remove_items(more, codes), "item_code")]
    one_sheet = spark.createDataFrame([("S2", "A1")], "po_no string, item_code string")
    left = rows(worksheet.worksheet_remove_items(more, one_sheet), "po_no", "item_code")
    assert ("S1", "A1") in left and ("S2", "A1") not in left


def test_only_positive_numbers_are_submitted(spark):
    typed = ["5", "0", "-1", "abc", "", " 2.5 ", "1e1", "5d", "Infinity", None]
    sheet_rows = spark.createDataFrame(
        [("S1", f"A{i}", q, "202608", f"S1000{i}") for i, q in enumerate(typed)],
        "po_no string, item_code string, delivery_qty string, month string, po_line_key string",
    )
    requests = spark.createDataFrame(
        [("S1", "7", day("2026-07-27"), None, "010")],
        "po_no string, supplier_code string, due_date date, contact_name string, contact_phone string",
    )
    found = worksheet.submit_lines(sheet_rows, requests, "2026-08-15")
    assert rows(found, "seq", "qty") == [(1, 5.0), (2, 2.5), (3, 10.0)]
    assert rows(found.limit(1), "due_date", "status", "store_code", "contact_name", "receipt_no") == [
        ("20260727", "N", "E010", "", "")
    ]


def test_months_around_a_year_end(spark):
    days = spark.createDataFrame([(day("2026-08-31"),)], "d date")
    months = [r[1] for r in rows(worksheet.month_options(days, "d"), "as_of", "month")]
    assert months == [
        "202603", "202604", "202605", "202606", "202607", "202608", "202609", "202610", "202611", "202612", "202701",
    ]
    assert worksheet.default_window(day("2026-03-05"), 7) == (day("2026-02-26"), day("2026-03-05"))


def test_scalar_texts(spark):
    one = spark.createDataFrame([("202608", 1234567.5, day("2026-07-05"), "1.2.3.4 , 5.6.7.8", None)], "m string, q double, d date, f string, h string")
    found = one.select(
        c.month_label("m"), c.quantity_text("q"), c.long_date("d"), c.client_address("f", "h"), c.client_address("h", "h"),
        c.month_label("h"), c.client_address("h", "m"),
    ).first()
    assert tuple(found) == ("2026-08", "1,234,567.5", "2026년 7월 5일", "1.2.3.4", "127.0.0.1", "", "202608")


def test_status_labels_differ_on_unknown(spark):
    df = spark.createDataFrame([("N",), ("Y",), (None,), ("X",)], "s string")
    found = rows(df, "s", c.status_label("s", "closed"), c.status_label("s", "open"), c.status_label("s", "value"))
    assert found == [
        ("N", "진행중", "진행중", "진행중"), ("X", "종결", "진행중", "X"), ("Y", "종결", "종결", "종결"),
        (None, "종결", "진행중", "-"),
    ]


def test_grid_filter_ignores_case(spark):
    df = spark.createDataFrame([("Red", 1), ("RED x", 2), ("blue", 3)], "name string, n int")
    assert [r.n for r in grid.grid_filter_sort(df, {"name": "red"}, [("n", False)]).collect()] == [2, 1]


@pytest.mark.parametrize("lines, expected", [(0, 15), (3, 15), (15, 15), (22, 22)])
def test_sheet_length(spark, t, lines, expected):
    headers = spark.createDataFrame([("G1", "7", None, None)], LAYOUTS["prov_header"].schema)
    body = spark.createDataFrame(
        [("G1", f"{i:04d}", "", "A1", float(i), "N", None) for i in range(1, lines + 1)], LAYOUTS["prov_line"].schema
    )
    small = t.changed(prov_header=headers, prov_line=body)
    found = rows(sheet.delivery_sheet(small), "line_no", "item_code", "qty")
    assert [r[0] for r in sorted(found)] == list(range(1, expected + 1))
    assert sum(r[1] == "A1" for r in found) == lines
    assert sum(r[1] == "-" for r in found) == (lines == 0)
    total = lines * (lines + 1) / 2
    assert rows(sheet.delivery_sheet_totals(small), "total_qty", "total_text") == [(total, f"{int(total):,}")]
    parts = sheet.delivery_sheet_nested(small, rows_per_part=10).orderBy("part").collect()
    assert [len(p["lines"]) for p in parts] == ([10, 5] if expected == 15 else [10, 10, 2])
    assert [x["line_no"] for p in parts for x in p["lines"]] == list(range(1, expected + 1))
    assert sum(p["part_qty"] or 0 for p in parts) == total
    assert {(p["total_qty"], p["part_count"], p["total_text"]) for p in parts} == {(total, len(parts), f"{int(total):,}")}


def test_sheet_head(t):
    head = sheet.delivery_sheet_header(reads.receipt_history(t), "2026-07-05")
    assert rows(head.filter("receipt_no = 'G2'"), "po_no", "due_date", "printed_on") == [
        ("-", "2026-07-28", "2026년 7월 5일"), ("S4", "2026-07-28", "2026년 7월 5일"),
    ]


def edits(spark, *entries):
    return spark.createDataFrame(list(entries), "seq int, receipt_no string, item_code string, qty double, status string")


def test_edits_change_every_line_of_the_item_and_the_last_wins(spark, t):
    changes = edits(spark, (1, "G2", "A1", 9.0, "N"), (2, " G2", "A1 ", 8.0, "Y"), (3, "G1", "none", 1.0, "Y"))
    found = rows(writes.edit_receipt_lines(t, changes), "receipt_no", "line_seq", "qty", "status")
    assert found == [
        ("G1", "0001", 3.0, "Y"), ("G1", "0002", 2.0, "N"), ("G1", "0003", 1.0, "Y"),
        ("G2", "0001", 8.0, "Y"), ("G2", "0002", 7.0, None), ("G2", "0003", 8.0, "Y"),
    ]
    assert rows(writes.edit_match_count(t, changes), "receipt_no", "updated_count") == [("G1", 0), ("G2", 4)]


def test_no_edits_change_nothing(spark, t):
    none = edits(spark, (1, "x", "x", 0.0, "Y")).limit(0)
    after = writes.edit_receipt_lines(t, none)
    assert rows(after, *t.prov_line.columns) == rows(t.prov_line, *t.prov_line.columns)


def test_bulk_status_change(spark, t):
    keys = spark.createDataFrame([("G2", "0001")], "receipt_no string, line_seq string")
    shown = reads.receipt_detail(t, receipts=spark.createDataFrame([("G2",), ("G3",)], "receipt_no string"))
    found = rows(grid.bulk_status_change(shown, keys, "Y"), "seq", "item_code", "status")
    assert found == [(1, "A1", "Y"), (2, "A3", None), (3, "A1", "Y")]


def test_delete_removes_from_all_three_tables(spark, t):
    ids = spark.createDataFrame([("G1",), ("unknown",)], "receipt_no string")
    left = writes.delete_receipts(t, ids)
    for table in ("prov_header", "prov_line", "prov_contact"):
        before, after = rows(t[table], "receipt_no"), rows(left[table], "receipt_no")
        assert after == [r for r in before if r[0] != "G1"]
    assert rows(writes.delete_counts(t, ids), "deleted_count", "found_count") == [(2, 1)]


PAYLOAD = """{"ipgoNumb": "%s", "ipgoDate": "20260727", "custCode": "7", "userName": "Kim", "ordrNumb": " S1 ",
 "teleNumb": null, "memoXxxx": "head", "items": [%s]}"""
ITEM = '{"itemCode": "%s", "ordrDetl": "%s ", "gaipQnty": %s, "gaipYmmm": "202607", "memoXxxx": "item"}'


@pytest.fixture(scope="module")
def requests(spark):
    one = ITEM % ("A1", "S10001", 5)
    two = ITEM % ("A2", "", 2.5)
    return spark.createDataFrame(
        [
            (2, PAYLOAD % ("", f"{one},{two}")), (10, PAYLOAD % ("", one)), (3, PAYLOAD % ("G2 ", two)),
            (4, PAYLOAD % ("", "")), (5, "no json"),
        ],
        "request_id int, payload string",
    )


def test_requests_are_exploded_and_empty_ones_rejected(requests):
    found = explode_requests(requests)
    assert rows(found, "request_id", "seq", "item_code", "po_line_key", "qty", "status", "memo", "store_code", "po_no") == [
        (10, 1, "A1", "S10001", 5.0, "Y", "head", "E010", "S1"),
        (2, 1, "A1", "S10001", 5.0, "Y", "head", "E010", "S1"),
        (2, 2, "A2", "", 2.5, "Y", "head", "E010", "S1"),
        (3, 1, "A2", "", 2.5, "Y", "head", "E010", "S1"),
    ]
    assert rows(rejected_requests(requests), "request_id", "reason") == [(4, "empty items"), (5, "unreadable document")]


def test_registration_numbers_and_sequences(spark, t, requests):
    used = spark.createDataFrame([("G2607270041", "7", None, day("2026-07-27"))], LAYOUTS["prov_header"].schema)
    busy = t.changed(prov_header=t.prov_header.unionByName(used))
    new = writes.register_receipts(busy, explode_requests(requests), as_of="2026-07-01")
    assert rows(new.summary, "request_id", "receipt_no", "inserted_count") == [
        (10, "G2607270043", 1), (2, "G2607270042", 2), (3, "G2", 1),
    ]
    assert rows(new.lines, "receipt_no", "line_seq", "item_code") == [
        ("G2", "0004", "A2"), ("G2607270042", "0001", "A1"), ("G2607270042", "0002", "A2"),
        ("G2607270043", "0001", "A1"),
    ]
    assert rows(new.headers, "receipt_no", "due_date", "saved_on") == [
        ("G2607270042", day("2026-07-27"), day("2026-07-01")), ("G2607270043", day("2026-07-27"), day("2026-07-01")),
    ]
    assert rows(new.contacts, "receipt_no", "contact_name", "contact_phone") == [
        ("G2607270042", "Kim", ""), ("G2607270043", "Kim", ""),
    ]
    after = writes.with_registration(busy, new)
    assert after.prov_line.count() == t.prov_line.count() + 4


def test_item_codes_are_unique_after_trimming(t):
    assert t.item.select(F.trim("item_code")).distinct().count() == t.item.count()


def test_blocks(t):
    assert rows(blocks.code_by_group(t, "qnty_code"), "code", "name") == [("Q1", "EA")]
    assert rows(blocks.cumulative_provisional(t.prov_line).filter("po_line_key = ''"), "item_code", "provisional_qty", "open_provisional_qty") == [("A1", 7.0, 6.0)]
    assert rows(reads.item_type_list(t), "code") == [("21",), ("22",)]


def test_a_sheet_of_more_lines_than_four_digits_keeps_their_order(spark, t):
    headers = spark.createDataFrame([("G1", "7", None, None)], LAYOUTS["prov_header"].schema)
    number = F.when(F.col("id") < 10_000, F.lpad(F.col("id").cast("string"), 4, "0")).otherwise(F.col("id").cast("string"))
    body = spark.range(1, 10_003).select(
        F.lit("G1").alias("receipt_no"), number.alias("line_seq"), F.lit("").alias("po_line_key"),
        F.lit("A1").alias("item_code"), F.col("id").cast("double").alias("qty"), F.lit("N").alias("status"),
        F.lit(None).cast("date").alias("updated_on"),
    )
    small = t.changed(prov_header=headers, prov_line=body)
    assert sheet.delivery_sheet(small).filter("line_no <> qty").count() == 0
    parts = sheet.delivery_sheet_nested(small).orderBy("part").collect()
    assert len(parts) == 11 and {(p["total_qty"], p["part_count"]) for p in parts} == {(10_002 * 10_003 / 2, 11)}
    first = blocks.first_item(small.prov_line.filter("qty >= 9999"), "receipt_no", "qty").first()
    assert first["qty"] == 9999.0


def test_number_text_rounds_halves_up(spark):
    df = spark.createDataFrame([(0.0625,), (-0.0625,), (-0.0,), (1234.0005,), (None,)], "q double")
    assert [r[0] for r in df.select(c.quantity_text("q")).collect()] == ["0.063", "-0.063", "0", "1,234.001", None]


@pytest.mark.parametrize(
    "pattern, found", [("[[]", ["a[b"]), ("[&]", ["x&&y"]), ("[&&x]", ["x&&y"]), ("a[[x]b", ["a[b"]), ("[^a]b", ["a[b"]), ("\\", ["p\\q"])]
)
def test_signs_in_pattern_classes(spark, pattern, found):
    df = spark.createDataFrame([("a[b",), ("x&&y",), ("ab",), ("p\\q",)], "s string")
    assert rows(df.filter(c.contains_any(["s"], pattern, "pattern")), "s") == [(x,) for x in found]


def test_equal_hand_added_rows_are_numbered_in_a_total_order(spark):
    worksheet_rows = spark.createDataFrame(
        [("S1", "A1", qty, month, None) for qty, month in (("5", "202601"), ("3", "202602"), ("3", "202601"))],
        "po_no string, item_code string, delivery_qty string, month string, po_line_key string",
    )
    orders = spark.createDataFrame(
        [("S1", "7", day("2026-01-01"), "", "")],
        "po_no string, supplier_code string, due_date date, contact_name string, contact_phone string",
    )
    for n in (1, 3):
        lines = worksheet.submit_lines(worksheet_rows.repartition(n), orders, "2026-01-01")
        assert rows(lines, "seq", "qty", "month") == [(1, 3.0, "202601"), (2, 3.0, "202602"), (3, 5.0, "202601")]


def test_the_later_edit_wins_across_requests(spark, t):
    document = '{"items":[{"itemCode":"%s","gaipQnty":%s,"statType":"%s"},{"itemCode":"%s","gaipQnty":"abc","statType":"N"}]}'
    line = t.prov_line.filter("item_code = 'A1'").first()
    raw = spark.createDataFrame(
        [(i, line.receipt_no, document % ("A1 ", qty, status, "none")) for i, qty, status in ((1, 9, "Y"), (2, '"4"', "N"))],
        "request_id int, receipt_no string, payload string",
    )
    edits = explode_edits(raw)
    assert rows(edits, "qty", "item_code") == [(4.0, "A1"), (9.0, "A1"), (None, "none"), (None, "none")]
    after = writes.edit_receipt_lines(t, edits).filter((F.col("receipt_no") == line.receipt_no) & (F.col("item_code") == "A1"))
    assert {(r.qty, r.status) for r in after.collect()} == {(4.0, "N")}


def test_raw_line_status_of_one_order(t):
    every = reads.po_line_status_raw(t)
    number = every.first()["po_no"]
    wanted = sorted(map(repr, every.filter(F.col("po_no") == number).collect()))
    assert sorted(map(repr, reads.po_line_status_raw(t, number=number).collect())) == wanted


def test_line_tables_of_a_database_must_be_split(spark):
    with pytest.raises(ValueError, match="bounds"):
        load_jdbc(spark, "jdbc:none")
