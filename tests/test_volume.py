"""What large tables shuffle: shared steps run once, texts go once, and the rows are those of the SQL."""

import pytest
from compare import connect, duck_rows, spark_rows
from conftest import SMALL
from test_plans import large, plan_of, shuffles  # noqa: F401

from dockledger.catalog.oracle import ORACLE
from dockledger.catalog.queries import ON_TABLES, QUERIES
from dockledger.functions.skew import skew_join
from dockledger.plans import exports, reads
from dockledger.sources.sample import sample_tables

READ_AGAIN = [
    "bulk_status_change", "delivery_sheet_nested", "delivery_sheet_with_totals", "edit_match_count", "edit_outcomes",
    "edit_receipt_lines", "po_line_status", "po_line_status_raw", "receipt_detail", "receipt_detail_batch",
    "receipt_detail_closed", "receipt_detail_open", "receipt_history", "receipt_history_by_month", "receipt_history_open",
    "receipt_history_range", "receipt_history_search", "receipt_history_year", "register_receipts",
    "register_receipts_headers", "worksheet_remove_items",
]


@pytest.mark.parametrize("name", READ_AGAIN)
def test_rows_on_the_given_tables(spark, name):
    con = connect(SMALL)
    assert spark_rows(QUERIES[name](spark, SMALL)) == duck_rows(con, ORACLE[name])


def test_lines_are_shuffled_once_for_their_order(spark, large):  # noqa: F811
    t = sample_tables(spark, SMALL)
    assert shuffles(t.receipt_line) <= 2  # lines and orders
    assert shuffles(t.prov_line) <= 3  # and the receipts


@pytest.mark.parametrize("name", ["bulk_status_change", "edit_match_count", "receipt_detail_batch"])
def test_lines_are_numbered_once(spark, large, name):  # noqa: F811
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "row_number" not in plan


@pytest.mark.parametrize("name", ["receipt_detail", "receipt_detail_batch", "po_line_status_raw"])
def test_shipments_are_joined_once(spark, large, name):  # noqa: F811
    assert "o_custkey" not in "".join(x for x in plan_of(QUERIES[name](spark, SMALL)).splitlines() if "Join" in x)


def test_nested_sheets_read_the_lines_once(stored, large):  # noqa: F811
    assert plan_of(ON_TABLES["delivery_sheet_nested"](stored)).count("po_line_key") == 0
    assert plan_of(ON_TABLES["delivery_sheet_nested"](stored)).count("FileScan parquet") <= 4


def test_history_reads_order_lines_once(stored, large):  # noqa: F811
    history = reads.receipt_history(stored, ordered=False)
    assert plan_of(history).count("FileScan parquet") <= 4
    assert shuffles(history) <= 8


def test_months_are_counted_on_a_stored_history(spark, stored, monkeypatch):
    plans = []
    write = exports.write_by_month
    monkeypatch.setattr(exports, "write_by_month", lambda rows, *a: (plans.append(plan_of(rows)), write(rows, *a)))
    assert ON_TABLES["receipt_history_by_month"](stored).count()
    assert "Join" not in plans[0]


@pytest.mark.parametrize("name", ["register_receipts", "register_receipts_headers"])
def test_registrations_are_made_once(stored, large, name):  # noqa: F811
    assert "po_line" not in plan_of(ON_TABLES[name](stored)).replace("po_line_key", "")


@pytest.mark.parametrize("name", ["edit_match_count", "edit_outcomes"])
def test_edits_are_made_once(stored, large, name):  # noqa: F811
    """They are stored: the only lines that the plan still groups by receipt are those that the edits match."""
    assert "first_item_code" not in plan_of(ON_TABLES[name](stored))


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_a_key_is_shuffled_once_and_stays(spark, large, how):  # noqa: F811
    left = spark.createDataFrame([("a", 1), (None, 2), ("", 3), ("b", 4), (None, 5)], "k string, n int")
    right = spark.createDataFrame([("a", "x"), ("", "y"), (None, "z")], "k string, v string")
    joined = skew_join(left, right, ["k"], how, spread_by=["n"])
    plain = left.join(right, left.k.eqNullSafe(right.k) & left.k.isNotNull(), how)
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, plain.select(left["*"], *(["v"] if how == "left" else [])).collect()))
    sent = [x for x in plan_of(joined).splitlines() if "Exchange" in x]
    assert sent and not any("k#" in x.split("_key")[0] for x in sent)
