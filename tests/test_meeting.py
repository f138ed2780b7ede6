"""Lines of all kinds meet by their key in one shuffle, with the rows of the joins that they replace."""

import pytest
from compare import connect, duck_rows, spark_rows
from conftest import SMALL
from pyspark.sql import functions as F
from test_plans import large, plan_of, shuffles  # noqa: F401

from dockledger.catalog.oracle import ORACLE
from dockledger.catalog.queries import ON_TABLES, QUERIES
from dockledger.operators import blocks, writes
from dockledger.plans import reads
from dockledger.sources.sample import sample_tables

LINES = "po_no string, po_line_key string, item_code string, status string, qty double"
RECEIPTS = "po_line_key string, item_code string, qty double, actual_no string"
ANNOUNCED = "receipt_no string, line_seq string, po_line_key string, item_code string, qty double, status string, due_date date"


@pytest.fixture(scope="module")
def odd(spark):
    """Glued keys of two orders, a key with two items, lines without key, item or quantity, hand-added lines."""
    lines = [
        ("S1", "S10001", "A", "N", 5.0), ("S1", "S10001", "A", "Y", 5.0), ("S10", "S10001", "B", "N", 3.0), ("S2", "S20001", None, "N", 2.0),
        ("S3", "S30001", "A", "N", None), (None, None, "A", "N", 4.0), ("S4", None, "A", "Y", 4.0), ("S5", "S50001", "C", None, 1.0),
        ("", "", "D", "N", 6.0),
    ]
    receipts = [
        ("S10001", "A", 1.0, "I1"), ("S10001", "A", None, "I1"), ("S10001", "C", 9.0, "I2"), ("S20001", None, 7.0, "I1"), (None, "A", 8.0, "I1"),
        ("", "D", 2.0, "I3"), ("", "A", 2.0, "I3"), ("S30001", "A", 1.0, None),
    ]
    announced = [
        (r, f"{n:04d}", key, item, qty, status, None)
        for n, (r, key, item, qty, status) in enumerate([
            ("G1", "S10001", "A", 1.0, "N"), ("G1", "S10001", "A", 2.0, "Y"), ("G2", "S10001", "B", None, "N"), ("G2", "S20001", None, 1.0, "N"),
            ("G3", None, "A", 1.0, "N"), ("G3", "", "A", 3.0, "N"), ("G3", "", "A", 4.0, "N"), ("G3", "", "D", 4.0, "Y"), ("G4", "X", "A", 1.0, "N"),
            ("G4", "S50001", "C", 1.0, "Y"), ("G4", "S30001", None, 1.0, None),
        ])
    ]
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(receipts, RECEIPTS), spark.createDataFrame(announced, ANNOUNCED)


def rows(df, columns):
    return sorted(map(repr, df.select(columns).collect()))


def test_order_lines_meet_as_they_join(odd):
    columns = ["po_no", "item_code", "status", "balance_key", "ordered_qty", "received_qty", "outstanding_qty", "provisional_qty"]
    assert rows(reads._lines_with_quantities(*odd), columns) == rows(reads._lines_by_join(*odd), columns)


def test_receipt_lines_meet_as_they_join(odd):
    lines, receipts, announced = odd
    columns = ["receipt_no", "line_seq", "item_code", "qty", "status", "balance_key", "ordered_qty", "outstanding_qty", "open_provisional_qty"]
    found = reads._with_balances(blocks.quantities(lines, receipts, announced))
    joined = reads._details_by_join(announced, found, None)
    assert rows(reads._details_with_quantities(announced, lines, receipts, announced), columns) == rows(joined, columns)


def test_receipts_without_item_are_of_no_line(odd):
    found = {(r.po_no, r.item_code): r.received_qty for r in reads._lines_with_quantities(*odd).collect()}
    assert found[("S2", None)] == 0 and found[("S10", "B")] in (0, 1)


def test_receipt_detail_shuffles_lines_by_key_once(stored, large):  # noqa: F811
    assert shuffles(reads.receipt_detail(stored, status="N")) <= 7
    assert shuffles(ON_TABLES["receipt_detail_batch"](stored)) <= 11
    assert "balance_item" not in plan_of(reads.receipt_detail(stored))


def test_order_lines_are_shuffled_by_key_once(stored, large):  # noqa: F811
    assert shuffles(reads.po_line_status(stored)) <= 7


@pytest.mark.parametrize("name", ["worksheet_remove_items", "register_receipts", "register_receipts_headers", "register_receipts_summary"])
def test_rows_with_one_shuffle_of_the_lines(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == duck_rows(connect(SMALL), ORACLE[name])


def test_worksheets_share_the_shuffle_of_the_lines(spark, large):  # noqa: F811
    t = sample_tables(spark, SMALL, "lines")
    plan = plan_of(reads.po_line_status(t).drop("status"))
    assert plan.count("REPARTITION_BY_COL") - plan.count("ReusedExchange") <= 2


def test_numbering_sends_no_price(spark, large):  # noqa: F811
    """Lines get their number in the receipt from their place in the order line."""
    plan = plan_of(sample_tables(spark, SMALL).prov_line)
    assert "l_extendedprice" not in "".join(x for x in plan.splitlines() if "receipt_no" in x)


def test_no_line_is_read_where_requests_add_to_no_receipt(spark, large):  # noqa: F811
    t = sample_tables(spark, SMALL)
    t = t.changed(prov_line=t.prov_line.withColumn("line_seq", F.concat("line_seq", F.raise_error(F.lit("read")).cast("string"))))
    items = ON_TABLES["submit_lines"](sample_tables(spark, SMALL)).limit(50)
    new = writes.register_receipts(t, items, as_of="1997-07-15")
    assert new.lines.count() == 50
    added = items.withColumn("receipt_no", F.lit("G0000011997"))
    with pytest.raises(Exception, match="read"):
        writes.register_receipts(t, added, as_of="1997-07-15").lines.collect()


@pytest.mark.parametrize("table", ["po_line", "receipt_line", "prov_line", "prov_header", "receipt_header"])
@pytest.mark.parametrize("again", ["", "lines", "shipments", "numbered"])
def test_odd_lines_are_derived_as_by_sql(spark, tmp_path, table, again):
    """Missing and negative line numbers, missing flags, equal shipments, lines and orders without a number."""
    con = connect(SMALL)
    con.execute("SET default_null_order = 'nulls_first'")  # Spark's
    con.execute(f"""
        COPY (SELECT CASE WHEN n % 19 = 0 THEN NULL ELSE l_orderkey END AS l_orderkey, l_partkey, l_suppkey,
                     CAST(CASE n % 17 WHEN 0 THEN NULL WHEN 1 THEN -3 ELSE l_linenumber END AS INTEGER) AS l_linenumber,
                     l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN n % 23 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
                     l_linestatus, l_shipdate
              FROM (SELECT *, row_number() OVER () AS n FROM lineitem))
        TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    for name in ("orders", "part"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    tables = ORACLE["item_search"].split("SELECT item_code, part_no, item_name, item_group, item_type, t.name")[0]
    derived = sample_tables(spark, str(tmp_path), again)[table]
    derived = derived.drop("po_line_key") if table == "po_line" else derived
    assert spark_rows(derived) == duck_rows(con, f"{tables} SELECT * FROM {table}")
