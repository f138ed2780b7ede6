"""What must never show up in a plan, and what must."""

import re

import pytest
from pyspark.sql import functions as F

from dockledger.plans import reads
from dockledger.catalog.queries import ON_TABLES


@pytest.fixture
def large(spark):
    """Plans as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ON_TABLES))
def test_no_pairs_no_python_no_single_task(spark, stored, large, name):
    plan = plan_of(ON_TABLES[name](stored))
    for node in ("NestedLoopJoin", "CartesianProduct", "Python", "Pandas", "BroadcastExchange"):
        assert node not in plan, node
    # Only a result of one row may be made in one task.
    if name != "delete_receipts_counts":
        assert "SinglePartition" not in plan


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", plan_of(df)))


def test_shuffle_counts(stored, large):
    assert shuffles(reads.po_history(stored, ordered=False)) <= 4
    assert shuffles(reads.po_line_status(stored)) <= 9
    assert shuffles(reads.po_line_status_raw(stored)) <= 11
    assert shuffles(reads.receipt_detail(stored)) <= 10
    assert shuffles(ON_TABLES["receipt_detail_batch"](stored)) <= 14
    assert shuffles(reads.receipt_history(stored, ordered=False)) <= 9


@pytest.mark.parametrize("build", [
    lambda t: reads.receipt_history(t, supplier=7, ordered=False), lambda t: reads.po_line_status(t, supplier=7),
    lambda t: reads.po_line_status_raw(t, supplier=7), lambda t: reads.receipt_detail(t, supplier=7),
])
def test_a_small_selection_shuffles_little(spark, stored, build):
    """With a broadcast limit below the line tables, only the selected rows are shuffled, and no fact table."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        df = build(stored)
        found = len(df.collect())
        written = _shuffled_rows(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found
    # items and their few codes are no part of the selection
    assert written < 0.05 * stored.po_line.count() + 3 * stored.item.count()


def _shuffled_rows(df):
    """Rows written to shuffles by the plan that ran."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if name == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_filters_and_columns_reach_the_scan(stored, large):
    plan = plan_of(reads._selected(stored.po_header, 7, "po_date", "1997-01-01", "1997-12-31"))
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert any("EqualTo(supplier_code,7)" in line and "GreaterThanOrEqual(po_date,1997-01-01)" in line for line in pushed)
    lines = re.findall(r"FileScan parquet \[([^\]]*)\]", plan_of(reads.po_history(stored)))
    assert lines
    assert not any("qty" in columns for columns in lines)


def test_range_of_all_days_changes_nothing(stored):
    def rows(df):
        return sorted(map(repr, df.collect()))

    every = reads.receipt_history(stored, ordered=False)
    spanned = reads.receipt_history(stored, date_from="1990-01-01", date_to="2010-01-01", ordered=False)
    assert rows(every) == rows(spanned)
    mine = reads.po_history(stored, ordered=False)
    wanted = reads.po_history(stored, supplier=7, ordered=False).select("po_no")
    kept = rows(mine.join(wanted, "po_no", "left_semi").select(mine.columns))
    assert rows(reads.po_history(stored, supplier=7, ordered=False)) == kept


def test_properties(spark, stored):
    t = stored
    history = reads.receipt_history(t, ordered=False)
    keys = t.po_line.select("po_line_key", "po_no")
    groups = t.prov_line.join(keys, "po_line_key", "left").select("receipt_no", "po_no").distinct()
    assert history.count() == groups.count()
    assert history.filter(F.col("item_summary").isNotNull()).count() == t.prov_header.count()
    ordered = ON_TABLES["po_line_balance"](t).agg(F.sum("ordered_qty")).first()[0]
    assert ordered == t.po_line.agg(F.sum("qty")).first()[0]
    status, raw = reads.po_line_status(t), reads.po_line_status_raw(t)
    assert raw.distinct().count() == status.distinct().count() == status.count()
    numbered = ON_TABLES["delivery_sheet"](t).groupBy("receipt_no").agg(
        F.max("line_no").alias("top"), F.count("*").alias("n"), F.count("qty").alias("lines")
    )
    sizes = numbered.join(t.prov_line.groupBy("receipt_no").count(), "receipt_no")
    assert numbered.filter("top <> n or top < 15").count() == 0
    assert sizes.filter("lines <> count").count() == 0
    kept = ON_TABLES["delete_receipts"](t).count()
    gone = ON_TABLES["receipt_detail_closed"](t).count()
    assert kept + gone == t.prov_line.count()


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_partition_count_does_not_matter(spark, stored, partitions):
    names = ["receipt_history", "delivery_sheet", "register_receipts"]
    expected = {n: sorted(map(repr, ON_TABLES[n](stored).collect())) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for n in names:
            assert sorted(map(repr, ON_TABLES[n](stored).collect())) == expected[n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
