import pytest
from compare import connect, duck_rows, kinds, spark_rows
from conftest import SMALL

import __spark_entry__ as contract
from dockledger.catalog.oracle import ORACLE
from dockledger.catalog.queries import ON_TABLES
from dockledger.catalog.queries import QUERIES as OWN
from dockledger.sources.sample import sample_tables

QUERIES = contract.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def check(df, con, sql):
    columns, rows = spark_rows(df)
    expected_columns, expected = duck_rows(con, sql)
    assert columns == expected_columns
    assert kinds(df, con, sql) == {}
    assert rows, "an empty result proves nothing"
    assert rows == expected


def test_every_query_has_sql():
    assert set(OWN) == set(ORACLE)
    assert set(OWN) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(stored, con, name):
    check(ON_TABLES[name](stored), con, ORACLE[name])


@pytest.mark.parametrize("name", ["po_picker", "receipt_history", "receipt_detail", "register_receipts"])
def test_query_on_the_given_tables_equals_sql(spark, con, name):
    check(QUERIES[name](spark, SMALL), con, ORACLE[name])


@pytest.mark.parametrize(
    "table", ["item", "po_header", "po_line", "receipt_header", "receipt_line", "prov_header", "prov_line"]
)
def test_derived_table_equals_sql(spark, con, table):
    tables = ORACLE["item_search"].split("SELECT item_code, part_no, item_name, item_group, item_type, t.name")[0]
    derived = sample_tables(spark, SMALL)[table]
    derived = derived.drop("po_line_key") if table == "po_line" else derived
    check(derived, con, f"{tables} SELECT * FROM {table}")


def test_entry(spark):
    assert contract.entry(spark).count() > 0
