"""Search index, files by month, and the queries sent to a source database."""

import datetime as dt
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from dockledger.operators import search_index
from dockledger.plans import exports, reads
from dockledger.sources import loading
from dockledger.sources.loading import Condition
from dockledger.tables import LAYOUTS, TABLE_NAMES

TEXTS = [
    ("1", "steel bolt", "B-1"), ("2", "Steel", None), ("3", "ab", "b"), ("4", "", "x"), ("5", None, None), ("6", "aaa aaaa", "aab"),
    ("7", "볼트 M8×20", "볼트"), ("8", "a%b_c", "[x]"), ("9", "bolt steel", "bolt steel"), ("10", "long " * 30, "tail"),
]
SEARCHES = ["steel", "bolt s", "aaaa", "aab", "a", "ab", "b", "x", "볼트", "볼트 M8", "%b_", "[x]", "none", "", " ", "long long long long long tail", "long " * 20]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "item string, name string, part string").repartition(3)


@pytest.mark.parametrize("text", SEARCHES)
def test_an_indexed_search_finds_the_same_rows(spark, texts, text, tmp_path):
    index = search_index.store(search_index.build(texts, "item", ["name", "part"]), str(tmp_path / "index"))
    want = {i for i, *own in TEXTS if any(x is not None and text in x for x in own)}
    got = [r.item for r in search_index.search(texts, index, text, ["name", "part"]).collect()]
    assert sorted(got) == sorted(want)
    only = {i for i, name, _ in TEXTS if name is not None and text in name}
    assert {r.item for r in search_index.search(texts, index, text, ["name"]).collect()} == only
    if text:
        assert {r.item for r in search_index.candidates(index, text, ["name", "part"]).collect()} >= want


def test_an_index_narrows_and_prunes(spark, stored, tmp_path):
    index = search_index.store(search_index.build(stored.item, "item_code", reads.ITEM_TEXTS), str(tmp_path / "index"))
    found = search_index.candidates(index, "P00000012", reads.ITEM_TEXTS)
    assert 0 < found.count() < 0.2 * stored.item.count()
    assert "In(piece" in found._jdf.queryExecution().executedPlan().toString()
    for text in ("P00000012", "red", "P0000000", "zz", "e"):
        rows = lambda df: sorted(map(repr, df.collect()))
        assert rows(reads.item_search(stored, text, index=index)) == rows(reads.item_search(stored, text))


def _months(path):
    return {p.name: sorted((f.name, f.stat().st_mtime_ns) for f in p.glob("*.parquet")) for p in Path(path).glob("month=*")}


def test_a_rerun_of_one_month_replaces_only_it(spark, tmp_path):
    path = str(tmp_path / "out")
    days = [None, *(dt.date(2026, m, d) for m in (1, 2, 3) for d in (1, 15, 28))]
    rows = spark.createDataFrame([(i, days[i % len(days)], f"t{i}") for i in range(400)], "id int, day date, text string")
    exports.write_by_month(rows, path, "day", rows_per_file=25)
    before = _months(path)
    assert set(before) == {"month=none", "month=202601", "month=202602", "month=202603"}
    for folder in Path(path).glob("month=*"):
        sizes = [spark.read.parquet(str(f)).count() for f in folder.glob("*.parquet")]
        assert max(sizes) <= 25 and len(sizes) >= sum(sizes) / 25
    back = spark.read.parquet(path)
    assert sorted(back.select("id", "day", "text").collect(), key=repr) == sorted(rows.collect(), key=repr)
    february = rows.filter(F.month("day") == 2).withColumn("text", F.lit("new"))
    exports.write_by_month(february, path, "day")
    after = _months(path)
    assert {k: v for k, v in after.items() if k != "month=202602"} == {k: v for k, v in before.items() if k != "month=202602"}
    assert not set(after["month=202602"]) & set(before["month=202602"])
    assert spark.read.parquet(path).filter("text = 'new'").count() == february.count()
    exports.write_by_month(rows.limit(0), path, "day")
    assert _months(path) == after


def test_a_month_of_most_rows_gives_many_files(spark, tmp_path):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, F.lit("2026-02-01")).otherwise(F.lit("2026-01-01")).cast("date").alias("day"))
    exports.write_by_month(rows, str(tmp_path), "day", rows_per_file=100)
    files = {month: len(found) for month, found in _months(tmp_path).items()}
    assert files["month=202601"] >= 45 and files["month=202602"] >= 5


@pytest.fixture(scope="module")
def database():
    """The generated queries run on any database that knows RTRIM; its tables bear the source's names."""
    con = duckdb.connect()
    for name in TABLE_NAMES:
        kinds = {"string": "VARCHAR", "double": "DOUBLE", "date": "DATE"}
        columns = ", ".join(f"{f.source} {kinds[f.type.simpleString()]}" for f in LAYOUTS[name].fields)
        con.execute(f"CREATE TABLE {LAYOUTS[name].source} ({columns})")
    con.execute("INSERT INTO mt_ordr_detl SELECT 'S' || i // 3 || '  ', '000' || i % 3, CASE WHEN i % 5 = 0 THEN NULL ELSE 'P' || i END, i, DATE '2026-01-01' + i::INT, 'N ' FROM range(90) r(i)")
    con.execute("INSERT INTO mt_ordr_detl VALUES (NULL, '1', 'P', 1, NULL, NULL), ('O''Neil', '1', 'P', 1, NULL, 'Y')")
    return con


def test_each_row_of_a_split_table_is_read_once(database):
    bounds = {"po_line": ("po_no", ["S2", "S1", "O'", "S25"]), "receipt_line": ("po_line_key", ["A"]), "prov_line": ("receipt_no", ["A"])}
    derived, predicates = loading.jdbc_reads(bounds)["po_line"]
    whole = sorted(map(repr, database.execute(f"SELECT * FROM {derived}").fetchall()))
    parts = [database.execute(f"SELECT * FROM {derived} WHERE {p}").fetchall() for p in predicates]
    assert len(parts) == 5 and sum(map(bool, parts)) == 5
    assert sorted(repr(r) for p in parts for r in p) == whole and len(whole) == 92
    assert all(r[0] is None or not r[0].endswith(" ") for p in parts for r in p)


def test_filters_stand_inside_the_query(database):
    conditions = [Condition("qty", ">=", 30), Condition("delivery_date", "<", dt.date(2026, 2, 15)), Condition("po_no", ">", "S1")]
    sql = loading.source_query("po_line", conditions)
    assert "WHERE item_qnty >= 30 AND dery_date < '2026-02-15' AND ordr_numb > 'S1'" in sql
    rows = database.execute(sql).fetchall()
    assert rows and all(r[3] >= 30 and r[4] < dt.date(2026, 2, 15) for r in rows)
    assert database.execute(loading.source_query("po_line", [Condition("po_no", "=", "O'Neil")])).fetchall()[0][0] == "O'Neil"


def test_unfit_reads_are_refused():
    with pytest.raises(ValueError, match="bounds are needed for \\['prov_line', 'receipt_line'\\]"):
        loading.jdbc_reads({"po_line": ("po_no", ["S1"])})
    for bad in (Condition("none", "=", 1), Condition("qty", "; DROP", 1)):
        with pytest.raises(ValueError):
            loading.source_query("po_line", [bad])
    assert loading.split_predicates("x", []) == []
