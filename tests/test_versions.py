import threading
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from dockledger.functions.storage import create_once, names_in, text_of
from dockledger.operators import writes
from dockledger.plans import reads, versions
from dockledger.sources.requests import explode_requests
from dockledger.sources.sample import sample_tables
from dockledger.tables import SUPPLIED, TABLE_NAMES


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("versions"))
    t = sample_tables(spark, SMALL)
    assert versions.publish_version(spark, {name: t[name] for name in TABLE_NAMES}, folder) == 1
    return folder


def test_flows_make_versions(spark, root):
    first = versions.load_version(spark, root)
    lines = first.prov_line.count()
    payload = (
        '{"ipgoDate":"20300101","custCode":"7","userName":"Kim","ordrNumb":"S1",'
        '"items":[{"itemCode":"P000000001","ordrDetl":"","gaipQnty":3}]}'
    )
    raw = spark.createDataFrame([(1, payload), (2, payload)], "request_id int, payload string")
    bad = [(3, payload.replace("20300101", "20301301")), (4, payload[:-3]), (5, payload.replace(':3}', ':"x"}'))]
    raw = raw.unionByName(spark.createDataFrame(bad, raw.schema))
    answers = versions.run_register(spark, root, raw, "2029-12-30").orderBy("request_id").collect()
    assert [(r.inserted_count, r.reason) for r in answers] == [
        (1, None), (1, None), (0, "ipgoDate is no date"), (0, "unreadable document"), (0, "quantity is no number"),
    ]
    numbers = [r.receipt_no for r in answers[:2]]
    assert numbers == ["G3001010001", "G3001010002"] and answers[2].receipt_no is None
    second = versions.load_version(spark, root)
    assert second.prov_line.count() == lines + 2
    assert second.prov_header.filter("receipt_no is null").count() == 0
    saved = second.prov_header.filter(F.col("receipt_no") == numbers[0]).first()
    assert (str(saved.saved_on), str(saved.due_date)) == ("2029-12-30", "2030-01-01")

    edits = spark.createDataFrame(
        [(1, numbers[0], "P000000001", 9.0, "Y")], "seq int, receipt_no string, item_code string, qty double, status string"
    )
    assert [tuple(r) for r in versions.run_edit(spark, root, edits).collect()] == [(numbers[0], 1)]
    edited = versions.load_version(spark, root).prov_line.filter(F.col("receipt_no") == numbers[0])
    assert [(r.qty, r.status) for r in edited.collect()] == [(9.0, "Y")]

    ids = spark.createDataFrame([(numbers[1],), ("none",)], "receipt_no string")
    assert tuple(versions.run_delete(spark, root, ids).first()) == (2, 1)
    last = versions.load_version(spark, root)
    assert last.prov_line.count() == lines + 1
    assert last.prov_header.filter(F.col("receipt_no").isin(numbers)).count() == 1

    # Older versions stay readable, and tables that no flow changes are stored once.
    assert versions.load_version(spark, root, 2).prov_line.count() == lines + 2
    assert versions.current_version(spark, root) == 4
    assert len(versions._state(spark, root, None).tables["po_line"]) == 1


def test_empty_input_is_refused_and_changes_nothing(spark, root):
    before = versions.current_version(spark, root)
    with pytest.raises(ValueError, match="no items to register"):
        versions.run_register(spark, root, spark.createDataFrame([(1, '{"items":[]}')], "request_id int, payload string"), "2030-01-01")
    with pytest.raises(ValueError, match="no items to edit"):
        versions.run_edit(spark, root, spark.createDataFrame([], "seq int, receipt_no string"))
    with pytest.raises(ValueError, match="no receipts to delete"):
        versions.run_delete(spark, root, spark.createDataFrame([], "receipt_no string"))
    assert versions.current_version(spark, root) == before


def test_incomplete_first_version_is_refused(spark, tmp_path):
    t = sample_tables(spark, SMALL)
    with pytest.raises(ValueError, match="would lack"):
        versions.publish_version(spark, {"item": t.item}, str(tmp_path))


def _small(spark):
    t = sample_tables(spark, SMALL)
    return {name: t[name] for name in TABLE_NAMES}


def _request(i, day="20300101", qty="3"):
    return (
        i,
        f'{{"ipgoDate":"{day}","custCode":"7","userName":"Kim","ordrNumb":"S1",'
        f'"items":[{{"itemCode":"P000000001","ordrDetl":"","gaipQnty":{qty}}}]}}',
    )


@pytest.fixture
def few(spark, tmp_path):
    """A version of few rows, so that many writes are quick; its dates come as date-times."""
    folder = str(tmp_path / "few")
    tables = {name: df.limit(5) for name, df in _small(spark).items()}
    for name, column in (("prov_header", "saved_on"), ("prov_header", "due_date"), ("prov_line", "updated_on")):
        tables[name] = tables[name].withColumn(column, F.col(column).cast("timestamp"))
    versions.publish_version(spark, tables, folder)
    return folder


def test_a_stale_or_repeated_base_is_refused(spark, few):
    before = sorted(versions.load_version(spark, few).prov_line.collect(), key=repr)
    with pytest.raises(ValueError, match="not current"):
        versions.publish_version(spark, _small(spark), few)
    assert versions.current_version(spark, few) == 1
    edits = spark.createDataFrame([(1, "none", "none", 9.0, "Y")], "seq int, receipt_no string, item_code string, qty double, status string")
    versions.run_edit(spark, few, edits)
    with pytest.raises(ValueError, match="not current"):
        versions.publish_version(spark, {"prov_line": _small(spark)["prov_line"]}, few, base=1)
    assert versions.current_version(spark, few) == 2
    for version in (1, 2):
        assert sorted(versions.load_version(spark, few, version).prov_line.collect(), key=repr) == before
    with pytest.raises(ValueError, match="no version"):
        versions.load_version(spark, few, 3)


@pytest.mark.parametrize("remains", ["folder", "empty", "half", "data"])
def test_what_a_dead_writer_leaves_is_passed_over(spark, few, remains):
    before = versions.load_version(spark, few).item.count()
    left = Path(few) / "versions" / "v00000002.json"
    if remains == "folder":
        (left / "_temporary").mkdir(parents=True)
    elif remains == "data":
        (left.parent / "_new-0123").write_text("{")
        versions.load_version(spark, few).item.limit(1).write.parquet(f"{few}/item/v00000002-{'0' * 32}")
    else:
        whole = next((Path(few) / "versions").glob("v*.json")).read_text()
        left.write_text("" if remains == "empty" else whole[: len(whole) // 2])
    assert versions.current_version(spark, few) == 1
    number = versions.publish_version(spark, {"item": _small(spark)["item"].limit(3)}, few, base=1)
    assert number == (2 if remains == "data" else 3)
    assert versions.current_version(spark, few) == number
    assert versions.load_version(spark, few).item.count() == 3
    assert versions.load_version(spark, few, 1).item.count() == before
    if number == 3:
        with pytest.raises(ValueError, match="no version 2"):
            versions.load_version(spark, few, 2)
    assert versions.publish_version(spark, {"item": _small(spark)["item"].limit(4)}, few, base=number) == number + 1


def test_of_writers_at_the_same_time_one_succeeds(spark, few, monkeypatch):
    """All pass the check of their base before any of them commits."""
    real, gate, results = versions.create_once, threading.Barrier(4), []

    def at_once(*arguments):
        gate.wait(60)
        return real(*arguments)

    def write(n):
        try:
            results.append((n, versions.publish_version(spark, {"item": _small(spark)["item"].limit(n)}, few, base=1)))
        except ValueError as error:
            results.append((n, str(error)))

    monkeypatch.setattr(versions, "create_once", at_once)
    writers = [threading.Thread(target=write, args=(n,)) for n in (1, 2, 3, 4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    won = [n for n, r in results if r == 2]
    assert len(won) == 1 and all("another writer" in r for n, r in results if n not in won)
    assert versions.current_version(spark, few) == 2
    assert versions.load_version(spark, few).item.count() == won[0]


def test_files_appear_once_elsewhere_too(spark, tmp_path):
    """By rename without overwriting, as on a distributed file system."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./in", f"file://{tmp_path}")
    path = "viewfs://shelf/in/made/v1.json"
    assert create_once(spark, path, "first") and not create_once(spark, path, "second")
    assert text_of(spark, path) == "first" and names_in(spark, "viewfs://shelf/in/made") == ["v1.json"]
    assert names_in(spark, "viewfs://shelf/in/none") == []


def _files(root):
    return {str(p.relative_to(root)): p.stat().st_size for p in Path(root).rglob("*.parquet")}


def _all_rows(t):
    return {name: sorted(t[name].collect(), key=repr) for name in ("prov_header", "prov_line", "prov_contact")}


def test_small_changes_store_little_and_are_worked_in(spark, tmp_path):
    root = str(tmp_path / "whole")
    versions.publish_version(spark, _small(spark), root)
    t = versions.load_version(spark, root)
    want, files = t, _files(root)
    schema = "seq int, receipt_no string, item_code string, qty double, status string"
    lines = t.prov_line.orderBy("receipt_no", "line_seq").limit(40).collect()
    steps = [
        [(1, lines[0].receipt_no, lines[0].item_code, 77.0, "Y"), (2, lines[0].receipt_no, lines[0].item_code + " ", 78.0, "N")],
        [lines[-1].receipt_no],
        [(1, lines[0].receipt_no, lines[0].item_code, 79.0, "Y"), (1, lines[-1].receipt_no, lines[-1].item_code, 5.0, "Y")],
        [(1, lines[5].receipt_no, lines[5].item_code, 1.5, "Y")],
    ]
    for step in steps:
        if isinstance(step[0], tuple):
            edits = spark.createDataFrame(step, schema)
            want = want.changed(prov_line=writes.edit_receipt_lines(want, edits))
            versions.run_edit(spark, root, edits)
        else:
            ids = spark.createDataFrame([(x,) for x in step], "receipt_no string")
            want = writes.delete_receipts(want, ids)
            versions.run_delete(spark, root, ids)
    new = set(_files(root)) - set(files)
    assert {name.split("/")[0] for name in new} == {"edits", "deletes"}
    assert spark.read.parquet(*{f"{root}/{name.rsplit('/', 1)[0]}" for name in new if name.startswith("edits")}).count() == 4
    changed = versions.load_version(spark, root)
    assert _all_rows(changed) == _all_rows(want) != _all_rows(t)
    assert _all_rows(versions.load_version(spark, root, 1)) == _all_rows(t)
    assert versions.compact(spark, root, most=4) == 5
    assert versions.compact(spark, root, most=3) == 6
    assert versions._state(spark, root, None).changes() == 0
    assert _all_rows(versions.load_version(spark, root)) == _all_rows(want)


def test_a_receipt_made_after_its_deletion_stays(spark, few):
    """Changes apply to rows that were there; marks stay, so numbers and lines of deleted receipts are not given again."""
    raw = lambda i, more="": spark.createDataFrame([(i, _request(i)[1].replace('"ipgoDate"', more + '"ipgoDate"'))], "request_id int, payload string")
    [first] = versions.run_register(spark, few, raw(1), "2030-01-01").collect()
    versions.run_delete(spark, few, spark.createDataFrame([(first.receipt_no,)], "receipt_no string"))
    [second] = versions.run_register(spark, few, raw(2), "2030-01-01").collect()
    assert (first.receipt_no, second.receipt_no) == ("G3001010001", "G3001010002")
    [again] = versions.run_register(spark, few, raw(3, f'"ipgoNumb":"{first.receipt_no}",'), "2030-01-02").collect()
    assert again.receipt_no == first.receipt_no
    t = versions.load_version(spark, few)
    mine = F.col("receipt_no") == first.receipt_no
    assert [(r.line_seq, r.qty) for r in t.prov_line.filter(mine).collect()] == [("0002", 3.0)]
    assert t.prov_header.filter(mine).count() == t.prov_contact.filter(mine).count() == 1
    [more] = versions.run_register(spark, few, raw(4, f'"ipgoNumb":"{first.receipt_no}",'), "2030-01-03").collect()
    t = versions.load_version(spark, few)
    assert sorted(r.line_seq for r in t.prov_line.filter(mine).collect()) == ["0002", "0003"]
    assert t.prov_header.filter(mine).count() == 1


def test_a_supplier_reads_a_part_of_the_lines(spark, tmp_path):
    """Row groups whose range of suppliers lacks the wanted one are skipped; rows are the same as without."""
    root = str(tmp_path / "whole")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so little is stored as one file
    try:
        versions.publish_version(spark, _small(spark), root)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for name, (_, document) in SUPPLIED.items():
        t = versions.load_version(spark, root)
        groups = []
        for path in Path(root, name).rglob("*.parquet"):
            meta = pq.ParquetFile(path).metadata
            at = meta.schema.to_arrow_schema().names.index("_owner")
            groups += [(meta.row_group(i).column(at).statistics, meta.row_group(i).num_rows) for i in range(meta.num_row_groups)]
        read = sum(n for x, n in groups if x.null_count or x.min <= 7 <= x.max)
        assert 0 < read < 0.3 * sum(n for _, n in groups)
        mine = t.of_supplier(name, 7)
        assert "EqualTo(_owner,7)" in mine._jdf.queryExecution().executedPlan().toString()
        headers = t[SUPPLIED[name][0]].filter("supplier_code = 7").select(document)
        want = t[name].join(headers, document, "left_semi")
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, want.select(mine.columns).collect()))
        assert mine.columns == t[name].columns and t.of_supplier(name, None) is t[name]
    # Lines added to a receipt of before have no supplier; they are read for each.
    known = t.prov_header.filter("supplier_code = 7").first().receipt_no
    raw = spark.createDataFrame([(1, _request(1)[1].replace('"ipgoDate"', f'"ipgoNumb":"{known}","ipgoDate"'))], "request_id int, payload string")
    versions.run_register(spark, root, raw, "2030-01-01")
    versions.run_edit(spark, root, spark.createDataFrame([(1, known, "P000000001", 8.0, "Y")], "seq int, receipt_no string, item_code string, qty double, status string"))
    for again in (False, True):
        t = versions.load_version(spark, root)
        added = [r for r in reads.receipt_detail(t, supplier=7).collect() if r.receipt_no == known and r.qty == 8.0 and r.status == "Y"]
        assert added
        everyone = sorted(map(repr, reads.receipt_history(t, ordered=False).collect()))
        mine = sorted(map(repr, reads.receipt_history(t, supplier=7, ordered=False).collect()))
        assert mine and set(mine) < set(everyone)
        if not again:
            versions.compact(spark, root, most=0)
    assert t.of_supplier("prov_line", 7).filter(F.col("receipt_no") == known).count() == t.prov_line.filter(F.col("receipt_no") == known).count()
    assert not t.of_supplier("prov_line", 7).filter(F.col("receipt_no") != known).join(t.prov_header.filter("supplier_code <> 7"), "receipt_no").count()


def test_registering_scans_no_header_and_no_line(spark, few):
    t = versions.load_version(spark, few)
    raw = spark.createDataFrame([(i, _request(i)[1]) for i in range(3)], "request_id int, payload string")
    new = writes.register_receipts(t, explode_requests(raw), as_of="2030-01-01")
    for df in (new.lines, new.headers, new.contacts, new.summary):
        read = [path.split("/few/")[1] for path in df.inputFiles() if "/few/" in path]
        assert not [path for path in read if not path.startswith("marks/")]
    assert any("/few/marks/" in path for path in new.lines.inputFiles())
    other = writes.register_receipts(t, explode_requests(raw), writes.NumberRule(prefix="H"), as_of="2030-01-01")
    assert {r.receipt_no for r in other.summary.collect()} == {f"H300101000{i}" for i in (1, 2, 3)}


def test_every_request_has_an_outcome_and_its_words_are_kept(spark, few):
    good = _request(1)[1].replace('"items"', '"storCode":"W1","memoXxxx":"by noon","items"').replace('"gaipQnty"', '"gaipYmmm":"203001","gaipQnty"')
    bad = [good.replace("P000000001", x) for x in ("", "  ")] + [good[:-4], good.replace("20300101", "soon"), None]
    raw = spark.createDataFrame([(i, p, "10.1.2.3, 10.9.9.9") for i, p in enumerate([good, *bad])], "request_id int, payload string, forwarded_for string")
    out = {r.request_id: r for r in versions.run_register(spark, few, raw, "2030-01-01").collect()}
    assert set(out) == set(range(6))
    assert [out[i].reason for i in range(6)] == [None, "item without itemCode", "item without itemCode", "unreadable document", "ipgoDate is no date", "unreadable document"]
    assert versions.load_details(spark, few).collect() == [(out[0].receipt_no, "0001", "0", "S1", "W1", "by noon", "203001", "10.1.2.3")]
    assert versions.load_details(spark, few, 1).collect() == []


def test_edit_documents_change_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "whole")
    versions.publish_version(spark, _small(spark), root)
    first, second = versions.load_version(spark, root).prov_line.orderBy("receipt_no", "line_seq").limit(2).collect()
    item = '{"itemCode":"%s","gaipQnty":%s,"statType":"%s"}'
    fit = item % (first.item_code, '"4"', "Y")
    documents = [
        (1, first.receipt_no, f'{{"items":[{fit}]}}'), (2, first.receipt_no, f'{{"items":[{fit},{item % (second.item_code, chr(34) + "abc" + chr(34), "Y")}]}}'),
        (3, first.receipt_no, '{"items":[{"itemCode":"x","gaipQnty":1}]}'), (4, "none", f'{{"items":[{fit}]}}'), (5, " ", f'{{"items":[{fit}]}}'), (6, "x", None),
    ]
    raw = spark.createDataFrame(documents, "request_id int, receipt_no string, payload string")
    out = {r.request_id: (r.updated_count, r.reason) for r in versions.run_edit_documents(spark, root, raw).collect()}
    assert out == {
        1: (out[1][0], None), 2: (0, "quantity is no number"), 3: (0, "item without statType"), 4: (0, None),
        5: (0, "no receipt number"), 6: (0, "unreadable document"),
    }
    assert out[1][0] >= 1
    t = versions.load_version(spark, root)
    assert t.prov_line.filter("qty is null or status is null").count() == 0
    edited = t.prov_line.filter((F.col("receipt_no") == first.receipt_no) & (F.col("item_code") == first.item_code))
    assert {(r.qty, r.status) for r in edited.collect()} == {(4.0, "Y")}
    before = versions.current_version(spark, root)
    nothing = spark.createDataFrame([(1, first.receipt_no, first.item_code, None, "Y")], "seq int, receipt_no string, item_code string, qty double, status string")
    with pytest.raises(ValueError, match="no qty"):
        versions.run_edit(spark, root, nothing)
    versions.run_edit_documents(spark, root, raw.filter("request_id > 4"))
    assert versions.current_version(spark, root) == before


def test_date_times_become_days_and_many_registrations_are_joined(spark, few):
    assert dict(versions.load_version(spark, few).prov_header.dtypes)["saved_on"] == "date"
    first = sorted(versions.load_version(spark, few).prov_line.collect(), key=repr)
    for i in range(4):
        raw = spark.createDataFrame([_request(i), _request(-i - 1, qty='"5"')], "request_id int, payload string")
        versions.run_register(spark, few, raw, "2030-01-01")
    t = versions.load_version(spark, few)
    header, lines = sorted(t.prov_header.collect(), key=repr), sorted(t.prov_line.collect(), key=repr)
    assert len(lines) == 5 + 8 and len({r.receipt_no for r in header}) == 5 + 8
    assert {r.qty for r in lines if r.receipt_no.startswith("G300101")} == {3.0, 5.0}
    assert versions.compact(spark, few, most=3) == 6
    assert all(len(own) == 1 for own in versions._state(spark, few, 6).tables.values())
    t = versions.load_version(spark, few)
    assert sorted(t.prov_header.collect(), key=repr) == header and sorted(t.prov_line.collect(), key=repr) == lines
    assert versions.compact(spark, few, most=3) == 6
    assert sorted(versions.load_version(spark, few, 1).prov_line.collect(), key=repr) == first
