"""Operators that compare documents: SimHash, line templates, repeated strings; archives; the pipeline."""

import base64
import collections
import gzip
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from compare import connect, duck_rows, spark_rows
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from dockledger.llm import gsaca, line_templates, repeats, simhash, warc
from dockledger.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, SMALL))
    expected_columns, expected = duck_rows(connect(SMALL), ORACLE[name])
    assert columns == expected_columns and rows
    if name == "op10_backoff":  # sums of logarithms in another order
        assert [r[2:] for r in rows] == [r[2:] for r in expected] or all(
            a == pytest.approx(b, abs=2e-6) for x, y in zip(rows, expected, strict=True) for a, b in zip(x, y, strict=True)
        )
    else:
        assert rows == expected


def print_by_hand(text, length=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + length]) for i in range(len(words) - length + 1)]
    shingles = shingles or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(values, bits):
    """The root of each value, all pairs compared."""
    values = np.array(values, np.uint64)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_and_components(odd, none, docs):
    for table, hand in ((odd, True), (docs, True)):
        rows = simhash.near_duplicates(table, ["doc_id", "text"]).collect()
        assert len(rows) == table.count()
        prints = [r.fingerprint & (1 << 64) - 1 for r in rows]
        assert not hand or prints == [print_by_hand(r.text) for r in rows]
        groups = collections.defaultdict(list)
        for r, root in zip(rows, components_by_hand(prints, 2), strict=True):
            groups[root].append(r)
        for members in groups.values():
            ids = [r.doc_id for r in members if r.doc_id is not None]
            assert {r.component_id for r in members} == {min(ids, default=None)}
            kept = [r for r in members if r.keeper]
            assert len(kept) == 1 and kept[0].doc_id == min(ids, default=None)
    assert simhash.near_duplicates(none, ["doc_id"]).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
@pytest.mark.parametrize("crowd", [4096, 8])
def test_every_link_is_found(spark, monkeypatch, bits, crowd):
    """Chains and clusters around some values, with flips in both halves and in the two bits outside them."""
    monkeypatch.setattr(simhash, "_LOOKUP", crowd)
    rng = np.random.default_rng(bits)
    values = set()
    for seed in rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist():
        for _ in range(30):
            values.add(seed)
            flips = rng.choice(64, rng.integers(1, 4), replace=False)
            seed ^= sum(1 << int(f) for f in flips)
    values = sorted(values | {0, 1, 3, 1 << 63, 3 << 62})
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "p long"), bits)
    tree = {r.node: r.root for r in simhash.components(links).collect()}
    wanted = components_by_hand(np.array(signed, np.int64).view(np.uint64), bits)
    groups, hand = collections.defaultdict(set), collections.defaultdict(set)
    for v, root in zip(signed, wanted, strict=True):
        hand[root].add(v)
        groups[tree.get(v, v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, hand.values()))
    assert all(root == min(members) for root, members in groups.items())


def test_anchors_cover_and_long_chains_join(spark):
    masks = simhash.anchor_masks(2)
    assert [len(m) for m in masks] == [1] + [16] * 31
    values = np.random.default_rng(0).integers(0, 1 << 31, 500, dtype=np.uint64)
    for half in (values,):
        assert (simhash.syndromes(half ^ masks[5][0]) != simhash.syndromes(half)).any()
        for v, s in zip(half, simhash.syndromes(half), strict=True):
            assert (simhash.syndromes(v ^ masks[s]) == 0).all()
    chain = spark.createDataFrame([(i + 1, i) for i in range(300)], "member long, root long")
    assert {r.root for r in simhash.components(chain).collect()} == {0}


def test_templates_drop_recurring_lines(spark, odd, none):
    footer = "Page {} of the very same footer"
    rows = [(i, f"{_spell('o', i)} {_spell('p', i)} {_spell('q', i)}\n{footer.format(i)}\nThe end.") for i in range(8)]
    rows += [(100, "only here is this line found\nThe end."), (101, None), (102, "")]
    kept, lines, dropped = line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: (r.text, r[lines], r[dropped]) for r in kept.collect()}
    # The template "Page <*> of the very same footer" and the short line stay in the first document.
    assert found[0] == (rows[0][1], 3, 0)
    for i in range(1, 8):
        assert found[i][0] == rows[i][1].split("\n")[0] and found[i][2] == 2
    assert found[100] == ("only here is this line found", 2, 1) and found[101] == (None, 0, 0) and found[102] == ("", 1, 0)
    table, lines, dropped = line_templates.drop_templates(odd)
    rows = table.collect()
    assert len(rows) == odd.count()
    assert [c for c in table.columns if c not in (lines, dropped)] == odd.columns
    footers = [r for r in rows if r.text and "Shared footer line" in r.text]
    assert len(footers) == 1
    assert line_templates.drop_templates(none)[0].count() == 0


@pytest.mark.parametrize("n", [400, 4000])
def test_a_template_with_words_as_fields_recurs_at_any_size(spark, n):
    """However often each of 200 names and 200 cities stands in the leaf, they are fields."""
    word = lambda kind, i: kind + "".join("abcdefghij"[int(c)] for c in str(i))
    lines = [f"We sent a parcel to {word('n', i % 200)} in {word('c', (7 * i + i // 200) % 200)}" for i in range(n)]
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept, _, dropped = line_templates.drop_templates(table)
    assert {r.doc_id: r[dropped] for r in kept.collect()} == {i: int(i > 0) for i in range(n)}


def _dropped(spark, lines):
    """Which of the documents lose lines; a document for each line."""
    kept, _, dropped = line_templates.drop_templates(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    return {r.doc_id for r in kept.collect() if r[dropped]}


def _spell(kind, i):
    return kind + "".join("abcdefghij"[int(c)] for c in str(i))


@pytest.mark.parametrize("others", [0, 8000])
def test_a_template_recurs_whatever_else_is_in_its_leaf(spark, others):
    """Neither unrelated lines of the same length and opening change it, nor another template over the same names."""
    rng = random.Random(4)
    lines = [f"We sent a parcel to {_spell('n', i)} in {_spell('c', 3 * i)}" for i in range(50)]
    mass = [f"We sent a {' '.join(_spell('w', rng.randrange(3000)) for _ in range(5))}" for _ in range(others)]
    assert _dropped(spark, lines + mass) & set(range(50)) == set(range(1, 50))
    letters = [f"We sent a letter to {_spell('n', i % 60)} at {_spell('t', i % 45)}" for i in range(others)]
    dropped = _dropped(spark, lines + mass + letters)
    assert dropped & set(range(50)) == set(range(1, 50))
    first = 50 + len(mass)
    assert {i for i in dropped if i >= first} == set(range(first + 1, first + len(letters)))
    assert not {i for i in dropped if 50 <= i < first}


def test_short_lines_and_scripts_without_spaces_recur(spark):
    shared = ["Share", "Read more", "All rights reserved.", "次の記事を読むにはこちらをクリックしてください", "Page 7", "12", "3 4"]
    texts = ["\n".join([f"own{_spell('x', i)}", *shared, f"{i} {i}"]) for i in range(6)]
    kept, _, dropped = line_templates.drop_templates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {r.doc_id: (r.text, r[dropped]) for r in kept.collect()}
    assert found[0] == (texts[0], 0)
    for i in range(1, 6):  # numbers alone are no template: different ones stay
        assert found[i] == (f"own{_spell('x', i)}\n{i} {i}", len(shared))


def test_templates_equal_sql_on_odd_lines(spark):
    rng = random.Random(12)
    words = ["red", "blue", "a", "7", "x9", "end.", "日本", "to"]
    texts = ["\n".join(rng.choice([" ", "", "\t"]) + rng.choice([" ", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    rows = [*enumerate(texts), (900, None), (901, "")]
    kept, lines, dropped = line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(line_templates.ORACLE_SQL).fetchall()}
    got = {r.doc_id: (r[lines], r[dropped], None if r.text is None else hashlib.md5(r.text.encode()).hexdigest()) for r in kept.collect()}
    assert got == want and sum(n for _, n, _ in got.values()) > 300


def test_lines_with_one_opening_and_other_endings_stay(spark):
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    texts = [f"It was the {word(i)}\nIt was the {word(i)} {word(i + 50)}\nPosted at time {i}:30\nUser of id {i} {i}" for i in range(20)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept, _, dropped = line_templates.drop_templates(table)
    found = {r.doc_id: (r.text, r[dropped]) for r in kept.collect()}
    # Lines that differ in numbers only are one template as before.
    assert found == {i: ("\n".join(t.split("\n")[: 2 if i else 4]), 2 if i else 0) for i, t in enumerate(texts)}


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(400):
        text = rng.integers(0, rng.integers(2, 5), rng.integers(1, 60))
        text[-1] = 0

        def suffix(i, text=text):
            return tuple(text[i : i + int(np.flatnonzero(text[i:] == 0)[0])])

        order = gsaca.suffix_array(text).tolist()
        assert sorted(order) == list(range(len(text)))
        assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(len(text)))
    assert len(gsaca.suffix_array(np.zeros(0, np.int64))) == 0


def repeats_by_hand(texts):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        yield len(d), int(gone.sum()), spans, np.frombuffer(d, np.uint8)[~gone].tobytes()


def planted():
    rng = np.random.default_rng(9)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    passages = [noise(n) for n in (199, 200, 201, 330, 900)]
    texts = [noise(150) + p + noise(150) for p in passages for _ in range(3)]
    texts += [passages[3][:250] + noise(40), "ab" * 400, "z" * 199, "z" * 200, "z" * 500, passages[4], noise(3000)]
    texts += [noise(90) + passages[4][i : i + 210] + noise(90) for i in range(0, 600, 7)]
    texts += ["é" * 150, "xé" * 150, None, "", texts[0], texts[0]]
    return texts


@pytest.mark.parametrize("crowd", [4096, 1])
def test_repeats(spark, odd, none, docs, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "ARRAY", 2000)
    table = spark.createDataFrame(list(enumerate(planted())), "doc_id long, text string")
    short = odd.withColumn("text", F.when(F.length("text") < 20_000, F.col("text")))
    for one in (table, short, docs.filter("length(text) < 3000")):
        texts = [r.text for r in one.collect()]
        rows = repeats.dedup_repeats(one, ["doc_id", "text"]).collect()
        wanted = sorted(((t or "", *x) for t, x in zip(texts, repeats_by_hand(texts), strict=True)))
        assert sorted((r.text or "", r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows) == wanted
    assert repeats.dedup_repeats(none, ["doc_id"]).count() == 0


def test_archive_round_trip(spark, tmp_path):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.1\r\n\n"
    pages = [(5, "http://a/ b\r\n", "same é"), (3, "http://a/1", "same é"), (9, None, None), (8, "u", ""), (7, "u", tricky)]
    pages += [(3, "http://a/1", "same é"), (None, "u", tricky), (11, "u", "x" * 300_000), (None, None, "lonely")]
    table = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, record_type string")
    path = str(tmp_path / "archive")
    warc.write_archive(table, path)
    records = warc.read_archive(spark, path, with_payload=True)
    by_kind = collections.Counter(r.record_type for r in records.collect())
    assert by_kind == {"request": 9, "metadata": 9, "response": 5, "revisit": 4}
    payloads = sorted(bytes(r.payload) for r in records.filter("record_type = 'response'").collect())
    assert payloads == sorted({(p[2] or "").encode() for p in pages})
    captures = warc.transactions(records)
    assert captures.filter("request is null or metadata is null").count() == 0
    rows = warc.resolved(captures).collect()
    first = {}
    for page, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault((html or "").encode(), page)
    wanted, told = [], set()
    for page, _, html in pages:
        data = (html or "").encode()
        is_first = page == first[data] and data not in told
        told |= {data} if is_first else set()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        wanted.append((page, len(data), digest, "response" if is_first else "revisit", None if is_first else first[data]))
    key = lambda x: tuple((v is None, str(v)) for v in x)
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(found, key=key) == sorted(wanted, key=key)
    assert all(r.digest_agrees and r.has_request for r in rows)
    empty = str(tmp_path / "empty")
    warc.write_archive(table.limit(0), empty)
    assert warc.resolved(warc.transactions(warc.read_archive(spark, empty))).count() == 0


def test_a_broken_archive_is_reported():
    good = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert len(list(warc.parse(good * 2, False))) == 2
    packed = gzip.compress(good) + gzip.compress(good + good)
    for step in (1, 7, 1 << 16):
        assert len(list(warc.parse(warc.unpacked(packed, step), False))) == 3
        assert len(list(warc.parse(warc.unpacked(good * 2, step), False))) == 2
    for bad in (good[:-4] + b"x" + good[-4:], good[:-2], good.replace(b"WARC-Type", b"x"), good.replace(b"Content-Length: 2", b"x: 2"), b"x"):
        with pytest.raises(ValueError):
            list(warc.parse(bad, False))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.parse(warc.unpacked(packed[:-9]), False))
    assert list(warc.parse(b"", False)) == []


def _warc(kind, name, body=b"", *fields):
    head = [b"WARC/1.0", b"warc-TYPE:" + kind, b"Warc-Record-Id:   <" + name + b">  ", *fields, b"content-length:%d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_captures_of_foreign_archives(spark, tmp_path):
    """Names in any case, any blanks, continued lines; several, missing and repeated records of a capture."""
    to = lambda *names: [b"WARC-CONCURRENT-TO:\t<" + n + b">" for n in names]
    records = [
        _warc(b"warcinfo", b"w"), _warc(b"response", b"r1", b"HTTP/1.1 200 OK\r\n\r\nhello", b"warc-target-uri:http://a/", b"  long"),
        _warc(b"metadata", b"m2", b"PAGE-ID:8", *to(b"r1")), _warc(b"metadata", b"m1", b"page-id :  7 \r\nother: x", *to(b"r1")),
        _warc(b"request", b"q1", b"GET", *to(b"r1", b"r2")), _warc(b"response", b"r2", b"no head"), _warc(b"request", b"q9", b"", *to(b"gone")),
        _warc(b"metadata", b"m9", b"page-id: many"), _warc(b"response", b"r3", b"\r\n\r\nagain"), _warc(b"response", b"r3", b"\r\n\r\nagain"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records[:5]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[5:])))
    read = warc.read_archive(spark, str(tmp_path))
    assert read.count() == len(records)
    rows = {r.record_id: r for r in warc.transactions(read).collect()}
    name = lambda x: x and x.record_id
    shown = {k: (name(r.response), name(r.request), name(r.metadata), r.n_response, r.n_request, r.n_metadata) for k, r in rows.items()}
    assert shown == {
        "<r1>": ("<r1>", "<q1>", "<m1>", 1, 1, 2), "<r2>": ("<r2>", "<q1>", None, 1, 1, 0), "<r3>": ("<r3>", None, None, 2, 0, 0),
        "<gone>": (None, "<q9>", None, 0, 1, 0), "<m9>": (None, None, "<m9>", 0, 0, 1),
    }
    first = rows["<r1>"]
    assert (first.response.uri, first.response.payload_bytes, first.metadata.page_id) == ("http://a/ long", 5, 7)
    assert rows["<m9>"].metadata.page_id is None and rows["<r2>"].response.payload_bytes == 0
    assert {r.page_id for r in warc.resolved(warc.transactions(read)).collect()} == {7, None}


def test_members_and_files(spark, tmp_path, monkeypatch):
    """Every record is a member of its own; files are cut by bytes, also in a run of large pages."""
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rng = np.random.default_rng(1)
    noise = lambda n: bytes(rng.integers(33, 126, n, dtype=np.uint8)).decode()
    pages = [(i, "http://a/", noise(9_000 if i % 50 > 30 else 10)) for i in range(100)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archive(table, str(tmp_path / "x"))
    found = [f.read_bytes() for f in (tmp_path / "x").rglob("part-*")]
    assert len(found) >= 10 and max(map(len, found)) < 20_000 + 10_000
    sizes = []
    for data in found:
        while data:
            member = zlib.decompressobj(31)
            sizes.append(len(list(warc.parse(member.decompress(data), False))))
            data = member.unused_data
    assert sizes == [1] * 300
    big = next(iter(warc._members(iter([pa.RecordBatch.from_arrays([pa.array(["z" * (1 << 24)])], ["record"])]))))
    assert gzip.decompress(big.column(0)[0].as_py() + b"\0") == b"z" * (1 << 24)


def test_pipeline(spark):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    before = docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] > 0
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1")
    rejected = before.join(labels, "doc_id").join(corpus_pipeline.keep_good(spark, before, SMALL), "doc_id", "left_anti")
    assert all(rules_fail(r.text) for r in rejected.collect())
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("copies")).collect()
    assert all(r.n == r.copies for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}


def rules_fail(text):
    words = WORD.findall(text)
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    under = {k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words) < 10 or len(under) > 0.2 * len(words)


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, odd, SMALL)
        assert set(odd.columns) <= set(kept.columns) and kept.count() > 0, name
        assert stage(spark, none, SMALL).count() == 0, name
