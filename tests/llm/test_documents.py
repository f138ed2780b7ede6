"""Operators that judge documents one by one or by counts: mixing, rules, classifier, language, decontamination, scores."""

import collections
import math
import re

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from dockledger.llm import backoff, decontaminate, language_mixture, mixing, quality_model, repetition
from dockledger.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, most):
    """Targets by filling, step by step."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i] + 1e-9]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            return target
        for i in over:
            target[i] = most * sizes[i]
        left -= sum(target[i] for i in over)
        open_ -= set(over)
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 100, 5], [0, 7, 0, 3], [1000, 1], [5]])
def test_targets(sizes):
    weights = [1.0 + i % 3 for i in range(len(sizes))]
    assert mixing.targets(sizes, weights, 3.0) == pytest.approx(fill(sizes, weights, 3.0))


def test_targets_of_nothing():
    assert mixing.targets([], [], 3.0) == []
    assert mixing.targets([0, 0], [1.0, 2.0], 3.0) == [0.0, 0.0]


def test_mix_meets_targets_and_agrees_with_itself(spark):
    first = QUERIES["op1_entropy_mix"](spark, SMALL).collect()
    again = QUERIES["op1_entropy_mix"](spark, SMALL).collect()
    assert sorted(first) == sorted(again)
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sources = collections.defaultdict(list)
    for r in first:
        assert r.size == len(WORD.findall(texts[r.doc_id].text))
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert 0 < r.rate <= 3.0000001
        sources[texts[r.doc_id].source].append(r)
    names = sorted(sources)
    wanted = fill([sum(r.size for r in sources[n]) for n in names], [1.0 + i % 3 for i in range(len(names))], 3.0)
    for name, target in zip(names, wanted, strict=True):
        rows = sources[name]
        assert rows[0].target == pytest.approx(target)
        # The rates themselves meet the target, copies nearly.
        assert sum(r.rate * r.size for r in rows) == pytest.approx(target, rel=1e-5)
        assert abs(sum(r.taken for r in rows) - target) <= max(60, 0.02 * target)
        tilts = {round(math.log(r.rate) / r.size, 9) for r in rows if r.size > 50 and r.rate < 2.999}
        assert len(tilts) <= 1  # an exponential tilt, the same for all of a source


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["size"] == len(WORD.findall(r.text or "")) for r in rows)
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    assert all(r.taken == 0 for r in rows if not r["size"])
    assert all(r.source_size == sum(x["size"] for x in v) for v in by_source.values() for r in v)
    assert mixing.mix_sources(none).count() == 0


def rules_by_hand(text):
    words = WORD.findall(text or "")
    n = len(words)
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    under = {k for i in range(n - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    failed = n < 10 or 100 * len(under) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(under), failed


def test_rules(odd, none, docs):
    for table in (odd, docs):
        rows = repetition.quality_rules(table.select("doc_id", "text"), keep=["doc_id", "text"]).collect()
        assert len(rows) == table.count()
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules_by_hand(r.text)
            assert not (r.base_failed and r.kept)
    clashing = repetition.quality_rules(odd)
    assert clashing.columns.count("n_words") == 1 and clashing.columns.count("kept") == 1
    assert clashing.count() == odd.count()
    assert repetition.quality_rules(none).count() == 0


def test_rules_reject_texts_that_repeat_themselves(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    texts = [clean, "same " * 50, clean + "\n" + clean, " ".join(f"{w}***" for w in clean.split())]
    rows = repetition.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.kept for r in sorted(rows.collect())] == [True, False, False, False]


def test_rules_reject_interleaved_repeated_lines(spark):
    menu = "\n".join(f"Home About News Contact\nword{i} other{i} third{i} last{i}" for i in range(8))
    short = "one short clean line\nthat has another one\none short clean line"  # two thirds of it, held twice
    table = spark.createDataFrame([(0, menu), (1, short)], "doc_id long, text string")
    rows = sorted(repetition.quality_rules(table).collect())
    assert [(r.n_repeat_words, r.base_failed, r.kept) for r in rows] == [(0, False, False), (0, False, True)]


def test_each_rule_rejects_rows_of_its_own_and_equals_sql(spark):
    """A planted table on which base, n-gram, line and symbol rules each decide alone; the query's SQL agrees."""
    word = lambda kind, i: kind + "".join("abcdefghij"[int(c)] for c in str(i))
    filler = lambda n, kind="w": " ".join(word(kind, i) for i in range(n))
    long_run = " ".join(word("x" * 40, i) for i in range(10))  # few words, many characters
    lines = "\n".join(f"Home About News Contact\n{word('u', i)} {word('v', i)} {word('t', i)}" for i in range(8))
    five = " ".join(word("y" * 40, i) for i in range(5))
    texts = {
        "clean": filler(200), "short": filler(9), "repeats": "same " * 60, "ngrams": f"{long_run} {filler(150)} {long_run}",
        "five": f"{five} {filler(80)} {five}", "lines": lines, "one line": f"{filler(6, 'l')}\n{filler(9)}\n{filler(6, 'l')}",
        "symbols": " ".join(f"{word('w', i)}#*" for i in range(60)), "both": f"{lines}\n{long_run} {filler(60)} {long_run}",
    }
    table = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(texts.items())], "doc_id long, text string, kind string")
    rows = {r.kind: r for r in repetition.quality_rules(table, keep=["doc_id", "kind"]).collect()}

    def reasons(r):
        limits = repetition.NGRAM_LIMITS
        few = r.n_dup_lines <= repetition.FEW_LINES
        return {
            "base": r.base_failed, "ngrams": any(r[f"dup_chars_{n}"] > x * r.word_chars for n, x in limits.items()),
            "lines": r.dup_line_chars > (repetition.LINE_LIMIT if few else repetition.LINES_LIMIT) * r.word_chars,
            "symbols": r.n_symbols > repetition.SYMBOL_LIMIT * r.n_words,
        }

    found = {kind: sorted(k for k, v in reasons(r).items() if v) for kind, r in rows.items()}
    assert found == {
        "clean": [], "short": ["base"], "repeats": ["base", "ngrams"], "ngrams": ["ngrams"], "five": ["ngrams"], "lines": ["lines"],
        "one line": found["one line"], "symbols": ["symbols"], "both": ["ngrams"],
    }
    assert all(r.kept == (not found[kind]) for kind, r in rows.items())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, texts[r.kind]) for r in rows.values()])
    result = con.execute(repetition.ORACLE_SQL)
    names = [d[0] for d in result.description]
    want = {r[names.index("doc_id")]: dict(zip(names, r, strict=True)) for r in result.fetchall()}
    assert {r.doc_id: {n: r[n] for n in names} for r in rows.values()} == want


def test_classifier(spark, docs, labels, odd, none):
    scores = QUERIES["op2_quality_classifier"](spark, SMALL).join(labels, "doc_id").filter("held_out").collect()
    good = [r.score for r in scores if r.quality == 1]
    bad = [r.score for r in scores if r.quality == 0]
    assert good and bad
    pairs = [(g > b) + 0.5 * (g == b) for g in good for b in bad]
    assert sum(pairs) / len(pairs) > 0.95
    weights = quality_model.fit(quality_model.labelled_sample(docs, labels))
    rows = quality_model.score(odd, weights).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality_model.score(none, weights).count() == 0
    nothing = quality_model.fit(quality_model.labelled_sample(none, labels))
    assert {r.score for r in quality_model.score(odd, nothing).collect()} == {0.5}


def test_classifier_learns_neither_from_held_out_rows_nor_from_too_many(docs, labels):
    rows = quality_model.labelled_sample(docs, labels).select(F.max(F.crc32(F.col("id").cast("string")) % 5 == 0)).first()
    assert rows[0] is False
    assert quality_model.labelled_sample(docs, labels, most=10).count() < 30


def test_languages(spark, docs, odd, none):
    rows = QUERIES["op5_language_mixture"](spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    told = [r.lang == r.lang_pred for r in rows if r.held_out and r.lang is not None]
    assert sum(told) / len(told) > 0.95
    langs, like = language_mixture.fit(language_mixture.training_rows(docs))
    rows = language_mixture.identify(odd, langs, like)
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    rows = rows.collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = texts.get(r.doc_id) or ""
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
        assert 0 <= r.score <= 1 and r.lang_pred in {*langs, "und"}
    assert language_mixture.identify(none, langs, like).count() == 0
    nothing = language_mixture.fit(language_mixture.training_rows(none))
    assert {(r.lang_pred, r.score) for r in language_mixture.identify(odd, *nothing).collect()} == {("und", 0.0)}


def test_mixture_finds_both_languages(spark, docs):
    langs, like = language_mixture.fit(language_mixture.training_rows(docs))
    long_ = docs.filter("length(text) > 1500").select("lang", "text").collect()
    one = {lang: next(r.text for r in long_ if r.lang == lang)[:1500] for lang in {r.lang for r in long_}}
    a, b = sorted(one)[:2]
    mixed = spark.createDataFrame([(1, one[a] + "\n" + one[b]), (2, one[a])], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_mixture.identify(mixed, langs, like).collect()}
    assert sorted(rows[1].languages) == [a, b] and rows[2].languages == [a]


def bm25_by_hand(items, passages):
    """All (passage, item) scores as a share of the item's score for itself, for items of one segment."""
    words = {i: decontaminate.normal(t.encode()).split() for i, t in items}
    words = {i: w for i, w in words.items() if len(w) >= decontaminate.MIN_WORDS}
    df = collections.Counter(w for v in words.values() for w in set(v))
    mean = sum(map(len, words.values())) / len(words)
    idf = {w: math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    for i, own in words.items():
        tf = collections.Counter(own)
        weight = {w: idf[w] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, n in tf.items()}
        whole = sum(weight.values())
        for p, query in passages:
            yield p, i, sum(weight.get(w, 0) for w in set(query)) / whole


def test_retrieval_finds_exactly_what_reaches_the_threshold(spark, docs, items):
    """Block-max bounds must not lose a passage: the number retrieved equals that of scoring everything."""
    few = docs.filter("length(text) < 4000")
    every = [(r.item_id, r.text) for r in items.collect()]
    assert all(len(decontaminate.normal(t.encode()).split()) <= 64 for _, t in every)
    passages = []
    for r in few.collect():
        words = decontaminate.normal(r.text.encode()).split()
        for a in range(0, max(len(words), 1), 32):
            passages.append((r.doc_id, words[a : a + 64]))
    for threshold in (0.5, 0.15):
        wanted = collections.Counter(p for p, _, s in bm25_by_hand(every, passages) if s >= threshold)
        rows = decontaminate.decontaminate(few, items, ["doc_id"], threshold=threshold).collect()
        assert {r.doc_id: r.retrieved for r in rows if r.retrieved} == dict(wanted)


def test_leaks(spark, docs, items, odd, none):
    every = {r.item_id: r.text for r in items.collect()}
    clean = " ".join(f"clean{i}" for i in range(90))
    long_item = " ".join(f"term{i}" for i in range(300)) + ". The answer is here now."
    extra = [(900, long_item), (901, None), (902, "too short"), (None, "an item without any id but words enough. yes it has")]
    table = spark.createDataFrame([*every.items(), *extra, (900, long_item)], "item_id long, text string")
    question = long_item.split(". ")[0]
    texts = [clean, f"{clean} {every[0]} {clean}", every[1].upper(), f"{clean}\n{long_item}\n{clean} {every[2]}", question, extra[3][1]]
    rows = decontaminate.decontaminate(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table, ["doc_id"]
    )
    found = {r.doc_id: (r.contaminated, r.item_ids) for r in rows.collect()}
    # The question alone is no leak; an item without an id is one, but is not listed.
    assert found == {
        0: (False, []), 1: (True, [0]), 2: (True, [1]), 3: (True, [2, 900]), 4: (False, []), 5: (True, []),
    }
    rows = decontaminate.decontaminate(odd, table, ["doc_id", "contaminated"]).collect()
    assert len(rows) == odd.count() and not any(r.contaminated for r in rows)
    assert decontaminate.decontaminate(none, table, ["doc_id"]).count() == 0
    nothing = decontaminate.decontaminate(docs, items.limit(0), ["doc_id"])
    assert not nothing.filter("contaminated").count()


@pytest.mark.parametrize("segments", [1 << 14, 2])
def test_different_texts_with_one_id_are_all_verified(spark, monkeypatch, segments):
    monkeypatch.setattr(decontaminate, "PASS_SEGMENTS", segments)
    words = lambda kind: " ".join(f"{kind}{i}" for i in range(20)) + f". The answer is {kind} here now."
    pairs = [(7, "a"), (7, "b"), (None, "c"), (None, "d"), (-1, "e"), (-1, "f")]
    items = spark.createDataFrame([(i, words(k)) for i, k in pairs], "item_id long, text string")
    table = spark.createDataFrame([(k, words(k)) for _, k in pairs], "doc_id string, text string")
    rows = decontaminate.decontaminate(table, items, ["doc_id"]).collect()
    assert {r.doc_id: (r.contaminated, r.item_ids) for r in rows} == {
        k: (True, [] if i is None else [i]) for i, k in pairs
    }


def test_short_items_and_scripts_without_spaces(spark):
    prose = " ".join(f"clean{i}" for i in range(50))
    japanese = "日本の首都はどこですか。答えは東京です。"
    thai = "เมืองหลวงของประเทศไทยคือกรุงเทพมหานคร"
    items = [(1, "capital of France? Paris"), (2, japanese), (3, "Paris"), (4, "blue whale"), (5, thai), (6, " ?! "), (7, "one two three")]
    texts = [
        f"{prose} Capital of France: PARIS, {prose}", f"全く別の話です。{japanese}そして終わりです。", f"{prose} in Paris, {prose} a blue whale {prose}",
        f"{prose}\nParis.\n{prose}", f"{prose}\n Blue whale! \n{prose}", f"ก่อน {thai} หลัง", prose, "日本の首都は大きいです。東京の話をしましょう。", "capital of Paris",
        f"one two\nthree {prose}", f"one two {prose} three", "", None,
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.decontaminate(table, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    assert {r.doc_id: r.item_ids for r in found if r.contaminated} == {0: [1], 1: [2], 3: [3], 4: [4], 5: [5], 9: [7]}


def test_several_passes_find_the_same(spark, docs, items, monkeypatch):
    extra = spark.createDataFrame([(900, "of the"), (901, " ".join(f"term{i}" for i in range(300)))], items.schema)
    items = items.unionByName(extra)
    one = sorted(decontaminate.decontaminate(docs, items, ["doc_id"]).collect())
    with monkeypatch.context() as patch:
        patch.setattr(decontaminate, "PASS_BYTES", 200_000)
        rows = decontaminate.segments(items).collect()
        parts = list(decontaminate._broadcasts(rows, collections.defaultdict(lambda: 1.0), 40.0))
        assert len(parts) >= 3 and max(sum(s.bytes for s in shards) for shards, _ in parts) < 200_000
        assert sum(len({r.item for r in own}) for _, own in parts) == len({r.item for r in rows})
        assert sorted(decontaminate.decontaminate(docs, items, ["doc_id"]).collect()) == one
    monkeypatch.setattr(decontaminate, "PASS_SEGMENTS", 15)
    monkeypatch.setattr(decontaminate, "SHARD_SEGMENTS", 4)
    assert sorted(decontaminate.decontaminate(docs, items, ["doc_id"]).collect()) == one


def backoff_by_hand(texts, order):
    low = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    count = collections.Counter(tuple(t[i : i + k]) for t in low for k in range(1, order + 1) for i in range(len(t) - k + 1))
    total = sum(map(len, low))

    def log_s(gram):
        if len(gram) == 1:
            return math.log(count[gram] / total)
        return math.log(count[gram] / count[gram[:-1]]) if count[gram] >= 2 else math.log(0.4) + log_s(gram[1:])

    for t in low:
        yield len(t), sum(log_s(tuple(t[max(0, i - order + 1) : i + 1])) for i in range(len(t)))


@pytest.mark.parametrize("order", [1, 3, 4])
def test_backoff_of_any_order_equals_sql(spark, docs, order):
    few = docs.filter("doc_id % 5 = 0").select("doc_id", "text")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [tuple(r) for r in few.collect()])
    want = {r[0]: r[1:] for r in con.execute(backoff.oracle_sql(order)).fetchall()}
    got = {r.doc_id: r for r in backoff.score(few, ["doc_id"], order=order).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert r.n_words == want[i][0] and r.log_score == pytest.approx(want[i][1], abs=1e-5)


@pytest.mark.parametrize(("words", "order"), [(1 << 21, 2), (20_000, 3), (300, 2), (300, 3)])
def test_backoff(odd, none, docs, monkeypatch, words, order):
    """However many blocks and buckets there are, the scores are the same."""
    monkeypatch.setattr(backoff, "BLOCK_WORDS", words)
    monkeypatch.setattr(backoff, "BUCKET_WORDS", 3 * words)
    if words < 1000:
        docs = docs.limit(30)
    for table in (odd, docs):
        texts = [r.text for r in table.collect()]
        rows = backoff.score(table, ["doc_id", "text"], order=order).collect()
        wanted = sorted((t or "", n, round(s, 6)) for t, (n, s) in zip(texts, backoff_by_hand(texts, order), strict=True))
        found = sorted((r.text or "", r.n_words, r.log_score) for r in rows)
        assert [x[:2] for x in found] == [x[:2] for x in wanted]
        assert [x[2] for x in found] == pytest.approx([x[2] for x in wanted], abs=1e-5)
        assert all((r.mean_log_score is None) == (r.n_words == 0) for r in rows)
    assert backoff.score(none, ["doc_id"]).count() == 0
