"""The two models computed again in plain Python: their scores on small tables must be the same."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from dockledger.llm import common, language_mixture, quality_model

MASK = (1 << 64) - 1
SPACES = b" \t\n\v\f\r"


def mixed(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & MASK
    return h ^ (h >> 31)


def word_hash(word):
    total, power = 0, 1
    for byte in word:
        total, power = (total + (byte + 1) * power) & MASK, power * common._BASE & MASK
    return mixed(total ^ len(word))


def kind_of(byte):
    groups = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()", b"!?", b"#*$%&|<>@~^=_"]
    return next((1 << i for i, g in enumerate(groups) if byte in g), 128 if byte >= 128 else 64)


def grams(text):
    """Coordinate -> value of a text."""
    data = (text or "").encode()
    for c in SPACES:
        data = data.replace(bytes([c]), b" ")
    words = [w for w in data.split(b" ") if w]
    out = collections.Counter()
    before = one = two = 0
    for w in words:
        h, shape = word_hash(w), 0
        for byte in w:
            shape |= kind_of(byte)
        shape |= (kind_of(w[0]) == 2) << 8 | min(len(w) // 4, 7) << 9 | (h == before) << 12
        shape = mixed(shape + 1)
        for g in (
            mixed(h ^ 0x1F), mixed((mixed((before + 3) & MASK) + h + 0x2F) & MASK), mixed((mixed((one + 3) & MASK) + shape + 0x3F) & MASK),
            mixed((mixed((mixed((two + 5) & MASK) + one + 3) & MASK) + shape + 0x4F) & MASK),
        ):
            out[g >> (64 - quality_model.DIM_BITS)] += 1
        before, two, one = h, one, shape
    return {k: v * quality_model.SCALE / max(len(words), 1) for k, v in out.items()}


def margin(weights, values):
    return weights.get("bias", 0.0) + sum(weights.get(k, 0.0) * v for k, v in values.items())


def ftrl(rows):
    """Weights after the epochs over rows (values, label), by the update rule as it is published."""
    m = quality_model
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= m.L1:
            return 0.0
        return -(z[i] - math.copysign(m.L1, z[i])) / ((m.BETA + math.sqrt(n[i])) / m.ALPHA + m.L2)

    for _ in range(m.EPOCHS):
        for values, label in rows:
            values = {**values, "bias": 1.0}
            w = {i: weight(i) for i in values}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in values.items())))
            for i, v in values.items():
                g = (p - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / m.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_classifier_equals_plain_python(spark, docs, labels, odd):
    labelled = quality_model.labelled_sample(docs.filter("length(text) < 2500"), labels)
    weights = quality_model.fit(labelled)
    shards = labelled.repartition(quality_model.SHARDS, F.xxhash64("id")).withColumn("shard", F.spark_partition_id()).collect()
    assert len(shards) > 40 and len({r.shard for r in shards}) == quality_model.SHARDS
    mean = collections.Counter()
    for shard in range(quality_model.SHARDS):
        rows = [r for r in shards if r.shard == shard]
        rows.sort(key=lambda r: (r.id * 0x9E3779B97F4A7C15 & 0xFFFFFFFF, (r.text or "").encode(), r.label))
        for i, w in ftrl([(grams(r.text), r.label) for r in rows]).items():
            mean[i] += w / quality_model.SHARDS
    table = docs.select("doc_id", "text").filter("length(text) < 2500").unionByName(odd.select("doc_id", "text").filter("text is null or length(text) < 2500"))
    scored = quality_model.score(table.withColumn("key", F.monotonically_increasing_id()).withColumn("doc_id", F.col("key")), weights)
    texts = {r.key: r.text for r in table.withColumn("key", F.monotonically_increasing_id()).collect()}
    rows = scored.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = 1 / (1 + math.exp(-margin(mean, grams(texts[r.doc_id]))))
        assert r.score == pytest.approx(want, abs=2e-5)
        assert abs(want - 0.3) < 2e-5 or r.predicted == (want >= 0.3)


def trigram_counts(text):
    data = b" " + text.lower().encode() + b"  "
    data = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in data)
    out = collections.Counter()
    for a, b, c in zip(data, data[1:], data[2:]):
        if not (b == 32 and (a == 32 or c == 32)):
            out[((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language_mixture.BUCKET_BITS)] += 1
    return out


def climb(counts, like, share):
    """Proportions and the log-likelihood before the last step, by expectation-maximisation on one text."""
    m, total = language_mixture, sum(counts.values())
    for _ in range(m.MAX_ITERATIONS // m.ROUNDS):
        for _ in range(m.ROUNDS):
            last, likely, part = share, 0.0, [0.0] * len(share)
            for bucket, n in counts.items():
                terms = [s * x for s, x in zip(share, like[bucket])]
                whole = max(sum(terms), 1e-30)
                likely += n * math.log(whole)
                part = [p + n * t / whole for p, t in zip(part, terms)]
            share = [p / total for p in part]
        if max(abs(a - b) for a, b in zip(share, last)) <= m.SETTLED / m.ROUNDS:
            break
    return share, likely


def best_set(counts, like, kinds):
    m, total = language_mixture, sum(counts.values())
    share, gain = climb(counts, like, [1 / kinds] * kinds)
    order = sorted(range(kinds), key=lambda i: (-share[i], i))
    cost = m.PENALTY * math.log(max(total, 2))
    out = [float(i == order[0]) for i in range(kinds)]
    value = sum(n * math.log(max(like[b][order[0]], 1e-30)) for b, n in counts.items())
    if gain - value <= cost:
        return out
    for k in range(2, kinds + 1):
        found, likely = climb(counts, like, [1 / k if i in order[:k] else 0.0 for i in range(kinds)])
        if likely - (k - 1) * cost > value:
            out, value = found, likely - (k - 1) * cost
        if gain - k * cost <= value:
            break
    return out


def test_mixture_equals_plain_python(spark, docs, odd):
    training = language_mixture.training_rows(docs).filter("length(text) < 4000")
    langs, like = language_mixture.fit(training)
    counted = {lang: collections.Counter() for lang in langs}
    for r in training.collect():
        counted[r.lang].update(trigram_counts(r.text))
    own = {}
    for bucket in range(language_mixture.BUCKETS):
        own[bucket] = [c[bucket] + language_mixture.SMOOTHING for c in counted.values()]
    sums = [sum(row[i] for row in own.values()) for i in range(len(langs))]
    own = {b: [x / s for x, s in zip(row, sums)] for b, row in own.items()}
    assert max(abs(a - b) / b for bucket, row in own.items() for a, b in zip(like[bucket], row)) < 1e-5
    short = docs.filter("length(text) between 50 and 1200").select("text").limit(90).collect()
    texts = [r.text for r in short] + [short[i].text + "\n" + short[i + 1].text for i in range(40)]
    texts += [r.text for r in odd.select("text").collect() if len(r.text or "") < 1000] + ["a", "zz zz", "éé"]
    rows = language_mixture.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), langs, like).collect()
    several = 0
    for r in rows:
        text = texts[r.doc_id] or ""
        counts = trigram_counts(text)
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        share = best_set(counts, own, len(langs))
        assert r.score == pytest.approx(max(share), abs=2e-3)
        assert sorted(r.languages) == [lang for lang, s in zip(langs, share) if s > 0]
        assert r.lang_pred == langs[share.index(max(share))] or abs(sorted(share)[-1] - sorted(share)[-2]) < 2e-3
        several += len(r.languages) > 1
    assert several >= 10
