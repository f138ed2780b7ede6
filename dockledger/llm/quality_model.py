"""Quality classifier: logistic regression on hashed n-grams of words, trained by FTRL-proximal, scored by sparse sums.

An n-gram is hashed into one of 2**18 coordinates; its value is its count over the number of words. Besides the words
themselves, n-grams of word shapes are hashed (which kinds of characters a word has, its length, whether it repeats
the word before), so unseen words still say something. The training rows are a bounded sample of the labelled ones;
shards of it are trained side by side and their weights averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.llm.common import fresh, joined, mix, pieces, span_hashes, word_spans

DIM_BITS = 18
DIM = 1 << DIM_BITS
#: Most labelled rows that training reads; a uniform sample by the hash of doc_id if there are more.
TRAIN_ROWS = 24_000
SHARDS, EPOCHS = 4, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
#: Value of an n-gram that every word starts.
SCALE = 8.0

_KIND = np.full(256, 64, np.uint8)
for _bit, _chars in enumerate([
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()", b"!?", b"#*$%&|<>@~^=_",
]):
    _KIND[list(_chars)] = 1 << _bit
_KIND[128:] = 128
_KIND[[0x20, *range(0x09, 0x0E)]] = 0


def features(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Coordinates, one array for each kind of n-gram with an entry for each word, and where each text's words start.

    The entry of an n-gram is at its last word; at the first words of a text, shorter n-grams stand in.
    """
    buf, starts = joined(texts)
    begin, end = word_spans(buf)
    at = np.searchsorted(begin, starts)
    if not len(begin):
        return [], at
    words = span_hashes(buf, begin, end)
    kinds = _KIND[buf]
    shape = np.bitwise_or.reduceat(kinds, begin).astype(np.uint64)
    shape |= (kinds[begin].astype(np.uint64) == 2).astype(np.uint64) << np.uint64(8)
    shape |= np.minimum((end - begin) // 4, 7).astype(np.uint64) << np.uint64(9)
    before = np.concatenate([words[:1] * 0, words[:-1]])
    firsts = at[:-1][at[:-1] < at[1:]]
    before[firsts] = 0
    shape |= (words == before).astype(np.uint64) << np.uint64(12)
    shape = mix(shape + np.uint64(1))
    one = np.concatenate([shape[:1] * 0, shape[:-1]])
    one[firsts] = 0
    two = np.concatenate([one[:1] * 0, one[:-1]])
    two[firsts] = 0
    k = [np.uint64(x) for x in (0x1F, 0x2F, 0x3F, 0x4F, 3, 5)]
    grams = [
        mix(words ^ k[0]),
        mix(mix(before + k[4]) + words + k[1]),
        mix(mix(one + k[4]) + shape + k[2]),
        mix(mix(mix(two + k[5]) + one + k[4]) + shape + k[3]),
    ]
    return [(g >> np.uint64(64 - DIM_BITS)).astype(np.int32) for g in grams], at


def train_shard(rows: list[tuple[bytes, int]]) -> np.ndarray:
    """Weights after FTRL-proximal over the rows in the given order; the last coordinate is the intercept."""
    data = []
    for a in range(0, len(rows), 256):
        part = rows[a : a + 256]
        grams, at = features([t for t, _ in part])
        for i, (_, label) in enumerate(part):
            n = int(at[i + 1] - at[i])
            index, count = np.unique(
                np.concatenate([g[at[i] : at[i + 1]] for g in grams] or [np.zeros(0, np.int32)]), return_counts=True
            )
            value = np.concatenate([count * (SCALE / max(n, 1)), [1.0]])
            data.append((np.concatenate([index, [DIM]]).astype(np.int32), value.astype(np.float32), float(label)))
    z, n2 = np.zeros(DIM + 1), np.zeros(DIM + 1)
    weight = lambda i: np.where(
        np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n2[i])) / ALPHA + L2)
    )
    for _ in range(EPOCHS):
        for index, value, label in data:
            w = weight(index)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            root = np.sqrt(n2[index])
            n2[index] += g * g
            z[index] += g - (np.sqrt(n2[index]) - root) / ALPHA * w
    return weight(np.arange(DIM + 1))


def fit(labelled: DataFrame) -> np.ndarray:
    """Average weights of the shards of labelled: (id, text, label). Rows that are equal are used as often as they occur."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        rows.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 & 0xFFFFFFFF, r[1] or b"", r[2]))  # an order free of tasks
        if rows:
            w = train_shard([(t or b"", y) for _, t, y in rows])
            used = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w[used])], ["coordinate", "w"])

    shards = labelled.select(F.col("id"), F.col("text").cast("binary"), "label").repartition(SHARDS, F.xxhash64("id"))
    found = shards.mapInArrow(train, "coordinate long, w double")
    found = found.groupBy("coordinate").agg((F.sum("w") / SHARDS).alias("w")).toArrow()  # at most 2**18 rows
    out = np.zeros(DIM + 1, np.float32)
    out[found["coordinate"].to_numpy()] = found["w"].to_numpy()
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(id, text, label) of documents that are labelled and not held out.

    A document with several labels has the lowest. The sampled labels have a bounded number, so they are broadcast and
    the documents are not shuffled.
    """
    usable = (F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("quality").isin(0, 1)
    usable = labels.filter(usable).groupBy("doc_id").agg(F.min("quality").alias("label"))
    share = min(1.0, most / max(usable.count(), 1))
    sample = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = sample.select(F.col("doc_id").cast("long").alias("id"), "label")
    return docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select(
        "id", F.col("text").cast("string").alias("text"), "label"
    )


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs, from the text alone.

    Null and empty texts have no n-gram and get the intercept's score. A null doc_id is not held out. Without labelled
    rows all weights are 0 and every score is 0.5.
    """
    name = fresh(docs, "model_text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    source = docs.select("doc_id", held_out.alias("held_out"), docs[text].cast("string").alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for a, b, texts in pieces(batch, name):
                grams, at = features(texts)
                total = np.zeros(int(at[-1]) + 1)
                if grams:
                    np.cumsum(sum(w[g].astype(np.float64) for g in grams), out=total[1:])
                n = np.diff(at)
                margin = w[DIM] + (total[at[1:]] - total[at[:-1]]) * SCALE / np.maximum(n, 1)
                p = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(p),
                           pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double, predicted int")
