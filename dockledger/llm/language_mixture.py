"""Language identification: each text is a mixture of languages, its proportions found by expectation-maximisation.

A language is a distribution over hashed byte trigrams of lower-cased text. The proportions that make a text's
trigrams most likely are found for all languages together; then fewer languages are tried, and the set with the best
likelihood less a penalty for each further language is kept. The prediction is the largest proportion in that set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.llm.common import fresh, pieces

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Most documents of a language that training reads; a uniform sample by the hash of doc_id if there are more.
TRAIN_ROWS = 4000
SMOOTHING = 0.05
#: Units of log(number of trigrams) that a further language must gain; trigrams overlap, so more than a half.
PENALTY = 3.0
ROUNDS, MAX_ITERATIONS, SETTLED = 4, 24, 0.02
UNKNOWN = "und"
#: Texts are taken in pieces of so many bytes for each language of the model, so working arrays keep their size.
PIECE_BYTES = 4 << 20

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[i for i in range(128) if not chr(i).isalpha()]] = 0x20
_TABLE = bytes(_LETTERS)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, bucket, count), sorted by text; digits, marks and white space count as one kind of gap."""
    parts = [b" " + t.lower().encode("utf-8", "replace").translate(_TABLE) + b"  " for t in texts]
    starts = np.cumsum([0, *map(len, parts)])
    buf = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (buf[:-2] << np.uint32(16)) | (buf[1:-1] << np.uint32(8)) | buf[2:]
    gap = buf == 0x20
    use = ~(gap[1:-1] & (gap[:-2] | gap[2:]))
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))[:-2]
    use &= np.repeat(starts[1:], np.diff(starts))[:-2] > np.arange(len(code)) + 2  # within one text
    bucket = (code[use] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    key, count = np.unique((owner[use] << BUCKET_BITS) | bucket, return_counts=True)
    return key >> BUCKET_BITS, key & (BUCKETS - 1), count


def training_rows(docs: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(lang, text) of documents with a language that are not held out, at most about `most` of each language."""
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = usable.filter("lang is not null and text is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    shares = [(r.lang, min(1.0, most / r["count"])) for r in usable.groupBy("lang").count().collect()]
    table = docs.sparkSession.createDataFrame([(k, int(v * (1 << 30))) for k, v in shares], "lang string, below long")
    chosen = usable.join(F.broadcast(table), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("below"))
    return chosen.select("lang", "text")


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in order, and for each bucket the likelihood of it in each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, texts in pieces(batch, "text"):
                owner, bucket, n = trigrams([t.decode("utf-8", "replace") for t in texts])
                own = np.array(langs[a:b], object)[owner] if len(owner) else np.zeros(0, object)
                for lang in set(langs[a:b]):
                    at = own == lang
                    held = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    held += np.bincount(bucket[at], n[at], BUCKETS).astype(np.int64)
        for lang, held in totals.items():
            used = np.flatnonzero(held)
            columns = [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(held[used])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most 2**16 rows a language
    langs = sorted(set(table["lang"].to_pylist()))
    out = np.full((BUCKETS, len(langs)), SMOOTHING)
    place = {lang: i for i, lang in enumerate(langs)}
    column = np.array([place[x] for x in table["lang"].to_pylist()], np.int64)
    np.add.at(out, (table["bucket"].to_numpy(), column), table["n"].to_numpy())
    return langs, (out / out.sum(axis=0, keepdims=True)).astype(np.float32)


class Mixture:
    """The trigrams of some texts with their likelihoods; proportions for all these texts at once."""

    def __init__(self, owner: np.ndarray, like: np.ndarray, count: np.ndarray):
        self.texts, first, self.length = np.unique(owner, return_index=True, return_counts=True)
        self.first, self.like, self.count = first, like, count.astype(np.float32)
        self.total = np.add.reduceat(self.count, first) if len(first) else np.zeros(0, np.float32)

    def spread(self, per_text: np.ndarray) -> np.ndarray:
        return np.repeat(per_text, self.length, axis=0)

    def only(self, keep: np.ndarray) -> Mixture:
        rows = self.spread(keep)
        return Mixture(self.spread(self.texts)[rows], self.like[rows], self.count[rows])

    def step(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next proportions, and the log-likelihood of the given ones."""
        part = self.spread(share) * self.like
        whole = np.maximum(part.sum(axis=1), np.float32(1e-30))
        part *= (self.count / whole)[:, None]
        gain = np.add.reduceat(self.count * np.log(whole), self.first)
        return np.add.reduceat(part, self.first, axis=0) / self.total[:, None], gain

    def solve(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihoods after expectation-maximisation; a text that no longer moves leaves early."""
        out, gain = share.copy(), np.zeros(len(share))
        open_, here = np.arange(len(share)), self
        for i in range(0, MAX_ITERATIONS, ROUNDS):
            now = out[open_]
            for _ in range(ROUNDS):
                last = now
                now, likely = here.step(now)
            out[open_], gain[open_] = now, likely
            moving = np.abs(now - last).max(axis=1) > SETTLED / ROUNDS
            if not moving.any() or i + ROUNDS >= MAX_ITERATIONS:
                break
            here, open_ = here.only(moving), open_[moving]
        return out, gain

    def best(self) -> np.ndarray:
        """Proportions under the language set with the best penalised likelihood, for each text."""
        kinds = self.like.shape[1]
        share, gain = self.solve(np.full((len(self.texts), kinds), 1 / kinds, np.float32))
        order = np.argsort(-share, axis=1, kind="stable")
        cost = PENALTY * np.log(np.maximum(self.total, 2))
        single = np.zeros_like(share)
        np.put_along_axis(single, order[:, :1], 1.0, axis=1)
        _, alone = self.step(single)
        # All languages together gain the most; where that does not pay for one further language, none does.
        out, value = single, alone.astype(np.float64)
        rest = np.flatnonzero(gain - alone > cost)
        here = self.only(np.isin(np.arange(len(self.texts)), rest))
        for k in range(2, kinds + 1):
            if not len(rest):
                break
            start = np.zeros((len(rest), kinds), np.float32)
            np.put_along_axis(start, order[rest][:, :k], np.float32(1 / k), axis=1)
            found, likely = here.solve(start)
            net = likely - (k - 1) * cost[rest]
            better = net > value[rest]
            out[rest[better]], value[rest[better]] = found[better], net[better]
            going = gain[rest] - k * cost[rest] > value[rest]  # a larger set may still win
            here, rest = here.only(going), rest[going]
        return out


def proportions(texts: list[str], like: np.ndarray) -> np.ndarray:
    """Proportions of the languages for each text; all zero for a text without a trigram."""
    out = np.zeros((len(texts), like.shape[1]), np.float32)
    owner, bucket, count = trigrams(texts)
    if len(owner) and like.shape[1]:
        mixture = Mixture(owner, like[bucket], count)
        out[mixture.texts] = mixture.best()
    return out


def identify(docs: DataFrame, langs: list[str], like: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and the languages of the chosen set, for each row of docs.

    A null text, or one without a letter, is `und` with score 0, as is every text if no language was learned. Ties go
    to the language that sorts first. A null doc_id is not held out. Columns of docs are neither kept nor read.
    """
    name = fresh(docs, "language_text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    source = docs.select("doc_id", held_out.alias("held_out"), docs[text].cast("string").alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(like)  # 2**16 rows a language

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            for a, b, raw in pieces(batch, name, PIECE_BYTES // max(len(langs), 1)):
                texts = [t.decode("utf-8", "replace") for t in raw]
                share = proportions(texts, shared.value)
                known = np.array([has_letter(t) for t in texts]) & (share.sum(axis=1) > 0)
                top = np.where(known, share.argmax(axis=1) if len(langs) else 0, len(langs))
                score = np.where(known, share.max(axis=1, initial=0.0), 0.0).astype(np.float64).clip(0, 1)
                sets = [[langs[j] for j in np.flatnonzero(s > 0)] if k else [] for s, k in zip(share, known, strict=True)]
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                           pa.array(list(names[top]), pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "languages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        apply, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<string>"
    )
