"""Stupid-backoff scores of documents under the n-gram counts of the corpus itself, computed by joins.

log S(c | ab) is log(n(abc) / n(ab)) for an n-gram seen at least twice, else log alpha + log S(c | b); of a single word
it is log(n(c) / N). A word's context has as many words of its text as the order allows. Documents are dealt over blocks
of about two million words. A block sends each of its different n-grams once, with its count, to the hash bucket of the
n-gram. A bucket adds up the counts of all blocks and answers each block with the totals in the order it asked, so answers
need no keys. The block joins them to its n-grams and sums for each document. An n-gram that is everywhere arrives once
from each block, so no key is heavy, and no document's sum travels. Text crosses the network once, by block. A block and a
bucket exchange a message if they share an n-gram, so there are at most as many messages as different n-grams of blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.llm.common import WORD, fresh, joined, mix, span_hashes, word_spans

ALPHA, MIN_COUNT = 0.4, 2
#: Words of the longest n-grams.
ORDER = 2
#: Mean words of a block, and of what arrives in a bucket.
BLOCK_WORDS, BUCKET_WORDS = 1 << 21, 1 << 22
_RESULT = {"n_words": pa.int64(), "log_score": pa.float64(), "mean_log_score": pa.float64()}


class Block:
    """The n-grams of some texts: the distinct ones with counts, and which one ends at each word, by their length."""

    def __init__(self, texts: list[bytes], buckets: int, order: int):
        buf, starts = joined([t.lower() for t in texts])  # of bytes: A-Z only
        begin, end = word_spans(buf)
        self.at = np.searchsorted(begin, starts)
        self.order = order
        words = span_hashes(buf, begin, end)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.at))
        self.before = np.minimum(np.arange(len(words)) - self.at[self.owner], order - 1)  # words of context
        keys, last = [words], words
        for k in range(1, order):
            ends = np.flatnonzero(self.before >= k)
            made = np.zeros(len(words), np.uint64)
            made[ends] = mix(mix(last[ends - 1] + np.uint64(0x50 + k)) + words[ends])
            keys.append(made[ends])
            last = made
        self.grams, index, self.counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        self.index = np.split(index, np.cumsum([len(x) for x in keys])[:-1])
        # A bucket is a range of hashes, so its n-grams lie next to each other.
        bucket = ((self.grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        self.buckets, first = np.unique(bucket, return_index=True)
        self.parts = [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)])]

    def scores(self, totals: np.ndarray, all_words: int) -> np.ndarray:
        """The sum for each text, from the total count of each distinct n-gram."""
        n = totals[self.index[0]].astype(np.float64)
        value = np.log(n / all_words) + self.before * np.log(ALPHA) if len(n) else n
        for k in range(1, self.order):
            ends = np.flatnonzero(self.before >= k)
            own = np.zeros(len(value))
            own[ends] = totals[self.index[k]]
            seen = ends[own[ends] >= MIN_COUNT]
            value[seen] = np.log(own[seen] / n[seen - 1]) + (self.before[seen] - k) * np.log(ALPHA)
            n = own
        return np.bincount(self.owner, value, len(self.at) - 1).astype(np.float64)


def packed(grams: np.ndarray) -> bytes:
    """Ascending hashes as their differences, all first bytes, then all second ones: the last are zeros, which compress."""
    steps = np.diff(grams, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8")[:, 0]
    return np.cumsum(steps, dtype=np.uint64)


def _texts(table: pa.Table, column: str) -> list[bytes]:
    return [t or b"" for t in table.column(column).cast(pa.binary()).to_pylist()]


def ask(table: pa.Table, column: str, block: str, buckets: int, order: int) -> pa.Table:
    """The n-grams of a block as one row a bucket."""
    own = Block(_texts(table, column), buckets, order)
    number = table.column(block)[0].as_py()
    rows = [
        (int(b), number, packed(own.grams[part]), zlib.compress(own.counts[part].astype(np.uint32).tobytes(), 1))
        for b, part in zip(own.buckets, own.parts, strict=True)
    ]
    kinds = {"bucket": pa.int32(), "block": pa.int32(), "grams": pa.binary(), "counts": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds.items())})


def answer(table: pa.Table) -> pa.Table:
    """For each row of a bucket the total counts of its n-grams, in their order."""
    grams = np.concatenate([unpacked(x.as_py()) for x in table.column("grams")])
    counts = [np.frombuffer(zlib.decompress(x.as_py()), np.uint32) for x in table.column("counts")]
    ends = np.cumsum([len(c) for c in counts])
    distinct, index = np.unique(grams, return_inverse=True)
    sums = np.bincount(index, np.concatenate(counts), len(distinct)).astype(np.uint64)  # exact up to 2**53
    replies = [zlib.compress(x.tobytes(), 1) for x in np.split(sums[index], ends[:-1])]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "totals": pa.array(replies, pa.binary())})


def score_block(docs: pa.Table, replies: pa.Table, column: str, keep: list[str], buckets: int, all_words: int, order: int) -> pa.Table:
    own = Block(_texts(docs, column), buckets, order)
    totals = np.zeros(len(own.grams), np.uint64)
    found = dict(zip(replies.column("bucket").to_pylist(), replies.column("totals"), strict=True))
    for bucket, part in zip(own.buckets.tolist(), own.parts, strict=True):
        totals[part] = np.frombuffer(zlib.decompress(found.pop(bucket).as_py()), np.uint64)
    n, sums = np.diff(own.at), own.scores(totals, all_words)
    mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
    return pa.table([*(docs.column(c) for c in keep), pa.array(n), pa.array(sums), mean], names=[*keep, *_RESULT])


def score(docs: DataFrame, keep: list[str], text: str = "text", order: int = ORDER) -> DataFrame:
    """The columns `keep` of docs, then n_words, log_score (sum over the words) and mean_log_score, a row for each row.

    Words are lower-cased in A-Z. Every word of every row counts, repeated rows as often as they occur; rows with equal
    texts get equal scores. A null, empty or blank text has no words, log_score 0 and a null mean. The counts include the
    document itself, so a word is never unknown. Columns of keep with the name of a result column are replaced.
    """
    name, block, kept = fresh(docs, "backoff_text"), fresh(docs, "backoff_block"), [c for c in keep if c.lower() not in _RESULT]
    value = docs[text].cast("string")
    all_words = docs.select(F.sum(F.regexp_count(value, F.lit(WORD)).cast("long"))).first()[0] or 0
    blocks, buckets = max(1, -(-all_words // BLOCK_WORDS)), max(1, -(-all_words // BUCKET_WORDS))
    # The row number keeps repeated rows from meeting in one block.
    dealt = F.pmod(F.xxhash64(value, F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    base = docs.select(*(docs[c] for c in kept), value.alias(name), dealt.alias(block))
    asked = base.groupBy(block).applyInArrow(
        lambda table: ask(table, name, block, buckets, order), "bucket int, block int, grams binary, counts binary"
    )
    replies = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, totals binary")
    schema = T.StructType([docs.schema[c] for c in kept] + [
        T.StructField(c, T.LongType() if k == pa.int64() else T.DoubleType()) for c, k in _RESULT.items()
    ])
    return base.groupBy(block).cogroup(replies.groupBy("block")).applyInArrow(
        lambda left, right: score_block(left, right, name, kept, buckets, all_words, order), schema
    )


def oracle_sql(order: int = ORDER) -> str:
    """The same in DuckDB SQL; w0 is a word, w1 the one before it, and so on."""
    ids = range(order)
    grams = lambda k: ", ".join(f"w{i}" for i in range(k + 1))
    counts = ", ".join(
        f"n{k} AS (SELECT {grams(k)}, count(*) AS n FROM words WHERE w{k} IS NOT NULL GROUP BY {grams(k)})" for k in ids
    )
    joins = "".join(
        f" LEFT JOIN n{k} ON n{k}.n >= {MIN_COUNT} AND " + " AND ".join(f"words.w{i} = n{k}.w{i}" for i in range(k + 1))
        + f" LEFT JOIN n{k - 1} c{k} ON " + " AND ".join(f"words.w{i + 1} = c{k}.w{i}" for i in range(k))
        for k in ids if k
    )
    context = " + ".join(["0", *(f"CASE WHEN words.w{k} IS NULL THEN 0 ELSE 1 END" for k in ids if k)])
    cases = " ".join(f"WHEN n{k}.n IS NOT NULL THEN ln(n{k}.n / c{k}.n) + ({context} - {k}) * ln({ALPHA})" for k in reversed(ids) if k)
    alone = f"ln(n0.n / total.n) + ({context}) * ln({ALPHA})"
    return rf"""
WITH taken AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS t
  FROM documents
), words AS (
  SELECT doc_id, {", ".join(f"unnest(list_concat([NULL::VARCHAR FOR x IN range({k})], t[1:greatest(len(t) - {k}, 0)])[1:len(t)]) AS w{k}" if k else "unnest(t) AS w0" for k in ids)}
  FROM taken WHERE len(t) > 0
), {counts}, total AS (
  SELECT count(*) AS n FROM words
), scored AS (
  SELECT doc_id, {f"CASE {cases} ELSE {alone} END" if cases else alone} AS s
  FROM words CROSS JOIN total JOIN n0 ON words.w0 = n0.w0{joins}
), summed AS (
  SELECT doc_id, count(*) AS n_words, sum(s) AS s FROM scored GROUP BY doc_id
)
SELECT documents.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words,
  round(coalesce(s, 0.0), 6) AS log_score, round(s / n_words, 6) AS mean_log_score
FROM documents LEFT JOIN summed USING (doc_id)
"""
