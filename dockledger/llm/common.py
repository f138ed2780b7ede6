"""Helpers shared by the text operators: stored intermediate tables and word hashing on bytes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.functions.storage import shared_folder as scratch  # noqa: F401
from dockledger.functions.storage import stored  # noqa: F401

#: A word is a run of characters other than space, tab, newline, vertical tab, form feed and return.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once; every working array is a small multiple of it.
PIECE = 1 << 21


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE):
    """(first row, one past the last, their texts as bytes) so that each piece holds about `size` bytes."""
    texts = batch.column(column).cast(pa.binary())
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield start, i, [x or b"" for x in texts.slice(start, i - start).to_pylist()]
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths), [x or b"" for x in texts.slice(start).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one byte array, a space after each, and where each text starts; one entry more for the end."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), starts


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in bytes."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; only the last table is kept."""

    def table(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    if n not in _TABLES:
        _TABLES.clear()
        _TABLES[n] = table(_BASE), table(pow(_BASE, -1, 1 << 64))
    return _TABLES[n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes have equal hashes, wherever they are.

    Spans must be sorted and not empty. A prefix sum of byte times power gives any span's polynomial; the inverse
    power moves it to position zero. Long input is taken in pieces, so the tables stay small.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(int(np.searchsorted(ends, base + PIECE, "right")), i + 1)
        stop = int(ends[i:j].max())
        n = stop - base
        power, inverse = _powers(1 << max(PIECE.bit_length() - 1, (n + 1).bit_length()))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((buf[base:stop].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix(((total[e] - total[s]) * inverse[s]) ^ (e - s).astype(np.uint64))
        i = j
    return out


def per_row(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """How many of the sorted positions fall in each text that joined() laid out."""
    return np.diff(np.searchsorted(positions, starts))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null; the keys of the left side are kept."""
    renamed = right.select(*(F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = functools.reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys))
    return left.join(renamed, on, how).drop(*(f"__r_{k}" for k in keys))
