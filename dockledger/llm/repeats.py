"""Suffix-array dedup: removes every byte under a string of 200 bytes that also starts anywhere else.

Each 200-byte window chooses an anchor, the 112 bytes in it with the least hash, so equal windows choose equal anchors.
Neighbouring windows with one anchor form a record: its context is all their bytes. Records meet by the hash of their
anchor. A context whose 64-bit hash occurs twice is removed whole; one whose anchor occurs nowhere else has no repeats.

What is left are contexts that share an anchor and differ around it. Their windows choose again, anchors of 172 bytes,
and these finer records come with their bytes to one place by anchor. Equal ones are repeats. Unequal ones go to a
suffix array: the anchor becomes one symbol, and two windows are equal if they are next to each other in the array and
agree in 29 symbols.

Text crosses the network once, by document. An anchor that very many different contexts share is taken apart into its
windows, which are counted by hash like any other key, so no anchor fills a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.llm import common
from dockledger.llm.common import fresh, mix, pieces, stored
from dockledger.llm.gsaca import suffix_array

LENGTH, ANCHOR, CORE = 200, 112, 172
#: Symbols of a window in a suffix array, the core being one.
WINDOW = LENGTH - CORE + 1
#: Different contexts of an anchor up to which they are sorted.
CROWD = 4096
#: Symbols in a suffix array, about; a group is never cut.
ARRAY = 1 << 15
#: Bytes that are taken at once, so that the working arrays stay in the cache.
BLOCK = 1 << 18
FULL, OPEN, PARTNER, CROWDED = 1, 2, 4, 8
_LOW, _SCATTER = np.uint64(0xFFFFFFFF), np.uint64(0xBF58476D1CE4E5B9)


class Records:
    """The records of some texts for anchors of a length: each one's text, its first and last window, its anchor's place
    and its number in the text; hashes of the anchors and of the contexts. `wanted` marks the windows that take part.
    """

    def __init__(self, texts: list[bytes], anchor: int, wanted: np.ndarray | None = None):
        self.starts = np.cumsum([0, *map(len, texts)])
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        n, m, span = len(self.buf), len(self.buf) - anchor + 1, LENGTH - anchor + 1
        none = np.zeros(0, np.int64)
        self.text, self.low, self.high, self.at, self.number = none, none, none, none, none
        self.anchor, self.context = none.astype(np.uint64), none.astype(np.uint64)
        if m < span:
            return
        power, inverse = common._powers(1 << max(common.PIECE.bit_length() + 1, (n + 1).bit_length()))
        self.total, self.inverse = np.zeros(n + 1, np.uint64), inverse
        weighted = self.buf.astype(np.uint64)
        weighted += np.uint64(1)
        weighted *= power[:n]
        np.cumsum(weighted, out=self.total[1:])
        hashes = self.total[anchor:] - self.total[:-anchor]
        hashes *= inverse[:m]
        # Upper half: the hash, scattered; lower half: the place, so of equal hashes the first is the least.
        key = hashes * _SCATTER
        key &= ~_LOW
        key |= np.arange(m, dtype=np.uint64)
        # Minima of windows of twice the width each time, then of two that overlap.
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[: len(key) - width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        chosen = (key & _LOW).astype(np.int64)
        lengths = np.diff(self.starts)
        usable = np.maximum(lengths - LENGTH + 1, 0)  # windows of each text
        owner = np.repeat(np.arange(len(texts)), usable)
        windows = np.arange(len(owner)) + (self.starts[:-1] - np.cumsum(usable) + usable)[owner]
        if wanted is not None:
            keep = wanted[windows]
            windows, owner = windows[keep], owner[keep]
        if not len(windows):
            return
        chosen = chosen[windows]
        new = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1]) | (windows[1:] != windows[:-1] + 1)
        first = np.flatnonzero(np.concatenate([[True], new]))
        self.low, self.high = windows[first], windows[np.concatenate([first[1:] - 1, [len(windows) - 1]])]
        self.at, self.text = chosen[first], owner[first]
        self.anchor = mix(hashes[self.at])
        self.context = self.hash(self.low, self.high + LENGTH) ^ (self.at - self.low).astype(np.uint64)
        begin = np.searchsorted(self.text, np.arange(len(texts)))
        self.number = np.arange(len(self.text)) - begin[self.text]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(((self.total[end] - self.total[start]) * self.inverse[start]) ^ (end - start).astype(np.uint64))

    def of(self, packed: list[list[int] | None], code: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the records that have one of the bits of code, and their codes; packed: per text, number and code."""
        begin = np.searchsorted(self.text, np.arange(len(packed)))
        index = [(int(begin[i]) + (x >> 4), x & 15) for i, part in enumerate(packed) for x in part or () if x & code]
        return np.array([x[0] for x in index], np.int64), np.array([x[1] for x in index], np.int64)

    def cover(self, low: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Marks the places under any of the spans."""
        edge = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(edge, low, 1)
        np.add.at(edge, end, -1)
        return np.cumsum(edge[:-1]) > 0


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def repeated_windows(contexts: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """For each context (place of its core, bytes): whether each of its windows equals another window of the list."""
    number: dict[tuple[int, bytes], int] = {}
    which = [number.setdefault(c, len(number)) for c in contexts]
    often = np.bincount(which) > 1
    cores: dict[bytes, list[int]] = {}
    for i, (left, data) in enumerate(number):
        cores.setdefault(data[left : left + CORE], []).append(i)
    flags = [np.full(len(data) - LENGTH + 1, often[i]) for i, (_, data) in enumerate(number)]
    # Cores with several contexts, each context as symbols: bytes before, the core, bytes behind, an end.
    members = [(i, symbol) for symbol, group in enumerate(cores.values(), 257) if len(group) > 1 for i in group]
    if members:
        distinct, parts, valid = list(number), [], []
        for i, symbol in members:
            left, data = distinct[i]
            x = np.frombuffer(data, np.uint8).astype(np.int32) + 1
            parts += [x[:left], np.array([symbol], np.int32), x[left + CORE :], np.zeros(1, np.int32)]
            valid.append(np.arange(len(data) - CORE + 2) < len(flags[i]))
        found = _equal_neighbours(np.concatenate(parts), np.concatenate(valid))
        for (i, _), part in zip(members, np.split(found, np.cumsum([len(v) for v in valid])[:-1]), strict=True):
            flags[i] = flags[i] | part[: len(flags[i])]
    return [flags[i] for i in which]


def _equal_neighbours(text: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Marks the usable places whose window equals that of a neighbour in the suffix array."""
    order = suffix_array(text)
    order = order[usable[order]]
    windows = np.lib.stride_tricks.sliding_window_view(text, WINDOW)
    found = np.zeros(len(text), bool)
    for a in range(0, len(order) - 1, 1 << 14):
        one, two = order[a : a + (1 << 14)], order[a + 1 : a + 1 + (1 << 14)]
        one = one[: len(two)]
        equal = (windows[one] == windows[two]).all(axis=1)
        found[one[equal]] = True
        found[two[equal]] = True
    return found


def _known(docs: DataFrame, name: str, key: str) -> DataFrame:
    """(key, records): for each document the numbers of the records that need work, with what they need in the low bits."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch, name, BLOCK):
                r = Records(texts, ANCHOR)
                if not len(r.text):
                    continue
                keys = batch.column(key).slice(a, b - a).to_numpy()[r.text]
                _, first, count = np.unique(mix(r.anchor) + r.context, return_index=True, return_counts=True)
                columns = [_long(r.anchor[first]), _long(r.context[first]), pa.array(count), pa.array(keys[first])]
                yield pa.RecordBatch.from_arrays(columns, ["h", "c", "n", "one"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch, name, BLOCK):
                r = Records(texts, ANCHOR)
                keys = batch.column(key).slice(a, b - a).to_numpy()[r.text]
                columns = [_long(r.anchor), _long(r.context), pa.array(keys), pa.array(r.number.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "c", "key", "number"])

    source = docs.select(key, name)
    contexts = source.mapInArrow(gather, "h long, c long, n long, one long").repartition("h")
    contexts = contexts.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    anchors = contexts.groupBy("h").agg(F.count("*").alias("d"), F.min("n").alias("least"))
    needs = contexts.join(anchors, "h").filter((F.col("n") > 1) | (F.col("d") > 1))
    partner = (F.col("n") > 1) & (F.col("least") == 1)
    code = (
        F.when(F.col("n") > 1, FULL).otherwise(OPEN)
        + F.when(partner, PARTNER).otherwise(0)
        + F.when(F.col("d") > CROWD, CROWDED).otherwise(0)
    )
    needs = needs.select("h", "c", "one", code.alias("code"))
    found = source.mapInArrow(each, "h long, c long, key long, number int").join(needs, ["h", "c"])
    # Of equal contexts one document stands for all as a partner.
    own = F.when(F.col("key") == F.col("one"), F.col("code")).otherwise(F.col("code").bitwiseAND(~PARTNER))
    packed = F.shiftleft(F.col("number").cast("long"), 4) + own
    return stored(found.groupBy("key").agg(F.collect_set(packed).alias("records")), "repeat-records")


def _batches_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows that come sorted by h, whole groups together, in lists of about ARRAY symbols."""
    held: list[dict] = []
    size, rows = 0, (row for batch in batches for row in batch.to_pylist())
    for _, group in itertools.groupby(rows, key=lambda row: row["h"]):
        part = list(group)
        held += part
        size += sum(len(r["data"]) - CORE + 2 for r in part)
        if size >= ARRAY:
            yield held
            held, size = [], 0
    if held:
        yield held


def dedup_repeats(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The columns `carry` of docs, then kept (binary), n_bytes, n_removed and n_spans, a row for each row.

    A null text has no bytes; texts of under 200 bytes stay whole. Strings are judged on the input. Matches stay within
    a document's row; rows with equal doc_id and text are two documents, so they lose all they have if long enough.
    Texts are whole: a task holds one text at a time, or some that are short.
    """
    name, key = fresh(docs, "repeat_text"), fresh(docs, "repeat_key")
    own = ["kept", "n_bytes", "n_removed", "n_spans"]
    carry = [c for c in carry if c.lower() not in own]
    value = docs[text].cast("string")
    base = docs.select(*(docs[c] for c in carry), F.xxhash64("doc_id", value).alias(key), value.alias(name))
    records = _known(base, name, key)

    def emit(batches: Iterator[pa.RecordBatch], crowded: bool) -> Iterator[pa.RecordBatch]:
        """Finer records with their bytes, or the windows of crowded anchors: (h, key, place, core, data)."""
        for batch in batches:
            for a, b, texts in pieces(batch, name, BLOCK):
                r, known = Records(texts, ANCHOR), batch.column("records").slice(a, b - a).to_pylist()
                keys = batch.column(key).slice(a, b - a).to_numpy()
                index, codes = r.of(known, OPEN | PARTNER)
                index = index[(codes & CROWDED != 0) == crowded]
                wanted = r.cover(r.low[index], r.high[index] + 1)
                if crowded:
                    at = np.flatnonzero(wanted)
                    of = np.searchsorted(r.starts, at, "right") - 1
                    yield _emitted(r.hash(at, at + LENGTH), keys[of], at - r.starts[of], at * 0, [b""] * len(at))
                else:
                    fine = Records(texts, CORE, wanted)
                    low, end = fine.low.tolist(), (fine.high + LENGTH).tolist()
                    whole = r.buf.tobytes()
                    data = [whole[x:y] for x, y in zip(low, end, strict=True)]
                    yield _emitted(fine.anchor, keys[fine.text], fine.low - r.starts[fine.text], fine.at - fine.low, data)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches_of_groups(batches):
            flags = repeated_windows([(r["core"], r["data"]) for r in rows])
            hit = [(r["key"], r["place"] + np.flatnonzero(f)) for r, f in zip(rows, flags, strict=True) if f.any()]
            columns = [pa.array([x[0] for x in hit], pa.int64()), pa.array([x[1] for x in hit], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "places"])

    schema = "h long, key long, place long, core long, data binary"
    work = base.join(records, base[key] == records["key"]).drop("key").filter(
        F.exists("records", lambda x: x.bitwiseAND(OPEN | PARTNER) != 0)
    )
    contexts = work.mapInArrow(lambda batches: emit(batches, False), schema)
    sorted_ = contexts.repartition("h").sortWithinPartitions("h")
    parts = sorted_.mapInArrow(judge, "key long, places array<long>").withColumn("place", F.explode("places")).drop("places")
    if not records.filter(F.exists("records", lambda x: x.bitwiseAND(CROWDED) != 0)).isEmpty():
        crowd = work.mapInArrow(lambda batches: emit(batches, True), schema).select("h", "key", "place")
        again = crowd.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
        parts = parts.unionByName(crowd.join(again, "h").drop("h"))
    parts = parts.groupBy("key").agg(F.collect_set("place").alias("places"))
    full = base.join(records, base[key] == records["key"], "left").drop("key")
    full = full.join(parts, full[key] == parts["key"], "left").drop("key")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch, name, BLOCK):
                part = batch.slice(a, b - a)
                known, places = (part.column(part.schema.names.index(c)).to_pylist() for c in ("records", "places"))
                touched = [i for i, x in enumerate(known) if x]
                r = Records([texts[i] for i in touched], ANCHOR)
                index, _ = r.of([known[i] for i in touched], FULL)
                single = [np.asarray(places[i] or [], np.int64) + r.starts[k] for k, i in enumerate(touched)]
                single = np.concatenate([np.zeros(0, np.int64), *single])
                low, end = np.concatenate([r.low[index], single]), np.concatenate([r.high[index], single]) + LENGTH
                gone = r.cover(low, end)
                result = [(t, len(t), 0, 0) for t in texts]
                for k, i in enumerate(touched):
                    mark = gone[r.starts[k] : r.starts[k + 1]]
                    spans = int((mark[1:] & ~mark[:-1]).sum() + mark[:1].sum())
                    kept = r.buf[r.starts[k] : r.starts[k + 1]][~mark].tobytes()
                    result[i] = (kept, len(mark), int(mark.sum()), spans)
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array([x[i] for x in result], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(carry))), *columns], [*carry, *own])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return full.mapInArrow(remove, f"{kinds}, kept binary, n_bytes long, n_removed long, n_spans long")


def _emitted(h: np.ndarray, keys: np.ndarray, place: np.ndarray, core: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
    columns = [_long(h), pa.array(keys, pa.int64()), pa.array(place, pa.int64()), pa.array(core, pa.int64()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["h", "key", "place", "core", "data"])
