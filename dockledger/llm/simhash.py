"""Near-duplicates by SimHash: fingerprints, an anchor-point covering to find near pairs, and their components.

Two fingerprints with at most d differing bits have a half of 31 bits in which at most d // 2 differ. The anchors of a
half are the words of the [31, 26] Hamming code: every value is within one bit of a word (covering radius 1). A
fingerprint goes to all anchors within 1 + d // 2 bits of each half, so the anchor next to one of two near values also
holds the other. Bits are compared only among the fingerprints of an anchor. The two bits outside the halves take no
part in the search; the comparison is of all 64.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.llm.common import fresh, joined, pieces, stored, word_spans

BITS, SEED = 64, 42
_HALF = 31
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16
#: From this many fingerprints at an anchor, near ones are looked up instead of compared one by one.
_LOOKUP = 4096
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        part = hashes[i : i + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_ = 2 * counts > len(hashes)
    return int(np.packbits(set_, bitorder="little").view("<u8")[0])


def fingerprints(texts: list[bytes], length: int) -> list[int]:
    """One fingerprint for each text, over its shingles of `length` words joined by spaces, repeats included."""
    buf, starts = joined([t.translate(_UPPER) for t in texts])
    begin, end = word_spans(buf)
    at = np.searchsorted(begin, starts)
    # The words in order with one space between them; a shingle is a slice of it.
    sizes = end - begin
    plain = bytes(buf)
    if len(begin) and bool(((begin[1:] - end[:-1]) == 1).all()) and bool((buf[end] == 0x20).all()):
        words, first, last = plain, begin, end
    else:
        words = b" ".join(plain[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True))
        last = np.cumsum(sizes + 1) - 1
        first = last - sizes
    digest = xxhash.xxh64_intdigest
    out = []
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if a == b:
            out.append(0)
            continue
        step = min(length, b - a)
        s, e = first[a : b - step + 1].tolist(), last[a + step - 1 : b].tolist()
        hashes = np.fromiter((digest(words[x:y], SEED) for x, y in zip(s, e, strict=True)), np.uint64, len(s))
        out.append(fingerprint(hashes))
    return out


def with_fingerprint(docs: DataFrame, column: str, carry: list[str], text: str = "text", length: int = 3) -> DataFrame:
    """The columns `carry` of docs and the fingerprint as a signed 64-bit number."""
    name = fresh(docs, "simhash_text")
    source = docs.select(*(docs[c] for c in carry), docs[text].cast("string").alias(name))
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(column, T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch, name):
                found = np.array(fingerprints(texts, length), np.uint64).view(np.int64)
                columns = [*(batch.column(c).slice(a, b - a) for c in carry), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, [*carry, column])

    return source.mapInArrow(apply, schema)


def anchor_masks(radius: int) -> list[np.ndarray]:
    """For each syndrome of the Hamming code, what to flip in a value with it to reach the words within the radius."""
    masks: list[list[int]] = [[] for _ in range(_HALF + 1)]
    for weight in range(radius + 1):
        for positions in itertools.combinations(range(_HALF), weight):
            syndrome = 0
            for p in positions:
                syndrome ^= p + 1  # column p of the check matrix
            masks[syndrome].append(sum(1 << p for p in positions))
    return [np.array(m, np.uint64) for m in masks]


def syndromes(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for p in range(_HALF):
        out ^= np.where((values >> np.uint64(p)) & np.uint64(1), p + 1, 0)
    return out


def anchors(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for all anchors of both halves; the half is in the lowest bit of the anchor."""
    masks = anchor_masks(1 + bits // 2)
    index, found = [], []
    for half in (0, 1):
        values = (prints >> np.uint64(half * _HALF)) & np.uint64((1 << _HALF) - 1)
        kinds = syndromes(values)
        for kind in range(_HALF + 1):
            own = np.flatnonzero(kinds == kind)
            words = values[own][:, None] ^ masks[kind][None, :]
            index.append(np.repeat(own, len(masks[kind])))
            found.append((words * np.uint64(2) + np.uint64(half)).ravel())
    return np.concatenate(index), np.concatenate(found)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of n nodes, given links."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        open_ = label[a] != label[b]
        if not open_.any():
            break
        # the roots themselves must learn of each other
        x, y = label[a[open_]], label[b[open_]]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
    return label


def near_pairs(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted distinct values that differ in at most so many bits; all of them."""
    n, left, right = len(values), [], []
    if n >= _LOOKUP:
        flips = [sum(1 << p for p in c) for w in range(1, bits + 1) for c in itertools.combinations(range(BITS), w)]
        for flip in flips:
            other = values ^ np.uint64(flip)
            at = np.searchsorted(values, other).clip(max=n - 1)
            hit = np.flatnonzero((values[at] == other) & (other > values))
            left.append(hit)
            right.append(at[hit])
    else:
        for shift in range(1, n):
            hit = np.flatnonzero(np.bitwise_count(values[shift:] ^ values[:-shift]) <= bits)
            left.append(hit)
            right.append(hit + shift)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _links_of_runs(anchor: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links for whole runs of equal anchors, as (member, smallest of its local component)."""
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(anchor)]]))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(sizes < _LOOKUP, sizes)
    rest = np.repeat(starts + sizes, sizes) - np.arange(len(anchor))  # rows from here to the end of the run
    shift, open_ = 1, np.flatnonzero(small & (rest > 1))
    while len(open_):
        hit = open_[np.bitwise_count(prints[open_] ^ prints[open_ + shift]) <= bits]
        a.append(hit)
        b.append(hit + shift)
        shift += 1
        open_ = open_[rest[open_] > shift]
    for start, size in zip(starts[sizes >= _LOOKUP].tolist(), sizes[sizes >= _LOOKUP].tolist(), strict=True):
        x, y = near_pairs(prints[start : start + size], bits)
        a.append(x + start)
        b.append(y + start)
    left, right = np.concatenate(a), np.concatenate(b)
    nodes, codes = np.unique(np.concatenate([left, right]), return_inverse=True)
    root = _roots(len(nodes), codes[: len(left)], codes[len(left) :])
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return prints[nodes[member]], prints[nodes[root[member]]]


def near_links(prints: DataFrame, bits: int) -> DataFrame:
    """(member, root) rows that join all near fingerprints of `prints`, whose one column has distinct values.

    The rows of an anchor never become pairs: an anchor yields at most one row a fingerprint.
    """
    name = prints.columns[0]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(0, len(values), 1 << 14):
                part = values[i : i + (1 << 14)]
                index, found = anchors(part, bits)
                columns = [pa.array(found.view(np.int64)), pa.array(part[index].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "print"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        for batch in itertools.chain(batches, [None]):
            anchor, values = held
            if batch is not None:
                anchor = np.concatenate([anchor, batch.column(0).to_numpy(zero_copy_only=False)])
                values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(anchor):
                continue
            whole = len(anchor) if batch is None else int(np.searchsorted(anchor, anchor[-1]))  # the last run may go on
            held = (anchor[whole:], values[whole:])
            if not whole:
                continue
            order = np.lexsort((values[:whole], anchor[:whole]))
            member, root = _links_of_runs(anchor[:whole][order], values[:whole][order], bits)
            columns = [pa.array(member.view(np.int64)), pa.array(root.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["member", "root"])

    spread = prints.select(F.col(name).alias("print")).mapInArrow(replicate, "anchor long, print long")
    dealt = spread.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "member long, root long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node other than its root; the root is the smallest node of the component.

    Each round hangs every node and its neighbours on the smallest neighbour, first those above the node, then those
    below it, until nothing moves. Smallest neighbours are pre-aggregated before the shuffle; a node with very many
    links is only joined to its one smallest neighbour, which adaptive execution splits.
    """
    edges = stored(links.toDF("u", "v"), "links")

    def hang(edges: DataFrame, above: bool) -> DataFrame:
        if above:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        out = both.join(least, "u")
        if above:
            return out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        own = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return own.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    def state(edges: DataFrame) -> tuple:
        r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    before = state(edges)
    while before[0]:
        edges = stored(hang(hang(edges, True), False), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.toDF("node", "root")


def near_duplicates(
    docs: DataFrame, carry: list[str], length: int = 3, bits: int = 2, text: str = "text"
) -> DataFrame:
    """The columns `carry` of docs, then fingerprint (signed 64 bits), component_id and keeper, a row for each row.

    component_id is the smallest doc_id that can be reached over links, null only if no row of the component has one.
    keeper is true for one row of a component: the one with the smallest doc_id, of repeated rows an arbitrary but
    fixed one. Columns of carry with the name of a result column are replaced. Null, empty and blank texts have fingerprint 0 and are linked like any other; texts with fewer words
    than a shingle are one shingle. Rows with equal doc_id are judged by their texts. An empty table gives no rows.
    """
    carry = [c for c in carry if c.lower() not in ("fingerprint", "component_id", "keeper")]
    print_, row = fresh(docs, "fingerprint"), fresh(docs, "simhash_row")
    columns = list(dict.fromkeys([*carry, "doc_id"]))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    prints = stored(with_fingerprint(numbered, print_, [*columns, row], text, length), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(row).alias("row")))
    groups = stored(prints.groupBy(print_).agg(least.alias("least")), "fingerprint-groups")
    tree = components(near_links(groups.select(print_), bits))
    rooted = groups.join(tree, groups[print_] == tree["node"], "left").select(
        print_, F.coalesce("root", print_).alias("root"), "least"
    )
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"))
    known = rooted.join(firsts, "root").select(F.col(print_).alias("print"), "first")
    found = prints.join(known, prints[print_] == known["print"])
    return found.select(
        *(F.col(c) for c in carry), F.col(print_).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"), (F.col(row) == F.col("first.row")).alias("keeper"),
    )
