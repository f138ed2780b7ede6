"""Benchmark decontamination: every passage of every document queries a BM25 index of the benchmark's items.

Items are cut into segments of at most 64 words; a posting holds the BM25 weight of a term in a segment over the
segment's score for its own words, so all scores are shares of a full match. Passages are 64 words, one every 32. For a
passage the sum of the terms' largest weights bounds its score anywhere; where that reaches the threshold, the largest
weights in each block of 16 segments bound it for the block; blocks that may reach it are scored in full. So exactly
the segments at or above the threshold are retrieved. Their items are verified: of the question and of the answer,
enough three-word shingles must stand in the document around the passages found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.llm.common import fresh, joined, mix, pieces, span_hashes, stored, word_spans

K1, B = 1.2, 0.75
STRIDE, PASSAGE, SEGMENT, BLOCK, SHINGLE = 32, 64, 64, 16, 3
#: Least share of a segment's own score, and least share of shingles of the question and of the answer.
THRESHOLD, OVERLAP = 0.5, 0.6
#: Items with fewer words are not ranked but found whole: all their words in a row, and those of one or two words, which
#: stand in texts by chance, as a line of their own.
MIN_WORDS, LINE_WORDS = 5, 2
#: Segments that the driver takes at a time, about, and bytes of an index in one broadcast; what is more takes further passes.
PASS_SEGMENTS, PASS_BYTES = 1 << 13, 64 << 20
SHARD_SEGMENTS = 512

# Words are runs of ASCII letters and digits and of all other characters above ASCII; in scripts that are written without
# spaces (Thai, Lao, Burmese, Khmer, kana, Han) every character is a word.
_GAP = bytes(c if c >= 128 or chr(c).isalnum() else 0x20 for c in range(256))
_SINGLE = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_MARKS = re.compile("[\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20]")


def normal(text: bytes) -> bytes:
    text = text.decode("utf-8", "replace").lower()
    if not text.isascii() and _SINGLE.search(text):
        text = _MARKS.sub(" ", _SINGLE.sub(r" \1 ", text))
    return text.encode().translate(_GAP)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and where each text's words start."""
    buf, starts = joined([normal(t) for t in texts])
    begin, end = word_spans(buf)
    return span_hashes(buf, begin, end), np.searchsorted(begin, starts)


def shingles(words: np.ndarray, length: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of so many words; of a shorter text, the whole."""
    length = min(length, len(words))
    out = np.zeros(max(len(words) - length + 1, 0) if length else 0, np.uint64)
    for k in range(length):
        out = mix(out + words[k : k + len(out)] + np.uint64(k))
    return out


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last sentence; of a single sentence, the last quarter of its words."""
    ends = [m.end() for m in re.finditer(r"[.!?]+\s+(?=\S)|[。？！]+\s*(?=\S)", text.strip())]
    if ends:
        return text.strip()[: ends[-1]], text.strip()[ends[-1] :]
    words = text.split() if not _SINGLE.search(text) else normal(text.encode()).decode().split()
    cut = len(words) - max(1, len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def segments(items: DataFrame) -> DataFrame:
    """(item, item_id, terms, question, answer, lengths) for each segment of the items; short ones have empty lengths.

    item: a number of its own for each different (item_id, text); lengths: of the shingles of question and answer, less than usual where a part has fewer words.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (words, _), parts = word_hashes([text.encode()]), question_and_answer(text)
                if len(words) < MIN_WORDS:
                    if len(words):
                        rows.append((item, item_id, words.view(np.int64), [], [], []))
                    continue
                parts = [word_hashes([p.encode()])[0] for p in parts]
                sets = [np.unique(shingles(p)).view(np.int64) for p in parts]
                lengths = [min(SHINGLE, len(p)) for p in parts]
                count = -(-len(words) // SEGMENT)
                for part in np.array_split(words, count):
                    rows.append((item, item_id, part.view(np.int64), *sets, lengths))
            ids = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
            lists = [pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (2, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([*ids, *lists], ["item", "item_id", "terms", "question", "answer", "lengths"])

    source = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    return source.distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(
        apply, "item long, item_id long, terms array<long>, question array<long>, answer array<long>, lengths array<long>"
    )


class Shard:
    """An index of some segments: weights by term, and their maxima over all and over blocks of segments."""

    def __init__(self, rows: list, idf: dict[int, float], mean: float):
        term, segment, weight = [], [], []
        for i, (_, words) in enumerate(rows):
            own, tf = np.unique(np.asarray(words, np.int64).view(np.uint64), return_counts=True)
            w = np.array([idf[int(t)] for t in own.view(np.int64)]) * tf * (K1 + 1)
            w /= tf + K1 * (1 - B + B * len(words) / mean)
            term.append(own)
            segment.append(np.full(len(own), i))
            weight.append(w / w.sum())
        self.items = np.array([item for item, _ in rows], np.int64)
        self.terms, place = np.unique(np.concatenate(term), return_inverse=True)
        segment, weight = np.concatenate(segment), np.concatenate(weight).astype(np.float32)
        blocks = -(-len(rows) // BLOCK)
        self.block_max = np.zeros((len(self.terms), blocks), np.float32)
        np.maximum.at(self.block_max, (place, segment // BLOCK), weight)
        self.most = self.block_max.max(axis=1)
        # The weights of a block as a small table: a row for each term that it has, a column for each segment.
        self.row_of = np.zeros((blocks, len(self.terms)), np.int32)
        self.table = []
        for b in range(blocks):
            at = np.flatnonzero(segment // BLOCK == b)
            own, row = np.unique(place[at], return_inverse=True)
            table = np.zeros((len(own) + 1, BLOCK), np.float32)
            table[row + 1, segment[at] % BLOCK] = weight[at]
            self.row_of[b, own] = np.arange(1, len(own) + 1)
            self.table.append(table)
        self.bytes = sum(x.nbytes for x in (self.terms, self.block_max, self.most, self.row_of, *self.table))

    def search(self, stride: np.ndarray, words: np.ndarray, follows: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """(first stride of a passage, segment) for all that reach the threshold.

        stride: of each word, in order; follows: whether a stride and the next one are of one document.
        """
        at = np.searchsorted(self.terms, words).clip(max=len(self.terms) - 1)
        known = self.terms[at] == words
        key = np.unique(stride[known] * len(self.terms) + at[known])
        if not len(key):
            return []
        stride, term = np.divmod(key, len(self.terms))
        first = np.flatnonzero(np.concatenate([[True], stride[1:] != stride[:-1]]))
        bound = np.zeros(len(follows) + 1)
        bound[stride[first]] = np.add.reduceat(self.most[term], first)
        passage = np.flatnonzero(bound[:-1] + np.where(follows, bound[1:], 0) >= threshold - 1e-6)
        if not len(passage):
            return []
        used = np.zeros(len(follows) + 1, bool)
        used[passage] = used[passage + 1] = True
        keep = used[stride]
        stride, term = stride[keep], term[keep]
        first = np.flatnonzero(np.concatenate([[True], stride[1:] != stride[:-1]]))
        bounds = np.zeros((len(follows) + 1, self.block_max.shape[1]), np.float32)
        bounds[stride[first]] = np.add.reduceat(self.block_max[term], first, axis=0)
        upper = bounds[passage] + np.where(follows[passage, None], bounds[passage + 1], 0)
        out = []
        starts = np.searchsorted(stride, np.arange(len(follows) + 2))
        for p, b in zip(*np.nonzero(upper >= threshold - 1e-6), strict=True):
            s = int(passage[p])
            distinct = np.unique(term[starts[s] : starts[s + 1 + int(follows[s])]])
            score = self.table[b][self.row_of[b, distinct]].sum(axis=0)
            out += [(s, int(b) * BLOCK + int(i)) for i in np.flatnonzero(score >= threshold - 1e-6)]
        return out


def whole_items(texts: list[bytes], words: np.ndarray, at: np.ndarray, short: dict[int, dict[int, list[int]]]) -> list[set[int]]:
    """For each text the short items that stand in it whole. short: hash of all words -> items, by number of words."""
    found: list[set[int]] = [set() for _ in texts]
    for length, items in short.items():
        if length <= LINE_WORDS:
            for i, text in enumerate(texts):
                lines = text.split(b"\n")
                own, starts = word_hashes(lines)
                for a in starts[:-1][np.diff(starts) == length]:
                    found[i].update(items.get(int(shingles(own[a : a + length], length)[0]), ()))
            continue
        runs = shingles(words, length)
        owner = np.searchsorted(at, np.arange(len(runs)), "right") - 1
        for k in np.flatnonzero(np.isin(runs, np.array(list(items), np.uint64))):
            if k + length <= at[owner[k] + 1]:
                found[owner[k]].update(items[int(runs[k])])
    return found


def contaminations(
    texts: list[bytes], shards: list[Shard], sets: dict[int, tuple], threshold: float, overlap: float, short: dict | None = None
):
    """For each text: how many (passage, segment) pairs were retrieved, and the items that were verified."""
    words, at = word_hashes(texts)
    count = np.diff(at)
    strides = np.maximum(-(-count // STRIDE), 1)
    base = np.concatenate([[0], np.cumsum(strides)])
    owner = np.repeat(np.arange(len(texts)), count)
    inside = np.arange(len(words)) - at[owner]
    stride = base[owner] + inside // STRIDE
    of = np.repeat(np.arange(len(texts)), strides)
    follows = np.concatenate([of[1:] == of[:-1], [False]])
    retrieved = np.zeros(len(texts), np.int64)
    spans: dict[tuple[int, int], list[int]] = {}
    for shard in shards:
        for s, segment in shard.search(stride, words, follows, threshold):
            text = int(of[s])
            retrieved[text] += 1
            begin = (s - int(base[text])) * STRIDE
            span = spans.setdefault((text, int(shard.items[segment])), [begin, begin])
            span[0], span[1] = min(span[0], begin), max(span[1], begin)
    found = whole_items(texts, words, at, short or {})
    for (text, item), (low, high) in spans.items():
        question, answer, length = sets[item]
        own = words[at[text] : at[text + 1]][max(0, low - length) : high + PASSAGE + length]
        parts = [np.isin(part, shingles(own, k)).mean() if k else 1.0 for part, k in (question, answer)]
        if min(parts) >= overlap:
            found[text].add(item)
    return retrieved, found


def decontaminate(
    docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text",
    threshold: float = THRESHOLD, overlap: float = OVERLAP,
) -> DataFrame:
    """The columns `keep` of docs, then contaminated, item_ids (sorted) and retrieved, a row for each row.

    Null, empty and short texts are passages like any other; without words they are clean. Null item texts and items
    without a word are left out; items of fewer than five words are found whole (see `whole_items`), the others by rank;
    an item with a null id counts but is not listed; repeated items count once, and different texts with one id (or none)
    are items of their own.
    Without items nothing is contaminated. Names that clash with a result column are replaced.
    """
    own = ["contaminated", "item_ids", "retrieved"]
    keep = [c for c in keep if c.lower() not in own]
    index = stored(segments(items), "segments")
    ranked = index.filter(F.size("lengths") > 0)
    total = ranked.agg(F.count("*"), F.sum(F.size("terms"))).first()
    passes = max(1, -(-index.count() // PASS_SEGMENTS))
    mean = (total[1] or 1) / max(total[0], 1)
    name = fresh(docs, "passage_text")
    state = docs.select(
        *(docs[c] for c in keep), docs[text].cast("string").alias(name),
        F.array().cast("array<long>").alias("item_ids"), F.lit(0).cast("long").alias("retrieved"),
        F.lit(False).alias("contaminated"),
    )
    frequency = ranked.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count()
    for i in range(passes):
        part = index.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == i)
        terms = part.select(F.explode("terms").alias("term")).distinct().join(frequency, "term").collect()
        idf = {r.term: float(np.log(1 + (total[0] - r["count"] + 0.5) / (r["count"] + 0.5))) for r in terms}
        rows = part.collect()  # about PASS_SEGMENTS
        for j, (shards, own) in enumerate(_broadcasts(rows, idf, mean)):
            if i or j:
                state = stored(state, "decontaminated")
            state = _query(state, name, shards, own, threshold, overlap)
    return state.select(*keep, "contaminated", "item_ids", "retrieved")


def _broadcasts(rows: list, idf: dict, mean: float) -> Iterator[tuple[list[Shard], list]]:
    """Indexes of some rows each, of at most about PASS_BYTES; the segments of an item stay together."""
    rows.sort(key=lambda r: (len(r.terms), r.item_id is None, r.item_id or 0, r.terms))  # alike lengths share a block
    parts: list[list] = [[]]
    last = {r.item: i for i, r in enumerate(rows)}
    until, size = 0, 0
    # a segment of n words takes at most so many bytes of a shard: term, maxima and rows of 32 blocks, table
    cost = lambda r: len(r.terms) * (8 + 2 * 4 * (SHARD_SEGMENTS // BLOCK) + 4 + 4 * BLOCK)
    for i, r in enumerate(rows):
        if size + cost(r) > PASS_BYTES and i > until:
            parts.append([])
            size = 0
        parts[-1].append(r)
        size, until = size + cost(r), max(until, last[r.item])
    for own in parts:
        ranked = [r for r in own if r.lengths]
        yield [Shard([(r.item, r.terms) for r in ranked[a : a + SHARD_SEGMENTS]], idf, mean) for a in range(0, len(ranked), SHARD_SEGMENTS)], own


def _query(state: DataFrame, name: str, shards: list[Shard], rows: list, threshold: float, overlap: float) -> DataFrame:
    """One pass: queries the index of rows with every passage and adds what it finds to the state's columns."""

    sets, short = {}, {}
    ids = {r.item: r.item_id for r in rows}
    for r in rows:
        if not r.lengths:
            words = np.asarray(r.terms, np.int64).view(np.uint64)
            short.setdefault(len(words), {}).setdefault(int(shingles(words, len(words))[0]), []).append(r.item)
            continue
        length = sets.get(r.item, ((), (), 0))[2] + len(r.terms)
        parts = [np.asarray(x, np.int64).view(np.uint64) for x in (r.question, r.answer)]
        sets[r.item] = *zip(parts, r.lengths, strict=True), length
    shared = state.sparkSession.sparkContext.broadcast((shards, sets, ids, short))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, sets, ids, short = shared.value
        for batch in batches:
            names = batch.schema.names
            for a, b, texts in pieces(batch, name):
                retrieved, found = contaminations(texts, shards, sets, threshold, overlap, short)
                part = batch.slice(a, b - a)
                before = part.column(names.index("item_ids")).to_pylist()
                listed = [sorted({*x, *(ids[i] for i in y)} - {None}) for x, y in zip(before, found, strict=True)]
                bad = [bool(y) or x for x, y in zip(part.column(names.index("contaminated")).to_pylist(), found, strict=True)]
                sums = part.column(names.index("retrieved")).to_numpy() + retrieved
                new = {"item_ids": pa.array(listed, pa.list_(pa.int64())), "retrieved": pa.array(sums), "contaminated": pa.array(bad)}
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(i)) for i, n in enumerate(names)], names)

    return state.mapInArrow(apply, state.schema)
