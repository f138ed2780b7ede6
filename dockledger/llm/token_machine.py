"""Token counts by finite-state machines compiled from a tokenizer file.

Two deterministic transducers read a text. The first reads classes of normalised characters and finds where words begin.
It has nine states, so a chunk of text is a map of nine states: the maps of all chunks are made side by side and composed
by a parallel prefix scan, then all chunks are read again, each from its own first state. The second reads the bytes of
words, the last byte of a word as a symbol of its own; each of its transitions is annotated with the number of tokens that
are settled by it. Its states are made when first reached. A chunk in which a word ends leaves it in a state that does not
depend on where it began, so such maps are constant, and the scan hands these states on to the chunks behind; chunks
inside one long word are read in order.

Byte-pair merges as a machine: tokens follow each other in an encoding if and only if merging the bytes of the two gives
the two again, which the ranks along the border tell. So an encoding's last token and the tokens that may still grow at
each earlier border are all that the bytes to come depend on, and that is a state.

Compiled here: files of byte-level BPE with a suffix at word ends, text normalised by NFC, white space and lower case, and
split into contractions, letters, single numbers and other characters. Other files raise ValueError.

Defined results: null texts count as empty and have no tokens; equal rows are counted each; an empty table gives an empty
result. Only the named columns are read, so others may have any name. Special tokens inside a text are one token each.
Memory is bounded: texts are read in blocks, and the table of transitions starts anew when it is full.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from dockledger.llm.common import fresh

#: Classes of characters. STMD: the letters that end a contraction at once. MARK stands for a special token.
SPACE, LETTER, STMD, R, V, L, E, NUMBER, QUOTE, OTHER, MARK = range(11)
#: States of the first machine, after a character: nothing open, letters, others, a quote that opens a word, the same with
#: r, v or l behind it, a whole contraction, a number.
IDLE, LETTERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, WHOLE, DIGIT = range(9)
STATES = 9
#: Code points past Unicode's: a special token, the end of a text; and a character whose normal form is not one
#: character or depends on its neighbours.
SPECIAL, STOP, OPEN = 0x110000, 0x110001, 0xFFFFFFFF
#: Characters of a block, symbols of a chunk, transitions that are kept.
BLOCK, CHUNK, KEPT = 1 << 21, 64, 1 << 19
#: The split pattern of the files that can be compiled.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _table() -> np.ndarray:
    """The first machine: next state by class and state."""
    out = np.zeros((MARK + 1, 16), np.uint8)
    for state in range(STATES):
        out[[LETTER, STMD, R, V, L, E], state] = LETTERS
        out[NUMBER, state] = DIGIT
        out[QUOTE, state] = OTHERS if state in (OTHERS, QUOTED) else QUOTED
        out[OTHER, state] = OTHERS
    out[[STMD, R, V, L], QUOTED] = WHOLE, QUOTED_R, QUOTED_V, QUOTED_L
    out[[E, E, L], [QUOTED_R, QUOTED_V, QUOTED_L]] = WHOLE
    return out


def _begins() -> np.ndarray:
    """Whether a character begins a word, by the states before and after it; r, v and l behind a quote: unless it goes on."""
    out = np.zeros((STATES, STATES), bool)
    out[:, [LETTERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, DIGIT]] = True
    out[[LETTERS, QUOTED_R, QUOTED_V, QUOTED_L], LETTERS] = False
    out[[OTHERS, QUOTED], OTHERS] = False
    return out


NEXT, BEGINS = _table(), _begins()


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(rest)}


def _check(spec: dict) -> None:
    model, names = spec["model"], [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    split, byte_level = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])[:2]
    added = [not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in spec["added_tokens"]]
    fits = [
        model["type"] == "BPE" and model["end_of_word_suffix"] and not model["continuing_subword_prefix"],
        not any(model.get(x) for x in ("dropout", "byte_fallback", "ignore_merges", "fuse_unk", "unk_token")),
        names == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"},
        split.get("pattern") == {"Regex": PATTERN} and split["behavior"] == "Removed" and split["invert"],
        byte_level.get("type") == "ByteLevel" and not byte_level["add_prefix_space"] and not byte_level["use_regex"],
        all(added),
    ]
    if not all(fits):
        raise ValueError("this kind of tokenizer file is not compiled")


class Characters:
    """Normal form and class of each code point, both asked of the library; texts as code points in normal form."""

    def __init__(self, spec: dict) -> None:
        self.bare = json.dumps({**spec, "added_tokens": [], "model": {**spec["model"], "vocab": {}, "merges": []}})
        names = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = "|".join(map(re.escape, names))
        library = Tokenizer.from_str(self.bare)
        points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
        self.normal = np.full(STOP + 1, OPEN, np.uint32)
        self.normal[[1, SPECIAL, STOP]] = 1, SPECIAL, STOP
        self.kind = np.full(STOP + 1, SPACE, np.uint8)
        meets = self._meeting()
        for at in range(0, len(points), 1 << 16):
            part = points[at : at + (1 << 16)]
            forms = library.normalizer.normalize_str("\1".join(map(chr, part))).split("\1") if 1 not in part else [library.normalizer.normalize_str(chr(p)) for p in part]
            for p, form in zip(part, forms):
                if len(form) == 1 and p not in meets:
                    self.normal[p] = ord(form)
            # a letter on both sides and the character twice: one word of letters, two around spaces, three with a word
            # of others, four with two numbers
            found = library.pre_tokenizer.pre_tokenize_str("".join(f"a{chr(p)}{chr(p)}a " for p in part))
            words = np.bincount(np.array([span[0] for _, span in found]) // 5, minlength=len(part))
            self.kind[part] = np.array([SPACE, LETTER, SPACE, OTHER, NUMBER], np.uint8)[words]
        for kind, letters in ((STMD, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e"), (QUOTE, "'")):
            self.kind[[ord(c) for c in letters]] = kind
        self.kind[SPECIAL] = MARK

    @staticmethod
    def _meeting() -> set[int]:
        """Characters that may combine with, or move before, the one in front of them."""
        out = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # fixed values: vowels and finals of Hangul
        for p in range(0x110000):
            c = chr(p)
            if unicodedata.combining(c) or unicodedata.category(c) == "Cn":
                out.add(p)
            parts = unicodedata.decomposition(c).split()
            if len(parts) == 2 and not parts[0].startswith("<"):
                out.add(int(parts[1], 16))
        return out

    def points(self, texts: Iterable[str], size: int = BLOCK) -> Iterator[np.ndarray]:
        """The texts in normal form in arrays of about `size` code points, a STOP behind each text."""
        library = Tokenizer.from_str(self.bare)
        held, n = [], 0
        for text in texts:
            at = 0
            while True:
                end = at + size
                while at < len(text) and end < len(text) and (self.normal[ord(text[end])] == OPEN or self._inside(text, end)):
                    end += 1
                held.append(self._normal(text[at:end], library))
                n += len(held[-1])
                at = end
                if at >= len(text):
                    held.append(np.array([STOP], np.uint32))
                    n += 1
                if n >= size:
                    yield np.concatenate(held)
                    held, n = [], 0
                if at >= len(text):
                    break
        if held:
            yield np.concatenate(held)

    def _inside(self, text: str, at: int) -> bool:
        """Whether a special token lies over this place."""
        return bool(self.special) and any(m.start() < at - max(0, at - 99) < m.end() for m in re.finditer(self.special, text[max(0, at - 99) : at + 99]))

    def _normal(self, text: str, library: Tokenizer) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        marks = [m.span() for m in re.finditer(self.special, text)] if self.special and "<|" in text else []
        if marks:
            raw, gone = raw.copy(), np.zeros(len(raw), bool)
            for start, end in marks:
                raw[start], gone[start + 1 : end] = SPECIAL, True
            raw = raw[~gone]
        out = self.normal[raw]
        opened = out == OPEN
        if not opened.any():
            return out
        # each run of open characters with the one before it is normalised by the library, all in one call
        edge = np.diff(np.concatenate([[0], opened.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        based = (starts > 0) & ~np.isin(raw[starts - 1], [1, SPECIAL])
        starts = starts - based
        clips = [raw[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts, ends)]
        forms = library.normalizer.normalize_str("\1".join(clips)).split("\1")
        parts, at = [], 0
        for a, b, form in zip(starts, ends, forms):
            parts += [out[at:a], np.frombuffer(form.encode("utf-32-le"), np.uint32)]
            at = b
        return np.concatenate([*parts, out[at:]])


class Pieces:
    """The second machine: bytes of words to numbers of tokens."""

    def __init__(self, spec: dict) -> None:
        model, letters = spec["model"], byte_letters()
        suffix, ids = model["end_of_word_suffix"], model["vocab"]
        self.rank, halves, symbols = {}, {}, {}
        for token, i in ids.items():
            ends = token.endswith(suffix)
            body = token[: -len(suffix)] if ends else token
            if body and all(c in letters for c in body):
                symbols[i] = [letters[c] for c in body]
                symbols[i][-1] += 256 * ends
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = ids[a + b]
            if whole in halves:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.rank[ids[a] << 32 | ids[b]] = n
            halves[whole] = ids[a], ids[b], n
        # the tokens along the left and the right border of each, with the rank of the merge that takes them in
        self.left, self.right = ({i: self._border(i, halves, side) for i in symbols} for side in (0, 1))
        self.child, self.token, self.grows = {}, [-1], [False]
        never: set[int] = set()
        for i, s in sorted(symbols.items(), key=lambda x: halves.get(x[0], (0, 0, -1))[2]):
            if i in halves and (never & {*halves[i][:2]} or not self.follows(*halves[i])):
                never.add(i)
                continue
            node = 0
            for x in s:
                key, self.grows[node] = node << 9 | x, True
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.grows.append(False)
                node = self.child[key]
            self.token[node] = i
        self.restart()

    @staticmethod
    def _border(token: int, halves: dict, side: int) -> list[tuple[int, int]]:
        out, taken = [], 1 << 60
        while token in halves:
            out.append((token, taken))
            taken, token = halves[token][2], halves[token][side]
        return [*out, (token, taken)]

    def follows(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether no merge ranked below `before` crosses the border between the tokens a and b.

        A merge crosses if both its tokens lie at the border when its rank comes: the one on the left must be taken in
        later, the one on the right not earlier (of equal merges the left one comes first).
        """
        for x, x_taken in self.right[a]:
            for y, y_taken in self.left[b]:
                n = self.rank.get(x << 32 | y)
                if n is not None and n < x_taken and n <= y_taken and n < before:
                    return False
        return True

    def restart(self) -> None:
        """Forget all states but the first."""
        self.states, self.number, self.known = [((-1, 0, 0),)], {((-1, 0, 0),): 0}, {}
        self.pairs: dict[int, bool] = {}
        self.keys, self.values = np.full(1 << 12, -1, np.int64), np.zeros(1 << 12, np.int64)
        self._put(512, 0)  # symbol 512: nothing, in the first state

    def _put(self, key: int, value: int) -> None:
        self.known[key] = value
        if 2 * len(self.known) > len(self.keys):
            keys, values = self.keys, self.values
            self.keys, self.values = np.full(2 * len(keys), -1, np.int64), np.zeros(2 * len(keys), np.int64)
            for k, v in zip(keys[keys >= 0].tolist(), values[keys >= 0].tolist()):
                self._slot(k, v)
        self._slot(key, value)

    def _slot(self, key: int, value: int) -> None:
        mask = len(self.keys) - 1
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32 & mask
        while self.keys[at] >= 0:
            at = at + 1 & mask
        self.keys[at], self.values[at] = key, value

    def step(self, state: int, symbol: int) -> int:
        """Next state << 16 | tokens settled, for one symbol.

        A state lists the tokens behind which another may be growing, where that one stands in the tree of all tokens,
        and how many tokens there were, less the least of these numbers: so many are settled.
        """
        key = state << 10 | symbol
        if key in self.known:
            return self.known[key]
        grown, ended = [], None
        for last, node, n in self.states[state]:
            node = self.child.get(node << 9 | symbol, -1)
            if node < 0:
                continue
            token = self.token[node]
            if token >= 0 and (last < 0 or self._follows(last, token)):
                ended = token, 0, n + 1
            if self.grows[node]:
                grown.append((last, node, n))
        if symbol >= 256:
            value = ended[2]
        else:
            grown.append(ended)
            least = min(n for _, _, n in grown)
            made = tuple((last, node, n - least) for last, node, n in grown)
            if made not in self.number:
                self.number[made] = len(self.states)
                self.states.append(made)
            value = self.number[made] << 16 | least
        self._put(key, value)
        return value

    def _follows(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if key not in self.pairs:
            self.pairs[key] = self.follows(a, b)
        return self.pairs[key]

    def steps(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """step() for many at once: by the hash table, what is missing there is made first."""
        keys = states << 10 | symbols
        while True:
            mask = len(self.keys) - 1
            at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & mask
            found = self.keys[at]
            out = self.values[at]
            rest = np.flatnonzero(found != keys)
            missing = []
            while len(rest):
                empty = found[rest] < 0
                missing.append(keys[rest[empty]])
                rest = rest[~empty]
                at[rest] = at[rest] + 1 & mask
                found[rest] = self.keys[at[rest]]
                out[rest] = self.values[at[rest]]
                rest = rest[found[rest] != keys[rest]]
            missing = np.unique(np.concatenate(missing)) if missing else keys[:0]
            if not len(missing):
                return out
            for key in missing.tolist():
                self.step(key >> 10, key & 1023)

    def read(self, symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Tokens settled at each symbol, and the state behind the last one."""
        chunks = len(symbols) // CHUNK
        out = np.zeros(len(symbols), np.uint16)
        if len(self.known) > KEPT and state == 0:
            self.restart()
        if chunks:
            grid = np.ascontiguousarray(symbols[: chunks * CHUNK].reshape(chunks, CHUNK).T)
            emitted = np.zeros((CHUNK, chunks), np.uint16)
            ends = grid >= 256
            first = np.where(ends.any(axis=0), ends.argmax(axis=0), CHUNK)
            # behind its first word end a chunk is read from the first state: its map is constant
            states = np.zeros(chunks, np.int64)
            place = np.arange(CHUNK)[:, None]
            tails = np.where(place > first, grid, 512)
            for j in range(1, CHUNK):
                value = self.steps(states, tails[j])
                states, emitted[j] = value >> 16, value & 0xFFFF
            state = self._heads(grid, first, states, emitted, state)
            out[: chunks * CHUNK] = emitted.T.ravel()
        for i in range(chunks * CHUNK, len(symbols)):
            value = self.step(state, int(symbols[i]))
            state, out[i] = value >> 16, value & 0xFFFF
        return out, state

    def _heads(self, grid: np.ndarray, first: np.ndarray, exits: np.ndarray, emitted: np.ndarray, state: int) -> int:
        """Read each chunk up to its first word end from the state that the scan hands it."""
        constant = first < CHUNK
        ready = np.flatnonzero(np.concatenate([[True], constant[:-1]]))
        while len(ready):
            states = np.where(ready > 0, exits[ready - 1], state)
            if len(ready) < 16:  # inside long words
                for k, at in zip(ready.tolist(), states.tolist()):
                    for j in range(min(int(first[k]) + 1, CHUNK)):
                        value = self.step(at, int(grid[j, k]))
                        at, emitted[j, k] = value >> 16, value & 0xFFFF
                    if not constant[k]:
                        exits[k] = at
            else:
                live = np.arange(len(ready))
                for j in range(CHUNK):
                    live = live[first[ready[live]] >= j]
                    if not len(live):
                        break
                    value = self.steps(states[live], grid[j, ready[live]].astype(np.int64))
                    states[live], emitted[j, ready[live]] = value >> 16, value & 0xFFFF
                inner = ~constant[ready]
                exits[ready[inner]] = states[inner]
            ready = ready[~constant[ready]] + 1
            ready = ready[ready < len(first)]
        return int(exits[-1])


def word_states(classes: np.ndarray, state: int) -> np.ndarray:
    """The first machine's state after each character, from the state before all."""
    chunks = -(-len(classes) // CHUNK)
    padded = np.full(chunks * CHUNK, SPACE, np.int16)
    padded[: len(classes)] = classes
    grid = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T) << 4
    flat = NEXT.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for row in grid:
        maps = flat[row[:, None] + maps]
    distance = 1
    while distance < chunks:  # after this round a map covers 2 * distance chunks
        maps[distance:] = np.take_along_axis(maps[distance:], maps[:-distance].astype(np.intp), axis=1)
        distance *= 2
    states = np.concatenate([[state], maps[:-1, state]]).astype(np.uint8)
    out = np.empty((CHUNK, chunks), np.uint8)
    for j, row in enumerate(grid):
        states = flat[row + states]
        out[j] = states
    return out.T.ravel()[: len(classes)]


def count_tokens(texts: Iterable[str], characters: Characters, pieces: Pieces, size: int = BLOCK) -> Iterator[int]:
    """The number of tokens of each text, read in blocks of about `size` characters."""
    behind = 4  # so many characters tell where the words before them end
    word, piece, total = IDLE, 0, 0
    held = np.zeros(0, np.uint32)
    blocks = characters.points(texts, size)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        points = np.concatenate([held, block])
        classes = characters.kind[points]
        states = word_states(classes, word)
        before = np.concatenate([[word], states[:-1]])
        after = np.concatenate([states[1:], [IDLE]])
        begins = BEGINS[before, states] & ~((states >= QUOTED_R) & (states <= QUOTED_L) & (after == WHOLE))
        inside = (classes != SPACE) & (classes != MARK)
        ends = inside & ~np.concatenate([inside[1:] & ~begins[1:], [False]])
        use = len(points) if following is None else max(len(points) - behind, 0)
        if use:
            word = int(states[use - 1])
        held, points, inside, ends, classes = points[use:], points[:use], inside[:use], ends[:use], classes[:use]
        kept = points[inside]
        symbols = np.frombuffer(kept.tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int64)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.cumsum(np.where(inside, width, 0))
        symbols[offset[ends] - 1] += 256
        settled, piece = pieces.read(symbols, piece)
        so_far = np.concatenate([[0], np.cumsum(settled, dtype=np.int64)])
        stops = np.flatnonzero(points == STOP)
        marks = np.cumsum(classes == MARK)
        sums = so_far[offset] + marks if len(points) else so_far[:0]
        for at in stops.tolist():
            yield total + int(sums[at])
            total = -int(sums[at])
        total += int(sums[-1]) if len(sums) else 0
        block = following


def compile_tokenizer(path: str) -> tuple[Characters, Pieces]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    _check(spec)
    return Characters(spec), Pieces(spec)


def token_counts(docs: DataFrame, keep: list[str], text: str, path: str) -> DataFrame:
    """The columns `keep`, and n_bytes (UTF-8) and n_tokens of each text, for the tokenizer file at `path` on the driver."""
    # bounded by the file and by Unicode; a worker that is used again keeps the states it has made
    machine = docs.sparkSession.sparkContext.broadcast(compile_tokenizer(path))
    kept = docs.select(*keep)
    chosen = docs.select(*keep, F.col(text).cast("string").alias(fresh(kept, "text")))
    names = fresh(kept, "n_bytes"), fresh(kept, "n_tokens")
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters, pieces = machine.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).cast(pa.int64())
            counts = count_tokens((x.as_py() or "" for x in column), characters, pieces)
            columns = [*batch.columns[:-1], sizes, pa.array(counts, pa.int64(), size=batch.num_rows)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return chosen.mapInArrow(task, schema)
