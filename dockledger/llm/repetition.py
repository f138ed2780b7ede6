"""Quality rules: how much of a text is inside repeated n-grams and lines.

Words are hashed once; the hash of an n-gram is a rolling combination of its words' hashes. Windows of a text with
equal hashes are repeated, and the characters under any repeated window are counted once for each length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dockledger.llm.common import WORD, fresh, joined, mix, pieces, span_hashes, word_spans

#: Largest share of word characters inside repeated n-grams, by n-gram length. A short clean text may hold one line
#: twice, which is a third of it; texts that mainly repeat themselves are far above.
NGRAM_LIMITS = {5: 0.36, 6: 0.35, 7: 0.34, 8: 0.33, 9: 0.32, 10: 0.31}
#: Largest share of word characters inside repeated lines, and of symbol characters for each word.
LINE_LIMIT = 0.70
#: The lower limit for lines where more than so many lines equal an earlier one, as a menu between unique lines does.
FEW_LINES, LINES_LIMIT = 3, 0.30
SYMBOL_LIMIT = 0.25
MIN_WORDS = 10
#: Largest percentage of words in repeated five-word windows.
REPEAT_PERCENT = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "dup_line_chars": pa.int64(),
    **{f"dup_chars_{n}": pa.int64() for n in NGRAM_LIMITS},
}


def repeated(values: np.ndarray) -> np.ndarray:
    """Marks the entries whose value occurs twice or more."""
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(n_words: int, windows: np.ndarray, length: int) -> np.ndarray:
    """Marks the words under any of the marked windows."""
    at = np.flatnonzero(windows)
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of so many words, in order."""
    n = len(hashes) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(length if n > 0 else 0):
        out = mix(out + hashes[k : k + n] + np.uint64(k))
    return out


def repeated_lines(text: bytes) -> tuple[int, list[int]]:
    """How many lines with a word equal an earlier line, and the index of every line that has an equal one."""
    if b"\n" not in text:
        return 0, []
    seen: dict[bytes, int] = {}
    again, marked = 0, set()
    for i, line in enumerate(text.split(b"\n")):
        if not line.strip(b" \t\n\x0b\x0c\r"):
            continue
        first = seen.setdefault(line, i)
        if first != i:
            again += 1
            marked |= {first, i}
    return again, sorted(marked)


def measure(text: bytes, hashes: np.ndarray, chars: np.ndarray, n_symbols: int) -> tuple:
    """The measures of a text from its words' hashes and numbers of characters."""
    n, total = len(hashes), int(chars.sum())
    dup_lines, lines = repeated_lines(text)
    line_chars = 0
    if lines:
        parts = text.split(b"\n")
        line_chars = sum(len(w.decode("utf-8", "replace")) for i in lines for w in parts[i].split())
    repeat_words, by_length, any_left = 0, [], True
    for length in NGRAM_LIMITS:
        inside = 0
        if any_left and n >= length:
            marks = repeated(rolled(hashes, length))
            any_left = bool(marks.any())  # without a repeated n-gram there is no longer one
            if any_left:
                under = covered(n, marks, length)
                inside = int(chars[under].sum())
                if length == 5:
                    repeat_words = int(under.sum())
        by_length.append(inside)
    base_failed = n < MIN_WORDS or 100 * repeat_words > REPEAT_PERCENT * n
    kept = (
        not base_failed
        and all(inside <= limit * total for inside, limit in zip(by_length, NGRAM_LIMITS.values(), strict=True))
        and line_chars <= (LINE_LIMIT if dup_lines <= FEW_LINES else LINES_LIMIT) * total
        and n_symbols <= SYMBOL_LIMIT * n
    )
    return n, total, n_symbols, dup_lines, repeat_words, base_failed, kept, line_chars, *by_length


def measures(texts: list[bytes]) -> list[tuple]:
    buf, starts = joined(texts)
    begin, end = word_spans(buf)
    hashes = span_hashes(buf, begin, end)
    firsts = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
    chars = firsts[end] - firsts[begin]
    symbols = np.add.reduceat(_SYMBOL[buf].astype(np.int64), starts[:-1]) if len(texts) else []
    at = np.searchsorted(begin, starts)
    return [
        measure(text, hashes[at[i] : at[i + 1]], chars[at[i] : at[i + 1]], int(symbols[i]))
        for i, text in enumerate(texts)
    ]


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all but the text), then the measures and the verdict, a row for each row.

    A null text counts as one without words; texts with fewer than ten words are rejected. Rows are judged each for
    itself, so repeated rows get equal results. A column of docs that has the name of a measure is replaced by it.
    Texts are whole; a text is held by one task, as is its row.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != text or keep is not None]
    keep = [c for c in keep if c.lower() not in MEASURES]
    name = fresh(docs, "rule_text")
    source = docs.select(*(docs[c] for c in keep), docs[text].cast("string").alias(name))
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField(c, T.BooleanType() if kind == pa.bool_() else T.LongType()) for c, kind in MEASURES.items()
    ])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch, name):
                columns = list(zip(*measures(texts), strict=True))
                own = [pa.array(x, kind) for x, kind in zip(columns, MEASURES.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in keep), *own], [*keep, *MEASURES]
                )

    return source.mapInArrow(apply, schema)


_LENGTHS = list(NGRAM_LIMITS)


def _words(n: int) -> str:
    return ", ".join(f"w{k}" for k in range(n))


ORACLE_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t
), led AS (
  SELECT doc_id, i, word AS w0, {", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(1, max(_LENGTHS)))}
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), grams AS (
  {" UNION ALL ".join(f"SELECT doc_id, {n} AS n, i, concat_ws(' ', {_words(n)}) AS g FROM led WHERE w{n - 1} IS NOT NULL" for n in _LENGTHS)}
), again AS (
  SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS c FROM grams) WHERE c > 1
), under AS (
  SELECT DISTINCT doc_id, n, again.i + k AS i FROM again, range({max(_LENGTHS)}) offsets(k) WHERE k < n
), inside AS (
  SELECT doc_id, n, count(*) AS words, sum(length(word)) AS chars FROM under JOIN words USING (doc_id, i) GROUP BY doc_id, n
), lines AS (
  SELECT doc_id, line, count(*) AS c, list_sum(list_transform(regexp_extract_all(line, '{WORD}'), lambda x: length(x))) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id, line
), by_line AS (
  SELECT doc_id, sum(c - 1) AS n_dup_lines, sum(c * chars) FILTER (WHERE c > 1) AS dup_line_chars FROM lines GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols
  FROM t
), pivoted AS (
  SELECT doc_id, max(words) FILTER (WHERE n = 5) AS n_repeat_words,
    {", ".join(f"max(chars) FILTER (WHERE n = {n}) AS dup_chars_{n}" for n in _LENGTHS)}
  FROM inside GROUP BY doc_id
), measured AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
    {", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in _LENGTHS)}
  FROM counted LEFT JOIN by_line USING (doc_id) LEFT JOIN pivoted USING (doc_id)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM measured
)
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in MEASURES if c not in ("base_failed", "kept"))}, base_failed,
  NOT base_failed AND dup_line_chars <= CASE WHEN n_dup_lines <= {FEW_LINES} THEN {LINE_LIMIT} ELSE {LINES_LIMIT} END * word_chars
  AND n_symbols <= {SYMBOL_LIMIT} * n_words
  AND {" AND ".join(f"dup_chars_{n} <= {limit} * word_chars" for n, limit in NGRAM_LIMITS.items())} AS kept
FROM judged
"""
