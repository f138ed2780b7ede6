"""Search by parts of texts without reading all texts: a table of three-character pieces narrows the rows, `contains` verifies.

Every text is cut into all its pieces of three characters; a shorter text is one piece. What contains a search text has
all the pieces of it, and for a search of less than three characters at least one piece that contains it. So no row is
missed, whatever the search. Stored sorted by piece, the table is read only where the pieces are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.functions.columns import contains_any

PIECE = 3
#: Pieces of a long search that are looked up; `contains` verifies the rest, so their number decides speed alone.
LOOKED_UP = 16


def _pieces(text: Column) -> Column:
    last = F.greatest(F.length(text) - PIECE + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: text.substr(i, F.lit(PIECE))))


def build(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(piece, column, key): the pieces of the columns of each row, each once a row and column; empty texts have none."""
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns]))
    found = rows.select(F.col(key), texts.alias("_t")).filter(F.col("_t.text") != "")
    return found.select(F.explode(_pieces(F.col("_t.text"))).alias("piece"), "_t.column", key).distinct()


def store(index: DataFrame, path: str) -> DataFrame:
    """The index sorted by piece, so that a lookup skips all other row groups."""
    key = index.columns[2]
    index.repartitionByRange("piece", key).sortWithinPartitions("piece", "column", key).write.mode("error").parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def candidates(index: DataFrame, search: str, columns: Sequence[str]) -> DataFrame:
    """Keys of the rows that may contain the text in one of the columns: all that do, and few others."""
    key = index.columns[2]
    own = index.filter(F.col("column").isin(*columns))
    if len(search) < PIECE:
        return own.filter(F.col("piece").contains(search)).select(key).distinct()
    pieces = sorted({search[i : i + PIECE] for i in range(len(search) - PIECE + 1)})[:LOOKED_UP]
    hits = own.filter(F.col("piece").isin(*pieces)).groupBy(key, "column").agg(F.count(F.lit(1)).alias("pieces"))
    return hits.filter(F.col("pieces") == len(pieces)).select(key).distinct()


def search(rows: DataFrame, index: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """The rows that contain the text in one of the columns, found by the index."""
    if text:
        rows = rows.join(candidates(index, text, columns), index.columns[2], "left_semi")
    return rows.filter(contains_any(list(columns), text))
