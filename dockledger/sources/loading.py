"""Reading the logical tables from Parquet folders or a database."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.functions.columns import business_date, line_key
from dockledger.tables import LAYOUTS, TABLE_NAMES, Tables


def conform(df: DataFrame, table: str, *, source_names: bool = False, clean: bool = False) -> DataFrame:
    """Columns of a table under their names and types here.

    `clean` is for data of the source database: its comparisons ignore trailing
    blanks, so keys lose them, and dates may be text in two spellings. Data written
    by this package is clean already; left alone, its filters reach the scan.
    """
    columns = []
    for spec in LAYOUTS[table].fields:
        name = spec.source if source_names else spec.name
        column, found = F.col(name), df.schema[name].dataType
        if clean and spec.is_key and isinstance(found, T.StringType):
            column = F.rtrim(column)
        if isinstance(spec.type, T.DateType) and isinstance(found, T.StringType):
            column = business_date(column)
        elif not spec.is_key and found != spec.type:
            column = column.cast(spec.type)  # date-times become days, numbers the quantity type
        columns.append(column.alias(spec.name))
    df = df.select(*columns)
    return df.withColumn("po_line_key", line_key("po_no", "line_seq")) if table == "po_line" else df


def load_parquet(spark: SparkSession, root: str, *, source_names: bool = False, clean: bool = True) -> Tables:
    """Tables from `root/<table>`, or `root/<source table>` with the source's column names."""

    def open_table(name: str) -> DataFrame:
        folder = LAYOUTS[name].source if source_names else name
        return conform(spark.read.parquet(f"{root}/{folder}"), name, source_names=source_names, clean=clean)

    return Tables({name: partial(open_table, name) for name in TABLE_NAMES})


@dataclass(frozen=True)
class Condition:
    """A filter on a column of a table, under its name here: one of = < <= > >= with a text, number or date."""

    column: str
    operator: str
    value: str | float | dt.date

    def sql(self, table: str) -> str:
        if self.operator not in ("=", "<", "<=", ">", ">="):
            raise ValueError(f"unknown operator {self.operator!r}")
        return f"{_source_name(table, self.column)} {self.operator} {_literal(self.value)}"


def _source_name(table: str, column: str) -> str:
    for spec in LAYOUTS[table].fields:
        if spec.name == column:
            return spec.source
    raise ValueError(f"{table} has no column {column!r}")


def _literal(value: str | float | dt.date) -> str:
    if isinstance(value, dt.date):
        value = value.isoformat()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def source_query(table: str, conditions: Sequence[Condition] = ()) -> str:
    """The table as a query of the source database: names as here, keys without trailing blanks, filters inside.

    Filters stand on the bare columns, whose comparisons ignore trailing blanks there, so that its indexes serve them.
    """
    columns = ", ".join(f"RTRIM({f.source}) AS {f.name}" if f.is_key else f"{f.source} AS {f.name}" for f in LAYOUTS[table].fields)
    where = " AND ".join(c.sql(table) for c in conditions)
    return f"SELECT {columns} FROM {LAYOUTS[table].source}" + (f" WHERE {where}" if where else "")


def split_predicates(column: str, bounds: Sequence[str | float | dt.date]) -> list[str]:
    """Predicates that share a table out: each row, also one without a value, is in exactly one of them."""
    marks = sorted(set(bounds))
    if not marks:
        return []
    between = [f"{column} >= {_literal(a)} AND {column} < {_literal(b)}" for a, b in zip(marks, marks[1:])]
    return [f"{column} < {_literal(marks[0])} OR {column} IS NULL", *between, f"{column} >= {_literal(marks[-1])}"]


def jdbc_reads(
    bounds: Mapping[str, tuple[str, Sequence]], conditions: Mapping[str, Sequence[Condition]] | None = None
) -> dict[str, tuple[str, list[str]]]:
    """For each table the derived table to read and the predicates to read it by, one task each."""
    unsplit = {"po_line", "receipt_line", "prov_line"} - {name for name, (_, marks) in bounds.items() if marks}
    if unsplit:
        raise ValueError(f"bounds are needed for {sorted(unsplit)}")
    reads = {}
    for name in TABLE_NAMES:
        column, marks = bounds.get(name, ("", ()))
        if marks:
            _source_name(name, column)
        reads[name] = f"({source_query(name, (conditions or {}).get(name, ()))}) AS {name}", split_predicates(column, marks)
    return reads


def load_jdbc(
    spark: SparkSession,
    url: str,
    *,
    bounds: Mapping[str, tuple[str, Sequence]] | None = None,
    conditions: Mapping[str, Sequence[Condition]] | None = None,
    options: dict[str, str] | None = None,
) -> Tables:
    """Tables over JDBC, each as a query with trimmed keys, so that later filters on keys reach the database as well.

    `bounds` gives, per table, a column and the values at which it is split, one task more than values; the line tables
    must have them: without, one task would read such a table. `conditions` are filters inside the queries.
    """
    reads = jdbc_reads(bounds or {}, conditions)

    def open_table(name: str) -> DataFrame:
        derived, predicates = reads[name]
        df = spark.read.jdbc(url, derived, predicates=predicates or ["1 = 1"], properties=options or {})
        return conform(df, name)

    return Tables({name: partial(open_table, name) for name in TABLE_NAMES})
