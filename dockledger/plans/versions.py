"""Table versions: a write flow stores what it changed, then makes it current.

Stored rows go to a folder of their own name, never to one that exists. New rows add a folder to a table, edits and
deletes are small folders of their own; `load_version` applies them: a row is changed by the last edit of its receipt and
item, and gone if its receipt was deleted, where either came after the row. `compact` stores such tables anew.

A version is one file, written last. It appears under its number whole or not at all and never in place of another
(`create_once`), so readers see the old version or the new one, and of writers that build on the same version at the
same time one succeeds; the others fail, and what they stored belongs to no version. What a writer that died leaves
behind is never read: data folders that no version names, a temporary file, or something under a version's number that
is no whole version, which the next writer passes over.

With each stored folder go the heavy keys (see `dockledger.functions.skew`) and high-water marks: the last running
number of a day and the last line of a receipt. Marks of folders are merged when they are read, so registering looks
at no header and no line. Numbers of deleted receipts are not given again.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.functions import skew
from dockledger.functions.columns import line_key
from dockledger.functions.storage import create_once, names_in, stored, text_of
from dockledger.operators import writes
from dockledger.sources import requests
from dockledger.sources.loading import conform
from dockledger.tables import HEAVY_KEYS, LAYOUTS, SUPPLIED, TABLE_NAMES, Marks, Tables

_HEAVY_SCHEMA = "table string, columns string, key string, rows long"
_DAYS_SCHEMA = "day string, last_number long"
_RECEIPTS_SCHEMA = "receipt_no string, last_sequence long, has_header boolean"
_DELETES_SCHEMA = "receipt_no string"
_PROV = ("prov_header", "prov_line", "prov_contact")

# The supplier of a line's document, stored with the line; NULL where a line was added to a document of before.
_OWNER = "_owner"
# Rows are stored in these ranges, so that filters on suppliers and dates skip row groups.
_STORED_BY = {
    "item": ["item_code"],
    "code": ["code_group", "code"],
    "po_header": ["po_date", "po_no"],
    "po_line": [_OWNER, "po_no", "line_seq"],
    "receipt_header": ["actual_no"],
    "receipt_line": ["po_line_key", "actual_no"],
    "prov_header": ["due_date", "receipt_no"],
    "prov_line": [_OWNER, "receipt_no", "line_seq"],
    "prov_contact": ["receipt_no"],
}


@dataclass(frozen=True)
class State:
    """What a version consists of: folders by table, in the order they were stored; a folder's name has its version."""

    version: int = 0
    base: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    edits: list[str] = field(default_factory=list)
    deletes: list[str] = field(default_factory=list)
    details: list[str] = field(default_factory=list)
    rule: dict = field(default_factory=lambda: asdict(writes.NumberRule()))

    def changes(self) -> int:
        return len(self.edits) + len(self.deletes)


def _read(spark: SparkSession, root: str, name: str) -> State | None:
    """The version in a file of this name, None if it holds no whole one."""
    text = text_of(spark, f"{root}/versions/{name}")
    try:
        return State(**json.loads(text)) if text else None
    except (ValueError, TypeError):
        return None


def _numbers(spark: SparkSession, root: str) -> dict[int, str]:
    """The numbers that are taken, by whole versions or by remains, with the names that take them."""
    found = [(re.match(r"v(\d+)", name), name) for name in names_in(spark, f"{root}/versions")]
    return dict(sorted((int(match[1]), name) for match, name in found if match))


def _current(spark: SparkSession, root: str) -> tuple[State, int]:
    """The last whole version and the next free number."""
    numbers = _numbers(spark, root)
    free = max(numbers, default=0) + 1
    for number in sorted(numbers, reverse=True):
        state = _read(spark, root, numbers[number])
        if state:
            return state, free
    return State(), free


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the current version, 0 if there is none."""
    return _current(spark, root)[0].version


def _state(spark: SparkSession, root: str, version: int | None) -> State:
    if version is None:
        state = _current(spark, root)[0]
    else:
        state = _read(spark, root, f"v{version:08d}.json")
    if not state or not state.version:
        raise ValueError(f"there is no version {version} under {root}")
    return state


def load_version(spark: SparkSession, root: str, version: int | None = None) -> Tables:
    """Tables of a version, the current one by default."""
    return _load(spark, root, _state(spark, root, version))


def _load(spark: SparkSession, root: str, state: State) -> Tables:
    heavy = _heavy(spark, root, state)

    def open_table(name: str, supplier: object = None) -> DataFrame:
        paths = [f"{root}/{folder}" for folder in state.tables[name]]
        df = spark.read.schema(spark.read.parquet(paths[0]).schema).parquet(*paths)
        if supplier is not None:
            df = df.filter((F.col(_OWNER) == supplier) | F.col(_OWNER).isNull())
        if name in _PROV and state.changes():
            df = _with_changes(df, name, _changes(spark, root, state), heavy)
        df = df.drop(_OWNER)
        return df.withColumn("po_line_key", line_key("po_no", "line_seq")) if name == "po_line" else df

    sources = {name: partial(open_table, name) for name in TABLE_NAMES}
    return Tables(sources, heavy, _marks(spark, root, state), open_table)


def load_details(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """What registrations said beside the receipts' lines: see `register_receipts`. Deleted receipts keep theirs."""
    state = _state(spark, root, version)
    paths = [f"{root}/{folder}" for folder in state.details]
    if not paths:
        return spark.createDataFrame([], writes.DETAILS)
    return spark.read.schema(writes.DETAILS).parquet(*paths)


def _stored_in(df: DataFrame) -> DataFrame:
    """Adds the version that stored a row, which its folder's name tells."""
    return df.withColumn("_version", F.regexp_extract("_metadata.file_path", r"/v(\d+)-[0-9a-f]+/[^/]*$", 1).cast("int"))


def _changes(spark: SparkSession, root: str, state: State) -> tuple[DataFrame | None, DataFrame | None]:
    """The last edit of each receipt and item, and the last deletion of each receipt, with their versions."""
    latest = gone = None
    if state.edits:
        edits = _stored_in(spark.read.schema(writes.EDITS).parquet(*[f"{root}/{folder}" for folder in state.edits]))
        latest = edits.groupBy("receipt_no", "item_code").agg(F.max(F.struct("_version", "qty", "status")).alias("_edit"))
    if state.deletes:
        deletes = _stored_in(spark.read.schema(_DELETES_SCHEMA).parquet(*[f"{root}/{folder}" for folder in state.deletes]))
        gone = deletes.groupBy("receipt_no").agg(F.max("_version").alias("_deleted"))
    return latest, gone


def _with_changes(rows: DataFrame, name: str, changes: tuple[DataFrame | None, DataFrame | None], heavy: dict) -> DataFrame:
    latest, gone = changes
    columns, lines = rows.columns, name == "prov_line"
    spread = ["line_seq"] if lines else ["receipt_no"]
    rows = _stored_in(rows)
    if gone is not None:
        hot = heavy.get((name, ("receipt_no",)))
        rows = skew.skew_join(rows, gone, ["receipt_no"], spread_by=spread, hot=hot)
        rows = rows.filter(F.col("_deleted").isNull() | (F.col("_deleted") <= F.col("_version")))
    if lines and latest is not None:
        hot = heavy.get((name, ("receipt_no", "item_code")))
        rows = skew.skew_join(rows, latest, ["receipt_no", "item_code"], spread_by=spread, hot=hot)
        later = F.coalesce(F.col("_edit._version") > F.col("_version"), F.lit(False))
        rows = rows.withColumns({c: F.when(later, F.col("_edit")[c]).otherwise(F.col(c)) for c in ("qty", "status")})
    return rows.select(*columns)


def _heavy(spark: SparkSession, root: str, state: State) -> dict:
    """Heavy keys by table and columns, from the lists beside the folders; only their numbers reach the driver."""
    paths = [f"{root}/heavy/{folder}" for name in HEAVY_KEYS for folder in state.tables[name]]
    keys = spark.read.schema(_HEAVY_SCHEMA).parquet(*paths)
    keys = keys.groupBy("table", "columns", "key").agg(F.sum("rows").alias("rows"))
    found = {}
    for row in keys.groupBy("table", "columns").agg(F.count(F.lit(1)).alias("n"), F.min("rows").alias("least")).collect():
        own = keys.filter((F.col("table") == row["table"]) & (F.col("columns") == row["columns"])).select("key", "rows")
        found[row["table"], tuple(row["columns"].split(","))] = skew.HeavyKeys(own, row["n"], row["least"])
    return found


def _marks(spark: SparkSession, root: str, state: State) -> Marks:
    """High-water marks of the version: those of its folders, merged."""

    def days() -> DataFrame:
        found = spark.read.schema(_DAYS_SCHEMA).parquet(*[f"{root}/marks/days/{folder}" for folder in state.tables["prov_header"]])
        return found.groupBy("day").agg(F.max("last_number").alias("last_number"))

    def receipts() -> DataFrame:
        paths = [f"{root}/marks/receipts/{folder}" for name in ("prov_header", "prov_line") for folder in state.tables[name]]
        found = _stored_in(spark.read.schema(_RECEIPTS_SCHEMA).parquet(*paths))
        header = F.max(F.when(F.col("has_header"), F.col("_version"))).alias("_version")
        found = found.groupBy("receipt_no").agg(F.max("last_sequence").alias("last_sequence"), header)
        gone = _changes(spark, root, state)[1]
        if gone is not None:
            found = found.join(gone, "receipt_no", "left")
            kept = F.col("_deleted").isNull() | (F.col("_deleted") <= F.col("_version"))
            found = found.withColumn("_version", F.when(kept, F.col("_version")))
        return found.select("receipt_no", "last_sequence", F.col("_version").isNotNull().alias("has_header"))

    return Marks(days, receipts, writes.NumberRule(**state.rule))


def publish_version(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    root: str,
    base: int = 0,
    added: Mapping[str, DataFrame] | None = None,
    heavy_rows: int = skew.HEAVY_ROWS,
    *,
    edits: DataFrame | None = None,
    deletes: DataFrame | None = None,
    details: DataFrame | None = None,
    rule: writes.NumberRule | None = None,
) -> int:
    """Stores whole tables, added rows, edits and deletes as the version after `base` and makes it current.

    Version 1 has all tables; later ones take what they do not store from `base`, which must be the current version.
    Columns are cast to the types of the layout, keys to the type they are stored with. `rule` is the rule of the
    numbers whose marks are kept; it is told with the first version.
    """
    state, number = _current(spark, root)
    if base != state.version:
        raise ValueError(f"version {base} is not current, {state.version} is: read it and try again")
    missing = set(TABLE_NAMES) - set(state.tables) - set(tables)
    if missing:
        raise ValueError(f"version {number} would lack {sorted(missing)}")
    rule = writes.NumberRule(**state.rule) if state.version or rule is None else rule

    def folder_for(name: str) -> str:
        return f"{name}/v{number:08d}-{uuid.uuid4().hex}"

    folders = {name: list(own) for name, own in state.tables.items()}
    new = {**tables, **(added or {})}
    for name, df in new.items():
        folder = folder_for(name)
        df = conform(df, name).select(*[f.name for f in LAYOUTS[name].fields])
        if name in SUPPLIED:
            header = SUPPLIED[name][0]
            if header not in new and name in tables:
                df = _with_owner(df, name, _load(spark, root, state)[header])
            else:
                df = _with_owner(df, name, new.get(header))
        if name in state.tables:
            stored_as = spark.read.parquet(f"{root}/{state.tables[name][0]}").schema
            df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in stored_as.fields])
        ranged = df.repartitionByRange(*_STORED_BY[name]).sortWithinPartitions(*_STORED_BY[name])
        ranged.write.mode("error").parquet(f"{root}/{folder}")
        if name in HEAVY_KEYS:
            _store_heavy(spark, root, name, folder, heavy_rows)
        if name in ("prov_header", "prov_line"):
            _store_marks(spark, root, name, folder, rule)
        folders[name] = [folder] if name in tables else [*folders[name], folder]
    small = {"edits": (edits, writes.EDITS), "deletes": (deletes, _DELETES_SCHEMA), "details": (details, writes.DETAILS)}
    kept = {what: getattr(state, what) for what in small}
    if set(_PROV) <= set(tables):
        kept |= {"edits": [], "deletes": []}  # the tables are stored without what was changed
    for what, (df, _) in small.items():
        if df is not None:
            folder = folder_for(what)
            df.write.mode("error").parquet(f"{root}/{folder}")
            kept[what] = [*kept[what], folder]
    made = State(number, base, folders, **kept, rule=asdict(rule))
    if not create_once(spark, f"{root}/versions/v{number:08d}.json", json.dumps(asdict(made))):
        raise ValueError(f"version {number} was written by another writer: read it and try again")
    return number


def _with_owner(lines: DataFrame, name: str, headers: DataFrame | None) -> DataFrame:
    """Lines with the supplier of their document; NULL if there are no headers at hand, or several suppliers."""
    if headers is None:
        return lines.withColumn(_OWNER, F.lit(None).cast("string"))
    header, document = SUPPLIED[name]
    least, most = F.min("supplier_code"), F.max("supplier_code")
    owners = conform(headers, header).groupBy(document).agg(F.when(least == most, least).alias(_OWNER))
    return skew.skew_join(lines, owners, [document], spread_by=["line_seq"])


def _store_heavy(spark: SparkSession, root: str, name: str, folder: str, heavy_rows: int) -> None:
    rows = spark.read.parquet(f"{root}/{folder}")
    if name == "po_line":
        rows = rows.withColumn("po_line_key", line_key("po_no", "line_seq"))
    found = None
    for columns in HEAVY_KEYS[name]:
        keys = skew.count_heavy_keys(rows, columns, heavy_rows)
        keys = keys.select(F.lit(name).alias("table"), F.lit(",".join(columns)).alias("columns"), "key", "rows")
        found = keys if found is None else found.unionByName(keys)
    found.write.mode("error").parquet(f"{root}/heavy/{folder}")


def _store_marks(spark: SparkSession, root: str, name: str, folder: str, rule: writes.NumberRule) -> None:
    rows = spark.read.parquet(f"{root}/{folder}")
    if name == "prov_header":
        writes.last_numbers(rows, rule).write.mode("error").parquet(f"{root}/marks/days/{folder}")
        marks = rows.select("receipt_no", F.lit(0).cast("long").alias("last_sequence"), F.lit(True).alias("has_header"))
    else:
        marks = writes.last_sequences(rows).withColumn("has_header", F.lit(False))
    marks.write.mode("error").parquet(f"{root}/marks/receipts/{folder}")


def compact(spark: SparkSession, root: str, most: int = 20, heavy_rows: int = skew.HEAVY_ROWS) -> int:
    """A version in which tables of more than `most` folders are stored as one, and more than `most` folders of edits and
    deletes are worked into their tables; without such the current version."""
    state = _current(spark, root)[0]
    many = {name for name, own in state.tables.items() if len(own) > most}
    if state.changes() > most:
        many |= set(_PROV)
    if not many:
        return state.version
    t = _load(spark, root, state)
    return publish_version(spark, {name: t[name] for name in sorted(many)}, root, state.version, heavy_rows=heavy_rows)


def _require(rows: DataFrame, message: str) -> None:
    if rows.isEmpty():
        raise ValueError(message)


def _start(spark: SparkSession, root: str) -> tuple[int, Tables]:
    state = _state(spark, root, None)
    return state.version, _load(spark, root, state)


def run_register(
    spark: SparkSession, root: str, raw_requests: DataFrame, as_of: str, rule: writes.NumberRule | None = None
) -> DataFrame:
    """Registers request documents on day `as_of`: request_id, receipt_no, inserted_count, reason.

    Every request has an outcome: one that cannot be registered stores nothing, it has a reason and no receipt number.
    Without `rule` numbers follow the rule of the store; another rule has no marks, so its numbers are looked up in the headers.
    """
    base, t = _start(spark, root)
    raw = stored(raw_requests, "requests")
    rejected = requests.rejected_requests(raw).select("request_id", "reason")
    items = stored(requests.explode_requests(requests.accepted_requests(raw)), "requested-items")
    _require(items, "no items to register")
    hot = writes.heavy_registrations(items)
    new = writes.register_receipts(t, items, rule or t.marks.rule, as_of=as_of, hot=hot, settle=True)
    new = new.settled()  # headers, lines, contacts and answers must agree on the numbers given
    if not new.summary.isEmpty():
        added = {"prov_header": new.headers, "prov_line": new.lines, "prov_contact": new.contacts}
        publish_version(spark, {}, root, base, added, details=new.details)
    return stored(outcomes(new, rejected), "registered")


def outcomes(new: writes.Registration, rejected: DataFrame) -> DataFrame:
    """One row a request: request_id, receipt_no, inserted_count, and the reason if it was refused."""
    accepted = new.summary.withColumn("reason", F.lit(None).cast("string"))
    none, zero = F.lit(None).cast("string").alias("receipt_no"), F.lit(0).cast("long").alias("inserted_count")
    refused = rejected.unionByName(new.rejected).select("request_id", none, zero, "reason")
    return accepted.unionByName(refused)


def run_edit(spark: SparkSession, root: str, edits: DataFrame) -> DataFrame:
    """Applies edits; returns the number of updates per receipt. Stores no more than the edits themselves.

    An edit without receipt, item, quantity or status would overwrite data with nothing: then all are refused.
    """
    edits = stored(edits, "edits")
    _require(edits, "no items to edit")
    unfit = writes.unfit_edits(edits).first()
    if unfit:
        raise ValueError(f"edit of receipt {unfit['receipt_no']!r}, item {unfit['item_code']!r}: no {unfit['lacks']}")
    base, t = _start(spark, root)
    publish_version(spark, {}, root, base, edits=writes.latest_edits(edits))
    return writes.edit_match_count(t, edits)


def run_edit_documents(spark: SparkSession, root: str, raw_edits: DataFrame) -> DataFrame:
    """Applies edit documents (request_id, receipt_no, payload): request_id, receipt_no, updated_count, reason.

    Every document has an outcome; one that is refused changes nothing.
    """
    raw = stored(raw_edits, "edit-documents")
    accepted = stored(requests.explode_edits(requests.accepted_edits(raw)), "edits")
    if not accepted.isEmpty():
        base, t = _start(spark, root)
        publish_version(spark, {}, root, base, edits=writes.latest_edits(accepted))
    else:
        _, t = _start(spark, root)
    return stored(edit_outcomes(t, accepted, requests.rejected_edits(raw)), "edited")


def edit_outcomes(t: Tables, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row a document, from the lines before the edits."""
    by = F.col("seq.request_id").alias("request_id")
    counted = writes.edit_match_count(t, accepted.select("*", by), ["request_id"])
    counted = counted.select("request_id", "receipt_no", "updated_count", F.lit(None).cast("string").alias("reason"))
    refused = rejected.select("request_id", "receipt_no", F.lit(0).cast("long").alias("updated_count"), "reason")
    return counted.unionByName(refused)


def run_delete(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """Deletes receipts; returns how many ids were sent and how many receipts existed. Stores the ids only."""
    ids = stored(ids, "deletes")
    _require(ids, "no receipts to delete")
    base, t = _start(spark, root)
    publish_version(spark, {}, root, base, deletes=writes.deleted_numbers(ids))
    return writes.delete_counts(t, ids)

