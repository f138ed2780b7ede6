"""The write flows as set operations: new rows, changed rows, remaining rows.

Functions read one table version; `dockledger.plans.versions` stores the result as the
next one. They are lazy, but for numbering in groups that are heavy (see `number_within`).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.functions.columns import business_date
from dockledger.functions import skew
from dockledger.functions.skew import HeavyKeys, number_within, skew_join
from dockledger.functions.storage import stored
from dockledger.tables import Tables


@dataclass(frozen=True)
class NumberRule:
    """Receipt numbers: prefix, day, running number of the day with at least `digits` digits."""

    prefix: str = "G"
    day_format: str = "yyMMdd"
    digits: int = 4


_NEW_LINE = ["receipt_no", "line_seq", "po_line_key", "item_code", "qty", "status", "updated_on"]
#: What a registration says beside the lines; kept with the version that stores them.
DETAILS = (
    "receipt_no string, line_seq string, request_id string, po_no string, store_code string, memo string, month string, "
    "client_address string"
)
EDITS = "receipt_no string, item_code string, qty double, status string"


@dataclass(frozen=True)
class Registration:
    """Rows to add to the tables, number and line count per request, and requests that cannot be registered."""

    registered: DataFrame
    created: DataFrame
    summary: DataFrame
    rejected: DataFrame

    @property
    def lines(self) -> DataFrame:
        return self.registered.select(*_NEW_LINE)

    @property
    def details(self) -> DataFrame:
        return self.registered.select(*[name.split()[0] for name in DETAILS.split(", ")])

    @property
    def headers(self) -> DataFrame:
        return self.created.select("receipt_no", "supplier_code", "saved_on", "due_date")

    @property
    def contacts(self) -> DataFrame:
        return self.created.select("receipt_no", "contact_name", "contact_phone")

    def settled(self) -> Registration:
        """The same, stored: all that is read from it agrees."""
        parts = {name: stored(getattr(self, name), f"registered-{name}") for name in ("registered", "created", "summary", "rejected")}
        return Registration(**parts)


_SAID = ["po_no", "store_code", "memo", "month", "client_address"]
_KEYS = {"owner": ["owner"], "request": ["request_id"], "day": ["day"]}


def register_receipts(
    t: Tables,
    registrations: DataFrame,
    rule: NumberRule = NumberRule(),
    *,
    as_of: dt.date | str,
    hot: dict[str, HeavyKeys] | None = None,
    settle: bool = False,
) -> Registration:
    """Registers requests given as one row per item (see `explode_requests`).

    A request without receipt number gets the next free number of its due day, in
    the order of request ids; one with a number adds lines to that receipt. Line
    sequences continue after the receipt's last one. A request with a due date that is
    none, or with a line without item or quantity, is rejected as a whole: no receipt
    without a number can arise. `as_of` is the day of saving; `hot` the heavy keys of
    the registrations (see `heavy_registrations`). `settle` stores the requests before and after they are numbered,
    so that they are grouped and numbered once; without, the result is lazy, but for the receipts that requests add to
    where the tables have no marks.
    """
    hot = hot or {}
    keep = stored if settle else lambda df, _: df
    hot_owners, hot_requests, hot_days = (hot.get(k) for k in _KEYS)
    items = _with_keys(registrations, rule)

    head = ["receipt_no", "day", "due_date", "supplier_code", "contact_name", "contact_phone"]
    no_day, no_line = F.col("day").isNull(), F.col("qty").isNull() | F.coalesce(F.col("item_code") == "", F.lit(True))
    requests = items.groupBy("request_id").agg(
        F.min(F.struct("seq", *head)).alias("head"),
        F.count(F.lit(1)).alias("line_count"),
        F.max(no_day).alias("no_day"),
        F.max(no_line).alias("no_line"),
    )
    reason = F.when(F.col("no_day"), F.lit("due date")).when(F.col("no_line"), F.lit("item or quantity"))
    requests = requests.select("request_id", "line_count", reason.alias("reason"), *[F.col(f"head.{c}").alias(c) for c in head])
    requests = keep(requests, "checked-requests")
    rejected = requests.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    requests = requests.filter(F.col("reason").isNull()).drop("reason")

    new = requests.filter(F.col("receipt_no") == "").drop("receipt_no")
    new = number_within(new, ["day"], ["request_id"], "nth", hot=hot_days)
    new = skew_join(new, _last_numbers(t, rule), ["day"], spread_by=["request_id"], hot=hot_days)
    running = F.coalesce("last_number", F.lit(0)) + F.col("nth")
    number = F.concat(F.lit(rule.prefix), F.col("day"), F.format_string(f"%0{rule.digits}d", running))
    new = new.withColumn("receipt_no", number).drop("nth", "last_number")
    requests = keep(new.withColumn("known", F.lit(False)).unionByName(requests.filter(F.col("receipt_no") != "").withColumn("known", F.lit(True))), "numbered-requests")
    new, known = requests.filter(~F.col("known")).drop("known"), requests.filter("known").drop("known")

    numbers = requests.select("request_id", F.col("receipt_no").alias("number"))
    lines = skew_join(items.drop("receipt_no"), numbers, ["request_id"], "inner", spread_by=["seq"], hot=hot_requests)
    lines = number_within(lines, ["owner"], ["request_id", "seq", "item_code", "po_line_key", "qty"], "nth", hot=hot_owners)
    last = _last_sequences(t, known).select(F.concat(F.lit("R"), F.col("receipt_no")).alias("owner"), "last_sequence")
    lines = skew_join(lines, last, ["owner"], spread_by=["request_id", "seq"], hot=hot_owners)
    lines = lines.withColumnRenamed("number", "receipt_no")
    sequence = F.coalesce("last_sequence", F.lit(0)) + F.col("nth")
    lines = lines.select(
        "receipt_no",
        F.format_string("%04d", sequence).alias("line_seq"),
        "po_line_key",
        "item_code",
        "qty",
        "status",
        F.lit(None).cast("date").alias("updated_on"),
        F.col("request_id").cast("string").alias("request_id"),
        *[(F.col(c) if c in lines.columns else F.lit(None)).cast("string").alias(c) for c in _SAID],
    )

    # A receipt that requests add to exists already, or is created by the first of them.
    first = F.min_by(F.struct("due_date", "supplier_code", "contact_name", "contact_phone"), "request_id")
    created = known.groupBy("receipt_no").agg(first.alias("head")).select("receipt_no", "head.*")
    there = t.marks.receipts().filter("has_header") if t.marks else t.prov_header
    created = created.join(there.select("receipt_no"), "receipt_no", "left_anti")
    created = created.unionByName(new.select(*created.columns))
    supplier = F.col("supplier_code").cast(t.prov_header.schema["supplier_code"].dataType)
    created = created.select(
        "receipt_no", supplier.alias("supplier_code"), F.lit(as_of).cast("date").alias("saved_on"),
        business_date("due_date").alias("due_date"), "contact_name", "contact_phone",
    )
    summary = requests.select("request_id", "receipt_no", F.col("line_count").alias("inserted_count"))
    return Registration(lines, created, summary, rejected)


def _with_keys(registrations: DataFrame, rule: NumberRule) -> DataFrame:
    owner = F.when(F.col("receipt_no") != "", F.concat(F.lit("R"), F.col("receipt_no"))).otherwise(
        F.concat(F.lit("Q"), F.col("request_id").cast("string"))
    )
    items = registrations.withColumn("receipt_no", F.trim(F.coalesce("receipt_no", F.lit(""))))
    day = F.date_format(business_date("due_date"), rule.day_format)
    return items.withColumn("owner", owner).withColumn("day", day)


def heavy_registrations(
    registrations: DataFrame, rule: NumberRule = NumberRule(), heavy_rows: int = skew.HEAVY_ROWS
) -> dict[str, HeavyKeys]:
    """Heavy owners, requests and days of stored registrations; one exact pass over them, none over the tables."""
    items, found = _with_keys(registrations, rule), {}
    for name, columns in _KEYS.items():
        keys = stored(skew.count_heavy_keys(items, columns, heavy_rows), f"heavy-{name}")
        count, least = keys.agg(F.count(F.lit(1)), F.min("rows")).first()
        if count:
            found[name] = HeavyKeys(keys, count, least)
    return found


def last_numbers(headers: DataFrame, rule: NumberRule) -> DataFrame:
    """Highest running number in use per day."""
    start = len(rule.prefix) + 1
    day_length = len(rule.day_format)
    used = headers.filter(F.col("receipt_no").startswith(rule.prefix)).select(
        F.substring("receipt_no", start, day_length).alias("day"),
        F.expr(f"substring(receipt_no, {start + day_length})").try_cast("long").alias("number"),
    )
    return used.groupBy("day").agg(F.max("number").alias("last_number"))


def last_sequences(lines: DataFrame) -> DataFrame:
    """Highest line sequence per receipt."""
    return lines.groupBy("receipt_no").agg(F.max(F.col("line_seq").try_cast("long")).alias("last_sequence"))


def _last_numbers(t: Tables, rule: NumberRule) -> DataFrame:
    return t.marks.days() if t.marks and t.marks.rule == rule else last_numbers(t.prov_header, rule)


def _last_sequences(t: Tables, known: DataFrame) -> DataFrame:
    """Highest line sequence of the receipts that requests add to."""
    wanted = known.select("receipt_no").distinct()
    if t.marks:
        return t.marks.receipts().join(wanted, "receipt_no", "left_semi").select("receipt_no", "last_sequence")
    # Settled: where requests add to no receipt no line is read, and where they add to few the lines are not shuffled.
    wanted = stored(wanted, "continued-receipts")
    if wanted.isEmpty():
        return wanted.select("receipt_no", F.lit(None).cast("long").alias("last_sequence"))
    hot = t.hot("prov_line", "receipt_no")
    return last_sequences(skew_join(t.prov_line, wanted, ["receipt_no"], "left_semi", spread_by=["line_seq"], hot=hot))


def with_registration(t: Tables, new: Registration) -> Tables:
    return t.changed(
        prov_header=t.prov_header.unionByName(new.headers),
        prov_line=t.prov_line.unionByName(new.lines),
        prov_contact=t.prov_contact.unionByName(new.contacts),
    )


_LINE = ["receipt_no", "item_code"]


def _clean_edits(edits: DataFrame) -> DataFrame:
    return edits.withColumns({name: F.trim(F.col(name)) for name in _LINE})


def latest_edits(edits: DataFrame) -> DataFrame:
    """The edit that counts of each receipt and item: the last by `seq`."""
    edit = F.max(F.struct("seq", "qty", "status")).alias("edit")
    return _clean_edits(edits).groupBy(*_LINE).agg(edit).select(*_LINE, "edit.qty", "edit.status")


def unfit_edits(edits: DataFrame) -> DataFrame:
    """Edits that would overwrite data with nothing, and what they lack."""
    lacks = F.lit(None).cast("string")
    for name in ("status", "qty", "item_code", "receipt_no"):
        none = F.col(name).isNull() if name == "qty" else F.coalesce(F.trim(name) == "", F.lit(True))
        lacks = F.when(none, F.lit(name)).otherwise(lacks)
    return edits.select("receipt_no", "item_code", lacks.alias("lacks")).filter(F.col("lacks").isNotNull())


def edit_receipt_lines(t: Tables, edits: DataFrame) -> DataFrame:
    """All provisional lines after the edits: quantity and status by receipt and item.

    Every line of that item changes. Of several edits of one item the last (by `seq`)
    wins. The update date stays as it is.
    """
    latest = latest_edits(edits).select(*_LINE, F.struct("qty", "status").alias("edit"))
    lines = skew_join(t.prov_line, latest, _LINE, spread_by=["line_seq"], hot=t.hot("prov_line", *_LINE))
    edited = F.col("edit").isNotNull()
    return lines.withColumns(
        {name: F.when(edited, F.col("edit")[name]).otherwise(F.col(name)) for name in ("qty", "status")}
    ).drop("edit").select(*t.prov_line.columns)


def edit_match_count(t: Tables, edits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lines changed per receipt (and further columns), counted once for every edit that matches them."""
    sent = _clean_edits(edits).groupBy(*by, *_LINE).agg(F.count(F.lit(1)).alias("edits"))
    lines = t.prov_line.select("line_seq", *_LINE)
    hot = t.hot("prov_line", *_LINE)
    wanted = sent.select(*_LINE).distinct() if by else sent.select(*_LINE)
    lines = skew_join(lines, wanted, _LINE, "left_semi", spread_by=["line_seq"], hot=hot)
    matched = lines.groupBy(*_LINE).agg(F.count(F.lit(1)).alias("lines"))
    counted = sent.join(matched, _LINE, "left")
    updates = F.sum(F.col("edits") * F.coalesce("lines", F.lit(0)))
    return counted.groupBy(*by, "receipt_no").agg(updates.alias("updated_count"))


def deleted_numbers(ids: DataFrame) -> DataFrame:
    return ids.select(F.rtrim("receipt_no").alias("receipt_no")).distinct()


def delete_receipts(t: Tables, ids: DataFrame) -> Tables:
    """Tables without the lines, contacts and headers of the given receipts (column `receipt_no`)."""
    gone = deleted_numbers(ids)
    hot = t.hot("prov_line", "receipt_no")
    return t.changed(
        prov_line=skew_join(t.prov_line, gone, ["receipt_no"], "left_anti", spread_by=["line_seq"], hot=hot),
        prov_contact=t.prov_contact.join(gone, "receipt_no", "left_anti"),
        prov_header=t.prov_header.join(gone, "receipt_no", "left_anti"),
    )


def delete_counts(t: Tables, ids: DataFrame) -> DataFrame:
    """How many ids were sent, which is what a caller is told, and how many receipts existed."""
    known = t.prov_header.select("receipt_no").distinct().withColumn("known", F.lit(1))
    sent = ids.groupBy(F.rtrim("receipt_no").alias("receipt_no")).agg(F.count(F.lit(1)).alias("sent")).join(known, "receipt_no", "left")
    return sent.agg(
        F.coalesce(F.sum("sent"), F.lit(0)).alias("deleted_count"),
        F.count("known").alias("found_count"),
    )
