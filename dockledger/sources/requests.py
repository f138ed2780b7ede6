"""Request documents: registrations, edits and deletes as JSON with an array of items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.functions.columns import CLOSED, business_date, client_address, text_or, typed_quantity

DEFAULT_STORE = "E010"

# Field names of the request documents.
REQUEST_SCHEMA = T.StructType([
    T.StructField("ipgoNumb", T.StringType()),
    T.StructField("ipgoDate", T.StringType()),
    T.StructField("custCode", T.StringType()),
    T.StructField("userName", T.StringType()),
    T.StructField("ordrNumb", T.StringType()),
    T.StructField("teleNumb", T.StringType()),
    T.StructField("storCode", T.StringType()),
    T.StructField("memoXxxx", T.StringType()),
    T.StructField("statType", T.StringType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("itemCode", T.StringType()),
        T.StructField("ordrDetl", T.StringType()),
        T.StructField("gaipQnty", T.StringType()),  # numbers may be sent as text
        T.StructField("gaipYmmm", T.StringType()),
        T.StructField("memoXxxx", T.StringType()),
    ]))),
])

EDIT_SCHEMA = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("itemCode", T.StringType()),
        T.StructField("gaipQnty", T.StringType()),
        T.StructField("statType", T.StringType()),
    ]))),
])
DELETE_SCHEMA = T.StructType([T.StructField("ipgoNumbs", T.ArrayType(T.StringType()))])
# Fields that a registration must have, in the document and in each item.
REQUIRED = ["ipgoDate", "custCode", "userName", "ordrNumb"]
REQUIRED_IN_ITEM = ["itemCode", "ordrDetl", "gaipQnty"]
REQUIRED_IN_EDIT = ["itemCode", "gaipQnty", "statType"]


def _parsed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("request", F.from_json("payload", REQUEST_SCHEMA))


def _lacks(name: str) -> Callable[[Column], Column]:
    """Whether an item has no such field; a line without order line is sent with an empty text for it."""
    if name == "ordrDetl":
        return lambda item: item.isNull() | item[name].isNull()
    return lambda item: item.isNull() | F.coalesce(F.trim(item[name]) == "", F.lit(True))


def _unreadable() -> Column:
    return F.col("payload").isNull() | F.try_parse_json("payload").isNull()


def _items_reason(reason: Column, items: Column, required: list[str]) -> Column:
    """Adds the reasons that lie in the items of a document."""
    reason = reason.when(items.isNull(), F.lit("no items")).when(F.size(items) == 0, F.lit("empty items"))
    for name in required:
        reason = reason.when(F.exists(items, _lacks(name)), F.lit(f"item without {name}"))
    return reason.when(F.exists(items, lambda item: typed_quantity(item["gaipQnty"]).isNull()), F.lit("quantity is no number"))


def _reason() -> Column:
    """Why the parsed request cannot be registered; NULL if it can."""
    reason = F.when(_unreadable(), F.lit("unreadable document"))
    for name in REQUIRED:
        reason = reason.when(F.col(f"request.{name}").isNull(), F.lit(f"no {name}"))
    reason = _items_reason(reason, F.col("request.items"), REQUIRED_IN_ITEM)
    return reason.when(business_date(F.col("request.ipgoDate")).isNull(), F.lit("ipgoDate is no date"))


def accepted_requests(raw: DataFrame) -> DataFrame:
    """The requests that can be registered, as they came."""
    return _parsed(raw).filter(_reason().isNull()).select(*raw.columns)


def rejected_requests(raw: DataFrame) -> DataFrame:
    """The others: request_id, payload and the first reason that holds."""
    return _parsed(raw).select("request_id", "payload", _reason().alias("reason")).filter(F.col("reason").isNotNull())


def explode_requests(raw: DataFrame) -> DataFrame:
    """One row per requested item, from rows of `request_id`, `payload` and, where
    known, `forwarded_for` and `peer`. The item's own memo is ignored, the header's counts."""
    request, item = F.col("request"), F.col("item")
    forwarded = F.col("forwarded_for") if "forwarded_for" in raw.columns else F.lit(None).cast("string")
    peer = F.col("peer") if "peer" in raw.columns else F.lit(None).cast("string")
    items = _parsed(raw).select("*", F.posexplode("request.items").alias("position", "item"))
    return items.select(
        "request_id",
        (F.col("position") + 1).alias("seq"),
        F.trim(F.coalesce(request["ipgoNumb"], F.lit(""))).alias("receipt_no"),
        request["ipgoDate"].alias("due_date"),
        request["custCode"].alias("supplier_code"),
        request["userName"].alias("contact_name"),
        text_or(request["teleNumb"], "").alias("contact_phone"),
        text_or(request["storCode"], DEFAULT_STORE).alias("store_code"),
        text_or(request["memoXxxx"], "").alias("memo"),
        F.trim(request["ordrNumb"]).alias("po_no"),
        text_or(request["statType"], CLOSED).alias("status"),
        item["itemCode"].alias("item_code"),
        F.trim(item["ordrDetl"]).alias("po_line_key"),
        typed_quantity(item["gaipQnty"]).alias("qty"),
        text_or(item["gaipYmmm"], "").alias("month"),
        client_address(forwarded, peer).alias("client_address"),
    )


def _checked_edits(raw: DataFrame) -> DataFrame:
    """Edit documents with `request` and the first reason why one cannot be applied, NULL if it can."""
    parsed = raw.withColumn("request", F.from_json("payload", EDIT_SCHEMA))
    reason = F.when(_unreadable(), F.lit("unreadable document"))
    reason = reason.when(F.coalesce(F.trim("receipt_no") == "", F.lit(True)), F.lit("no receipt number"))
    return parsed.withColumn("reason", _items_reason(reason, F.col("request.items"), REQUIRED_IN_EDIT))


def accepted_edits(raw: DataFrame) -> DataFrame:
    """The edit documents that can be applied, as they came."""
    return _checked_edits(raw).filter(F.col("reason").isNull()).select(*raw.columns)


def rejected_edits(raw: DataFrame) -> DataFrame:
    """The others: request_id, receipt_no and the first reason that holds. One unfit item refuses its document."""
    return _checked_edits(raw).filter(F.col("reason").isNotNull()).select("request_id", "receipt_no", "reason")


def explode_edits(raw: DataFrame) -> DataFrame:
    """One row per edited item, from rows of `request_id`, `receipt_no` (the document is sent to its address) and
    `payload`. `seq` orders all edits: by request, then by place in the document, so later ones win."""
    parsed = raw.withColumn("request", F.from_json("payload", EDIT_SCHEMA))
    items = parsed.select("request_id", "receipt_no", F.posexplode("request.items").alias("position", "item"))
    item = F.col("item")
    return items.select(
        F.struct("request_id", F.col("position").alias("position")).alias("seq"),
        F.trim("receipt_no").alias("receipt_no"),
        F.trim(item["itemCode"]).alias("item_code"),
        typed_quantity(item["gaipQnty"]).alias("qty"),
        item["statType"].alias("status"),
    )


def _checked_deletes(raw: DataFrame) -> DataFrame:
    numbers = F.from_json("payload", DELETE_SCHEMA)["ipgoNumbs"]
    reason = F.when(_unreadable(), F.lit("unreadable document")).when(numbers.isNull(), F.lit("no receipt numbers"))
    reason = reason.when(F.size(numbers) == 0, F.lit("empty receipt numbers"))
    blank = F.exists(numbers, lambda x: F.coalesce(F.trim(x) == "", F.lit(True)))
    return raw.withColumn("reason", reason.when(blank, F.lit("blank receipt number")))


def accepted_deletes(raw: DataFrame) -> DataFrame:
    """The delete documents that can be applied, as they came."""
    return _checked_deletes(raw).filter(F.col("reason").isNull()).select(*raw.columns)


def rejected_deletes(raw: DataFrame) -> DataFrame:
    """The others: request_id and the first reason that holds."""
    return _checked_deletes(raw).filter(F.col("reason").isNotNull()).select("request_id", "reason")


def explode_deletes(raw: DataFrame) -> DataFrame:
    """One row per receipt number in delete documents: rows of `request_id` and `payload`."""
    numbers = F.from_json("payload", DELETE_SCHEMA)["ipgoNumbs"]
    return raw.select("request_id", F.posexplode(numbers).alias("position", "receipt_no"))
