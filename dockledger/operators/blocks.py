"""Building blocks of the queries: document roll-ups, quantities, code names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockledger.functions.columns import OPEN, rolled_status
from dockledger.functions.skew import STAND_INS, HeavyKeys, skew_join
from dockledger.tables import QUANTITY, Tables, no_quantity

# Code groups and the item types that are bought.
ITEM_TYPE_GROUP = "item_gubn"
UNIT_GROUP = "qnty_code"
BOUGHT_TYPES = "2"

CODE_SALTS = 256  # tasks over which the rows of one code spread


def number_order(column: str) -> list[Column]:
    """Order of numbers kept as text: by length, then as text, so 10000 comes after 9999."""
    return [F.length(column), F.col(column)]


def code_by_group(t: Tables, group: str) -> DataFrame:
    """Codes of one group; the group's name is compared without regard to case."""
    return t.code.filter(F.lower("code_group") == group.lower()).select("code", "name")


def with_code_name(df: DataFrame, codes: DataFrame, code: str, spread_by: str) -> DataFrame:
    """Left join with a code list on a column of few values; each code's rows are dealt over many tasks.

    The list goes to each of them: it has a row for each code of one group.
    """
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(CODE_SALTS)).cast("int"))
    every = codes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(CODE_SALTS - 1))))
    return dealt.join(every, [code, "_salt"], "left").drop("_salt")


def item_with_unit(t: Tables, type_prefix: str = BOUGHT_TYPES) -> DataFrame:
    """Items of the bought types with their unit: its name, or its code where it has none."""
    units = code_by_group(t, UNIT_GROUP).select(F.col("code").alias("unit_code"), F.col("name").alias("unit_name"))
    items = with_code_name(t.item.filter(F.col("item_type").startswith(type_prefix)), units, "unit_code", "item_code")
    return items.select(
        "item_code", "part_no", "item_name", "item_group", F.coalesce("unit_name", "unit_code").alias("unit")
    )


def trim_join_items(
    df: DataFrame, column: str, t: Tables, *, spread_by: list[str], hot: HeavyKeys | None = None
) -> DataFrame:
    """Adds the name of the item whose code equals the column, blanks around both ignored."""
    names = t.item.select(F.trim("item_code").alias("_item"), "item_name")
    coded = df.withColumn("_item", F.trim(F.col(column)))
    return skew_join(coded, names, ["_item"], spread_by=spread_by, hot=hot and hot.trimmed()).drop("_item")


def first_item(lines: DataFrame, document: str, *extra: str) -> DataFrame:
    """Per document its first line's item (by sequence), line count and rolled status.

    `extra` names further columns to take from the first line. The smallest
    (sequence, item, ...) struct is a partial aggregate: no document is ever sorted
    or held in one task.
    """
    first = F.min(F.struct(F.length("line_seq").alias("digits"), "line_seq", "item_code", *extra)).alias("first")
    rolled = lines.groupBy(document).agg(
        first, F.count(F.lit(1)).alias("line_count"), rolled_status("status").alias("status")
    )
    return rolled.select(
        document,
        F.col("first.item_code").alias("first_item_code"),
        *[F.col(f"first.{name}").alias(name) for name in extra],
        "line_count",
        "status",
    )


def status_rollup(lines: DataFrame, document: str) -> DataFrame:
    return lines.groupBy(document).agg(rolled_status("status").alias("status"))


def ordered_qty(po_lines: DataFrame) -> DataFrame:
    """Ordered quantity per PO line and item; a missing quantity counts as 0."""
    return po_lines.groupBy("po_line_key", "item_code").agg(
        F.sum(F.coalesce("qty", no_quantity())).alias("ordered_qty")
    )


def received_qty(receipt_lines: DataFrame) -> DataFrame:
    return receipt_lines.groupBy("po_line_key", "item_code").agg(
        F.sum(F.coalesce("qty", no_quantity())).alias("received_qty")
    )


def po_line_balance(po_lines: DataFrame, receipt_lines: DataFrame) -> DataFrame:
    """Ordered, received and outstanding quantity per PO line and item.

    Receipts of another item do not count; outstanding is negative after over-delivery.
    """
    both = ordered_qty(po_lines).join(received_qty(receipt_lines), ["po_line_key", "item_code"], "left")
    received = F.coalesce("received_qty", no_quantity())
    return both.select(
        "po_line_key",
        "item_code",
        "ordered_qty",
        received.alias("received_qty"),
        (F.col("ordered_qty") - received).alias("outstanding_qty"),
    )


def cumulative_provisional(prov_lines: DataFrame) -> DataFrame:
    """Provisional quantity per PO line key and item, of all lines and of the open ones.

    The open quantity is NULL, not 0, where no line is open. Hand-added lines share
    the blank key and add up per item.
    """
    qty = F.coalesce("qty", no_quantity())
    return prov_lines.groupBy("po_line_key", "item_code").agg(
        F.sum(qty).alias("provisional_qty"),
        F.sum(F.when(F.col("status") == OPEN, qty)).alias("open_provisional_qty"),
    )


def quantities(po_lines: DataFrame, receipt_lines: DataFrame, prov_lines: DataFrame) -> DataFrame:
    """Ordered, received, outstanding and provisional quantities per PO line key and item, in one pass over all lines.

    The three kinds of lines are one union and one aggregate, so they are shuffled once, by key and item, already added
    up in each task. `ordered_qty` is NULL where no PO line has the key and item, the provisional quantities as in
    `cumulative_provisional`.
    """

    def tagged(lines: DataFrame, column: str) -> DataFrame:
        qty = F.coalesce("qty", no_quantity())
        parts = {"ordered": F.lit(None), "received": F.lit(None), "provisional": F.lit(None), "open": F.lit(None)} | {column: qty}
        if column == "provisional":
            parts["open"] = F.when(F.col("status") == OPEN, qty)
        return lines.select("po_line_key", "item_code", *[x.cast(QUANTITY).alias(c) for c, x in parts.items()])

    every = tagged(po_lines, "ordered").unionByName(tagged(receipt_lines, "received")).unionByName(tagged(prov_lines, "provisional"))
    added = every.groupBy("po_line_key", "item_code").agg(*[F.sum(c).alias(c) for c in ("ordered", "received", "provisional", "open")])
    received = F.coalesce(F.when(F.col("item_code").isNotNull(), F.col("received")), no_quantity())
    return added.select(
        "po_line_key",
        "item_code",
        F.col("ordered").alias("ordered_qty"),
        received.alias("received_qty"),
        (F.col("ordered") - received).alias("outstanding_qty"),
        F.col("provisional").alias("provisional_qty"),
        F.col("open").alias("open_provisional_qty"),
    )


# Kinds of lines that meet by key: shown only, and those whose quantity is ordered, received or announced.
SHOWN, ORDERED, RECEIVED, ANNOUNCED = range(4)


def meeting_key() -> Column:
    """Key by which lines of all kinds meet. Hand-added lines share the blank key: they meet by item."""
    return F.when(F.col("po_line_key") == "", F.concat(F.lit("\u0000"), F.coalesce("item_code", F.lit("")))).otherwise(F.col("po_line_key"))


def met_key(key: str) -> Column:
    """The key of a line of an order from the one by which it met."""
    return F.when(F.col(key).startswith("\u0000"), "").otherwise(F.col(key))


def tagged(lines: DataFrame, kind: int, no_item: bool = False) -> DataFrame:
    """Lines as `meet` takes them. Without a key they count nowhere, without an item only if `no_item` says so."""
    counted = lines if no_item else lines.filter(F.col("item_code").isNotNull())
    spread = F.concat(F.lit("\u0000\u0000"), F.pmod(F.xxhash64("item_code", "qty"), F.lit(STAND_INS)).cast("string"))
    return counted.select(F.coalesce(meeting_key(), spread).alias("_line_key"), "item_code", "qty", F.lit(kind).alias("_kind"))


def meet(lines: DataFrame, key: str) -> DataFrame:
    """Lines of all kinds with `balances` of their key, one for each item ordered under it, and the quantity `announced`
    of key and item, NULL where there is none.

    The key is all they are shuffled by. Receipts of another item do not count.
    """
    qty = F.coalesce("qty", no_quantity())
    of_item, of_key = Window.partitionBy(key, "item_code"), Window.partitionBy(key)
    added = {kind: F.sum(F.when(F.col("_kind") == kind, qty)).over(of_item) for kind in (ORDERED, RECEIVED, ANNOUNCED)}
    rows = lines.repartition(key).select("*", *[added[k].alias(f"_added_{k}") for k in added])
    ordered, received = F.col(f"_added_{ORDERED}"), F.coalesce(f"_added_{RECEIVED}", no_quantity())
    balance = F.struct(
        "item_code", ordered.alias("ordered_qty"), received.alias("received_qty"), (ordered - received).alias("outstanding_qty")
    )
    # The lines of one item have equal balances: as a set, each is there once.
    balances = F.collect_set(F.when(F.col("_kind") == ORDERED, balance)).over(of_key)
    rows = rows.select("*", balances.alias("_balances"))
    balances = F.transform("_balances", lambda x: F.struct(*[x[c].alias(c) for c in ("ordered_qty", "received_qty", "outstanding_qty")]))
    return rows.select(*lines.columns, balances.alias("balances"), F.col(f"_added_{ANNOUNCED}").alias("announced"))
