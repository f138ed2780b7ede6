"""The logical tables derived from the `part`, `orders` and `lineitem` test data."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dockledger.functions import skew
from dockledger.functions.columns import line_key
from dockledger.functions.storage import stored
from dockledger.tables import QUANTITY, TABLE_NAMES, Tables

# Item type and unit codes of the test data, with their names.
ITEM_TYPES = {"ECONOMY": "21", "STANDARD": "22", "PROMO": "23", "SMALL": "29", "MEDIUM": "11", "LARGE": "11"}
ITEM_TYPE_NAMES = {"11": "product", "21": "raw", "22": "sub", "23": "pack"}
UNIT_NAMES = {"Q1": "EA", "Q2": "KG"}


def _padded(number: Column, digits: int) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)


def _po_no(order_key: str) -> Column:
    return F.concat(F.lit("S"), _padded(F.col(order_key), 10))


def _item_code(part_key: Column) -> Column:
    return F.concat(F.lit("P"), _padded(part_key, 9))


def _mapped(column: str, mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[F.col(column)]


def _codes(item: DataFrame, group: str, column: str, names: dict[str, str]) -> DataFrame:
    used = item.select(F.col(column).alias("code")).filter(F.col("code").isin(list(names))).distinct()
    return used.select(F.lit(group).alias("code_group"), "code", _mapped("code", names).alias("name"))


def _line_key() -> Column:
    return F.concat(_po_no("l_orderkey"), _padded(F.col("l_linenumber"), 4))


# What is read of a line's status and return flag, as bits beside its number in the order.
_RECEIVED, _RETURNED, _ACCEPTED = 1, 2, 4
_NO_NUMBER = 1 << 40


def _place() -> Column:
    bits = {_RECEIVED: F.col("l_linestatus") == "F", _RETURNED: F.col("l_returnflag") == "R", _ACCEPTED: F.col("l_returnflag") == "A"}
    state = sum((F.when(holds, bit).otherwise(0) for bit, holds in bits.items()), F.lit(0))
    return F.coalesce(F.col("l_linenumber").cast("long"), F.lit(_NO_NUMBER)) * 8 + state


def _is(bit: int) -> Column:
    return F.col("place").bitwiseAND(bit) != 0


def _numbered(lines: DataFrame) -> DataFrame:
    number = F.shiftright("place", 3)
    return lines.withColumn("l_linenumber", F.when(number != _NO_NUMBER, number))


def _delivered_item() -> Column:
    """A returned line was delivered with another part than ordered."""
    return _item_code(F.when(_is(_RETURNED), F.col("l_partkey")).otherwise(F.coalesce("other_part", "l_partkey")))


def _actual_no() -> Column:
    return F.concat(F.lit("I"), _padded(F.col("l_suppkey"), 6))


def _receipt_no(customer: Column, year: Column) -> Column:
    return F.concat(F.lit("G"), _padded(customer, 6), year.cast("string"))


_SHIPMENT_ID = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


class _Sample:
    """One folder of test data; every method derives one table or a shared step."""

    def __init__(self, spark: SparkSession, sf_dir: str, again: str = "") -> None:
        self.spark, self.sf_dir, self.again = spark, sf_dir, (again,) if again else ()

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def part(self) -> DataFrame:
        return self._read("part")

    @cached_property
    def orders(self) -> DataFrame:
        return self._read("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self._read("lineitem")

    def item(self) -> DataFrame:
        size = F.col("p_size")
        return self.part.select(
            _item_code(F.col("p_partkey")).alias("item_code"),
            F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("part_no"),
            F.col("p_name").alias("item_name"),
            F.col("p_brand").alias("item_group"),
            _mapped("p_type", ITEM_TYPES).alias("item_type"),
            F.when(size <= 15, "Q1").when(size <= 30, "Q2").otherwise("Q9").alias("unit_code"),
        )

    def code(self) -> DataFrame:
        item = self.item()
        types = _codes(item, "item_gubn", "item_type", ITEM_TYPE_NAMES)
        return types.unionByName(_codes(item, "qnty_code", "unit_code", UNIT_NAMES))

    def po_header(self) -> DataFrame:
        return self.orders.select(
            _po_no("o_orderkey").alias("po_no"),
            F.col("o_custkey").alias("supplier_code"),
            F.to_date("o_orderdate").alias("po_date"),
        )

    def po_line(self) -> DataFrame:
        if "lines" in self.again:  # lines without an order number are no shipments
            lines = self._grouped(self.by_order).unionByName(self._grouped(self._lines().filter(F.col("l_orderkey").isNull())))
        else:
            lines = self._grouped(self._lines())
        return lines.withColumn("po_line_key", line_key("po_no", "line_seq"))

    def _grouped(self, lines: DataFrame) -> DataFrame:
        grouped = _numbered(lines).groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_partkey").alias("min_part"),
            F.max("l_quantity").alias("qty"),
            F.max("l_shipdate").alias("last_ship"),
            F.max(F.when(_is(_RECEIVED), 0).otherwise(1)).alias("any_open"),
        )
        stray_blank = (F.col("l_linenumber") == 3) & (F.col("min_part") % 10 == 0)
        return grouped.select(
            _po_no("l_orderkey").alias("po_no"),
            _padded(F.col("l_linenumber"), 4).alias("line_seq"),
            F.concat(F.when(stray_blank, " ").otherwise(""), _item_code(F.col("min_part"))).alias("item_code"),
            F.col("qty").cast(QUANTITY).alias("qty"),
            F.col("last_ship").alias("delivery_date"),
            F.when(F.col("any_open") == 1, "N").otherwise("Y").alias("status"),
        )

    def _lines(self) -> DataFrame:
        """Lines in few bytes: they are shuffled more than once. Their number and state are one column, so that tables
        made of one and the other read the same columns."""
        return self.lineitem.select(
            "l_orderkey", _place().alias("place"), *_SHIPMENT_ID, F.to_date("l_shipdate").alias("l_shipdate")
        )

    @cached_property
    def by_order(self) -> DataFrame:
        """Lines dealt by order. Tables of one query that read the same columns of them share this shuffle."""
        return self._lines().filter(F.col("l_orderkey").isNotNull()).repartition("l_orderkey")

    @cached_property
    def customers(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")

    @cached_property
    def shipments(self) -> DataFrame:
        """Lines with their customer and the smallest part of their order line."""
        # Shuffled once: what is grouped by order and line number, and joined by order, stays where its order is.
        of_line = Window.partitionBy("l_orderkey", "l_linenumber")
        # Shipments of one order line are all here: their place among them is sent on, not what they are ordered by.
        lines = _numbered(self.by_order).withColumn("nth", F.row_number().over(of_line.orderBy(*_SHIPMENT_ID)))
        lines = lines.withColumn("min_part", F.min("l_partkey").over(of_line))
        # Most lines have the smallest part themselves; it is not sent twice.
        other = F.when(~F.col("min_part").eqNullSafe(F.col("l_partkey")), F.col("min_part"))
        lines = lines.withColumn("other_part", other).drop("min_part", "l_linenumber", "l_extendedprice")
        return lines.join(self.customers, "l_orderkey")

    @cached_property
    def delivered(self) -> DataFrame:
        """Shipments as they are received and announced, stored if several tables are made of them."""
        lines = self.shipments
        return stored(lines, "shipments") if "shipments" in self.again else lines

    @cached_property
    def numbered(self) -> DataFrame:
        """The same with receipt number and position in the receipt, stored if they are read more than once."""
        number = _receipt_no(F.col("o_custkey"), F.year("l_shipdate"))
        # To be stored they are dealt by the number, which is made where they arrive. Else tables without it leave it out.
        lines = self.delivered.repartition(number) if "numbered" in self.again else self.delivered
        lines = _numbered(lines).withColumn("receipt_no", number)
        lines = skew.number_within(lines, ["receipt_no"], ["l_orderkey", "l_linenumber", "nth"], "position")
        return stored(lines.drop("nth", "l_linenumber"), "numbered-shipments") if "numbered" in self.again else lines

    def receipt_line(self) -> DataFrame:
        lines = self.numbered if "numbered" in self.again else self.delivered
        return _numbered(lines).filter(_is(_RECEIVED)).select(
            _line_key().alias("po_line_key"),
            _delivered_item().alias("item_code"),
            F.col("l_quantity").cast(QUANTITY).alias("qty"),
            _actual_no().alias("actual_no"),
        )

    def _customer_lines(self) -> DataFrame:
        """Lines with their customer, from where they are stored already."""
        if "numbered" in self.again:
            return self.numbered
        return self.delivered if "shipments" in self.again else self._lines().join(self.customers, "l_orderkey")

    def receipt_header(self) -> DataFrame:
        received = self._customer_lines() if self.again else self._lines().join(self.customers, "l_orderkey", "left_semi")
        suppliers = received.filter(_is(_RECEIVED)).select("l_suppkey").distinct()
        return suppliers.select(_actual_no().alias("actual_no"), F.lit("1").alias("receipt_type"))

    def prov_line(self) -> DataFrame:
        orphan = (F.col("l_linenumber") == 7) & _is(_RETURNED)
        return _numbered(self.numbered).select(
            "receipt_no",
            _padded(F.col("position"), 4).alias("line_seq"),
            F.when(orphan, "").otherwise(_line_key()).alias("po_line_key"),
            _delivered_item().alias("item_code"),
            F.col("l_quantity").cast(QUANTITY).alias("qty"),
            F.when(_is(_RECEIVED), "Y").otherwise("N").alias("status"),
            F.when(~_is(_ACCEPTED), F.col("l_shipdate")).alias("updated_on"),
        )

    def prov_header(self) -> DataFrame:
        grouped = self._customer_lines().groupBy(F.col("o_custkey").alias("supplier_code"), F.year("l_shipdate").alias("year"))
        dates = grouped.agg(
            F.min("l_shipdate").alias("saved_on"), F.max("l_shipdate").alias("due_date")
        )
        number = _receipt_no(F.col("supplier_code"), F.col("year"))
        return dates.select(number.alias("receipt_no"), "supplier_code", "saved_on", "due_date")

    def prov_contact(self) -> DataFrame:
        return self.prov_header().select(
            "receipt_no",
            F.concat(F.lit("D"), F.col("supplier_code").cast("string")).alias("contact_name"),
            F.lit("").alias("contact_phone"),
        )


def sample_tables(spark: SparkSession, sf_dir: str, again: str = "") -> Tables:
    """The tables, each derived when it is used.

    For a query that reads tables of lines more than once `again` names the step that they share, which is then stored:
    `shipments`, or `numbered` where they have the lines' numbers in the receipt too. With `lines` nothing is stored: tables
    that read the same columns of the lines are derived from one shuffle of them by order.
    """
    sample = _Sample(spark, sf_dir, again)
    return Tables({name: getattr(sample, name) for name in TABLE_NAMES})
