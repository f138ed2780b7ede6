"""The nine logical tables, their schemas, and the record that carries them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.functions import skew

QUANTITY = T.DoubleType()


def no_quantity() -> Column:
    """Zero of the quantity type, so that sums keep that type."""
    return F.lit(0).cast(QUANTITY)


@dataclass(frozen=True)
class Field:
    """A column: its name here, its name in the source database, its type."""

    name: str
    source: str
    type: T.DataType
    is_key: bool = False


@dataclass(frozen=True)
class Layout:
    source: str
    fields: tuple[Field, ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type) for f in self.fields])


_TEXT, _DATE = T.StringType(), T.DateType()

# Names of the source tables and columns.
LAYOUTS: dict[str, Layout] = {
    "item": Layout("be_item_info", (
        Field("item_code", "item_code", _TEXT, True),
        Field("part_no", "atsk_code", _TEXT, True),
        Field("item_name", "item_name", _TEXT),
        Field("item_group", "item_grup", _TEXT),
        Field("item_type", "item_gubn", _TEXT, True),
        Field("unit_code", "qnty_code", _TEXT, True),
    )),
    "code": Layout("sys_code_info", (
        Field("code_group", "grup_code", _TEXT, True),
        Field("code", "code", _TEXT, True),
        Field("name", "name", _TEXT),
    )),
    "po_header": Layout("mt_ordr_mast", (
        Field("po_no", "ordr_numb", _TEXT, True),
        Field("supplier_code", "cust_code", _TEXT, True),
        Field("po_date", "ordr_date", _DATE),
    )),
    "po_line": Layout("mt_ordr_detl", (
        Field("po_no", "ordr_numb", _TEXT, True),
        Field("line_seq", "sqen_numb", _TEXT, True),
        Field("item_code", "item_code", _TEXT, True),
        Field("qty", "item_qnty", QUANTITY),
        Field("delivery_date", "dery_date", _DATE),
        Field("status", "stat_type", _TEXT, True),
    )),
    "receipt_header": Layout("mt_ipgo_mast", (
        Field("actual_no", "ipgo_numb", _TEXT, True),
        Field("receipt_type", "ipgo_type", _TEXT),
    )),
    "receipt_line": Layout("mt_ipgo_detl", (
        Field("po_line_key", "ordr_numb", _TEXT, True),
        Field("item_code", "item_code", _TEXT, True),
        Field("qty", "item_qnty", QUANTITY),
        Field("actual_no", "ipgo_numb", _TEXT, True),
    )),
    "prov_header": Layout("mt_gaip_mast", (
        Field("receipt_no", "ipgo_numb", _TEXT, True),
        Field("supplier_code", "cust_code", _TEXT, True),
        Field("saved_on", "in_date", _DATE),
        Field("due_date", "ipgo_date", _DATE),
    )),
    "prov_line": Layout("mt_gaip_detl", (
        Field("receipt_no", "ipgo_numb", _TEXT, True),
        Field("line_seq", "sqen_numb", _TEXT, True),
        Field("po_line_key", "ordr_numb", _TEXT, True),
        Field("item_code", "item_code", _TEXT, True),
        Field("qty", "gaip_qnty", QUANTITY),
        Field("status", "stat_type", _TEXT, True),
        Field("updated_on", "up_date", _DATE),
    )),
    "prov_contact": Layout("imsi_gaip_user", (
        Field("receipt_no", "gaip_numb", _TEXT, True),
        Field("contact_name", "user_name", _TEXT),
        Field("contact_phone", "tele_numb", _TEXT),
    )),
}


@dataclass(frozen=True)
class Marks:
    """High-water marks of the stored tables, opened when used.

    `days`: (day, last_number) of the receipts numbered by `rule`; `receipts`: (receipt_no, last_sequence, has_header).
    """

    days: Callable[[], DataFrame]
    receipts: Callable[[], DataFrame]
    rule: object


TABLE_NAMES = tuple(LAYOUTS)
Source = DataFrame | Callable[[], DataFrame]


class Tables:
    """The logical tables, each opened when it is first used: `t.item`, `t.po_line`, ...

    `po_line` also carries `po_line_key`. `heavy` has the heavy keys of the tables by table and columns, as stored with a
    version; tables without it get plain joins, which adaptive execution may still split. `marks` are those stored with
    a version; without them numbers and sequences in use are looked up in the tables.
    """

    def __init__(
        self,
        sources: Mapping[str, Source],
        heavy: Mapping[tuple[str, tuple[str, ...]], skew.HeavyKeys] | None = None,
        marks: Marks | None = None,
        of_supplier: Callable[[str, object], DataFrame] | None = None,
    ) -> None:
        missing = set(TABLE_NAMES) - set(sources)
        if missing:
            raise ValueError(f"missing tables: {sorted(missing)}")
        self._sources = dict(sources)
        self._opened: dict[str, DataFrame] = {}
        self._heavy = dict(heavy or {})
        self.marks = marks
        self._of_supplier = of_supplier

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            source = self._sources[name]
            self._opened[name] = source if isinstance(source, DataFrame) else source()
        return self._opened[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in LAYOUTS:
            raise AttributeError(name)
        return self[name]

    def changed(self, **tables: DataFrame) -> Tables:
        """Same tables with some replaced; a changed table keeps its heavy keys, which only deal out its rows."""
        marks = None if {"prov_header", "prov_line"} & set(tables) else self.marks
        of_supplier = None if set(SUPPLIED) & set(tables) else self._of_supplier
        return Tables({**self._sources, **self._opened, **tables}, self._heavy, marks, of_supplier)

    def of_supplier(self, name: str, supplier: object) -> DataFrame:
        """Lines of a table that may belong to the supplier's documents, from the part of the table where they are
        stored; all lines if no supplier is given or the table is not stored by supplier."""
        if supplier is None or self._of_supplier is None:
            return self[name]
        return self._of_supplier(name, supplier)

    def hot(self, table: str, *columns: str) -> skew.HeavyKeys | None:
        """Heavy values of a key of a table, None if it has none. No pass over the table."""
        if columns not in HEAVY_KEYS[table]:
            raise KeyError((table, columns))
        return self._heavy.get((table, columns))


# Line tables that are stored by the supplier of their documents: header table and document number.
SUPPLIED = {"po_line": ("po_header", "po_no"), "prov_line": ("prov_header", "receipt_no")}

# Keys by which the line tables are joined or grouped.
HEAVY_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "item": (("part_no",),),
    "po_line": (("po_no",), ("po_line_key",), ("item_code",)),
    "receipt_line": (("po_line_key",), ("actual_no",)),
    "prov_header": (("receipt_no",),),
    "prov_line": (
        ("receipt_no",), ("po_line_key",), ("item_code",), ("po_line_key", "item_code"), ("receipt_no", "item_code"),
    ),
}
