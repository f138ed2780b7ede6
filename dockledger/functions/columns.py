"""Column expressions shared by the queries. All of them stay inside Catalyst."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status codes, the words shown for them, and text conventions.
OPEN = "N"
CLOSED = "Y"
OPEN_LABEL = "진행중"
CLOSED_LABEL = "종결"
ALL_LABEL = "전체"
SUMMARY_SEPARATOR = " 외 "
PICKER_SEPARATOR = "     외 "
SUMMARY_UNIT = "건"
DEFAULT_UNIT = "EA"
NO_TEXT = "-"
LOOPBACK = "127.0.0.1"

# A number as a person types it into a quantity cell.
_TYPED_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def line_key(po_no: Column | str, line_seq: Column | str) -> Column:
    """Key of a purchase-order line: number and sequence glued; NULL if either is."""
    return F.concat(_col(po_no), _col(line_seq))


def business_date(column: Column | str) -> Column:
    """Date from `YYYYMMDD`, `YYYY-MM-DD` or a date-time text; NULL when it is none of them."""
    digits = F.substring(F.regexp_replace(_col(column), "[-T: ]", ""), 1, 8)
    return F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")


def compact_date(column: Column | str) -> Column:
    return F.date_format(_col(column), "yyyyMMdd")


def month_code(column: Column | str) -> Column:
    return F.date_format(_col(column), "yyyyMM")


def month_label(column: Column | str) -> Column:
    """`YYYYMM` shown as `YYYY-MM`; other text unchanged, NULL as empty."""
    return F.coalesce(F.regexp_replace(_col(column), r"^(\d{4})(\d{2})$", "$1-$2"), F.lit(""))


def long_date(column: Column | str) -> Column:
    return F.date_format(_col(column), "yyyy'년' M'월' d'일'")


def quantity_text(column: Column | str) -> Column:
    """Thousands separators and at most three decimals, halves away from zero; no minus before a zero."""
    rounded = F.round(_col(column).cast("decimal(38,12)"), 3)
    return F.call_function("format_number", rounded, F.lit("#,##0.###"))


def typed_quantity(column: Column | str) -> Column:
    """Number in a cell that may hold any text; NULL when it is not a number."""
    text = _col(column).cast("string")
    return F.when(text.rlike(_TYPED_NUMBER), text.try_cast("double"))


def text_or(column: Column | str, default: str) -> Column:
    """The text, or the default where it is NULL or empty."""
    return F.when(_col(column) != "", _col(column)).otherwise(F.lit(default))


def client_address(forwarded: Column | str, host: Column | str) -> Column:
    """First hop of a forwarded list, else the peer, else loopback."""
    first_hop = F.trim(F.split(_col(forwarded), ",")[0])
    return F.when(_col(forwarded) != "", first_hop).otherwise(F.coalesce(_col(host), F.lit(LOOPBACK)))


def item_summary(
    line_count: Column | str, item_name: Column | str, item_code: Column | str, separator: str = SUMMARY_SEPARATOR
) -> Column:
    """First item of a document, plus how many more lines it has."""
    shown = F.coalesce(_col(item_name), _col(item_code))
    more = (_col(line_count) - 1).cast("string")
    return F.when(_col(line_count) > 1, F.concat(shown, F.lit(separator), more, F.lit(SUMMARY_UNIT))).otherwise(shown)


def rolled_status(status: Column | str) -> Column:
    """Aggregate: open as soon as one line is open. A NULL status counts as closed."""
    any_open = F.max(F.when(_col(status) == OPEN, 1).otherwise(0))
    return F.when(any_open == 1, OPEN).otherwise(CLOSED)


def wildcard_regex(text: str) -> str:
    """Regular expression for search text in which `%`, `_` and `[...]` are wildcards."""
    parts = []
    for token in re.findall(r"\[[^\]]+\]|.", text, flags=re.S):
        if token == "%":
            parts.append(".*")
        elif token == "_":
            parts.append(".")
        elif len(token) > 1:
            inner = re.sub(r"([\[\\&])", r"\\\1", token[1:-1])
            parts.append(f"[{inner}]")
        else:
            parts.append(re.escape(token))
    return "(?s)" + "".join(parts)


def _check_mode(mode: str) -> None:
    if mode not in ("literal", "pattern"):
        raise ValueError(f"mode must be 'literal' or 'pattern', not {mode!r}")


def contains_any(columns: list[Column | str], text: str, mode: str = "literal", ignore_case: bool = False) -> Column:
    """True where one of the columns contains the text; a NULL column never does."""
    _check_mode(mode)
    tests = []
    for column in map(_col, columns):
        if mode == "literal":
            tests.append(F.lower(column).contains(text.lower()) if ignore_case else column.contains(text))
        else:
            regex = wildcard_regex(text)
            tests.append(column.rlike(regex.replace("(?s)", "(?siu)") if ignore_case else regex))
    return reduce(or_, tests)


def equals(column: Column | str, text: str, mode: str = "literal") -> Column:
    """True where the column is the text, or in pattern mode where all of it fits the text."""
    _check_mode(mode)
    if mode == "literal":
        return _col(column) == text
    return _col(column).rlike(wildcard_regex(text).replace("(?s)", "(?s)^") + r"\z")


def status_code(status: str | None) -> str | None:
    """Status argument of a query as its code; None stands for all."""
    if status in (None, "", "all", "ALL", ALL_LABEL):
        return None
    codes = {OPEN: OPEN, OPEN_LABEL: OPEN, CLOSED: CLOSED, CLOSED_LABEL: CLOSED}
    if status not in codes:
        raise ValueError(f"unknown status {status!r}")
    return codes[status]


def has_status(column: Column | str, status: str | None) -> Column:
    """Status filter; also for all statuses it drops rows without one."""
    code = status_code(status)
    return _col(column).isNotNull() if code is None else _col(column) == code


def status_label(column: Column | str, unknown: str = "closed") -> Column:
    """Word for a status. `unknown` decides what anything but the two codes becomes:
    `closed`, `open`, or `value` (the value itself, a dash when there is none)."""
    status = _col(column)
    known = F.when(status == OPEN, OPEN_LABEL).when(status == CLOSED, CLOSED_LABEL)
    rest = {"closed": F.lit(CLOSED_LABEL), "open": F.lit(OPEN_LABEL), "value": text_or(status, NO_TEXT)}
    if unknown not in rest:
        raise ValueError(f"unknown must be one of {sorted(rest)}, not {unknown!r}")
    return known.otherwise(rest[unknown])
