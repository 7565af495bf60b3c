"""Numbers and names as the object panel shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(value: Column, digits: int) -> Column:
    """A double from 1 to 2^34 with this many digits as C's printf gives it: its binary value is rounded, ties to even.

    format_string rounds the shortest decimal instead, and halves up: 519.05, stored as 519.0499.., would be 519.1.
    """
    whole = F.floor(value)
    shifted = ((value - whole) * F.lit(2.0**52)).cast("long") * F.lit(10**digits)  # exact, as the last bit of such a value is 2^-52 or more
    cut, rest = F.shiftright(shifted, 52), shifted.bitwiseAND(F.lit((1 << 52) - 1))
    up = (rest > F.lit(1 << 51)) | ((rest == F.lit(1 << 51)) & (cut.bitwiseAND(F.lit(1)) == 1))
    total = whole * F.lit(10**digits) + cut + up.cast("long")
    text = total.cast("string")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - digits), F.lit("."), F.right(text, F.lit(digits)))


def _scaled(value: Column, units: list[tuple[float, str]], digits: int) -> Column:
    out = value.cast("string")
    for size, unit in reversed(units):
        out = F.when(value >= size, F.concat(_fixed(value / F.lit(size), digits), F.lit(unit))).otherwise(out)
    return out


def human_number(value: Column) -> Column:
    """1.2B, 3.4M, 5.6K, or the number itself."""
    return _scaled(value.cast("long"), [(1e9, "B"), (1e6, "M"), (1e3, "K")], 1)


def human_bytes(value: Column) -> Column:
    """Decimal units with two digits; below 1 KB plain bytes."""
    v = value.cast("long")
    return F.when(v < 1000, F.concat(v.cast("string"), F.lit(" B"))).otherwise(_scaled(v, [(1e9, " GB"), (1e6, " MB"), (1e3, " KB")], 2))


def grouped_number(value: Column) -> Column:
    return F.format_number(value, 0)


# Fixed display names; any other type loses its first underscore.
TYPE_LABELS = {
    "BIGQUERY_TABLE": "BQ TABLE", "BIGQUERY_VIEW": "BQ VIEW", "BIGQUERY_UDF": "BQ UDF", "BIGQUERY_PROCEDURE": "BQ PROC", "PROCEDURE": "PROC",
    "FUNCTION": "FUNC", "COMPOSER_DAG": "DAG", "LUA_UDF": "LUA UDF", "SYNC_JOB": "SYNC",
}


def type_label(type_: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in TYPE_LABELS.items() for x in pair))
    return F.coalesce(F.element_at(labels, type_), F.regexp_replace(type_, "^([^_]*)_", "$1 "))


def shown_columns(columns: Column, n: int = 20) -> tuple[Column, Column]:
    """The first n columns, and how many more there are."""
    return F.slice(columns, 1, n), F.greatest(F.size(columns) - n, F.lit(0))
