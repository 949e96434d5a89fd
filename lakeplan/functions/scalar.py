"""Scalar and aggregate helpers.

Everything here is a Column expression of built-in functions: it stays in
whole-stage code and can be pushed to the scan where Spark can do so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Cols = Column | str


def _c(x: Cols) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int_div(a: Cols, b: Cols) -> Column:
    """Truncating integer division; null for a zero divisor."""
    a, b = _c(a), _c(b)
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def safe_div(a: Cols, b: Cols) -> Column:
    """a / b as double; null for a zero divisor."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def safe_mod(a: Cols, b: Cols) -> Column:
    """Remainder with the sign of a; null for a zero divisor."""
    return F.try_mod(_c(a), _c(b))


def xor(a: Cols, b: Cols) -> Column:
    """Exclusive or of booleans; null if either is."""
    return _c(a) != _c(b)


def bit_and(a: Cols, b: Cols) -> Column:
    return _c(a).bitwiseAND(_c(b))


def bit_or(a: Cols, b: Cols) -> Column:
    return _c(a).bitwiseOR(_c(b))


def bit_xor(a: Cols, b: Cols) -> Column:
    return _c(a).bitwiseXOR(_c(b))


def concat(*parts: Cols) -> Column:
    """Null if any part is."""
    return F.concat(*map(_c, parts))


def concat_skip_nulls(*parts: Cols) -> Column:
    """Null parts count as empty."""
    return F.concat_ws("", *map(_c, parts))


def substr(s: Cols, start: int | Column, length: int | Column | None = None) -> Column:
    """Characters from ``start`` (1 is the first; less counts as 1); '' past the end or for a length below 1."""
    at = F.greatest(start if isinstance(start, Column) else F.lit(start), F.lit(1)).cast("int")
    n = F.length(_c(s)) if length is None else length if isinstance(length, Column) else F.lit(length)
    return F.substring(_c(s), at, F.greatest(n, F.lit(0)).cast("int"))


def like(s: Cols, pattern: str) -> Column:
    """LIKE with % and _ and no escape character; plain prefix, suffix and infix patterns use the direct tests.

    A direct prefix test can be pushed to a Parquet scan.
    """
    s, body = _c(s), pattern.strip("%")
    if "_" not in pattern and "%" not in body:
        left, right = pattern.startswith("%"), pattern.endswith("%")
        if not body:
            return s.isNotNull() if pattern else s == ""
        if left and right:
            return s.contains(body)
        if right:
            return s.startswith(body)
        return s.endswith(body) if left else s == body
    return s.like(pattern.replace("\\", "\\\\"))


_UNITS = {"DAY": "DAY", "DAYS": "DAY", "MONTH": "MONTH", "MONTHS": "MONTH", "YEAR": "YEAR", "YEARS": "YEAR"}


def date_shift(d: Cols, amount: int, unit: str) -> Column:
    """Date plus amount days, months or years; months and years stop at the end of the month."""
    if unit.upper() not in _UNITS:
        raise ValueError(f"interval unit must be day, month or year: {unit}")
    return (_c(d).cast("date") + F.expr(f"INTERVAL '{int(amount)}' {_UNITS[unit.upper()]}")).cast("date")


def year_of(d: Cols) -> Column:
    return F.year(_c(d).cast("date")).cast("long")


def month_of(d: Cols) -> Column:
    return F.month(_c(d).cast("date")).cast("long")


def day_of(d: Cols) -> Column:
    return F.dayofmonth(_c(d).cast("date")).cast("long")


def current_timestamp_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def truthy(c: Cols, kind: str) -> Column:
    """A bare column as predicate: numbers other than 0, strings that aren't empty."""
    return F.length(_c(c)) > 0 if kind == "string" else _c(c) if kind == "boolean" else _c(c) != 0


def not_null_or(c: Cols, *others: Cols) -> Column:
    return F.coalesce(_c(c), *map(_c, others))


def exact_sum(c: Cols, scale: int = 4) -> Column:
    """Sum of a double taken in decimals of ``scale`` digits: the same whatever the order of rows and partitions."""
    return F.sum(_c(c).cast(f"decimal(18,{scale})")).cast("double")


def exact_avg(c: Cols, scale: int = 4) -> Column:
    """Average by exact sum and count."""
    return exact_sum(c, scale) / F.count(_c(c))
