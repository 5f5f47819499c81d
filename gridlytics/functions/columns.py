"""Column expressions shared by the operators; all stay inside Catalyst."""

from __future__ import annotations

import calendar as _calendar
import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cubic feet per cubic metre, and the multiplier of each volume unit before that division.
CUBIC_FEET_PER_CUBIC_METER = 35.3147
# Names used in the published reports.
WEEKDAY_NAMES = ("Lunes", "Martes", "Miercoles", "Jueves", "Viernes", "Sabado", "Domingo")
MONTH_NAMES = (
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
)
# Fixed value: a holiday is coded as an eighth day of the week.
HOLIDAY_CODE = 8


def to_date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def month_end(value: str | dt.date, months: int = 0) -> dt.date:
    """Last day of the month ``months`` away from ``value``; a plain date, so scans can push it down."""
    day = to_date(value)
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    return dt.date(year, month + 1, _calendar.monthrange(year, month + 1)[1])


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or NULL."""
    return F.when(condition, 1).otherwise(0)


def band(col, edges: Sequence[float], labels: Sequence, closed: str = "right") -> Column:
    """Label of the interval a value falls in; ``len(labels) == len(edges) + 1``; NULL stays NULL."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    value = as_column(col)
    out = None
    for edge, label in zip(edges, labels):
        hit = value <= F.lit(edge) if closed == "right" else value < F.lit(edge)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.when(value.isNotNull(), F.lit(labels[-1]))


def clip(col, lo=None, hi=None) -> Column:
    """Cap and floor; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    value = out = as_column(col)
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(value.isNotNull(), out)


def pick(values: Sequence, index: Column) -> Column:
    """Value at a 0-based position; NULL for a NULL position, where ``element_at`` on a literal array returns a value."""
    return F.get(F.array(*map(F.lit, values)), index)


def ratio(num, den, fill=None) -> Column:
    """``num / den`` with a zero or NULL denominator giving ``fill``."""
    out = F.try_divide(as_column(num).cast("double"), as_column(den).cast("double"))
    return out if fill is None else F.coalesce(out, F.lit(float(fill)))


def parse_decimal(col) -> Column:
    """Text with a decimal comma or point to double; unreadable text gives NULL."""
    return F.replace(as_column(col), F.lit(","), F.lit(".")).try_cast("double")


def clean_comment(col) -> Column:
    return F.replace(as_column(col), F.lit("/"), F.lit(" , "))


def to_cubic_meters(value, unit, sign) -> Column:
    """Signed volume in cubic metres as DECIMAL(20,4); an unknown unit gives NULL."""
    signed = as_column(value).cast("double") * as_column(sign)
    unit = as_column(unit)
    return (
        F.when(unit == "M3", signed)
        .when(unit == "FT3", signed / CUBIC_FEET_PER_CUBIC_METER)
        .when(unit.isin("KPC", "MBTU"), signed * 1000 / CUBIC_FEET_PER_CUBIC_METER)
        .cast("decimal(20,4)")
    )


def day_code(date, holiday=None) -> Column:
    """Monday 0 to Sunday 6; a holiday becomes code 8."""
    weekday = F.weekday(as_column(date))
    if holiday is None:
        return weekday
    return F.when(as_column(holiday) == 1, HOLIDAY_CODE).otherwise(weekday)


def weekday_name(date) -> Column:
    return pick(WEEKDAY_NAMES, F.weekday(as_column(date)))


def month_name(date) -> Column:
    return pick(MONTH_NAMES, F.month(as_column(date)) - 1)


def percent_error(predicted, actual) -> Column:
    """``|predicted - actual| / actual``; NULL when the actual is zero."""
    predicted, actual = as_column(predicted), as_column(actual)
    return F.try_divide(F.abs(predicted - actual), actual)


def sentinel_to_null(col, sentinel: str = "1900-01-01") -> Column:
    value = as_column(col)
    return F.when(value != F.lit(sentinel).cast("date"), value)


def draw(keys: Sequence[str], seed: int = 0) -> Column:
    """A whole number from 0 to 2^60 - 1 drawn by the keys of a row: the first 15 digits of an MD5 sum, the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
