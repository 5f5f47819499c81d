"""Registry of queries and the SQL text each must agree with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlytics.plans.bases import CTES, Tables

PLACES = 6
#: Doubles of a frame up to which they are rounded the quick way; its longer code, for many columns, would be too long to be compiled.
QUICK_PLACES = 12

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _places(col: Column) -> Column:
    """``round(col, 6)`` of a double, which goes by way of its decimal text: where one whole number of millionths is clearly the nearest, it
    is divided down instead, to the same double."""
    millionths = col * 10.0**PLACES
    clear = (F.abs(col) < 1e7) & (F.abs(millionths - F.rint(millionths)) < 0.49)
    return F.when(clear, F.rint(millionths) / 10.0**PLACES).otherwise(F.round(col, PLACES))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, decimals as doubles, timestamps as dates, so both engines print the same values."""
    out, quick = [], sum(kind in ("double", "float") for _, kind in df.dtypes) <= QUICK_PLACES
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            number = col.cast("double")
            col = (_places(number) if quick and kind == "double" else F.round(number, PLACES)) + F.lit(0.0)
        elif kind.startswith("timestamp"):
            col = col.cast("date")
        out.append(col.alias(name))
    return df.select(*out)


def with_ctes(body: str, ctes: Sequence[str]) -> str:
    """Prefix the named common tables and what they depend on, in order of definition."""
    needed, stack = set(), list(ctes)
    while stack:
        name = stack.pop()
        if name not in needed:
            needed.add(name)
            stack += CTES[name][0]
    parts = [f"{name} AS ({CTES[name][1]})" for name in CTES if name in needed]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def query(name: str, sql: str | None = None, ctes: Sequence[str] = (), doubles: Sequence[str] = ()):
    """Register a function of :class:`Tables` and, where SQL can say the same, its oracle text."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(build(Tables(spark, sf_dir)))
        if sql is not None:
            text = with_ctes(sql.strip(), ctes)
            if doubles:
                changes = ", ".join(f"round(CAST({c} AS DOUBLE), {PLACES}) + 0.0::DOUBLE AS {c}" for c in doubles)
                text = f"SELECT * REPLACE ({changes}) FROM ({text}) AS answer"
            ORACLES[name] = text
        return build

    return add
