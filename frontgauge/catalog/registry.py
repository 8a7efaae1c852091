"""Named queries over the given tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

# Digits kept behind the point; of numbers below SMALL (tiny p-values) as many digits of
# the number itself, down to 1e-MOST. Finer than any difference that matters, coarser
# than the last bits in which two engines differ.
DIGITS, SMALL, MOST = 6, 1e-3, 14


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order in the last bits; compare without them.

    Operators return plain values; only registered queries go through this.
    """
    return df.select(*[_cut(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _cut(c: Column) -> Column:
    own = F.least(F.lit(MOST), DIGITS - 1 - F.floor(F.log10(F.abs(c))))
    places = F.when(F.abs(c) < SMALL, own).otherwise(DIGITS)
    scale = F.pow(F.lit(10.0), places)
    plain = (c == 0) | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(plain, c).otherwise(F.round(c * scale) / scale)


def _cut_sql(c: str) -> str:
    own = f"least({MOST}, {DIGITS - 1} - floor(log10(abs({c}))))"
    places = f"CASE WHEN abs({c}) < {SMALL} THEN {own} ELSE {DIGITS} END"
    scale = f"pow(10.0::DOUBLE, {places})"
    return f"CASE WHEN {c} = 0 OR isnan({c}) OR isinf({c}) THEN {c} ELSE round({c}::DOUBLE * {scale}) / {scale} END"


def query(sql: str | None = None, rounds: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register a query; `rounds` names the double columns of its SQL."""

    def add(fn: Query) -> Query:
        text = sql
        if sql is not None and rounds:
            each = ", ".join(f"{_cut_sql(f'({c})::DOUBLE')} AS {c}" for c in rounds)
            text = f"SELECT * REPLACE ({each}) FROM ({sql})"
        ENTRIES[fn.__name__] = Entry(lambda spark, folder: rounded(fn(spark, folder)), text)
        return fn

    return add
