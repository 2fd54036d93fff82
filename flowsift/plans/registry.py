"""Registry of checkable queries: a Spark callable and, where SQL can say
the same thing, an equivalent DuckDB query over the same Parquet tables.

Double columns are rounded to 6 digits on both sides, so the comparison does
not depend on the order of floating-point additions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ORACLE_DOUBLES: dict[str, tuple[str, ...]] = {}


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    dbl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not dbl:
        return df
    return df.select(*[(F.round(F.col(f"`{c}`").cast("double"), digits) if c in dbl else F.col(f"`{c}`"))
                       .alias(c) for c in df.columns])


def round_sql(sql: str, doubles: Sequence[str], digits: int = DIGITS) -> str:
    """Round exactly like Spark's ``round`` on a double, which rounds the
    shortest round-trip decimal form half-up: DuckDB prints the same shortest
    form, which is parsed as a wide DECIMAL and rounded there, so halves and
    near-halves go the same way in both engines. Infinities, NaN and
    magnitudes beyond the DECIMAL range pass unchanged (no 6th decimal there)."""
    if not doubles:
        return sql

    def r(c: str) -> str:
        x = f'CAST("{c}" AS DOUBLE)'
        return (f"CASE WHEN isinf({x}) OR isnan({x}) OR abs({x}) >= 1e19 THEN {x} "
                f"ELSE CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE) END")

    rep = ", ".join(f'{r(c)} AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and its oracle SQL."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = round_sql(sql, doubles)
            ORACLE_DOUBLES[name] = tuple(doubles)
        return fn
    return deco
