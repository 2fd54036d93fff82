"""Shared by the training-data operators: table access, the held-out rule,
collision-free column names and the queries' own registry."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL if there is one."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        k = n
        while k.lower() in taken:
            k = "_" + k
        taken.add(k.lower())
        out.append(k)
    return out


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, mod ``folds`` (a null id counts as empty text)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds


def fold_of_py(doc_id, folds: int = 5) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


class ByteCache(dict):
    """Keeps what ``make`` gives for a word. It is emptied before it holds more than
    about ``limit`` bytes, and words over LONG characters are never kept, so text
    without blanks (one "word") can't fill a worker."""

    LONG = 64
    OVERHEAD = 180  # bytes that an entry's objects take besides their contents

    def __init__(self, make: Callable, limit: int = 24 << 20):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0

    def __missing__(self, key):
        got = self.make(key)
        if len(key) <= self.LONG:
            self.held += self.OVERHEAD + len(key) + (len(got) if isinstance(got, bytes) else 0)
            if self.held > self.limit:
                self.clear()
            self[key] = got
        return got

    def clear(self) -> None:
        super().clear()
        self.held = 0
