"""Line deduplication over overlapping windows of three lines.

Lines are split at line feeds and compared without surrounding blanks; blank
lines are passed over when windows are formed. Every three consecutive lines
are hashed (two 64-bit hashes), equal windows are found over all documents,
and of each window only the first occurrence by (doc_id, position) stays:
later occurrences cover their lines, the covered positions of a document are
merged, and what lies between is kept. In the first occurrence's own document
a later, overlapping occurrence covers only what lies beyond the first.

The window table is narrow (hashes, ids, positions) and is written once. Only
hashes that occur more than once, pre-aggregated before the shuffle, are
joined back; a window that a third of all rows share is one row on that side
and its occurrences are split as a skewed join. Texts move once, to meet
their own covered positions.

Nulls and ties: a null text has no lines and stays null; documents of fewer
than three non-blank lines have no window and stay as they are; a null
doc_id comes after all others; rows equal in doc_id and text are one document
(they lose the same lines), rows of one doc_id with different texts are
different documents. An empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.llm.base import fresh, quoted
from flowsift.session import cut_lineage

WINDOW = 3


def _windows(lines: Column) -> Column:
    """Array of (h1, h2, first line, last line) for each window of non-blank lines."""
    numbered = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"))),
                        lambda s: s["x"] != "")
    hashed = F.transform(numbered, lambda s: F.struct(
        s["i"].alias("i"), F.xxhash64(s["x"]).alias("a"), F.xxhash64(F.lit("second"), s["x"]).alias("b")))

    def cut(hs: Column) -> Column:
        def one(j: Column) -> Column:
            w = [F.get(hs, j + k) for k in range(WINDOW)]
            return F.struct(F.xxhash64(*[x["a"] for x in w]).alias("h1"), F.xxhash64(*[x["b"] for x in w]).alias("h2"),
                            w[0]["i"].alias("p0"), w[-1]["i"].alias("p2"))
        return F.when(F.size(hs) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(hs) - WINDOW), one))

    # bind the hashed lines once: a one-element array mapped over itself
    return F.flatten(F.transform(F.array(hashed), lambda hs: F.coalesce(cut(hs), F.array().cast(
        "array<struct<h1:bigint,h2:bigint,p0:int,p2:int>>"))))


def covered_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, h, gone): per document (id and text hash) the sorted line positions
    that later occurrences of repeated windows cover."""
    docs = df.select(quoted(doc_id).alias("d"), F.xxhash64(quoted(text)).alias("h"),
                     F.split(quoted(text), "\n", -1).alias("lines")).filter("lines is not null")
    win = cut_lineage(docs.select("d", "h", F.explode(_windows(F.col("lines"))).alias("w")).select("d", "h", "w.*"))
    first = F.min(F.struct(F.col("d").isNull().alias("dn"), F.col("d").alias("d"), F.col("h").alias("h"),
                           F.col("p0").alias("p0"), F.col("p2").alias("p2")))
    repeated = cut_lineage(win.groupBy("h1", "h2").agg(first.alias("f"), F.count("*").alias("n"))
                           .filter("n > 1").select("h1", "h2", "f"))
    later = win.join(repeated, ["h1", "h2"])
    same = F.col("d").eqNullSafe(F.col("f.d")) & (F.col("h") == F.col("f.h"))
    later = later.withColumn("p0", F.when(same, F.greatest("p0", F.col("f.p2") + 1)).otherwise(F.col("p0")))
    return (later.filter("p0 <= p2").groupBy("d", "h")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("p0", "p2"))))).alias("gone")))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``df`` with the text shortened, and n_lines, n_removed
    (names preceded by underscores where ``df`` has them already)."""
    h, d2, h2, gone, lines, n_lines, n_removed = fresh(
        df, "_h", "_d2", "_h2", "_gone", "_lines", "n_lines", "n_removed")
    cover = covered_lines(df, doc_id, text).toDF(d2, h2, gone)
    body = df.withColumn(h, F.xxhash64(quoted(text)))
    out = body.join(cover, F.col(h).eqNullSafe(F.col(h2)) & quoted(doc_id).eqNullSafe(F.col(d2)), "left")
    out = out.withColumn(lines, F.split(quoted(text), "\n", -1))
    # what lies between the covered positions: one slice for each gap
    cuts = F.zip_with(F.concat(F.array(F.lit(-1)), F.col(gone)), F.concat(F.col(gone), F.array(F.size(lines))),
                      lambda s, e: F.slice(F.col(lines), s + 2, e - s - 1))
    kept = F.array_join(F.flatten(cuts), "\n")
    out = out.withColumn(n_lines, F.when(quoted(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn(n_removed, F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long"))
    new = F.when(F.col(gone).isNull(), quoted(text)).otherwise(kept)
    return out.select(*[(new.alias(c) if c == text else quoted(c)) for c in df.columns], n_lines, n_removed)
