"""Queries of sources, sinks and stored state: the events table
written as logs, datasets, metrics and sketches, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowsift.functions import columns as C
from flowsift.operators import encode as J
from flowsift.operators import evaluate as N
from flowsift.operators import sample as I
from flowsift.operators import sketches as K
from flowsift.plans import oracle_views as V
from flowsift.plans.catalog_core import raw
from flowsift.plans.catalog_prep import scored
from flowsift.plans.registry import query
from flowsift.session import scratch_path
from flowsift.sources import logs
from flowsift.sources.views import flows

# fixed values: three headers of one log format, as three exporters write them
HEADERS = {
    "part0": {"uid": "uid", "id.orig_h": "orig_h", "id.resp_p": "resp_p", "proto": "proto", "duration": "duration_raw",
              "orig_bytes": "orig_bytes", "missed_bytes": "missed_bytes"},
    "part1": {"proto": "proto", "duration": "duration_raw", "uid": "uid", "id.resp_p": "resp_p", "id.orig_h": "orig_h",
              "missed_bytes": "missed_bytes", "orig_bytes": "orig_bytes"},
    "part2": {"uid": "uid", "id.resp_p": "resp_p", "proto": "proto", "duration": "duration_raw", "id.orig_h": "orig_h"},
}


def written_logs(spark, d) -> str:
    """The folder of the flows as '|' logs of three headers."""
    base, rows = scratch_path(spark, f"logs/{uuid.uuid4().hex}"), flows(spark, d)
    for name, header in HEADERS.items():
        part = rows.filter(F.col("source_file") == name).select(*[F.col(c).alias(n) for n, c in header.items()])
        logs.write_flows(part, f"{base}/{name}", "csv")
    return base


@query("read_logs", f"""WITH {V.FLOWS}
SELECT proto, count(*) AS rows, count(DISTINCT orig_h) AS sources, CAST(sum(resp_p) AS BIGINT) AS ports,
       count(TRY_CAST(duration_raw AS DOUBLE)) AS durations, sum(TRY_CAST(duration_raw AS DOUBLE)) AS duration_sum,
       count(missed_bytes) FILTER (source_file <> 'part2') AS missed_known,
       CAST(sum(orig_bytes) FILTER (source_file <> 'part2') AS DOUBLE) AS bytes
FROM flows GROUP BY proto""", doubles=("duration_sum", "bytes"))
def q_read_logs(spark, d):
    """Logs of three headers written, read back, typed and unioned by name."""
    df = logs.read_flows(spark, written_logs(spark, d))
    return df.groupBy("proto").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("orig_h").alias("sources"), F.sum("resp_p").alias("ports"),
        F.count("duration").alias("durations"), F.sum("duration").alias("duration_sum"),
        F.count("missed_bytes").alias("missed_known"), F.sum("orig_bytes").alias("bytes"))


@query("dataset_shares", f"""WITH {V.LABELED},
t AS (SELECT CAST(label = 'Malicious' AS INTEGER) AS target, count(*) AS n FROM labeled
      WHERE label IN ('Benign', 'Malicious') GROUP BY 1),
s AS (SELECT 'train' AS split, target, CAST(round(n * 0.75) AS BIGINT) AS count FROM t
      UNION ALL SELECT 'test', target, n - CAST(round(n * 0.75) AS BIGINT) FROM t)
SELECT split, target, count, 100.0 * count / sum(count) OVER (PARTITION BY split) AS pct FROM s""", doubles=("pct",))
def q_dataset_shares(spark, d):
    """Training and test set written with their feature names, loaded, class shares."""
    rows = C.binary_target(C.keep_classes(C.clean_labels(raw(spark, d)))).select("uid", "orig_pkts", "resp_pkts", "target")
    rows = I.stratified_split(rows, "target", id_col="uid")
    path = scratch_path(spark, f"datasets/{uuid.uuid4().hex}")
    logs.write_dataset(rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split"), path,
                       ["orig_pkts", "resp_pkts"])
    *_, share = logs.load_dataset(spark, path)
    return share


@query("merged_metrics", f"""WITH {V.FLOWS},
m AS (SELECT 'a' AS model, 0.5 AS cut UNION ALL SELECT 'b', 0.7),
p AS (SELECT m.model, (f.score >= m.cut) AS p, (trim(label_raw) LIKE 'Malicious%') AS y FROM flows f, m)
SELECT model, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp FROM p GROUP BY model""")
def q_merged_metrics(spark, d):
    """Metrics written and read, an older table's rows replaced by model name."""
    base = scratch_path(spark, f"metrics/{uuid.uuid4().hex}")
    y = (F.trim("label_raw").startswith("Malicious")).cast("int")

    def of(model, cut):
        rows = flows(spark, d).select(y.alias("label"), (F.col("score") >= cut).cast("int").alias("prediction"))
        return N.confusion(rows, "label").select(F.lit(model).alias("model"), "tp", "fp")

    logs.write_metrics(of("a", 0.1).unionByName(of("b", 0.7)), f"{base}/old")
    logs.write_metrics(of("a", 0.5), f"{base}/new")
    return logs.merge_metrics(logs.read_metrics(spark, f"{base}/old"), logs.read_metrics(spark, f"{base}/new")).select(
        "model", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"))


@query("first_rows", f"""WITH {V.FLOWS} SELECT uid, orig_h, resp_p, proto FROM flows ORDER BY uid LIMIT 10""")
def q_first_rows(spark, d):
    """H5: the first rows of the table by their key."""
    return flows(spark, d).select("uid", "orig_h", "resp_p", "proto").orderBy("uid").limit(10)


@query("feature_vectors", f"""WITH {V.FLOWS}
SELECT uid, CAST(orig_pkts AS DOUBLE) AS f0, CAST(resp_pkts AS DOUBLE) AS f1, CAST(resp_p AS DOUBLE) AS f2 FROM flows""",
       doubles=("f0", "f1", "f2"))
def q_feature_vectors(spark, d):
    """A vector of three features, read back in the order of their names."""
    from pyspark.ml.functions import vector_to_array
    v = vector_to_array("features")
    out = J.assemble(flows(spark, d), ["orig_pkts", "resp_pkts", "resp_p"])
    return out.select("uid", *[v[i].alias(f"f{i}") for i in range(3)])


_SKETCHED = ("resp_p", "orig_bytes", "resp_bytes", "orig_pkts")


@query("sketch_profile", f"""WITH {V.RAW}
""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(3 AS BIGINT) AS files, count(*) AS rows, count(*) - count({c}) AS missing,
CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, true AS distinct_fits, true AS median_fits FROM raw"""
    for c in _SKETCHED), doubles=("min", "max"))
def q_sketch_profile(spark, d):
    """The profile of three files from their stored sketches; counts and extremes
    exact, distinct counts within 5 % and the median within 2 % of the ranks."""
    df = raw(spark, d).select("source_file", *_SKETCHED)
    store = scratch_path(spark, f"sketches/{uuid.uuid4().hex}")
    files = [r[0] for r in df.select("source_file").distinct().collect()]
    K.update_store(spark, store, files[:1], lambda f: df.filter(F.col("source_file").isin(f)))
    K.update_store(spark, store, files, lambda f: df.filter(F.col("source_file").isin(f)))  # the others alone
    found = K.merged_profile(spark.read.parquet(store))
    exact = {r["column"]: r["n_distinct"] for r in J.cardinality(df, _SKETCHED).collect()}
    medians = {r["column"]: r["q50"] for r in found.collect()}
    ranks = df.agg(*[F.struct(F.avg((F.col(c) < medians[c]).cast("double")).alias("lo"),
                              F.avg((F.col(c) <= medians[c]).cast("double")).alias("hi")).alias(c) for c in _SKETCHED]).first()
    fits = {c: ranks[c]["lo"] <= 0.52 and ranks[c]["hi"] >= 0.48 for c in _SKETCHED}
    look = F.create_map(*[x for c in _SKETCHED for x in (F.lit(c), F.struct(
        F.lit(exact[c]).alias("n"), F.lit(fits[c]).alias("median")))])[F.col("column")]
    return found.select("column", "files", "rows", "missing", "min", "max",
                        (F.abs(F.col("n_distinct") - look["n"]) <= 1 + 0.05 * look["n"]).alias("distinct_fits"),
                        look["median"].alias("median_fits"))
