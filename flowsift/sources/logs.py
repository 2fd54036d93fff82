"""Sources and sinks.

Logs are ``|``-delimited text with a header. They are read as text columns
(no schema-inference pass over the data) and typed with ``try_cast``
afterwards, so a ``-`` in a numeric field becomes NULL instead of failing
the job. Files whose headers differ are read per header group and unioned
by name; a column missing in one group is NULL there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.functions.columns import LOG_NUMERIC_COLUMNS, coerce_numeric

# fixed values: Zeek integer fields and their Spark types after reading
INT_FIELDS = {"orig_p": "int", "resp_p": "int", "orig_pkts": "bigint", "resp_pkts": "bigint",
              "orig_ip_bytes": "bigint", "resp_ip_bytes": "bigint", "missed_bytes": "bigint"}

HEADERS_AT_ONCE = 32


def normalise_name(name: str) -> str:
    """'id.orig_h' -> 'orig_h', 'detailed-label' -> 'detailed_label'."""
    name = name.strip()
    if name.startswith("id."):
        name = name[3:]
    return re.sub(r"[^0-9A-Za-z_]", "_", name)


def _file_status(spark: SparkSession, path: str) -> list:
    """Hadoop's status of the data files under ``path`` (a file, folder or glob), by name."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    out = []
    for st in fs.globStatus(p) or []:
        if st.isDirectory():
            it = fs.listFiles(st.getPath(), True)
            while it.hasNext():
                f = it.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    out.append(f)
        else:
            out.append(st)
    return sorted(out, key=lambda f: f.getPath().toString())


def _list_files(spark: SparkSession, path: str) -> list[str]:
    """Data files under ``path``, via the Hadoop file system."""
    return [f.getPath().toString() for f in _file_status(spark, path)]


def file_versions(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of every data file under ``path``: changes when they do."""
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in _file_status(spark, path))


def _header(spark: SparkSession, file: str) -> str:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(file)
    stream = p.getFileSystem(conf).open(p)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    stream = codec.createInputStream(stream) if codec is not None else stream
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return reader.readLine() or ""
    finally:
        stream.close()


# A1 / A2 / F4
def read_flows(spark: SparkSession, path: str, sep: str = "|", typed: bool = True,
               numeric: Sequence[str] = LOG_NUMERIC_COLUMNS, mixed_headers: bool = True) -> DataFrame:
    """Read one log file or every log file under a folder.

    Adds ``source_file``; renames dotted / hyphenated names; types known
    numeric fields (unparsable -> NULL) and the timestamp. With
    ``mixed_headers`` the header line of every file is read (a short read
    per file, many at a time) and files are grouped by header; without it, the
    folder is one CSV scan under the first file's header, and a file with
    another header is an error.
    """
    files = _list_files(spark, path)
    if not files:
        raise FileNotFoundError(path)
    groups: dict[str, list[str]] = {}
    if mixed_headers:
        with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:  # waits for the store, not for the processor
            for f, header in zip(files, pool.map(lambda f: _header(spark, f), files)):
                groups.setdefault(header, []).append(f)
    else:
        groups[_header(spark, files[0])] = files
    parts = []
    for header, members in groups.items():
        raw = header.split(sep)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in raw])
        df = (spark.read.option("sep", sep).option("header", True).option("enforceSchema", mixed_headers)
              .option("mode", "PERMISSIVE").schema(schema).csv(members))
        parts.append(df.select(*[F.col(f"`{n}`").alias(normalise_name(n)) for n in raw],
                               F.col("_metadata.file_name").alias("source_file")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return type_flows(out, numeric) if typed else out


def type_flows(df: DataFrame, numeric: Sequence[str] = LOG_NUMERIC_COLUMNS) -> DataFrame:
    df = coerce_numeric(df, numeric)
    ints = {c: F.col(c).try_cast(t) for c, t in INT_FIELDS.items()
            if c in df.columns and c not in numeric}
    if "ts" in df.columns:
        ints["ts"] = F.col("ts").try_cast("double")
    return df.withColumns(ints) if ints else df


# A3
def head_per_group(df: DataFrame, group: str, order: str | Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of each group by an explicit order key.

    ``row_number() <= n`` lets Spark insert a per-task group limit before the
    shuffle (WindowGroupLimit), so even a hot group ships at most ``n`` rows
    per input task.
    """
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# A4
def write_flows(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = (), sep: str = "|") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("sep", sep).option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


# A5
def write_dataset(train: DataFrame, test: DataFrame, path: str, features: Sequence[str],
                  label: str = "target") -> None:
    """Train and test rows in one Parquet table partitioned by ``split``,
    plus the feature names beside it."""
    both = (train.withColumn("split", F.lit("train"))
            .unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True))
    both.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    spark = train.sparkSession
    spark.createDataFrame([(json.dumps(list(features)), label)], "features string, label string") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/meta")


# A6
def load_dataset(spark: SparkSession, path: str):
    """-> (train, test, feature names, label, class share per split)."""
    data = spark.read.parquet(f"{path}/data")
    meta = spark.read.json(f"{path}/meta").first()
    features, label = json.loads(meta["features"]), meta["label"]
    from flowsift.operators.profile import class_share
    share = class_share(data, label, ["split"])
    return (data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test"),
            features, label, share)


# A7
def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


# A8
def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


# A9 / F5
def merge_metrics(a: DataFrame, b: DataFrame, key: str = "model") -> DataFrame:
    """Union two metrics tables by column name; a later row replaces an
    earlier one with the same model name."""
    both = (a.withColumn("_o", F.lit(0)).unionByName(b.withColumn("_o", F.lit(1)), allowMissingColumns=True))
    w = Window.partitionBy(key).orderBy(F.desc("_o"))
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_o")
