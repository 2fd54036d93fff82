"""Session set-up and the few cluster-safety helpers every operator shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Above this many rows or bytes a statistics table is joined with a shuffle instead
# of being broadcast. Group-statistic tables (one row per category) stay far below.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20
# what one task of an iterative fit may hold in memory
TASK_BYTES = 256 << 20


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "flowsift") -> SparkSession:
    """Session with the settings the operators assume (UTC, AQE, no UI).

    On a cluster pass ``master=None`` and let spark-submit decide; local runs
    pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    local = bool(master) and master.startswith("local")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # first-n-per-group (A3) keeps up to 10,000 rows per group; let the
        # optimizer insert the map-side group limit for sizes that large.
        "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    }
    if local:
        # one JVM: the driver's memory is the executors' memory
        conf["spark.driver.memory"] = os.environ.get("FLOWSIFT_DRIVER_MEMORY", "16g")
    if shuffle_partitions or local:
        # on a cluster the site's setting (with AQE coalescing) is kept unless one is given
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or max(cpus, 8))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    always used. Only when it is unset and Spark runs in one local process
    (tests) is a scratch folder made; a cluster without one is an error, as
    other machines couldn't read what the driver's disk holds.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="flowsift-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder, for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, as columns, to the shared folder and read back: later passes
    read the columns they need instead of computing all rows again."""
    path = scratch_path(df.sparkSession, f"{name}/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int, row_bytes: int, least: int | None = None) -> int:
    """Tasks over ``rows`` rows of ``row_bytes`` bytes in memory, so that none holds more than
    ``TASK_BYTES``; a multiple of ``least`` (the session's cores), so that the last tasks of a
    pass leave no core idle."""
    least = max(least or spark.sparkContext.defaultParallelism, 1)
    return max(-(-rows * row_bytes // (TASK_BYTES * least)), 1) * least


def merged(df: DataFrame, tasks: int) -> DataFrame:
    """A materialised ``df`` of partitions of about one size in ``tasks`` partitions: without
    a shuffle where it has as many, else dealt anew."""
    return df.coalesce(tasks) if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def maybe_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``small`` only after checking its rows and bytes.

    The table (usually an aggregate) is first written once to the reliable
    checkpoint folder, so counting it and joining it do not compute it twice.
    Above the bound the plain DataFrame is returned and Spark joins it with a
    shuffle (AQE may still convert it at run time when it turns out small).
    """
    small = cut_lineage(small)
    wide = [f.name for f in small.schema.fields if not isinstance(f.dataType, T.AtomicType)
            or isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in wide]
    per_row = sum(size, F.lit(16 * len(small.columns)))
    n, total = small.agg(F.count(F.lit(1)), F.sum(per_row)).first()
    return F.broadcast(small) if n <= max_rows and (total or 0) <= BROADCAST_MAX_BYTES else small


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name, NULL equal to NULL; the keys appear once."""
    keys = list(keys)
    names = {k: f"__r_{i}" for i, k in enumerate(keys)}
    hint = right._jdf.queryExecution().logical().nodeName() == "ResolvedHint"
    right = right.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns])
    right = F.broadcast(right) if hint else right
    cond = reduce(and_, [left[f"`{k}`"].eqNullSafe(right[n]) for k, n in names.items()])
    return left.join(right, cond, how).drop(*names.values())
