"""Connection-log views derived from the driver's tables.

The reference reads Zeek ``conn.log`` exports. The test tables have no such
log, so ``flows_from_events`` derives one from ``events`` with fixed rules
(FIXTURES.md §3); the same rules are written in SQL for the oracle, so both
engines see the same connections. ``flows_from_lineitem`` is the dense view
used at scale: a supplier is a source, a part is a port, the ship date is time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flows_from_events(events: DataFrame) -> DataFrame:
    """Raw connection records, one per event; numeric text as in the log."""
    eid = F.col("event_id")
    et = F.col("event_type")
    cents = F.round(F.col("value") * 100).cast("bigint")
    proto = (F.when(eid % 10 <= 5, "tcp").when(eid % 10 <= 8, "udp").otherwise("icmp"))
    # fixed values: event type -> connection state
    state = (F.when(et == "error", "S0").when(et == "click", "SF").when(et == "view", "S1")
             .when(et == "purchase", "RSTO").when(et == "signup", "REJ"))
    # fixed values: event type -> raw label text (compound label has three blanks)
    label_raw = (F.when(et == "error", "Malicious   PartOfAHorizontalPortScan")
                 .when(et == "signup", "  Malicious").otherwise("Benign"))
    # fixed values: event id mod 6 -> service ('-' is the log's unset marker)
    m6 = eid % 6
    service = (F.when(m6 == 0, "dns").when(m6 == 1, "http").when(m6 == 2, F.lit(None).cast("string"))
               .when(m6 == 3, "dns").when(m6 == 4, "ssl").otherwise("-"))
    return events.select(
        eid.alias("uid"),
        F.col("ts").alias("event_time"),
        F.col("user_id").alias("orig_h"),
        F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("resp_p"),
        proto.alias("proto"),
        state.alias("conn_state"),
        service.alias("service"),
        cents.alias("cents"),
        F.when(eid % 5 == 0, F.lit("-")).otherwise(cents.cast("string")).alias("duration_raw"),
        F.when(eid % 10 == 3, F.lit(None).cast("bigint")).otherwise(cents).alias("orig_bytes"),
        F.when(eid % 4 == 1, F.lit(None).cast("bigint")).otherwise((cents * 7) % 5000).alias("resp_bytes"),
        (cents % 13).alias("orig_pkts"),
        (cents % 7).alias("resp_pkts"),
        F.when(eid % 50 == 0, 1).otherwise(0).cast("bigint").alias("missed_bytes"),
        label_raw.alias("label_raw"),
        F.when((et == "error") & (eid % 7 == 0), F.lit("C&C")).otherwise(F.lit(None).cast("string"))
        .alias("detailed_label"),
        F.concat(F.lit("part"), (eid % 3).cast("string")).alias("source_file"),
        (((eid * 37) % 101) / F.lit(100.0)).alias("score"),
    )


def flows_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Dense connection view at scale: many rows per source and per day."""
    return lineitem.select(
        F.col("l_orderkey").alias("uid"),
        F.col("l_shipdate").alias("event_time"),
        F.col("l_suppkey").alias("orig_h"),
        F.col("l_partkey").alias("resp_p"),
        F.when(F.col("l_returnflag") == "R", "udp").otherwise("tcp").alias("proto"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("conn_state"),
        F.col("l_quantity").alias("orig_pkts"),
        F.col("l_extendedprice").alias("orig_bytes"),
        F.col("l_tax").alias("resp_bytes"),
        F.when(F.col("l_returnflag") == "R", "Malicious").otherwise("Benign").alias("label"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_from_events(read_table(spark, sf_dir, "events"))
