"""Per-source window features.

A source IP can own a third of all connections (port scans), so no window
here is partitioned by the source alone. The time axis of every source is
cut into chunks of ``chunk_seconds`` (default: four window lengths). A row
is processed in its own chunk and, when it lies within one window length of
the next chunk(s), copied there as read-only context ("halo"). Each
(source, chunk) task then has everything its rows' trailing windows need, so
results are exact while a hot source spreads over as many tasks as it has
chunks. Extra rows: about window/chunk of the input.

Windows are trailing and inclusive: ``[t - window, t]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.session import join_null_safe, maybe_broadcast

US = 1_000_000


def micros(ts: str | Column, df: DataFrame | None = None) -> Column:
    """Microseconds since the epoch. A TIMESTAMP_NTZ wall clock is read as
    UTC whatever the session zone (rebuilt from its fields, so no DST gap or
    overlap of the session zone can distort differences); a TIMESTAMP is
    already an instant."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if df is not None and isinstance(ts, str) and isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.unix_micros(F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                                              F.extract(F.lit("SECOND"), c), F.lit("UTC")))
    return F.unix_micros(c.cast("timestamp"))


def _and_untimed(df: DataFrame, ts: str, features, *outs: str) -> DataFrame:
    """``features`` of the rows that have a time, plus the rows without one, whose features are NULL."""
    timed = features(df.filter(F.col(ts).isNotNull()))
    types = {f.name: f.dataType for f in timed.schema.fields}
    untimed = df.filter(F.col(ts).isNull()).withColumns({o: F.lit(None).cast(types[o]) for o in outs})
    return timed.unionByName(untimed)


def _with_parts(df: DataFrame, t: Column, window_us: int, chunk_us: int) -> DataFrame:
    """Adds ``_t`` (µs), ``_part`` (chunk processed in) and ``_home`` (1 in the row's own chunk)."""
    home = F.floor(F.col("_t") / chunk_us)
    last = F.floor((F.col("_t") + window_us) / chunk_us)
    return (df.withColumn("_t", t)
            .withColumn("_chunk", home)
            .withColumn("_part", F.explode(F.sequence(home, last)))
            .withColumn("_home", (F.col("_part") == F.col("_chunk")).cast("int"))
            .drop("_chunk"))


def _chunk(window_seconds: float, chunk_seconds: float | None) -> tuple[int, int]:
    w = int(round(window_seconds * US))
    c = int(round((chunk_seconds if chunk_seconds else 4 * window_seconds) * US))
    return w, max(c, 1)


MAX_TASK_ROWS = 5_000_000


def densest_window(df: DataFrame, key: str, ts: str, seconds: float) -> int:
    """Rows of the densest (key, window-length slot): one partial-aggregate pass."""
    slot = F.floor(micros(ts, df) / int(round(seconds * US)))
    return df.groupBy(F.col(key), slot.alias("_s")).count().agg(F.max("count")).first()[0] or 0


# G1
def rolling_count(df: DataFrame, key: str, ts: str, seconds: float = 300, out: str = "conn_rate",
                  chunk_seconds: float | None = None, method: str = "auto",
                  max_task_rows: int = MAX_TASK_ROWS) -> DataFrame:
    """Connections of the same key in the trailing window (the row included);
    NULL for rows without a time. ``method`` as in ``source_window_features``."""
    return _and_untimed(df, ts, lambda x: _rolling_count(x, key, ts, seconds, out, chunk_seconds, method, max_task_rows),
                        out)


def _rolling_count(df: DataFrame, key: str, ts: str, seconds: float, out: str, chunk_seconds: float | None, method: str,
                   max_task_rows: int) -> DataFrame:
    if method == "auto":
        dens = densest_window(df, key, ts, seconds)
        if dens * ((chunk_seconds / seconds if chunk_seconds else 4.0) + 1.0) > max_task_rows:
            method, chunk_seconds = "prefix", max(seconds * max_task_rows / max(dens, 1), 1e-6)
    if method == "prefix":
        return _prefix_features(df, key, ts, None, seconds, out, None, chunk_seconds or seconds / 4)
    w_us, c_us = _chunk(seconds, chunk_seconds)
    x = _with_parts(df, micros(ts, df), w_us, c_us)
    win = Window.partitionBy(key, "_part").orderBy("_t").rangeBetween(-w_us, 0)
    return (x.withColumn(out, F.count(F.lit(1)).over(win))
            .filter(F.col("_home") == 1).drop("_t", "_part", "_home"))


# G1 + G2
def source_window_features(df: DataFrame, key: str, ts: str, val: str, seconds: float = 300,
                           rate_out: str = "conn_rate_5min", distinct_out: str = "port_scan_score",
                           chunk_seconds: float | None = None, method: str = "auto",
                           max_task_rows: int = MAX_TASK_ROWS) -> DataFrame:
    """Rolling connection count and exact rolling distinct count of ``val``.

    ``method``: 'halo' (below), 'prefix' (``source_window_features_prefix``)
    or 'auto': the halo form while one task's rows (about
    (chunk/window + 1) × the densest window of one key) stay within
    ``max_task_rows``, otherwise the prefix form with chunks sized so a chunk
    of the densest key holds about ``max_task_rows`` rows.

    Distinct count by sweep instead of a set per row: an occurrence of a value
    at t keeps it "active" on [t, min(next occurrence, t + window + 1µs)).
    Each such piece emits +1 at its start and -1 at its end; the number of
    distinct values in a row's window is the running sum of these deltas at
    the row's time. The pieces need the next occurrence of the same value
    (``lead`` over key, chunk, value); the running sum and the row count
    share one window over (key, chunk). NULL values are not counted; a NULL key
    is a key; rows without a time stay, with NULL features.
    """
    return _and_untimed(df, ts, lambda x: _window_features(x, key, ts, val, seconds, rate_out, distinct_out,
                                                           chunk_seconds, method, max_task_rows), rate_out, distinct_out)


def _window_features(df: DataFrame, key: str, ts: str, val: str, seconds: float, rate_out: str, distinct_out: str,
                     chunk_seconds: float | None, method: str, max_task_rows: int) -> DataFrame:
    if method == "auto":
        dens = densest_window(df, key, ts, seconds)
        ratio = (chunk_seconds / seconds if chunk_seconds else 4.0) + 1.0
        if dens * ratio > max_task_rows:
            chunk = max(seconds * max_task_rows / max(dens, 1), 1e-6)
            return _prefix_features(df, key, ts, val, seconds, rate_out, distinct_out, chunk)
    elif method == "prefix":
        return _prefix_features(df, key, ts, val, seconds, rate_out, distinct_out, chunk_seconds or seconds / 4)
    w_us, c_us = _chunk(seconds, chunk_seconds)
    x = _with_parts(df, micros(ts, df), w_us, c_us)
    # pieces of the sweep, one per occurrence; equal (value, t) pairs give empty pieces
    occ = x.filter(F.col(val).isNotNull()).select(key, "_part", val, "_t")
    nxt = F.lead("_t").over(Window.partitionBy(key, "_part", val).orderBy("_t"))
    pieces = occ.withColumn("_end", F.least(F.coalesce(nxt, F.lit(2 ** 62)), F.col("_t") + (w_us + 1)))
    deltas = pieces.select(key, "_part", F.inline(F.array(
        F.struct(F.col("_t").alias("_at"), F.lit(1).alias("_d")),
        F.struct(F.col("_end").alias("_at"), F.lit(-1).alias("_d")))))
    rows = x.withColumn("_at", F.col("_t")).withColumn("_d", F.lit(0)).withColumn("_row", F.lit(1))
    stream = rows.unionByName(deltas.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(key, "_part").orderBy("_at")
    out = (stream
           .withColumn(distinct_out, F.sum("_d").over(order.rangeBetween(Window.unboundedPreceding, 0)))
           .withColumn(rate_out, F.sum("_row").over(order.rangeBetween(-w_us, 0))))
    return (out.filter((F.col("_row") == 1) & (F.col("_home") == 1))
            .drop("_t", "_part", "_home", "_at", "_d", "_row"))


# G1 + G2, bounded tasks for any density
def source_window_features_prefix(df: DataFrame, key: str, ts: str, val: str | None, seconds: float = 300,
                                  rate_out: str = "conn_rate_5min", distinct_out: str = "port_scan_score",
                                  chunk_seconds: float = 60.0) -> DataFrame:
    """Same results as ``source_window_features``, with no lower bound on the
    rows a task must hold (the halo form needs one window of a source's rows
    per task; a source with millions of connections per window breaks that).

    Both features are running sums of deltas evaluated at each row's time: a
    row adds 1 to both at t; the count gets -1 at t + window + 1µs, the
    distinct count -1 where the sweep piece ends (one delta where both meet).
    Time is cut into short chunks. The sum over all earlier chunks of the
    source (a prefix over the per-chunk totals) is one more delta at the start
    of each chunk, so a running sum inside (source, chunk) gives the value and
    nothing is joined. The next occurrence of a value is found inside (source,
    value, chunk); the first one of the value's next non-empty chunk is a
    marker row there, for the last one of a chunk.
    """
    outs = [rate_out] + ([distinct_out] if val is not None else [])
    return _and_untimed(df, ts, lambda x: _prefix_features(x, key, ts, val, seconds, rate_out, distinct_out,
                                                           chunk_seconds), *outs)


def _prefix_features(df: DataFrame, key: str, ts: str, val: str | None, seconds: float, rate_out: str,
                     distinct_out: str | None, chunk_seconds: float) -> DataFrame:
    w_us, c_us = int(round(seconds * US)), max(int(round(chunk_seconds * US)), 1)
    x = df.withColumn("_t", micros(ts, df))
    close = F.col("_t") + (w_us + 1)
    if val is None:  # the count alone
        ends = x.select(key, close.alias("_at"), F.lit(-1).alias("_dr"), F.lit(0).alias("_dd"))
        return _prefix_eval(x, ends, key, F.lit(0), c_us, rate_out, None)
    occ = x.filter(F.col(val).isNotNull()).select(key, val, "_t", F.floor(F.col("_t") / c_us).alias("_c"))
    firsts = occ.groupBy(key, val, "_c").agg(F.min("_t").alias("_first"))
    later = F.lead("_first").over(Window.partitionBy(key, val).orderBy("_c"))
    markers = firsts.withColumn("_t", later).filter(F.col("_t").isNotNull()).select(key, val, "_t", "_c", F.lit(0).alias("_occ"))
    nxt = F.lead("_t").over(Window.partitionBy(key, val, "_c").orderBy("_t"))
    pieces = (occ.withColumn("_occ", F.lit(1)).unionByName(markers)
              .withColumn("_end", F.least(F.coalesce(nxt, F.lit(2 ** 62)), close)).filter(F.col("_occ") == 1))

    def delta(at, dr, dd):
        return F.struct(at.alias("_at"), F.lit(dr).alias("_dr"), F.lit(dd).alias("_dd"))

    ends = pieces.select(key, F.inline(F.when(F.col("_end") == close, F.array(delta(close, -1, -1)))
                                       .otherwise(F.array(delta(F.col("_end"), 0, -1), delta(close, -1, 0)))))
    ends = ends.unionByName(x.filter(F.col(val).isNull()).select(key, F.inline(F.array(delta(close, -1, 0)))))
    return _prefix_eval(x, ends, key, F.col(val).isNotNull().cast("int"), c_us, rate_out, distinct_out)


def _prefix_eval(x: DataFrame, ends: DataFrame, key: str, counted: Column, c_us: int, rate_out: str,
                 distinct_out: str | None) -> DataFrame:
    """Running sums at every row's time of the rows' own deltas (1, ``counted``) and of
    ``ends``: inside (key, chunk), where the key's earlier chunks are one delta."""
    rows = x.withColumn("_at", F.col("_t")).withColumn("_dr", F.lit(1)).withColumn("_dd", counted) \
        .withColumn("_row", F.lit(1))
    ends = ends.withColumn("_row", F.lit(0))
    chunk = F.floor(F.col("_at") / c_us)
    totals = (rows.select(key, "_at", "_dr", "_dd", "_row").unionByName(ends).groupBy(key, chunk.alias("_c"))
              .agg(F.sum("_dr").alias("_tr"), F.sum("_dd").alias("_td"), F.max("_row").alias("_any")))
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(key, (F.col("_c") * c_us).alias("_at"), F.sum("_tr").over(before).alias("_dr"),
                            F.sum("_td").over(before).alias("_dd"), F.lit(0).alias("_row"), "_any")
    earlier = earlier.filter((F.col("_any") == 1) & F.col("_dr").isNotNull()).drop("_any")
    stream = (rows.unionByName(ends, allowMissingColumns=True).unionByName(earlier, allowMissingColumns=True)
              .withColumn("_c", chunk))
    run = Window.partitionBy(key, "_c").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    out = stream.withColumn(rate_out, F.sum("_dr").over(run))
    if distinct_out:
        out = out.withColumn(distinct_out, F.sum("_dd").over(run))
    return out.filter(F.col("_row") == 1).drop("_t", "_c", "_at", "_dr", "_dd", "_row")


# G2
def rolling_distinct(df: DataFrame, key: str, ts: str, val: str, seconds: float = 300,
                     out: str = "port_scan_score", chunk_seconds: float | None = None,
                     method: str = "auto") -> DataFrame:
    return source_window_features(df, key, ts, val, seconds, "_rate", out, chunk_seconds, method).drop("_rate")


# G3
def gap_stats(df: DataFrame, key: str, ts: str, mean_out: str = "time_delta_mean",
              std_out: str = "time_delta_std", chunk_seconds: float | None = None,
              max_broadcast_rows: int | None = None, max_task_rows: int = MAX_TASK_ROWS) -> DataFrame:
    """Mean and sample std (seconds) of the gaps between consecutive
    connections of each key, attached to every row of the key.

    Gaps inside a chunk come from ``lag`` over (key, chunk); the gap across a
    chunk border from a small per-(key, chunk) min/max table. The gap
    statistics are partial aggregates, so a hot key is summed in parallel.
    """
    if chunk_seconds is None:  # one hour, shorter if the densest source-hour exceeds the task budget
        dens = densest_window(df, key, ts, 3600.0)
        chunk_seconds = 3600.0 if dens <= max_task_rows else max(3600.0 * max_task_rows / dens, 1e-6)
    c_us = max(int(chunk_seconds * US), 1)
    x = df.select(key, micros(ts, df).alias("_t")).withColumn("_c", F.floor(F.col("_t") / c_us))
    inner = (x.withColumn("_g", F.col("_t") - F.lag("_t").over(Window.partitionBy(key, "_c").orderBy("_t")))
             .select(key, "_g"))
    edges = x.groupBy(key, "_c").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    border = (edges.withColumn("_g", F.col("_lo") - F.lag("_hi").over(Window.partitionBy(key).orderBy("_c")))
              .select(key, "_g"))
    gaps = inner.unionByName(border).filter(F.col("_g").isNotNull())
    # integer microsecond gaps: the sum is exact, one division at the end
    stats = gaps.groupBy(key).agg((F.avg("_g") / US).alias(mean_out), (F.stddev_samp("_g") / US).alias(std_out))
    if max_broadcast_rows is not None:
        from flowsift.session import maybe_broadcast
        stats = maybe_broadcast(stats, max_broadcast_rows)
    return join_null_safe(df, stats, [key], "left")  # a NULL source is a source


# G4
def window_counts(df: DataFrame, key: str, ts: str, every: str = "5 minutes", slide: str | None = None,
                  val: str | None = None) -> DataFrame:
    """Connections (and distinct ``val``) per key and tumbling/sliding window."""
    win = F.window(ts, every, slide) if slide else F.window(ts, every)
    aggs = [F.count(F.lit(1)).alias("connections")]
    if val:
        aggs.append(F.count_distinct(val).alias("distinct_" + val))
    g = df.groupBy(key, win.alias("w")).agg(*aggs)
    return g.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *[a for a in g.columns if a not in (key, "w")])


def _series_order() -> Window:
    # one row per time bin: the series is small (bins, not rows), so one ordered task is fine
    return Window.orderBy("window_start")


# G5
def failed_ratio(df: DataFrame, ts: str, every: str = "5 minutes", state: str = "conn_state",
                 failed: Sequence[str] = ("S0", "REJ"), ok: Sequence[str] = ("SF",)) -> DataFrame:
    """failed / successful connections per window and its rise over the previous window."""
    g = df.groupBy(F.window(ts, every).start.alias("window_start")).agg(
        F.count_if(F.col(state).isin(*failed)).alias("failed"),
        F.count_if(F.col(state).isin(*ok)).alias("succeeded"))
    return ratio_change(g.withColumn("failed_ratio", F.try_divide(F.col("failed").cast("double"), F.col("succeeded"))))


def ratio_change(series: DataFrame) -> DataFrame:
    """The rise of ``failed_ratio`` over the previous window of a window series."""
    return series.withColumn("ratio_change", F.col("failed_ratio") - F.lag("failed_ratio").over(_series_order()))


# G6
def share_series(df: DataFrame, ts: str, col: str = "proto", every: str = "5 minutes") -> DataFrame:
    """Share of each value per window and its change against the value's previous window."""
    g = df.filter(F.col(col).isNotNull()).groupBy(F.window(ts, every).start.alias("window_start"), col) \
        .agg(F.count(F.lit(1)).alias("count"))
    return shares(g, col)


def shares(counts: DataFrame, col: str) -> DataFrame:
    """Shares and their changes from the counts per (window_start, ``col``)."""
    g = counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("window_start")))
    return g.withColumn("share_change", F.col("share") - F.lag("share").over(
        Window.partitionBy(col).orderBy("window_start")))


# G7
def low_volume_share(df: DataFrame, ts: str, every: str = "5 minutes", bytes_col: str = "orig_bytes",
                     pkts_col: str = "orig_pkts", max_bytes: float = 100.0, max_pkts: float = 2.0) -> DataFrame:
    """Mean bytes per packet and the share of low-byte, low-packet connections per window."""
    # plain aggregates only, so the same function serves a stream
    bpp = F.col(bytes_col) / F.when(F.col(pkts_col) == 0, F.lit(1)).otherwise(F.col(pkts_col))
    low = (F.coalesce(F.col(bytes_col), F.lit(0)) <= max_bytes) & (F.coalesce(F.col(pkts_col), F.lit(0)) <= max_pkts)
    return df.groupBy(F.window(ts, every).start.alias("window_start")).agg(
        F.avg(bpp).alias("bytes_per_pkt"), (F.count_if(low) / F.count(F.lit(1))).alias("low_volume_share"))
