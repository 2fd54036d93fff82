"""Runs of periodically repeated words, by recursive frequency splitting.

Words are runs of characters other than ASCII white space. A run is a stretch
of words with smallest period q (words q apart are equal), of max(LEAST, 2 * q)
words or more, that no neighbouring word extends keeping period q.

1. Splitting. A run's words each occur twice in it at least, so a word that
   occurs once in its segment (at first: its text) is in no run: it splits the
   segment, and segments under LEAST words go. The shorter segments make more
   words too rare; this repeats until nothing splits. Of ordinary prose little
   is left. All texts of a batch are split together.
2. Lag scan of the segments that are left. A run of period q has m =
   max(LEAST - q, q) consecutive matches of words q apart, so one at a multiple
   of m: only those places are compared, about n log n for all lags up to half
   the segment. A match is followed both ways to the run's ends. Lags are taken
   in blocks [2^k, 2^(k+1)), none a multiple of another; a match within a found
   run whose period divides the lag is that run's own, so the periods kept are
   the smallest. No length is capped.

``collapsed`` leaves out the words that any run contains after its first q.

Nulls and ties: a null or empty text has no words, no runs and an empty
collapsed text; rows are treated one by one, equal ones alike; an empty table
gives an empty result. Columns of ``df`` stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.llm.base import fresh, quoted

LEAST = 12              # words of a run at least
BATCH_BYTES = 8 << 20   # of the texts that are split together, about
PAIRS = 1 << 21         # pairs compared at once
LOOK = 16               # words a match is followed in step with the others

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
    T.StructField("collapsed", T.StringType())])


def surviving_segments(ids: np.ndarray, sizes: list[int], least: int = LEAST) -> list[tuple[int, int]]:
    """(first, end) of the stretches of ``ids`` that splitting leaves; sizes: words of each text."""
    at = np.arange(len(ids))
    segment = np.repeat(np.arange(len(sizes)), sizes)
    while True:
        # segments under ``least`` words go
        long = (np.bincount(segment, minlength=1) >= least)[segment] if len(at) else np.zeros(0, bool)
        at, segment = at[long], segment[long]
        if not len(at):
            return []
        # words that occur once in their segment split it
        key = segment * (int(ids.max()) + 1) + ids[at]
        order = np.argsort(key)
        k = key[order]
        differs = k[1:] != k[:-1]
        once = np.empty(len(k), bool)
        once[order] = np.concatenate([[True], differs]) & np.concatenate([differs, [True]])
        if not once.any():
            starts = np.flatnonzero(np.concatenate([[True], np.diff(segment) != 0]))
            ends = np.append(starts[1:], len(at)) - 1
            return [(int(at[a]), int(at[b]) + 1) for a, b in zip(starts, ends)]
        at, segment = at[~once], segment[~once]
        new = (np.diff(at) != 1) | (np.diff(segment) != 0)
        segment = np.cumsum(np.concatenate([[False], new])) if len(at) else segment


def _anchors(lags: np.ndarray, n: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of the places that each lag compares, PAIRS at a time, about."""
    step = np.maximum(least - lags, lags)
    count = -(-(n - lags) // step)
    first = 0
    while first < len(lags):
        upto = max(first + 1, int(np.searchsorted(np.cumsum(count[first:]), PAIRS, "right")) + first)
        c = count[first:upto]
        q = np.repeat(lags[first:upto], c)
        number = np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c)
        yield number * np.repeat(step[first:upto], c), q
        first = upto


def _matches(x: np.ndarray, i: int, q: int, by: int) -> int:
    """How many words beyond place i, going by +1 or -1, equal those q further on."""
    n, done, width = len(x), 0, 64
    while True:
        room = min(width, n - q - 1 - i - done if by > 0 else i - done)
        if room <= 0:
            return done
        a = i + 1 + done if by > 0 else i - done - room
        differ = np.flatnonzero(x[a:a + room] != x[a + q:a + q + room])
        if len(differ):
            return done + int(differ[0] if by > 0 else room - 1 - differ[-1])
        done, width = done + room, width * 2


def scan_lags(x: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment."""
    n, found, low = len(x), [], 1
    while low <= n // 2:
        lags = np.arange(low, min(2 * low, n // 2 + 1))
        new = []
        for i, q in _anchors(lags, n, least):
            hit = x[i] == x[i + q]
            i, q = i[hit], q[hit]
            # followed a few words in step: most matches of ordinary words end there
            need, got, open_end = np.maximum(least - q, q), np.ones(len(i), np.int64), np.zeros(len(i), bool)
            for by in (1, -1):
                live = np.arange(len(i))
                for d in range(1, LOOK + 1):
                    a = i[live] + by * d
                    inside = (a >= 0) & (a + q[live] < n)
                    live, a = live[inside], a[inside]
                    live = live[x[a] == x[a + q[live]]]
                    got[live] += 1
                open_end[live] = True
            ahead = open_end | (got >= need)
            i, q = i[ahead], q[ahead]
            for start, length, p in found:  # matches that a run of a smaller period makes
                own = (q % p == 0) & (i >= start) & (i + q < start + length)
                i, q = i[~own], q[~own]
            last, end = 0, 0
            for a, lag in zip(i.tolist(), q.tolist()):
                if lag == last and a < end:
                    continue  # within the stretch just followed
                lo = a - _matches(x, a, lag, -1)
                end, last = a + 1 + _matches(x, a, lag, 1), lag
                if end - lo >= max(least - lag, lag):
                    new.append((lo, end - lo + lag, lag))
        found += new
        low *= 2
    return found


def find_runs(ids: np.ndarray, sizes: list[int], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start and period; ids: the texts' words as numbers, one after another."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    ends = np.cumsum(sizes)
    for a, b in surviving_segments(ids, sizes, least):
        text = int(np.searchsorted(ends, a, "right"))
        first = int(ends[text]) - sizes[text]
        out[text] += [(a - first + s, length, q) for s, length, q in scan_lags(ids[a:b], least)]
    return [sorted(r, key=lambda r: (r[0], r[2])) for r in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _analyse(texts: list[str | None], least: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    number: dict[bytes, int] = {}
    parts, sizes = [], []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").split()
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        sizes.append(len(words))
    number.clear()
    found = find_runs(np.concatenate(parts) if parts else np.empty(0, np.int64), sizes, least)
    for t, n, runs in zip(texts, sizes, found):
        words = (t or "").encode("utf-8", "surrogatepass").split()
        if runs:
            words = [words[i] for i in np.flatnonzero(kept_words(n, runs))]
        yield n, runs, b" ".join(words).decode("utf-8", "surrogatepass")


def with_runs(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``df`` and three columns: n_words, runs (array of start, length, period by start
    and period) and collapsed (the kept words, joined by single blanks)."""
    kind = "array<struct<start:long,length:long,period:long>>"

    @F.pandas_udf(f"n_words long, runs {kind}, collapsed string")
    def analysed(batch):
        import pandas as pd
        rows, part, held = [], [], 0
        for t in batch:
            part.append(t)
            held += len(t or "")
            if held >= BATCH_BYTES:
                rows += _analyse(part, least)
                part, held = [], 0
        rows += _analyse(part, least)
        return pd.DataFrame([(n, [dict(zip(("start", "length", "period"), r)) for r in runs], c) for n, runs, c in rows],
                            columns=["n_words", "runs", "collapsed"])

    at, *names = fresh(df, "_found", "n_words", "runs", "collapsed")
    out = df.withColumn(at, analysed(quoted(text)))
    return out.select(*map(quoted, df.columns), *[F.col(f"{at}.{c}").alias(k) for c, k in zip(
        ("n_words", "runs", "collapsed"), names)])


def run_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli) and
    sha256 digests of all runs and of the collapsed text."""
    found = with_runs(df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")), "text", least)
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("best", best)
    length, period = -F.col("best.less"), F.col("best.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                        length.alias("length"), period.alias("period"),
                        F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
