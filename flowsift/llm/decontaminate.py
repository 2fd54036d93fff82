"""Benchmark decontamination: every training passage queries a BM25 index of
the test items with block-max WAND, and what is retrieved is verified.

The index is built by Spark over all items (term and document frequencies,
lengths) and collected in shards of bounded size; each shard is broadcast and
the texts are scanned once for it (benchmarks of a few MB are one shard). An
item's impacts are divided by its own threshold, so that a passage is retrieved
when its score reaches 1. The threshold is the least BM25 score of any passage
that holds SHARE of the shingles of a part that decides (below): the part's full
score less its heaviest terms, as many as may be absent then. A part of no more
distinct words than that (number grids, repeated words) still has so many shingles
held that one of them weighs as much as the lightest of that rank: this is its
threshold. The least one over the parts is the item's, so retrieval loses nothing
of a passage that verification would accept.

A text is cut into passages (twice the longest item, half overlapping), each
passage is a query. WAND's first bound (sum of list maxima) and the bounds of
all blocks are evaluated for a batch of passages at once; the pivoting search
then runs inside the blocks that can reach the threshold.

Verification: the share of distinct five-word shingles (the words as one if fewer)
that the document holds of the item, of its question (all but the last sentence)
and of its answer (the last sentence). A document holds an item if it holds SHARE
of the whole, question and answer together, or SHARE of the question alone, where
that has LEAST_QUESTION shingles or more (a shorter one is no evidence). All three
shares are reported.

Words are lower-cased runs of letters, digits and underscores. Nulls and ties:
null or empty texts and items without words match nothing; equal items are all
reported; rows of one doc_id are reported for each row; empty tables give an
empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.llm.base import quoted
from flowsift.session import cut_lineage

K1, B = 1.2, 0.75
SHARE = 0.8            # of the shingles of an item, or of its question, that must be held
LEAST_QUESTION = 8     # shingles of a question that decides alone
SHINGLE = 5
BLOCK = 8              # items in a block of the index
SHARD_BYTES = 16 << 20  # text of the items in a broadcast shard
MIN_PASSAGE = 128      # words
BOUNDS = 1 << 22       # block bounds that are added up at once

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(ws: list[str], k: int = SHINGLE) -> set[str]:
    if not ws:
        return set()
    k = min(k, len(ws))
    return {" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)}


def question_and_answer(text: str) -> tuple[str, str]:
    parts = [p for p in SENTENCE.split(text) if WORD.search(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


class Vocabulary(dict):
    """Term numbers; -1 for other words."""

    def __missing__(self, word: str) -> int:
        return -1


def least_score(part: set[str], weight: dict[str, float]) -> float:
    """The least score of a passage that holds SHARE of a part's shingles."""
    lost = int((1 - SHARE) * len(part) + 1e-9)
    heavy = sorted((weight[w] for w in {w for s in part for w in s.split(" ")}), reverse=True)
    # every absent term takes a shingle of its own with it, so at most `lost` terms may be absent
    if lost < len(heavy):
        return sum(heavy[lost:])
    # few words in many shingles: the terms of the shingles that must be held
    sums = sorted(sum(weight[w] for w in sorted(set(s.split(" ")))) for s in part)
    return sums[len(part) - lost - 1]


class IndexShard:
    """Inverted index of some items: posting lists by item with impacts over the
    item's threshold, their maxima, and for each list the blocks of items it has,
    with the maxima there."""

    def __init__(self, items: list[tuple]):
        """items: (item_id, text, terms, impacts)."""
        self.ids = [x[0] for x in items]
        self.vocabulary = Vocabulary()
        lists: list[list[tuple[int, float]]] = []
        self.parts, longest = [], 1
        for at, (_, text, terms, impacts) in enumerate(items):
            ws = words(text)
            whole = shingles(ws)
            q, a = (shingles(words(x)) for x in question_and_answer(text))
            self.parts.append((whole, q, a))
            longest = max(longest, len(ws))
            weight = dict(zip(terms, impacts))
            threshold = least_score(whole, weight)
            if len(q) >= LEAST_QUESTION:
                threshold = min(threshold, least_score(q, weight))
            for t, w in zip(terms, impacts):
                k = self.vocabulary.get(t)
                if k is None:
                    k = self.vocabulary[t] = len(lists)
                    lists.append([])
                lists[k].append((at, w / threshold))
        self.stride = max(MIN_PASSAGE // 2, longest)
        self.items = [[i for i, _ in x] for x in lists]
        self.impact = [[w for _, w in x] for x in lists]
        self.top = np.array([max(x) for x in self.impact], np.float64)
        self.n_blocks = -(-len(items) // BLOCK)
        self.blocks: list[list[int]] = []        # of each list
        self.block_top: list[list[float]] = []
        for x in lists:
            best: dict[int, float] = {}
            for i, w in x:  # rounded up: a bound may only be too large
                best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), w * (1 + 1e-6))
            self.blocks.append(sorted(best))
            self.block_top.append([best[k] for k in self.blocks[-1]])
        self.list_at = np.cumsum([0, *map(len, self.blocks)])
        self.all_blocks = np.array([k for x in self.blocks for k in x], np.int64)
        self.all_tops = np.array([w for x in self.block_top for w in x], np.float64)

    def search(self, terms: list[int], blocks: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND over the blocks whose bound reaches 1: (item, score) of
        all items that do.

        Inside a block the lists stand by their next item; the pivot is the first
        item at which the block maxima of the lists up to it add up to 1, and
        lists before it skip to it."""
        found = []
        for block in blocks:
            lo, hi = block * BLOCK, (block + 1) * BLOCK
            lists = []  # [next item, its place, list, impacts, block maximum]
            for t in terms:
                k = bisect_left(self.blocks[t], block)
                if k < len(self.blocks[t]) and self.blocks[t][k] == block:
                    at = bisect_left(self.items[t], lo)
                    lists.append([self.items[t][at], at, self.items[t], self.impact[t], self.block_top[t][k]])
            while lists:
                lists.sort(key=itemgetter(0))
                bound, pivot = 0.0, hi
                for x in lists:
                    bound += x[4]
                    if bound >= 1 - 1e-6:
                        pivot = x[0]
                        break
                if pivot >= hi:
                    break
                if lists[0][0] == pivot:
                    score = 0.0
                    for x in lists:
                        if x[0] != pivot:
                            break
                        score += x[3][x[1]]
                    if score >= 1 - 1e-9:
                        found.append((pivot, score))
                    pivot += 1
                for x in lists:
                    if x[0] < pivot:
                        x[1] = bisect_left(x[2], pivot, x[1])
                        x[0] = x[2][x[1]] if x[1] < len(x[2]) else hi
                lists = [x for x in lists if x[0] < hi]
        return found

    def passages(self, texts: list[str | None]) -> tuple[list[list[str]], dict]:
        """The words of each text, and (text, passage) -> (terms, live blocks) of
        the passages that can reach a threshold."""
        get, size, step = self.vocabulary.__getitem__, max(1, len(self.vocabulary)), self.stride
        all_words, keys, base, owner = [], [], 0, []
        for n, t in enumerate(texts):
            ws = words(t)
            all_words.append(ws)
            ids = np.fromiter(map(get, ws), np.int64, len(ws))
            at = np.flatnonzero(ids >= 0)
            last = max(0, -(-len(ws) // step) - 2)  # the last passage: [last * step, (last + 2) * step)
            here, term = at // step, ids[at]
            early, late = here >= 1, here <= last
            keys.append(((here[late] + base) * size + term[late]))
            keys.append(((here[early] - 1 + base) * size + term[early]))
            owner += [(n, p) for p in range(last + 1)]
            base += last + 1
        key = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        win, term = key // size, key % size
        bound = np.bincount(win, self.top[term], base)
        live = bound[win] >= 1 - 1e-9
        win, term = win[live], term[live]
        out: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        if len(win):
            starts = np.flatnonzero(np.r_[True, win[1:] != win[:-1]])
            ends = np.r_[starts[1:], len(win)]
            at_once = max(1, BOUNDS // self.n_blocks)
            for lo in range(0, len(starts), at_once):  # block bounds, a slice of passages at a time
                s, e = starts[lo:lo + at_once], ends[lo:lo + at_once]
                t, row = term[s[0]:e[-1]], np.repeat(np.arange(len(s)), e - s)
                for cut in np.array_split(np.arange(len(t)), max(1, int((self.list_at[t + 1] - self.list_at[t]).sum()) // BOUNDS + 1)):
                    size = self.list_at[t[cut] + 1] - self.list_at[t[cut]]
                    upto = np.cumsum(size)
                    place = np.repeat(self.list_at[t[cut]] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
                    key = np.repeat(row[cut], size) * self.n_blocks + self.all_blocks[place]
                    part = np.bincount(key, self.all_tops[place], len(s) * self.n_blocks)
                    sums = part if cut[0] == 0 else sums + part
                sums = sums.reshape(len(s), self.n_blocks)
                for k in np.flatnonzero(sums.max(axis=1) >= 1 - 1e-6):
                    out[owner[win[s[k]]]] = term[s[k]:e[k]].tolist(), np.flatnonzero(sums[k] >= 1 - 1e-6).tolist()
        return all_words, out

    def matches(self, texts: list[str | None]) -> list[dict[int, tuple]]:
        """Per text: item -> (best score, overlap of the whole, the question and the answer), verified."""
        scores: list[dict[int, float]] = [{} for _ in texts]
        all_words, live = self.passages(texts)
        for (n, _), (terms, blocks) in live.items():
            for item, score in self.search(terms, blocks):
                scores[n][item] = max(score, scores[n].get(item, 0.0))
        out: list[dict[int, tuple]] = [{} for _ in texts]
        for n, found in enumerate(scores):
            held: dict[int, set[str]] = {}  # the document's shingles by size

            def share(part: set[str]) -> float:
                size = min((s.count(" ") + 1 for s in part), default=1)
                if size not in held:
                    held[size] = shingles(all_words[n], size)
                return len(part & held[size]) / max(1, len(part))

            for item, score in found.items():
                whole, q, a = self.parts[item]
                shares = share(whole), share(q), share(a)
                if shares[0] >= SHARE - 1e-12 or (len(q) >= LEAST_QUESTION and shares[1] >= SHARE - 1e-12):
                    out[n][item] = (score, *shares)
        return out


def _terms(batches):
    for b in batches:
        rows = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ws = words(t)
            tf: dict[str, int] = {}
            for w in ws:
                tf[w] = tf.get(w, 0) + 1
            rows += [(i, t, len(ws), w, c) for w, c in tf.items()]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                                          pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()),
                                          pa.array(cols[4], pa.int64())], names=["n", "text", "length", "term", "tf"])


def build_index(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[IndexShard]:
    """The index shards of a benchmark, one at a time: statistics over all items by Spark."""
    numbered = items.select(quoted(item_id).alias("item_id"), quoted(text).alias("text"),
                            F.xxhash64(quoted(item_id), quoted(text)).alias("n"))
    rows = numbered.select("n", "text").distinct().mapInArrow(_terms, "n long, text string, length long, term string, tf long")
    n, total = rows.groupBy("n").agg(F.first("length").alias("length")).agg(F.count("*"), F.sum("length")).first()
    if not n:
        return
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (total / n)))
    made = (rows.join(df, "term").groupBy("n").agg(F.array_sort(F.collect_list(F.struct(
        "term", impact.alias("w")))).alias("t")).join(numbered, "n"))
    size = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    if shards > 1:
        made = cut_lineage(made)
    for k in range(shards):  # the driver holds one, of bounded size
        got = made.filter(F.pmod("n", F.lit(shards)) == k).orderBy("item_id", "text").collect()
        if got:
            yield IndexShard([(r.item_id, r.text, [x.term for x in r.t], [x.w for x in r.t]) for r in got])


def contaminated_pairs(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id",
                       text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, bm25 (over the threshold), overlap, question_overlap,
    answer_overlap of every document and item found in it."""
    body = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", body.schema["doc_id"].dataType),
                           T.StructField("item_id", items.schema[item_id].dataType), *[
        T.StructField(c, T.DoubleType()) for c in ("bm25", "overlap", "question_overlap", "answer_overlap")]])
    out = spark.createDataFrame([], schema)
    for shard in build_index(items, item_id, text="text"):
        sent = spark.sparkContext.broadcast(shard)

        def scan(batches, sent=sent):
            index = sent.value
            for b in batches:
                ids, texts, rows = b.column(0).to_pylist(), b.column(1), []
                for lo in range(0, len(ids), 512):
                    for n, hits in enumerate(index.matches(texts.slice(lo, 512).to_pylist())):
                        rows += [(ids[lo + n], index.ids[i], *map(float, h)) for i, h in sorted(hits.items())]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        out = out.unionByName(body.mapInArrow(scan, schema))
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no item is found."""
    clean = docs
    for shard in build_index(items):
        sent = spark.sparkContext.broadcast(shard)

        clean = clean.filter(~_finder(sent)(quoted(text)))
    return clean


def _finder(sent):
    @F.pandas_udf(T.BooleanType())
    def found(batch):
        import pandas as pd
        got = []
        for lo in range(0, len(batch), 512):
            got += [bool(h) for h in sent.value.matches(batch.iloc[lo:lo + 512].tolist())]
        return pd.Series(got, dtype=bool)
    return found
