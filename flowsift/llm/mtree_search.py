"""Exact top-k search by inner product in M-trees.

Vectors become integers floor(64 * x). The greatest inner product is the least
Euclidean distance once every candidate x has a further coordinate sqrt(M^2 -
|x|^2), M the largest norm, and the query a 0 there: d(q, x)^2 = |q|^2 + M^2 -
2 q.x. So metric bounds hold for scores.

Equal vectors are one entry with its smallest ids (no result needs more than k +
1 of them). Entries are dealt to their nearest of a few routers, large groups
are split, and each group is loaded into an M-tree by one task: pages of at
most PAGE entries with a router, a covering radius and every entry's distance
to it. The pages are rows of a table that is written once.

A tree and a block of queries (QUERY_BLOCK at most, about; fewer where tasks would
be idle) meet in a group of their own; queries stay in Spark. Each query searches
best-first: the page with the highest possible score next, until it can't reach
the k-th best. A page's stored distances give each
entry's bound |d(q, router) - d(router, entry)| before any distance is computed;
only entries that can still reach the k-th best are computed. All trees' lists
of a query are merged by score. No pair table exists, results are exact: squared
norms of 2^61 or more, whose sums 64 bits might not hold, raise an error.

Nulls and ties: null vectors, vectors with null or non-finite components, and
rows of null vec_id take no part; shorter vectors count as padded with zeros;
rows equal in vec_id and vector count once; a query leaves out all rows of its
own vec_id; ties go to the smaller vec_id; a query with fewer candidates than k
gets them all. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsift.llm.base import quoted
from flowsift.session import cut_lineage

SCALE = 64
PAGE = 512            # entries of a page
FAN_OUT = 16          # children of an inner node
TREE_ROWS = 16_000    # entries of a tree, about
QUERY_BLOCK = 4_096   # queries that meet a tree in one task, about
ROUTERS = 64          # groups that entries are dealt to, at most

PAGES = ("tree int, page int, leaf boolean, router binary, radius double, parent_distance double, "
         "children array<int>, vectors binary, distances binary, ids array<array<bigint>>")


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the integer vectors that take part."""
    x = quoted(embedding)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (df.filter(quoted(vec_id).isNotNull() & x.isNotNull()).filter(fine)
            .select(quoted(vec_id).cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v")))


class Page:
    """A node: router and radius in the lifted space; a leaf's vectors with their
    distances to the router and ids, or child pages."""

    __slots__ = ("leaf", "router", "radius", "parent_distance", "children", "vectors", "distances", "ids")

    def __init__(self, leaf, router, radius, parent_distance, children=(), vectors=None, distances=None, ids=()):
        self.leaf, self.router, self.radius, self.parent_distance = leaf, router, radius, parent_distance
        self.children, self.vectors, self.distances, self.ids = children, vectors, distances, ids


def lift(x: np.ndarray, norm2: float) -> np.ndarray:
    """The vectors with their further coordinate."""
    rest = norm2 - (x.astype(np.float64) ** 2).sum(axis=1)
    return np.c_[x, np.sqrt(np.maximum(rest, 0.0))]


def build(vectors: np.ndarray, ids: list, norm2: float, seed: int = 8) -> list[Page]:
    """The pages of a tree over integer vectors; page 0 is the root."""
    lifted, rng, pages = lift(vectors, norm2), np.random.default_rng(seed), []

    def node(rows: np.ndarray, parent: np.ndarray | None) -> int:
        at = len(pages)
        pages.append(None)
        x = lifted[rows]
        centre = x.mean(axis=0)
        router = x[((x - centre) ** 2).sum(axis=1).argmin()]
        away = np.sqrt(((x - router) ** 2).sum(axis=1))
        up = 0.0 if parent is None else float(np.sqrt(((parent - router) ** 2).sum()))
        radius = float(away.max())
        if len(rows) <= PAGE:
            order = np.argsort(away, kind="stable")
            pages[at] = Page(True, router, radius, up, vectors=vectors[rows[order]], distances=away[order],
                             ids=[ids[i] for i in rows[order]])
            return at
        # children: nearest of some seeds, no child larger than its share by far
        n = min(FAN_OUT, -(-len(rows) // PAGE))
        seeds = x[rng.choice(len(rows), n, replace=False)]
        d = (x ** 2).sum(axis=1)[:, None] - 2 * x @ seeds.T + (seeds ** 2).sum(axis=1)[None, :]
        nearest = d.argmin(axis=1)
        groups = [np.flatnonzero(nearest == g) for g in range(n)]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:  # the seeds coincide in effect: cut by distance
            groups = np.array_split(np.argsort(away, kind="stable"), n)
        pages[at] = Page(False, router, radius, up)
        pages[at].children = [node(rows[g], router) for g in groups]
        return at

    if len(vectors):
        node(np.arange(len(vectors)), None)
    return pages


def search(pages: list[Page], q: np.ndarray, own: int, norm2: float, k: int) -> list[tuple[int, int]]:
    """The k best (score, vec_id) in one tree for the integer query ``q``."""
    best: list[tuple[int, int]] = []  # heap of (score, -vec_id), the worst on top
    if not pages:
        return []
    lifted = np.append(q.astype(np.float64), 0.0)
    total = float((lifted ** 2).sum()) + norm2
    slack = 1e-9 * (total + 1)

    def limit(distance: float) -> float:
        """The highest score of anything at ``distance`` or more."""
        return (total - max(0.0, distance) ** 2) / 2 + slack

    def floor() -> float:
        return best[0][0] if len(best) == k else -math.inf

    def away(p: Page) -> float:
        return math.sqrt(max(0.0, float(((lifted - p.router) ** 2).sum())))

    d = away(pages[0])
    queue = [(-limit(d - pages[0].radius), 0, d)]
    while queue:
        top, at, d = heapq.heappop(queue)
        if -top < floor():
            break
        p = pages[at]
        if p.leaf:
            # the stored distances bound every entry before any is computed
            bounds = (total - np.abs(d - p.distances) ** 2) / 2 + slack
            live = np.flatnonzero(bounds >= floor())
            if not len(live):
                continue
            # entries stand by distance, so the live ones are close together: no copy of the page
            lo, hi = live[0], live[-1] + 1
            scores = p.vectors[lo:hi] @ q
            good = np.flatnonzero(scores >= floor())
            for i in good[np.argsort(-scores[good], kind="stable")]:
                s = int(scores[i])
                if s < floor():
                    break
                for v in p.ids[lo + i]:
                    if v == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -v))
                    elif (s, -v) > best[0]:
                        heapq.heapreplace(best, (s, -v))
                    else:
                        break  # ids ascend: the rest is no better
            continue
        for c in p.children:
            child = pages[c]
            if limit(abs(d - child.parent_distance) - child.radius) < floor():
                continue  # the parent's distance rules it out, uncomputed
            dc = away(child)
            bound = limit(dc - child.radius)
            if bound >= floor():
                heapq.heappush(queue, (-bound, c, dc))
    return [(s, -v) for s, v in sorted(best, reverse=True)]


def _pack_pages(tree: int, pages: list[Page]) -> pd.DataFrame:
    rows = [(tree, n, p.leaf, p.router.astype("<f8").tobytes(), p.radius, p.parent_distance, list(p.children),
             p.vectors.astype("<i8").tobytes() if p.leaf else None,
             p.distances.astype("<f8").tobytes() if p.leaf else None, [list(i) for i in p.ids])
            for n, p in enumerate(pages)]
    return pd.DataFrame(rows, columns=["tree", "page", "leaf", "router", "radius", "parent_distance", "children",
                                       "vectors", "distances", "ids"])


def _unpack_pages(rows: pd.DataFrame, dim: int, dtype) -> list[Page]:
    out = []
    for r in rows.sort_values("page").itertuples():
        out.append(Page(r.leaf, np.frombuffer(r.router, "<f8"), r.radius, r.parent_distance, list(r.children),
                        np.frombuffer(r.vectors, "<i8").reshape(-1, dim).astype(dtype) if r.leaf else None,
                        np.frombuffer(r.distances, "<f8") if r.leaf else None, [list(i) for i in r.ids]))
    return out


def top_k(df: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best candidates.

    ``is_query`` makes a condition of the vec_id column."""
    spark = df.sparkSession
    rows = cut_lineage(integer_vectors(df, vec_id, embedding).distinct())
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    n, dim, norm2 = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n or not dim:
        return empty if not n else _without_components(rows, is_query, k)
    if norm2 >= 2.0 ** 61:
        raise ValueError("vectors are too long for exact 64-bit scores")
    dtype = np.float64 if norm2 * 4 < 2 ** 52 else np.int64  # exact either way
    pad = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v")))
    rows = rows.select("vec_id", pad.alias("v"))
    # equal vectors: one entry with its k + 1 smallest ids (ranked before the shuffle as well)
    rank = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    entries = (rows.withColumn("r", rank).filter(F.col("r") <= k + 1)
               .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    entries = cut_lineage(entries)
    # routers: a few entries by hash; each entry goes to the nearest, large groups are split
    count = entries.count()
    groups = min(ROUTERS, max(1, math.ceil(count / TREE_ROWS)))
    routers = np.array([r.v for r in entries.orderBy(F.xxhash64("v")).limit(groups).collect()], np.float64)
    half = (routers ** 2).sum(axis=1) / 2

    @F.pandas_udf("int")
    def nearest(v):
        x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.empty((0, dim))
        return pd.Series((x @ routers.T - half).argmax(axis=1).astype(np.int32))

    dealt = cut_lineage(entries.withColumn("g", nearest("v")))
    sizes = {r.g: r.n for r in dealt.groupBy("g").agg(F.count("*").alias("n")).collect()}
    first, parts = 0, []
    for g, size in sorted(sizes.items()):  # at most ROUTERS numbers
        split = math.ceil(size / TREE_ROWS)
        parts.append((g, first, split))
        first += split
    parts = F.create_map(*[x for g, a, s in parts for x in (F.lit(g), F.struct(F.lit(a).alias("a"), F.lit(s).alias("s")))])
    place = F.element_at(parts, F.col("g"))
    trees = dealt.withColumn("tree", (place["a"] + F.pmod(F.xxhash64("v"), place["s"])).cast("int"))

    def load(key, rows):
        rows = rows.sort_values("first")
        return _pack_pages(int(key[0]), build(np.stack(rows["v"].to_numpy()).astype(np.int64),
                                              [list(map(int, i)) for i in rows["ids"]], norm2))

    pages = cut_lineage(trees.select("tree", "v", "ids", F.element_at("ids", 1).alias("first"))
                        .groupBy("tree").applyInPandas(load, PAGES))

    queries = rows.filter(is_query(F.col("vec_id")))
    asked, busy = queries.count(), 3 * spark.sparkContext.defaultParallelism
    if not asked:
        return empty
    blocks = max(math.ceil(asked / QUERY_BLOCK), min(math.ceil(asked / 64), math.ceil(busy / first)))
    every_tree = F.explode(F.sequence(F.lit(0), F.lit(first - 1))).alias("tree")
    queries = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), every_tree)
    copies = pages.withColumnRenamed("tree", "of_tree").withColumn(
        "of_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = queries.groupBy("tree", "block").cogroup(copies.groupBy("of_tree", "of_block")).applyInPandas(
        _searcher(dim, dtype, norm2, k), "query_id long, vec_id long, score long")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", best).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _searcher(dim: int, dtype, norm2: float, k: int):
    def look(queries, rows):
        out = []
        if len(queries) and len(rows):
            tree = _unpack_pages(rows, dim, dtype)
            for own, q in zip(queries["vec_id"].tolist(), queries["v"]):
                out += [(own, v, s) for s, v in search(tree, np.asarray(q, np.int64).astype(dtype), own, norm2, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
    return look


def _without_components(rows: DataFrame, is_query, k: int) -> DataFrame:
    """All vectors are empty: every score is 0, the smallest ids win."""
    first = [r.vec_id for r in rows.select("vec_id").distinct().orderBy("vec_id").limit(k + 1).collect()]
    ids = rows.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id")).distinct()
    near = ids.withColumn("near", F.slice(F.array_remove(F.array(*map(F.lit, first)), F.col("query_id")), 1, k))
    return near.select("query_id", F.posexplode("near").alias("rank", "vec_id")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
