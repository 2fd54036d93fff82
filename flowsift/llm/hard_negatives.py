"""Hard negatives by windowed inner-product search in cover trees.

Vectors become integers floor(scale * x), so scores are exact. Every candidate x
is augmented by a coordinate sqrt(M^2 - |x|^2), M the largest norm, and a query
q by 0: all candidates then have norm M, and d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so
distances bound scores from both sides.

Equal vectors of one label are one entry with its smallest ids (as many as a
result can need). Entries are dealt to the nearest of a few routers, large
groups are split, and one task builds a cover tree of each group: a node of
level l covers its entries within BASE^l of its centre, itself an entry;
children are centres more than BASE^(l-1) apart, each covering what lies
within BASE^(l-1) of it; entries beyond FAN centres go to pages of that level.
Nodes keep their actual covering radius and their label, if they have but one.

A request asks for the k best scores in a window [lo, hi] of the same or of
other labels. The requests that meet a tree descend it together: a node's bounds
are one matrix product for all that it is open to, and nodes wholly outside a
window or of the wrong label only are skipped. Each request looks into its most
promising leaf first; the k-th best so far then rules out others. A leaf's scores
are exact and made once for all requests of one anchor. First each request
searches the tree where it can score best; the k-th best found there rules out
other trees by their roots and is the least score in the rest. A request and
a tree meet in a group (tree, chunk of anchors), so the work of a tree is split
as well; requests stay in Spark.

``mine`` asks twice: for each anchor's best rows of its label, the positives,
then for each of them for rows of other labels that score between ``low`` and
``high`` times the positive.

Nulls and ties: rows with null vec_id, null label, null vector, or a null or
non-finite component take no part; shorter vectors count as padded with zeros;
rows equal in all three columns count once; rows of one vec_id with different
vectors or labels are different anchors, and an anchor is never its own result;
ties go to the smaller vec_id; positive scores below 0 have empty windows.
Squared norms of 2^61 or more raise an error (sums of 64 bits hold all others).
Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.llm.base import quoted
from flowsift.session import cut_lineage

BASE = 1.5
FAN = 64              # children of a node, at most
PAGE = 256            # entries of a leaf, at most
TREE_ROWS = 16_000    # entries of a tree, about
ROUTERS = 64
CHUNK = 4_096         # requests that meet a tree in one task, about
SUMMARY_BYTES = 16 << 20  # of tree roots that are broadcast at once
ALL = 1 << 62         # beyond any score

KEY = ("anchor_id", "akey", "positive_id")
FOUND = "anchor_id long, akey long, positive_id long, vec_id long, score long"


def integer_rows(df: DataFrame, scale: int, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, v): the rows that take part, labels as numbers."""
    x, y = quoted(embedding), quoted(label)
    whole = isinstance(df.schema[label].dataType, (T.IntegralType,))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (df.filter(quoted(vec_id).isNotNull() & y.isNotNull() & x.isNotNull()).filter(fine)
            .select(quoted(vec_id).cast("long").alias("vec_id"), (y.cast("long") if whole else F.xxhash64(y)).alias("label"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")).distinct())


class CoverTree:
    """Entries in the order of the leaves; nodes as columns."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: list[list[int]], norm2: float):
        self.norm2 = norm2
        order, self.nodes = self._build(lift(vectors, norm2))
        self.vectors, self.labels, self.ids = vectors[order], labels[order], [ids[i] for i in order]
        at = {old: new for new, old in enumerate(order.tolist())}
        n = self.nodes
        self.centre = np.array([at[x[0]] for x in n])
        self.radius = np.array([x[1] for x in n])
        self.first, self.end = np.array([x[2] for x in n]), np.array([x[3] for x in n])
        self.kids = [np.array(x[4], np.int64) for x in n]
        low, high = (np.array([f(self.labels[a:b]) for a, b in zip(self.first, self.end)]) for f in (np.min, np.max))
        self.mixed, self.label = low != high, low
        del self.nodes

    @staticmethod
    def _build(x: np.ndarray) -> tuple[np.ndarray, list]:
        """(entries by leaf, nodes): a node is (centre, radius, first, end, children)."""
        nodes: list = []
        order: list[int] = []

        def away(rows: np.ndarray, centre: int) -> np.ndarray:
            return np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1))

        def node(rows: np.ndarray, centre: int, split: bool = True) -> int:
            at, first = len(nodes), len(order)
            nodes.append(None)
            d = away(rows, centre)
            radius, kids = float(d.max()), []
            if len(rows) <= PAGE or not split or radius == 0:
                order.extend(rows[np.argsort(d, kind="stable")].tolist())
            else:
                level = math.ceil(math.log(radius) / math.log(BASE) - 1e-9)  # the least that covers the node
                cover, rest, c = BASE ** (level - 1), rows, centre
                while len(rest) and len(kids) < FAN:
                    near = away(rest, c) <= cover
                    if near.all() and not kids:  # rounding: the level below covers it as well
                        near = d < radius
                    kids.append(node(rest[near], c))
                    rest = rest[~near]
                    c = rest[0] if len(rest) else c
                if len(rest):  # more centres than FAN: pages of this level, near ones together
                    rest = rest[np.argsort(away(rest, centre), kind="stable")]
                    kids += [node(p, p[len(p) // 2], False) for p in np.array_split(rest, -(-len(rest) // PAGE))]
            nodes[at] = centre, radius, first, len(order), kids
            return at

        middle = ((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()
        node(np.arange(len(x)), int(middle))
        return np.array(order), nodes

    def bounds(self, nodes: np.ndarray, q: np.ndarray, total, slack) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) possible scores of entries of some nodes, with one query or (as rows) several."""
        scores = (q @ self.vectors[self.centre[nodes]].T).astype(np.float64)
        return score_bounds(scores, self.radius[nodes], total, slack)

    def search(self, q: np.ndarray, own: int, label: int, same: bool, lo: int, hi: int, k: int) -> list[tuple[int, int]]:
        """The k best (vec_id, score) in the window, of the same or of other labels."""
        one = [np.array([x]) for x in (0, own, label, same, lo, hi)]
        return self.search_all(q[None], *one, k)[0]

    def search_all(self, q: np.ndarray, of: np.ndarray, own: np.ndarray, label: np.ndarray, same: np.ndarray,
                   lo: np.ndarray, hi: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """What ``search`` gives for each of several requests; request r asks with the vector q[of[r]].

        All descend together: a node is met once, by the requests that it is open
        to. Each looks into its most promising leaf first."""
        total = ((q.astype(np.float64) ** 2).sum(axis=1) + self.norm2)[:, None]
        best: list[list[tuple[int, int]]] = [[] for _ in of]  # heaps of (score, -vec_id), the worst on top
        least = lo.copy()  # what a result must score at least
        leaves, most = self._open_leaves(q, of, total, label, same, lo, hi)
        first = np.full(len(of), -1)
        top = np.full(len(of), -np.inf)
        for at, (_, who) in enumerate(leaves):
            better = most[at] > top[who]
            first[who[better]], top[who[better]] = at, most[at][better]
        for at, (n, who) in enumerate(leaves):
            self._look_into(n, who[first[who] == at], q, of, own, label, same, least, hi, k, best)
        # the leaves that promise most to any request come first
        for at in sorted(range(len(leaves)), key=lambda i: -most[i].max()):
            n, who = leaves[at]
            self._look_into(n, who[(first[who] != at) & (most[at] >= least[who])], q, of, own, label, same, least, hi, k, best)
        return [[(-v, s) for s, v in sorted(x, reverse=True)] for x in best]

    def _open_leaves(self, q, of, total, label, same, lo, hi) -> tuple[list, list]:
        """(leaf, requests it is open to) of every such leaf, and the greatest scores they can have there."""
        out, most = [], []
        slack = 1e-9 * (total + 1)
        low, high = self.bounds(np.zeros(1, np.int64), q, total, slack)
        inside = np.flatnonzero((low[of, 0] <= hi) & (high[of, 0] >= lo))
        stack = [(0, inside, high[of[inside], 0])]
        while stack:
            n, who, upper = stack.pop()
            if not len(who):
                continue
            if not len(self.kids[n]):
                out.append((n, who))
                most.append(np.minimum(upper, hi[who]))
                continue
            kids = self.kids[n]
            mine, row = np.unique(of[who], return_inverse=True)
            low, high = self.bounds(kids, q[mine], total[mine], slack[mine])
            for i, kid in enumerate(kids.tolist()):
                inside = (low[row, i] <= hi[who]) & (high[row, i] >= lo[who])
                if not self.mixed[kid]:
                    inside &= (self.label[kid] == label[who]) == same[who]
                stack.append((kid, who[inside], high[row[inside], i]))
        return out, most

    def _look_into(self, n, who, q, of, own, label, same, least, hi, k, best) -> None:
        """Take a leaf's entries into the best of some requests."""
        if not len(who):
            return
        mine, row = np.unique(of[who], return_inverse=True)
        for a in range(self.first[n], self.end[n], PAGE):
            b = min(a + PAGE, self.end[n])
            scores = (q[mine] @ self.vectors[a:b].T)[row]
            good = (scores >= least[who][:, None]) & (scores <= hi[who][:, None])
            good &= (self.labels[a:b] == label[who][:, None]) == same[who][:, None]
            for j in np.flatnonzero(good.any(axis=1)).tolist():
                r = int(who[j])
                heap, at = best[r], np.flatnonzero(good[j])
                for i in at[np.argsort(-scores[j, at], kind="stable")]:
                    s = int(scores[j, i])
                    if len(heap) == k and s < heap[0][0]:
                        break
                    for v in self.ids[a + i]:
                        if v == own[r]:
                            continue
                        if len(heap) < k:
                            heapq.heappush(heap, (s, -v))
                        elif (s, -v) > heap[0]:
                            heapq.heapreplace(heap, (s, -v))
                        else:
                            break  # ids ascend: the rest is no better
                if len(heap) == k:
                    least[r] = max(least[r], heap[0][0])


def lift(x: np.ndarray, norm2: float) -> np.ndarray:
    """The vectors with their further coordinate."""
    rest = norm2 - (x.astype(np.float64) ** 2).sum(axis=1)
    return np.c_[x, np.sqrt(np.maximum(rest, 0.0))]


def score_bounds(scores, radius, total, slack):
    """(least, greatest) scores within ``radius`` of augmented points with these scores."""
    d = np.sqrt(np.maximum(total - 2 * scores, 0.0))
    return (total - (d + radius) ** 2) / 2 - slack, (total - np.maximum(0.0, d - radius) ** 2) / 2 + slack


class Forest:
    """Trees over all rows: table (tree, body), and their roots."""

    def __init__(self, rows: DataFrame, keep: int):
        """rows: (vec_id, label, v), distinct; keep: ids that an entry needs at most."""
        spark = rows.sparkSession
        norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
        self.count, self.dim, norm2 = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
        self.norm2 = float(norm2 or 0)
        if self.norm2 >= 2.0 ** 61:
            raise ValueError("vectors are too long for exact 64-bit scores: use a smaller scale")
        if not self.count:
            return
        self.dim = max(1, self.dim)
        self.dtype = np.float64 if self.norm2 * 4 < 2 ** 52 else np.int64  # exact either way
        self.pad = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(self.dim) - F.size("v")))
        rows = rows.withColumn("v", self.pad)
        rank = F.row_number().over(W.partitionBy("v", "label").orderBy("vec_id"))
        entries = cut_lineage(rows.withColumn("r", rank).filter(F.col("r") <= keep).groupBy("v", "label")
                              .agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
        n = entries.count()
        groups = min(ROUTERS, max(1, math.ceil(n / TREE_ROWS)))
        routers = np.array([r.v for r in entries.orderBy(F.xxhash64("v", "label")).limit(groups).collect()], np.float64)
        half, dim, total, dtype = (routers ** 2).sum(axis=1) / 2, self.dim, self.norm2, self.dtype

        @F.pandas_udf("int")
        def nearest(v):
            x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.empty((0, dim))
            return pd.Series((x @ routers.T - half).argmax(axis=1).astype(np.int32))

        dealt = entries.withColumn("g", nearest("v")) if groups > 1 else entries.withColumn("g", F.lit(0))
        dealt = cut_lineage(dealt)
        sizes = dealt.groupBy("g").agg(F.count("*").alias("n")).collect()  # ROUTERS rows at most
        parts = F.create_map(*[x for r in sizes for x in (F.lit(r.g), F.lit(math.ceil(r.n / TREE_ROWS)))])
        split = F.pmod(F.xxhash64("v", "label"), F.element_at(parts, F.col("g")).cast("long"))

        def load(key, rows):
            rows = rows.assign(first=[i[0] for i in rows["ids"]]).sort_values(["first", "label"])
            tree = CoverTree(np.stack(rows["v"].to_numpy()).astype(np.int64), rows["label"].to_numpy(),
                             [list(map(int, i)) for i in rows["ids"]], total)
            root = tree.vectors[tree.centre[0]].astype("<i8").tobytes()
            radius = float(tree.radius[0])
            tree.vectors = tree.vectors.astype(np.min_scalar_type(-int(np.abs(tree.vectors).max()) - 1))
            return pd.DataFrame([(int(key[0]), int(key[1]), root, radius, pickle.dumps(tree, 5))],
                                columns=["g", "s", "root", "radius", "body"])

        made = dealt.withColumn("s", split).groupBy("g", "s").applyInPandas(
            load, "g int, s long, root binary, radius double, body binary")
        self.trees = cut_lineage(made.withColumn("tree", F.xxhash64("g", "s")))
        self.n_trees, self.spark = self.trees.count(), spark

    def pairs(self, requests: DataFrame) -> DataFrame:
        """(key, tree, upper, far): the trees whose scores can be in a request's window."""
        at_once = max(1, SUMMARY_BYTES // (8 * self.dim + 64))
        turns, out, total, dtype = math.ceil(self.n_trees / at_once), None, self.norm2, self.dtype
        for turn in range(turns):
            mine = self.trees.filter(F.pmod(F.xxhash64("tree"), F.lit(turns)) == turn)
            got = mine.select("tree", "root", "radius").collect()
            if not got:
                continue
            sent = self.spark.sparkContext.broadcast((np.array([r.tree for r in got], np.int64), np.array(
                [np.frombuffer(r.root, "<i8") for r in got], np.int64), np.array([r.radius for r in got])))

            @F.pandas_udf("array<struct<tree:long,upper:double,far:double>>")
            def open_to(v, lo, hi, sent=sent):
                trees, roots, radius = sent.value
                out = []
                for q, a, b in zip(v, lo, hi):
                    q = np.asarray(q, np.int64).astype(dtype)
                    of = float((q.astype(np.float64) ** 2).sum()) + total
                    scores = (roots.astype(dtype) @ q).astype(np.float64)
                    least, most = score_bounds(scores, radius, of, 1e-9 * (of + 1))
                    out.append([{"tree": int(trees[i]), "upper": float(most[i]), "far": -float(scores[i])}
                                for i in np.flatnonzero((least <= b) & (most >= a))])
                return pd.Series(out)

            part = requests.select(*KEY, "hi", F.explode(open_to("v", "lo", "hi")).alias("t")).select(
                *KEY, "t.tree", F.least("t.upper", "hi").alias("upper"), "t.far")
            out = part if out is None else out.unionByName(part)
        return cut_lineage(out)

    def look(self, requests: DataFrame, pairs: DataFrame, k: int, n_requests: int) -> DataFrame:
        """The k best rows that each request finds in each of its trees."""
        busy = 3 * self.spark.sparkContext.defaultParallelism
        chunks = max(math.ceil(n_requests / CHUNK), min(math.ceil(n_requests / 64), math.ceil(busy / self.n_trees)), 1)
        chunk = F.pmod(F.xxhash64(*KEY[:2]), F.lit(chunks)).alias("chunk")  # an anchor's requests stay together
        asked = requests.join(pairs.select(*KEY, "tree"), list(KEY)).select("tree", chunk, *requests.columns)
        bodies = pairs.select("tree", chunk).distinct().join(self.trees.select("tree", "body"), "tree")
        bodies = bodies.select(F.col("tree").alias("of_tree"), F.col("chunk").alias("of_chunk"), "body")
        dtype = self.dtype

        def found(asked, bodies):
            out = []
            if len(asked) and len(bodies):
                tree = pickle.loads(bodies["body"].iloc[0])
                tree.vectors = tree.vectors.astype(dtype)
                # requests of one anchor ask with one vector
                asked = asked.sort_values(["anchor_id", "akey", "positive_id"], ignore_index=True)
                new = ~asked.duplicated(["anchor_id", "akey"]).to_numpy()
                q = np.stack(asked["v"][new].to_numpy()).astype(np.int64).astype(dtype)
                column = {c: asked[c].to_numpy() for c in ("anchor_id", "label", "same", "lo", "hi")}
                results = tree.search_all(q, np.cumsum(new) - 1, *column.values(), k)
                for key, got in zip(asked[list(KEY)].itertuples(index=False, name=None), results):
                    out += [(*key, v, s) for v, s in got]
            return pd.DataFrame(out, columns=["anchor_id", "akey", "positive_id", "vec_id", "score"]).astype("int64")

        return asked.groupBy("tree", "chunk").cogroup(bodies.groupBy("of_tree", "of_chunk")).applyInPandas(found, FOUND)

    def best(self, requests: DataFrame, k: int) -> DataFrame:
        """anchor_id, akey, positive_id, vec_id, score, rank of each request's k best."""
        requests = cut_lineage(requests)
        n = requests.count()
        pairs = self.pairs(requests)
        first = pairs.groupBy(*KEY).agg(F.max_by("tree", F.struct("upper", -F.col("far"), "tree")).alias("tree"))
        found = cut_lineage(self.look(requests, first, k, n))
        if self.n_trees > 1:  # the k-th best so far rules out trees
            floor = found.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
            rest = pairs.join(first.withColumnRenamed("tree", "done"), list(KEY)).filter("tree != done")
            rest = rest.join(floor, list(KEY), "left").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
            raised = requests.join(floor.select(*KEY, "kth"), list(KEY), "left").withColumn(
                "lo", F.greatest("lo", "kth")).select(*requests.columns)
            found = found.unionByName(self.look(raised, cut_lineage(rest.select(*KEY, "tree")), k, n))
        rank = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` makes a condition of the vec_id column; a negative scores
    ``low`` to ``high`` percent of the positive."""
    empty = df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                            "positive_score long, negative_score long")
    rows = cut_lineage(integer_rows(df, scale, vec_id, embedding, label))
    forest = Forest(rows, max(n_positives, n_negatives) + 1)
    if not forest.count:
        return empty
    anchors = cut_lineage(rows.filter(is_anchor(F.col("vec_id"))).select(
        F.col("vec_id").alias("anchor_id"), F.xxhash64("v", "label").alias("akey"), "label", forest.pad.alias("v")))
    whole = anchors.withColumns({"positive_id": F.lit(0).cast("long"), "same": F.lit(True),
                                 "lo": F.lit(-ALL).cast("long"), "hi": F.lit(ALL).cast("long")})
    positives = forest.best(whole, n_positives).select(
        "anchor_id", "akey", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    positives = cut_lineage(positives)
    # least and greatest whole score in the window
    s = F.col("positive_score")
    asked = positives.filter(s >= 0).join(anchors, ["anchor_id", "akey"]).withColumns({
        "same": F.lit(False), "lo": F.expr(f"({low} * positive_score + 99) div 100"),
        "hi": F.expr(f"({high} * positive_score) div 100")})
    found = forest.best(asked.select(*anchors.columns, "positive_id", "same", "lo", "hi"), n_negatives)
    return found.join(positives, list(KEY)).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
