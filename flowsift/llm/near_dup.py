"""MinHash near-duplicates with sequential Bayesian verification.

A document is the set of its distinct word shingles (words: runs without
ASCII white space, A-Z lower-cased; fewer words than a shingle: the whole
sequence as one). Two documents are linked if 100 * |A & B| >= percent *
|A | B|; a component is what links reach.

1. One pass over the texts hashes the shingles to 64 bits and makes a digest
   of the whole set and a signature of BANDS * ROWS minimum hashes. Documents
   with equal digests are one class (similarity 1), known by its smallest id.
2. Classes that agree in all ROWS hashes of a band are candidates. A pair at
   the least similarity is missed by every band with probability
   (1 - 0.8^5)^35 < 1e-6, and less above it.
3. A candidate's signatures are compared batch by batch. After each batch the
   posterior P(similarity >= s | m of n hashes agree), from a uniform prior,
   must be at least MISS, or the pair is pruned: the chosen miss probability.
4. Survivors are verified on their full shingle sets, exactly.

A band bucket of any size is never expanded into pairs: its members are first
compared with its hub alone (linear), links are contracted into
components, and only buckets that still hold several components go on, with
pairs across components only. Buckets of more than SPLIT members make no pairs
of their own: exact prefix filters on what each member has beyond its hub
propose them (see ``_residual_pairs``); members that lie almost wholly within
different hubs are paired by two bands (a pair agrees in fewer than two of
the 35 bands with probability < 2e-5), and by the same filters, with a hub of
their own, where more than SPLIT agree in the same two. No bucket is capped. Hot hubs and hot sets are one row on
their side of a join, whose other side is split as a skewed join.

Nulls and ties: no words, or a null text: empty set, linked with nothing. Rows
of one doc_id count as one document. A null doc_id takes the component of an
equal set, if an id has that set, and else stays alone with component_id null
and kept true. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.llm.base import ByteCache, fresh, quoted
from flowsift.session import cut_lineage, maybe_broadcast

BANDS, ROWS = 35, 5
BATCH = 25            # hashes compared between two looks at the posterior
MISS = 1e-6           # posterior below which a pair is pruned
SPLIT = 20            # members of a mixed bucket beyond which it isn't paired within

_WORDS = ByteCache(xxhash.xxh64_intdigest)
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
# odd multipliers of the minimum hashes
_A = (np.random.default_rng(20).integers(0, 2 ** 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))


def shingle_set(text: str | None, words_per_shingle: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    k = min(n, words_per_shingle)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s = (s * _P) ^ h[i:n - k + 1 + i]
        s ^= s >> np.uint64(29)
    s *= _M
    s ^= s >> np.uint64(32)
    s *= _M
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minimum hashes of a non-empty set."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 2048):
        np.minimum(out, (_A[:, None] * h[None, at:at + 2048]).min(axis=1), out=out)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """d1 and d2 of a set: 128 bits, zeros for the empty one."""
    if not len(s):
        return 0, 0
    a, c = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(c)


def _sign_batches(words_per_shingle: int):
    def run(batches):
        band = np.arange(1, BANDS + 1, dtype=np.uint64)
        for b in batches:
            n, d1, d2, bands, sigs = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, words_per_shingle)
                n.append(len(s))
                a, c = _digest(s)
                d1.append(a), d2.append(c)
                if not len(s):
                    bands.append(None), sigs.append(None)
                    continue
                sig = signature(s)
                key = band * _M
                for col in sig.reshape(BANDS, ROWS).T:
                    key = (key ^ col) * _P
                    key ^= key >> np.uint64(31)
                bands.append(_signed(key))
                sigs.append(((sig * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "sig"])
        _WORDS.clear()
    return run


def _set_batches(words_per_shingle: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words_per_shingle) for t in b.column(1).to_pylist()]
            d1, d2 = zip(*map(_digest, sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(_signed, sets)), pa.list_(pa.int64())), pa.array(d1, pa.int64()),
                 pa.array(d2, pa.int64())], names=["id", "set", "d1", "d2"])
    return run


def _digests(words_per_shingle: int):
    @F.pandas_udf("d1 long, d2 long")
    def digests(batch):
        import pandas as pd
        return pd.DataFrame([_digest(shingle_set(t, words_per_shingle)) for t in batch], columns=["d1", "d2"])
    return digests


def _row_key(doc_id, d1, d2):
    """What tells rows apart: the id (null ones last) and the digest of the set."""
    return F.struct(doc_id.isNull().alias("alone"), doc_id.alias("doc_id"), d1.alias("d1"), d2.alias("d2"))


def least_matches(percent: int, total: int = BANDS * ROWS, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, fewest agreements that keep a pair) after each batch.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m
    + 1), and P(similarity >= t) is a binomial sum. Signature bytes also agree
    by chance, and the band that proposed the pair agrees for certain; both
    only raise m, so they prune less, never more."""
    t, out = percent / 100, []
    for n in [*range(batch, total, batch), total]:
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append((n, m))
    return out


def _posterior_keep(percent: int):
    looks = least_matches(percent)

    @F.pandas_udf(T.BooleanType())
    def keep(a, b):
        import pandas as pd
        n = len(a)
        if not n:
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(a), np.uint8).reshape(n, -1)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(n, -1)
        alive, agree, at = np.arange(n), np.zeros(n, np.int32), 0
        for upto, least in looks:  # each batch is compared for the pairs still alive only
            agree[alive] += (x[alive, at:upto] == y[alive, at:upto]).sum(axis=1)
            alive, at = alive[agree[alive] >= least], upto
        out = np.zeros(n, bool)
        out[alive] = True
        return pd.Series(out)
    return keep


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int,
              by_row: bool = False) -> DataFrame:
    """The pairs (a, b) that are links: posterior pruning, then the exact test."""
    sig = classes.select("rep", "sig")
    cand = (pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b"))
    cand = cut_lineage(cand.filter(_posterior_keep(percent)("sa", "sb")).select("a", "b"))
    need = cand.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = _sets(docs, need, words, by_row)
    both = cand.join(sets.toDF("b", "tb"), "b").join(sets.toDF("a", "ta"), "a")
    inter = F.size(F.array_intersect("ta", "tb")).cast("long")
    both = both.select("a", "b", inter.alias("i"), (F.size("ta") + F.size("tb")).cast("long").alias("s"))
    return cut_lineage(both.filter(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge (a, b): the smallest id it reaches.

    Labels spread along the edges and jump to their label's label, until no
    label changes; every round is written to the checkpoint folder."""
    both = cut_lineage(edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                                      F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
                       .select("e.*"))
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m"))
                         .select(F.col("u").alias("id"), F.least("u", "m").alias("label")))
    while True:
        near = (both.join(labels.toDF("v", "lv"), "v").groupBy("u").agg(F.min("lv").alias("m")))
        new = labels.join(near, labels["id"] == near["u"]).select("id", F.col("label").alias("old"),
                                                                  F.least("label", "m").alias("label"))
        over = new.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = cut_lineage(new.join(over, "label", "left").select(
            "id", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        done = new.filter("old <> label").isEmpty()
        labels = new.select("id", "label")
        if done:
            return labels


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = 4,
                    percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``df``."""
    docs = df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return _components_of(docs, words_per_shingle, percent).withColumnRenamed("doc_id", doc_id)


def _components_of(docs: DataFrame, words_per_shingle: int, percent: int, by_row: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; if
    ``by_row`` with the row key in the place of the id: rows of one id and
    different sets, and rows without an id, are documents of their own."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()),
        T.StructField("d2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sig", T.BinaryType())])
    signed = docs.mapInArrow(_sign_batches(words_per_shingle), schema)
    if by_row:
        signed = signed.withColumn("doc_id", _row_key(F.col("doc_id"), F.col("d1"), F.col("d2")))
    signed = cut_lineage(signed)
    # one row for each distinct set
    classes = cut_lineage(signed.filter("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"),
        F.count("*").alias("n")).filter("rep is not null"))
    # buckets of several classes, by band; each row knows its bucket's smallest class
    bands = classes.select(F.explode("bands").alias("key"), "rep")
    shared = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    members = cut_lineage(bands.join(cut_lineage(shared.filter("lo < hi").select("key", "size")), "key"))
    # a bucket's hub is the class that meets most others: of a family of copies most likely their origin
    meets = members.groupBy("rep").agg(F.sum("size").alias("meets"))
    hubs = (members.join(meets, "rep").groupBy("key").agg(F.max(F.struct("meets", "rep")).alias("m"))
            .select("key", F.col("m.rep").alias("hub"), F.col("m.meets").alias("meets")))
    members = cut_lineage(members.select("key", "rep").join(cut_lineage(hubs), "key"))
    star = members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = _verified(star, classes, docs, words_per_shingle, percent, by_row)
    labels = components(links)

    # buckets that hold several components yet: pairs across components, the hub's own are done
    rest = (members.filter("rep <> hub").select("key", "rep", "hub", "meets")
            .join(labels.toDF("rep", "label"), "rep", "left")
            .select("key", "rep", "hub", "meets", F.coalesce("label", "rep").alias("label")))
    mixed = cut_lineage(_mixed(rest, "hub", "meets"))
    small = mixed.filter(F.col("n") <= SPLIT).select("key", "rep", "label")
    large = (mixed.filter(F.col("n") > SPLIT).groupBy("rep", "label")
             .agg(F.max(F.struct("meets", "hub")).alias("p")).select("rep", "label", F.col("p.hub").alias("pivot")))
    sharing, plain = _residual_pairs(cut_lineage(large), docs, words_per_shingle, percent, by_row)
    # two members within different pivots: they agree in a second band. Both bands' buckets
    # are large and hold several pivots, or else the pair is among those above
    within = _mixed(plain.withColumnRenamed("pivot", "label").join(
        mixed.filter(F.col("n") > SPLIT).select("key", "rep"), "rep"))
    second = (within.groupBy("rep", "label").agg(F.array_sort(F.collect_set("key")).alias("k"))
              .select("rep", "label", "k", F.posexplode("k").alias("at", "k1"))
              .select("rep", "label", F.explode(F.expr("transform(slice(k, at + 2, size(k)), x -> xxhash64(k1, x))"))
                      .alias("key")))
    apart = _apart_pairs(_mixed(second), docs, words_per_shingle, percent, by_row)
    across = (_across(small.select("key", "rep", "label")).unionByName(apart).unionByName(sharing)
              .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    more = _verified(across, classes, docs, words_per_shingle, percent, by_row)
    # contract: links between the labels so far
    if not more.isEmpty():
        lab = labels.toDF("id", "l")
        top = (more.join(lab.toDF("a", "la"), "a", "left").join(lab.toDF("b", "lb"), "b", "left")
               .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct())
        roots = components(top).toDF("label", "root")
        known = labels.unionByName(more.select(F.explode(F.array("a", "b")).alias("id")).distinct()
                                   .join(labels, "id", "left_anti").select("id", F.col("id").alias("label")))
        labels = cut_lineage(known.join(roots, "label", "left").select("id", F.coalesce("root", "label").alias("label")))
    # every class's component, then every row's
    found = classes.join(labels.toDF("rep", "label"), "rep", "left").filter("n > 1 or label is not null").select(
        "d1", "d2", F.coalesce("label", "rep").alias("label"))
    found = cut_lineage(found)
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(found, ["d1", "d2"], "left")
    comp = F.when(F.col("n_shingles") > 0, F.col("label"))
    comp = F.coalesce(comp, F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"),
                      F.col("doc_id").eqNullSafe(comp).alias("kept"))


def _mixed(rows: DataFrame, *more: str) -> DataFrame:
    """The rows (key, rep, label, more) of keys with several labels, and n, the key's rows."""
    keys = (rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
            .filter("lo < hi").select("key", "n"))
    return rows.select("key", "rep", *more, "label").join(cut_lineage(keys), "key")


def _across(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of one key and different labels."""
    rows = cut_lineage(rows.select("key", "rep", "label"))
    return _cut_pairs(rows.toDF("key", "a", "la").join(rows.toDF("key", "b", "lb"), "key").filter("la < lb"))


def _cut_pairs(pairs: DataFrame) -> DataFrame:
    """The distinct (a, b), computed now. Each way of proposing pairs is a plan of its own:
    in one plan of them all the driver would plan, compile and broadcast for dozens of
    exchanges at once, and hold what that takes."""
    return cut_lineage(pairs.select("a", "b").distinct())


def _apart_pairs(rows: DataFrame, docs: DataFrame, words: int, percent: int, by_row: bool = False) -> DataFrame:
    """Candidates (a, b) across labels of rows (key, rep, label, n): all pairs of a key of
    SPLIT rows or fewer; of a larger key each row with the key's hub, and what the
    residual filters propose with that hub as the pivot of all its rows. Two rows that are
    both linked with the hub are joined by it and needn't be a pair."""
    rows = cut_lineage(rows)
    small = _across(rows.filter(F.col("n") <= SPLIT).select("key", "rep", "label"))
    large = rows.filter(F.col("n") > SPLIT)
    if large.isEmpty():
        return small
    meets = large.groupBy("rep").agg(F.sum("n").alias("meets"))
    hubs = (large.join(meets, "rep").groupBy("key").agg(F.max(F.struct("meets", "rep")).alias("m"))
            .select("key", F.col("m.rep").alias("pivot")))
    members = cut_lineage(large.join(cut_lineage(hubs), "key").filter("rep <> pivot").select("rep", "label", "pivot").distinct())
    sharing, _ = _residual_pairs(members, docs, words, percent, by_row)
    star = members.select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    return small.unionByName(star).unionByName(sharing)


def _residual_pairs(members: DataFrame, docs: DataFrame, words: int, percent: int,
                    by_row: bool = False) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b) across labels among members (rep, label, pivot) of large
    buckets: exact prefix filters on what members have beyond their pivot. Also
    the members (rep, pivot) for which only pairs with one pivot are covered.

    Let p = percent / 100, and let x share i shingles with its pivot B. A
    partner y shares at least p * |x| shingles with x, so at least ``need = p *
    |x| - i`` of the residual x - B. If need is positive, y holds one of any
    ``|x - B| - need + 1`` residual shingles (first filter).

    Otherwise let x be short of B by dx shingles and hold ax others, and y by dy
    and ay. With s of these changes in common, the intersection is |B| - dx - dy
    + s and the union |B| + ax + ay - s, so a link asks for s >= (dx + dy + p *
    (ax + ay) - (1 - p) * |B|) / (1 + p). If x isn't linked with B, dx + p * ax
    > (1 - p) * |B|, hence s > (dy + p * ay) / (1 + p), and x holds one of y's
    first ``dy + ay - s + 1`` changes in any order (second filter; here those
    that the fewest unlinked members hold come first). In the same order the first
    common change is among x's first ``dx + ax - s + 1`` as well, with s >= dx + p *
    ax - (1 - p) * |B|, as dy + p * ay >= p * s. An x that holds less than
    it lacks shares most of its changes with others of its kind: it is proposed
    by the prefix filter of whole sets instead, the |x| - p * |x| + 1 shingles
    that the fewest members of the pivot hold, one of which must be among the
    partner's own (third filter).

    Copies of one origin, or documents around one passage, have that in the
    pivot: these indexes stay sparse where band buckets are dense."""
    if members.isEmpty():
        return (members.select(F.col("rep").alias("a"), F.col("pivot").alias("b")), members.select("rep", "pivot"))
    need_sets = members.select(F.explode(F.array("rep", "pivot")).alias("id")).distinct()
    sets = _sets(docs, need_sets, words, by_row)
    held = members.join(sets.toDF("rep", "tx"), "rep").join(sets.toDF("pivot", "tp"), "pivot")
    held = cut_lineage(held.select("rep", "label", "pivot", "tx", F.size("tp").alias("n"),
                                   F.array_sort(F.array_except("tx", "tp")).alias("more"),
                                   F.array_sort(F.array_except("tp", "tx")).alias("less")))
    size, own, lost = F.size("tx"), F.size("more"), F.size("less")
    need = F.ceil(size * percent / 100).cast("int") - (size - own)
    # sets that differ more in size can't be linked
    fits = (100 * F.col("nb") >= percent * F.col("na")) & (100 * F.col("na") >= percent * F.col("nb"))
    partner = [F.col("rep").alias("b"), F.col("label").alias("lb"), size.alias("nb")]
    own_rows = cut_lineage(held.select(*partner, F.explode("more").alias("e")))
    in_pivot = cut_lineage(held.groupBy("pivot").agg(F.count("*").alias("c"))
                           .join(sets.toDF("pivot", "tp"), "pivot").select("pivot", "c", F.explode("tp").alias("e")))
    # the first residual shingles by how many members may hold them: the rarest propose the fewest pairs
    held_by = (own_rows.select("e", F.lit(1).alias("c")).unionByName(in_pivot.select("e", "c"))
               .groupBy("e").agg(F.sum("c").alias("c")))
    keys = cut_lineage(
        held.filter(need > 0)
        .select("rep", "label", size.alias("size"), "pivot", (own - need + 1).alias("k"), F.explode("more").alias("e"))
        .join(held_by, "e").groupBy("rep", "label", "size", "pivot", "k")
        .agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("r"))
        .select("rep", "label", "size", "pivot", F.explode(F.slice("r", F.lit(1), F.col("k"))).alias("r"))
        .select(F.col("rep").alias("a"), F.col("label").alias("la"), F.col("size").alias("na"), "pivot",
                F.col("r.e").alias("e")))
    # y holds the shingle beyond its own pivot, or has it of its pivot: of these
    # only the ones that a key asks for are looked up
    asked = (keys.select("e").distinct().join(in_pivot, "e").groupBy("pivot").agg(F.collect_set("e").alias("asked")))
    shared = held.join(asked, "pivot").select(*partner, F.explode(F.array_intersect("tx", "asked")).alias("e"))
    pairs = _cut_pairs(keys.drop("pivot").join(own_rows.unionByName(shared), "e").filter("la <> lb").filter(fits))

    plain = held.filter(need <= 0)
    # a missing shingle is another element than the same shingle added
    changes = F.concat("more", F.transform("less", lambda e: F.xxhash64(F.lit("less"), e)))
    share = F.floor((100 * lost + percent * own) / (100 + percent)).cast("int") + 1
    linked = 100 * (F.col("n") - lost) >= percent * (F.col("n") + own)
    few = ~linked & (size < own + lost)
    # what x alone says of s: dy + p * ay >= p * s, so s >= dx + p * ax - (1 - p) * |B|
    least = F.ceil((100 * lost + percent * own - (100 - percent) * F.col("n")) / 100).cast("int")
    x = cut_lineage(plain.filter(~linked & ~few).select(
        F.col("rep").alias("a"), F.col("label").alias("la"), size.alias("na"), "pivot", (own + lost - least + 1).alias("k"),
        F.explode(changes).alias("e")))
    seldom = cut_lineage(x.groupBy("pivot", "e").agg(F.count("*").alias("c")))
    # the same order on both sides: x's first changes, too, must hold one of a partner's
    x = (x.join(seldom, ["pivot", "e"]).groupBy("a", "la", "na", "pivot", "k")
         .agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("r"))
         .select("a", "la", "na", "pivot", F.explode(F.slice("r", F.lit(1), F.col("k"))).alias("r"))
         .select("a", "la", "na", "pivot", F.col("r.e").alias("e")))
    first = F.greatest(own + lost - share + 1, F.lit(0))
    # of y's changes those that the fewest x hold; what none holds proposes nothing
    rows = (plain.select("rep", "label", size.alias("size"), "pivot", first.alias("k"), F.explode(changes).alias("e"))
            .join(seldom, ["pivot", "e"], "left"))
    y = (rows.groupBy("rep", "label", "size", "pivot", "k")
         .agg(F.count_if(F.col("c").isNull()).alias("none"),
              F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "e")))).alias("r"))
         .select(F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("size").alias("nb"), "pivot",
                 F.explode(F.slice("r", F.lit(1), F.greatest(F.col("k") - F.col("none"), F.lit(0)).cast("int"))).alias("r"))
         .select("b", "lb", "nb", "pivot", F.col("r.e").alias("e")))
    near = _cut_pairs(x.join(y, ["pivot", "e"]).filter("la <> lb").filter(fits))

    whole = (plain.join(plain.filter(few).select("pivot").distinct(), "pivot", "left_semi")
             .select("rep", "label", size.alias("size"), few.alias("few"), "pivot", F.explode("tx").alias("e")))
    common = whole.groupBy("pivot", "e").agg(F.count("*").alias("c"))
    prefix = cut_lineage(
        whole.join(common, ["pivot", "e"]).groupBy("rep", "label", "size", "few", "pivot")
        .agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("r"))
        .select("rep", "label", "size", "few", "pivot",
                F.explode(F.slice("r", F.lit(1), (F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).cast("int")))
                .alias("r"))
        .filter("r.c > 1").select("rep", "label", "size", "few", "pivot", F.col("r.e").alias("e")))
    small = _cut_pairs(prefix.filter("few").selectExpr("rep AS a", "label AS la", "size AS na", "pivot", "e")
                       .join(prefix.selectExpr("rep AS b", "label AS lb", "size AS nb", "pivot", "e"), ["pivot", "e"])
                       .filter("la <> lb").filter(fits))
    return pairs.unionByName(near).unionByName(small), plain.select("rep", "pivot")


def _sets(docs: DataFrame, ids: DataFrame, words: int, by_row: bool = False) -> DataFrame:
    """(id, set): the shingle sets of the documents named in ``ids``."""
    ids = maybe_broadcast(ids)
    named = F.col("id")["doc_id"] if by_row else F.col("id")
    text = docs.join(ids, F.col("doc_id").eqNullSafe(named) if by_row else F.col("doc_id") == named, "left_semi")
    sets = text.select("doc_id", "text").mapInArrow(
        _set_batches(words), T.StructType([T.StructField("id", docs.schema["doc_id"].dataType),
                                           T.StructField("set", T.ArrayType(T.LongType())),
                                           T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())]))
    if not by_row:
        return sets.select("id", "set")
    sets = sets.select(_row_key(F.col("id"), F.col("d1"), F.col("d2")).alias("id"), "set")
    # rows of one key are one document
    return sets.join(ids, "id", "left_semi").groupBy("id").agg(F.first("set").alias("set"))


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = 5,
                         percent: int = 80) -> DataFrame:
    """The rows of ``df`` of which one row of each component stays: the one with
    the smallest id (null ids last; of equal ids and sets the first by text).

    Rows are told apart by id and set, not by id alone: of an id's rows only
    those go that are linked with another row, and rows without an id are
    documents like others. Rows that are linked with nothing all stay."""
    docs = df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    digest, key, g, i, r = fresh(df, "_digest", "_key", "_g", "_i", "_r")
    found = _components_of(docs, words_per_shingle, percent, by_row=True)
    found = cut_lineage(found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias(g), "kept")
                        .agg(F.count("*").alias("n")).filter("not kept or n > 1"))
    gone = maybe_broadcast(found.filter("not kept").select(g))
    again = maybe_broadcast(found.filter("kept").select(g))  # equal rows of one id, of which one stays
    ids = maybe_broadcast(found.select(F.col(g)["doc_id"].alias(i)).distinct())
    named, same = quoted(doc_id).eqNullSafe(F.col(i)), F.col(key) == F.col(g)
    held = df.join(ids, named, "left_semi").withColumn(digest, _digests(words_per_shingle)(quoted(text)))
    held = held.withColumn(key, _row_key(quoted(doc_id), F.col(digest)["d1"], F.col(digest)["d2"])).drop(digest)
    held = held.join(gone, same, "left_anti")
    row = F.struct(*map(quoted, df.columns))
    # an aggregate, not a rank: the copies of a hot row don't meet in one task
    once = (held.join(again, same, "left_semi").groupBy(key)
            .agg(F.min_by(row, F.struct(quoted(text), F.xxhash64(F.to_json(row)))).alias(r)).select(f"{r}.*"))
    return (df.join(ids, named, "left_anti").unionByName(held.join(again, same, "left_anti").drop(key))
            .unionByName(once))
