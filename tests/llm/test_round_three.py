"""Token store, periodic runs and hard negatives against brute force: nulls, empty
and long texts, ties, repeated rows, empty tables, clashing columns, hot keys."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsift.llm import hard_negatives, near_dup, packing, period_runs, queries, token_store

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


# 11 token store

def streams():
    rng = np.random.default_rng(11)
    return [rng.zipf(1.4, 5000) % 49_000, np.zeros(1000), np.array([5]), np.array([]), np.array([1, 2] * 50 + [1] * 31),
            rng.integers(0, 3, 4000), rng.integers(0, 70_000, 500), np.repeat(rng.integers(0, 99, 40), 50)]


@pytest.mark.parametrize("at", range(8))
def test_grammar_round_trip_and_random_access(at, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK", 16)
    ids = streams()[at].astype(np.uint32)
    cuts = sorted({0, len(ids) // 3, len(ids) // 3, len(ids)})
    parts = [ids[a:b] for a, b in zip(cuts, cuts[1:])] or [ids]
    shard = token_store.Shard(token_store.encode_shard(parts))
    assert (shard.ids() == ids).all() and shard.n_ids == len(ids)
    for n, p in enumerate(parts):
        assert (shard.document(n) == p).all()
    rng = np.random.default_rng(at)
    for _ in range(50):
        lo, hi = sorted(rng.integers(0, len(ids) + 1, 2))
        assert (shard.ids_between(lo, hi) == ids[lo:hi]).all()
    # rules expand to as many ids as the shard says
    assert (shard.rule_lengths == [len(shard.grammar.expand(np.array([shard.grammar.base + k], np.uint32)))
                                   for k in range(len(shard.rule_lengths))]).all()


def test_pairs_are_replaced_by_frequency():
    ids = np.array([7, 8, 9] * 40 + [8, 9] * 60 + [1, 2, 3, 4], np.uint32)
    base, rules, rounds, seq = token_store.compress(ids)
    assert rules[0].tolist() == [8, 9] and len(seq) < len(ids) / 2 and sum(rounds) == len(rules)
    at, rank, pairs = token_store.frequent_pairs(ids, 16)
    brute = {}
    for a, b in zip(ids, ids[1:]):
        brute[a, b] = brute.get((a, b), 0) + 1
    assert set(at) == {i for i in range(len(ids) - 1) if brute[ids[i], ids[i + 1]] >= 16}
    assert all(tuple(pairs[r]) == (ids[i], ids[i + 1]) for i, r in zip(at, rank)) and pairs[0].tolist() == [8, 9]
    assert token_store.compress(np.array([4, 3, 2], np.uint32))[1].shape == (0, 2)


def test_words_of_one_stem_are_looked_up_once(monkeypatch):
    tok = packing.WordTokenizer(queries.tokenizer_file())
    texts = [None, "", "Hend, HEND. hend it's It'LL.", "  K, \u212a \u0130x! a.. B?! \xe9. \xc9, 12. x1; ., .\n",
             "\x85x\u3000y\xa0z", "a\x1cb A\x1fb", "<|endoftext|> A.", "hend; Hend! " * 50]
    for batch in (pa.array(texts), pa.array([t for t in texts if "\x1c" not in (t or "")]), pa.array(texts).slice(2, 2),
                  pa.array(texts).cast(pa.large_string()), pa.array([], pa.string()), pa.array([None], pa.string())):
        flat, sizes = tok.many(batch)
        want = [tok.ids(t) for t in batch.to_pylist()]
        assert sizes.tolist() == [len(x) for x in want] and flat.tolist() == [int(i) for x in want for i in x]
    made, tok = [], packing.WordTokenizer(queries.tokenizer_file())
    monkeypatch.setattr(tok.words, "make", lambda w: made.append(w) or tok.word(w))
    tok.many(pa.array(["Hend, hend. HEND!", "hend hend; Hend"]))
    assert sorted(w for w in made if w not in tok.MARKS) == ["hend"]
    cuts = packing.slices(pa.array(texts), 40)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(texts) and all(a[1] == b[0] and a[0] < a[1] for a, b in zip(cuts, cuts[1:]))


def test_rare_pairs_are_not_sorted(monkeypatch):
    ids = np.random.default_rng(5).integers(0, 40_000, 50_000).astype(np.uint32)
    ids[::100], ids[1::100] = 7, 8
    sorted_rows, sort = [], np.sort
    monkeypatch.setattr(np, "sort", lambda x, *a, **k: sorted_rows.append(len(x)) or sort(x, *a, **k))
    at, rank, pairs = token_store.frequent_pairs(ids, 16)
    assert (ids[at] == 7).all() and (rank == 0).all() and pairs.tolist() == [[7, 8]] and len(at) == 500
    assert max(sorted_rows) < 5_000
    monkeypatch.setattr(token_store, "SLOT_BITS", 1)  # slots that pairs share propose more, with the same result
    assert all(np.array_equal(a, b) for a, b in zip(token_store.frequent_pairs(ids, 16), (at, rank, pairs)))


@pytest.mark.parametrize("shard_ids", [1, 300, 1 << 20])
def test_token_store_equals_the_library(spark, tmp_path, shard_ids):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_file())
    texts = ["Hello world " * 30, None, "", "ÄÖ 漢字 <|endoftext|>", "word " * 4000, "x", "same", "same", "z" * 5000]
    ids = [5, 1, None, 9, 2, 7, 7, 7, 30]
    df = docs(spark, texts, ids).withColumn("part", F.lit(1)).withColumn("body", F.lit("b")).repartition(4)
    path = str(tmp_path / "store")
    token_store.write_shards(df, path, queries.tokenizer_file(), shard_ids=shard_ids)
    got = [tuple(r) for r in token_store.read_documents(spark, path, with_ids=True).collect()]
    assert len(got) == len(texts)
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    at, want = 0, sorted(((i is not None, i or 0), [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in zip(ids, texts))
    for i, start, n, crc, own in got:
        assert start == at and n == len(own) and crc == zlib.crc32(np.array(own, "<u4").tobytes())
        at += n
    assert sorted(((r[0] is not None, r[0] or 0), r[4]) for r in got) == want


def test_a_workers_next_task_finds_its_words(spark, tmp_path):
    df = docs(spark, [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)])
    token_store.write_shards(df.repartition(8), str(tmp_path / "store"), queries.tokenizer_file())

    def held(batches):
        for b in batches:
            words = len(packing.tokenizer_of(path, token_store.WORD_BYTES).words)
            yield pa.RecordBatch.from_arrays([pa.array([words] * b.num_rows, pa.int64())], names=["words"])

    path = queries.tokenizer_file()
    assert max(r.words for r in df.repartition(8).mapInArrow(held, "words long").collect()) > 0


def test_token_store_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_shards(docs(spark, []), path, queries.tokenizer_file())
    assert token_store.read_documents(spark, path).count() == 0


# 12 periodic runs

def brute_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                seg = w[i:j + q]
                if not any(seg[p:] == seg[:-p] for p in range(1, q)):
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_texts():
    rng, out = random.Random(12), []
    for _ in range(150):
        k, n = rng.choice([1, 2, 3, 5, 30, 500]), rng.randrange(0, 120)
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < .6 and n > 4:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
        if rng.random() < .3:
            w = w + [900 + i for i in range(rng.randrange(5))] + w
        out.append(w)
    return out


@pytest.mark.parametrize("look, pairs", [(16, 1 << 21), (2, 40)])
def test_runs_equal_brute_force(monkeypatch, look, pairs):
    monkeypatch.setattr(period_runs, "LOOK", look)
    monkeypatch.setattr(period_runs, "PAIRS", pairs)
    texts = run_texts()
    got = period_runs.find_runs(np.array(sum(texts, [])), [len(t) for t in texts])
    assert got == [brute_runs(t) for t in texts] and sum(map(len, got)) > 100


def test_splitting_leaves_no_word_that_occurs_once():
    texts = run_texts()
    ids, sizes = np.array(sum(texts, [])), [len(t) for t in texts]
    left = period_runs.surviving_segments(ids, sizes)
    for a, b in left:
        assert b - a >= 12 and min(np.unique(ids[a:b], return_counts=True)[1]) >= 2
    ends = np.cumsum(sizes)
    for n, t in enumerate(texts):
        for start, length, _ in brute_runs(t):  # every run lies whole in a segment
            a = int(ends[n]) - len(t) + start
            assert any(x <= a and a + length <= y for x, y in left)


def test_long_segments_are_scanned_whole():
    x = np.arange(120_000) % 40_000
    x[100_000:] = 50_000 + np.arange(20_000) % 7
    assert sorted(period_runs.scan_lags(x)) == [(0, 100_000, 40_000), (100_000, 20_000, 7)]


def test_run_digest_and_edges(spark):
    texts = [" ".join(f"w{i}" for i in t) for t in run_texts()]
    texts += [None, "", " \t\n", "a  b\tA b " * 9, "x y " * 3000, "a b c a b c a b c a b c end"]
    df = docs(spark, texts, [*range(len(texts) - 1), None]).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(2))
    df = df.unionByName(df.limit(3))
    out = period_runs.with_runs(df)
    assert out.columns == [*df.columns, "n_words", "_runs", "_collapsed"] and out.count() == len(texts) + 3
    got = {r.doc_id: r for r in period_runs.run_digest(df).collect()}
    for i, t in zip([*range(len(texts) - 1), None], texts):
        w = (t or "").encode().split()
        runs = brute_runs(w) if len(w) < 3000 else [(0, 6000, 2)]
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        r = got[i]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == (
            (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2]))
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
    assert period_runs.run_digest(df.limit(0)).count() == 0


# 13 hard negatives

def brute_negatives(rows, every, n_pos=5, n_neg=3, scale=256):
    rows = {(i, y, tuple(int(np.floor(float(np.float32(c)) * scale)) for c in v)) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    dim = max(len(v) for _, _, v in rows)
    rows = sorted((i, y, np.array(v + (0,) * (dim - len(v)))) for i, y, v in map(tuple, rows))
    out = []
    for i, y, q in rows:
        if i % every:
            continue
        scored = [(-int(v @ q), j, z == y) for j, z, v in rows if j != i]
        for s, p, _ in sorted(x for x in scored if x[2])[:n_pos]:
            inside = sorted(x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:n_neg]
            out += [(i, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(inside)]
    return sorted(out)


def vectors(seed, n, dim, centres):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return [(i, (c[i % centres] + 0.4 * rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(0, 4)))
            for i in range(n)]


@pytest.mark.parametrize("page, tree, chunk", [(256, 16_000, 4096), (4, 40, 8)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, page, tree, chunk):
    for name, value in (("PAGE", page), ("TREE_ROWS", tree), ("CHUNK", chunk), ("FAN", 4 if page == 4 else 64),
                        ("SUMMARY_BYTES", 1 if page == 4 else 16 << 20)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(13, 150, 6, 5)
    rows += [(i, rows[3][1], i % 3) for i in range(200, 290)]  # equal vectors, ties
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * 6, 1), (304, [float("inf")] * 6, 1),
             (None, [1.0] * 6, 1), (306, [2.0, 1.0], 2), (308, [1.0] * 6, None), (310, [], 3), rows[0], rows[40]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {"v": F.lit(1), "rank": F.lit(2), "tree": F.lit(3), "anchor_id": F.lit(4)}).repartition(3)
    got = hard_negatives.mine(df, lambda v: v % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10)
    text = df.withColumn("label", F.concat(F.lit("l"), "label"))  # labels of another type
    if page == 256:
        assert sorted(map(tuple, hard_negatives.mine(text, lambda v: v % 10 == 0).collect())) == brute_negatives(rows, 10)
        assert hard_negatives.mine(df.limit(0), lambda v: v % 10 == 0).count() == 0
        with pytest.raises(ValueError):
            hard_negatives.mine(df, lambda v: v % 10 == 0, scale=1 << 40)


def test_cover_tree_bounds_and_search(monkeypatch):
    monkeypatch.setattr(hard_negatives, "PAGE", 8)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 6)), 20, axis=0) + 0.05 * rng.normal(size=(800, 6))
    v = np.unique(np.floor(256 * x).astype(np.int64), axis=0)
    n = len(v)
    label, norm2 = rng.integers(0, 3, n), float((v ** 2).sum(axis=1).max())
    tree = hard_negatives.CoverTree(v, label, [[i] for i in range(n)], norm2)
    assert sorted(i for [i] in tree.ids) == list(range(n)) and len(tree.kids) > 20
    lifted = hard_negatives.lift(tree.vectors, norm2)
    for k, kids in enumerate(tree.kids):  # radii cover, children split their parent
        inside = lifted[tree.first[k]:tree.end[k]]
        assert np.sqrt(((inside - lifted[tree.centre[k]]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-6
        if len(kids):
            assert [tree.first[k], *tree.end[kids]] == [*tree.first[kids], tree.end[k]]
    for a in range(0, n, 37):
        scores = v @ v[a]
        q = v[a].astype(np.float64)
        low, high = tree.bounds(np.arange(len(tree.kids)), q, float((q ** 2).sum()) + norm2, 1e-3)
        for k in range(len(tree.kids)):
            s = tree.vectors[tree.first[k]:tree.end[k]] @ q
            assert low[k] <= s.min() and s.max() <= high[k]
        for same, lo, hi in ((True, -hard_negatives.ALL, hard_negatives.ALL), (False, int(scores.max() // 2), int(scores.max() * .9))):
            ok = [(-int(scores[i]), i) for i in range(n) if i != a and (label[i] == label[a]) == same and lo <= scores[i] <= hi]
            assert tree.search(q, a, label[a], same, lo, hi, 4) == [(i, -s) for s, i in sorted(ok)[:4]]


def test_requests_of_one_anchor_share_a_leafs_scores(monkeypatch):
    """Requests that meet a tree look into a leaf together: far fewer looks than requests times leaves."""
    monkeypatch.setattr(hard_negatives, "PAGE", 16)
    rng = np.random.default_rng(8)
    v = np.unique(rng.integers(-200, 200, (600, 8)), axis=0)
    n, looks = len(v), []
    label, norm2 = rng.integers(0, 3, n), float((v ** 2).sum(axis=1).max())
    tree = hard_negatives.CoverTree(v, label, [[i] for i in range(n)], norm2)
    inner = tree._look_into
    monkeypatch.setattr(tree, "_look_into", lambda leaf, who, *rest: (looks.append(len(who)), inner(leaf, who, *rest)))
    anchors = np.arange(0, n, 20)
    of = np.repeat(np.arange(len(anchors)), 5)
    own, top = anchors[of], np.array([int((v @ v[a]).max()) for a in anchors])[of]
    lo, hi = top * np.tile([10, 20, 30, 40, 50], len(anchors)) // 100, top * 9 // 10
    same = np.arange(len(of)) % 2 == 0
    got = tree.search_all(v[anchors].astype(np.float64), of, own, label[own], same, lo, hi, 3)
    for r, a in enumerate(own):
        s = v @ v[a]
        ok = [(-int(s[i]), i) for i in range(n) if i != a and (label[i] == label[a]) == same[r] and lo[r] <= s[i] <= hi[r]]
        assert got[r] == [(i, -x) for x, i in sorted(ok)[:3]]
    leaves = sum(not len(k) for k in tree.kids)
    assert len(looks) <= 2 * leaves < sum(looks) / 10


# 3 two-band buckets

def test_large_two_band_buckets_make_no_square_of_pairs(spark):
    """Copies of one origin agree in two bands, few of them are linked with each other:
    the filters propose far fewer pairs than the bucket has, and lose no link."""
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    origin = [word() for _ in range(160)]
    texts = [" ".join(origin)]
    for n in range(120):
        w = list(origin)
        for j in rng.choice(160, rng.integers(3, 12), replace=False):
            w[j] = word()
        texts.append(" ".join(w))
        if n % 5 == 0:
            texts.append(" ".join(w[:-1] + [word()]))  # a near copy of the last one
    texts += [" ".join(word() for _ in range(40)) for _ in range(5)]
    df, n = docs(spark, texts), len(texts)
    sets = [set(near_dup.shingle_set(t).tolist()) for t in texts]
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    rows = [(1, i, i, n - 5) for i in range(n - 5)] + [(2, i, i % 2, 5) for i in range(n - 5, n)]
    rows.append((3, 0, 0, 30))  # the origin meets most others
    pairs = near_dup._apart_pairs(spark.createDataFrame(rows, "key long, rep long, label long, n long"),
                                  df.select("doc_id", "text"), 4, 80)
    got = {tuple(sorted(p)) for p in pairs.distinct().collect()}
    assert {p for p in got if p[1] >= n - 5} == {(a, b) for a in range(n - 5, n) for b in range(a + 1, n) if (a - b) % 2}

    def classes(edges):
        root = list(range(n))
        for a, b in sorted(edges):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
        return root
    want = [(a, b) for a in range(n) for b in range(a + 1, n) if link(a, b)]
    assert len(want) > 20 and classes(p for p in got if link(*p)) == classes(want)
    assert len(got) < n * n / 8, (len(got), n)


# 3 the driver's memory

def test_no_plan_of_near_duplicates_is_wide(spark, monkeypatch):
    """Every plan that the driver runs joins a few tables: what it plans, compiles and
    broadcasts at once is bounded, and links are those of brute force."""
    monkeypatch.setattr(near_dup, "SPLIT", 4)
    cut, wide = near_dup.cut_lineage, []

    def counted(df):
        wide.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return cut(df)

    monkeypatch.setattr(near_dup, "cut_lineage", counted)
    rng = np.random.default_rng(22)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    origin = [word() for _ in range(120)]
    texts = [" ".join(origin)]
    for _ in range(60):
        w = list(origin)
        for j in rng.choice(120, rng.integers(1, 14), replace=False):
            w[j] = word()
        texts.append(" ".join(w))
    texts += [" ".join(origin[:120 - n]) for n in range(6, 60, 6)]
    texts += [" ".join([word() for _ in range(20)] + origin[:60]) for _ in range(20)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, texts)).collect()}
    assert len(wide) > 20 and max(wide) <= 6, wide
    sets = [set(near_dup.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert [got[i] for i in range(len(texts))] == root


def test_residual_pairs_of_no_members(spark):
    members = spark.createDataFrame([], "rep long, label long, pivot long")
    pairs, plain = near_dup._residual_pairs(members, docs(spark, ["a b c d e"]).select("doc_id", "text"), 4, 80)
    assert pairs.columns == ["a", "b"] and plain.columns == ["rep", "pivot"] and not pairs.count() + plain.count()
