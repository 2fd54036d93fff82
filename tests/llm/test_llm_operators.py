"""The training-data operators against brute force on small tables: nulls,
empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.llm import (chat_format, decontaminate, lang_backoff, line_dedup, mtree_search, near_dup, packing,
                          pii_bootstrap, quality_nbsvm, shard_tree)

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 4000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


# 1 sharding

def test_growing_takes_rows_only_into_the_new_shard(spark):
    for n in (8, 9, 12):  # below two full regions a new shard joins an old rack
        df = shard_tree.assign_shards(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")),
                                      n_shards=n).toPandas()
        moved = df[df["shard"] != df.grown_shard]
        assert set(moved.grown_shard) <= {n} and len(moved)
        assert set(df["shard"]) == set(range(n))
        for _, g in df.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))


def test_weight_change_moves_only_into_the_changed_subtree(spark):
    base = shard_tree.regular_topology(8)
    heavy = [shard_tree.Shard(s.shard, s.region, s.rack, 3.0 if s.shard == 5 else 1.0) for s in base]
    df = shard_tree.assign_shards(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(None).cast(
        "string").alias("text")), topology=base, grown=heavy).toPandas()
    moved = df[df["shard"] != df.grown_shard]
    assert (df["size"] == 1).all() and (df.text_crc32 == 0).all()
    assert set(moved.grown_shard) <= {4, 5, 6, 7}          # its region alone gains
    other = moved[moved["shard"].isin([6, 7])]
    assert set(other.grown_shard) <= {4, 5}                # and of that region its rack
    assert set(moved[moved["shard"] == 4].grown_shard) <= {5}
    share = (df.grown_shard == 5).mean()
    assert abs(share - 3 / 10) < 0.03


def test_shard_edge_rows(spark):
    df = docs(spark, ["é", None, "", "é", LONG], [1, None, 2, 1, 3]).withColumn("shard", F.lit(9))
    got = shard_tree.assign_shards(df).toPandas()
    assert len(got) == 5
    row = got[got.doc_id == 1].iloc[0]
    assert row["size"] == 3 and row.text_crc32 == zlib.crc32("é".encode())
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert shard_tree.assign_shards(df.limit(0)).count() == 0


# 2 chat

def test_chat_round_trip_and_machine(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "a\\<\\|b<||<\\\\|", "", None, "\n<", "|x", "<|im_end|>\n<|im_start|>"]
    roles = ["user", "assistant", "us\\ner\n\\", None, "<|im_end|>", "system", "assistant"]
    rows = [(7, i, r, t) for i, (r, t) in enumerate(zip(roles, nasty))]
    rows += [(8, None, "user", "q"), (8, 1, "assistant", "a"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = chat_format.format_conversations(df)
    back = out.withColumn("b", chat_format.parse_formatted(F.col("formatted"))).collect()
    by = {r.conv_id: r for r in back}
    assert [(t.role, t.text) for t in by[7].b] == [(r or "", t or "") for r, t in zip(roles, nasty)]
    assert not by[7].valid and by[7].bad_turn == 2
    assert by[8].valid and by[None].valid
    assert by[7].formatted.count("<|im_start|>") == len(roles)
    d = {r.conv_id: r for r in chat_format.chat_digest(df).collect()}
    loss = "".join(t or "" for r, t in zip(roles, nasty) if r == "assistant")
    assert d[7].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and d[7].loss_chars == len(loss)
    assert chat_format.chat_digest(df.limit(0)).count() == 0


# 3 near-duplicates

def brute_components(texts, ids, k=4, percent=80):
    sets, label = {}, {}
    for i, t in zip(ids, texts):
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if w else set()
        label[i] = i

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    order = sorted(sets)
    for a in order:
        for b in order:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.fixture(scope="module")
def family():
    """An origin, copies with more and more changed words, and texts around one passage."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    origin = [word() for _ in range(120)]
    texts = [" ".join(origin)]
    for n in range(150):
        w = list(origin)
        for j in rng.choice(120, rng.integers(1, 14), replace=False):
            w[j] = word()
        texts.append(" ".join(w))
    for n in range(0, 120, 6):
        texts.append(" ".join(origin[:120 - n]))      # pieces of the origin
    passage = origin[:60]
    for _ in range(60):
        own = [word() for _ in range(rng.integers(20, 60))]
        texts.append(" ".join(own[:10] + passage + own[10:]))
    return texts + ["", None, "one two", "ONE  two", "three", " ", texts[5], LONG, LONG + " x"]


def test_near_duplicates_equal_brute_force(spark, family, monkeypatch):
    monkeypatch.setattr(near_dup, "SPLIT", 4)  # every bucket of the family goes the exact way
    rng = np.random.default_rng(4)
    ids = [int(i) for i in rng.permutation(len(family))]
    df = docs(spark, family, ids).withColumn("key", F.lit(0)).withColumn("rep", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_components(family, ids)
    kept = near_dup.drop_near_duplicates(df, words_per_shingle=4)
    want = {c for _, c in brute_components(family, ids).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == df.columns


def test_residual_filters_lose_no_link(spark):
    """Windows, changed copies and mixtures of two pivots: every link is proposed, but
    for members that lie almost wholly within different pivots."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    pivots = [[word() for _ in range(150)] for _ in range(2)]
    pivots[1][40:100] = pivots[0][40:100]  # a passage of both
    texts, at = [list(p) for p in pivots], [0, 1]
    for n in range(160):
        which = n % 2
        w = list(pivots[which])
        if n % 3 == 0:  # a window: holds less of the pivot than it lacks
            lo, size = int(rng.integers(0, 100)), int(rng.integers(12, 50))
            w = w[lo:lo + size]
        else:
            for j in rng.choice(150, rng.integers(3, 18), replace=False):
                w[j] = word() if n % 3 == 1 else f"common{j % 7}"
        texts.append(w)
        at.append(which)
        if n % 4 == 0:  # a near copy of the last one, with words of its own
            texts.append(w[:len(w) * 9 // 10] + [word()])
            at.append(which)
    texts = [" ".join(w) for w in texts]
    df = docs(spark, texts, list(range(len(texts))))
    members = spark.createDataFrame([(i, i, at[i]) for i in range(2, len(texts))], "rep long, label long, pivot long")
    pairs, plain = near_dup._residual_pairs(members, df.select("doc_id", "text"), 4, 80)
    got = {tuple(sorted(p)) for p in pairs.distinct().collect()}
    within = {r.rep for r in plain.collect()}
    sets = [set(near_dup.shingle_set(t).tolist()) for t in texts]

    def links(a, b):
        return 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    far = [i for i in range(2, len(texts)) if not links(i, at[i])]
    want = {(min(a, b), max(a, b)) for a in far for b in range(2, len(texts)) if a != b and links(a, b)
            and (at[a] == at[b] or not {a, b} & within)}
    assert len(want) > 40 and want <= got
    assert any(len(sets[a]) < len(sets[a] ^ sets[at[a]]) for a, _ in want)  # the whole-set filter's kind


def test_near_duplicates_edges(spark):
    df = docs(spark, ["a b c d e", "a b c d e", "a b c d e", "", None, "x"], [5, None, 5, 6, None, 7])
    got = sorted(map(tuple, near_dup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (6, 0, 6, True),
                          (None, 0, None, True), (7, 1, 7, True)], key=str)
    kept = near_dup.drop_near_duplicates(df, words_per_shingle=4).collect()
    assert sorted((r.doc_id is None, r.text or "") for r in kept) == [(False, ""), (False, "a b c d e"), (False, "x"), (True, "")]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_drop_near_duplicates_decides_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    made = [(5, a), (None, a), (None, b), (None, c), (None, c), (None, c + " end"), (None, None), (None, ""),
            (7, b + " end"), (7, d), (7, d), (7, "other words"), (7, "third text"), (8, "third text"), (9, None), (9, None)]
    df = docs(spark, [t for _, t in made], [i for i, _ in made])
    kept = near_dup.drop_near_duplicates(df, words_per_shingle=4)
    want = [(5, a), (7, b + " end"), (7, d), (7, "other words"), (7, "third text"), (9, None), (9, None), (None, c),
            (None, None), (None, "")]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    near = [(i, c if i is None and t == c + " end" else t) for i, t in got]  # either of the two sets of c may stay
    assert sorted(near, key=str) == sorted(want, key=str) and kept.columns == df.columns
    # an id on most rows: clean texts all stay, of equal rows one
    many = [f"text{i} of its own {i * i} words" for i in range(300)]
    hot = docs(spark, many + ["same words in all"] * 50, [1] * 350)
    assert sorted(r.text for r in near_dup.drop_near_duplicates(hot).collect()) == sorted(many + ["same words in all"])


def test_posterior_bounds():
    looks = near_dup.least_matches(80)
    assert looks[-1][0] == near_dup.BANDS * near_dup.ROWS and all(m <= n * 0.8 for n, m in looks)
    assert (1 - 0.8 ** near_dup.ROWS) ** near_dup.BANDS < 1e-6


# 4 quality

def test_quality_equals_brute_force(spark):
    """Counts, ratios, descent and interpolation of a small table, from plain Python."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["good", "fine", "a", "the"] if i % 2 else ["spam", "junk", "a", "the"], 6)), i % 2)
            for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    model = quality_nbsvm.fit_quality(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    f = {i: set(quality_nbsvm.features(t).tolist()) for i, t, _ in rows}
    n = {c: np.full(2 ** quality_nbsvm.BITS, quality_nbsvm.SMOOTH) for c in (0, 1)}
    for i, _, c in rows:
        n[c][list(f[i])] += 1
    ratio = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    assert np.allclose(model.scale, ratio)
    seen = sorted(set().union(*f.values()))
    base = model.weights[seen] / ratio[seen]  # (1 - MIX) * mean|w| + MIX * w
    at0 = np.setdiff1d(np.arange(1000), seen)  # indicators that no row holds have w = 0
    mean = (model.weights[at0] / ratio[at0])[0] / (1 - quality_nbsvm.MIX)
    w = (base - (1 - quality_nbsvm.MIX) * mean) / quality_nbsvm.MIX
    assert np.isclose(np.abs(w).mean(), mean)
    # w minimises the hinge loss over unit rows: no dual coordinate of the fitted rows can still move much
    x = {i: np.where(np.isin(seen, list(v)), ratio[seen], 0) / np.sqrt((ratio[list(v)] ** 2).sum()) for i, v in f.items()}
    margins = np.array([(1 if c else -1) * (x[i] @ w) for i, _, c in rows])
    assert (margins > 0).all() and margins.min() > 0.9
    # a word pair and a word are features; a fresh text of known words is scored by them
    a, b = (set(quality_nbsvm.features(t).tolist()) for t in ("good fine", "good"))
    assert b <= a and len(a - b) >= 2
    assert model.score("good fine good") > 0.5 > model.score("junk spam junk")


def test_quality_learns_and_handles_edges(spark):
    d = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    lab = spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet")
    held = lab.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = quality_nbsvm.fit_quality(d, lab.join(held, "doc_id", "left_anti"))
    test = d.join(held, "doc_id").select("quality", quality_nbsvm.quality_score(d, model).alias("s")).toPandas()
    assert ((test.s >= 0.3) == (test.quality == 1)).mean() >= 0.95
    odd = docs(spark, ["", None, LONG, "!!"]).withColumn("score", F.lit("x"))
    s = [r.s for r in odd.select(quality_nbsvm.quality_score(odd, model).alias("s")).collect()]
    assert all(0 <= x <= 1 for x in s) and s[0] == s[1]
    one = spark.createDataFrame([(0, 1), (1, None), (2, 7)], "doc_id long, quality int")
    assert quality_nbsvm.fit_quality(odd, one).score("a") == 1.0
    assert quality_nbsvm.fit_quality(odd, one.limit(0)).score("a") == 0.5


# 5 packing

def tokenizer_path():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


def test_tokenizer_equals_the_library(spark):
    tok = packing.tokenizer_of(tokenizer_path())
    texts = ["Ünïcodé ΣΑΣ <|endoftext|>s a\x1cb 12345 don't it's O'Neill l'été n'est ªº ²½", "İstanbul ﬁ ǅ ŉ ſ",
             "x\u0085y\xa0z \xad", "a\x00b\x7f tab\tq", "日本語 한국어 😀👍🏽 é", "<|startoftext|>", "</w> x</w>", "", None, LONG]
    texts += [r.text for r in spark.read.parquet(SF + "/documents.parquet").select("text").collect()]
    for t in texts:
        assert tok.ids(t).tolist() == (tok.tokenizer.encode(t, add_special_tokens=False).ids if t else [])


def test_packing_is_whole_and_tight(spark):
    path = tokenizer_path()
    base = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(None, "x"), (-1, None), (-2, ""), (-3, LONG), (-4, "a b"), (-4, "a b")], base.schema)
    df = base.unionByName(more).withColumn("block", F.lit(3))
    got = packing.pack_documents(df, path).toPandas()
    tok = packing.tokenizer_of(path)
    want = sorted(len(tok.ids(r.text)) + 1 for r in df.collect())
    assert sorted(got.groupby(["doc_id", "piece"], dropna=False).length.sum())[-1] <= 2 * 2048
    assert got.length.sum() == sum(want)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.r_[0, s.length.cumsum()[:-1]]).all() and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2
    long = got[got.doc_id == -3].sort_values("piece")
    ids = np.append(tok.ids(LONG), 0).astype("<u4")
    assert list(long.ids_crc32) == [zlib.crc32(ids[s:s + 2048].tobytes()) for s in range(0, len(ids), 2048)]
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_local_search_beats_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = rng.integers(1, 101, 200).tolist()
        plain, better = packing.pack(sizes, 100, rounds=0), packing.pack(sizes, 100)
        assert sorted(i for b in better for i in b) == list(range(200))
        assert all(sum(sizes[i] for i in b) <= 100 for b in better)
        assert -(-sum(sizes) // 100) <= len(better) <= len(plain)


# 6 decontamination

def test_decontamination(spark):
    items = spark.read.parquet(SF + "/benchmark.parquet")
    text = {r.item_id: r.text for r in items.collect()}
    ids = sorted(text)
    filler = " ".join(f"w{i}" for i in range(400))
    made = [filler + " " + text[ids[0]] + " " + filler, text[ids[1]].upper().replace(" ", "\n"), filler, "", None,
            " ".join(text[ids[2]].split()[:len(text[ids[2]].split()) // 2]), LONG, text[ids[3]], text[ids[3]]]
    df = docs(spark, made).withColumn("item_id", F.lit(0))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(spark, df, items).collect()}
    assert got == {(0, ids[0]), (1, ids[1]), (7, ids[3]), (8, ids[3])}
    left = decontaminate.drop_contaminated(spark, df, items)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 6] and left.columns == df.columns
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "?!")], "item_id long, text string")
    assert decontaminate.contaminated_pairs(spark, df, odd).count() == 0
    assert decontaminate.contaminated_pairs(spark, df.limit(0), items).count() == 0


def test_question_or_whole_decides(spark):
    """The full question with no or another answer is found; a short question or an answer alone is not."""
    q = "Which of the many rivers that run to the northern sea is the longest one of all of them?"
    items = spark.createDataFrame([(1, f"{q} It is the one that the old maps call the grey river."),
                                   (2, "Who wrote it? Nobody can tell for sure who wrote that long and old book of tales.")],
                                  "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(200))
    made = [f"{filler} {q} {filler}", f"{q} Nobody knows.", f"{filler} It is the one that the old maps call the grey river. {filler}",
            f"{filler} who wrote it {filler}", f"{q} It is the one that the old maps call the grey river."]
    got = {(r.doc_id, r.item_id): (round(r.overlap, 2), r.question_overlap, r.answer_overlap)
           for r in decontaminate.contaminated_pairs(spark, docs(spark, made), items).collect()}
    assert set(got) == {(0, 1), (1, 1), (4, 1)}
    assert got[0, 1][1:] == (1.0, 0.0) and got[4, 1] == (1.0, 1.0, 1.0) and got[0, 1][0] < 0.8
    assert [r.doc_id for r in decontaminate.drop_contaminated(spark, docs(spark, made), items).collect()] == [2, 3]


def test_shards_and_bound_slices_change_nothing(spark, monkeypatch):
    items = spark.read.parquet(SF + "/benchmark.parquet")
    df = spark.read.parquet(SF + "/documents.parquet")
    want = sorted(map(tuple, decontaminate.contaminated_pairs(spark, df, items).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 4000)
    monkeypatch.setattr(decontaminate, "BOUNDS", 50)
    got = sorted(map(tuple, decontaminate.contaminated_pairs(spark, df, items).select("doc_id", "item_id").collect()))
    assert got == want and want


def test_wand_finds_what_scoring_all_finds():
    rng = np.random.default_rng(6)
    vocab = [f"t{i}" for i in range(60)]
    items = []
    for i in range(90):
        terms = rng.choice(vocab, rng.integers(5, 15), replace=False).tolist()
        items.append((i, " ".join(terms), terms, rng.uniform(0.2, 3, len(terms)).tolist()))
    index = decontaminate.IndexShard(items)
    for _ in range(200):
        q = sorted({index.vocabulary[t] for t in rng.choice(vocab, 25)} - {-1})
        score = {}
        for t in q:
            for i, w in zip(index.items[t], index.impact[t]):
                score[i] = score.get(i, 0) + w
        want = {i for i, s in score.items() if s >= 1 - 1e-9}
        assert {i for i, _ in index.search(q, list(range(index.n_blocks)))} == want


def test_items_of_few_words_and_many_shingles(spark):
    rng = np.random.default_rng(61)
    two = " ".join(rng.choice(["yes", "no"], 60))
    grid = " ".join(map(str, rng.integers(0, 10, 120)))
    assert len(decontaminate.shingles(two.split())) >= 10 and len(decontaminate.shingles(grid.split())) >= 50
    items = spark.createDataFrame([(1, two), (2, grid), (3, "yes the sky is blue today")], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(300))
    made = [f"{filler} {two} {filler}", f"{filler} {grid}", " ".join(two.split()[:50]), " ".join(grid.split()[:110]),
            " ".join(grid.split()[:60]), "yes yes yes yes yes no", filler, None]
    made += [" ".join(rng.choice(["yes", "no"], n)) for n in (20, 60, 100, 120)]
    whole = {r.item_id: decontaminate.shingles(r.text.split()) for r in items.collect()}
    want = {(d, i) for d, t in enumerate(made) for i, s in whole.items()
            if len(s & decontaminate.shingles((t or "").split())) >= 0.8 * len(s)}
    assert {(0, 1), (1, 2), (3, 2)} <= want and (4, 2) not in want
    df = docs(spark, made)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(spark, df, items).collect()} == want
    left = {r.doc_id for r in decontaminate.drop_contaminated(spark, df, items).collect()}
    assert left == set(range(len(made))) - {d for d, _ in want}


# 7 personal data

def base_spans(t):
    def luhn(d):
        s = [int(c) for c in reversed(d)]
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(s)) % 10 == 0
    out = [(m.start(), 0, "email", m.end())
           for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for kind, no, pattern, lo, hi in (("card", 2, r"[0-9]([\x20-]?[0-9])+", 12, 19),
                                      ("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if lo <= len(d) <= hi and (no == 3 or luhn(d)):
                out.append((m.start(), no, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_personal_data_base_spans(spark):
    texts = ["a.@b.c d@e.f_g@h.i..j@k.l x@y a@b.c.d-e.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255",
             "4111 1111-1111 1111 4111  1111 4111111111111111-", "+1 (734) 555-6564 +12 ++49 30 1234567 (",
             "é𝒳😀 mail me: é@x.y 😀 a@b.co", "1" * 30000, "a" * 30000 + "@" + "b." * 9000, "- " * 9000, None, "",
             "1 " * 9000, "_-" * 9000]
    texts += [r.text for r in spark.read.parquet(SF + "/documents.parquet").select("text").collect()]
    df = docs(spark, texts).withColumn("base", F.lit(1)).withColumn("h", F.lit(2))
    got = {r.doc_id: r for r in pii_bootstrap.personal_data_digest(df).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert got[i].n_email == want.count("email:") and got[i].n_phone == want.count("phone:")
    assert pii_bootstrap.personal_data_digest(df.limit(0)).count() == 0


def test_bootstrap_finds_unseen_identifiers(spark):
    seeds = [f"alpha beta contact me{i}@mail{i}.org today w{i}" for i in range(20)]
    new = ["alpha beta contact zq81-77xk-0042 today w", "plain words zq81-77xk-0099 there", "no numbers at all"]
    got = {r.doc_id: r.spans for r in pii_bootstrap.personal_data_digest(docs(spark, seeds + new)).collect()}
    at = new[0].index("zq81")
    assert got[20] == f"id:{at}:{at + 14}" and got[21] == "" and got[22] == ""
    assert all(got[i].startswith("email:") for i in range(20))


# 8 top-k

def brute_top(rows, k):
    rows = {(i, tuple(np.floor(64 * np.array(v, np.float32).astype(float)).astype(int))) for i, v in rows
            if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    dim = max((len(v) for _, v in rows), default=0)
    rows = sorted((i, v + (0,) * (dim - len(v))) for i, v in rows)
    out = []
    for q, x in rows:
        if q % 2 == 0:
            best = sorted((-int(np.dot(x, v)), i) for i, v in rows if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("page, tree", [(4, 1000), (4, 40), (128, 16000)])
def test_mtree_equals_brute_force(spark, monkeypatch, page, tree):
    monkeypatch.setattr(mtree_search, "PAGE", page)
    monkeypatch.setattr(mtree_search, "TREE_ROWS", tree)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]                      # equal vectors, ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8),
             (306, [2.0, 1.0]), (308, []), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("rank", F.lit(2))
    got = mtree_search.top_k(df, lambda v: v % 2 == 0, k=5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)
    assert mtree_search.top_k(df.limit(0), lambda v: v % 2 == 0).count() == 0


# 9 language

def test_language(spark):
    d = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    held = F.col("doc_id") % 5 == 0
    model = lang_backoff.fit_languages(d.filter(~held))
    test = d.filter(held).select("lang", lang_backoff.predict_languages(d, model).alias("p")).select("lang", "p.*").toPandas()
    assert (test.lang == test.lang_pred).mean() > 0.97 and test.score.between(0, 1).all()
    odd = docs(spark, [None, "", "123 ?!", "½ ²", "the of and that in", LONG, "qqqzzz"]).withColumn("p", F.lit(1))
    got = [tuple(r.x) for r in odd.select(lang_backoff.predict_languages(odd, model).alias("x")).collect()]
    assert [g[0] for g in got[:4]] == ["und"] * 4 and got[4][0] == "en" and got[6][0] in model.langs
    none = lang_backoff.fit_languages(odd.withColumn("lang", F.lit(None).cast("string")))
    assert none.predict(["text"]) == [("und", 0.0)]
    # words first: a known word's own frequency; an unseen word backs off
    assert model.find(0, ["the", "thezzqx"])[0].tolist() == [True, False]
    known, got = model.resolve(["the", "thezzqx"])
    assert known.tolist() == [True, False] and (got[0] == model.find(0, ["the"])[1]).all()
    assert np.allclose(got[1], model.find(3, lang_backoff.grams("thezzqx", 3))[1].mean(axis=0), atol=1e-5)


def language_rows(seed=9, n=(300, 8)):
    rng = np.random.default_rng(seed)
    pool = {x: ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(m)] for x, m in (("aa", 200), ("bb", 60))}
    rows = [(x, " ".join(rng.choice(pool[x], 30))) for x, m in zip(pool, n) for _ in range(m)]
    return rows + rows[-3:] + [("bb", "zwei zwei"), ("bb", "\u6f22\u5b57" * 300), ("cc", "12 34"), ("bb", None)]


def test_language_counts_equal_brute_force(spark):
    rows = language_rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(5)
    model = lang_backoff.fit_languages(df)
    assert model.langs == ["aa", "bb", "cc"] and model.rare is None
    for kind in range(4):
        seen = {}
        for x, t in rows:
            for w in lang_backoff.words(t):
                for g in [w] if kind == 0 else lang_backoff.grams(w, kind):
                    seen.setdefault(g, dict.fromkeys(model.langs, 0))[x] += 1
        total = [sum(c[x] for c in seen.values()) for x in model.langs]
        known = {g: c for g, c in seen.items() if kind or sum(c.values()) >= lang_backoff.MIN_COUNT}
        assert len(model.known[kind][0]) == len(known)
        hit, got = model.find(kind, list(known))
        assert hit.all()
        for c, e in zip(known.values(), got):
            want = [np.log((c[x] - 0.5) / t) if c[x] else np.log(0.25 / max(total)) for x, t in zip(model.langs, total)]
            assert np.allclose(e, want, atol=1e-5)


def test_language_joins_what_is_not_broadcast(spark, monkeypatch):
    """Words and n-grams beyond the broadcast, by joins, give what the whole model in memory gives."""
    rows = language_rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(5)
    whole = lang_backoff.fit_languages(df)
    probe = df.union(spark.createDataFrame([(-1, "", "hhhhq abcde zwei"), (-2, "", " "), (-3, "", "qabx hgf z")], df.schema))
    for room in (40, 150):
        monkeypatch.setattr(lang_backoff, "SENT_BYTES", 2 * room * (8 + 4 * 3))
        model = lang_backoff.fit_languages(df)
        assert sum(len(model.known[k][0]) for k in (1, 2, 3)) == room and len(model.known[0][0]) == room
        with pytest.raises(ValueError):
            lang_backoff.predict_languages(probe, model)
        out = lang_backoff.with_languages(probe, model, "p")
        assert out.columns == [*probe.columns, "p"]
        got = {r.doc_id: (r.text, *r.p) for r in out.collect()}
        assert len(got) == len(rows) + 3 == out.count()
        for t, lang, score in got.values():
            want = whole.predict([t])[0]
            assert lang == want[0] and abs(score - want[1]) < 1e-4
    assert all(got[i][1] == x for i, (x, t) in enumerate(rows) if x != "cc" and t)


def test_language_is_not_drawn_to_small_languages(spark):
    """100 to 1: texts of the large language's rarer words stay its own; the small one is still found."""
    rng = np.random.default_rng(99)
    pool = {x: ["".join(rng.choice(list("abcdefghijk"), 6)) for _ in range(3000)] for x in ("aa", "bb")}
    p = 1 / np.arange(1, 3001)
    rows = [(x, " ".join(rng.choice(pool[x], 40, p=p / p.sum()))) for x, n in (("aa", 4000), ("bb", 40)) for _ in range(n)]
    model = lang_backoff.fit_languages(spark.createDataFrame(rows, "lang string, text string"))
    seen = {w for x, t in rows if x == "aa" for w in t.split()}
    rare = [w for w in pool["aa"][1500:] if w in seen and model.find(0, [w])[0][0]]
    large = [" ".join(rng.choice(rare, 6)) for _ in range(400)]
    small = [" ".join(rng.choice(pool["bb"], 6, p=p / p.sum())) for _ in range(400)]
    assert sum(x == "aa" for x, _ in model.predict(large)) >= 398
    assert sum(x == "bb" for x, _ in model.predict(small)) >= 390


# 10 lines

def brute_lines(rows):
    """rows: (doc_id, text), ids distinct and ascending."""
    wins, first, gone = [], {}, {}
    for d, t in rows:
        ls = [(i, x.strip(" ")) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")]
        wins += [(d, ls[j][0], ls[j + 2][0], (ls[j][1], ls[j + 1][1], ls[j + 2][1])) for j in range(len(ls) - 2)]
    for d, a, b, w in sorted(wins):
        if w not in first:
            first[w] = (d, b)
        else:
            fd, fb = first[w]
            gone.setdefault(d, set()).update(range(max(a, fb + 1) if d == fd else a, b + 1))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))
            for d, t in rows}


def test_line_dedup(spark):
    rng = np.random.default_rng(10)
    texts = ["\n".join(rng.choice(["a", "b", " c ", "", "d"], rng.integers(0, 14))) for _ in range(60)]
    texts += ["A\nA\nA\nA\nA\nA", None, "", "\n\n\n\n", "x\ny", "\n".join(f"l{i}" for i in range(3000)) + "\na\nb"]
    df = docs(spark, texts).withColumn("n_removed", F.lit("own")).withColumn("lines", F.lit(0))
    out = line_dedup.dedup_lines(df)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == brute_lines(list(enumerate(texts)))
    assert out.columns[:len(df.columns)] == df.columns and out.columns[-1] == "_n_removed"
    same = docs(spark, ["a\nb\nc", "a\nb\nc", "q\na\nb\nc"], [1, 1, None])
    assert sorted(str(r.text) for r in line_dedup.dedup_lines(same).collect()) == ["a\nb\nc", "a\nb\nc", "q"]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_strong_shapes_are_seeds_of_their_contexts(spark):
    rng = np.random.default_rng(7)
    secret = ["".join(rng.choice(list("0123456789abcdef"), 40)) + "0a" for _ in range(12)]
    texts = [f"word{i % 3}x and token = \"{s}\" then" for i, s in enumerate(secret)]
    texts += ["here TOKEN = \"ab12cd34ef56\" too",        # a weaker one in the same place
              f"hash {secret[0][::-1]} alone",           # a strong one in no such place
              'my token = "none" at all', 'token = "12345678901234567"', "release 2024-01-02 of 10-20-3000"]
    got = {r.doc_id: (r.spans, r.n_found) for r in pii_bootstrap.personal_data_digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts[:13]):
        at = t.index('"') + 1
        assert got[i] == (f"id:{at}:{t.index(chr(34), at)}", 1)
    assert all(got[i] == ("", 0) for i in range(13, len(texts)))
