"""The registered queries of the training-data operators: oracles, plans, pipeline."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from flowsift.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    from check_oracle import compare, duck
    r = compare(spark, duck(SF), name, SF)
    assert r["ok"], r


@pytest.mark.parametrize("name", ["op1_shard_tree", "op2_chat_format", "op7_contextual_pii", "op10_line_dedup"])
def test_plans_without_python(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_every_operator_is_registered():
    names = E.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark, tmp_path):
    base = spark.read.parquet(SF + "/documents.parquet")
    n = base.agg(F.max("doc_id")).first()[0]
    text = {r.doc_id: r.text for r in base.collect()}
    leak = spark.read.parquet(SF + "/benchmark.parquet").first().text
    words = "the of and that in thing other when with from have this not are was which".split()
    clean = " ".join(words[(i * 7 + i * i) % 16] + str(i % 3) * 0 for i in range(80))
    extra = [(n + 1, "12 34 ?!", "en", "s", 8), (n + 2, None, "en", "s", 0), (n + 3, clean, "en", "s", len(clean)),
             (n + 4, clean + " the", "en", "s", len(clean) + 4), (n + 5, "and the " + leak + " of", "en", "s", 0)]
    docs = base.unionByName(spark.createDataFrame(extra, base.schema)).withColumn("_language", F.lit(1))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "packing"]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        got = stage(spark, docs, SF)
        if k < 4:
            assert got.columns == docs.columns
        got.write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not {n + 1, n + 2} & seen["language"] and set(text) <= seen["language"]
    assert {n + 3, n + 4} <= seen["lines"]
    assert n + 3 in seen["near_duplicates"] and n + 4 not in seen["near_duplicates"]
    assert n + 5 in seen["near_duplicates"] and n + 5 not in seen["decontamination"]
    assert seen["packing"] == seen["decontamination"]


def brute_near_duplicates(rows, k=5):
    """The ids that stay: the smallest of each component of 80 % similar shingle sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i for i in ids if root(i) == i}


def brute_clean(rows, items):
    """The ids whose texts hold no item: not 80 % of its shingles nor of its question's, if that has eight."""
    from flowsift.llm.decontaminate import question_and_answer, shingles, words
    parts = []
    for t in items:
        whole, q = shingles(words(t)), shingles(words(question_and_answer(t)[0]))
        parts += [(whole, min(5, len(words(t))))] + ([(q, 5)] if len(q) >= 8 else [])
    return {i for i, t in rows if not any(
        p and len(p & shingles(words(t), k)) >= 0.8 * len(p) for p, k in parts)}


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage's whole output, and run()'s, against plain Python versions of their rules."""
    import zlib

    import numpy as np
    from test_llm_operators import brute_lines
    from tokenizers import Tokenizer
    from flowsift.llm import lang_backoff
    base = spark.read.parquet(SF + "/documents.parquet")
    items = [r.text for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    text = {r.doc_id: r.text for r in base.collect()}
    n = max(text)
    lines = "\n".join(f"the line {i} of that and with" for i in range(4))
    first = next(t for t in text.values() if t and len(t.split()) > 100)
    extra = [(n + 1, "12 34 ?!", "en", "s", 8), (n + 2, None, "en", "s", 0), (n + 3, first, "en", "s", len(first)),
             (n + 4, first + " the", "en", "s", len(first) + 4), (n + 5, "and the " + items[0] + " of", "en", "s", 0),
             (n + 6, lines, "en", "s", len(lines)), (n + 7, "when they\n" + lines, "en", "s", len(lines) + 10)]
    (tmp_path / "sf").mkdir()
    base.unionByName(spark.createDataFrame(extra, base.schema)).repartition(3).write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.read.parquet(SF + "/benchmark.parquet").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    sf, docs = str(tmp_path / "sf"), spark.read.parquet(str(tmp_path / "sf/documents.parquet"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.text is not None) + [(n + 2, None)]
    # language: what the model, learned from the stage's own rows, is sure of
    model = lang_backoff.fit_languages(docs)
    said = model.predict([t for _, t in rows])
    rows = sorted((i, t) for (i, t), (lang, score) in zip(rows, said) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE)
    want = [dict(rows)]
    # lines: repeated windows of three go, and documents of nothing else with them
    left = brute_lines(rows)
    rows = [(i, left[i]) for i, t in rows if left[i] == t or left[i].strip()]
    want.append(dict(rows))
    kept = brute_near_duplicates(rows)
    rows = [(i, t) for i, t in rows if i in kept]
    want.append(dict(rows))
    clean = brute_clean(rows, items)
    rows = [(i, t) for i, t in rows if i in clean]
    want.append(dict(rows))
    assert len(want[0]) > len(want[1]) or any(want[0][i] != t for i, t in want[1].items())
    assert len(want[1]) > len(want[2]) > len(want[3]) and {n + 1, n + 2}.isdisjoint(want[0])
    tok = Tokenizer.from_file(queries.tokenizer_file())
    pieces = set()
    for i, t in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s:s + 2048], "<u4")
            pieces.add((i, p, s, len(part), zlib.crc32(part.tobytes())))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = [(r.doc_id, r.text) for r in docs.collect()]
        assert dict(got) == want[k] and len(got) == len(want[k]), name
    for out in (corpus_pipeline.STAGES[-1][1](spark, docs, sf), corpus_pipeline.run(spark, sf)):
        got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.collect()]
        assert set(got) == pieces and len(got) == len(pieces)
