"""Language identification, words first with backoff to character n-grams.

Learning counts, for every language, all words (lower-cased runs of letters)
and all character n-grams of words up to MAX_GRAM characters (the word's ends
marked) over every learning text: partial counts per partition, summed by
Spark. The model keeps every word seen MIN_COUNT times or more and every
n-gram, as log frequencies. The most frequent words and n-grams, SENT_BYTES of
them whatever the number of languages and scripts, are broadcast as sorted
hashes and one matrix; the others stay tables, which are joined to the words
that texts hold beyond the broadcast ones (``with_languages``).

A word or n-gram seen c times among the T of a language counts there as
(c - DISCOUNT) / T. Where it was never seen it counts as UNSEEN / T of the
largest language, the same for all: so no language gains from being small.

A text's words are scored one by one: a known word by its log frequency in each
language; another word by the mean log frequency of its known n-grams of
MAX_GRAM characters, or, if it has none, of one character less, and so on. The
language with the highest sum wins (ties: the first by name); the score is its
posterior from the mean word's evidence, counted for at most CONFIDENT words.

Nulls and ties: a null text or one without a letter is ``und`` with score 0;
rows of null lang teach nothing; repeated rows count each; a language whose
rows hold no letter is never preferred; with no learning row at all every text
is ``und``. Words of any length are counted and scored whole. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.llm.base import fresh, quoted
from flowsift.session import cut_lineage, maybe_broadcast

MAX_GRAM = 3
SENT_BYTES = 64 << 20  # of the words and n-grams that are broadcast, half each; the others are joined
MIN_COUNT = 2          # a known word was seen so often at least
CONFIDENT = 20
DISCOUNT = 0.5
UNSEEN = 0.25
UNDETERMINED = "und"
FLUSH = 150_000        # (language, word) counts that a task holds at once
FLUSH_CHARS = 32 << 20
CHUNK_CHARS = 4 << 20  # of the texts whose words are looked up together

WORD = re.compile(r"[^\W\d_]+")
PREDICTED = "lang_pred string, score double"


def words(text: str | None) -> list[str]:
    ws = WORD.findall(text.lower()) if text else []
    # fractions and raised digits pass for letters in the pattern
    return ws if ws and any(c.isalpha() for c in text) else []


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def _count(batches):
    """(lang, kind, key, n) of whole partitions: kind 0 words, 3 trigrams, -1 all words."""
    by_lang: dict[str, Counter] = {}
    chars = 0

    def flush():
        rows = []
        for lang, counts in by_lang.items():
            three: dict[str, int] = {}
            for w, c in counts.items():
                s = f"^{w}$"
                for i in range(len(s) - 2):
                    g = s[i:i + 3]
                    three[g] = three.get(g, 0) + c
            for kind, part in ((0, counts), (3, three), (-1, {"": counts.total()})):
                rows.append(pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([kind] * len(part), pa.int32()),
                     pa.array(part.keys(), pa.string()), pa.array(part.values(), pa.int64())],
                    names=["lang", "kind", "key", "n"]))
        by_lang.clear()
        return rows

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            by_lang.setdefault(lang, Counter()).update(words(t := text.as_py()))
            chars += len(t)
            if chars >= FLUSH_CHARS or sum(map(len, by_lang.values())) >= FLUSH:
                yield from flush()
                chars = 0
    yield from flush()


def _hashes(ws: list[str]) -> np.ndarray:
    """The same numbers that Spark's xxhash64 gives."""
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in ws), np.uint64, len(ws))


def _packed(codes: np.ndarray, n: int) -> np.ndarray:
    """The code points of every n-gram of a row of code points, in one number each."""
    last = max(0, len(codes) - n + 1)
    key = codes[:last].astype(np.uint64)
    for k in range(1, n):
        key = (key << np.uint64(21)) | codes[k:last + k]
    return key


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class LanguageModel:
    """langs; known: sorted keys and log frequencies by kind (0: hashes of words, n:
    n-grams as numbers); rare: (kind, key, e) of those beyond them, or None."""

    def __init__(self, langs: list[str], rare: DataFrame | None = None):
        self.langs, self.rare = langs, rare
        empty = np.empty(0, np.uint64), np.empty((0, len(langs)), np.float32)
        self.known = [empty] * (MAX_GRAM + 1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rare": None}  # workers have no tables

    def learn(self, kind: int, keys: np.ndarray, evidence: np.ndarray) -> None:
        """Put keys and their log frequencies by language among the known ones."""
        order = np.argsort(keys)
        self.known[kind] = keys[order], evidence[order]

    def _find(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys are known, where those are)."""
        have = self.known[kind][0]
        at = np.searchsorted(have, keys)
        hit = at < len(have)
        hit[hit] = have[at[hit]] == keys[hit]
        return hit, at[hit]

    def find(self, kind: int, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words or n-grams are known, log frequencies of those)."""
        numbers = _hashes(keys) if kind == 0 else np.array([_packed(_codes(k), kind)[0] for k in keys], np.uint64)
        hit, at = self._find(kind, numbers)
        return hit, self.known[kind][1][at]

    def resolve(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(which words are known, the evidence of every word by language)."""
        out = np.zeros((len(ws), len(self.langs)), np.float32)
        hit, at = self._find(0, _hashes(ws))
        out[hit] = self.known[0][1][at]
        rest = np.flatnonzero(~hit)
        if len(rest):
            out[rest] = self.by_grams([ws[i] for i in rest])
        return hit, out

    def by_grams(self, ws: list[str]) -> np.ndarray:
        """The mean log frequencies of each word's longest known n-grams."""
        codes = _codes("".join([f"^{w}$" for w in ws]))
        of_word = np.repeat(np.arange(len(ws)), [len(w) + 2 for w in ws])
        out, todo = np.zeros((len(ws), len(self.langs)), np.float32), np.ones(len(ws), bool)
        for n in range(MAX_GRAM, 0, -1):
            of = of_word[:len(codes) - n + 1]
            own = (of == of_word[n - 1:]) & todo[of]
            of, key = of[own], _packed(codes, n)[own]
            hit, at = self._find(n, key)
            of, found = of[hit], self.known[n][1][at]
            count = np.bincount(of, minlength=len(ws))
            got = count > 0
            for j in range(len(self.langs)):
                out[got, j] = np.bincount(of, found[:, j], len(ws))[got] / count[got]
            todo &= ~got
            if not todo.any():
                break
        return out

    def word_with(self, w: str, more: dict[tuple[int, str], list[float]]) -> np.ndarray:
        """The evidence of an unknown word; more: n-grams that aren't broadcast."""
        for n in range(MAX_GRAM, 0, -1):
            gs = grams(w, n)
            hit, got = self.find(n, gs)
            rest = [more[n, g] for g, known in zip(gs, hit) if not known and (n, g) in more]
            if len(got) or rest:
                return np.concatenate([got, np.array(rest, np.float32).reshape(-1, len(self.langs))]).mean(axis=0, dtype=np.float64)
        return np.zeros(len(self.langs))

    def chunks(self, texts):
        """For some texts at a time: (number of texts, their distinct words, all words'
        numbers one after another, words of each text)."""
        numbers: dict[str, int] = {}
        parts, chars = [], 0
        for t in texts:
            ws = words(t) if self.langs else []
            parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int64, len(ws)))
            chars += len(t or "")
            if chars >= CHUNK_CHARS:
                yield len(parts), list(numbers), np.concatenate(parts), np.array([len(p) for p in parts])
                numbers, parts, chars = {}, [], 0
        if parts:
            yield len(parts), list(numbers), np.concatenate(parts), np.array([len(p) for p in parts])

    def sums(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The evidence of each text's words by language, and the number of words."""
        out, counts = [np.empty((0, len(self.langs)))], [np.empty(0, np.int64)]
        for n, own, at, sizes in self.chunks(texts):
            e = self.resolve(own)[1]
            text = np.repeat(np.arange(n), sizes)
            out.append(np.stack([np.bincount(text, e[at, j], n) for j in range(len(self.langs))], axis=1)
                       if self.langs else np.empty((n, 0)))
            counts.append(sizes)
        return np.concatenate(out), np.concatenate(counts)

    def best(self, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and their posteriors from the evidence of ``n`` words each."""
        if not self.langs:
            return np.full(len(n), UNDETERMINED, object), np.zeros(len(n))
        top = s.argmax(axis=1)
        share = np.minimum(n, CONFIDENT) / np.maximum(n, 1)
        p = np.exp((s - s[np.arange(len(s)), top][:, None]) * share[:, None])
        lang = np.array(self.langs, object)[top]
        return np.where(n > 0, lang, UNDETERMINED), np.where(n > 0, 1 / p.sum(axis=1), 0.0)

    def predict(self, texts) -> list[tuple[str, float]]:
        return [(str(x), float(y)) for x, y in zip(*self.best(*self.sums(texts)))]


def fit_languages(df: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from all rows of ``df`` with a language and a text."""
    body = df.select(quoted(lang).cast("string").alias("lang"), quoted(text).alias("text")).filter(
        "lang is not null and text is not null")
    counts = (body.mapInArrow(_count, "lang string, kind int, key string, n long")
              .groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
              .groupBy("kind", "key").agg(F.sum("n").alias("n"), F.map_from_entries(
                  F.collect_list(F.struct("lang", "n"))).alias("by_lang")))
    counts = cut_lineage(counts.filter((F.col("kind") != 0) | (F.col("n") >= MIN_COUNT)))
    grams3 = counts.filter("kind = 3").select("key", F.explode("by_lang").alias("lang", "n"))
    # the shorter n-grams: the first letters of each trigram, and of a word's last one also what follows
    key, last = F.col("key"), F.col("key").endswith("$")

    def cut(n: int, at: int) -> Column:
        return F.struct(F.lit(n).alias("kind"), F.substring(key, at, n).alias("key"))

    part = F.concat(F.array(cut(3, 1), cut(2, 1), cut(1, 1)),
                    F.when(last, F.array(cut(2, 2), cut(1, 2), cut(1, 3))).otherwise(F.array().cast(
                        "array<struct<kind:int,key:string>>")))
    short = (grams3.select(F.explode(part).alias("p"), "lang", "n").groupBy("p.kind", "p.key", "lang")
             .agg(F.sum("n").alias("n")).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.map_from_entries(
                 F.collect_list(F.struct("lang", "n"))).alias("by_lang")))
    short = cut_lineage(short)
    sums = (counts.filter("kind = -1").select(F.lit(0).alias("kind"), F.explode("by_lang").alias("lang", "n"))
            .unionByName(short.select("kind", F.explode("by_lang").alias("lang", "n")))
            .groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect())
    langs = sorted({r.lang for r in sums})
    totals = {k: [sum(r.n for r in sums if r.kind == k and r.lang == x) for x in langs] for k in range(MAX_GRAM + 1)}
    known = counts.filter("kind = 0").select("kind", "key", "n", "by_lang")
    model, rare = LanguageModel(langs), None
    if not langs:
        return model
    room = max(1, SENT_BYTES // 2 // (8 + 4 * len(langs)))
    for part in (known, short):
        if part.count() > room:  # those after the last one that is broadcast
            last = part.orderBy(F.desc("n"), "kind", "key").select("n", "kind", "key").offset(room - 1).first()
            n, kind, key = F.col("n"), F.col("kind"), F.col("key")
            here = (n > last.n) | ((n == last.n) & ((kind < last.kind) | ((kind == last.kind) & (key <= last.key))))
            rest = part.filter(~here).select("kind", "key", _evidence(totals, langs))
            rare = rest if rare is None else rare.unionByName(rest)
            part = part.filter(here)
        of_words = part.filter("kind = 0").select("kind", F.xxhash64("key").alias("key"), _evidence(totals, langs))
        of_grams = part.filter("kind > 0").select("kind", "key", _evidence(totals, langs))
        for rows in (of_words.toArrow(), of_grams.toArrow()):  # ``room`` rows at most
            kinds, e = rows.column("kind").to_numpy(), rows.column("e").combine_chunks().flatten().to_numpy()
            keys = rows.column("key")
            for kind in np.unique(kinds).tolist():
                here = np.flatnonzero(kinds == kind)
                number = (keys.to_numpy().view(np.uint64) if kind == 0 else np.array(
                    [_packed(_codes(k), kind)[0] for k in keys.take(here).to_pylist()], np.uint64))
                model.learn(kind, number, e.reshape(-1, len(langs))[here])
    model.rare = rare
    return model


def _evidence(totals: dict[int, list[int]], langs: list[str]) -> Column:
    """Log frequencies by language (array of floats) of a row (kind, by_lang)."""
    def of(kind: int, j: int) -> Column:
        c, t = F.col("by_lang")[langs[j]], totals[kind]
        seen = F.log(F.greatest(c - DISCOUNT, F.lit(DISCOUNT))) - math.log(max(1, t[j]))
        return F.coalesce(F.when(c > 0, seen), F.lit(math.log(UNSEEN / max(1, *t))))

    kinds = [F.array(*[of(k, j) for j in range(len(langs))]).cast("array<float>") for k in range(MAX_GRAM + 1)]
    return F.get(F.array(*kinds), F.col("kind")).alias("e")


def predict_languages(df: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """Struct (lang_pred, score) of each row's text, for a model that is broadcast
    whole; ``with_languages`` is the form for any model."""
    if model.rare is not None:
        raise ValueError("the model has words beyond its broadcast: use with_languages")
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTED)
    def predicted(batch):
        import pandas as pd
        m = sent.value
        return pd.DataFrame(dict(zip(("lang_pred", "score"), m.best(*m.sums(batch)))))

    return predicted(quoted(text))


def with_languages(df: DataFrame, model: LanguageModel, name: str, text: str = "text") -> DataFrame:
    """``df`` and the column ``name``: struct (lang_pred, score) of each row's text.

    Words beyond the broadcast ones are scored by backoff to broadcast n-grams
    first. What the joined words and n-grams change in that is looked up once a
    word, summed by the text's digest and added before languages are compared."""
    if model.rare is None:
        return df.withColumn(name, predict_languages(df, model, text))
    sent, size = df.sparkSession.sparkContext.broadcast(model), len(model.langs)

    @F.pandas_udf("array<double>")
    def change(key, now):
        import pandas as pd
        before = sent.value.by_grams(list(key))
        return pd.Series([(np.asarray(e, np.float64) - b).tolist() for e, b in zip(now, before)])

    @F.pandas_udf("array<double>")
    def change_by_grams(key, found):
        import pandas as pd
        m, before = sent.value, sent.value.by_grams(list(key))
        return pd.Series([(m.word_with(w, {(g["kind"], g["key"]): g["e"] for g in gs}) - b).tolist()
                          for w, gs, b in zip(key, found, before)])

    @F.pandas_udf("s array<double>, n int, h1 long, h2 long")
    def base(batch):
        import pandas as pd
        s, n = sent.value.sums(batch)
        h = np.array([_digest(t) for t in batch], np.int64).reshape(-1, 2)
        return pd.DataFrame({"s": s.tolist(), "n": n, "h1": h[:, 0], "h2": h[:, 1]})

    @F.pandas_udf(PREDICTED)
    def predicted(s, n, more):
        import pandas as pd
        s = np.array([x if y is None else np.add(x, y) for x, y in zip(s, more)]).reshape(-1, size)
        return pd.DataFrame(dict(zip(("lang_pred", "score"), sent.value.best(s, n.to_numpy()))))

    def beyond(batches):
        """(h1, h2, part, key, k): a text's words that aren't broadcast, once in a task for equal texts."""
        model, part, seen = sent.value, TaskContext.get().partitionId(), set()
        for b in batches:
            mine = []
            for t in b.column(0):
                h = _digest(t := t.as_py())
                if t is not None and h not in seen:
                    seen.add(h)
                    mine.append((h, t))
            done = 0
            for n, own, at, sizes in model.chunks([t for _, t in mine]):
                known = model.resolve(own)[0]
                text = np.repeat(np.arange(n), sizes)[~known[at]]
                pair, k = np.unique(text * len(own) + at[~known[at]], return_counts=True)
                text = pair // max(1, len(own)) + done
                h = np.array([x for x, _ in mine], np.int64).reshape(-1, 2)[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.full(len(k), part, np.int32)),
                     pa.array([own[i] for i in pair % max(1, len(own))], pa.string()), pa.array(k.astype(np.int32))],
                    names=["h1", "h2", "part", "key", "k"])
                done += n

    rare = model.rare
    held = df.select(quoted(text)).mapInArrow(beyond, "h1 long, h2 long, part int, key string, k int")
    table = rare.filter("kind = 0").select("key", change("key", "e").alias("c"))
    if model.rare.filter("kind > 0").limit(1).count():  # n-grams beyond the broadcast: for the words never seen
        held = cut_lineage(held)
        lone = held.select("key").distinct().join(table.select("key"), "key", "left_anti")
        marked = F.concat(F.lit("^"), "key", F.lit("$"))
        every = F.concat(*[_all_grams(marked, n) for n in range(1, MAX_GRAM + 1)])
        at = lone.select("key", F.explode(F.array_distinct(every)).alias("g")).select("key", "g.*")
        seen = at.join(rare.filter("kind > 0").toDF("kind", "gram", "e"), ["kind", "gram"])
        seen = seen.groupBy("key").agg(F.collect_list(F.struct("kind", F.col("gram").alias("key"), "e")).alias("found"))
        table = table.unionByName(seen.select("key", change_by_grams("key", "found").alias("c")))
    held = held.join(maybe_broadcast(table), "key")
    # every task that met a text has its whole sum: one of them counts
    more = (held.groupBy("h1", "h2", "part").agg(*[F.sum(F.col("k") * F.col("c")[i]).alias(f"c{i}") for i in range(size)])
            .groupBy("h1", "h2").agg(F.min_by(F.array(*[f"c{i}" for i in range(size)]), "part").alias("more")))
    b, h1, h2, m = fresh(df, "_base", "_h1", "_h2", "_more")
    more = maybe_broadcast(more.toDF(h1, h2, m))
    seen = df.withColumn(b, base(quoted(text)))
    on = (F.col(b)["h1"] == F.col(h1)) & (F.col(b)["h2"] == F.col(h2))
    seen = seen.join(more, on, "left")
    return seen.select(*map(quoted, df.columns), predicted(F.col(b)["s"], F.col(b)["n"], F.col(m)).alias(name))


def _all_grams(marked: Column, n: int) -> Column:
    """Structs (kind, gram) of all n-grams of a marked word."""
    last = F.length(marked) - (n - 1)
    found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.struct(
        F.lit(n).alias("kind"), F.substring(marked, i, F.lit(n)).alias("gram")))
    return F.when(last >= 1, found).otherwise(F.slice(found, 1, 0))


def _digest(text: str | None) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.int64)
    return int(a), int(b)
