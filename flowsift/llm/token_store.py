"""Token ids in Re-Pair compressed shards, with random access.

Documents are dealt to partitions by ranges of their id and sorted there, every
text is tokenized and closed by END_ID, and each task cuts its ids at document
ends into shards of about SHARD_IDS. A shard is compressed by a grammar of its
own: in every round all adjacent pairs are counted, the frequent ones become
nonterminals, and their occurrences are replaced, the more frequent pair first
where two overlap, until a round saves less than LEAST_GAIN of the sequence.

The shards are rows of a Parquet table (``part``, ``shard``, ``n_ids``,
``doc_ids``, ``body``), written by Spark, so any store that Spark reaches will
do. ``body`` is little-endian:

    "RPG1", then six u32: documents, ids, first nonterminal B, rules, rounds, symbols
    u32 x documents       ids of each document
    u32 x rounds          rules of each round
    u32 x 2 x rules       nonterminal B + k stands for these two symbols
    u32 x rules           how many ids nonterminal B + k expands to
    u32 x blocks          ids before every BLOCKth symbol
    symbols               u16 if B + rules < 65536, else u32

``ids_between`` decodes any range of a shard's ids from the block that holds
its first id on, expanding no other symbol.

Nulls and ties: a null text is empty (END_ID alone); null doc_ids come first;
rows of equal doc_id are ordered by a hash of the text, equal rows follow each
other; a document of any length lies whole in one shard (a long one is a shard
of its own); an empty table gives empty results.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.llm.base import quoted
from flowsift.llm.packing import slices, tokenizer_of
from flowsift.session import maybe_broadcast

END_ID = 2
SHARD_IDS = 1 << 18   # a shard's arrays stay within a core's cache
LEAST_COUNT = 16      # occurrences that a pair must have to become a rule
LEAST_GAIN = 0.03     # share of the sequence that a round must save for another one
BLOCK = 1024          # symbols between two entries of the position table
WORD_BYTES = 192 << 20  # of the words whose ids a worker keeps
SLOT_BITS = 17        # of a pair's hash, by which rare pairs are told before the sort
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MAGIC = b"RPG1"


def frequent_pairs(seq: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions whose pair is frequent, the pair's rank there: 0 is the most frequent, the pairs by rank)."""
    bits = int(seq.max()).bit_length()
    key = (seq[:-1].astype(np.uint64) << np.uint64(bits)) | seq[1:]
    # a frequent pair's slot is frequent too: positions of the other slots are not sorted
    slot = ((key * SPREAD) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
    place = np.flatnonzero((np.bincount(slot, minlength=1 << SLOT_BITS) >= least)[slot])
    if not len(place):
        return place, np.empty(0, np.int32), np.empty((0, 2), np.uint32)
    key, n = key[place], len(place)
    places = n.bit_length()
    if 2 * bits + places <= 64:  # pair and position in one number: sorts fast
        both = np.sort((key << np.uint64(places)) | np.arange(n, dtype=np.uint64))
        order = both.view(np.int64) & np.int64((1 << places) - 1)
        key = both >> np.uint64(places)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(new, n))
    often = np.flatnonzero(counts >= least)
    often = often[np.argsort(-counts[often], kind="stable")]
    key = key[new[often]]
    pairs = np.c_[key >> np.uint64(bits), key & np.uint64((1 << bits) - 1)].astype(np.uint32)
    rank = np.full(len(counts), -1, np.int32)
    rank[often] = np.arange(len(often))
    of = np.empty(n, np.int32)
    of[order] = np.repeat(rank, counts)
    at = np.flatnonzero(of >= 0)
    return place[at], of[at], pairs


def choose(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the positions are replaced: those no more frequent pair overlaps;
    of a stretch of one pair (aaaa) every other one."""
    near = np.diff(at) == 1
    more = np.zeros(len(at), bool)  # a neighbour comes first
    more[1:] |= near & (rank[:-1] < rank[1:])
    more[:-1] |= near & (rank[1:] < rank[:-1])
    same = np.concatenate([[False], near & (rank[1:] == rank[:-1])])
    if same.any():
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
        odd = (np.arange(len(at)) - first) % 2 == 1
        more |= odd
    return ~more


def compress(ids: np.ndarray, least: int = LEAST_COUNT, gain: float = LEAST_GAIN) -> tuple[int, np.ndarray, list[int], np.ndarray]:
    """(first nonterminal, rules, rules of each round, symbols) of a sequence of ids."""
    seq, rules, rounds = ids.astype(np.uint32), [], []
    base = int(seq.max()) + 1 if len(seq) else 0
    made = 0
    while len(seq) > 1:
        at, rank, pairs = frequent_pairs(seq, least)
        if not len(at):
            break
        mine = choose(at, rank)
        at, rank = at[mine], rank[mine]
        worth = np.bincount(rank, minlength=len(pairs)) >= least
        keep = worth[rank]
        at, rank = at[keep], rank[keep]
        if not len(at):
            break
        rule = pairs[worth]
        name = (np.cumsum(worth) + (base + made - 1)).astype(np.uint32)  # rank -> nonterminal
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq[at] = name[rank]
        saved, before = len(at), len(seq)
        seq = seq[stay]
        rules.append(rule)
        rounds.append(len(rule))
        made += len(rule)
        if saved < gain * before:
            break
    return base, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), rounds, seq


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... lengths[0] of them, then those of starts[1], ..."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Grammar:
    """Rules with the ids that each expands to."""

    def __init__(self, base: int, rules: np.ndarray, rounds: list[int]):
        self.base = base
        self.lengths = np.ones(len(rules), np.int64)
        self.starts = np.zeros(len(rules), np.int64)
        self.flat = np.empty(0, np.uint32)
        done = 0
        for n in rounds:  # a round's rules are made of earlier ones
            pairs = rules[done:done + n].reshape(-1)
            size = self.sizes(pairs).reshape(-1, 2).sum(axis=1)
            more = self.expand(pairs)
            self.lengths[done:done + n] = size
            self.starts[done:done + n] = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, more])
            done += n

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol expands to."""
        out = np.ones(len(symbols), np.int64)
        deep = symbols >= self.base
        out[deep] = self.lengths[symbols[deep] - np.uint32(self.base)]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.sizes(symbols)
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        deep = symbols >= self.base
        plain = ends[~deep] - 1
        rest = np.ones(len(out), bool)  # what is no plain symbol's place is the rules', in their order
        rest[plain] = False
        out[plain] = symbols[~deep]
        rule = symbols[deep] - np.uint32(self.base)
        out[rest] = self.flat[_spread(self.starts[rule], self.lengths[rule])]
        return out


def encode_shard(docs: list[np.ndarray]) -> bytes:
    """The body of a shard of documents' ids."""
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    base, rules, rounds, seq = compress(ids)
    grammar = Grammar(base, rules, rounds)
    size = grammar.sizes(seq)
    blocks = (np.cumsum(size) - size)[::BLOCK]
    wide = base + len(rules) >= 1 << 16
    head = struct.pack("<6I", len(docs), len(ids), base, len(rules), len(rounds), len(seq))
    return b"".join([MAGIC, head, *[np.asarray(x).astype("<u4").tobytes() for x in (
        [len(d) for d in docs], rounds, rules, grammar.lengths, blocks)], seq.astype("<u4" if wide else "<u2").tobytes()])


class Shard:
    """A shard's body, opened: its tables are read, its symbols are not yet expanded."""

    def __init__(self, body: bytes):
        if body[:4] != MAGIC:
            raise ValueError("not a token shard")
        docs, self.n_ids, base, rules, rounds, symbols = struct.unpack_from("<6I", body, 4)
        self.at, self.body = 28, body
        self.doc_lengths = self._take(docs).astype(np.int64)
        steps = self._take(rounds).tolist()
        pairs = self._take(2 * rules).reshape(-1, 2)
        self.rule_lengths = self._take(rules)
        self.blocks = self._take(-(-symbols // BLOCK)).astype(np.int64)
        self.symbols = self._take(symbols, "<u4" if base + rules >= 1 << 16 else "<u2").astype(np.uint32)
        self.grammar = Grammar(base, pairs, steps)

    def _take(self, n: int, kind: str = "<u4") -> np.ndarray:
        out = np.frombuffer(self.body, kind, n, self.at)
        self.at += out.nbytes
        return out

    def ids(self) -> np.ndarray:
        return self.grammar.expand(self.symbols)

    def ids_between(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi (exclusive) of the shard."""
        lo, hi = max(0, lo), min(hi, self.n_ids)
        if lo >= hi:
            return np.empty(0, np.uint32)
        first = int(np.searchsorted(self.blocks, lo, "right")) - 1
        last = int(np.searchsorted(self.blocks, hi, "left"))
        part = self.symbols[first * BLOCK:last * BLOCK]
        ends = np.cumsum(self.grammar.sizes(part)) + self.blocks[first]
        a, b = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left")) + 1
        before = ends[a - 1] if a else self.blocks[first]
        return self.grammar.expand(part[a:b])[lo - before:hi - before]

    def document(self, n: int) -> np.ndarray:
        """Ids of the shard's n-th document."""
        end = int(self.doc_lengths[:n + 1].sum())
        return self.ids_between(end - int(self.doc_lengths[n]), end)


def write_shards(df: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                 end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all texts, in ascending order of ``doc_id``, as a table of shards."""
    kind = df.schema[doc_id].dataType
    body = df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    # equal ids and equal rows too can go to several tasks, so that none is too large
    keys = ["doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m")]
    body = body.select("text", *keys).repartitionByRange("doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()),
                           T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)),
                           T.StructField("body", T.BinaryType())])

    def run(batches):
        tok, part, shard = tokenizer_of(tokenizer, WORD_BYTES), TaskContext.get().partitionId(), 0
        names, docs, held = [], [], 0
        end = np.array([end_id], "<u4")

        def flush():
            ids = pa.concat_arrays(names)
            offsets = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([held], pa.int64()),
                 pa.ListArray.from_arrays(offsets, ids), pa.array([encode_shard(docs)], pa.binary())],
                names=schema.names)

        for b in batches:
            since = 0
            for lo, hi in slices(b.column(1)):
                flat, sizes = tok.many(b.column(1).slice(lo, hi - lo))
                for n, ids in enumerate(np.split(flat, np.cumsum(sizes)[:-1]), lo):
                    ids = np.concatenate([ids, end])
                    if docs and held + len(ids) > shard_ids:
                        names.append(b.column(0).slice(since, n - since))
                        yield flush()
                        names, docs, held, since, shard = [], [], 0, n, shard + 1
                    docs.append(ids)
                    held += len(ids)
            names.append(b.column(0).slice(since))
        if docs:
            yield flush()
        # the words stay for the worker's next task: they are bounded, and new ones cost more than all else here

    body.select("doc_id", "text").mapInArrow(run, schema).write.parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document of a written table."""
    shards = spark.read.parquet(path)
    # ids before each part: one number a part, summed by the driver; within a part by a window
    totals, before, at = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect(), [], 0
    for r in totals:
        before.append((r.part, at))
        at += r.n
    starts = spark.createDataFrame(before, "part int, before long")
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    place = shards.select("part", "shard", "n_ids").withColumn("inside", F.coalesce(inside, F.lit(0)))
    place = place.join(starts, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("start"))
    place = maybe_broadcast(place)  # three numbers a shard: else the bodies would be shuffled
    schema = T.StructType([T.StructField("doc_id", shards.schema["doc_ids"].dataType.elementType),
                           *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def run(batches):
        for b in batches:
            for n in range(b.num_rows):
                shard = Shard(b.column(2)[n].as_py())
                ids, size = shard.ids().astype("<u4"), shard.doc_lengths
                ends = np.cumsum(size)
                parts = np.split(ids, ends[:-1])
                cols = [b.column(1)[n].values, pa.array(b.column(0)[n].as_py() + ends - size, pa.int64()),
                        pa.array(size, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return shards.join(place, ["part", "shard"]).select("start", "doc_ids", "body").mapInArrow(run, schema)
