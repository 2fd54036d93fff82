"""Best-fit packing with a swap-based local search.

Texts are tokenized once; a document's ids end with a separator id, only
documents longer than a sequence are cut, and what remains per piece is a
narrow row (id, start, length, checksum). Pieces are dealt at random to blocks
of about BLOCK_PIECES, and each block is packed by one task: best fit in
decreasing order, then a local search that exchanges one document for one,
two for one, or moves one, always from the emptier to the fuller bin, so that
the sum of squared fills rises until bins are empty. A block wastes less than
a few sequences whatever its size, so blocks cost nothing at scale.

Tokenizing goes word by word through the tokenizer's own model with a bounded
cache: the tokenizer drops white space, so a text's ids are its words' ids one
after another.

Nulls and ties: a null text is empty (one separator); equal rows are packed one
by one; a null doc_id is an id like others; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.llm.base import ByteCache, quoted
from flowsift.session import cut_lineage

CAPACITY = 2048
SEPARATOR = 0
BLOCK_PIECES = 25_000
WORD_BYTES = 128 << 20  # of the words whose ids a worker keeps
CHUNK_BYTES = 8 << 20   # of texts whose distinct words are looked up together
ROUNDS = 4  # sweeps of the local search over the underfull bins


def _byte_letters() -> dict[int, str]:
    """How byte-level pre-tokenizers write a byte: printable Latin-1 as itself,
    the others as the letters from code point 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts by a `tokenizers` file that normalises by NFC and lower
    case, splits by a pattern, drops white space and maps bytes to letters. Ids
    are kept per word as little-endian unsigned 32-bit numbers."""

    # first code point beyond the Latin blocks, for which Python's rules are taken to be the tokenizer's
    BEYOND_LATIN = "\u0250"
    MARKS = ".,;:!?"

    def __init__(self, path: str, word_bytes: int = WORD_BYTES):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = ByteCache(self.word, word_bytes)  # of words, and of the pieces that the pattern makes of them
        self.letters = _byte_letters()
        split = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]
        self.split = regex.compile(split["pattern"]["Regex"])

    def piece(self, p: str) -> bytes:
        s = p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode()))
        return array("I", [t.id for t in self.model.tokenize(s)]).tobytes()

    def word(self, w: str) -> bytes:
        low = w.lower()
        latin = low.isascii() or max(low) < self.BEYOND_LATIN  # these are their own normal form as well
        if latin and low.isalpha():  # one piece
            return self.piece(w) if low == w else self.words[low]
        if latin and w[-1] in self.MARKS and low[:-1].isalpha():  # letters and a mark: two
            return self.words[low[:-1]] + self.words[w[-1]]
        if latin and "<|" not in w and w.isprintable():
            pieces = self.split.findall(low)
            return self.piece(w) if pieces == [w] else b"".join(map(self.words.__getitem__, pieces))
        return self.whole(w)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, not to the tokenizer
            return np.frombuffer(self.whole(text), "<u4")
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), "<u4")

    def distinct(self, words: pa.Array) -> list[bytes]:
        """The ids of each of some words; those that differ only in ASCII case or a last mark
        are looked up together."""
        plain = pc.match_substring_regex(words, f"^[A-Za-z]+[{self.MARKS}]?$")
        stems = pc.if_else(plain, pc.ascii_rtrim(pc.ascii_lower(words), self.MARKS), words).dictionary_encode()
        own = [self.words[w] if w else b"" for w in stems.dictionary.to_numpy(zero_copy_only=False)]
        last = pc.index_in(pc.utf8_slice_codeunits(words, -1), pa.array(list(self.MARKS), words.type))
        last = pc.fill_null(pc.if_else(plain, last, -1), -1)
        marks = [*map(self.words.__getitem__, self.MARKS), b""]  # -1: none
        return [own[i] + marks[j] for i, j in zip(stems.indices.to_numpy().tolist(), last.to_numpy().tolist())]

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after another, and each text's number of ids; every
        distinct word is looked up once."""
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            parts = [self.ids(t) for t in texts.to_pylist()]
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        split = pc.utf8_split_whitespace(texts)  # of the same white space as Python's
        words = split.flatten().dictionary_encode()
        found = self.distinct(words.dictionary)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = words.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        where = np.repeat((np.cumsum(size) - size)[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return np.frombuffer(b"".join(found), "<u4")[where], np.diff(np.append(0, ends)[split.offsets.to_numpy()])


def slices(texts: pa.Array, size: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Stretches (first, end) of texts of about ``size`` bytes, of one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // size)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)])) if len(texts) else []


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer_of(path: str, word_bytes: int = WORD_BYTES) -> WordTokenizer:
    """One tokenizer (and cache of about ``word_bytes``) for each worker process and file."""
    if (path, word_bytes) not in _TOKENIZERS:
        _TOKENIZERS[path, word_bytes] = WordTokenizer(path, word_bytes)
    return _TOKENIZERS[path, word_bytes]


def cut_pieces(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
               with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every piece."""
    body = df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", body.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def run(batches):
        tok = tokenizer_of(path)
        for b in batches:
            rows, at, ids_out = [], [], []
            for n, t in enumerate(b.column(1)):
                ids = np.append(tok.ids(t.as_py()), np.uint32(SEPARATOR)).astype("<u4")
                for p, s in enumerate(range(0, len(ids), capacity)):
                    x = ids[s:s + capacity]
                    rows.append((p, s, len(x), zlib.crc32(x.tobytes())))
                    at.append(n)
                    if with_ids:
                        ids_out.append(x.astype(np.int64))
            cols = list(zip(*rows)) or [()] * 4
            arrays = [b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()),
                      *[pa.array(c, pa.int64()) for c in cols[1:]]]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        tok.words.clear()

    return body.mapInArrow(run, schema)


class Bins:
    """Bins of one block: members by size, free space, and bins by free space."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.members: list[list[int]] = []
        self.free: list[int] = []
        self.at_free: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0  # bit f: there is a bin with f free
        self.holds: dict[int, set[int]] = {}  # size -> underfull bins that hold such a document

    def _file(self, b: int, on: bool) -> None:
        f = self.free[b]
        (self.at_free[f].add if on else self.at_free[f].discard)(b)
        if self.at_free[f]:
            self.mask |= 1 << f
        else:
            self.mask &= ~(1 << f)
        if f > 0:
            for i in self.members[b]:
                s = self.sizes[i]
                if on:
                    self.holds.setdefault(s, set()).add(b)
                elif b in self.holds.get(s, ()):
                    self.holds[s].discard(b)

    def change(self, b: int, out: list[int], into: list[int]) -> None:
        self._file(b, False)
        for i in out:
            self.members[b].remove(i)
        self.members[b] += into
        self.free[b] += sum(self.sizes[i] for i in out) - sum(self.sizes[i] for i in into)
        if self.members[b]:
            self._file(b, True)

    def open(self, i: int) -> None:
        self.members.append([i])
        self.free.append(self.capacity - self.sizes[i])
        self._file(len(self.free) - 1, True)

    def best(self, size: int, but: int = -1) -> int:
        """The fullest bin with ``size`` free, other than ``but``; -1: none."""
        f = size
        while True:
            m = self.mask >> f
            if not m:
                return -1
            f += (m & -m).bit_length() - 1
            for b in self.at_free[f]:
                if b != but:
                    return b
            f += 1

    def with_size(self, lo: int, hi: int, free, but: int, fill: int) -> tuple[int, int] | None:
        """(bin, document) with a document of a size in lo..hi, from the smallest:
        the bin has free(size) or more, is fuller than ``fill`` and isn't ``but``."""
        for y in range(max(1, lo), hi + 1):
            for b in self.holds.get(y, ()):
                if b != but and self.free[b] >= free(y) and self.capacity - self.free[b] >= fill:
                    return b, next(i for i in self.members[b] if self.sizes[i] == y)
        return None

    def drain(self, a: int) -> bool:
        """Move what bin ``a`` holds to fuller bins, or make it smaller by
        exchanges; true if it ends empty."""
        changed = True
        while changed and self.members[a]:
            changed = False
            fill = self.capacity - self.free[a]
            top = self.mask.bit_length() - 1  # the most free space of any bin
            for i in sorted(self.members[a], key=lambda i: -self.sizes[i]):
                s = self.sizes[i]
                b = self.best(s, a)
                if b >= 0 and self.capacity - self.free[b] >= fill - s:
                    self.change(a, [i], [])
                    self.change(b, [], [i])
                    changed = True
                    break
                # one for one: a smaller document comes back
                got = self.with_size(s - min(top, s - 1), s - 1, lambda y: s - y, a, fill)
                if got:
                    b, j = got
                    self.change(a, [i], [j])
                    self.change(b, [j], [i])
                    changed = True
                    break
            if not changed and len(self.members[a]) > 1:
                # two for one: two of this bin's documents for a smaller one
                two = sorted(self.members[a], key=lambda i: self.sizes[i])[:2]
                s = sum(self.sizes[i] for i in two)
                got = self.with_size(s - min(top, s - 1), s - 1, lambda y: s - y, a, fill)
                if got:
                    b, j = got
                    self.change(a, two, [j])
                    self.change(b, [j], two)
                    changed = True
        return not self.members[a]


def pack(sizes: list[int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[list[int]]:
    """Bins (lists of positions in ``sizes``), none over capacity: best fit
    decreasing, then the local search."""
    full = [[i] for i, s in enumerate(sizes) if s == capacity]
    bins = Bins(sizes, capacity)
    for i in sorted((i for i, s in enumerate(sizes) if s < capacity), key=lambda i: (-sizes[i], i)):
        b = bins.best(sizes[i])
        if b < 0:
            bins.open(i)
        else:
            bins.change(b, [], [i])
    least = -(-sum(s for s in sizes if s < capacity) // capacity)
    for _ in range(rounds):
        live = [b for b, m in enumerate(bins.members) if m]
        if len(live) <= least:
            break
        emptied = sum(bins.drain(b) for b in sorted(live, key=lambda b: (-bins.free[b], b)) if bins.free[b] > 0
                      and bins.members[b])
        if not emptied:
            break
    return full + [m for m in bins.members if m]


def pack_documents(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    pieces = cut_lineage(cut_pieces(df, path, doc_id, text, capacity))
    blocks = max(1, round(pieces.count() / BLOCK_PIECES))
    # the checkpointed rows are dealt by their number, so equal rows don't meet in one block
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    names = pieces.columns

    def run(key, table):
        block = key[0].as_py()
        sizes = table.column("length").to_pylist()
        seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for n, members in enumerate(pack(sizes, capacity)):
            at = 0
            for i in members:
                seq[i], off[i] = (block << 32) + n, at
                at += sizes[i]
        return (table.select(names).append_column("sequence_id", pa.array(seq))
                .append_column("offset", pa.array(off)))

    out = dealt.groupBy("block").applyInArrow(run, schema)
    return out.withColumnRenamed("doc_id", doc_id)
