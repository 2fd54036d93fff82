"""Sharding by a hierarchical weighted hash tree.

A topology is a list of shards, each with a weight and a place (region,
rack). Inner nodes weigh what their shards weigh together. A key descends
region -> rack -> shard; at each level every child draws
``-ln(u) / weight`` with ``u`` a hash of (key, child), and the smallest draw
wins. A child is chosen in proportion to its weight, and a change of one
child's weight changes that child's draws only, so rows move only into or
out of subtrees whose weight changed; a new region takes rows into itself
and moves nothing between the others.

The draws read the key alone: any executor recomputes the same shard, and no
table of assignments exists. Slots number each shard's rows without gaps:
rows are dealt to many (shard, hash prefix) cells, the small table of cell
counts is prefix-summed, and rows are ranked inside their cell, so no task
holds a shard.

Nulls and ties: a null key hashes as the empty text; a null text has size 1
and the checksum of the empty text; rows equal in key, size and checksum get
neighbouring slots in any order (they can't be told apart). An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsift.llm.base import quoted
from flowsift.session import maybe_broadcast

# hexadecimal digits of md5 that make the 52-bit uniform number
HEX_DIGITS = 13
# rows that one (shard, hash prefix) cell should hold at most, on average
CELL_ROWS = 200_000


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def regular_topology(n_shards: int, per_rack: int = 2, racks_per_region: int = 2) -> list[Shard]:
    """Shards in order over racks and regions. Every shard from number 8 on (two
    full regions) opens a region of its own, so that growing by one shard changes
    no existing node's weight."""
    base = per_rack * racks_per_region * 2
    out = []
    for s in range(n_shards):
        if s < base:
            out.append(Shard(s, f"g{s // (per_rack * racks_per_region)}", f"k{s // per_rack}"))
        else:
            out.append(Shard(s, f"g{2 + s - base}", f"k{base // per_rack + s - base}"))
    return out


def uniform(key: Column, node: Column) -> Column:
    """Hash of (key, node) in (0, 1): 52 bits of md5."""
    digits = F.substring(F.md5(F.concat(key, F.lit("/"), node).cast("binary")), 1, HEX_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16 ** HEX_DIGITS)


def _children(topology: list[Shard]) -> dict[str, list[tuple[str, float]]]:
    """Per inner node path: its children's paths and weights. Root is ''."""
    weight: dict[str, float] = {}
    kids: dict[str, dict[str, None]] = {}
    for t in topology:
        if not t.weight > 0:
            continue  # a weight of zero takes a shard out
        path = ["", t.region, f"{t.region}.{t.rack}", f"{t.region}.{t.rack}.{t.shard}"]
        for parent, child in zip(path, path[1:]):
            kids.setdefault(parent, {})[child] = None
            weight[child] = weight.get(child, 0.0) + t.weight
    if not kids:
        raise ValueError("the topology has no shard of positive weight")
    return {p: [(c, weight[c]) for c in sorted(cs)] for p, cs in kids.items()}


def shard_of(key: Column, topology: list[Shard]) -> Column:
    """The shard (int) of a key: three weighted draws down the tree."""
    kids = _children(topology)
    tree = F.create_map(*[x for p, cs in sorted(kids.items()) for x in (
        F.lit(p), F.array(*[F.struct(F.lit(c).alias("node"), F.lit(float(w)).alias("weight")) for c, w in cs]))])
    key = F.coalesce(key.cast("string"), F.lit(""))

    def winner(parent: Column) -> Column:
        return F.array_min(F.transform(F.element_at(tree, parent), lambda c: F.struct(
            (-F.ln(uniform(key, c["node"])) / c["weight"]).alias("draw"), c["node"].alias("node"))))["node"]

    leaf = winner(winner(winner(F.lit(""))))
    return F.element_at(F.split(leaf, "[.]"), -1).cast("int")


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 8,
                  topology: list[Shard] | None = None, grown: list[Shard] | None = None) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row.

    ``grown_shard`` is the shard under ``grown`` (default: one more shard)."""
    topology = topology or regular_topology(n_shards)
    grown = grown or regular_topology(len(topology) + 1)
    body = F.coalesce(quoted(text), F.lit(""))
    rows = df.select(
        quoted(key).alias(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
    ).withColumn("shard", shard_of(quoted(key), topology)).withColumn("grown_shard", shard_of(quoted(key), grown))
    rows = rows.withColumn("law", F.lit("key")).withColumn("_o", F.md5(F.concat_ws(
        "/", F.coalesce(quoted(key).cast("string"), F.lit("")), "size", "text_crc32").cast("binary")))
    # the cells: enough hash prefixes for CELL_ROWS rows each
    digits, n = 1, df.count() / max(1, len(topology))
    while n / 16 ** digits > CELL_ROWS and digits < 8:
        digits += 1
    # slots follow the order of _o, whose prefix names the cell: the number of cells doesn't change them
    digits = max(digits, 3)
    rows = rows.withColumn("_c", F.substring("_o", 1, digits))
    cells = rows.groupBy("shard", "_c").agg(F.count("*").alias("_n"))
    sums = W.partitionBy("shard").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    base = maybe_broadcast(cells.select("shard", "_c", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_base")))
    rank = F.row_number().over(W.partitionBy("shard", "_c").orderBy("_o", quoted(key), "size", "text_crc32"))
    return (rows.withColumn("_r", rank).join(base, ["shard", "_c"])
            .select(quoted(key), "size", "text_crc32", "law", "shard",
                    (F.col("_base") + F.col("_r") - 1).cast("long").alias("slot"), "grown_shard"))
