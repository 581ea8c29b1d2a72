"""Operator 4: sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards with weights; the weight of a rack or
region is the sum of what hangs below it. A row descends level by level: every
child of the current node draws ``-ln(u) / weight`` with ``u`` from the hash of
(node path, row key), and the smallest draw wins. A child is chosen with
probability weight / sum of weights, and a changed weight changes only that
child's draw. So rows move only into or out of subtrees whose weights changed;
within an unchanged node nothing moves.

``grown`` adds one shard as a region of its own. No old node's weight changes,
so the only moves are into the new shard (the law ``key``).

Cases: a null key is a key of its own; a null text counts 0 bytes (size 16,
crc32 of the empty string); repeated rows share a shard and get slots of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklib.llm.common import key_text, let, unit_draw

SHARDS, REGIONS, RACKS = 40, 4, 2


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(n_shards: int = SHARDS, regions: int = REGIONS, racks: int = RACKS) -> list[Leaf]:
    """``n_shards`` shards of weight 1 dealt to regions x racks in turn."""
    n = regions * racks
    return [Leaf(f"r{i % n // racks}", f"k{i % n % racks}", i) for i in range(n_shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own."""
    new = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"r+{new}", "k0", new, weight)]


def _draw_child(path: Column, key: Column, children: Column) -> Column:
    """The position of the child (struct name, weight) with the smallest draw; equal draws go to the earlier one."""
    return F.array_min(F.transform(children, lambda c, i: F.struct(
        (-F.log(unit_draw(F.concat_ws("/", path, c["name"]), key)) / c["weight"]).alias("d"), i.alias("i"))))["i"]


def _children(names_weights: list[tuple[str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in names_weights])


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key: region, then rack, then shard. The tree is three constant nested arrays."""
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    if not regions:
        raise ValueError("a tree needs at least one shard of positive weight")
    weight = {r: {k: sum(x.weight for x in v) for k, v in racks.items()} for r, racks in regions.items()}
    top = _children([(r, sum(w.values())) for r, w in weight.items()])
    racks = F.array(*[_children(list(w.items())) for w in weight.values()])
    shards = F.array(*[F.array(*[_children([(str(x.shard), x.weight) for x in v]) for v in r.values()])
                       for r in regions.values()])

    def in_rack(r, k):
        here = F.get(F.get(shards, r), k)
        path = F.concat_ws("/", F.get(top, r)["name"], F.get(F.get(racks, r), k)["name"])
        return let(_draw_child(path, key, here), lambda s: F.get(here, s)["name"].cast("int"))

    def in_region(r):
        return let(_draw_child(F.get(top, r)["name"], key, F.get(racks, r)), lambda k: in_rack(r, k))

    return let(_draw_child(F.lit(""), key, top), in_region)


def shard_documents(docs: DataFrame, tree: list[Leaf] | None = None, blocks: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text).

    Slots are gapless from 0 within a shard without ranking a shard in one
    task: rows are ranked inside (shard, hash block), and the blocks' counts,
    at most shards x ``blocks`` rows, give the offsets.
    """
    tree = tree or even_tree()
    key = key_text(F.col("doc_id"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")).select(
        "*", shard_of(key, tree).alias("shard"), shard_of(key, grown(tree)).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int").alias("block"))
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("o_shard"), F.col("block").alias("o_block"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("r", F.row_number().over(rank))
    return ranked.join(offsets, (F.col("shard") == F.col("o_shard")) & (F.col("block") == F.col("o_block"))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("r") - 1).cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"))
