"""Sharding by a hierarchical weighted hash tree.

A shard sits in a rack and a rack in a region. A row descends region, rack and shard levels; at each level every child
draws -ln(u) / weight with u a hash of the row's key and the child's path, and the smallest draw wins, so a child gets
rows in proportion to its weight and nothing but the key and the tree decides.

Weight that is added later is a generation of its own. A node holds one arm for each generation of weight under it, and
the arms draw beside each other at the top level. Old arms draw as before, hence growth by one shard can only let the
new arm win: rows move into the new shard alone, and subtrees whose weights did not change exchange nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, let

#: Groups a shard's rows are numbered in; a group's rows meet in one task, a shard's never do.
SLOT_BUCKETS = 256


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0
    generation: int = 0


def topology(n: int, base: int = 40, regions: int = 4, racks: int = 2) -> list[Shard]:
    """n shards: the first base ones are generation 0, dealt over regions and racks; each later one is a generation."""
    return [Shard(f"r{i % regions}", f"k{i // regions % racks}", i, 1.0, max(0, i - base + 1)) for i in range(n)]


def tree(shards: list[Shard]) -> dict[str, list[tuple[str, float]]]:
    """Children of each inner path with their weights. A path begins with its generation, and the root is empty."""
    if any(s.weight < 0 for s in shards) or not any(s.weight for s in shards):
        raise ValueError("weights must not be negative, and one at least must be positive")
    weights: dict[str, dict[str, float]] = {}
    for s in shards:
        if s.weight:
            region = f"g{s.generation}/{s.region}"
            rack = f"{region}/{s.rack}"
            for parent, child in (("", region), (region, rack), (rack, f"{rack}/{s.shard}")):
                weights.setdefault(parent, {}).setdefault(child, 0.0)
                weights[parent][child] += s.weight
    return {parent: sorted(children.items()) for parent, children in weights.items()}


def uniform(text: Column) -> Column:
    """A double in (0, 1) from the first 52 bits of the text's md5."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def place(key: Column, shards: list[Shard]) -> Column:
    """The shard of a key, an int."""
    nodes = tree(shards)
    at = F.create_map(*[x for parent, children in nodes.items() for x in (F.lit(parent), F.array(*[F.struct(F.lit(c).alias("child"), F.lit(w).alias("weight")) for c, w in children]))])

    def descend(path: Column) -> Column:
        draws = F.transform(F.element_at(at, path), lambda c: F.struct((-F.log(uniform(F.concat_ws("|", key, c["child"]))) / c["weight"]).alias("draw"), c["child"].alias("child")))
        return F.array_min(draws)["child"]

    leaf = let(descend(F.lit("")), lambda region: let(descend(region), descend))
    return F.substring_index(leaf, "/", -1).cast("int")


def assign(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; slots of a shard run from 0 without gaps.

    Rows of equal doc_id go to the same shard; a null doc_id is a key of its own. A null text has size 16 and the
    checksum of no bytes. Slots follow a hash of the key, then doc_id, checksum and size; rows equal in all of these
    take neighbouring slots. Other columns are left out, so their names can't clash. An empty table gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select("doc_id", key.alias("key"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = placed.select("*", place(F.col("key"), shards).alias("shard"), (place(F.col("key"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"), F.pmod(F.conv(F.substring(F.md5("key"), 17, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("bucket"))
    # one row a shard and bucket: at most len(shards) * buckets rows, so the broadcast below is bounded
    counts = docs.select(key.alias("key")).select(place(F.col("key"), shards).alias("shard"), F.pmod(F.conv(F.substring(F.md5("key"), 17, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("bucket")).groupBy("shard", "bucket").count()
    before = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("within", within - 1)
        .join(F.broadcast(before), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), "grown_shard")
    )


def with_shard(docs: DataFrame, shards: list[Shard], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs and each row's shard, in a column of that name or, where docs has it, a longer one."""
    return docs.withColumn(fresh(docs, name)[0], place(F.coalesce(F.col(key).cast("string"), F.lit("null")), shards))
