"""Sharding by a hierarchical weighted hash tree.

A topology names shards by region and rack, each shard with a weight; a region or rack weighs what its
shards weigh together. A row descends region, rack and shard: at every level each child draws a hash of
(key, child), scaled by the child's weight, and the best draw wins (weighted rendezvous: with u uniform
in (0, 1), the smallest -ln(u) / weight). A draw depends on the key and that child alone, so a changed
weight moves rows only between its subtree and the siblings of the nodes above it; rows never move
between two subtrees whose weights stay. A new region therefore takes rows only into itself.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A topology is a literal in the plan: more shards than this want a table of their own.
MAX_SHARDS = 10_000


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def regular_topology(regions: int, racks: int, shards: int) -> list[Shard]:
    """``regions * racks * shards`` shards of weight 1, numbered from 0."""
    return [Shard(f"region{r}", f"rack{k}", (r * racks + k) * shards + s)
            for r in range(regions) for k in range(racks) for s in range(shards)]


def with_new_region(topology: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The topology and one more shard, in a region of its own: rows move only into it."""
    number = 1 + max((s.shard for s in topology), default=-1)
    return [*topology, Shard(f"region-of-{number}", "rack0", number, weight)]


def _draw(key: Column, level: str, children: Column) -> Column:
    """The best child of ``children`` (array of struct name, weight) for ``key``."""
    def score(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child["name"]), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(2**53))
        return F.struct((-F.log(u) / child["weight"]).alias("cost"), child["name"].alias("name"))

    return F.array_min(F.transform(children, score))["name"]


def _children(nodes: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(nodes.items())])


def shard_of(key: Column, topology: list[Shard]) -> Column:
    """The shard number of a key. Null keys draw like any other value, all to one shard."""
    if not 0 < len(topology) <= MAX_SHARDS:
        raise ValueError(f"a topology has 1 to {MAX_SHARDS} shards, not {len(topology)}")
    if len({s.shard for s in topology}) < len(topology) or any(s.weight <= 0 for s in topology):
        raise ValueError("shard numbers are distinct and weights positive")
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    for s in topology:
        rack = f"{s.region}/{s.rack}"
        regions[s.region] = regions.get(s.region, 0.0) + s.weight
        racks.setdefault(s.region, {})[rack] = racks.get(s.region, {}).get(rack, 0.0) + s.weight
        shards.setdefault(rack, {})[str(s.shard)] = s.weight

    def below(parents: dict[str, dict[str, float]]) -> Column:
        return F.create_map(*[x for name, nodes in sorted(parents.items()) for x in (F.lit(name), _children(nodes))])

    key = F.coalesce(key.cast("string"), F.lit("null"))
    region = _draw(key, "region", _children(regions))
    rack = _draw(key, "rack", F.element_at(below(racks), region))
    return _draw(key, "shard", F.element_at(below(shards), rack)).cast("int")


#: Rows that one task numbers, about; the number of parts of a shard follows from the row count.
ROWS_A_PART = 500_000


def assign_shards(docs: DataFrame, topology: list[Shard], grown: list[Shard] | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` in its shard: ``id_col``, ``size`` (UTF-8 bytes of the text plus 16),
    ``text_crc32``, ``law`` (``key``: key and topology alone decide), ``shard``, ``slot`` and
    ``grown_shard`` (the shard under ``grown``, else null).

    Slots number a shard's rows from 0 without gaps. A shard is numbered in parts (hash of the id and
    of the text's checksum): parts are counted first, with partial aggregation, and each begins where
    the part before it ends, so no task sorts a whole shard and a hot shard stays many tasks. Null ids
    all go to one shard; null and empty texts have size 16 and checksum 0; repeated rows each get a
    slot (their order among themselves is free). Other columns of ``docs`` are not read."""
    text = F.col(f"`{text_col}`")
    key = F.col(f"`{id_col}`")
    rows = docs.select(
        key.alias("_key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(key, topology).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    parts = max(1, docs.count() // ROWS_A_PART // len(topology) * 2 + 1)
    part = F.pmod(F.xxhash64(F.col("_key").cast("string"), F.col("text_crc32"), F.lit("part")), F.lit(parts)).cast("int")
    rows = rows.withColumn("_part", part)
    held = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = held.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    order = Window.partitionBy("shard", "_part").orderBy("_key", "text_crc32")
    placed = rows.withColumn("_at", F.row_number().over(order) - 1).join(begins, ["shard", "_part"])
    return placed.select(F.col("_key").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("_begin") + F.col("_at")).cast("long").alias("slot"), "grown_shard")
