"""Sharding by a hierarchical weighted hash tree (region, rack, shard), with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import spare

LAW = "key"


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 4, per_region: int = 8) -> list[Leaf]:
    """Shards 0 .. shards - 1 of weight 1, filled rack by rack and region by region."""
    return [Leaf(s // per_region, s // per_rack, s) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a rack and region of its own.

    The only weights that change are those on the new path, so the only rows that move are those whose region draw the new
    region wins, and its single path takes them to the new shard.
    """
    return [*tree, Leaf(1 + max(x.region for x in tree), 1 + max(x.rack for x in tree), 1 + max(x.shard for x in tree), weight)]


def _straw(key: Column, level: str, node: int, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of key and node: the least of several falls on a node in proportion to its weight."""
    digest = F.md5(F.concat_ws(":", key, F.lit(level), F.lit(str(node))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double")
    return -F.log((draw + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _winner(key: Column, level: str, nodes: dict[int, float]) -> Column:
    if len(nodes) == 1:
        return F.lit(next(iter(nodes)))
    return F.array_min(F.array(*[F.struct(_straw(key, level, n, w).alias("straw"), F.lit(n).alias("node")) for n, w in sorted(nodes.items())]))["node"]


def _descend(key: Column, region: Column, rack: Column | None, tree: list[Leaf], level: str) -> Column:
    """The child that wins at level, below each node of the level above."""
    above = region if rack is None else rack
    parents: dict[int, dict[int, float]] = {}
    for x in tree:
        parent, child = (x.region, x.rack) if rack is None else (x.rack, x.shard)
        parents.setdefault(parent, {})
        parents[parent][child] = parents[parent].get(child, 0.0) + x.weight
    out = None
    for parent, nodes in sorted(parents.items()):
        pick = _winner(key, level, nodes)
        out = F.when(above == parent, pick) if out is None else out.when(above == parent, pick)
    return out


def with_shard(df: DataFrame, key_col: str, tree: list[Leaf], name: str = "shard") -> DataFrame:
    """df with the shard that its key draws: region first, then a rack in it, then a shard in that.

    Only the key and the tree decide. A null key draws as the text "null" does. Every row gets a shard; a column that is
    already called name is replaced.
    """
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    regions: dict[int, float] = {}
    for x in tree:
        regions[x.region] = regions.get(x.region, 0.0) + x.weight
    region, rack = spare(df.columns, "region", "rack")
    work = df.withColumn(region, _winner(key, "region", regions))
    work = work.withColumn(rack, _descend(key, F.col(region), None, tree, "rack"))
    return work.withColumn(name, _descend(key, F.col(region), F.col(rack), tree, "shard").cast("int")).drop(region, rack)


def with_slot(df: DataFrame, order: list[str], shard_col: str = "shard", cells: int = 1024) -> DataFrame:
    """df with slot: a gapless number from 0 within each shard; a column that is already called slot is replaced.

    A shard is cut into cells by a hash of the order columns; rows are numbered within their cell and moved up by the
    counts of the cells before it. So no task holds a whole shard, and the window over counts has cells rows a shard.
    Rows alike in all order columns are interchangeable.
    """
    cell, n, row, start = spare(df.columns, "cell", "n", "row", "start")
    digest = F.md5(F.concat_ws(":", F.lit("slot"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order]))
    work = df.withColumn(cell, F.pmod(F.conv(F.substring(digest, 1, 6), 16, 10).cast("int"), F.lit(cells)))
    counts = work.groupBy(shard_col, cell).agg(F.count("*").alias(n))
    starts = counts.selectExpr(shard_col, cell, f"sum({n}) over (partition by {shard_col} order by {cell}) - {n} as {start}")
    number = F.expr(f"row_number() over (partition by {shard_col}, {cell} order by {', '.join(order)})")
    return work.withColumn(row, number).join(starts, [shard_col, cell]).withColumn("slot", (F.col(start) + F.col(row) - 1).cast("long")).drop(cell, row, start)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law "key": the id and the number of shards decide, so equal texts under different ids part. A null or empty text has size 1
    and checksum 0; null ids share one shard; repeated rows repeat with slots of their own; an empty table gives none.
    Other columns are not read.
    """
    tree = topology(shards)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = with_shard(with_shard(base, "doc_id", tree), "doc_id", grown(tree), "grown_shard")
    return with_slot(placed, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")
