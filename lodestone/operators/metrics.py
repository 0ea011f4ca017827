"""Ranking metrics from per-query rows (mode, query_id, label, class, hit_rank, hit_rank_correct, ndcg)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import blank_to

# Cut-offs, rank bins and the normal quantile of a 95 % interval.
CUTS = (1, 3, 5, 10, 20)
BINS = ("1", "2-3", "4-5", "6-10", ">10", "miss")
Z = 1.959963984540054


def graded(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """The relevant ones of rows (query_id, uuid, rank, ...) with grade: 2 for the correct row, 1 for other acceptable ones. truth: query_id, correct_uuid, acceptable (an array)."""
    marks = truth.select("query_id", F.explode("acceptable").alias("uuid"), "correct_uuid").distinct()
    grade = F.when(F.col("uuid") == F.col("correct_uuid"), 2).otherwise(1)
    return rows.join(marks, ["query_id", "uuid"]).withColumn("grade", grade).drop("correct_uuid")


def per_query(rows: DataFrame, truth: DataFrame, modes: list[str], cut: int = 10) -> DataFrame:
    """One row per (mode of modes, query of truth) with the ranks of its hits; truth holds its acceptable rows as arrays, see graded."""
    holds = F.coalesce(F.array_contains("acceptable", F.col("correct_uuid")), F.lit(False))
    counted = truth.withColumn("n_acceptable", F.size(F.array_distinct("acceptable"))).withColumn("holds_correct", holds)
    asked = counted.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    return from_hits(graded(rows, truth), asked, ["mode"], cut)


def from_hits(hits: DataFrame, asked: DataFrame, keys: list[str], cut: int = 10) -> DataFrame:
    """One row per row of asked (*keys, query_id, label, class, n_acceptable, holds_correct) with hit_rank, hit_rank_correct and ndcg.

    hits: *keys, query_id, rank, grade of relevant rows only. A query without candidates or hits has null ranks. The gain of grade g is 2^g - 1, and
    the ideal order has the correct row first. Truth as rows needs no array of a query's acceptable rows anywhere.
    """
    best = hits.groupBy(*keys, "query_id").agg(
        F.min("rank").alias("hit_rank"),
        F.min(F.when(F.col("grade") == 2, F.col("rank"))).alias("hit_rank_correct"),
        F.sum(F.when(F.col("rank") <= cut, F.when(F.col("grade") == 2, 3.0).otherwise(1.0) / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    first = F.when(F.col("holds_correct"), 1).otherwise(0)
    others = F.col("n_acceptable") - first
    spots = F.when(others > 0, F.sequence(F.lit(1), F.least(others, F.lit(cut) - first).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    ideal = first * 3.0 + F.aggregate(F.transform(spots, lambda i: 1.0 / F.log2(i + first + 1.0)), F.lit(0.0), lambda s, x: s + x)
    base = asked.withColumn("ideal", ideal).join(best, [*keys, "query_id"], "left")
    ndcg = F.when(F.col("ideal") > 0, F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 6)).otherwise(0.0)
    return base.select(*keys, "query_id", "label", "class", "hit_rank", "hit_rank_correct", ndcg.alias("ndcg"))


def matched(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("label") == "match")


def _within(column: str, k: int | None) -> Column:
    hit = F.col(column).isNotNull() if k is None else F.col(column) <= k
    return F.sum(F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0))


def recall(rows: DataFrame, column: str = "hit_rank") -> DataFrame:
    """Per mode: n_scope, denom and the number of queries with a hit at 1, 3, 5, 10, 20 and anywhere. Only matches count."""
    only = rows.withColumn(column, F.when(F.col("label") == "match", F.col(column)))
    cells = [_within(column, k).alias(f"r{k}") for k in CUTS] + [_within(column, None).alias("rall")]
    return only.groupBy("mode").agg(F.count("*").alias("n_scope"), F.count_if(F.col("label") == "match").alias("denom"), *cells)


def mean_reciprocal_rank(rows: DataFrame, columns: tuple[str, ...] = ("hit_rank", "hit_rank_correct")) -> DataFrame:
    """Per mode: mrr and mrr_correct, or those of columns."""
    gain = lambda c: F.round(F.avg(F.coalesce(1.0 / F.col(c), F.lit(0.0))), 6).alias(c.replace("hit_rank", "mrr"))
    return matched(rows).groupBy("mode").agg(*[gain(c) for c in columns])


def wilson(hits: Column, n: Column) -> tuple[Column, Column, Column]:
    """(share, low, high) of the 95 % Wilson interval; zeros when n is zero."""
    p, z2 = hits / n, Z * Z
    mid, half = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    of = lambda x: F.when(n > 0, F.round(x, 6)).otherwise(0.0)
    return of(p), of(F.greatest(F.lit(0.0), (mid - half) / (1 + z2 / n))), of(F.least(F.lit(1.0), (mid + half) / (1 + z2 / n)))


def wilson_recall(rows: DataFrame) -> DataFrame:
    """Per mode, kind (acceptable, exact) and cell (r1 to r20, rall): hits, denom, share, low, high."""
    names = [f"r{k}" for k in CUTS] + ["rall"]
    cells = ", ".join(f"'{c}', {c}" for c in names)
    long = None
    for kind, column in (("acceptable", "hit_rank"), ("exact", "hit_rank_correct")):
        mine = recall(rows, column).selectExpr("mode", f"'{kind}' as kind", "denom", f"stack({len(names)}, {cells}) as (cell, hits)")
        long = mine if long is None else long.unionByName(mine)
    share, low, high = wilson(F.col("hits"), F.col("denom"))
    return long.select("mode", "kind", "cell", "hits", "denom", share.alias("share"), low.alias("low"), high.alias("high"))


def rank_bin(rank: Column) -> Column:
    return F.when(rank.isNull(), "miss").when(rank == 1, "1").when(rank <= 3, "2-3").when(rank <= 5, "4-5").when(rank <= 10, "6-10").otherwise(">10")


def rank_bins(rows: DataFrame) -> DataFrame:
    """Per mode and bin the number of matches; empty bins stay."""
    found = F.when(F.col("label") == "match", rank_bin(F.col("hit_rank")))
    wide = rows.groupBy("mode").agg(*[F.count_if(found == b).alias(f"b{i}") for i, b in enumerate(BINS)])
    cells = ", ".join(f"'{b}', {i}, b{i}" for i, b in enumerate(BINS))
    return wide.selectExpr("mode", f"stack({len(BINS)}, {cells}) as (bin, place, n)")


def class_breakdown(rows: DataFrame) -> DataFrame:
    """Per mode and class: n, r1, r10, rall, and the place by n descending, then name. A blank class is (unknown)."""
    named = matched(rows).withColumn("class", blank_to(F.col("class"), "(unknown)"))
    out = named.groupBy("mode", "class").agg(F.count("*").alias("n"), _within("hit_rank", 1).alias("r1"), _within("hit_rank", 10).alias("r10"), _within("hit_rank", None).alias("rall"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("n"), "class")))


def hit_status(label: Column, rank: Column, k: int) -> Column:
    """What a query's card says; a null label means that the query is not in the truth."""
    return (
        F.when(label.isNull(), "not in truth").when(label != "match", F.concat(F.lit("skipped: "), label)).when(rank.isNull(), "miss")
        .when(rank <= k, F.concat(F.lit("hit at "), rank)).otherwise(F.concat(F.lit("hit beyond "), F.lit(k)))
    )


def hits_misses(rows: DataFrame, k: int = 5) -> DataFrame:
    """mode, query_id, hit_rank, part (hit, miss, skipped) and place: hits by rank, the rest by id."""
    part = F.when(F.col("label") != "match", "skipped").when(F.col("hit_rank") <= k, "hit").otherwise("miss")
    out = rows.withColumn("part", part)
    w = Window.partitionBy("mode", "part").orderBy(F.when(F.col("part") == "hit", F.col("hit_rank")).otherwise(0), "query_id")
    return out.select("mode", "query_id", "hit_rank", "part", F.row_number().over(w).alias("place"))


def hit_mark(correct: Column, acceptable: Column) -> Column:
    """Two marks for the correct row, one for another acceptable row, else nothing; null counts as false."""
    return F.when(F.coalesce(correct, F.lit(False)), "**").when(F.coalesce(acceptable, F.lit(False)), "*").otherwise("")


def hit_marker(uuid: Column, correct: Column, acceptable: Column) -> Column:
    """hit_mark of a row against a correct id and an array of acceptable ones; an empty id never matches."""
    return hit_mark(uuid == correct, F.array_contains(acceptable, uuid))
