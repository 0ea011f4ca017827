"""Significance: exact McNemar tests, bootstrap intervals, changes between modes and ladder steps."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Resamples and seed of the bootstrap, thresholds of the verdicts.
RESAMPLES, SEED = 1000, 42
HELPS, HURTS, FLAT = 0.015, -0.015, 0.002
MODES = ("regex", "fuzzy", "semantic", "hybrid", "hybrid+rerank", "semantic+rerank")


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p-value of discordant counts b and c; 1 when both are zero.

    The binomial terms follow from each other, t(i+1) = t(i) (n - i) / (i + 1), in logarithms so that large n does not underflow.
    """
    n, low = b + c, F.least(b, c)
    steps = F.when(low > 0, F.sequence(F.lit(0), (low - 1).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))

    def grow(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    return F.when(n == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, grow)["s"]), 6))


def mcnemar_matrix(rows: DataFrame, k: int = 1) -> DataFrame:
    """For each pair of modes: b (only the first hits within k), c (only the second), p. Pairs are joined on the query, so sets that differ cannot be paired by position."""
    hits = rows.where("label = 'match'").select("query_id", "mode", F.coalesce(F.col("hit_rank") <= k, F.lit(False)).alias("hit"))
    a, z = hits.selectExpr("query_id", "mode as mode_a", "hit as hit_a"), hits.selectExpr("query_id", "mode as mode_b", "hit as hit_b")
    pairs = a.join(z, "query_id").where("mode_a < mode_b").groupBy("mode_a", "mode_b").agg(F.count_if(F.col("hit_a") & ~F.col("hit_b")).alias("b"), F.count_if(F.col("hit_b") & ~F.col("hit_a")).alias("c"))
    return pairs.withColumn("p", mcnemar(F.col("b"), F.col("c"))).withColumn("significant", F.col("p") < 0.05).withColumn("shown", shown_p(F.col("p")))


#: Places that one block holds, draws that are made at a time, and draws of a task, about.
BLOCK, AT_ONCE, DRAWN = 4096, 1 << 18, 2_000_000


def draws(spark: SparkSession, sizes: list[int], resamples: int = RESAMPLES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Rows (n, block, i, places) of all draws of n out of n for each n of sizes: places is a list of those that resample i draws in a block, counted from the block's start.

    Tasks are dealt by the number of draws, which is known beforehand, and are made as asked for: they are no shuffle that could be put together by its few bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, i, low, high in zip(*(batch.column(c).to_pylist() for c in ("n", "i", "low", "high"))):
                head = b"%d:%d:" % (seed, i)
                places = np.fromiter((int.from_bytes(md5(head + b"%d" % j).digest()[:6], "big") for j in range(low, high)), np.int64, high - low) % n
                places.sort()
                blocks, starts = np.unique(places // block, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array([*starts, len(places)], pa.int32()), pa.array(places % block, pa.int32()))
                same = lambda x, t: pa.array(np.full(len(blocks), x), t)
                yield pa.RecordBatch.from_arrays([same(n, pa.int64()), pa.array(blocks, pa.int64()), same(i, pa.int32()), lists], names=["n", "block", "i", "places"])

    each = spark.createDataFrame([], "n long, i int, low long, high long")
    for n in sizes:
        parts = -(-n // AT_ONCE)
        at = F.col("id") % parts
        units = spark.range(0, resamples * parts, 1, max(1, min(resamples * parts, resamples * n // DRAWN + spark.sparkContext.defaultParallelism)))
        each = each.unionByName(units.select(F.lit(n).cast("long").alias("n"), (F.floor(F.col("id") / parts) + 1).cast("int").alias("i"), (at * AT_ONCE + 1).alias("low"), (F.least((at + 1) * AT_ONCE, F.lit(n)) + 1).alias("high")))
    return each.mapInArrow(run, "n long, block long, i int, places array<int>")


def bootstrap_means(rows: DataFrame, values: dict[str, Column], resamples: int = RESAMPLES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Per mode and measure: point, low, high of a 95 % percentile interval of the mean of each of values.

    Draw j of resample i is the query in place hash(seed, i, j) modulo n, so reruns and other engines draw alike. Modes with equally many queries share their draws, which are
    made once for all modes and measures, see draws. Places lie in blocks; a block's draws meet its queries' values in a task, which counts them by resample and place and gives
    one sum for each resample, mode and measure, so no task grows with the queries and no draw is a row.
    """
    names = list(values)
    wide = rows.select("mode", "query_id", *[v.cast("double").alias(m) for m, v in values.items()])
    sizes = wide.groupBy("mode").agg(F.count("*").alias("n"), *[F.avg(m).alias(f"point_{m}") for m in names])
    place = F.row_number().over(Window.partitionBy("mode").orderBy("query_id")) - 1
    numbered = wide.withColumn("place", place).join(F.broadcast(sizes.select("mode", "n")), "mode")
    held = numbered.select("n", F.floor(F.col("place") / block).alias("block"), (F.col("place") % block).cast("int").alias("at"), "mode", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in names])
    drawn = draws(rows.sparkSession, sorted(r["n"] for r in sizes.select("n").distinct().collect()), resamples, seed, block)

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            lists, modes, at = left["places"].combine_chunks(), right["mode"].to_numpy(), right["at"].to_numpy()
            width = int(at.max()) + 1
            spots = (np.repeat(left["i"].to_numpy().astype(np.int64) - 1, np.diff(lists.offsets.to_numpy()))) * width + lists.flatten().to_numpy()
            times = np.bincount(spots, minlength=resamples * width).reshape(resamples, width).astype(np.float64)
            for mode in sorted(set(modes)):
                mine = np.zeros((width, len(names)))
                mine[at[modes == mode]] = np.column_stack([right[m].to_numpy()[modes == mode] for m in names])
                sums = times @ mine
                out.append(pa.table({"mode": pa.array([mode] * resamples, pa.string()), "i": pa.array(np.arange(1, resamples + 1), pa.int32()), **{m: sums[:, k] for k, m in enumerate(names)}}))
        return pa.concat_tables(out) if out else pa.table({"mode": pa.array([], pa.string()), "i": pa.array([], pa.int32()), **{m: pa.array([], pa.float64()) for m in names}})

    parts = drawn.groupBy("n", "block").cogroup(held.groupBy("n", "block")).applyInArrow(tile, ", ".join(["mode string", "i int", *[f"`{m}` double" for m in names]]))
    means = parts.groupBy("mode", "i").agg(*[F.sum(m).alias(m) for m in names]).join(F.broadcast(sizes), "mode").select("mode", *[F.when(F.col(f"point_{m}").isNotNull(), F.col(m) / F.col("n")).alias(m) for m in names])
    bounds = means.groupBy("mode").agg(*[F.percentile(m, F.lit(q)).alias(f"{side}_{m}") for m in names for side, q in (("low", 0.025), ("high", 0.975))])
    cells = ", ".join(f"'{m}', round(point_{m}, 6), round(low_{m}, 6), round(high_{m}, 6)" for m in names)
    return sizes.join(bounds, "mode").selectExpr("mode", f"stack({len(names)}, {cells}) as (measure, point, low, high)")


def bootstrap_mean(rows: DataFrame, value: Column, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Per mode: point, low, high of one value's interval, see bootstrap_means."""
    return bootstrap_means(rows, {"value": value}, resamples, seed).drop("measure")


#: What the intervals of ranking quality are of.
QUALITY = {"mrr": "hit_rank", "mrr_correct": "hit_rank_correct"}


def ranking_intervals(rows: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """Bootstrap intervals of both reciprocal ranks and nDCG@10 per mode."""
    values = {m: F.coalesce(1.0 / F.col(c), F.lit(0.0)) for m, c in QUALITY.items()} | {"ndcg10": F.col("ndcg")}
    return bootstrap_means(rows, values, resamples)


def mode_order(mode: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MODES]), mode).cast("int")


def mode_delta(summary: DataFrame, column: str) -> DataFrame:
    """summary with the change of column from the mode before it that ran, in the canonical order of modes."""
    w = Window.orderBy("place")
    return summary.withColumn("place", mode_order(F.col("mode"))).withColumn("delta", F.round(F.col(column) - F.lag(column).over(w), 6))


def ladder_steps(steps: DataFrame) -> DataFrame:
    """steps (mode, step, label, mrr, ...) with delta from step 0, marginal change and best (the first maximum)."""
    w = Window.partitionBy("mode").orderBy("step")
    out = steps.withColumn("delta", F.round(F.col("mrr") - F.first("mrr").over(w), 6)).withColumn("marginal", F.round(F.col("mrr") - F.lag("mrr").over(w), 6))
    return out.withColumn("best", F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("mrr"), "step")) == 1)


def step_verdicts(steps: DataFrame, noise: tuple[str, ...], leave_out: tuple[str, ...] = ("fuzzy",)) -> DataFrame:
    """Per step after the first: mean marginal change over modes, modes that gained, verdict.

    In this order: a noise field, hurts at HURTS or less, helps at HELPS or more with gains in at least half the modes, else neutral. Only steps that every mode has count.
    """
    rows = ladder_steps(steps.where(~F.col("mode").isin(*leave_out)))
    modes = rows.select(F.count_distinct("mode").alias("modes"))
    by = rows.where("marginal is not null").groupBy("step", "label").agg(F.round(F.avg("marginal"), 6).alias("mean_delta"), F.count_if(F.col("marginal") > 0).alias("positives"), F.count("*").alias("have"))
    by = by.crossJoin(F.broadcast(modes)).where("have = modes")
    verdict = (
        F.when(F.col("label").isin(*noise), "noise").when(F.col("mean_delta") <= HURTS, F.when(F.col("label") == "categories", "hurts: too broad").otherwise("hurts"))
        .when((F.col("mean_delta") >= HELPS) & (F.col("positives") >= F.floor((F.col("modes") + 1) / 2)), "helps").otherwise("neutral")
    )
    return by.select("step", "label", "mean_delta", "positives", verdict.alias("verdict"))


def moved(delta: Column) -> Column:
    return F.when(delta > FLAT, "lifted").when(F.abs(delta) <= FLAT, "flat").otherwise("lowered")


def shown_p(p: Column) -> Column:
    """A p-value as a report shows it: three places, halves to even, and `<.001` below that."""
    return F.when(p < 0.001, "<.001").otherwise(F.format_string("%.3f", F.bround(p, 3)))
