"""Ranked relations: scoring, order, thresholds, fusion, re-ranking, calibration.

A DataFrame has no order, so rank is a column. Scores are rounded before they are ranked and ties go to the smaller uuid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.sizes import MOST_ROWS

# Rank constant of the fusion, rows re-ranked, highest confidence.
RRF_K = 60
HEAD = 20
MOST_CONFIDENT = 0.97
# Default slope and offset of each mode's sigmoid, ours.
CURVES = {"bm25f": (0.6, -1.5), "semantic": (8.0, -2.0), "hybrid": (6.0, -3.0), "reranker": (1.0, 0.0)}


@dataclass(frozen=True)
class Fusion:
    """Parameters of the fused modes; pool is asymmetric (only fuzzy survivors have a lexical rank) or symmetric (the whole corpus has)."""

    k: int = RRF_K
    w_bm25: float = 1.0
    w_sem: float = 1.0
    pool: str = "asymmetric"


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double precision; of unit vectors the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score_vectors(queries: DataFrame, corpus: DataFrame, k: int | None = None, most_broadcast: int = 20_000) -> DataFrame:
    """Rows (query_id, uuid, score) of every query with every corpus row that has as many components: queries (query_id, v), corpus (uuid, v); with k only rows that can be
    among a query's k best. Rows without a vector are left out.

    Comparing a stated query set with all rows is the operator itself. The query side is counted: up to most_broadcast queries
    are sent to the tasks as a matrix, and each batch of the corpus gives one matrix product; with k a batch gives no more than k rows a query, ties with the kth aside. A larger query
    side is cut into blocks of that many. With k they meet blocks of the corpus as matrices, which give as few rows; without, each block meets each corpus partition in turn.
    """
    spark = queries.sparkSession
    asked, rows = queries.select("query_id", "v").where("v is not null"), corpus.select("uuid", "v").where("v is not null")
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("uuid", rows.schema["uuid"].dataType), T.StructField("score", T.DoubleType())])
    n = asked.count()
    if n > most_broadcast:
        blocks = -(-n // most_broadcast)
        asked = asked.select("query_id", F.col("v").alias("q"), F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)).alias("b"))
        rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
        if k is None:
            pairs = rows.join(asked, "b").where(F.size("q") == F.size("v"))
            return pairs.select("query_id", "uuid", F.round(dot("q", "v"), 6).alias("score"))
        cuts = -(-corpus.count() // most_broadcast) or 1
        rows = rows.withColumns({"c": F.pmod(F.xxhash64("uuid", "v"), F.lit(cuts)), "d": F.size("v")})
        asked = asked.withColumns({"c": F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)).cast("array<long>")), "d": F.size("q")})

        def tile(left: pa.Table, right: pa.Table) -> pa.Table:
            none = pa.table({f.name: pa.array([], t) for f, t in zip(schema.fields, (left["query_id"].type, right["uuid"].type, pa.float64()))})
            if not (len(left) and len(right)):
                return none
            names = right["uuid"].combine_chunks()
            return pa.Table.from_batches(list(best_pairs(left["query_id"].combine_chunks(), matrix(left["q"]), names, matrix(right["v"]), k)))

        return asked.groupBy("b", "c", "d").cogroup(rows.groupBy("b", "c", "d")).applyInArrow(tile, schema)
    by_size: dict[int, tuple[list, list]] = {}
    for row in asked.collect():
        ids, vectors = by_size.setdefault(len(row["v"]), ([], []))
        ids.append(row["query_id"])
        vectors.append(row["v"])
    sent = spark.sparkContext.broadcast({d: (pa.array(ids), np.array(vectors, np.float64)) for d, (ids, vectors) in by_size.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum([0, *sizes])
            for size, (ids, asked_rows) in sent.value.items():
                mine = np.flatnonzero(sizes == size)
                if not len(mine):
                    continue
                x = flat[(ends[mine][:, None] + np.arange(size)).ravel()].reshape(len(mine), size)
                yield from best_pairs(ids, asked_rows, batch.column(0).take(pa.array(mine)), x, k)

    return rows.mapInArrow(run, schema)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of one length as a matrix of doubles."""
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def best_pairs(ids: pa.Array, asked: np.ndarray, names: pa.Array, rows: np.ndarray, k: int | None) -> Iterator[pa.RecordBatch]:
    """query_id, uuid, score of the products of two matrices, a million at a time; with k only those that reach a query's kth score."""
    step = max(1, (1 << 20) // len(rows))
    for at in range(0, len(ids), step):
        scores = np.round(asked[at : at + step] @ rows.T, 6) + 0.0
        if k is None or k >= len(rows):
            q, c = np.divmod(np.arange(scores.size), len(rows))
        else:  # ties with the kth stay, as ids decide among them later
            least = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
            q, c = np.nonzero(scores >= least[:, None])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + at)), names.take(pa.array(c)), pa.array(scores[q, c])], names=["query_id", "uuid", "score"])


def ranked(scored: DataFrame, *keys: str, k: int | None = None) -> DataFrame:
    """scored with rank from 1 within each query; with k only the first k, which Spark prunes before the shuffle."""
    w = Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "uuid")
    out = scored.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def threshold_top(rows: DataFrame, least: float, k: int) -> DataFrame:
    """Rows of score least or more, or without a score, numbered anew, the first k of each query."""
    kept = rows.where(F.col("score").isNull() | (F.col("score") >= least)).drop("rank")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "uuid")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(left: DataFrame, right: DataFrame, k: int = RRF_K, w_left: float = 1.0, w_right: float = 1.0) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked relations: query_id, uuid, left_rank, right_rank, raw, normalised, rank."""
    both = left.select("query_id", "uuid", F.col("rank").alias("left_rank")).join(right.select("query_id", "uuid", F.col("rank").alias("right_rank")), ["query_id", "uuid"], "full")
    part = lambda w, c: F.coalesce(F.lit(w) / (k + F.col(c)), F.lit(0.0))
    fused = both.withColumn("raw", F.round(part(w_left, "left_rank") + part(w_right, "right_rank"), 9)).where("raw > 0")
    most = (w_left + w_right) / (k + 1)
    fused = fused.withColumn("normalised", F.least(F.lit(1.0), F.round(F.col("raw") / most, 6)))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "uuid")))


def calibrated(score: Column, mode: str, curves: dict[str, tuple | list] = CURVES) -> Column:
    """The mode's confidence of a raw score, at most MOST_CONFIDENT: a sigmoid from (slope, offset), or fitted steps from a list of (from, value)."""
    fitted = curves[mode]
    value = stepped(score, fitted) if isinstance(fitted, list) else 1 / (1 + F.exp(-(F.lit(fitted[0]) * score + F.lit(fitted[1]))))
    return F.round(F.least(F.lit(MOST_CONFIDENT), value), 6)


def stepped(score: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise constant calibration: the value of the last breakpoint that score reaches, the first one's below all and for null.

    Breakpoints are two constant arrays, searched by halves, so the plan stays small however many there are.
    """
    ordered = sorted((float(at), float(value)) for at, value in points)
    constant = lambda xs: F.split(F.lit(",".join(map(repr, xs))), ",").cast("array<double>")
    starts, values, n = constant([at for at, _ in ordered]), constant([value for _, value in ordered]), len(ordered)

    def halve(range_: Column, _: Column) -> Column:
        middle = F.floor((range_["low"] + range_["high"]) / 2).cast("int")
        reached = (range_["low"] < range_["high"]) & F.coalesce(score >= F.get(starts, middle), F.lit(False))
        return F.struct(F.when(reached, middle + 1).otherwise(range_["low"]).alias("low"), F.when(reached | (range_["low"] == range_["high"]), range_["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), halve)
    return F.get(values, F.greatest(found["low"] - 1, F.lit(0)))


def rerank(rows: DataFrame, logits: DataFrame, head: int = HEAD, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """rows (*keys, uuid, score, rank) with the first `head` of each query put in order of logit.

    logits: *keys, uuid, logit. A query whose head is not wholly scored keeps its first order (fallback true). The tail keeps
    its place. Adds logit, rank_before, moved; rank is the new one.
    """
    top = rows.where(F.col("rank") <= head).join(logits.select(*keys, "uuid", "logit"), [*keys, "uuid"], "left")
    own = Window.partitionBy(*keys)
    top = top.withColumn("fallback", F.count("logit").over(own) < F.count("*").over(own))
    by = F.when(F.col("fallback"), 0.0).otherwise(F.col("logit"))
    top = top.withColumn("new", F.row_number().over(own.orderBy(by.desc(), "rank")))
    tail = rows.where(F.col("rank") > head).withColumns({"logit": F.lit(None).cast("double"), "fallback": F.lit(False), "new": F.col("rank")})
    both = top.unionByName(tail.select(*top.columns))
    return both.withColumnRenamed("rank", "rank_before").withColumnRenamed("new", "rank").withColumn("moved", F.col("rank_before") - F.col("rank"))


def first_hits(scored: DataFrame, relevant: Column, n_queries: int) -> DataFrame:
    """Rows (query_id, hit_rank) from scored rows: the rank of the first relevant one, null where there is none.

    Two aggregations by query, both with partial sums: the best relevant row, then how many rows stand before it. The scored
    rows themselves are neither sorted nor shuffled while the queries are few enough for their best rows to be broadcast.
    """
    best = scored.groupBy("query_id").agg(F.max(F.when(relevant, F.struct("score", (-F.col("uuid")).alias("turned")))).alias("best"))
    side = F.broadcast(best) if n_queries <= MOST_ROWS else best
    before = scored.join(side, "query_id").groupBy("query_id").agg(
        F.count_if(F.struct("score", (-F.col("uuid")).alias("turned")) > F.col("best")).alias("n"), F.first("best").isNull().alias("none")
    )
    return before.select("query_id", F.when(~F.col("none"), F.col("n") + 1).cast("int").alias("hit_rank"))


#: Queries and rows of a tile, products made at a time, pairs that are computed exactly at a time, and groups that labels are dealt to.
MOST_ASKED, MOST_HELD, PRODUCTS, EXACT, GROUPS = 16_384, 32_768, 1 << 22, 1 << 16, 64


def vector_first_hits(queries: DataFrame, corpus: DataFrame, most_asked: int = MOST_ASKED, most_held: int = MOST_HELD) -> DataFrame:
    """first_hits of all products of queries (query_id, v, cluster) and rows (uuid, v, cluster); rows of the query's cluster are the relevant ones.

    The best relevant row is looked for among the rows of the cluster alone; then all rows that stand before it are counted. Blocks of either side meet as matrices in a task, and only
    one row a query leaves it. Products are made in single precision; pairs that this cannot tell from the score they are compared with are computed again in double precision.
    """
    asked = queries.select("query_id", "v", "cluster").where("v is not null").withColumn("d", F.size("v"))
    # columns of their own, as both sides may be parts of one table
    held = corpus.select("uuid", F.col("v").alias("v"), F.col("cluster").alias("cluster")).where("v is not null").withColumn("d", F.size("v"))
    grouped = lambda df: df.where("cluster is not null").withColumn("g", F.pmod(F.xxhash64("cluster"), F.lit(GROUPS)))
    found = _met(grouped(asked), grouped(held), most_asked, most_held).applyInArrow(_best_of_cluster, "query_id long, score double, uuid long")
    # NaN is the highest score, in Spark and in SQL
    best = found.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("uuid")).alias("turned"))).alias("best")).select("query_id", F.col("best.score").alias("score"), (-F.col("best.turned")).alias("best"))
    before = _met(asked.join(best, "query_id").withColumn("g", F.lit(0)), held.withColumn("g", F.lit(0)), most_asked, most_held).applyInArrow(_rows_before, "query_id long, n long")
    ranks = before.groupBy("query_id").agg((F.sum("n") + 1).cast("int").alias("hit_rank"))
    scored = asked.join(held.select("d").distinct(), "d", "left_semi").select("query_id").distinct()
    return scored.join(ranks, "query_id", "left").select("query_id", "hit_rank")


def _met(asked: DataFrame, held: DataFrame, most_asked: int, most_held: int):
    """Both sides in blocks a and b, so that each block of asked meets each block of held that has its group g and its number of components d."""
    counts = [df.groupBy("g", "d").agg(F.ceil(F.count("*") / most).cast("int").alias(n)) for df, most, n in ((asked, most_asked, "na"), (held, most_held, "nb"))]
    blocks = F.broadcast(counts[0].join(counts[1], ["g", "d"]))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(blocks, ["g", "d"]).withColumn("a", own("query_id", "na")).withColumn("b", every("nb")).drop("na", "nb")
    right = held.join(blocks, ["g", "d"]).withColumn("b", own("uuid", "nb")).withColumn("a", every("na")).drop("na", "nb")
    return left.groupBy("g", "d", "a", "b").cogroup(right.groupBy("g", "d", "a", "b"))


def _products(q: np.ndarray, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For some queries at a time: which they are, their products with x in single precision, how far each query's may lie from the rounded ones, and which products are not to be
    relied on at all (those of vectors that are not finite)."""
    with np.errstate(all="ignore"):
        q4, x4 = q.astype(np.float32), x.astype(np.float32)
        sizes = [np.sqrt((v * v).sum(axis=1)) for v in (q, x)]
        bad_q, bad_x = (~np.isfinite(n) | (n > 1e18) for n in sizes)
        slack = (q.shape[1] + 8) * 2.0**-23 * np.where(bad_q, 0.0, sizes[0]) * np.where(bad_x, 0.0, sizes[1]).max() + 1e-6
        step = max(1, PRODUCTS // len(x))
        for at in range(0, len(q), step):
            some = slice(at, at + step)
            yield some, q4[some] @ x4.T, slack[some], bad_q[some, None] | bad_x


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rounded products of rows i of q with rows j of x."""
    out = np.empty(len(i))
    with np.errstate(all="ignore"):
        for at in range(0, len(i), EXACT):
            out[at : at + EXACT] = np.round(np.einsum("ij,ij->i", q[i[at : at + EXACT]], x[j[at : at + EXACT]]), 6) + 0.0
    return out


def _best_of_cluster(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of each query the row of its cluster with the highest score, of these the smallest uuid."""
    out: list[tuple[np.ndarray, ...]] = []
    if len(left) and len(right):
        left, right = left.sort_by("cluster"), right.sort_by("cluster")
        ids, uuids, q, x = left["query_id"].to_numpy(), right["uuid"].to_numpy(), matrix(left["v"]), matrix(right["v"])
        mine, kinds = left["cluster"].to_numpy(), right["cluster"].to_numpy()
        for kind in np.intersect1d(mine, kinds):
            a, b = (slice(np.searchsorted(c, kind), np.searchsorted(c, kind, "right")) for c in (mine, kinds))
            for some, products, slack, bad in _products(q[a], x[b]):
                most = np.where(bad, -np.inf, products).max(axis=1) if bad.any() else products.max(axis=1)
                i, j = np.nonzero((products >= (most - 2 * slack)[:, None]) | bad)
                scores = _exact(q[a][some], x[b], i, j)
                order = np.lexsort((uuids[b][j], -np.nan_to_num(scores, posinf=np.inf, neginf=-np.inf), ~np.isnan(scores), i))
                _, first = np.unique(i[order], return_index=True)
                chosen = order[first]
                out.append((ids[a][some][i[chosen]], scores[chosen], uuids[b][j[chosen]]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "score": pa.array(columns[1], pa.float64(), from_pandas=False), "uuid": pa.array(columns[2], pa.int64())})


def _rows_before(left: pa.Table, right: pa.Table) -> pa.Table:
    """How many rows stand before a query's best relevant one (score, best)."""
    ids, counts = [], []
    if len(left) and len(right):
        uuids, q, x = right["uuid"].to_numpy(), matrix(left["v"]), matrix(right["v"])
        names, score, best = left["query_id"].to_numpy(), left["score"].to_numpy(), left["best"].to_numpy()
        for some, products, slack, bad in _products(q, x):
            least = score[some]
            # a comparison with NaN, the highest score, is false
            above = (products > (least + slack)[:, None]) & ~bad if bad.any() else products > (least + slack)[:, None]
            i, j = np.nonzero(((products >= (least - slack)[:, None]) & ~above) | bad | np.isnan(least)[:, None])
            scores, asked = _exact(q[some], x, i, j), least[i]
            same = (scores == asked) | (np.isnan(scores) & np.isnan(asked))
            before = (np.isnan(scores) & ~np.isnan(asked)) | (scores > asked) | (same & (uuids[j] < best[some][i]))
            ids.append(names[some])
            counts.append(np.count_nonzero(above, axis=1) + np.bincount(i[before], minlength=len(least)))
    return pa.table({"query_id": pa.array(np.concatenate(ids) if ids else [], pa.int64()), "n": pa.array(np.concatenate(counts) if counts else [], pa.int64())})
