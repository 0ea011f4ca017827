"""Centroid clustering: ball k-means on integer vectors. Clusters are balls; a member is compared with the neighbours its ring reaches only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm.common import of, remove, written
from lodestone.llm.vector_dedup import finite

EXACT = 1 << 53
LONG = (1 << 63) - 1
#: Components below this are kept as 16-bit numbers, 128 bytes for 64 of them.
NARROW = 1 << 15


def packed(values: np.ndarray) -> list[bytes]:
    """Rows of whole doubles as bytes: 16-bit integers where all of a row's numbers fit, else doubles."""
    narrow = np.abs(values).max(axis=1, initial=0.0) < NARROW
    return [(row.astype("<i2") if small else row.astype("<f8")).tobytes() for row, small in zip(values, narrow)]


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim))
    for kind, size in (("<i2", 2 * dim), ("<f8", 8 * dim)):
        at = [i for i, row in enumerate(rows) if len(row) == size]
        if at:
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(len(at), dim)
    return out


def whole(values: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, centroids) as doubles if every squared distance is exact so, else as Python's integers."""
    reach = max(float(np.abs(values).max(initial=0.0)), *(float(max(map(abs, c), default=0)) for c in centroids))
    if 4 * reach * reach * max(1, values.shape[1]) < EXACT:
        return values, np.array(centroids, np.float64)
    exact = np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)
    return exact, np.array(centroids, object)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    apart = x - y
    return (apart * apart).sum(axis=1)


def ball_assign(x: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of every row of x, ties to the smaller number; own is the cluster a row comes from.

    The rows of one cluster are a ball round its centroid. Centroid j is a neighbour if it lies within twice the ball's radius, and
    only members at least half way to it, its ring, can be as near to j as to their own: members inside of all rings are the stable core.
    """
    near, best = own.copy(), squared(x, centroids[own])
    for i in np.unique(own).tolist():
        members = np.flatnonzero(own == i)
        home = best[members]
        between = squared(centroids, centroids[i])
        around = [j for j in np.argsort(between, kind="stable").tolist() if j != i and between[j] <= 4 * home.max()]
        for j in around:  # from the nearest neighbour out, so rings only shrink
            ring = members[4 * home >= between[j]]
            to = squared(x[ring], centroids[j])
            closer = (to < best[ring]) | ((to == best[ring]) & (j < near[ring]))
            best[ring[closer]], near[ring[closer]] = to[closer], j
    return near, best


def assign(points: DataFrame, centroids: list[list[int]], dim: int) -> DataFrame:
    """points (id, vector, cluster) with the nearest of centroids, and its squared distance; then a row for each cluster a task has met: vector is null, sums and n are its members'.

    Squared distances beyond 64 bits are compared as they are and shown as the largest 64-bit number. Sums are decimal texts, as they have no limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((len(centroids), dim), object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                values = unpacked(part.column(1).to_pylist(), dim)
                x, y = whole(values, centroids)
                near, best = ball_assign(x, part.column(2).to_numpy().astype(np.int64), y)
                for j in np.unique(near).tolist():  # doubles whose squares are exact are below 2^26, so 4096 of them add up exactly
                    mine = x[near == j]
                    sums[j] += np.array([int(v) for v in mine.sum(axis=0)], object)
                    count[j] += len(mine)
                n = part.num_rows
                distance = pa.array([min(int(v), LONG) for v in best], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near.astype(np.int32)), distance, pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.int64())], names=names)
        met = np.flatnonzero(count).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(met), kind), pa.nulls(len(met), pa.binary()), pa.array(met, pa.int32()), pa.nulls(len(met), pa.int64()), pa.array([[str(v) for v in sums[j]] for j in met], pa.list_(pa.string())), pa.array(count[met])], names=names
        )

    kind = to_arrow_type(points.schema["id"].dataType)
    schema = T.StructType([points.schema["id"], *T._parse_datatype_string("vector binary, cluster int, distance long, sums array<string>, n long").fields])
    names = schema.names
    return points.select("id", "vector", "cluster").mapInArrow(run, schema)


def moved(found: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """centroids, each replaced by floor(sum / count) of its vectors; one without vectors stays. The tasks' partial sums meet by cluster, a row a task; k rows reach the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(centroids[0]), object)
        for row in table["sums"].to_pylist():
            total += np.array([int(v) for v in row], object)
        return pa.table({"cluster": table["cluster"][:1], "sums": pa.array([[str(v) for v in total]], pa.list_(pa.string())), "n": pa.array([sum(table["n"].to_pylist())], pa.int64())})

    out = list(centroids)
    for row in found.where("vector is null").select("cluster", "sums", "n").groupBy("cluster").applyInArrow(add, "cluster int, sums array<string>, n long").collect():
        out[row["cluster"]] = [int(v) // row["n"] for v in row["sums"]]
    return out


def first_draw(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)


def ball_kmeans(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, scale: float = 64.0, seed: str = "1") -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each row of df whose vector has dim components, none null or non-finite.

    A component x becomes floor(scale * x). Centroids start as the k vectors with the least sha256 of "seed:id" (a null id is written null; of rows with one id the least bytes come
    first; fewer rows make fewer centroids). A round assigns every vector and then moves each centroid to its vectors' floored mean; after the last round vectors are
    assigned once more. All of it is exact at any size: where doubles could round, Python's integers take over. Distances and sums beyond 64 bits show as the largest
    64-bit number. Repeated rows count each; an empty table gives no rows; other columns are not read.

    Each round reads the last one's table (vectors and clusters) and writes its own to the shared folder, so lineage is cut and no row is shuffled; k centroids are sent.
    """

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.floor(np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, dim) * scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed(values), pa.binary())], names=["id", "vector"])

    key, vector = of(id_col), of(vector_col)
    ok = (F.size(vector) == dim) & finite(F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale))))
    rows = df.where(ok).select(key.alias("id"), vector.alias("vector"))
    kept, path = written(rows.mapInArrow(codes, T.StructType([rows.schema["id"], T.StructField("vector", T.BinaryType())])), "points")
    start = kept.select(first_draw(seed, F.col("id")).alias("draw"), "vector").orderBy("draw", "vector").limit(k).collect()
    centroids = [[int(v) for v in unpacked([bytes(r["vector"])], dim)[0]] for r in start]
    points = kept.withColumn("cluster", F.lit(0))
    for turn in range(rounds + 1 if centroids else 0):
        found, at = written(assign(points, centroids, dim), f"round{turn}")
        remove(df.sparkSession, path)
        path, points = at, found.where("vector is not null")
        if turn < rounds:
            centroids = moved(found, centroids)
    inertia = {r["cluster"]: int(r["total"]) for r in points.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()} if centroids else {}
    told = [(j, min(v, LONG), min(sum(inertia.values()), LONG), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, v in inertia.items()]
    named = df.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    if not centroids:
        points = points.withColumn("distance", F.lit(0).cast("long"))
    return points.select("id", "cluster", "distance").join(F.broadcast(named), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
