"""Exact top-k inner products: a KD-tree in each shard, best-first search with box bounds and a propagated kth score."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import of, written
from lodestone.llm.vector_dedup import finite

EXACT = float(1 << 53)
#: Least rows of a shard, bytes of its components at most, and the number of shards up to which smaller ones are preferred, so that all cores search.
LEAST_ROWS, SHARD_BYTES, SPREAD = 4096, 32 << 20, 256


class Tree:
    """KD-tree by median splits on the widest side; every node has the tight box of its points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 128):
        order = np.argsort(ids, kind="stable")
        self.points, self.ids = points[order], ids[order]
        # all sums of products are whole numbers below 2^53, else Python's integers take over
        reach = np.abs(points).max(initial=0.0)
        self.reach = float(reach)
        lows, highs, self.spans, self.kids = [], [], [], []
        place = np.arange(len(points))
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            mine = self.points[place[a:b]]
            low, high = mine.min(axis=0), mine.max(axis=0)
            lows.append(low)
            highs.append(high)
            self.spans.append((a, b))
            wide = high - low
            if b - a > leaf and wide.max(initial=0.0) > 0:
                axis = int(np.argmax(wide))
                mid = (b - a) // 2
                place[a:b] = place[a:b][np.argpartition(mine[:, axis], mid)]
                self.kids.append((a, a + mid, b))
                todo += [(a, a + mid), (a + mid, b)]
            else:
                place[a:b] = np.sort(place[a:b])
                self.kids.append(None)
        at = {span: i for i, span in enumerate(self.spans)}
        self.kids = [k and (at[k[0], k[1]], at[k[1], k[2]]) for k in self.kids]
        self.points, self.ids = self.points[place], self.ids[place]
        self.low, self.high = np.array(lows), np.array(highs)

    def search(self, query: np.ndarray, own: int | None, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, among points whose score reaches floor and whose id is not own. Scores are whole numbers of any size."""
        exact = self.reach * float(np.abs(query).max(initial=0.0)) * len(query) < EXACT
        # a box cannot give more than its better corner on every axis; the margin covers sums beyond 2^53, and a bound beyond all doubles spares nothing
        with np.errstate(over="ignore", invalid="ignore"):
            bound = np.nan_to_num(np.maximum(query, 0) @ self.high.T + np.minimum(query, 0) @ self.low.T, nan=np.inf, neginf=-np.inf, posinf=np.inf)
            margin = 0.0 if exact else float(np.abs(bound).max()) * 1e-9
        mine = None if exact else [int(x) for x in query]
        heap, best = [(-bound[0], 0)], []
        while heap:
            top, node = heapq.heappop(heap)
            least = best[0][0] if len(best) == k else floor
            if margin < np.inf and -top + margin < least:
                break
            if kids := self.kids[node]:
                for child in kids:
                    if margin == np.inf or bound[child] + margin >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.spans[node]
            if exact:
                scores = self.points[a:b] @ query
                near = np.flatnonzero(scores >= least).tolist()
            else:
                scores = [sum(p * q for p, q in zip(map(int, row), mine)) for row in self.points[a:b]]
                near = [i for i, score in enumerate(scores) if score >= least]
            ids = self.ids[a:b]
            for i in near:
                if own is not None and ids[i] == own:
                    continue
                found = (scores[i], -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return [(int(s), -i) for s, i in sorted(best, reverse=True)]


MOST = (1 << 63) - 1
#: Bytes that hold any score of doubles, moved up so that it is not negative.
WIDE = 288


def _long(score: int) -> int:
    return max(~MOST, min(MOST, score))


def _beyond(score: int) -> bytes | None:
    """For a score beyond 64 bits a text of bytes that sorts as the score does, else nothing."""
    return None if ~MOST < score < MOST else (score + (1 << (8 * WIDE - 1))).to_bytes(WIDE, "big")


def _search(rows: DataFrame, k: int, leaf: int) -> DataFrame:
    """rows: shard, kind (0 a point, 1 a query), id, vector, floor; points of a shard come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, points, ids, tree = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            shards, kinds, names = (batch.column(i).to_pylist() for i in range(3))
            vectors, floors = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for s, kind, name, vector, floor in zip(shards, kinds, names, vectors, floors):
                if s != shard:
                    shard, points, ids, tree = s, [], [], None
                if kind == 0:
                    points.append(np.frombuffer(vector, np.float64))
                    ids.append(name)
                    continue
                if tree is None and points:
                    tree = Tree(np.stack(points), np.array(ids, np.int64), leaf)
                    points, ids = [], []
                if tree is not None:
                    for score, other in tree.search(np.frombuffer(vector, np.float64), name, k, -np.inf if floor is None else float(floor)):
                        out.append((name, vector, other, _long(score), _beyond(score)))
            cols = list(zip(*out)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["id", "vector", "other", "score", "beyond"])

    parts = rows.repartition("shard").sortWithinPartitions("shard", "kind")
    return parts.select("shard", "kind", "id", "vector", "floor").mapInArrow(run, "id long, vector binary, other long, score long, beyond binary")


def rows_of_a_shard(n: int, dim: int) -> int:
    """Rows a shard takes of a table of n: as few as make SPREAD shards, but no fewer than LEAST_ROWS, and no more than SHARD_BYTES hold."""
    most = max(1, SHARD_BYTES // (8 * max(1, dim)))
    return min(most, max(LEAST_ROWS, -(-n // SPREAD)))


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: float = 256.0, shard_rows: int | None = None, leaf: int = 128) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row whose id is divisible by `every` its k best rows by integer inner product.

    Components become floor(scale * x) with x as double. Null vectors and those with null or non-finite components (also such as scale makes non-finite) take no part, nor do
    rows with a null id; vectors of another dimension than a query's are no candidates. A query's own rows are those with its id; repeated candidate rows each count; a
    repeated query row is one query. Empty vectors score 0. Scores beyond 64 bits are ranked as they are and then shown as the nearest 64-bit number. Other columns are not read.

    Shards hold about shard_rows rows by hash, so a tree fits a task; unless given, shards grow with the table up to SHARD_BYTES, as a query is sent once to
    each of them. Each query first searches its home shard; its kth score there goes with it to all others, which return only rows that reach it.
    Queries stream past the trees in batches.
    """
    spark = df.sparkSession

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = np.floor(np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64) * scale)
            ends = np.cumsum([0, *(len(x) for x in lists)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([values[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()), pa.array(np.diff(ends).astype(np.int32))], names=["id", "vector", "dim"])

    ok = of(id_col).isNotNull() & of(vector_col).isNotNull() & finite(F.transform(of(vector_col), lambda x: x.cast("double") * F.lit(float(scale))))
    rows = df.where(ok).select(of(id_col).cast("long").alias("id"), of(vector_col).alias("vector")).mapInArrow(floors, "id long, vector binary, dim int")
    n, widest = df.agg(F.count("*"), F.max(F.size(of(vector_col)))).first()
    if shard_rows is None:
        shard_rows = rows_of_a_shard(n, widest or 1)
    shards = max(1, -(-n // shard_rows))
    place = F.struct("dim", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int").alias("part"))
    points = rows.select(place.alias("shard"), F.lit(0).alias("kind"), "id", "vector", F.lit(None).cast("long").alias("floor"))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).distinct()
    asked = queries.select(place.alias("shard"), F.lit(1).alias("kind"), "id", "vector", F.lit(None).cast("long").alias("floor"))
    home, _ = written(_search(points.unionByName(asked), k, leaf), "home")  # read twice below
    kth = home.groupBy("id", "vector").agg(F.when((F.count("*") >= k) & (F.min("score") > ~MOST), F.min("score")).alias("floor"))
    sent = queries.join(kth, ["id", "vector"], "left").withColumn("own", place["part"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("part <> own")
    sent = sent.select(F.struct("dim", "part").alias("shard"), F.lit(1).alias("kind"), "id", "vector", "floor")
    away = _search(points.unionByName(sent), k, leaf)
    order = "row_number() over (partition by id, vector order by score desc, beyond desc nulls first, other) as rank"
    return home.unionByName(away).selectExpr("id as query_id", order, "other as vec_id", "score").where(F.col("rank") <= k)
