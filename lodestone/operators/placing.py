"""Ranks of single rows, and first rows, without ranking all rows of a query.

Rows of the same texts are one form: they get the same score from any query, so forms are scored, and how many rows stand above a score is a sum over forms. Rows of one score
stand in the order of their uuid, so only scores that several forms share are spread out to rows, and only as far as they are asked for. Nothing is cut: every
rank is the one that row_number() over all rows gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import Fusion, matrix

#: How far rounding to nine decimals may move a fused score, and a little more.
SLACK = 2e-9
#: Scores of vectors are whole numbers of these parts, as they are rounded before they are ranked, and a place in a block of forms has this many bits below them.
PARTS, BITS = 1_000_000, 20
#: Most forms and queries of a tile, and products made at a time.
MOST_FORMS, MOST_ASKED, AT_ONCE = 16_384, 4_096, 1 << 21


class Levels:
    """Scores of forms (query_id, form, score) of rows members (uuid, form, n: from 1 by uuid within a form), forms (form, copies). keep is called on what is read more than once.

    held: query_id, form, score, copies, above (rows of a better score) and alike (forms of this score).
    """

    def __init__(self, scored: DataFrame, forms: DataFrame, members: DataFrame, keep: Callable[[DataFrame], DataFrame]):
        self.members = members
        # one shuffle and one order serve both windows; turned scores are in ascending order, as the keys of a window are
        counted = scored.join(forms.select("form", "copies"), "form").select("query_id", "form", "score", "copies", (-F.col("score")).alias("turned"))
        level = Window.partitionBy("query_id", "turned")
        down = F.sum("copies").over(Window.partitionBy("query_id").orderBy("turned"))
        self.held = keep(counted.select("query_id", "form", "score", "copies", (down - F.sum("copies").over(level)).alias("above"), F.count("*").over(level).alias("alike")))

    def sizes(self) -> DataFrame:
        """query_id and rows, the number of its rows."""
        return self.held.groupBy("query_id").agg(F.sum("copies").alias("rows"))

    def top(self, depth: DataFrame) -> DataFrame:
        """query_id, uuid, score, rank of the first `depth` rows of each query of depth (query_id, depth)."""
        near = self.held.join(depth, "query_id").where("above < depth").select("query_id", "form", "score", "above", (F.col("depth") - F.col("above")).alias("room"), "depth")
        return self._numbered(near.join(self.members, "form").where("n <= room"), "depth").where("rank <= depth").drop("depth")

    def place(self, wanted: DataFrame) -> DataFrame:
        """query_id, uuid, score, rank of the rows of wanted (query_id, uuid; each once) that are scored."""
        found = wanted.select("query_id", "uuid").join(self.members, "uuid").join(self.held, ["query_id", "form"])
        alone = found.where("alike = 1").select("query_id", "uuid", "score", (F.col("above") + F.col("n")).cast("int").alias("rank"))
        last = found.where("alike > 1").groupBy("query_id", "score").agg(F.max("uuid").alias("last"))
        before = self.held.where("alike > 1").join(last, ["query_id", "score"]).join(self.members, "form").where("uuid <= last")
        tied = self._numbered(before).join(wanted.select("query_id", "uuid"), ["query_id", "uuid"], "left_semi")
        return alone.unionByName(tied)

    @staticmethod
    def _numbered(rows: DataFrame, *carried: str) -> DataFrame:
        order = Window.partitionBy("query_id", "score").orderBy("uuid")
        return rows.select("query_id", "uuid", "score", (F.col("above") + F.row_number().over(order)).cast("int").alias("rank"), *carried)


class Shared:
    """Levels whose queries are shared: ids (query_id, own) name the query of levels that each query asks. Rows are found once for each different one."""

    def __init__(self, levels: Levels, ids: DataFrame):
        self.levels, self.ids = levels, ids

    def top(self, depth: DataFrame) -> DataFrame:
        """See Levels."""
        asked = depth.join(self.ids, "query_id")
        found = self.levels.top(asked.groupBy(F.col("own").alias("query_id")).agg(F.max("depth").alias("depth")))
        return asked.join(found.withColumnRenamed("query_id", "own"), "own").where("rank <= depth").select("query_id", "uuid", "score", "rank")

    def place(self, wanted: DataFrame) -> DataFrame:
        """See Levels."""
        asked = wanted.select("query_id", "uuid").join(self.ids, "query_id")
        found = self.levels.place(asked.select(F.col("own").alias("query_id"), "uuid").distinct())
        return asked.join(found.withColumnRenamed("query_id", "own"), ["own", "uuid"]).select("query_id", "uuid", "score", "rank")


def _tile(left: pa.Table, right: pa.Table) -> tuple[pa.Table, np.ndarray, pa.Table, np.ndarray, Iterator[tuple[int, np.ndarray]]]:
    """Both sides in the order of their ids, so that a product is made alike whenever it is made, the ids of both, and for some queries at a time (the first one's place, keys): a key
    is smaller the better the score, then the smaller the form; its last BITS are the form's place."""
    left, right = left.sort_by("query_id"), right.sort_by("form")
    q, x = matrix(left["v"]), matrix(right["v"])
    step = max(1, AT_ONCE // len(right))

    def keys() -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(left), step):
            parts = np.rint((q[at : at + step] @ x.T) * PARTS).astype(np.int64)
            yield at, (-parts << BITS) + np.arange(len(right))

    return left, left["query_id"].to_numpy(), right, right["form"].to_numpy(), keys()


class Tiles:
    """Levels of the products of vectors: asked (query_id, v, kind), rows (form, v, copies, kind), both kinds whole numbers; members (uuid, form, n) as for Levels.

    Products of a block of queries and one of forms are made in a task and made again for each question; only what was asked for leaves the task, so no row is ever written or
    shuffled for a product. keep is called on what is read more than once.
    """

    def __init__(self, asked: DataFrame, rows: DataFrame, members: DataFrame, keep: Callable[[DataFrame], DataFrame], most_forms: int = MOST_FORMS, most_asked: int = MOST_ASKED):
        self.members, self.keep = members, keep
        asked, rows = keep(asked), keep(rows)
        n, m = asked.count(), rows.count()
        tasks = 4 * asked.sparkSession.sparkContext.defaultParallelism
        self.blocks = max(1, -(-n // most_asked), min(tasks, -(-n // 256))), max(1, -(-m // most_forms))
        dealt = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
        self.asked, self.rows = asked.withColumn("a", dealt("query_id", self.blocks[0])), rows.withColumn("b", dealt("form", self.blocks[1]))

    def _met(self, asked: DataFrame, tile: Callable[[pa.Table, pa.Table], dict], schema: str) -> DataFrame:
        """What tile gives for each block of asked (query_id, v, a, ...) and each block of forms."""
        a, b = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in self.blocks)
        names = [x.split()[0] for x in schema.split(", ")]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            found = tile(left, right) if len(left) and len(right) else {c: [] for c in names}
            return pa.table({c: pa.array(found[c], pa.int64()) for c in names})

        return asked.withColumn("b", b).groupBy("a", "b").cogroup(self.rows.withColumn("a", a).groupBy("a", "b")).applyInArrow(run, schema)

    def sizes(self) -> DataFrame:
        """query_id and rows, the number of its rows: all."""
        return self.asked.select("query_id").crossJoin(F.broadcast(self.rows.agg(F.sum("copies").alias("rows"))))

    def named(self) -> DataFrame:
        """query_id and uuid of the first row of the query's kind."""

        def tile(left: pa.Table, right: pa.Table) -> dict:
            left, ids, right, forms, parts = _tile(left, right)
            mine, kinds, out = left["kind"].to_numpy(), right["kind"].to_numpy(), []
            none = np.iinfo(np.int64).max
            for at, keys in parts:
                best = np.where(mine[at : at + len(keys), None] == kinds, keys, none).min(axis=1)
                out.append((ids[at : at + len(keys)][best < none], best[best < none]))
            ids, best = (np.concatenate(x) for x in zip(*out))
            return {"query_id": ids, "parts": -(best >> BITS), "form": forms[best & ((1 << BITS) - 1)]}

        found = self._met(self.asked, tile, "query_id long, parts long, form long")
        return found.groupBy("query_id").agg(F.max(F.struct("parts", (-F.col("form")).alias("turned"))).alias("b")).select("query_id", (-F.col("b.turned")).alias("uuid"))

    def top(self, depth: DataFrame) -> DataFrame:
        """query_id, uuid, score, rank of the first `depth` rows of each query of depth (query_id, depth)."""

        def tile(left: pa.Table, right: pa.Table) -> dict:
            # a form has a row at least, so those that stand behind `depth` forms here hold no such row
            left, ids, right, forms, parts = _tile(left, right)
            depths, copies, out = left["depth"].to_numpy(), right["copies"].to_numpy(), []
            for at, keys in parts:
                asked = depths[at : at + len(keys)]
                most = int(min(asked.max(), len(forms)))
                first = np.sort(keys if most == len(forms) else np.partition(keys, most - 1, axis=1)[:, :most], axis=1)
                spots, scores = first & ((1 << BITS) - 1), -(first >> BITS)
                counts = copies[spots]
                before = np.cumsum(counts, axis=1) - counts
                fresh = np.concatenate([np.ones((len(keys), 1), bool), scores[:, 1:] != scores[:, :-1]], axis=1)
                above = np.maximum.accumulate(np.where(fresh, before, 0), axis=1)
                alike = np.arange(most) - np.maximum.accumulate(np.where(fresh, np.arange(most), 0), axis=1)
                i, j = np.nonzero(above + alike < asked[:, None])
                out.append((ids[at + i], forms[spots[i, j]], scores[i, j], counts[i, j]))
            return dict(zip(("query_id", "form", "parts", "copies"), map(np.concatenate, zip(*out))))

        wanted = depth.select("query_id", F.col("depth").cast("long").alias("depth")).where("depth > 0")
        found = self._met(self.asked.join(wanted, "query_id"), tile, "query_id long, form long, parts long, copies long")
        turned = found.withColumn("turned", -F.col("parts"))
        down, level = F.sum("copies").over(Window.partitionBy("query_id").orderBy("turned")), F.sum("copies").over(Window.partitionBy("query_id", "turned"))
        near = turned.withColumn("above", down - level).join(wanted, "query_id").where("above < depth")
        near = near.select("query_id", "form", (F.col("parts") / PARTS).alias("score"), "above", (F.col("depth") - F.col("above")).alias("room"), "depth")
        return Levels._numbered(near.join(self.members, "form").where("n <= room"), "depth").where("rank <= depth").drop("depth")

    def place(self, wanted: DataFrame) -> DataFrame:
        """query_id, uuid, score, rank of the rows of wanted (query_id, uuid; each once): what they score is looked up first, then how many rows stand above, and which forms score as much."""

        def score(left: pa.Table, right: pa.Table) -> dict:
            left, ids, right, forms, parts = _tile(left, right)
            lists, out = left["forms"].to_pylist(), []
            for at, keys in parts:
                for i, row in enumerate(keys):
                    asked = np.array(lists[at + i])
                    spots = np.minimum(np.searchsorted(forms, asked), len(forms) - 1)
                    spots = spots[forms[spots] == asked]
                    out.append((np.full(len(spots), ids[at + i]), forms[spots], -(row[spots] >> BITS)))
            return dict(zip(("query_id", "form", "parts"), map(np.concatenate, zip(*out))))

        def count(left: pa.Table, right: pa.Table) -> dict:
            left, ids, right, forms, parts = _tile(left, right)
            lists, copies, out = left["marks"].to_pylist(), right["copies"].to_numpy(), []
            for at, keys in parts:
                keys.sort(axis=1)
                for i, row in enumerate(keys):
                    marks = np.array(lists[at + i])
                    low, high = np.searchsorted(row, -marks << BITS), np.searchsorted(row, (1 - marks) << BITS)
                    spots = row & ((1 << BITS) - 1)
                    above = np.concatenate([[0], np.cumsum(copies[spots])])[low]
                    # one row for each form of a mark's score, one without a form where there is none; what stands above is told once
                    times = np.maximum(high - low, 1)
                    starts = np.cumsum(times) - times
                    n = np.arange(times.sum()) - np.repeat(starts, times)
                    held = np.where(np.repeat(high > low, times), forms[spots[np.minimum(np.repeat(low, times) + n, len(row) - 1)]], -1)
                    out.append((np.full(len(n), ids[at + i]), np.repeat(marks, times), np.where(n == 0, np.repeat(above, times), 0), held, np.repeat(high > low, times).astype(np.int64)))
            return dict(zip(("query_id", "parts", "above", "form", "holds"), map(np.concatenate, zip(*out))))

        found = self.keep(wanted.select("query_id", "uuid").join(self.members, "uuid"))
        asked = self.asked.join(found.groupBy("query_id").agg(F.collect_set("form").alias("forms")), "query_id")
        scored = self.keep(self._met(asked, score, "query_id long, form long, parts long"))
        asked = self.asked.join(scored.groupBy("query_id").agg(F.collect_set("parts").alias("marks")), "query_id")
        marks = self.keep(self._met(asked, count, "query_id long, parts long, above long, form long, holds long"))
        levels = marks.groupBy("query_id", "parts").agg(F.sum("above").alias("above"), F.sum("holds").alias("alike"))
        placed = found.join(scored, ["query_id", "form"]).join(levels, ["query_id", "parts"]).withColumn("score", F.col("parts") / PARTS)
        alone = placed.where("alike <= 1").select("query_id", "uuid", "score", (F.col("above") + F.col("n")).cast("int").alias("rank"))
        last = placed.where("alike > 1").groupBy("query_id", "parts", "score", "above").agg(F.max("uuid").alias("last"))
        before = marks.where("holds = 1").select("query_id", "parts", "form").join(last, ["query_id", "parts"]).join(self.members, "form").where("uuid <= last")
        return alone.unionByName(Levels._numbered(before).join(wanted.select("query_id", "uuid"), ["query_id", "uuid"], "left_semi"))


def fused_scores(left: Levels, right: Levels, fusion: Fusion, rows: DataFrame) -> DataFrame:
    """rows (query_id, uuid; each once) with left_rank, right_rank and raw, the score that both ranks give; rows in neither are left out."""
    part = lambda w, c: F.coalesce(F.lit(w) / (fusion.k + F.col(c)), F.lit(0.0))
    for side, name in ((left, "left_rank"), (right, "right_rank")):
        rows = rows.join(side.place(rows).select("query_id", "uuid", F.col("rank").alias(name)), ["query_id", "uuid"], "left")
    return rows.withColumn("raw", F.round(part(fusion.w_bm25, "left_rank") + part(fusion.w_sem, "right_rank"), 9)).where("raw > 0")


def _normalised(fusion: Fusion) -> Column:
    return F.least(F.lit(1.0), F.round(F.col("raw") / ((fusion.w_bm25 + fusion.w_sem) / (fusion.k + 1)), 6))


def fused_last(left: Levels, right: Levels, fusion: Fusion, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id and least, the normalised score of the worst fused row: of each form that left has its last row, of the others the one that right puts last."""
    last = right.members.groupBy("form").agg(F.max("uuid").alias("uuid"))
    both = left.held.select("query_id", "form").join(last, "form").select("query_id", "uuid")
    alone = right.held.select("query_id", "form", "score").join(left.held.select("query_id", "form"), ["query_id", "form"], "left_anti").join(last, "form")
    alone = alone.groupBy("query_id").agg(F.min(F.struct("score", (-F.col("uuid")).alias("turned"))).alias("b")).select("query_id", (-F.col("b.turned")).alias("uuid"))
    rows = fused_scores(left, right, fusion, keep(both.unionByName(alone)))
    return rows.groupBy("query_id").agg(F.min(_normalised(fusion)).alias("least"))


def fused(left: Levels, right: Levels, fusion: Fusion, targets: DataFrame, keep: Callable[[DataFrame], DataFrame], k: int = 0, least: float | None = None) -> DataFrame:
    """The first rows of the reciprocal rank fusion of two relations: query_id, uuid, left_rank, right_rank, raw, normalised, rank, for each query down to its k best rows, to all
    rows of targets (query_id, uuid) and, if given, to a raw score of least. right scores every row."""
    deepest = fused_scores(left, right, fusion, targets.select("query_id", "uuid").distinct()).groupBy("query_id").agg(F.min("raw").alias("target"))
    return fused_down(left, right, fusion, deepest, keep, k, least)


def fused_down(left: Levels, right: Levels, fusion: Fusion, deepest: DataFrame, keep: Callable[[DataFrame], DataFrame], k: int = 0, least: float | None = None) -> DataFrame:
    """fused down to the k best rows, a raw score of least and that of deepest (query_id, target).

    The kth row scores as much as rank k of right alone at least. A row that stands beyond rank m in both relations scores at most what m + 1 gives twice, so rows down to the rank
    at which that falls below the score asked for are all that can reach it. Of these, the ranks that are known give the kth score a better bound from below, and each row one
    from above; only rows that can still reach the score asked for are placed in the relation that lacks them. A target that lies deep makes its own query deep.
    """
    total = fusion.w_bm25 + fusion.w_sem
    floors = [x for x in (fusion.w_sem / (fusion.k + k) - SLACK if k else None, least) if x is not None]
    asked = right.sizes()
    bound = F.least(*[F.lit(x) for x in floors], F.col("target")) if floors else F.col("target")
    depth = F.when(F.col("bound") > 2 * SLACK, F.least(F.ceil(total / (F.col("bound") - SLACK) - fusion.k), F.col("rows"))).otherwise(F.col("rows"))
    depths = keep(asked.join(deepest, "query_id", "left").withColumn("bound", bound).where("bound is not null").select("query_id", "target", "bound", depth.alias("depth")))
    part = lambda w, rank: F.coalesce(F.lit(w) / (fusion.k + rank), F.lit(0.0))
    raw = lambda l, r: F.round(part(fusion.w_bm25, l) + part(fusion.w_sem, r), 9)  # noqa: E731, E741
    l, r = (side.top(depths.select("query_id", "depth")).select("query_id", "uuid", F.col("rank").alias(name)) for side, name in ((left, "left_rank"), (right, "right_rank")))  # noqa: E741
    near = l.join(r, ["query_id", "uuid"], "full").join(depths, "query_id")
    if k:
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("so_far")))
        near = near.withColumn("so_far", raw(F.col("left_rank"), F.col("right_rank"))).withColumn("n", order)
        kth = F.max(F.when(F.col("n") == k, F.col("so_far"))).over(Window.partitionBy("query_id"))
        near = near.withColumn("bound", F.least(F.greatest(F.lit(floors[0]), kth), *[F.lit(x) for x in floors[1:]], F.col("target")))
    beyond = F.col("depth") + 1
    near = near.where(raw(F.coalesce("left_rank", beyond), F.coalesce("right_rank", beyond)) >= F.col("bound"))
    near = keep(near.select("query_id", "uuid", "left_rank", "right_rank", "bound"))
    missing = [(side, name, keep(near.where(F.col(name).isNull()).select("query_id", "uuid"))) for side, name in ((left, "left_rank"), (right, "right_rank"))]
    for name, found in [(name, keep(side.place(wanted).select("query_id", "uuid", F.col("rank").alias("found")))) for side, name, wanted in missing]:
        near = near.join(found, ["query_id", "uuid"], "left").withColumn(name, F.coalesce(name, "found")).drop("found")
    rows = near.withColumn("raw", raw(F.col("left_rank"), F.col("right_rank"))).where("raw > 0 and raw >= bound").drop("bound")
    rank: Column = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "uuid"))
    return rows.withColumns({"normalised": _normalised(fusion), "rank": rank})
