"""Ranks among products of vectors against ranking all of them, and the ladder that reads them."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import placing, ranking
from lodestone.plans import registry

DATA = "/root/testdata/sf0.001"


def small_table(spark, forms=90, queries=40):
    """Vectors of few values, so that many scores are equal; forms of one to four rows, whose ids are mixed."""
    rng = np.random.default_rng(7)
    ids = iter(rng.permutation(forms * 4).tolist())
    rows = [sorted(next(ids) for _ in range(1 + i % 4)) for i in range(forms)]
    vectors = [[float(x) for x in v] for v in rng.integers(-2, 3, (forms, 3)) / 4]
    members = spark.createDataFrame([(u, us[0], n + 1) for us in rows for n, u in enumerate(us)], "uuid long, form long, n int")
    held = spark.createDataFrame([(us[0], v, len(us), us[0] % 5) for us, v in zip(rows, vectors)], "form long, v array<double>, copies long, kind long")
    asked = spark.createDataFrame([(q, [float(x) for x in v], q % 6) for q, v in enumerate(rng.integers(-2, 3, (queries, 3)) / 4)], "query_id long, v array<double>, kind long")
    return asked, held, members


@pytest.mark.parametrize("most_forms, most_asked", [(16, 7), (1000, 1000)])
def test_tiles_rank_as_ranking_all_products(spark, tmp_path, most_forms, most_asked):
    asked, held, members = small_table(spark)
    keep = lambda df: df.cache()
    tiles = placing.Tiles(asked, held, members, keep, most_forms, most_asked)
    assert (tiles.blocks[0] > 1, tiles.blocks[1] > 1) == (most_asked == 7, most_forms == 16)
    every = asked.select("query_id", F.col("v").alias("q")).crossJoin(held.select("form", "v")).select("query_id", "form", F.round(ranking.dot("q", "v"), 6).alias("score"))
    want = {(r["query_id"], r["uuid"]): (r["score"], r["rank"]) for r in ranking.ranked(every.join(members, "form").select("query_id", "uuid", "score")).collect()}
    got = lambda df: {(r["query_id"], r["uuid"]): (r["score"], r["rank"]) for r in df.select("query_id", "uuid", "score", "rank").collect()}
    depth = asked.select("query_id", (F.col("query_id") * 7 % 301).alias("depth"))
    assert got(tiles.top(depth)) == {k: v for k, v in want.items() if v[1] <= k[0] * 7 % 301}
    some = spark.createDataFrame([k for k in want if (k[0] + k[1]) % 3 == 0], "query_id long, uuid long")
    assert got(tiles.place(some)) == {k: v for k, v in want.items() if (k[0] + k[1]) % 3 == 0}
    kinds = {r["form"]: r["kind"] for r in held.collect()}
    kind = {r["uuid"]: kinds[r["form"]] for r in members.collect()}
    first = {}
    for (q, u), (_, rank) in want.items():
        if kind[u] == q % 6 and rank < first.get(q, (1 << 30, 0))[0]:
            first[q] = (rank, u)
    assert {r["query_id"]: r["uuid"] for r in tiles.named().collect()} == {q: u for q, (_, u) in first.items()} and len(first) < 40
    assert {r["rows"] for r in tiles.sizes().collect()} == {members.count()}


def test_shared_levels_answer_each_query(spark):
    asked, held, members = small_table(spark)
    scored = asked.select("query_id", F.col("v").alias("q")).crossJoin(held.select("form", "v")).where("query_id < 5 and form % 3 <> 1").select("query_id", F.col("form").alias("form"), F.round(ranking.dot("q", "v"), 6).alias("score"))
    levels = placing.Levels(scored, held.select("form", "copies"), members, lambda df: df.cache())
    shared = placing.Shared(levels, spark.createDataFrame([(100 + i, i % 5) for i in range(12)], "query_id long, own long"))
    want = {(r["query_id"], r["uuid"]): r["rank"] for r in ranking.ranked(scored.join(members, "form").select("query_id", "uuid", "score")).collect()}
    depth = spark.createDataFrame([(100 + i, 3 * i) for i in range(12)], "query_id long, depth long")
    got = {(r["query_id"], r["uuid"]): r["rank"] for r in shared.top(depth).collect()}
    assert got == {(100 + i, u): rank for i in range(12) for (q, u), rank in want.items() if q == i % 5 and rank <= 3 * i}
    wanted = spark.createDataFrame([(100 + i, u) for i in range(12) for u in range(0, 360, 17)], "query_id long, uuid long")
    got = {(r["query_id"], r["uuid"]): r["rank"] for r in shared.place(wanted).collect()}
    assert got == {(100 + i, u): rank for i in range(12) for (q, u), rank in want.items() if q == i % 5 and u % 17 == 0}


def test_the_ladder_equals_its_sql_without_ranking_all_rows(spark, monkeypatch):
    def whole(*args, **kwargs):
        raise AssertionError("a row for every text and item")

    for name in ("ranked", "rrf", "score_vectors"):
        monkeypatch.setattr(ranking, name, whole)
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from '{DATA}/part.parquet'")
    for name in ("field_ladder", "ladder_best"):
        got = registry.queries()[name](spark, DATA)
        said = duck.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in said.description]
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, said.fetchall()))
