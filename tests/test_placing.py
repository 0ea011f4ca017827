"""Ranks by forms against row_number() over all rows."""

import gc
import random
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical, placing, ranking, sizes
from lodestone.operators.ranking import Fusion
from lodestone.plans import registry
from lodestone.plans.roles import Roles
from lodestone.sources import scratch


def test_pairs_of_long_texts_are_one_array():
    """Numpy's strings of this size become several chunks, which no batch takes."""
    texts = pa.array([f"{i:0>120}" for i in range(1200)])
    batches = list(ranking.best_pairs(texts, np.ones((1200, 2)), pa.array(range(900)), np.ones((900, 2)), None))
    assert sum(map(len, batches)) == 1200 * 900 and batches[0]["query_id"][899].as_py() == texts[0].as_py() and batches[-1]["query_id"][-1].as_py() == texts[-1].as_py()


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    home = {u: rng.randrange(25) for u in range(1, 400)}
    smallest = {f: min(u for u in home if home[u] == f) for f in set(home.values())}
    rows = spark.createDataFrame([(u, smallest[f]) for u, f in home.items()], "uuid long, form long")
    members = rows.selectExpr("uuid", "form", "row_number() over (partition by form order by uuid) as n").cache()
    forms = rows.groupBy("form").agg(F.count("*").alias("copies")).cache()
    few = [(q, f, rng.choice((0.5, 1.0, 2.0))) for q in range(4) for f in smallest.values() if rng.random() < 0.4]
    many = [(q, f, rng.choice((0.1, 0.2, round(rng.random(), 6)))) for q in range(4) for f in smallest.values()]
    scored = [spark.createDataFrame(x, "query_id long, form long, score double").cache() for x in (few, many)]
    every = [ranking.ranked(s.join(members, "form").select("query_id", "uuid", "score")).cache() for s in scored]
    return [placing.Levels(s, forms, members, lambda df: df.localCheckpoint()) for s in scored], every


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


@pytest.mark.parametrize("depth", [1, 7, 1000])
def test_top_and_place_give_row_numbers(tables, spark, depth):
    columns = ("query_id", "uuid", "score", "rank")
    for levels, every in zip(*tables):
        depths = every.select("query_id").distinct().withColumn("depth", F.lit(depth))
        assert as_set(levels.top(depths), *columns) == as_set(every.where(F.col("rank") <= depth), *columns)
        wanted = spark.range(4).withColumnRenamed("id", "query_id").crossJoin(spark.range(1, 460, depth).withColumnRenamed("id", "uuid"))
        assert as_set(levels.place(wanted), *columns) == as_set(every.join(wanted, ["query_id", "uuid"]), *columns)
        assert as_set(levels.sizes(), "query_id", "rows") == as_set(every.groupBy("query_id").agg(F.count("*").alias("rows")), "query_id", "rows")


@pytest.mark.parametrize("fusion", [Fusion(5, 2.0, 0.5)])
def test_fused_rows_are_those_of_the_whole_fusion(tables, spark, fusion):
    (left, right), (a, b) = tables
    columns = ("query_id", "uuid", "left_rank", "right_rank", "raw", "normalised", "rank")
    whole = ranking.rrf(a, b, fusion.k, fusion.w_bm25, fusion.w_sem).cache()
    targets = spark.createDataFrame([(0, 390), (1, 5), (7, 5)], "query_id long, uuid long")
    got = placing.fused(left, right, fusion, targets, lambda df: df.localCheckpoint(), k=10)
    rows, true = as_set(got, *columns), as_set(whole, *columns)
    assert rows <= true and {r for r in true if r[-1] <= 10 or r[:2] in ((0, 390), (1, 5))} <= rows and len(rows) < len(true)
    least = whole.agg(F.percentile("raw", F.lit(0.8))).first()[0]
    assert {r for r in true if r[4] >= least} == as_set(placing.fused(left, right, fusion, targets.limit(0), lambda df: df.localCheckpoint(), least=least), *columns)


def test_the_worst_fused_row_is_found_by_forms(tables):
    (left, right), (a, b) = tables
    for fusion in (Fusion(), Fusion(5, 2.0, 0.5)):
        whole = ranking.rrf(a, b, fusion.k, fusion.w_bm25, fusion.w_sem).groupBy("query_id").agg(F.min("normalised").alias("least"))
        assert as_set(placing.fused_last(left, right, fusion, lambda df: df.localCheckpoint()), "query_id", "least") == as_set(whole, "query_id", "least")


def test_what_a_common_text_finds_is_dealt_to_salts(spark):
    queries = spark.range(200).select(F.col("id").alias("query_id"), F.when(F.col("id") < 150, "a").otherwise("b").alias("asked"))
    rows = spark.range(300).select(F.col("id").alias("uuid"), F.when(F.col("id") % 3 > 0, "x").otherwise("y").alias("held"))
    found = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "none")], "asked string, held string")
    got = [tuple(r) for r in lexical.spread(found, queries, rows, meeting=500).collect()]
    assert len(got) == len(set(got)) == 150 * 300 + 50 * 100
    assert set(got) == as_set(found.join(queries, "asked").join(rows, "held"), "query_id", "uuid")


def test_no_pair_of_vectors_and_no_posting_is_shuffled(spark):
    roles = Roles(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan(roles.vector_scores())
    assert "hashpartitioning(uuid" not in plan(lexical.corpus_stats(roles.corpus))
    assert as_set(lexical.vocabulary(roles.corpus), "term", "df") == as_set(lexical.document_frequency(lexical.postings(roles.corpus)), "term", "df")


def test_a_run_leaves_no_memo_and_no_step_behind(spark):
    """Memos of a run that is over kept its plans in the driver, and its steps in the shared folder."""
    roles = Roles(spark, "/root/testdata/sf0.001")
    asked = roles.cases()
    assert roles.cases() is asked and roles.forms is roles.forms
    steps, files = list(roles.steps), spark._jvm.org.apache.hadoop.fs
    there = lambda path: files.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(files.Path(path))
    done = roles.finished(asked.groupBy().count())
    assert done.first()[0] == 20 and len(steps) == 2 and not any(map(there, steps)) and all(map(there, roles.steps))
    gone = weakref.ref(roles)
    del roles
    gc.collect()
    assert gone() is None


def test_levels_are_written_once_and_dealt_by_query_alone(spark):
    scored = spark.createDataFrame([(q, f, float(f % 3) - 1.0) for q in range(3) for f in range(10)], "query_id long, form long, score double")
    forms = spark.createDataFrame([(f, 1 + f % 2) for f in range(10)], "form long, copies long")
    members = spark.createDataFrame([(10 * f + i, f, i + 1) for f in range(10) for i in range(1 + f % 2)], "uuid long, form long, n int")
    kept = []
    held = placing.Levels(scored, forms, members, lambda df: kept.append(df) or df).held
    assert len(kept) == 1 and "hashpartitioning(query_id, score" not in held._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r) for r in held.select("query_id", "form", "score", "copies").collect()]
    true = {(q, f, s, c, sum(d for p, _, t, d in rows if p == q and t > s), sum(p == q and t == s for p, _, t, _ in rows)) for q, f, s, c in rows}
    assert len(rows) == 30 and as_set(held, "query_id", "form", "score", "copies", "above", "alike") == true


def test_a_first_hit_is_found_without_reading_down_to_the_correct_row(spark, monkeypatch):
    roles, read = Roles(spark, "/root/testdata/sf0.001"), []
    fused = placing.fused

    def counted(*args):
        rows = fused(*args).localCheckpoint()
        read.append(rows.count())
        return rows

    monkeypatch.setattr(placing, "fused", counted)
    columns = ("query_id", "label", "hit_rank", "ndcg")
    near, whole = roles.evaluated(("hybrid",), True, False), roles.evaluated(("hybrid",), True)
    assert as_set(near, *columns) == as_set(whole, *columns) and "hit_rank_correct" not in near.columns
    assert read[0] <= read[1]
    assert as_set(roles.first("semantic", deep="top"), "query_id", "uuid", "rank") <= as_set(roles.first("semantic"), "query_id", "uuid", "rank")


def test_a_run_lets_spark_broadcast_little_that_was_not_counted(spark):
    """Tables of under 10 MB of compressed files were broadcast unasked, twenty times as large in the driver."""
    side, _ = scratch.written(spark.range(400_000).selectExpr("id * 7919 % 1000003 as id", "id % 3 as z"), "test")
    how = lambda: spark.range(5_000_000).join(side, "id")._jdf.queryExecution().executedPlan().toString()
    before, said = spark.conf.get(sizes.THRESHOLD), []
    plan = lambda roles: said.append((spark.conf.get(sizes.THRESHOLD), how())) or roles.corpus
    registry.registered("SELECT 1")(plan)
    run, _ = registry.REGISTRY.pop(plan.__name__)
    assert "BroadcastHashJoin" in how()
    run(spark, "/root/testdata/sf0.001")
    assert int(said[0][0]) <= 1 << 20 and "BroadcastHashJoin" not in said[0][1] and spark.conf.get(sizes.THRESHOLD) == before
