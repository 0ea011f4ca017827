from fractions import Fraction
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import metrics, stats, truth

PQ = "mode string, query_id long, label string, class string, hit_rank int, hit_rank_correct int, ndcg double"


def pq(spark, ranks, mode="m"):
    return spark.createDataFrame([(mode, i, "match", "c", r, r, 0.0) for i, r in enumerate(ranks)], PQ)


@pytest.mark.parametrize("b,c", [(0, 0), (1, 5), (10, 3), (7, 7), (30, 12), (2000, 1900)])
def test_mcnemar_equals_the_exact_sum(spark, b, c):
    p = float(min(1, Fraction(2 * sum(comb(b + c, i) for i in range(min(b, c) + 1)), 2 ** (b + c)))) if b + c else 1.0
    got = spark.createDataFrame([(b, c), (c, b)], "b long, c long").select(stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    assert [r["p"] for r in got] == [pytest.approx(p, abs=1e-6)] * 2


EDGE = metrics.Z**2 / (54 + metrics.Z**2)  # the interval's closed form at no hits


@pytest.mark.parametrize("h,n,low,high", [(0, 54, 0.0, EDGE), (54, 54, 1 - EDGE, 1.0), (0, 0, 0.0, 0.0)])
def test_wilson_edges(spark, h, n, low, high):
    share, lo, hi = metrics.wilson(F.col("h"), F.col("n"))
    got = spark.createDataFrame([(h, n)], "h long, n long").select(lo.alias("lo"), hi.alias("hi")).first()
    assert (got["lo"], got["hi"]) == (pytest.approx(low, abs=1e-6), pytest.approx(high, abs=1e-6))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(1, 40)), min_size=1, max_size=12))
def test_recall_is_monotone_and_below_any(spark, ranks):
    r = metrics.recall(pq(spark, ranks)).first()
    cells = [r[f"r{k}"] for k in metrics.CUTS] + [r["rall"]]
    assert cells == sorted(cells) and r["rall"] == sum(x is not None for x in ranks)


def test_labels_other_than_match_do_not_count(spark):
    rows = pq(spark, [1]).unionByName(pq(spark, [1]).withColumn("label", F.lit("skipped")).withColumn("query_id", F.lit(99).cast("long")))
    got = metrics.recall(rows).first()
    assert (got["n_scope"], got["denom"], got["r1"]) == (2, 1, 1)


def test_rank_bins_keep_empty_ones(spark):
    got = {r["bin"]: r["n"] for r in metrics.rank_bins(pq(spark, [1, 2, 3, 7, 50, None])).collect()}
    assert got == {"1": 1, "2-3": 2, "4-5": 0, "6-10": 1, ">10": 1, "miss": 1}


def test_ndcg_and_first_hits_by_hand(spark):
    rows = spark.createDataFrame([("m", 1, 5, 1), ("m", 1, 7, 2), ("m", 1, 6, 3)], "mode string, query_id long, uuid long, rank int")
    marks = spark.createDataFrame([(1, "match", "c", 6, [5, 6]), (2, "match", "", 8, [8]), (3, "match", None, None, [])], "query_id long, label string, class string, correct_uuid long, acceptable array<long>")
    got = {r["query_id"]: r for r in metrics.per_query(rows, marks, ["m"]).collect()}
    from math import log2

    assert got[1]["ndcg"] == pytest.approx((1 + 3 / log2(4)) / (3 + 1 / log2(3)), abs=1e-6)
    assert (got[1]["hit_rank"], got[1]["hit_rank_correct"], got[2]["hit_rank"], got[3]["ndcg"]) == (1, 3, None, 0.0)


def test_blank_class_is_unknown(spark):
    rows = pq(spark, [1, 2]).withColumn("class", F.when(F.col("query_id") == 0, " "))
    assert [r["class"] for r in metrics.class_breakdown(rows).collect()] == ["(unknown)"]


def test_verdicts_by_rule(spark):
    steps = [("a", 0, "name", 0.5), ("a", 1, "class", 0.6), ("a", 2, "categories", 0.5), ("a", 3, "density", 0.9), ("a", 4, "x", 0.901), ("fuzzy", 1, "class", 0.0)]
    got = {r["label"]: r["verdict"] for r in stats.step_verdicts(spark.createDataFrame(steps, "mode string, step int, label string, mrr double"), ("density",)).collect()}
    assert got == {"class": "helps", "categories": "hurts: too broad", "density": "noise", "x": "neutral"}


def test_best_step_is_the_first_maximum(spark):
    steps = spark.createDataFrame([("a", 0, "n", 0.5), ("a", 1, "c", 0.7), ("a", 2, "d", 0.7)], "mode string, step int, label string, mrr double")
    assert [r["step"] for r in stats.ladder_steps(steps).where("best").collect()] == [1]


def test_bootstrap_repeats_and_holds_the_point(spark):
    rows = pq(spark, [1, 2, 4, None, 1])
    a, b = (stats.bootstrap_mean(rows, F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0)), resamples=200).first() for _ in range(2))
    assert a == b and a["low"] <= a["point"] <= a["high"] and a["point"] == pytest.approx(0.55)


def test_pairs_are_joined_on_the_query(spark):
    a, b = pq(spark, [1, None, 1], "a"), pq(spark, [None, 1], "b")
    got = stats.mcnemar_matrix(a.unionByName(b)).first()
    assert (got["b"], got["c"]) == (1, 1)


def test_truth_join_prefers_exact_then_lowest_ordinal(spark):
    entries = spark.createDataFrame([("Ring", 5, "match"), (" ring", 2, "skipped"), ("red ring", 1, "match")], "name string, ordinal int, label string")
    scope = spark.createDataFrame([("RING",), ("a red ring x",), ("nothing",), ("",)], "name string")
    got = {r["name"]: (r["ordinal"], r["label"], r["how"]) for r in truth.scope_truth_join(scope, entries).collect()}
    assert got == {"RING": (2, "skipped", "exact"), "a red ring x": (1, "match", "substring"), "nothing": (None, None, "none"), "": (None, None, "none")}


def test_containment_by_runs_equals_search(spark):
    texts = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, "none"), (3, "tone two  three four five sixty"), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "two"), (3, "one two  three four five six"), (4, "a b c d e f g")], "item_id long, passage string")
    assert sorted(map(tuple, truth.containment_join(texts, items).collect())) == [(1, 1), (1, 2), (3, 2), (3, 3)]


def test_acceptable_takes_only_filled_ids(spark):
    rows = spark.createDataFrame([("a", ["b"]), ("", ["b", "b"]), (None, [])], "correct_uuid string, acceptable array<string>")
    assert [r["acceptable"] for r in truth.with_acceptable(rows).collect()] == [["b", "a"], ["b"], []]


def test_marker_needs_filled_ids(spark):
    rows = spark.createDataFrame([(None, None, []), (1, 1, [1]), (2, 1, [1, 2]), (3, 1, [1])], "u long, c long, a array<long>")
    assert [r[0] for r in rows.select(metrics.hit_marker(F.col("u"), F.col("c"), F.col("a"))).collect()] == ["", "**", "*", ""]


def test_truth_as_rows_is_the_union(spark):
    marks = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "name string, uuid string")
    correct = spark.createDataFrame([("a", "3"), ("b", "2"), ("c", ""), ("d", None)], "name string, uuid string")
    assert sorted(map(tuple, truth.acceptable_rows(marks, correct, "name").collect())) == [("a", "1"), ("a", "3"), ("b", "2")]


@pytest.mark.parametrize("p,said", [(0.0009, "<.001"), (0.001, "0.001"), (0.0625, "0.062"), (1.0, "1.000")])
def test_p_values_as_shown(spark, p, said):
    assert spark.range(1).select(stats.shown_p(F.lit(p))).first()[0] == said


def test_intervals_of_all_measures(spark):
    rows = pq(spark, [1, 2, None]).withColumn("ndcg", F.lit(0.5))
    got = {r["measure"]: r for r in stats.ranking_intervals(rows, resamples=100).collect()}
    assert set(got) == {"mrr", "mrr_correct", "ndcg10"} and (got["ndcg10"]["low"], got["ndcg10"]["high"]) == (0.5, 0.5) and got["mrr"]["point"] == 0.5
    cells = {(r["kind"], r["cell"]): r["hits"] for r in metrics.wilson_recall(rows).collect()}
    assert cells["exact", "rall"] == cells["acceptable", "r3"] == 2 and len(cells) == 12


def test_draws_are_made_in_even_tasks_and_met_by_blocks(spark):
    from hashlib import md5

    n, resamples = 60_000, 40
    drawn = stats.draws(spark, [n], resamples, block=1000)
    tasks = [r["count"] for r in drawn.select(F.spark_partition_id().alias("t"), F.explode("places")).groupBy("t").count().collect()]
    assert sum(tasks) == n * resamples and max(tasks) <= 0.5 * sum(tasks)
    rows = spark.range(2500).selectExpr("'a' as mode", "id as query_id", "sqrt(id) as x").unionByName(spark.range(7).selectExpr("'b' as mode", "id as query_id", "id * 1.0D as x"))
    got = {r["mode"]: r for r in stats.bootstrap_means(rows, {"x": F.col("x")}, resamples=30, block=128).collect()}
    for mode, values in (("a", np.sqrt(np.arange(2500))), ("b", np.arange(7.0))):
        means = [np.mean([values[int(md5(f"42:{i}:{j}".encode()).hexdigest()[:12], 16) % len(values)] for j in range(1, len(values) + 1)]) for i in range(1, 31)]
        assert (got[mode]["low"], got[mode]["high"]) == pytest.approx(np.quantile(means, [0.025, 0.975]), abs=2e-6) and got[mode]["point"] == pytest.approx(values.mean(), abs=1e-6)
