import bisect
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import lexical, ranking
from lodestone.plans import registry


def rows(spark, data):
    return spark.createDataFrame(data, "query_id long, uuid long, score double")


def as_ranks(df):
    return {(r["query_id"], r["uuid"]): r["rank"] for r in df.collect()}


def test_ties_go_to_the_smaller_uuid(spark):
    got = as_ranks(ranking.ranked(rows(spark, [(1, 9, 0.5), (1, 3, 0.5), (1, 4, 0.9)])))
    assert got == {(1, 4): 1, (1, 3): 2, (1, 9): 3}


def test_top_k_is_pruned_before_the_shuffle(spark):
    plan = ranking.ranked(rows(spark, [(1, 9, 0.5)]), k=3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_threshold_renumbers_and_keeps_null_scores(spark):
    got = ranking.threshold_top(rows(spark, [(1, 1, 0.9), (1, 2, 0.1), (1, 3, None)]), 0.5, 5)
    assert as_ranks(got) == {(1, 1): 1, (1, 3): 2}


def test_rrf_by_hand(spark):
    left, right = (ranking.ranked(rows(spark, x)) for x in ([(1, 1, 2.0), (1, 2, 1.0)], [(1, 2, 5.0), (1, 3, 4.0)]))
    got = {r["uuid"]: (r["raw"], r["rank"], r["left_rank"]) for r in ranking.rrf(left, right).collect()}
    assert got[2][0] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and got[2][1] == 1
    assert got[3][2] is None and got[1][1] == 2


@settings(max_examples=5, deadline=None)
@given(st.floats(0.1, 10))
def test_rrf_does_not_see_score_scale(spark, factor):
    data = [(1, i, float(10 - i)) for i in range(5)]
    other = rows(spark, [(1, i, float(i)) for i in range(5)])
    a = ranking.rrf(ranking.ranked(rows(spark, data)), ranking.ranked(other))
    b = ranking.rrf(ranking.ranked(rows(spark, [(q, u, s * factor) for q, u, s in data])), ranking.ranked(other))
    assert as_ranks(a) == as_ranks(b)


def test_rerank_permutes_only_the_head(spark):
    first = ranking.ranked(rows(spark, [(1, i, 1.0 - i / 10) for i in range(5)]))
    logits = spark.createDataFrame([(1, 0, -1.0), (1, 1, 3.0)], "query_id long, uuid long, logit double")
    got = {r["uuid"]: (r["rank"], r["moved"], r["fallback"]) for r in ranking.rerank(first, logits, head=2).collect()}
    assert got == {1: (1, 1, False), 0: (2, -1, False), 2: (3, 0, False), 3: (4, 0, False), 4: (5, 0, False)}


def test_rerank_falls_back_when_logits_are_missing(spark):
    first = ranking.ranked(rows(spark, [(1, 0, 0.9), (1, 1, 0.8)]))
    logits = spark.createDataFrame([(1, 1, 3.0)], "query_id long, uuid long, logit double")
    got = ranking.rerank(first, logits, head=2).collect()
    assert {r["uuid"]: r["rank"] for r in got} == {0: 1, 1: 2} and all(r["fallback"] for r in got)


def test_first_hits_agree_with_full_ranking(spark):
    data = [(q, u, float((q * 7 + u * 13) % 11)) for q in range(4) for u in range(20)]
    scored = rows(spark, data)
    relevant = F.col("uuid") % 5 == F.col("query_id")
    fast = {r["query_id"]: r["hit_rank"] for r in ranking.first_hits(scored, relevant, 4).collect()}
    full = {r["query_id"]: r["m"] for r in ranking.ranked(scored).groupBy("query_id").agg(F.min(F.when(relevant, F.col("rank"))).alias("m")).collect()}
    assert fast == full


def test_blocked_vector_scores_equal_broadcast_ones(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "uuid long, v array<double>")
    q = v.select(F.col("uuid").alias("query_id"), "v")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(ranking.score_vectors(q, v)) == as_set(ranking.score_vectors(q, v, most_broadcast=2))


def test_calibration_is_capped(spark):
    got = spark.range(1).select(ranking.calibrated(F.lit(50.0), "hybrid").alias("a"), ranking.stepped(F.lit(0.6), [(0.0, 0.1), (0.5, 0.4)]).alias("b")).first()
    assert (got["a"], got["b"]) == (0.97, 0.4)


def test_lexical_filters(spark):
    corpus = spark.createDataFrame([(1, "old anvil", "A B"), (2, "cold anvil", "A"), (3, "red ring", "B")], "uuid long, name string, classification string")
    ask = lambda t: spark.createDataFrame([(7, t)], "query_id long, text string")
    assert {r["uuid"] for r in lexical.fuzzy_search(ask("anvl"), corpus).collect()} == {1, 2}
    assert {r["uuid"] for r in lexical.fuzzy_search(ask("old"), corpus).collect()} == {1, 2}
    assert {r["uuid"] for r in lexical.regex_search(ask("^OLD"), corpus).collect()} == {1}
    assert lexical.fuzzy_search(ask(""), corpus).count() == 0
    plan = lexical.bm25f_scores(ask("old anvil"), corpus)
    best = ranking.ranked(plan).where("rank = 1").first()
    assert best["uuid"] == 1


def test_typo_expansion_weights(spark):
    terms = spark.createDataFrame([(1, "anvl"), (1, "ring")], "query_id long, term string")
    vocab = spark.createDataFrame([("anvil",), ("ring",), ("rings",)], "term string")
    got = {(r["source"], r["term"]): (r["distance"], r["weight"]) for r in lexical.typo_expansion(terms, vocab).collect()}
    assert got == {("anvl", "anvil"): (1, 0.5), ("ring", "ring"): (0, 1.0)}


def test_edit_pairs_against_all_pairs(spark):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    words = ["", "a", "ab", *("".join(rng.choice("ab") for _ in range(rng.randint(2, 6))) for _ in range(30))]
    long = ["".join(rng.choice("abc") for _ in range(rng.choice([63, 64, 65, 66, 200]))) for _ in range(6)]
    for w in long[:]:
        for _ in range(3):
            at = rng.randrange(len(w))
            long += [w[:at] + w[at + 1 :], w[:at] + "z" + w[at:], w[:at] + "zz" + w[at + 2 :]]
    words = sorted({*words, *long, "x" * 20_000})
    table = lambda c: spark.createDataFrame([(w,) for w in words], f"{c} string")
    for most in (1, 2):
        got = {(r["term"], r["known"]): r["distance"] for r in lexical.edit_pairs(table("term"), table("known"), most).collect()}
        near = [(a, b) for a in words for b in words if abs(len(a) - len(b)) <= most]
        want = {(a, b): d for a, b in near if (d := 0 if a == b else distance(a, b)) <= most}
        assert got == want and len(want) > len(words)


def test_substring_pairs_against_all_pairs(spark):
    hays, needles = ["", "a", "ab", "abcab", "xyz abc", "K\u00e4se"], ["", "a", "bc", "cab", "abcab", "yz ab", "\u00e4s", "zzz"]
    got = {tuple(r) for r in lexical.substring_pairs(spark.createDataFrame([(h,) for h in hays * 2], "hay string"), spark.createDataFrame([(n,) for n in needles], "needle string")).collect()}
    assert got == {(h, n) for h in hays for n in needles if n and n in h}


@pytest.mark.parametrize("most", [20_000, 3])
def test_best_scores_hold_the_first_k(spark, most):
    v = spark.createDataFrame([(i, [float(i % 4), 1.0]) for i in range(40)] + [(99, None), (98, [1.0])], "uuid long, v array<float>")
    q = v.where("uuid < 5 or uuid > 90").select(F.col("uuid").alias("query_id"), "v")
    every = ranking.ranked(ranking.score_vectors(q, v), k=3)
    few = ranking.score_vectors(q, v, k=3, most_broadcast=most)
    assert sorted(ranking.ranked(few, k=3).collect()) == sorted(every.collect())
    assert few.count() < ranking.score_vectors(q, v).count() and {r["uuid"] for r in every.where("query_id = 98").collect()} == {98}


def test_fitted_steps_replace_a_sigmoid(spark):
    curves = ranking.CURVES | {"hybrid": [(0.5, 0.4), (0.0, 0.1)]}
    got = spark.range(1).select(*[ranking.calibrated(F.lit(x), "hybrid", curves) for x in (-1.0, 0.2, 0.5, 9.0)]).first()
    assert tuple(got) == (0.1, 0.1, 0.4, 0.4)


def test_steps_of_many_breakpoints_are_searched_by_halves(spark):
    rng = random.Random(5)
    points = [(rng.choice((-1, 1)) * rng.random() * 50, rng.random()) for _ in range(10_000)] + [(3.0, 0.2), (3.0, 0.4)]
    starts = sorted(points)
    scores = [None, -1e9, 1e9, 3.0, starts[0][0], starts[-1][0]] + [rng.uniform(-55, 55) for _ in range(300)] + [at for at, _ in points[:50]]
    data = spark.createDataFrame([(s,) for s in scores], "score double").select("score", ranking.stepped(F.col("score"), points).alias("v"))
    for r in data.collect():
        at = 0 if r["score"] is None else max(0, bisect.bisect_right([a for a, _ in starts], r["score"]) - 1)
        assert r["v"] == starts[at][1]
    assert data._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") < 10


def test_few_steps_are_what_they_were(spark):
    data = spark.createDataFrame([(0.1,), (0.5,), (0.9,), (None,)], "score double")
    assert [r[0] for r in data.select(ranking.stepped(F.col("score"), [(0.8, 0.9), (0.2, 0.3), (0.5, 0.6)])).collect()] == [0.3, 0.6, 0.9, 0.3]
    assert [r[0] for r in data.select(ranking.stepped(F.col("score"), [(0.4, 0.7)])).collect()] == [0.7] * 4


@pytest.mark.parametrize("most", [7, 1000])
def test_first_hits_of_vectors_agree_with_ranking_all_products(spark, most):
    """Vectors of few values give many equal scores; one label has no row, one vector no label, some hold NaN or infinity, or have another number of components."""
    rng = np.random.default_rng(3)
    odd = {4: None, 9: [float("nan"), 1.0, 0.0], 13: [float("inf"), 1.0, -1.0], 17: [0.5, 0.5], 21: [1e30, 1.0, 0.0], 40: [float("nan"), 0.0, 0.0], 50: [0.25, 0.5]}
    rows = [(i, odd.get(i, [float(x) / 4 for x in v]), None if i == 30 else 9 if i == 60 else i % 4) for i, v in enumerate(rng.integers(-2, 3, (90, 3)))]
    table = spark.createDataFrame(rows, "id long, v array<double>, cluster int")
    asked, held = table.where("id % 10 = 0").withColumnRenamed("id", "query_id"), table.where("id % 10 <> 0").withColumnRenamed("id", "uuid")
    got = {r["query_id"]: r["hit_rank"] for r in ranking.vector_first_hits(asked, held, most, most).collect()}
    every = ranking.score_vectors(asked, held.select(F.struct("uuid", "cluster").alias("uuid"), "v")).select("query_id", "uuid.uuid", "uuid.cluster", "score")
    want = ranking.first_hits(every.join(asked.select("query_id", F.col("cluster").alias("ql")), "query_id"), F.col("cluster") == F.col("ql"), 9)
    assert got == {r["query_id"]: r["hit_rank"] for r in want.collect()} and None in got.values() and len(set(got.values())) > 3


def test_all_pairs_of_many_queries_are_neither_made_as_rows_nor_broadcast(spark, monkeypatch):
    def whole(*args, **kwargs):
        raise AssertionError("a row for every pair")

    monkeypatch.setattr(ranking, "score_vectors", whole)
    assert registry.queries()["recall_at_k"](spark, "/root/testdata/sf0.001").first()["n"] == 50
