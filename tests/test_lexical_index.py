"""Block-wise lexical top-k against ranking all scores."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical, ranking
from lodestone.plans import registry

WORDS = ["blue", "old", "red", "ring", "bolt", "plate", "x1", "7", "42", "steel"]


def tables(spark, corpus, queries):
    return spark.createDataFrame(corpus, "uuid long, name string, classification string"), spark.createDataFrame(queries, "query_id long, text string")


def made(seed, n, hot=0):
    rng = random.Random(seed)
    text = lambda most: " ".join(rng.choices(WORDS, k=rng.randint(0, most)))
    corpus = [(i, None if i % 17 == 0 else text(3), None if i % 13 == 0 else text(4)) for i in range(n)] + [(n + i, "blue ring", "steel 7") for i in range(hot)]
    queries = [(1, "blue ring"), (2, "ble ring"), (3, "od plate"), (4, "BLUE  ring!"), (5, ""), (6, None), (7, "zzzzzzzz"), (8, "steel steel 42 x1"), (9, "rng blt")]
    return corpus, queries


def rows(df):
    return sorted((r["query_id"], r["rank"], r["uuid"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("n, hot, block, k", [(150, 0, 4, 5), (60, 90, 8, 3), (40, 0, 64, 100)])
def test_top_equals_ranking_all_scores(spark, n, hot, block, k):
    corpus, queries = tables(spark, *made(n, n, hot))
    every = lexical.bm25f_terms(queries, corpus).groupBy("query_id", "uuid").agg(F.round(F.sum("contribution"), 6).alias("score"))
    got = lexical.Index(corpus, block=block).top(queries, k)
    assert rows(got) == rows(ranking.ranked(every, k=k).select("query_id", "uuid", "score", "rank"))
    assert rows(ranking.ranked(lexical.bm25f_scores(queries, corpus))) == rows(ranking.ranked(every))


def test_blocks_read_do_not_grow_with_the_corpus(spark):
    read = []
    for copies in (1, 4):
        names = [f"{a}{x} {b}" for a in "pqrstuvw" for b in ("ring", "bolt", "plate") for x in range(20 * copies)]
        corpus, queries = tables(spark, [(i, name, "steel") for i, name in enumerate(names)], [(1, "p0 ring"), (2, "w7 bolt")])
        index = lexical.Index(corpus, block=8)
        words = index.words(lexical._bags(queries, "text"))
        gains = index.gains(words)
        chosen = index.chosen(words, gains, 1)
        read.append(index.scores(words, gains, chosen).count())
        assert read[-1] < index.scores(words, gains).count() / 3
    assert read[1] <= 2 * read[0]


def test_no_block_grows_with_copies_or_a_common_name(spark):
    corpus, _ = tables(spark, [(i, "ring", f"c{i}") for i in range(400)] + [(1000 + i, "bolt", "x") for i in range(400)], [(1, "ring")])
    sizes = {r["block"]: r["n"] for r in lexical.Index(corpus, block=16)._blocked(16).groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 401 and max(sizes.values()) <= 48


def test_empty_tables(spark):
    corpus, queries = tables(spark, *made(1, 20))
    assert lexical.Index(corpus.limit(0)).top(queries, 3).count() == 0
    assert lexical.Index(corpus).top(queries.limit(0), 3).count() == 0


def test_a_hot_text_is_spread_out_in_even_tasks(spark):
    """One text asked 60 times and 90 rows of two texts are 5,400 pairs of one key; no task makes more than its packs, and all rows are those of the plain join."""
    corpus = spark.createDataFrame([(i, "steel beam", "metal" if i % 9 else "wood") for i in range(90)] + [(100, None, "metal"), (101, "glass", None)], "uuid long, name string, classification string")
    queries = spark.createDataFrame([(i, "steal beam") for i in range(60)] + [(60, "metal"), (61, ""), (62, None)], "query_id long, text string")
    index = lexical.Index(corpus)
    asked = lexical._bags(queries, "text")
    made = lexical.to_rows(index.explained(asked), asked, index, pack=8)
    sizes = [r[0] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    columns = ["query_id", "uuid", "source", "term", "distance", *[F.round(c, 9).alias(c) for c in ("weight", "idf", "tf", "contribution")]]
    every = lexical.bm25f_terms(queries, corpus)
    assert sorted(map(tuple, made.select(*columns).collect())) == sorted(map(tuple, every.select(*columns).collect()))
    assert len(sizes) > 1 and max(sizes) < sum(sizes) / 2
    scores = lexical.bm25f_scores(queries, corpus).select("query_id", "uuid", "score")
    assert sorted(map(tuple, lexical.every_score(queries, corpus).collect())) == sorted(map(tuple, scores.collect()))


def test_a_found_row_explodes_to_few_rows_at_a_time_and_is_calibrated_once(spark):
    """Spark holds all rows that one row explodes to, so a hot text's ids lie in small packs; confidences are of texts and forms, not of the rows made."""
    kept = []
    found = spark.createDataFrame([("a", "x"), ("a", "y")], "asked string, held string")
    queries, rows = spark.range(900).selectExpr("id as query_id", "'a' as asked"), spark.range(2000).selectExpr("id as uuid", "if(id < 1900, 'x', 'y') as held")
    assert lexical.spread(found, queries, rows, lambda df: kept.append(df) or df).count() == 900 * 2000
    packs = [max(len(r[c]) for r in df.collect()) for df in kept for c in ("uuids", "query_ids") if c in df.columns]
    assert len(packs) == 2 and max(packs) < 256
    assert "EXP(" not in registry.queries()["calibrated_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().upper()


def test_packs_that_are_too_many_to_be_broadcast_meet_the_rows_found(spark):
    found = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "y", 3), ("b", "none", 4)], "bag string, form string, z int")
    asked = spark.range(200).selectExpr("id as query_id", "if(id < 150, 'a', 'b') as bag")
    rows = spark.range(300).selectExpr("id as uuid", "if(id % 3 > 0, 'x', 'y') as form")
    made = lexical.by_packs(found, asked, rows, pack=16, made=3000, most_ids=100)
    want = found.join(asked, "bag").join(rows, "form")
    assert sorted(map(tuple, made.select("query_id", "uuid", "z").collect())) == sorted(map(tuple, want.select("query_id", "uuid", "z").collect()))
