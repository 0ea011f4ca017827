"""Joins by pieces, grams and literals against comparing all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical, truth


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def one_column(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def pairs(df, *columns):
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_edit_pairs_equal_all_pairs(spark, edits):
    rng = random.Random(edits)
    words = {"".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(160)} | {"", "a" * 80, "a" * 78, "b" + "a" * 79}
    terms = {"".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(60)} | {"", "a" * 79, "a" * 81 + "b"}
    got = pairs(lexical.edit_pairs(one_column(spark, "term", [*terms, None]), one_column(spark, "known", [*words, None]), edits), "term", "known", "distance")
    assert got == {(t, w, distance(t, w)) for t in terms for w in words if distance(t, w) <= edits}


def test_keys_of_a_term_do_not_grow_with_its_length(spark):
    terms, words = one_column(spark, "term", ["a" * 64, "abcdefgh"]), one_column(spark, "known", ["abcdefgi", "b" * 64])
    plan = lexical.edit_candidates(terms, words, 2)
    assert pairs(plan, "term", "known") == {("abcdefgh", "abcdefgi")}
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2
    rng = random.Random(1)
    known = ["".join(rng.choices("abcdefghij", k=10)) for _ in range(2000)]
    asked = [w[:3] + w[4:] for w in known[:50]]
    assert lexical.edit_candidates(one_column(spark, "term", asked), one_column(spark, "known", known), 2).count() < 50 * 2000 / 10


def test_substring_pairs_equal_all_pairs(spark):
    rng = random.Random(7)
    hays = {"".join(rng.choices("abc ", k=rng.randint(0, 12))) for _ in range(200)}
    needles = {"".join(rng.choices("abc ", k=rng.randint(1, 5))) for _ in range(80)} | {"zzz", "z", "abz"}
    got = lexical.substring_pairs(one_column(spark, "hay", [*hays, None]), one_column(spark, "needle", [*needles, "", None]))
    assert pairs(got, "hay", "needle") == {(h, n) for h in hays for n in needles if n in h}


def test_a_prefix_that_all_share_brings_no_pairs(spark):
    hays = one_column(spark, "hay", [f"common name {i:05d}" for i in range(3000)])
    asked = one_column(spark, "needle", [f"common name {i:05d}" for i in range(0, 3000, 10)])
    sets = asked.select("needle", lexical._grams(F.col("needle")).alias("grams"))
    met = lexical.gram_candidates(hays, sets)
    assert met.count() < 3000 * 300 / 20
    assert lexical.substring_pairs(hays, asked).count() == 300


def test_a_common_gram_is_dealt_to_salts(spark):
    hays = one_column(spark, "hay", [f"{i} abc" for i in range(1000)])
    sets = one_column(spark, "needle", ["n1", "n2"]).withColumn("grams", F.array(F.lit("abc")))
    met = lexical.gram_candidates(hays, sets, meeting=100)
    assert met.count() == 2000
    assert lexical.gram_candidates(hays, sets).count() == 2000
    tasks = lexical.gram_candidates(hays, sets, meeting=100).select(F.pmod(F.xxhash64("hay"), F.lit(20)).alias("salt")).groupBy("salt").count()
    assert tasks.count() == 20 and tasks.agg(F.max("count")).first()[0] < 200


PATTERNS = ["blue ring", "^OLD", "bl.e", "(blue|red) ri", "r(in|an)g$", "ol?d", "(?:steel )+x", "[bo]l[ut]", "x{2,3}", "old|bolt", "(abc){0}ring", "a.*b.*c", r"\bring\b", "RING", "(", "[", "", None, "(?=blue)b", "blue(?! ring)", "ri(n)(g)", "\\+", "[[a]b]ring"]


def test_regex_search_equals_all_pairs(spark):
    rng = random.Random(3)
    words = ["blue", "Old", "red ri", "ring", "rang", "bolt", "steel steel x", "xx", "a+b", "BLUE", "Ring", "é"]
    corpus = [(i, None if i % 19 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 3))), None if i % 7 == 0 else rng.choice(words)) for i in range(120)]
    asked = [(i, p) for i, p in enumerate(PATTERNS)] + [(100, "blue ring")]
    got = pairs(lexical.regex_search(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(corpus, "uuid long, name string, classification string")), "query_id", "uuid")

    def holds(pattern, text):
        try:
            return bool(re.search(pattern, text, re.IGNORECASE)) if pattern != "[[a]b]ring" else bool(re.search("[ab]ring", text, re.IGNORECASE))
        except (re.error, TypeError):
            return False

    assert got == {(q, u) for q, p in asked for u, n, c in corpus if holds(p, " ".join(x for x in (n, c) if x is not None))}


def test_required_literals():
    need = lexical.required
    assert need("Blue ring") == [["blue ring"]] and need("blue|red1") == [["blue"], ["red1"]] and need("(blue|re)") == [[]] and need("a(bcd)+e") == [["bcd"]]
    assert need("(bcd)*") == [[]] and need("ab?cdef") == [["cdef"]] and need("^foo.*barx$") == [["barx", "foo"]] and need("(") is None and need(None) is None and need("[a[b]cde") == [[]]


def test_containment_equals_all_pairs(spark):
    rng = random.Random(5)
    words = ["one", "two", "three", "four", "five", "six"]
    texts = [(i, None if i % 31 == 0 else rng.choice([" ", "  "]).join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(120)]
    passages = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(60)] + [(60, "ne two three four five six on"), (61, ""), (62, None)] + [(70 + i, t[5:60]) for i, t in texts[1:20] if t and len(t) > 70]
    a, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, passage string")
    want = {(d, i) for d, t in texts for i, p in passages if t is not None and p is not None and p in t}
    assert pairs(truth.containment_join(a, b), "doc_id", "item_id") == want
