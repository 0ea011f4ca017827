"""The text encoder against a plain Python version, and the dense modes that rank by it."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import encoder, stats
from lodestone.plans.roles import Roles

CORPUS = ["Steel Beam", "steel beam", "Concrete wall C25/30", "wall", "Ünïcode Glas 漢字", "", "a", None, "wall"]


def by_hand(text, corpus):
    grams = lambda t: {f"w:{w}" for w in re.findall("[a-z0-9]+", t.lower())} | {f"g:{t.lower()[i : i + 3]}" for i in range(len(t) - 2)}
    texts = {t for t in corpus if t is not None}
    out = [0] * encoder.DIMS
    for f in grams(text):
        df = sum(f in grams(t) for t in texts)
        w = math.floor(1000 * math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) + 0.5) * (2 if f.startswith("w:") else 1)
        digest = hashlib.md5(f"encoder:{f}".encode()).hexdigest()
        for j in range(encoder.DIMS):
            bits = int(digest[8 * (j // 32) : 8 * (j // 32) + 8], 16)
            out[j] += w * (2 * (bits >> j % 32 & 1) - 1)
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else [0.0] * encoder.DIMS


def test_vectors_equal_plain_python(spark):
    table = spark.createDataFrame([(t, "x", 1) for t in CORPUS], "text string, feature string, df int").repartition(3)
    fitted = encoder.fit(table)
    asked = ["steel wall", "unseen words", "Steel Beam", "--", "", "zz", "漢字 漢字", None]
    got = {r["text"]: r["v"] for r in fitted.encode(spark.createDataFrame([(t,) for t in asked * 2], "text string")).collect()}
    assert set(got) == {t for t in asked if t is not None}
    for t, v in got.items():
        assert v == pytest.approx(by_hand(t, CORPUS), abs=1e-12)
    assert fitted.n == 7 and got["--"] == [0.0] * encoder.DIMS
    nothing = encoder.fit(table.limit(0))
    assert nothing.n == 0 and nothing.encode(table.where("text = 'wall'")).count() == 1 and nothing.encode(table.limit(0)).count() == 0


def test_context_and_texts_change_dense_ranks(spark):
    """The query's text reaches the dense mode: its own item comes first, and the class lifts rows of that class."""
    roles = Roles(spark, "/root/testdata/sf0.001")
    rows = roles.semantic().join(roles.queries.select("query_id", "name", "class"), "query_id").join(roles.corpus.select("uuid", F.col("name").alias("item"), F.col("class").alias("c")), "uuid")
    means = {r["same"]: r["m"] for r in rows.groupBy((F.col("name") == F.col("item")).alias("same")).agg(F.avg("score").alias("m")).collect()}
    assert means[True] > means[False] + 0.3
    lifted = rows.where("c = class").agg(F.avg("score")).first()[0]
    told = roles.semantic(context=True).join(roles.queries.select("query_id", "class"), "query_id").join(roles.corpus.select("uuid", F.col("class").alias("c")), "uuid").where("c = class").agg(F.avg("score")).first()[0]
    assert told > lifted + 0.1
    roles.close()


def test_every_step_of_the_ladder_ranks_by_its_own_text(spark):
    roles = Roles(spark, "/root/testdata/sf0.001")
    steps = stats.ladder_steps(roles.ladder()).collect()
    for mode in ("semantic", "hybrid"):
        marginals = [r["marginal"] for r in sorted(steps, key=lambda r: r["step"]) if r["mode"] == mode and r["step"] > 1]
        assert len(marginals) == 7 and sum(m != 0 for m in marginals) >= 3
    roles.close()
