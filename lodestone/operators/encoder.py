"""Dense vectors of texts: hashed words and character trigrams, weighed by how rare they are in a corpus, projected on seeded signs.

A stand-in for a trained embedding model that runs as aggregation: no row leaves the JVM, and equal texts get equal vectors wherever they are encoded. Weights are whole
numbers, so sums are exact in any order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens, trigrams
from lodestone.operators.sizes import small

#: Components (two 32-bit words of signs), the unit of a weight, and how much more a word weighs than a trigram.
DIMS, UNIT, WORD = 64, 1000, 2
SEED = "encoder"


def features(texts: DataFrame) -> DataFrame:
    """Rows (text, feature): the different words (w:) and trigrams (g:) of each different text; a null text has none."""
    words = F.transform(F.array_distinct(tokens(F.col("text"))), lambda w: F.concat(F.lit("w:"), w))
    grams = F.transform(trigrams(F.col("text")), lambda g: F.concat(F.lit("g:"), g))
    return texts.select("text").distinct().select("text", F.explode(F.concat(words, grams)).alias("feature"))


@dataclass(frozen=True)
class Encoder:
    """known: rows (feature, df) of a corpus; n: its different texts."""

    known: DataFrame
    n: int

    def weight(self) -> Column:
        df = F.coalesce("df", F.lit(0))
        rare = F.round(UNIT * F.log(1 + (F.lit(self.n) - df + 0.5) / (df + 0.5))).cast("long")
        return rare * F.when(F.col("feature").startswith("w:"), WORD).otherwise(1)

    def encode(self, texts: DataFrame) -> DataFrame:
        """Rows (text, v), one for each different text that is not null: a unit vector, or zeros for a text without a word or trigram. Features that the corpus lacks count as the rarest."""
        bits = [F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), "feature").cast("binary")), at, 8), 16, 10).cast("long") for at in (1, 9)]
        weighed = features(texts).join(small(self.known), "feature", "left").select("text", self.weight().alias("w"), bits[0].alias("low"), bits[1].alias("high"))
        sign = lambda j: 2 * F.shiftright("high" if j >= 32 else "low", j % 32).bitwiseAND(F.lit(1)) - 1
        sums = weighed.groupBy("text").agg(*[F.sum(F.col("w") * sign(j)).alias(f"s{j}") for j in range(DIMS)]).select("text", F.array(*[f"s{j}" for j in range(DIMS)]).cast("array<double>").alias("v"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        unit = sums.select("text", norm.alias("norm"), "v").select("text", F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v")).alias("v"))
        none = F.array_repeat(F.lit(0.0), DIMS)
        return texts.select("text").where("text is not null").distinct().join(unit, "text", "left").select("text", F.coalesce("v", none).alias("v"))


def fit(texts: DataFrame) -> Encoder:
    """The encoder of a corpus: how many of its different texts hold each feature. Only counts are kept; nothing is trained."""
    known = features(texts).groupBy("feature").agg(F.count("*").alias("df"))
    return Encoder(known, texts.select("text").where("text is not null").distinct().count())
