"""Joining names in scope to ground truth entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import join_key
from lodestone.operators.lexical import Keep, as_is, substring_pairs
from lodestone.operators.sizes import small


def first_entries(entries: DataFrame, name_col: str = "name") -> DataFrame:
    """One entry for each normalised name: the one of lowest ordinal."""
    keyed = entries.withColumn("key", join_key(F.col(name_col)))
    return keyed.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy("ordinal"))).where("__n = 1").drop("__n")


def scope_truth_join(scope: DataFrame, entries: DataFrame, keep: Keep = as_is) -> DataFrame:
    """scope (name) with the ordinal and label of its entry and how it was found: exact, substring or none.

    Names are matched on their trimmed lower case first. Only names left over are compared by substring, either way round, with
    distinct entry names, see substring_pairs; the entry of lowest ordinal wins.
    """
    first = keep(first_entries(entries).select("key", "ordinal", "label"))
    names = scope.withColumn("key", join_key(F.col("name")))
    exact = names.join(first, "key", "left")
    left_over = keep(exact.where("ordinal is null and key <> ''").select("key").distinct())
    known = first.where("key <> ''").select(F.col("key").alias("other"))
    inside = substring_pairs(left_over, known, "key", "other", keep).unionByName(substring_pairs(known, left_over, "other", "key", keep))
    empty = first.where("key = ''").select(F.struct(F.col("ordinal").alias("o"), F.col("label").alias("l")).alias("e"))
    near = inside.join(first.withColumnRenamed("key", "other"), "other").select("key", F.struct(F.col("ordinal").alias("o"), F.col("label").alias("l")).alias("e"))
    near = near.unionByName(left_over.join(F.broadcast(empty), F.lit(True))).groupBy("key").agg(F.min("e").alias("n"))
    out = exact.join(near, "key", "left")
    how = F.when(F.col("ordinal").isNotNull(), "exact").when(F.col("n").isNotNull(), "substring").otherwise("none")
    return out.select("name", F.coalesce("ordinal", "n.o").alias("ordinal"), F.coalesce("label", "n.l").alias("label"), how.alias("how"))


def containment_join(texts: DataFrame, passages: DataFrame, gram: int = 4) -> DataFrame:
    """Rows (doc_id, item_id) where a text holds a passage: texts (doc_id, text), passages (item_id, passage); a null text or passage holds or is held by none.

    A passage's inner words decide: between its first and last word, which may be parts of longer ones, a run of `gram` words stands in any text that holds it. Texts' runs
    are joined to the passages' on equality and the pairs that meet are verified; only passages with fewer words are searched for in every text.
    """
    holds = F.col("text").contains(F.col("passage"))
    split = lambda c: F.split(c, r"\s+")
    inner = passages.where("passage is not null").select("item_id", "passage", split(F.col("passage")).alias("w"))
    keyed = inner.where(F.size("w") >= gram + 2).select("item_id", "passage", F.xxhash64(*[F.col("w")[i] for i in range(1, gram + 1)]).alias("key"))
    words = texts.select("doc_id", "text", split(F.col("text")).alias("w")).withColumn("last", F.size("w") - gram)
    spots = F.sequence(F.lit(0), F.col("last"))
    runs = F.when(F.col("last") >= 0, F.transform(spots, lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(gram)]))).otherwise(F.expr("cast(array() as array<bigint>)"))
    hits = words.select("doc_id", F.explode(F.array_distinct(runs)).alias("key")).join(small(keyed.select("key", "item_id")), "key").select("doc_id", "item_id").distinct()
    sure = hits.join(texts, "doc_id").join(small(passages), "item_id").where(holds).select("doc_id", "item_id").distinct()
    short = small(inner.where(F.size("w") < gram + 2).select("item_id", "passage"))
    return sure.unionByName(texts.join(short, holds).select("doc_id", "item_id"))


def with_acceptable(entries: DataFrame) -> DataFrame:
    """acceptable united with the correct id where that is not empty."""
    filled = F.col("correct_uuid").isNotNull() & (F.col("correct_uuid").cast("string") != "")
    return entries.withColumn("acceptable", F.when(filled, F.array_union("acceptable", F.array("correct_uuid"))).otherwise(F.array_distinct("acceptable")))


def acceptable_rows(marks: DataFrame, correct: DataFrame, key: str) -> DataFrame:
    """The same union with truth as rows: distinct (key, uuid) of marks and of correct, where an empty id is none."""
    filled = correct.where(F.col("uuid").isNotNull() & (F.col("uuid").cast("string") != ""))
    return marks.select(key, "uuid").unionByName(filled.select(key, "uuid")).distinct()
