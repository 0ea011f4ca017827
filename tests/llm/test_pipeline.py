"""The pipeline's stages: columns, decisions and what they keep."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import queries, sharding


def test_stages_in_order_and_their_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    first, tables = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "/root/testdata/sf0.01").persist()
        assert after.columns == first.columns, name
        tables.append([(r["doc_id"], r["text"]) for r in after.select("doc_id", "text").collect()])
        docs = after
    good, spoken, unique, mixed = tables
    known = [labels[i] for i, _ in good if i in labels]
    assert sum(known) / len(known) > 0.98 and len(good) > 800
    assert len(spoken) > 0.99 * len(good)
    assert len({t for _, t in unique}) == len(unique) and {i for i, _ in unique} <= {i for i, _ in spoken}
    assert {i for i, _ in mixed} <= {i for i, _ in unique} and len(mixed) > len(unique)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len([1 for r in packed if r["piece"] == 0]) == len(mixed)


NAMES = "row score size from source_size target copies draw rate spot same body word0 word1 at cid anchor home lang_pred accepted key y col n start cell region rack shard_ __size __spot __body __same __score __lang a.b piece length".split()


def test_stages_keep_columns_of_any_name(spark):
    """Columns that are called as the operators' own ones come back with their values from every stage but the last, which does not read them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in NAMES])
    own = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert len(rows) > 100 and all(r == own[r["doc_id"]] for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 200
    tree = sharding.topology(4)
    placed = sharding.with_slot(sharding.with_shard(docs, "doc_id", tree), ["doc_id"])
    assert [tuple(r)[: len(docs.columns)] for r in placed.orderBy("doc_id").select(*[F.col(f"`{c}`") for c in docs.columns]).collect()] == [tuple(own[i]) for i in sorted(own)]


def test_tables_of_a_run_go(spark):
    from lodestone.llm.common import release, scratch, shared_path

    spark.range(3).write.parquet(shared_path(spark, "left"))
    here = scratch(spark).removeprefix("file:").replace("//", "/")
    assert os.listdir(here)
    release(spark)
    assert not os.path.exists(here)
    assert os.path.isdir(scratch(spark).removeprefix("file:").replace("//", "/"))


def test_a_cluster_needs_a_shared_folder():
    from lodestone.llm.common import shared_dir

    def session(master, folder=None):
        conf = type("C", (), {"get": staticmethod(lambda k, d: folder)})
        return type("Session", (), {"conf": conf, "sparkContext": type("S", (), {"master": master, "applicationId": "app"})})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session("local[2]")) == shared_dir(session("local[2]")) != ""


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
