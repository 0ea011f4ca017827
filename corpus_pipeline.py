"""From raw documents to packed sequences: five stages, each one of the corpus operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next stage's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, mixing, packing, quality, simhash
from lodestone.llm.common import remove, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the quality classifier does not reject."""
    vectors = quality.word_vectors(docs)
    net = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), vectors)
    return quality.score_quality(docs, vectors, net).where(F.col("score") >= quality.KEEP_FROM).select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lie near enough to a learned language; texts without a letter go."""
    return langid.identify(docs, langid.fit_languages(docs)).where("accepted").select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, an estimated similarity of 0.8 or more."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.emit_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs, with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the classifiers, fingerprints and tokens; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result but the last written to the shared folder and reread; a stage's result goes once the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = written(docs, f"stage{k}")
            if before:
                remove(spark, before)
            before = path
    return docs
