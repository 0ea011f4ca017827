"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import of, written

# The weights that sources take in turn, the share of all sizes to be taken, the most times a source repeats.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Sources whose targets are broadcast: some 10 MB.
MOST_BROADCAST = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Rows (source, source_size, target, rate) from rows (source, source_size), one per source.

    Sources are weighed in code point order, null last. A target is the source's weight's part of share times all sizes, at most
    most times its size; what is over goes to the others by weight until none is above. With sources in ascending order of
    cap / weight the capped ones come first, so running sums give each possible cut and the first one that holds
    is the answer. The windows run in one task over the sources' table, one row a source: sources name origins, whose number a
    task must hold, not documents.
    """
    ranked = sizes.selectExpr("source", "source_size", "row_number() over (order by source asc nulls last) as __n")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__n") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    before = "over (order by __cap / __w, __n rows between unbounded preceding and 1 preceding)"
    cuts = capped.selectExpr(
        "*",
        f"coalesce(sum(source_size) {before}, 0) * {float(most)}D as __caps",
        f"sum(__w) over () - coalesce(sum(__w) {before}, 0) as __left",
        f"sum(source_size) over () * {float(share)}D as __all",
    ).withColumn("__level", (F.col("__all") - F.col("__caps")) / F.col("__left"))
    # the first source in that order whose cap is not below its level ends the capped ones
    levels = cuts.selectExpr("*", "min(case when __level * __w <= __cap then struct(__cap / __w as at, __n as n, __level as level) end) over () as __cut")
    full = F.col("__cut").isNull() | (F.struct((F.col("__cap") / F.col("__w")).alias("at"), F.col("__n").alias("n")) < F.struct(F.col("__cut.at"), F.col("__cut.n")))
    target = F.when(full, F.col("__cap")).otherwise(F.col("__cut.level") * F.col("__w"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return levels.withColumn("target", target.cast("double")).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def with_copies(rows: DataFrame, draw: Column, text: Column, source: Column, keep: list[Column]) -> DataFrame:
    """Rows (*keep, size, source_size, target, copies): copies is floor(rate) plus one if draw, uniform in [0, 1), falls below the fraction.

    A null source is a source of its own. The table of targets is written and counted first: up to MOST_BROADCAST sources it is
    broadcast, so the documents are not shuffled; beyond that it is joined, where Spark can split a hot source's partition, as one
    side has one row a key.
    """
    sizes = rows.groupBy(source.alias("source")).agg(F.sum(word_count(text)).cast("long").alias("source_size"))
    targets, _ = written(source_targets(sizes), "targets")
    drawn = rows.select(*keep, source.alias("from"), word_count(text).alias("size"), draw.alias("draw"))
    few = targets.count() <= MOST_BROADCAST
    joined = drawn.join(F.broadcast(targets) if few else targets, F.col("from").eqNullSafe(F.col("source")))
    extra = (F.col("draw") < F.col("rate") - F.floor("rate")).cast("int")
    return joined.withColumn("copies", F.floor("rate").cast("int") + extra).drop("source", "from", "draw", "rate")


def hashed_draw(seed: str, key: Column, text: Column) -> Column:
    """A number in [0, 1) from a hash of seed, id and text, so reruns agree and equal rows draw alike."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    A null or wordless text has size 0 and takes nothing; a source without words has target 0. Equal rows draw alike, so
    reruns and repeated rows agree. An empty table gives no rows. Other columns are not read.
    """
    key, text = of(id_col), of(text_col)
    mixed = with_copies(docs, hashed_draw(seed, key, text), text, of(source_col), [key.alias("doc_id")])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def emit_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """docs with every row as often as the mix takes it; columns of any name come back unchanged."""
    text = of(text_col)
    mixed = with_copies(docs, hashed_draw(seed, of(id_col), text), text, of(source_col), [F.struct("*").alias("row")])
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
