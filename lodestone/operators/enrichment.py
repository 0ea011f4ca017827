"""Query enrichment, search texts and report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import blank_to, translated_path

# The fields in the order in which they are added, the order in which a ladder adds them, the best set, and those that are noise.
FIELDS = ("class", "description", "concrete_grade", "structural_class", "host_categories", "density", "thermal_conductivity", "host_types")
LADDER_ORDER = ("class", "description", "concrete_grade", "structural_class", "host_categories", "density", "thermal_conductivity", "host_types")
BEST = ("class", "description", "concrete_grade", "structural_class")
NOISE = ("density", "thermal_conductivity", "host_types")


def ladder(fields: tuple[str, ...] | list[str]) -> list[tuple[str, list[str], bool]]:
    """(label, fields, whether the last one is noise) of cumulative field sets: the name alone, then each chosen field more, in LADDER_ORDER."""
    out, held = [("name", [], False)], []
    for field in (f for f in LADDER_ORDER if f in fields):
        held = [*held, field]
        out.append((field, held, field in NOISE))
    return out


def enriched_query(name: Column, fields: list[str], columns: dict[str, Column]) -> Column:
    """The name and the filled fields after it, in the order of FIELDS whatever order they are given in; unknown fields are left out."""
    chosen = [f for f in FIELDS if f in fields and f in columns]
    return F.concat_ws(" ", F.trim(name), *[F.nullif(F.trim(columns[f].cast("string")), F.lit("")) for f in chosen])


def search_text(name: Column, classification: Column, table: dict[str, str] | None = None) -> Column:
    """What lexical modes look at: lower-case name and translated classification."""
    return F.lower(F.concat_ws(" ", name, translated_path(classification, table or {})))


def semantic_text(text: Column, name: Column) -> Column:
    """What is embedded for a dataset; the name where there is no text."""
    return blank_to(text, name)


def host_string(categories: Column, types: Column) -> Column:
    """`categories (types)`, or whichever is there."""
    cats, kinds = F.array_join(categories, ", "), F.array_join(types, ", ")
    return F.when((cats != "") & (kinds != ""), F.concat(cats, F.lit(" ("), kinds, F.lit(")"))).otherwise(F.concat(cats, kinds))


def preview(entries: DataFrame, fields: list[str], columns: dict[str, Column], applied: list[str] | None = None) -> DataFrame:
    """The enriched text of the first match (else the first entry), whether any field was added, and whether it is stale: the last run, if any, applied other fields."""
    first = entries.orderBy((F.col("label") == "match").desc(), "ordinal").limit(1)
    text = enriched_query(F.col("name"), fields, columns)
    stale = applied is not None and set(applied) != set(fields)
    return first.select("ordinal", "name", text.alias("preview"), (text != F.trim("name")).alias("added"), F.lit(stale).alias("stale"))


def merged_items(left: DataFrame, right: DataFrame) -> DataFrame:
    """Items (uuid, name) of two sides by uuid; where both have one, the left side's stays."""
    a, b = left.select("uuid", F.col("name").alias("__l")), right.select("uuid", F.col("name").alias("__r"))
    return a.join(b, "uuid", "full").select("uuid", F.coalesce("__l", "__r").alias("name"))


def executive_summary(recalls: DataFrame) -> DataFrame:
    """One sentence a mode from its recall counts."""
    share = lambda c: F.round(100 * F.col(c) / F.greatest(F.col("denom"), F.lit(1)), 1).cast("string")
    text = F.concat("mode", F.lit(" finds "), share("rall"), F.lit(" % anywhere and "), share("r1"), F.lit(" % at rank 1"))
    return recalls.select("mode", text.alias("sentence"))


def provenance(corpus_files: DataFrame) -> DataFrame:
    """File and modification time of what a run read; the input keeps its file metadata column."""
    return corpus_files.select("_metadata.file_name", F.date_format("_metadata.file_modification_time", "yyyy-MM-dd HH:mm").alias("modified")).distinct()
