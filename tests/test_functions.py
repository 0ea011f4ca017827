import pytest
from pyspark.sql import functions as F

from lodestone.functions import numbers, text


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", float: "double", int: "long", bool: "boolean"}
    schema = ", ".join(f"{n} {kinds[type(values[n])] if values[n] is not None else 'string'}" for n in names) or "x string"
    row = tuple(values.values()) or ("",)
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_tokens_and_trigrams(spark):
    assert one(spark, text.tokens(F.col("a")), a="Beton C25/30, Old") == ["beton", "c25", "30", "old"]
    assert one(spark, text.tokens(F.col("a")), a=None) == []
    assert one(spark, text.trigrams(F.col("a")), a="abab") == ["aba", "bab"]
    assert one(spark, text.trigrams(F.col("a")), a="ab") == []


def test_escapes(spark):
    assert one(spark, text.html_escaped(F.col("a")), a='<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, text.markdown_cell(F.col("a")), a="a|b\r\nc") == "a\\|b  c"


def test_blank_and_chain(spark):
    assert one(spark, text.blank_to(F.col("a"), "(unknown)"), a="  ") == "(unknown)"
    assert one(spark, text.first_filled(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert one(spark, text.first_filled(F.col("a")), a=None) == ""


def test_filters(spark):
    assert one(spark, text.fuzzy_match(F.col("a"), F.lit("con fra")), a="Structural Framing Concrete")
    assert not one(spark, text.fuzzy_match(F.col("a"), F.lit("con xyz")), a="Concrete")
    assert one(spark, text.regex_match(F.col("a"), "^walls?$"), a="Walls")
    assert not one(spark, text.regex_match(F.col("a"), "(["), a="([")


def test_translated_path_keeps_unknown(spark):
    assert one(spark, text.translated_path(F.col("a"), {"Beton": "Concrete"}), a="Beton / Holz") == "Concrete / Holz"


def test_bar_and_truncation(spark):
    assert one(spark, text.text_bar(F.col("a"), 4), a=0.5) == "##.."
    assert one(spark, text.truncated(F.col("a"), 3, "..."), a="abcd") == "abc..."


def test_clean_number_keeps_small_values(spark):
    assert one(spark, numbers.clean_number(F.col("a")), a=1.2e-5) == pytest.approx(1.2e-5)
    assert one(spark, numbers.clean_number(F.col("a")), a=2400.00004) == 2400.0
    assert one(spark, numbers.clean_number(F.col("a")), a=0.0) == 0.0


def test_percent_tiers_and_bands(spark):
    assert [one(spark, numbers.percent(F.col("a")), a=x) for x in (0.005, 1.7, -1.0)] == [1, 100, 0]
    assert [one(spark, numbers.tier(F.col("a")), a=x) for x in (14.9, 15.0, 45.0, 70.0)] == ["very low", "low", "high", "very high"]
    assert one(spark, numbers.cosine_band(F.col("a")), a=0.5) == "related"


def test_reports_escape_whole_texts(spark):
    from lodestone.plans import registry

    data = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = registry.queries()["report_escapes"](spark, data).collect()
    assert len(got) == len(texts) and max(map(len, texts.values())) > 80
    for r in got:
        whole = texts[r["doc_id"]]
        assert r["html"] == whole.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
        assert r["cell"] == whole.replace("|", "\\|").replace("\r", " ").replace("\n", " ")
