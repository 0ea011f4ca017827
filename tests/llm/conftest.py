import pytest

TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs away from the old farm house today",
    "the QUICK brown fox jumps over the lazy dog and runs away from the old farm house today",
    "The quick brown fox jumps over the lazy dog and runs away from the old farm house tonight",
    "Der schnelle braune Fuchs springt über den faulen Hund und läuft heute vom alten Bauernhof weg",
    "Released under the MIT License. See the GNU General Public License and CC BY; apache\tlicense.",
    "cc by cc by mit-license MIT License",
    "", " \n\t ", "a", "a b", "12345 %%% 678", "it's 12 ab's  'll   odd\n \n spaces  ", "<|endoftext|> ünïcödé ‘quotes’ 漢字 \U0001f600 𐍈",
    "word " * 9000, "x" * 50_000, "K" + "elvin license", "same", "same",
]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): nulls, empty and very long texts, copies, repeated rows and ids."""
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "é", "B"][i % 5]) for i, t in enumerate(TEXTS)]
    out += [(100, None, None, "a"), (None, "null id", "en", "a"), (None, None, None, None), (7, "same id, other text", "en", "zz"), (3, TEXTS[3], "de", "b"), (3, TEXTS[3], "de", "b")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """rows as a table whose further columns clash with names that operators use."""
    wide = [(*r, 0, "x", "y", 1, 2.0, True, "z", 5, b"q") for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, size int, score double, home boolean, label string, id int, vector binary"
    return spark.createDataFrame(wide, schema).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
