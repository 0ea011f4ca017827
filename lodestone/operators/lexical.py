"""Lexical retrieval: corpus statistics, field-weighted BM25, typo expansion, regex and fuzzy filters.

Corpora are rows (uuid, name, classification). Nothing here compares all queries with all corpus rows: terms are
exploded and joined on equality. The vocabulary, not the corpus, is what misspelt terms are compared with.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens, trigrams
from lodestone.operators.ranking import ranked
from lodestone.operators.sizes import MOST_ROWS, small


@dataclass(frozen=True)
class Bm25f:
    """Parameters; the defaults are common published ones."""

    k1: float = 1.2
    b_name: float = 0.75
    b_class: float = 0.75
    w_name: float = 2.0
    w_class: float = 1.0
    max_distance: int = 2


def postings(corpus: DataFrame, *carried: str) -> DataFrame:
    """Rows (uuid, *carried, term, tf_name, tf_class, len_name, len_class)."""
    fields = corpus.select("uuid", *carried, tokens(F.col("name")).alias("n"), tokens(F.col("classification")).alias("c")).withColumns({"len_name": F.size("n"), "len_class": F.size("c")})
    both = F.concat(F.transform("n", lambda t: F.struct(t.alias("term"), F.lit(1).alias("name"))), F.transform("c", lambda t: F.struct(t.alias("term"), F.lit(0).alias("name"))))
    flat = fields.select("uuid", *carried, "len_name", "len_class", F.explode(both).alias("t")).select("uuid", *carried, "len_name", "len_class", "t.term", "t.name")
    return flat.groupBy("uuid", *carried, "term", "len_name", "len_class").agg(F.sum("name").cast("long").alias("tf_name"), F.sum(1 - F.col("name")).cast("long").alias("tf_class"))


def field_lengths(corpus: DataFrame) -> DataFrame:
    """One row: n_docs, avg_name, avg_class."""
    return corpus.agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens(F.col("name")))).alias("avg_name"), F.avg(F.size(tokens(F.col("classification")))).alias("avg_class"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(corpus: DataFrame) -> DataFrame:
    """Rows (term, df), as document_frequency of the postings gives them, for a corpus with one row a uuid: each row's different terms are counted by partial sums, and no posting is shuffled."""
    return corpus.select(F.explode(F.array_distinct(F.concat(tokens(F.col("name")), tokens(F.col("classification"))))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """Rows (term, df, n_docs, avg_name, avg_class)."""
    return vocabulary(corpus).crossJoin(F.broadcast(field_lengths(corpus)))


def query_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))


def _piece(text: str, size: Column, i: int, edits: int, shift: int = 0) -> Column:
    """Piece i, moved by shift, of the edits + 1 even ones of a text of length size, with the two numbers that tell it apart; null where it would leave the text."""
    at = lambda n: F.floor(n * size / (edits + 1)).cast("int")
    start, long = at(i) + shift, at(i + 1) - at(i)
    inside = (size >= 0) & (start >= 0) & (start + long <= F.length(text))
    return F.when(inside, F.struct(size.alias("size"), F.lit(i).alias("i"), F.substr(F.col(text), start + 1, long).alias("piece")))


def edit_candidates(terms: DataFrame, vocabulary: DataFrame, max_distance: int) -> DataFrame:
    """Rows (term, known) that meet on a piece, each pair once; all pairs within max_distance edits are among them.

    A known word is cut into d + 1 even pieces, one of which d edits leave whole, so it stands in the term. Where that is the i-th (from 0), at most i edits need be looked
    for before it: with more, at most d - i - 1 are left for the d - i pieces after it, and one of those is whole as well. So it is moved by i at most, counted from
    the front, and by d - i, counted from the end. For d = 2 a word has 3 keys and a term 19, however long they are. Words of up to d letters have an empty first piece and
    meet all terms whose length suits.
    """
    d = max_distance
    cuts = F.array(*[_piece("known", F.length("known"), i, d) for i in range(d + 1)])
    moves = [(more, i, shift) for more in range(-d, d + 1) for i in range(d + 1) for shift in range(max(-i, more - d + i), min(i, more + d - i) + 1)]
    spots = F.array(*[_piece("term", F.length("term") - more, i, d, shift) for more, i, shift in moves])
    held = vocabulary.select("known", F.explode(cuts).alias("key"))
    asked = terms.select("term", F.explode(F.array_distinct(F.array_compact(spots))).alias("key"))
    return asked.join(held, "key").select("term", "known").distinct()


def edit_pairs(terms: DataFrame, vocabulary: DataFrame, max_distance: int) -> DataFrame:
    """Rows (term, known, distance) of all terms and vocabulary words (known) within max_distance edits; only pairs that share a piece are measured, see edit_candidates."""
    pairs = edit_candidates(terms.where("term is not null"), vocabulary.where("known is not null"), max_distance)
    return pairs.withColumn("distance", F.levenshtein("term", "known", max_distance)).where(F.col("distance") >= 0)


#: Letters of a gram, and the pairs that one salt of a gram meets, about.
GRAM, MEETING = 3, 1_000_000


def _grams(text: Column, n: int = GRAM) -> Column:
    spots = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(spots)).otherwise(F.expr("cast(array() as array<string>)"))


Keep = Callable[[DataFrame], DataFrame]


def as_is(df: DataFrame) -> DataFrame:
    return df


def gram_candidates(hays: DataFrame, asked: DataFrame, fold: bool = False, sizes: Iterable[int] = range(1, GRAM + 1), meeting: int = MEETING, keep: Keep = as_is) -> DataFrame:
    """Rows (hay, needle) of different hays for different rows of asked (needle, grams, a set of strings of `sizes` letters that a hay must hold): of each set only the
    gram that the fewest hays hold is looked for, and sets with a gram that none holds are dropped at once. fold looks in the lower-cased hay.

    How many hays hold a gram is counted first. The hays of a gram are dealt to salts, each of which meets that gram's needles in about `meeting` pairs, so no common gram
    makes a task of its own size. Hays are read twice; keep is called on the chosen grams, which are no more than the sets.
    """
    text = F.lower("hay") if fold else F.col("hay")
    held = hays.select("hay").distinct().select("hay", F.explode(F.array_distinct(F.concat(*[_grams(text, n) for n in sizes]))).alias("gram"))
    counts = held.groupBy("gram").agg(F.count("*").alias("hays"))
    rare = asked.select("needle", "grams", F.explode("grams").alias("gram")).join(counts, "gram", "left")
    rare = rare.groupBy("needle", "grams").agg(F.min(F.struct(F.coalesce("hays", F.lit(0)).alias("hays"), "gram")).alias("r"))
    keyed = keep(rare.where("r.hays > 0").select("needle", "r.gram", "r.hays"))
    salted = small(keep(keyed.groupBy("gram").agg(F.ceil(F.first("hays") * F.count("*") / F.lit(meeting)).cast("int").alias("salts"))))
    dealt = held.join(salted, "gram").select("hay", "gram", F.pmod(F.xxhash64("hay"), F.col("salts")).cast("int").alias("salt"))
    spread = keyed.join(salted, "gram").select("needle", "gram", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return dealt.join(spread, ["gram", "salt"]).select("hay", "needle")


#: Ids in one pack, rows that a task makes, about, and ids up to which a side's packs are broadcast (8 bytes each).
PACK, MADE, MOST_IDS = 128, 16_000_000, 2_000_000


def spread(found: DataFrame, queries: DataFrame, rows: DataFrame, keep: Keep = as_is, meeting: int = MADE) -> DataFrame:
    """Rows (query_id, uuid) of all queries (query_id, asked) and rows (uuid, held) of the pairs found (asked, held; each once), in tasks of about `meeting` rows, see by_packs."""
    named = found.select(F.col("asked").alias("bag"), F.col("held").alias("form"))
    return by_packs(named, queries.select("query_id", F.col("asked").alias("bag")), rows.select("uuid", F.col("held").alias("form")), keep, made=meeting).select("query_id", "uuid")


def by_packs(found: DataFrame, asked: DataFrame, rows: DataFrame, keep: Keep = as_is, pack: int = PACK, made: int = MADE, most_ids: int = MOST_IDS) -> DataFrame:
    """Rows of found (bag, form, ...) for every query of the bag, asked (query_id, bag), and every row of the form, rows (uuid, form), with query_id and uuid.

    Found rows are few, what they stand for is not. The ids of a bag's queries and of a form's rows are dealt to packs of about `pack`; a found row is sent once for each
    pair of packs, to as many tasks as the rows made need, and spread out there. So no task grows with a bag or a form, and no row made is ever shuffled. Packs are small because
    Spark holds all rows that one row explodes to: on 8 cores pairs of 1,024 x 1,024 ids make 12 million rows a second, those of 128 x 128 90 million.
    """
    dealt = lambda ids, n: F.pmod(F.xxhash64(ids), F.ceil(F.col(n) / pack)).cast("int")
    packed = lambda df, key, ids, name: df.join(df.groupBy(key).agg(F.count("*").alias("n")), key).groupBy(key, dealt(ids, "n").alias(f"{name}_pack")).agg(F.collect_list(ids).alias(f"{ids}s"))
    held, wanted, found = keep(packed(rows, "form", "uuid", "row")), keep(packed(asked, "bag", "query_id", "query")), keep(found)
    sizes = [df.groupBy(key).agg(F.sum(F.size(ids)).alias(ids)) for df, key, ids in ((held, "form", "uuids"), (wanted, "bag", "query_ids"))]
    count = found.groupBy("bag", "form").agg(F.count("*").alias("n")).join(sizes[0], "form").join(sizes[1], "bag")
    total = count.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("uuids") * F.col("query_ids")), F.lit(0.0)).alias("total"))
    few = [df.agg(((F.count("*") <= MOST_ROWS) & (F.coalesce(F.sum(F.size(c)), F.lit(0)) <= most_ids)).alias(c)) for df, c in ((held, "uuids"), (wanted, "query_ids"))]
    total, few_rows, few_queries = total.crossJoin(F.broadcast(few[0])).crossJoin(F.broadcast(few[1])).first()
    tasks = max(found.sparkSession.sparkContext.defaultParallelism, int(total // made) + 1)
    units = found.join(held.select("form", "row_pack"), "form").join(wanted.select("bag", "query_pack"), "bag")
    sides = sorted([(few_queries, wanted, ["bag", "query_pack"]), (few_rows, held, ["form", "row_pack"])], key=lambda x: x[0])
    if few_rows and few_queries:
        # a hot pair of packs is no more than pack x pack rows made
        others = F.xxhash64(*[c for c in found.columns if c not in ("bag", "form")]) if len(found.columns) > 2 else F.lit(0)
        both = units.repartition(tasks, "bag", "form", "row_pack", "query_pack", others)
    else:
        # packs that are too many to be broadcast meet the units that are dealt by them, before these hold any ids
        both = units.repartition(tasks, *sides[0][2])
    for fits, side, keys in sides:
        both = both.join(F.broadcast(side) if fits else side.hint("merge"), keys)
    carried = found.columns
    return both.select(*carried, "query_ids", F.explode("uuids").alias("uuid")).select(*carried, F.explode("query_ids").alias("query_id"), "uuid")


def substring_pairs(hays: DataFrame, needles: DataFrame, hay: str = "hay", needle: str = "needle", keep: Keep = as_is) -> DataFrame:
    """Distinct rows (hay, needle) where the one holds the other; an empty or null needle is held by none.

    Needles meet the hays that hold the rarest of their grams of three letters (of all their letters, if they are fewer), see gram_candidates; these pairs are then searched.
    """
    n = F.col("needle")
    different = needles.select(F.col(needle).alias("needle")).distinct().where(F.length("needle") > 0)
    asked = different.select("needle", F.when(F.length(n) < GRAM, F.array(n)).otherwise(_grams(n)).alias("grams"))
    pairs = gram_candidates(hays.select(F.col(hay).alias("hay")).where("hay is not null"), asked, keep=keep)
    return pairs.where(F.contains("hay", "needle")).select(F.col("hay").alias(hay), F.col("needle").alias(needle))


def typo_expansion(terms: DataFrame, vocabulary: DataFrame, max_distance: int = 2) -> DataFrame:
    """Rows (query_id, source, term, distance, weight): a known term stands for itself, any other for vocabulary terms
    within max_distance edits, of weight 1 / (1 + distance). Only different unknown terms are compared, see edit_pairs.
    """
    vocab = vocabulary.select(F.col("term").alias("known"))
    marked = terms.join(vocab, F.col("term") == F.col("known"), "left")
    kept = marked.where("known is not null").select("query_id", F.col("term").alias("source"), "term", F.lit(0).alias("distance"))
    unknown = marked.where("known is null")
    near = edit_pairs(unknown.select("term").distinct(), vocab, max_distance)
    moved = unknown.select("query_id", "term").join(near, "term").select("query_id", F.col("term").alias("source"), F.col("known").alias("term"), "distance")
    return kept.unionByName(moved).withColumn("weight", F.lit(1.0) / (F.col("distance") + 1))


def bm25f_terms(queries: DataFrame, corpus: DataFrame, text_col: str = "text", params: Bm25f = Bm25f(), pairs: DataFrame | None = None) -> DataFrame:
    """The explanation of every score: query_id, uuid, source, term, distance, weight, idf, tf, contribution; with pairs (query_id, uuid) of those only, and
    statistics are of the whole corpus all the same."""
    posted = postings(corpus)
    frequency = document_frequency(posted)
    wanted = typo_expansion(query_terms(queries, text_col), frequency, params.max_distance).join(frequency, "term")
    lengths = F.broadcast(field_lengths(corpus))
    tf_name = params.w_name * F.col("tf_name") / (1 - params.b_name + params.b_name * F.col("len_name") / F.col("avg_name"))
    tf_class = params.w_class * F.col("tf_class") / (1 - params.b_class + params.b_class * F.col("len_class") / F.col("avg_class"))
    hits = wanted.join(posted, "term") if pairs is None else wanted.join(pairs.select("query_id", "uuid"), "query_id").join(posted, ["uuid", "term"])
    hits = hits.crossJoin(lengths)
    hits = hits.withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).withColumn("tf", tf_name + tf_class)
    return hits.withColumn("contribution", F.col("weight") * F.col("idf") * F.col("tf") / (params.k1 + F.col("tf"))).select(
        "query_id", "uuid", "source", "term", "distance", "weight", "idf", "tf", "contribution"
    )


def bm25f_scores(queries: DataFrame, corpus: DataFrame, text_col: str = "text", params: Bm25f = Bm25f(), pairs: DataFrame | None = None, rows: DataFrame | None = None, keep: Keep = as_is) -> DataFrame:
    """Rows (query_id, uuid, score) for every corpus row (or pair) that shares a term; scores are rounded before anything is ranked by them. Without pairs,
    queries of one set of terms and corpus rows of the same two texts are scored once; with rows (uuid, name, classification) those get the scores, while the corpus gives the statistics."""
    if pairs is not None:
        return bm25f_terms(queries, corpus, text_col, params, pairs).groupBy("query_id", "uuid").agg(F.round(F.sum("contribution"), 6).alias("score"))
    index, asked = Index(corpus, params, keep=keep), _bags(queries, text_col)
    words = index.words(asked)
    scored = index.scores(words, index.gains(words)).withColumnRenamed("uuid", "form")
    return scored.join(index.forms.select(F.col("uuid").alias("form"), "name", "classification"), "form").join(filled(corpus if rows is None else rows), ["name", "classification"]).join(asked, "bag").select("query_id", "uuid", "score")


def every_score(queries: DataFrame, corpus: DataFrame, params: Bm25f = Bm25f(), keep: Keep = as_is, change: Keep = as_is) -> DataFrame:
    """bm25f_scores of all rows, dealt evenly, see by_packs; change is applied to a bag's and form's score (bag, form, score) before it is spread out."""
    index, asked = Index(corpus, params, keep=keep), _bags(queries, "text")
    words = index.words(asked)
    scored = change(index.scores(words, index.gains(words)).select("bag", F.col("uuid").alias("form"), "score"))
    return to_rows(scored, asked, index, keep).select("query_id", "uuid", *[c for c in scored.columns if c not in ("bag", "form")])


def every_term(queries: DataFrame, corpus: DataFrame, params: Bm25f = Bm25f(), keep: Keep = as_is, change: Keep = as_is) -> DataFrame:
    """bm25f_terms of all rows, dealt evenly, see by_packs; change is applied to a bag's and form's terms (bag, form, ...) before they are spread out."""
    index, asked = Index(corpus, params, keep=keep), _bags(queries, "text")
    return to_rows(change(index.explained(asked)), asked, index, keep).drop("bag", "form")


def to_rows(found: DataFrame, asked: DataFrame, index: Index, keep: Keep = as_is, pack: int = PACK) -> DataFrame:
    """Rows of found (bag, form, ...) for every query of the bag and every row of the form, see by_packs."""
    rows = filled(index.corpus).join(index.forms.select(F.col("uuid").alias("form"), "name", "classification"), ["name", "classification"]).select("uuid", "form")
    return by_packs(found, asked, rows, keep, pack)


def _bags(queries: DataFrame, text_col: str) -> DataFrame:
    """query_id and bag, its text's different terms in order with a space between; texts without a term are left out."""
    return queries.select("query_id", F.array_join(F.array_sort(F.array_distinct(tokens(F.col(text_col)))), " ").alias("bag")).where("bag <> ''")


def filled(corpus: DataFrame) -> DataFrame:
    """uuid and the two texts, empty where they are null."""
    return corpus.select("uuid", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("classification", F.lit("")).alias("classification"))


#: Forms that a block holds, about.
BLOCK = 64
#: How far a block's bound may lie under the threshold and its rows be read all the same: half a unit of the rounded scores, and what sums in another order may differ by.
SLACK = 1e-6


class Index:
    """Postings of a corpus (uuid, name, classification) in blocks.

    Rows of the same two texts are one form, known by its smallest uuid, with a number of copies. A name of BLOCK forms or more fills blocks of its own, dealt
    by classification; other names lie with those that share their rarest word. Blocks follow from the rows alone, so a lost part is made again as it was, and
    no block grows with the corpus. keep is called on what is read more than once, to persist it, say.
    """

    def __init__(self, corpus: DataFrame, params: Bm25f = Bm25f(), block: int = BLOCK, keep: Keep = as_is):
        self.corpus, self.params, self.keep = corpus, params, keep
        self.forms = keep(filled(corpus).groupBy("name", "classification").agg(F.min("uuid").alias("uuid"), F.count("*").alias("copies")))
        mean = lambda c: (F.sum(F.col("copies") * F.size(tokens(F.col(c)))) / F.sum("copies"))
        lengths = self.forms.agg(F.sum("copies").alias("n_docs"), mean("name").alias("avg_name"), mean("classification").alias("avg_class"))
        tf_name = params.w_name * F.col("tf_name") / (1 - params.b_name + params.b_name * F.col("len_name") / F.col("avg_name"))
        tf_class = params.w_class * F.col("tf_class") / (1 - params.b_class + params.b_class * F.col("len_class") / F.col("avg_class"))
        tf = F.when(F.col("tf_name") > 0, tf_name).otherwise(0.0) + F.when(F.col("tf_class") > 0, tf_class).otherwise(0.0)
        posted = postings(self._blocked(block), "copies", "block").crossJoin(F.broadcast(lengths))
        self.held = keep(posted.select("term", "block", "uuid", "copies", "n_docs", tf.alias("tf")))
        self.frequency = self.held.groupBy("term").agg(F.sum("copies").alias("df"), F.first("n_docs").alias("n_docs"))

    def _blocked(self, size: int) -> DataFrame:
        names = self.forms.groupBy("name").agg(F.count("*").alias("n"))
        words = names.where(F.col("n") < size).select("name", "n", F.explode_outer(F.array_distinct(tokens(F.col("name")))).alias("word")).fillna("", ["word"])
        homes = words.join(words.groupBy("word").agg(F.sum("n").alias("all")), "word").groupBy("name").agg(F.min(F.struct("all", "word")).alias("home"))
        share = lambda text, n: F.pmod(F.xxhash64(text), F.ceil(n / size))
        own = F.xxhash64(F.lit("name"), "name", share("classification", F.col("n")))
        shared = F.xxhash64(F.lit("word"), "home.word", share("name", F.col("home.all")))
        return self.forms.join(names, "name").join(homes, "name", "left").select("uuid", "name", "classification", "copies", F.when(F.col("n") < size, shared).otherwise(own).alias("block"))

    def words(self, asked: DataFrame) -> DataFrame:
        """bag and source, one row for each term of each different bag."""
        return asked.select("bag").distinct().select("bag", F.explode(F.split("bag", " ")).alias("source"))

    def gains(self, words: DataFrame) -> DataFrame:
        """source, block, uuid, copies, gain: what each asked term, or all that a misspelt one may stand for, adds to the score of a form. Postings are read once for each different term."""
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        once = words.select(F.col("source").alias("query_id"), F.col("source").alias("term")).distinct()
        expanded = typo_expansion(once, self.frequency, self.params.max_distance).join(self.frequency, "term").select("source", "term", "weight", idf.alias("idf"))
        gain = F.col("weight") * F.col("idf") * F.col("tf") / (self.params.k1 + F.col("tf"))
        return expanded.join(self.held, "term").groupBy("source", "block", "uuid", "copies").agg(F.sum(gain).alias("gain"))

    def explained(self, asked: DataFrame) -> DataFrame:
        """bag, form, source, term, distance, weight, idf, tf, contribution: what bm25f_terms tells of rows, once for each different bag and form."""
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        words = self.words(asked)
        once = words.select(F.col("source").alias("query_id"), F.col("source").alias("term")).distinct()
        expanded = typo_expansion(once, self.frequency, self.params.max_distance).join(self.frequency, "term").select("source", "term", "distance", "weight", idf.alias("idf"))
        hits = words.join(expanded, "source").join(self.held.select("term", F.col("uuid").alias("form"), "tf"), "term")
        contribution = F.col("weight") * F.col("idf") * F.col("tf") / (self.params.k1 + F.col("tf"))
        return hits.select("bag", "form", "source", "term", "distance", "weight", "idf", "tf", contribution.alias("contribution"))

    def scores(self, words: DataFrame, gains: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
        """bag, uuid, copies, score of all forms that share a term with a bag, with chosen (bag, block) of those in its chosen blocks."""
        hits = words.join(gains, "source") if chosen is None else words.join(chosen.select("bag", "block"), "bag").join(gains, ["source", "block"])
        return hits.groupBy("bag", "uuid", "copies").agg(F.round(F.sum("gain"), 6).alias("score"))

    def chosen(self, words: DataFrame, gains: DataFrame, k: int) -> DataFrame:
        """bag, block, reach, least of the blocks that may hold one of a bag's k best rows.

        reach bounds the scores in a block: each term adds what it adds to the form there that it suits best. The k blocks of highest reach hold k rows at least; the kth
        score among theirs is least, and no block whose reach stays below it holds a better row.
        """
        tops = gains.groupBy("source", "block").agg(F.max("gain").alias("top"))
        reach = self.keep(words.join(tops, "source").groupBy("bag", "block").agg(F.sum("top").alias("reach")))
        first = reach.withColumn("n", F.row_number().over(Window.partitionBy("bag").orderBy(F.desc("reach"), "block"))).where(F.col("n") <= k)
        so_far = F.sum(F.least("copies", F.lit(k))).over(Window.partitionBy("bag").orderBy(F.desc("score"), "uuid"))
        least = self.scores(words, gains, first).withColumn("rows", so_far).groupBy("bag").agg(F.max(F.when(F.col("rows") >= k, F.col("score"))).alias("least"))
        return reach.join(least, "bag", "left").where(F.col("reach") >= F.coalesce("least", F.lit(0.0)) - SLACK)

    def top(self, queries: DataFrame, k: int, text_col: str = "text") -> DataFrame:
        """query_id, uuid, score, rank of each query's k best rows: what ranking all of bm25f_scores gives, ties to the smaller uuid.

        Of the forms, the k first by score and smallest uuid suffice, and of each the k smallest uuids, so copies and ties are spread out last and no more than k at a time.
        """
        asked = _bags(queries, text_col)
        words = self.words(asked)
        gains = self.keep(self.gains(words))
        forms = ranked(self.scores(words, gains, self.chosen(words, gains, k)).withColumnRenamed("bag", "query_id"), k=k)
        alike = Window.partitionBy("name", "classification").orderBy("uuid")
        rows = filled(self.corpus).withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k)
        named = forms.select(F.col("query_id"), F.col("uuid").alias("form"), "score").join(self.forms.select(F.col("uuid").alias("form"), "name", "classification"), "form")
        best = ranked(named.join(rows, ["name", "classification"]).select("query_id", "uuid", "score"), k=k).withColumnRenamed("query_id", "bag")
        return asked.join(best, "bag").select("query_id", "uuid", "score", "rank")


def trigram_overlap(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with shared, jaccard of the character trigrams of two columns."""
    x, y = trigrams(F.col(a)), trigrams(F.col(b))
    shared, union = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return pairs.withColumn("shared", shared).withColumn("jaccard", F.when(union > 0, F.round(shared / union, 6)).otherwise(0.0))


def required(pattern: str | None) -> list[list[str]] | None:
    """What a text must hold to match pattern whatever the case: the lower-case literals of one of the listed sets, all of them; one empty set if nothing is known to be
    needed, None for a pattern that does not compile. Only literals of GRAM letters or more are listed.

    The tree is that of the standard library. Groups and repeats that must occur are gone into; of alternatives, all must need something for them to count. Where classes
    may be read in two ways (a bracket inside of one), nothing is needed.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = re._parser.parse(pattern, re.IGNORECASE)
    except (re.error, TypeError, OverflowError, RecursionError):
        return None
    return [[]] if re.search(r"\[\^?\]|\[[^\]]*\[|&&", pattern) else [sorted(x) for x in _needs(tree) or [set()]]


def _needs(tree: Iterable) -> list[set[str]] | None:
    """One set of literals for each alternative of a parsed pattern, or None."""
    found, others, run = set(), [], ""
    for name, value in [*((str(op), value) for op, value in tree), ("END", None)]:
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        found, run = found | ({run} if len(run) >= GRAM else set()), ""
        inner = []
        if name == "SUBPATTERN":
            inner = _needs(value[-1])
        elif name == "ATOMIC_GROUP":
            inner = _needs(value)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _needs(value[2])
        elif name == "BRANCH":
            each = [_needs(x) for x in value[1]]
            inner = [y for x in each for y in x] if all(each) else None
        if inner and len(inner) == 1:
            found |= inner[0]
        elif inner:
            others.append(inner)
    return [found] if found else min(others, key=len, default=None)


def regex_search(queries: DataFrame, corpus: DataFrame, text_col: str = "text", keep: Keep = as_is) -> DataFrame:
    """Rows (query_id, uuid) where the query's pattern is found in name and classification, whatever the case; a pattern that does not compile, or none, finds nothing.

    Distinct texts are searched once for each distinct pattern, and only those that hold the rarest gram of the literals that the pattern needs, see required and
    gram_candidates. Patterns without such literals are tried on all texts, and are broadcast while they are few.
    """

    @F.pandas_udf("array<array<string>>")
    def needed(patterns: pd.Series) -> pd.Series:
        return patterns.map(required)

    hay = F.concat_ws(" ", "name", "classification")
    asked = queries.select("query_id", F.col(text_col).alias("pattern")).where("pattern is not null")
    parsed = keep(asked.select("pattern").distinct().select("pattern", F.explode(needed("pattern")).alias("literals")))
    texts, holds = corpus.select(hay.alias("hay")).distinct(), F.expr("regexp_like(hay, concat('(?i)', pattern))")
    sets = parsed.where(F.size("literals") > 0).select(F.col("pattern").alias("needle"), F.array_distinct(F.flatten(F.transform("literals", lambda x: _grams(x)))).alias("grams"))
    indexed = gram_candidates(texts, sets, fold=True, sizes=(GRAM,), keep=keep).select("hay", F.col("needle").alias("pattern")).distinct().where(holds)
    tried = texts.join(small(parsed.where(F.size("literals") == 0).select("pattern")), holds)
    found = indexed.unionByName(tried.select("hay", "pattern"))
    return spread(found.select(F.col("pattern").alias("asked"), F.col("hay").alias("held")), asked.withColumnRenamed("pattern", "asked"), corpus.select("uuid", hay.alias("held")), keep)


def fuzzy_search(queries: DataFrame, corpus: DataFrame, text_col: str = "text", keep: Keep = as_is) -> DataFrame:
    """Rows (query_id, uuid) where every query token is part of a name token or within 1 (4 to 7 letters) or 2 (8 and more) edits of one.

    Distinct tokens are matched with the vocabulary of names, by substring_pairs and edit_pairs; what follows are joins on equality and a count. Queries of
    one set of tokens are searched once, and so are rows of one name.
    """
    asked = queries.select("query_id", F.array_sort(F.array_distinct(tokens(F.col(text_col)))).alias("ts")).where(F.size("ts") > 0)
    named = corpus.select("name").distinct().select("name", F.explode(F.array_distinct(tokens(F.col("name")))).alias("word"))
    words, sets = keep(named.select(F.col("word").alias("known")).distinct()), asked.select("ts").distinct()
    wanted = keep(sets.select(F.explode("ts").alias("term")).distinct())
    near = substring_pairs(words, wanted, "known", "term", keep).select("term", "known")
    for low, high, edits in ((4, 7, 1), (8, 1 << 30, 2)):
        near = near.unionByName(edit_pairs(wanted.where(F.length("term").between(low, high)), words, edits).select("term", "known"))
    hits = sets.select("ts", F.size("ts").alias("need"), F.explode("ts").alias("term")).join(near.distinct(), "term").join(named, F.col("known") == F.col("word"))
    found = hits.groupBy("ts", "name", "need").agg(F.count_distinct("term").alias("got")).where("got = need")
    return spread(found.select(F.col("ts").alias("asked"), F.col("name").alias("held")), asked.withColumnRenamed("ts", "asked"), corpus.select("uuid", F.col("name").alias("held")), keep)
