"""Language identification: TF-IDF of character n-grams against several centroids a language, by cosine."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import U64, as_row, child, encoded, of, remove, slices, written
from lodestone.llm.quality import held_out

BUCKETS, CENTROIDS = 4096, 3
LOW, MARGIN = 0.005, 0.8
#: A limit is at most this part of the median, as few rows tell little of a low quantile.
MOST = 0.4
#: Characters that kept rows are cut to, to learn how high a cosine texts so short can reach, and the 1- to 3-grams from which on a text counts as whole.
CUTS, FULL = (8, 24, 72, 216), 1000
#: Languages at most: each is CENTROIDS rows of BUCKETS numbers, 48 KB, of a model that is broadcast.
MOST_LANGUAGES = 1000
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter; made once in a Python process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(counts of hashed 1- to 3-grams of lower-case letters and word edges per text, whether the text has a letter)."""
    joined = [f"\0{t.decode('utf-8', 'replace').lower()}\0" for t in texts]
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) for t in joined])
    is_letter = letters()[points]
    # runs of anything else become one space, so that a gram never reaches over two words; every text begins with one
    stay = is_letter | np.concatenate(([True], is_letter[:-1]))
    stay[np.concatenate(([0], ends[:-1]))[: len(texts)]] = True
    doc = np.searchsorted(ends, np.flatnonzero(stay), side="right")
    code = np.where(is_letter, points, 32)[stay].astype(np.uint64)
    mine = is_letter[stay]
    out = np.zeros(len(texts) * BUCKETS)
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            if len(code) < n:
                break
            size = len(code) - n + 1
            key = np.full(size, U64(n))
            for j in range(n):
                key = key * U64(1114112) + code[j : j + size]
            inside = doc[:size] == doc[n - 1 :]
            inside &= mine[n // 2 : n // 2 + size]
            bucket = ((key * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.int64) % BUCKETS
            out += np.bincount((doc[:size] * BUCKETS + bucket)[inside], minlength=len(texts) * BUCKETS)
    has = np.bincount(doc[mine], minlength=len(texts)) > 0
    return out.reshape(len(texts), BUCKETS).astype(np.float32), has


def learning_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows (text, lang, key) that may be learned from: not held out, with a text and a language; key is a hash of id and text."""
    usable = ~held_out(of(id_col)) & of(lang_col).isNotNull() & of(text_col).isNotNull()
    return docs.where(usable).select(of(text_col).alias("text"), of(lang_col).cast("string").alias("lang"), F.xxhash64(of(id_col), of(text_col), F.lit("lang")).alias("key"))


def gram_statistics(learn: DataFrame, each: int) -> tuple[int, np.ndarray, dict[str, int]]:
    """(rows with a letter, number of them that hold each bucket, per language the largest of its `each` least keys) over all learning rows.

    One pass over the texts: a task sends one row of counts, and of each language the `each` least different keys of rows with a
    letter. A language without such a row is not in the result.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, least = 0, np.zeros(BUCKETS, np.int64), {}
        for part in slices(batches, "text", 1 << 20):
            for k in range(0, part.num_rows, 512):
                cut = part.slice(k, 512)
                counts, has = gram_counts(encoded(cut.column(0)))
                total += int(has.sum())
                held += (counts > 0).sum(axis=0)
                langs, keys = np.array(cut.column(1).to_pylist(), object), cut.column(2).to_numpy()
                for lang in set(langs[has]):
                    least[lang] = np.unique(np.concatenate([least.get(lang, np.zeros(0, np.int64)), keys[has & (langs == lang)]]))[:each]
        names = [lang for lang, keys in least.items() for _ in keys]
        keys = [int(x) for found in least.values() for x in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([total] + [None] * len(keys), pa.int64()), pa.array([held.tolist()] + [None] * len(keys), pa.list_(pa.int64())), pa.array([None, *names], pa.string()), pa.array([None, *keys], pa.int64())], names=["n", "held", "lang", "key"]
        )

    spark = learn.sparkSession
    parts, path = written(learn.mapInArrow(partial, "n long, held array<long>, lang string, key long"), "grams")
    summed = parts.where("n is not null").select("n", F.posexplode("held").alias("bucket", "docs")).groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).collect()
    held = np.zeros(BUCKETS, np.int64)
    for row in summed:
        held[row["bucket"]] = row["docs"]
    order = Window.partitionBy("lang").orderBy("key")
    # equal keys have one rank, so Spark prunes each partition to `each` keys a language before the shuffle
    chosen = parts.where("lang is not null").select("lang", "key").withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= each)
    limits = {r["lang"]: r["most"] for r in chosen.groupBy("lang").agg(F.max("key").alias("most")).collect()}
    remove(spark, path)
    return (summed[0]["n"] if summed else 0), held, limits


@dataclass
class Centroids:
    """least: a row for each language, the limits at these numbers of grams; in between they are interpolated."""

    idf: np.ndarray
    names: list[str]
    owner: np.ndarray
    table: np.ndarray
    least: np.ndarray
    grams: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine with its nearest centroid, whether that reaches the language's own limit for texts of so many grams)."""
        cosine = self.weigh(counts) @ self.table.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        lang = self.owner[best]
        n, limit = counts.sum(axis=1), np.zeros(len(best))
        for i in np.unique(lang):
            limit[lang == i] = np.interp(n[lang == i], self.grams, self.least[i])
        return lang, score, score >= limit


def as_rows(rows: list[tuple]) -> np.ndarray:
    """The weighed grams of rows (length, apart, x, grams) as a matrix."""
    return np.array([np.frombuffer(row[2], np.float16) for row in rows], np.float32).reshape(-1, BUCKETS)


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """At most k unit centroids of unit rows: spherical k-means from rows that lie far apart."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    table = x[chosen]
    for _ in range(rounds):
        near = (x @ table.T).argmax(axis=1)
        sums = np.stack([x[near == j].sum(axis=0) for j in range(len(table))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        table = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), table)
    return table


def fit_languages(docs: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", centroids: int = CENTROIDS) -> Centroids:
    """Centroids of every language of the rows that are not held out and have a text and a language; no other row is read.

    Document frequencies cover all of those rows. The centroids are fitted on `sample` rows altogether, or one a language where there are
    more languages: of each the same number of rows, those of least hash, whatever the size of the table. Equal rows count once. A language
    none of whose rows has a letter cannot be learned, which a warning says.

    A fifth of the sampled rows, chosen by a hash of the text, is kept apart from the centroids. These rows are also cut to CUTS characters, as a short text has
    too few grams for a high cosine. At each length a language's limit is MARGIN of the cosine that all but LOW of its rows reach, or of all languages' rows where
    that is less, so clean text of that length stays; it is at most MOST of their median. Between the lengths' mean numbers of grams limits are interpolated. Where
    no row is apart, all rows count. More than MOST_LANGUAGES languages raise an error: the model would have no bound.
    """
    spark = docs.sparkSession
    learn = learning_rows(docs, id_col, text_col, lang_col)
    # one name a language: the model holds a centroid of BUCKETS numbers for each
    names = sorted(r["lang"] for r in learn.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} different values in {lang_col}: languages are learned for up to {MOST_LANGUAGES}")
    total, held, limits = gram_statistics(learn, max(1, sample // max(1, len(names))))
    if lost := [x for x in names if x not in limits]:
        warnings.warn(f"no text with a letter to learn {', '.join(lost)} from", stacklevel=2)
    idf = np.log((1 + total) / (1 + held)).astype(np.float32) + 1
    model = Centroids(idf, sorted(limits), np.zeros(0, np.int64), np.zeros((0, BUCKETS), np.float32), np.zeros((len(limits), 1)), np.array([FULL]))
    if not limits:
        return model
    most = F.broadcast(spark.createDataFrame(list(limits.items()), "lang string, most long"))
    some = learn.join(most, "lang").where("key <= most").dropDuplicates(["lang", "key"]).select("text", "lang", (F.pmod(F.xxhash64("text", F.lit("apart")), F.lit(5)) == 0).alias("apart"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            for k in range(0, part.num_rows, 256):
                cut = part.slice(k, 256)
                texts, apart = encoded(cut.column(0)), cut.column(2).to_numpy(zero_copy_only=False)
                for length in (0, *CUTS):
                    some = np.flatnonzero(apart) if length else np.arange(len(texts))
                    if not len(some):
                        continue
                    found, has = gram_counts([texts[i].decode("utf-8", "replace")[: length or None].encode() for i in some])
                    rows = some[has]
                    grams = pa.array(found[has].sum(axis=1).astype(np.int64))
                    x = pa.array([model.weigh(v[None])[0].astype(np.float16).tobytes() for v in found[has]], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[cut.column(i).take(pa.array(rows)) for i in (1, 2)], x, grams, pa.array(np.full(len(rows), length, np.int32))], names=["lang", "apart", "x", "grams", "length"])

    def fit(rows: pa.Table) -> pa.Table:
        """One language: its centroids, and of each length the cosines reached and the numbers of grams."""
        got = sorted(zip(*[rows[c].to_pylist() for c in ("length", "apart", "x", "grams")]))
        mine = [row for row in got if not row[0]]
        apart, whole = np.array([row[1] for row in mine], bool), np.array([row[3] for row in mine]) >= FULL
        x = as_rows(mine)
        table = cluster(x if apart.all() else x[~apart], centroids).astype(np.float32)
        held_apart = next((m for m in (apart & whole, whole, apart) if m.any()), np.ones(len(x), bool))
        best = lambda some: (some @ table.T).max(axis=1).tobytes()
        short = [[row for row in got if row[0] == length] for length in CUTS]
        reached = [*[best(as_rows(some)) for some in short], best(x[held_apart])]
        sizes = [*[[row[3] for row in some] for some in short], [FULL]]
        return pa.table({"lang": rows["lang"][:1], "centroids": pa.array([table.tobytes()], pa.binary()), "reached": pa.array([reached], pa.list_(pa.binary())), "sizes": pa.array([sizes], pa.list_(pa.list_(pa.int64())))})

    # a language's sampled rows meet in a task; the driver gets its centroids and one number for each row
    rows = some.mapInArrow(counts, "lang string, apart boolean, x binary, grams long, length int")
    fits = {r["lang"]: r for r in rows.groupBy("lang").applyInArrow(fit, "lang string, centroids binary, reached array<binary>, sizes array<array<long>>").collect()}
    tables = [np.frombuffer(fits[lang]["centroids"], np.float32).reshape(-1, BUCKETS) for lang in model.names]
    owner = [number for number, table in enumerate(tables) for _ in table]
    reached = [[np.frombuffer(cosines, np.float32) for cosines in fits[lang]["reached"]] for lang in model.names]
    sizes = [fits[lang]["sizes"] for lang in model.names]
    model.grams = np.maximum.accumulate([np.mean(sum((s[k] for s in sizes), []) or [FULL]) for k in range(len(CUTS) + 1)])
    model.least = np.zeros((len(model.names), len(model.grams)))
    for k in range(len(model.grams)):
        every = np.concatenate([c[k] for c in reached])
        for number, c in enumerate(reached):
            mine = c[k] if len(c[k]) else every
            if len(every):
                model.least[number, k] = min(MARGIN * np.quantile(mine, LOW), MARGIN * np.quantile(every, LOW), MOST * np.median(mine))
    model.owner, model.table = np.array(owner), np.concatenate(tables)
    return model


def identify(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """Rows (row, lang_pred, score, accepted): row is the row of docs as it is, lang_pred the language of the nearest centroid, score its cosine, accepted
    whether that reaches the language's limit.

    A null text or one without a letter is UNKNOWN with score 0 and not accepted, as is every text when nothing was learned.
    """
    rows = as_row(docs)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for part in slices(batches, ("row", text_col), 1 << 20):
            for k in range(0, part.num_rows, 512):
                cut = part.slice(k, 512)
                counts, has = gram_counts(encoded(child(cut, ("row", text_col))))
                if not len(fitted.table):
                    has = np.zeros(len(has), bool)
                    lang, score, near = np.zeros(len(has), int), np.zeros(len(has)), has
                else:
                    lang, score, near = fitted.predict(counts)
                said = [fitted.names[i] if h else UNKNOWN for i, h in zip(lang, has)]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(said, pa.string()), pa.array(np.where(has, score, 0.0).astype(np.float64)), pa.array(near & has)], names=["row", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, accepted. Repeated rows repeat; an empty table gives none; other columns are not read."""
    model = fit_languages(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = identify(docs.select(of(id_col).alias("doc_id"), of(text_col).alias("text")), model)
    key = F.col("row.doc_id")
    return found.select(key.alias("doc_id"), held_out(key).alias("held_out"), "lang_pred", "score", "accepted")
