"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import U64, as_row, child, encoded, of, slices

BUCKETS, DIMS, NONZERO, WINDOW = 8192, 32, 2, 2
KEEP_FROM = 0.7
EXTRA = 2
BLOCKS = 64
#: Classes of bytes: 0 parts words, 1 letters (and all beyond ASCII), 2 digits, 3 other signs. A word is a run of one class.
CLASSES = np.full(256, 3, np.uint8)
CLASSES[list(range(33))] = 0
CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASSES[48:58] = 2


def held_out(id_column: Column) -> Column:
    """Rows that learning must not see: crc32 of the id as text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every word of whole texts, in order."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = CLASSES[data]
    change = np.flatnonzero(np.diff(kind, prepend=0))
    starts = change[kind[change] > 0]
    ends = np.append(change[1:], len(data))[kind[change] > 0]
    # a polynomial of the bytes modulo 2^64: differences of running sums, brought back to power zero by the inverse base
    base, inverse = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    powers, backs = np.full(len(data), base, U64), np.full(len(data), inverse, U64)
    powers[0] = backs[0] = U64(1)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * np.cumprod(powers))))
    mixed = (sums[ends] - sums[starts]) * np.cumprod(backs)[starts]
    mixed = (mixed ^ (mixed >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    bucket = (mixed >> U64(40)).astype(np.int64) % BUCKETS
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return bucket, np.searchsorted(first, starts, side="right") - 1


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary index vectors: positions and signs of the nonzeros of each bucket."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def context_sums(texts: list[bytes], at: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Sums over all words of the index vectors of their neighbours within WINDOW, by the word's bucket."""
    bucket, doc = word_buckets(texts)
    out = np.zeros(BUCKETS * DIMS)
    for step in range(1, WINDOW + 1):
        same = np.flatnonzero(doc[step:] == doc[:-step])
        left, right = bucket[same], bucket[same + step]
        for word, near in ((left, right), (right, left)):
            for j in range(NONZERO):
                out += np.bincount(word * DIMS + at[near, j], sign[near, j], BUCKETS * DIMS)
    return out.reshape(BUCKETS, DIMS)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Random-indexing vectors of all word buckets from all documents: BUCKETS x (2 * DIMS), unit context sums beside the index vector itself.

    Each task sums its words' contexts in one table of fixed size and sends it in BLOCKS rows; these are added up by block
    as they stream by. The driver gets BUCKETS x DIMS numbers whatever the corpus holds.
    """
    at, sign = index_vectors()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIMS))
        for part in slices(batches, "__text", 2 << 20):
            total += context_sums(encoded(part.column(0)), at, sign)
        if total.any():
            pieces = total.reshape(BLOCKS, -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[block] = held.get(block, 0) + np.frombuffer(sums, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["block", "sums"])

    shape = "block int, sums binary"
    parts = docs.select(F.col(text_col).alias("__text")).mapInArrow(partial, shape)
    context = np.zeros((BLOCKS, BUCKETS * DIMS // BLOCKS))
    # sums of whole numbers are exact in doubles, so the order in which tasks end does not matter
    for row in parts.repartition("block").mapInArrow(add, shape).collect():
        context[row["block"]] = np.frombuffer(row["sums"], np.float64)
    context = context.reshape(BUCKETS, DIMS)
    context = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    own = np.zeros((BUCKETS, DIMS))
    for j in range(NONZERO):
        np.add.at(own, (np.arange(BUCKETS), at[:, j]), sign[:, j])
    return np.concatenate([context, own], axis=1).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each text's words, then the share of words that repeat one of the two before and the logarithm of their number; zeros for a wordless text."""
    bucket, doc = word_buckets(texts)
    wide = vectors.shape[1]
    out = np.zeros((len(texts), wide + EXTRA), np.float32)
    number = np.bincount(doc, minlength=len(texts))
    for k in range(0, len(bucket), 1 << 15):
        some = doc[k : k + (1 << 15)]
        heads = np.flatnonzero(np.diff(some, prepend=-1))
        out[some[heads], :wide] += np.add.reduceat(vectors[bucket[k : k + (1 << 15)]], heads, axis=0)
    again = np.zeros(len(bucket), bool)
    for step in (1, 2):  # a sign may stand between a word and its repeat
        again[step:] |= (bucket[step:] == bucket[:-step]) & (doc[step:] == doc[:-step])
    out[:, wide] = np.bincount(doc[again], minlength=len(texts))
    out[:, :-1] /= np.maximum(number, 1)[:, None]
    out[:, -1] = np.log1p(number) / 10
    return out


@dataclass
class Network:
    """Two layers over standardised inputs, and the temperature that divides the last one's output."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.mean) / self.spread) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the temperature is fitted on the fifth that is left.

    Without rows, or with labels of one kind only, the network gives that kind's share with one of each added, whatever the text.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    net = Network(x.mean(axis=0) if len(x) else np.zeros(d), x.std(axis=0) + 1e-3 if len(x) else np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), prior, 1.0)
    if len(np.unique(y)) < 2:
        return net
    net.w1, net.w2 = rng.normal(0, np.sqrt(2 / d), (d, hidden)), rng.normal(0, np.sqrt(1 / hidden), hidden)
    order = rng.permutation(len(x))
    check, learn = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - net.mean) / net.spread
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(learn), max(1, len(learn) // 128)):
            step += 1
            inner = z[rows] @ values[0] + values[1]
            active = np.maximum(inner, 0)
            wrong = (1 / (1 + np.exp(-np.clip(active @ values[2] + values[3], -60, 60))) - y[rows]) / len(rows)
            back = np.outer(wrong, values[2]) * (inner > 0)
            for i, grad in enumerate((z[rows].T @ back + decay * values[0], back.sum(axis=0), active.T @ wrong + decay * values[2], np.array([wrong.sum()]))):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                values[i] = values[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    if len(check):
        raw = net.logits(x[check])
        net.temperature = min((float(t) for t in np.geomspace(0.25, 8, 41)), key=lambda t: _loss(raw / t, y[check]))
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """The network, fitted on at most `sample` labels of rows that are not held out: those of least hash.

    Rows with a null id, text or label teach nothing. Equal labels of an id count once, different ones once each; of several texts under one id the one of
    least hash stands for it. So whatever repeats, the driver gets at most `sample` pooled vectors.
    """
    usable = F.col(label_col).isNotNull() & of(id_col).isNotNull() & ~held_out(of(id_col))
    known = labels.where(usable).select(of(id_col).alias("key"), F.col(label_col).cast("double").alias("y")).distinct()
    # twice the share that is needed goes on, so that only some 2 * sample rows are put in order
    share = min(1.0, 2 * sample / max(1, known.count()))
    spotted = known.withColumn("spot", F.pmod(F.xxhash64("key", "y", F.lit("quality")), F.lit(1 << 40)))
    some = spotted.where(F.col("spot") < int(share * (1 << 40))).orderBy("spot", "key", "y").limit(sample).select("key", "y")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            x = pooled(encoded(part.column(0)), vectors)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    texts = docs.where(of(text_col).isNotNull()).select(of(id_col).alias("key"), of(text_col).alias("text"))
    mine = texts.join(F.broadcast(some), "key").groupBy("key", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = sorted((bytes(r["x"]), r["y"]) for r in mine.select("text", "y").mapInArrow(pool, "y double, x binary").collect())
    x = np.array([np.frombuffer(a, np.float32) for a, _ in got], np.float64).reshape(len(got), vectors.shape[1] + EXTRA)
    return train(x, np.array([b for _, b in got]))


def score_quality(docs: DataFrame, vectors: np.ndarray, net: Network, text_col: str = "text") -> DataFrame:
    """Rows (row, score): row is the row of docs as it is, score the probability that its text is of quality 1.

    Only the text is an input; null and empty texts score as a text without words.
    """
    rows = as_row(docs)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = sent.value
        for part in slices(batches, ("row", text_col), 2 << 20):
            x = pooled(encoded(child(part, ("row", text_col))), table)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(x.astype(np.float64)))], names=["row", "score"])

    return rows.mapInArrow(run, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from KEEP_FROM on).

    Word vectors come from all documents, the network from labelled rows that are not held out. Null texts and wordless ones score as such;
    without labels all score 0.5. Repeated rows repeat; an empty table gives none; other columns are not read.
    """
    base = docs.select(of(id_col).alias("doc_id"), of(text_col).alias("text"))
    vectors = word_vectors(base)
    scored = score_quality(base, vectors, fit_quality(base, labels.withColumnRenamed(id_col, "doc_id"), vectors))
    key = F.col("row.doc_id")
    return scored.select(key.alias("doc_id"), held_out(key).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
