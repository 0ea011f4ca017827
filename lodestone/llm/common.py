"""Helpers shared by the corpus operators: lineage cuts, batch slicing, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import _at, release, remove, scratch, shared_dir, shared_path, written  # noqa: F401  the operators take them from here

U64 = np.uint64
# The five multipliers of the XXH64 specification.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
P1, P2, P3, P4, P5 = (U64(p) for p in PRIMES)


def rename_files(spark: SparkSession, source: str, target: str, ending: str, other: str) -> None:
    """Move the files of a committed folder that end in ending to target, with another ending; target's _SUCCESS comes last."""
    files, at = _at(spark, source)
    _, to = _at(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files.mkdirs(to)
    for status in files.listStatus(at):
        name = status.getPath().getName()
        if name.endswith(ending):
            files.rename(status.getPath(), path(to, name.removesuffix(ending) + other))
    files.create(path(to, "_SUCCESS")).close()


def spare(taken: list[str], *names: str) -> list[str]:
    """names, each with underscores added until no column is called so."""
    used = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def as_row(docs: DataFrame, *columns: Column) -> DataFrame:
    """docs as one struct column `row`, beside which further columns can have any names; select("row.*") gives docs back."""
    return docs.select(F.struct("*").alias("row"), *columns)


def of(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def child(batch: pa.RecordBatch, column: str | tuple[str, str]) -> pa.Array:
    """A column, or the field of a struct column that is never null."""
    return batch.column(column) if isinstance(column, str) else batch.column(column[0]).field(column[1])


def slices(batches: Iterator[pa.RecordBatch], column: str | tuple[str, str], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one cut stay near limit bytes; a single longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(child(batch, column)), 0).to_numpy(zero_copy_only=False)
        total, begin = np.cumsum(sizes, dtype=np.int64), 0
        while begin < batch.num_rows:
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_spans(buffer: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of buffer[start:start + length] for every span at once, grouped by length.

    The algorithm is the published XXH64; spans of one length run the same steps as arrays.
    """
    out = np.empty(len(starts), U64)
    if not len(starts):
        return out
    padded = buffer + b"\0" * 8
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    four = np.ndarray(len(padded) - 3, "<u4", padded, strides=(1,))
    one = np.frombuffer(padded, np.uint8)
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    with np.errstate(over="ignore"):
        s = U64(seed)
        for rows in np.split(order, cuts):
            n, at = int(lengths[rows[0]]), starts[rows]
            pos = 0
            if n >= 32:
                lanes = [np.full(len(rows), v, U64) for v in (s + P1 + P2, s + P2, s, s - P1)]
                while pos + 32 <= n:
                    lanes = [_round(a, eight[at + pos + 8 * i]) for i, a in enumerate(lanes)]
                    pos += 32
                h = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
                for a in lanes:
                    h = (h ^ _round(np.zeros_like(a), a)) * P1 + P4
            else:
                h = np.full(len(rows), s + P5, U64)
            h = h + U64(n)
            while pos + 8 <= n:
                h = _rotl(h ^ _round(np.zeros_like(h), eight[at + pos]), 27) * P1 + P4
                pos += 8
            if pos + 4 <= n:
                h = _rotl(h ^ (four[at + pos].astype(U64) * P1), 23) * P2 + P3
                pos += 4
            while pos < n:
                h = _rotl(h ^ (one[at + pos].astype(U64) * P5), 11) * P1
                pos += 1
            h = (h ^ (h >> U64(33))) * P2
            h = (h ^ (h >> U64(29))) * P3
            out[rows] = h ^ (h >> U64(32))
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(step := root[root], root):
            root = step
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root
