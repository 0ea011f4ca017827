"""Embedding near-duplicates: int8 tile products with rigorous error bounds, full precision where they leave doubt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import forest, of, written
from lodestone.llm.components import connected_components

BLOCK_BYTES = 4 << 20
SLACK = 1e-9  # more than the rounding of any double sum here


def finite(vector: Column) -> Column:
    """True for a vector without null and non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of one length as a matrix of doubles."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, error, length) of unit rows: |row - scale * codes| = error and |scale * codes| = length."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(x - back, axis=1), np.linalg.norm(back, axis=1)


def tile_links(x: np.ndarray, weight: np.ndarray, rows: np.ndarray, cols: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(links, root, recomputed) of the pairs rows x cols of x with cosine >= threshold.

    links sums the other side's weights; root connects linked rows. rows and cols are equal or disjoint. For unit u, v with codes U, V:
    |u.v - U.V| <= |u - U| |v| + |U| |v - V|, so a pair whose bound stays below the threshold cannot reach it.
    """
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1)
    codes, scale, error, length = quantised(x / norm[:, None])
    # products of int8 codes are integers below 2^24 for up to 1040 dimensions, so single precision is exact there
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    links, root, recomputed, same = np.zeros(len(x), np.int64), np.arange(len(x)), 0, np.array_equal(rows, cols)
    right = codes[cols].astype(kind).T
    for k in range(0, len(rows), 256):
        some = rows[k : k + 256]
        about = (codes[some].astype(kind) @ right).astype(np.float64) * scale[some][:, None] * scale[cols][None, :]
        maybe = about + error[some][:, None] + length[some][:, None] * error[cols][None, :] >= threshold - SLACK
        if same:
            maybe &= cols[None, :] > some[:, None]
        a, b = np.nonzero(maybe)
        recomputed += len(a)
        for j in range(0, len(a), 1 << 15):
            p, q = some[a[j : j + (1 << 15)]], cols[b[j : j + (1 << 15)]]
            hit = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= threshold
            p, q = p[hit], q[hit]
            links += np.bincount(p, weight[q], len(x)).astype(np.int64) + np.bincount(q, weight[p], len(x)).astype(np.int64)
            moved = np.flatnonzero(root != np.arange(len(x)))
            root = forest(len(x), np.concatenate([moved, p]), np.concatenate([root[moved], q]))
    return links, root, recomputed


def vector_classes(rows: DataFrame) -> DataFrame:
    """Equal vectors of a label as one row: cid, label, key, vector, dim, least id, n."""
    classes = rows.groupBy("label", "key").agg(F.first("vector").alias("vector"), F.min("id").alias("least"), F.count("*").alias("n"))
    return classes.withColumn("dim", F.size("vector")).withColumn("cid", F.monotonically_increasing_id())


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tile_rows: int | None = None) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of df.

    Vectors of equal non-null label and equal dimension link at cosine >= threshold in double precision. Null, empty and zero vectors and those with
    null or non-finite components link with nothing: no links, their own component. Equal vectors are compared once as a class
    and link with each other. component_id is the smallest id reachable; rows with a null id count as links but never name a
    component that has another id. Repeated rows are links of each other. Other columns are not read.

    A label is cut into blocks of about tile_rows classes by hash, and every pair of blocks is one tile: a task's memory is
    bounded whatever a label's share. Unless given, tile_rows is what makes a block BLOCK_BYTES of doubles: a class is sent once to each of its label's blocks, so
    large blocks save bytes. A tile gives one row a linked class (partial link count, tile root), never its pairs.
    """
    base = df.select(of(id_col).alias("id"), of(vector_col).alias("vector"), of(label_col).alias("label"))
    ok = F.col("label").isNotNull() & finite(F.col("vector")) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    keyed = base.withColumn("key", F.when(ok, F.md5(F.col("vector").cast("string").cast("binary"))))
    classes, _ = written(vector_classes(keyed.where("key is not null")), "vectors")
    most = F.lit(tile_rows) if tile_rows else F.greatest(F.lit(1024), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))
    blocks = classes.groupBy("label", "dim").agg(F.count("*").alias("classes")).select("label", "dim", F.ceil(F.col("classes") / most).cast("int").alias("blocks"))
    sided = classes.select("cid", "label", "dim", "vector", "n").join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = sided.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dim", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cid", "n", "vector"
    )

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = key[2].as_py(), key[3].as_py()
        block = table["block"].to_numpy()
        cid = table["cid"].to_numpy()
        links, root, _ = tile_links(matrix(table["vector"]), table["n"].to_numpy().astype(np.float64), np.flatnonzero(block == lo), np.flatnonzero(block == hi), threshold)
        linked = np.flatnonzero(links)
        return pa.table({"cid": cid[linked], "root": cid[root[linked]], "links": links[linked]})

    found, _ = written(dealt.groupBy("label", "dim", "lo", "hi").applyInArrow(tile, "cid long, root long, links long"), "tiles")
    parts = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    placed = classes.select("cid", "label", "key", "least", "n").join(links, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("component", "cid"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("component", "named"), "root")
    named = named.select("label", "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "named")
    out = keyed.select("id", "label", "key").join(named, ["label", "key"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("named"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
