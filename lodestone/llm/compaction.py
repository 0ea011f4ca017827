"""A plan for compacting small files: next-fit groups, a rewrite queue cut at a share of its bytes, and hashes of what the files will hold.

What comes one after the other (groups along a source, bytes along the queue) runs as a Blelloch scan over range-sorted leaves: each leaf is summed up
once, sums meet in a tree on the way up, and on the way down every node hands its children what comes before them. No step sees more than a leaf or FAN nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import of, written

FAN = 16
#: Rows of one leaf, about; a task holds a leaf's sizes and places.
LEAF_ROWS = 1 << 16
#: monotonically_increasing_id numbers partitions from this bit on.
PART_BIT = 33


@dataclass(frozen=True)
class Rules:
    """The layout's and the plan's numbers: ids of a block, slots, and when a file is dirty or small, a group full, and the queue cut; shares are in percent."""

    block_ids: int = 2000
    slots: int = 8
    kill: int = 9
    dirty: int = 20
    small: float = 0.75
    target: int = 32768
    share: int = 50
    file_cost: int = 4096
    wave: int = 16


def blelloch(leaves: DataFrame, merge: Callable[[bytes, bytes], bytes], start: bytes, parts: int, fan: int = FAN) -> DataFrame:
    """Rows (node, before): for each leaf (node, value) the merge of all values of smaller nodes, start for the first.

    node is a number below parts; merge is associative. The up-sweep merges each parent's children, the down-sweep hands every child its parent's `before` merged with the children
    to its left. Both group by parent, so a task holds at most fan values.
    """

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        value = None
        for x in table["value"].to_pylist():
            value = x if value is None else merge(value, x)
        return pa.table({"node": pa.array([table["parent"][0].as_py()], pa.int64()), "value": pa.array([value], pa.binary())})

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("node")
        before, out = right["before"][0].as_py(), []
        for x in left["value"].to_pylist():
            out.append(before)
            before = merge(before, x)
        return pa.table({"node": left["node"], "before": pa.array(out, pa.binary())})

    levels, size = [leaves.select("node", "value")], parts
    while size > 1:
        levels.append(levels[-1].withColumn("parent", F.floor(F.col("node") / fan)).groupBy("parent").applyInArrow(up, "node long, value binary"))
        size = -(-size // fan)
    before = levels.pop().select("node", F.lit(start).alias("before"))
    for level in reversed(levels):
        before = level.withColumn("parent", F.floor(F.col("node") / fan)).groupBy("parent").cogroup(before.withColumnRenamed("node", "parent").groupBy("parent")).applyInArrow(down, "node long, before binary")
    return before


def ranged(df: DataFrame, order: list[Column], leaf_rows: int, tag: str) -> tuple[DataFrame, int]:
    """df in this order, written, with `pos`, a number that keeps the order, and `leaf`; and a number above all leaves."""
    parts = max(1, -(-df.count() // leaf_rows))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    out, _ = written(sorted_.withColumn("leaf", F.shiftright("pos", PART_BIT)), tag)
    top = out.agg(F.max("leaf")).first()[0]
    return out, 1 if top is None else top + 1


class NextFit:
    """Next-fit of one source's files as functions of the group that is open when a leaf begins.

    A state is the open group's live bytes; two more stand for a group that is over full and for none. A leaf maps each of these states to (state, place of the open group's first file) at
    its end, -1 for a group that was open before, so functions of neighbouring leaves compose whatever lies before them.
    """

    def __init__(self, full: int):
        self.full, self.over, self.none = full, full + 1, full + 2

    def breaks(self, live: np.ndarray, carried: int | None) -> np.ndarray:
        """Whether each file starts a group, after an open group of this many bytes (None: none)."""
        fresh, held = np.zeros(len(live), bool), carried
        for i, size in enumerate(live.tolist()):
            fresh[i] = held is None or held + size > self.full
            held = size if fresh[i] else held + size
        return fresh

    def leaf(self, pos: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, total = len(live), np.concatenate([[0], np.cumsum(live)])
        after = np.maximum(np.searchsorted(total, total[:-1] + self.full, side="right") - 1, np.arange(1, n + 1))
        ends, firsts = np.empty(n, np.int64), np.empty(n, np.int64)
        for j in range(n - 1, -1, -1):  # a group that starts at j lasts until after[j]
            if after[j] < n:
                ends[j], firsts[j] = ends[after[j]], firsts[after[j]]
            else:
                ends[j], firsts[j] = min(total[n] - total[j], self.over), pos[j]
        carried = np.arange(self.full + 1)
        at = np.searchsorted(total, self.full - carried, side="right") - 1
        stays = at >= n
        at = np.minimum(at, n - 1)
        state = np.concatenate([np.where(stays, carried + total[n], ends[at]), ends[[0, 0]]])
        return state, np.concatenate([np.where(stays, -1, firsts[at]), firsts[[0, 0]]])

    def pack(self, head: str, tail: str, state: np.ndarray, first: np.ndarray) -> bytes:
        names = [x.encode() for x in (head, tail)]
        return np.array([len(x) for x in names], "<i8").tobytes() + b"".join(names) + state.astype("<i4").tobytes() + first.astype("<i8").tobytes()

    def unpack(self, value: bytes) -> tuple[str, str, np.ndarray, np.ndarray]:
        a, b = np.frombuffer(value, "<i8", 2).tolist()
        names, at = value[16 : 16 + a + b], 16 + a + b
        return names[:a].decode(), names[a:].decode(), np.frombuffer(value, "<i4", self.full + 3, at), np.frombuffer(value, "<i8", self.full + 3, at + 4 * (self.full + 3))

    def merge(self, left: bytes, right: bytes) -> bytes:
        if not left or not right:
            return left or right
        head, tail, state, first = self.unpack(left)
        other, last, then, since = self.unpack(right)
        at = state if tail == other else np.full(len(state), self.none)
        moved = since[at]
        return self.pack(head, last, then[at], np.where(moved < 0, first, moved))

    def entry(self, before: bytes, source: str) -> tuple[int | None, int]:
        """(live bytes of the group open before a leaf whose first file is of source, place of its first file)."""
        if not before:
            return None, -1
        _, tail, state, first = self.unpack(before)
        return (None, -1) if tail != source else (int(state[self.none]), int(first[self.none]))


def next_fit(files: DataFrame, full: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """files (file, live_bytes, ...) with `start`, equal for the files of a group: along each source in (block, slot) order a file joins the last group unless it would exceed `full`."""
    rule = NextFit(full)
    placed, parts = ranged(files, [F.col("file")], leaf_rows, "placed")

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        sources, live, pos = table["source"].to_pylist(), table["live_bytes"].to_numpy(), table["pos"].to_numpy()
        begin = len(sources) - 1
        while begin and sources[begin - 1] == sources[-1]:
            begin -= 1
        state, first = rule.leaf(pos[begin:], live[begin:])
        if begin:  # another source comes before, so nothing is carried over
            state, first = np.full_like(state, state[rule.none]), np.full_like(first, first[rule.none])
        return pa.table({"node": table["leaf"][:1], "value": pa.array([rule.pack(sources[0], sources[-1], state, first)], pa.binary())})

    def grouped(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        sources, live, pos = left["source"].to_pylist(), left["live_bytes"].to_numpy(), left["pos"].to_numpy()
        carried, start = rule.entry(right["before"][0].as_py(), sources[0])
        cuts = [0, *[i for i in range(1, len(sources)) if sources[i] != sources[i - 1]], len(sources)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            fresh = rule.breaks(live[a:b], carried if a == 0 else None)
            last = np.maximum.accumulate(np.where(fresh, np.arange(b - a), -1))
            out.append(np.where(last < 0, start, pos[a:b][np.maximum(last, 0)]))
        return pa.table({"pos": left["pos"], "start": pa.array(np.concatenate(out))})

    slim = placed.select("leaf", "pos", F.col("file.source").alias("source"), "live_bytes")
    before = blelloch(slim.groupBy("leaf").applyInArrow(summed, "node long, value binary"), rule.merge, b"", parts)
    starts = slim.groupBy("leaf").cogroup(before.withColumnRenamed("node", "leaf").groupBy("leaf")).applyInArrow(grouped, "pos long, start long")
    return placed.hint("merge").join(starts, "pos").drop("pos", "leaf")


def running(queue: DataFrame, order: list[Column], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """queue (…, bytes) with queue_index from 0 in this order, `upto`, its bytes up to and with the row, and `whole`, all of them."""
    placed, parts = ranged(queue, order, leaf_rows, "queue")
    merge = lambda a, b: b"%d %d" % tuple(x + y for x, y in zip(map(int, a.split()), map(int, b.split())))
    sums = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"))
    leaves = sums.select(F.col("leaf").alias("node"), F.concat_ws(" ", F.col("n").cast("string"), F.col("total").cast("string")).cast("binary").alias("value"))
    pair = F.split(F.col("before").cast("string"), " ")
    before = blelloch(leaves, merge, b"0 0", parts).select(F.col("node").alias("leaf"), F.get(pair, F.lit(0)).cast("long").alias("rows_before"), F.get(pair, F.lit(1)).cast("long").alias("bytes_before"))
    inside = placed.selectExpr("*", "row_number() over (partition by leaf order by pos) as number", "sum(bytes) over (partition by leaf order by pos rows unbounded preceding) as run")
    whole = placed.agg(F.sum("bytes")).first()[0] or 0
    joined = inside.hint("merge").join(before, "leaf")
    return joined.withColumns({"queue_index": F.col("rows_before") + F.col("number") - 1, "upto": F.col("bytes_before") + F.col("run"), "whole": F.lit(whole).cast("long")}).drop("pos", "leaf", "rows_before", "bytes_before", "number", "run")


def laid_out(docs: DataFrame, rules: Rules, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Rows (file, key, text, size, live): where each document lies and whether it still counts. file is (source, block, slot)."""
    key = of(id_col)
    h = F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)).cast("long")
    block = F.expr("(key - pmod(key, {0})) div {0}".format(rules.block_ids))
    slot = F.least(F.pmod(h, F.lit(rules.slots)), F.pmod(F.floor(h / rules.slots), F.lit(rules.slots))).cast("long")
    text = F.coalesce(of(text_col), F.lit(""))
    rows = docs.select(key.alias("key"), F.coalesce(of(source_col), F.lit("")).alias("source"), text.alias("text"), h.alias("h"), slot.alias("slot")).withColumn("block", block)
    gone = F.pmod(F.floor(F.col("h") / rules.slots**2), F.lit(100)) < rules.kill * F.pmod(F.col("slot") + F.coalesce("block", F.lit(0)), F.lit(rules.slots))
    return rows.select(F.struct("source", "block", "slot").alias("file"), "key", "text", F.octet_length("text").cast("long").alias("size"), (~gone).alias("live"))


def file_map(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows (file, out, n_files, live_rows, bytes, live_bytes, queue_index): every file, the first file of the group that it is rewritten with (itself if it is left alone), and that group's sums."""
    rows = laid_out(docs, rules, id_col, source_col, text_col)
    sums = rows.groupBy("file").agg(
        F.count("*").alias("rows"), F.count_if("live").alias("live_rows"), F.sum("size").alias("bytes"), F.sum(F.when(F.col("live"), F.col("size")).otherwise(0)).alias("live_bytes")
    )
    files, _ = written(sums.withColumn("dirty", 100 * (F.col("rows") - F.col("live_rows")) >= rules.dirty * F.col("rows")), "files")
    few = F.col("bytes") < rules.small * rules.target
    grouped, _ = written(next_fit(files.where(F.col("dirty") | few), rules.target, leaf_rows), "grouped")
    groups = grouped.groupBy("start").agg(
        F.min("file").alias("out"), F.count("*").alias("n_files"), F.sum("live_rows").alias("live_rows"), F.sum("bytes").alias("bytes"), F.sum("live_bytes").alias("live_bytes"), F.max("dirty").alias("dirty")
    )
    order = [F.desc("n_files"), F.asc("bytes"), F.asc("out")]
    queue = running(groups.where((F.col("n_files") >= 2) | F.col("dirty")).drop("dirty"), order, leaf_rows)
    chosen = queue.where(F.col("upto").cast("decimal(38,0)") * 100 <= F.col("whole").cast("decimal(38,0)") * rules.share).drop("upto", "whole")
    moved = grouped.select("file", "start").hint("merge").join(chosen, "start").drop("start")
    alone = files.hint("merge").join(moved.select("file"), "file", "left_anti").select("file", F.col("file").alias("out"), F.lit(1).cast("long").alias("n_files"), "live_rows", "bytes", "live_bytes", F.lit(None).cast("long").alias("queue_index"))
    return moved.select(*alone.columns).unionByName(alone)


def content_hashes(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows (out, live_sha256): of each out the SHA-256 of the lines "id:text\\n" of its live rows in order of id, then of text.

    Rows stream past in that order, so memory holds one batch, whatever a file holds; a hash of one file's bytes is one task's by nature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            done = []
            keys = list(zip(*(batch.column(0).field(i).to_pylist() for i in range(3))))
            for key, line in zip(keys, batch.column(1).to_pylist()):
                if key != held:
                    if held is not None:
                        done.append((held, digest.hexdigest()))
                    held, digest = key, hashlib.sha256()
                digest.update(line)
            yield told(done)
        if held is not None:
            yield told([(held, digest.hexdigest())])

    def told(done: list[tuple]) -> pa.RecordBatch:
        out = [dict(zip(("source", "block", "slot"), key)) for key, _ in done]
        kind = pa.struct([("source", pa.string()), ("block", pa.int64()), ("slot", pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(out, kind), pa.array([x for _, x in done], pa.string())], names=["out", "live_sha256"])

    live = rows.where("live").select("file", "key", "text")
    dealt = live.hint("merge").join(places.select("file", "out"), "file").repartition("out").sortWithinPartitions("out", "key", "text")
    line = F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("text"), F.lit("\n")).cast("binary")
    return dealt.select("out", line.alias("line")).mapInArrow(run, "out struct<source: string, block: bigint, slot: bigint>, live_sha256 string")


def compaction_plan(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows (source, block, slot, n_files, live_rows, bytes, cost, wave, live_sha256), one for each group that is rewritten and for each file that is not.

    source, block and slot are those of the first file. cost and wave are null where nothing is rewritten. A null source or text counts as empty. A row whose id is null lies in block null, which sorts first,
    has hash 0 and is written with an empty id. Rows with one id all count and are hashed in order of their texts. An empty table gives no rows. Other columns are not read.
    """
    places, _ = written(file_map(docs, rules, id_col, source_col, text_col, leaf_rows), "map")
    hashes = content_hashes(laid_out(docs, rules, id_col, source_col, text_col), places)
    outs = places.where("file = out").withColumns({"cost": F.when(F.col("queue_index").isNotNull(), F.col("bytes") + F.col("live_bytes") + rules.file_cost * F.col("n_files")), "wave": F.floor(F.col("queue_index") / rules.wave)})
    named = outs.hint("merge").join(hashes, "out", "left").withColumn("live_sha256", F.coalesce("live_sha256", F.lit(hashlib.sha256().hexdigest())))
    return named.select("out.source", "out.block", "out.slot", "n_files", "live_rows", "bytes", "cost", "wave", "live_sha256")
