"""Exact repeats across documents by prefix-free parsing.

A rolling hash of WORD bytes triggers phrase ends, which depend on content alone, so equal passages are cut alike and phrases overlap by the trigger. Every window of bytes belongs to the
first phrase end in it: `a` of its bytes, a suffix of a phrase, lie before that end, the rest is where the parse goes on. Two windows are equal if their phrase suffixes are equal and
the parse goes on alike. No two suffixes that are longer than a trigger are prefixes of each other, so corpus order is the order of phrase suffixes (the dictionary's suffix array), and among equal ones the
order of what follows (the parse's suffix array); a window that stands elsewhere too has an equal neighbour in that order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, encoded, of, slices, written

#: Bytes of a trigger, and bits of its hash that are zero: phrases of 64 bytes on average.
WORD, TRIGGER_BITS = 8, 6
MIX, MIX2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
#: Phrase ends of one group that one task orders; larger groups are split by more of their windows' bytes.
MOST = 8192
#: Widths of the ranges of `a` that share a group, after the first; at width 1 a group's windows are equal.
NARROWER = (24, 1)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes, the little-endian 8-byte word at each of them)."""
    padded = data + b"\0" * WORD
    return np.frombuffer(data, np.uint8), np.ndarray(len(data), "<u8", padded, strides=(1,))


def _rolled(words: np.ndarray) -> np.ndarray:
    """A hash of the 8 bytes at each place: their polynomial of base 256 modulo 2^64, mixed."""
    with np.errstate(over="ignore"):
        return words * MIX


def _span_hashes(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of `length` bytes, a multiple of 8, from each place."""
    h = np.full(len(at), U64(length))
    with np.errstate(over="ignore"):
        for k in range(0, length, WORD):
            h = (h ^ words[at + k]) * MIX2
            h ^= h >> U64(29)
    return h


def _lowest(codes: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` codes in a row, by doubling."""
    out, have = codes, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def phrase_ends(data: bytes, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, t, lo, hi): each window of the texts that end at `ends` starts at t - a with lo <= a <= hi for exactly one row.

    t is the first trigger's end more than WORD bytes into the window. A window without one takes the least hash among its 8-byte words, the last of
    equal ones, in its place; that too depends on the window's bytes alone.
    """
    _, words = _words(data)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    rolled = _rolled(words)
    t = np.flatnonzero((rolled >> U64(64 - TRIGGER_BITS)) == 0) + WORD
    doc = np.searchsorted(ends, t - 1, side="right")
    inside = t - WORD >= starts[np.minimum(doc, len(ends) - 1)]
    t, doc = t[inside & (t <= ends[-1])], doc[inside & (t <= ends[-1])]
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    before = np.where(first, starts[doc], np.concatenate([[0], t[:-1]]) - WORD)
    before = np.maximum(before, starts[doc])
    hi = np.minimum(window, t - before)
    lo = np.maximum(WORD + 1, t + window - ends[doc])
    rows = [(doc, t, lo, hi)]
    # windows without a trigger: between a trigger and the next one's reach, or the end of the text
    last = np.concatenate([first[1:], [True]]) if len(doc) else first
    tail = starts.copy()
    tail[doc[last]] = np.maximum(starts[doc[last]], t[last] - WORD)
    begin = np.concatenate([before, tail])
    end = np.concatenate([np.minimum(t - window - 1, ends[doc] - window), ends - window])
    of_text = np.concatenate([doc, np.arange(len(ends))])
    for k in np.flatnonzero(begin <= end).tolist():
        a, z = int(begin[k]), int(end[k])
        span = rolled[a : z + window - WORD + 1]
        codes = (span >> U64(32) << U64(32)) | U64(0xFFFFFFFF) - np.arange(len(span), dtype=U64)
        at = (U64(0xFFFFFFFF) - (_lowest(codes, window - WORD + 1) & U64(0xFFFFFFFF))).astype(np.int64) + WORD
        which, left, n = np.unique(at, return_index=True, return_counts=True)
        rows.append((np.full(len(which), of_text[k]), a + which, which - (left + n - 1), which - left))
    doc, t, lo, hi = (np.concatenate(x) for x in zip(*rows))
    good = lo <= hi
    return doc[good], t[good], lo[good], hi[good]


def halves(lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of the parts of `a` up to and beyond half a window: all windows of the one hold the half window after t, those of the other the half before."""
    half, row = window // 2, np.arange(len(lo))
    low, high = lo <= half, hi > half
    return np.concatenate([row[low], row[high]]), np.concatenate([lo[low], np.maximum(lo[high], half + 1)]), np.concatenate([np.minimum(hi[low], half), hi[high]])


def _parts(data: bytes, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, t, lo, hi, key): key hashes the half window that all of a part's windows hold."""
    doc, t, lo, hi = phrase_ends(data, ends, window)
    row, lo, hi = halves(lo, hi, window)
    doc, t, half = doc[row], t[row], window // 2
    _, words = _words(data)
    early = hi <= half
    at = np.where(early, t, t - half)
    key = _span_hashes(words, at, half // WORD * WORD)
    return doc, t, lo, hi, key ^ early.astype(U64)


def _texts(part: pa.RecordBatch, column: int) -> tuple[list[bytes], bytes, np.ndarray]:
    texts = encoded(part.column(column))
    return texts, b"".join(texts), np.cumsum([len(x) for x in texts], dtype=np.int64)


def _ordered(group: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by group and bytes, common bytes of each string in that order with the one before it; none across groups)."""
    lengths = np.array([len(x) for x in strings], np.int64)
    wide = -(-max(1, width) // WORD) * WORD
    table = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in strings), np.uint8).reshape(len(strings), wide)
    words = table.view(">u8").astype(U64)
    order = np.lexsort([lengths, *words.T[::-1], group])
    table, lengths, group = table[order], lengths[order], group[order]
    differs = table[1:] != table[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
    common = np.minimum(common, np.minimum(lengths[1:], lengths[:-1]))
    return order, np.concatenate([[0], np.where(group[1:] == group[:-1], common, 0)])


class _Least:
    """Least number of any stretch of an array, in two looks."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            step = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values[a + 1 .. b] for a < b."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.levels[k][a[at] + 1], self.levels[k][b[at] + 1 - (1 << k)])
        return out


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes], lo: np.ndarray, hi: np.ndarray, copies: np.ndarray, window: int) -> np.ndarray:
    """repeated[i, a]: whether the window with a bytes of left[i] and the rest of right[i] is also another row's of its group, or row i stands for several copies.

    left ends and right begins at a phrase end. Suffixes of the left sides in order are the dictionary's suffix array, right sides in order the parse's; rows that share a suffix of a bytes, in the
    parse's order, are a stretch of corpus order, and the common bytes of neighbours there are the least of those between them.
    """
    n = len(left)
    depth = np.arange(window + 1)
    inside = (depth >= lo[:, None]) & (depth <= hi[:, None])
    out = inside & (copies[:, None] >= 2)
    by_right, common_right = _ordered(group, right, window)
    rank = np.empty(n, np.int64)
    rank[by_right] = np.arange(n)
    least = _Least(common_right)
    by_left, common_left = _ordered(group, [x[::-1] for x in left], window)
    fresh = np.concatenate([[True], group[by_left][1:] != group[by_left][:-1]])
    for a in range(int(lo.min()), int(hi.max()) + 1):
        here = inside[by_left, a]
        # rows between two that share a suffix of a bytes share it as well
        class_ = np.cumsum(fresh | (common_left < a))[here]
        rows = by_left[here]
        if len(rows) < 2:
            continue
        order = np.argsort(class_ * n + rank[rows], kind="stable")
        class_, rows = class_[order], rows[order]
        same = np.flatnonzero(class_[1:] == class_[:-1])
        hit = same[least.between(rank[rows[same]], rank[rows[same + 1]]) >= window - a]
        out[rows[hit], a] = out[rows[hit + 1], a] = True
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of set flags."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


PART = "part binary, key binary, lo int, hi int, head binary, tail binary, copies long"


def _ordered_groups(parts: DataFrame, window: int) -> DataFrame:
    """Rows (part, lo, hi): ranges of `a` whose windows are repeated; parts' groups are by key and hold at most MOST rows."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        keys = table["key"].to_pylist()
        _, group = np.unique(np.array([hash(k) for k in keys]), return_inverse=True)
        lo, hi = (table[c].to_numpy().astype(np.int64) for c in ("lo", "hi"))
        row, first, last = _runs(repeated_windows(group, table["head"].to_pylist(), table["tail"].to_pylist(), lo, hi, table["copies"].to_numpy(), window))
        return pa.RecordBatch.from_arrays([table["part"].combine_chunks().take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["part", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_pylist()
            begin = 0
            for i in range(len(keys)):  # a group is never cut
                if keys[i] != last:
                    if rows + i - begin >= MOST:
                        held.append(batch.slice(begin, i - begin))
                        yield solve(pa.Table.from_batches(held))
                        held, rows, begin = [], 0, i
                    last = keys[i]
            held.append(batch.slice(begin))
            rows += len(keys) - begin
        if rows:
            yield solve(pa.Table.from_batches(held))

    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "part binary, lo int, hi int")


def _narrowed(parts: DataFrame, window: int, width: int) -> DataFrame:
    """parts cut into ranges of `a` of this width, keyed by all bytes that a range's windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                rows, keys, los, his, heads, tails = [], [], [], [], [], []
                columns = (batch.column(c).to_pylist() for c in ("lo", "hi", "head", "tail"))
                for i, (lo, hi, head, tail) in enumerate(zip(*columns)):
                    for a in range(lo - lo % width, hi + 1, width):  # the same cuts whatever a part's own range is
                        x, y = max(lo, a), min(hi, a + width - 1)
                        shared = head[len(head) - a :] + tail[: max(0, window - a - width + 1)]
                        rows.append(i)
                        keys.append(hashlib.blake2b(shared, digest_size=16, person=b"%d" % a).digest())
                        los.append(x)
                        his.append(y)
                        heads.append(head[len(head) - y :] if width > 1 else b"")
                        tails.append(tail[: window - x] if width > 1 else b"")
                copies = batch.column("copies").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part").take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary()), pa.array(los, pa.int32()), pa.array(his, pa.int32()), pa.array(heads, pa.binary()), pa.array(tails, pa.binary()), copies],
                    names=["part", "key", "lo", "hi", "head", "tail", "copies"],
                )

    return parts.mapInArrow(run, PART)


def repeated_ranges(parts: DataFrame, window: int, most: int = MOST, widths: tuple[int, ...] = NARROWER) -> DataFrame:
    """Rows (part, lo, hi) from distinct parts (see PART): the ranges of `a` whose windows stand at two places or more.

    Groups of up to `most` parts are ordered in one task each. A larger one is cut by narrower ranges of `a`, whose windows share more bytes and so fall into smaller groups; at
    width 1 a group holds equal windows, which are counted and never gathered. Sizes are written before they are joined, so that Spark can split a hot key's partition.
    """
    found = []
    for width in widths:
        size, _ = written(parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("copies").alias("places")).where("places > 1"), "sizes")
        sized = parts.join(size, "key")
        found.append(_ordered_groups(sized.where(F.col("parts") <= most).drop("parts", "places"), window))
        parts, _ = written(_narrowed(sized.where(F.col("parts") > most), window, width), "narrow")
    many, _ = written(parts.groupBy("key").agg(F.sum("copies").alias("places")).where("places > 1").select("key"), "many")
    found.append(parts.join(many, "key").select("part", "lo", "hi"))
    return reduce(DataFrame.unionByName, found)


def _open_texts(docs: DataFrame, window: int) -> DataFrame:
    """Rows (same, text, n, keys): each different text once, if any of its parts' keys stands at two places; keys are those, n its copies."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            _, data, ends = _texts(part, 1)
            if data:
                doc, _, _, _, key = _parts(data, ends, window)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(key.view(np.int64))], names=["same", "key"])

    keys = docs.where(F.octet_length("text") >= window).mapInArrow(keyed, "same binary, key long")
    twice, _ = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "twice")
    held = keys.join(twice, "key").groupBy("same").agg(F.collect_set("key").alias("keys"))
    texts = docs.groupBy("same").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    return texts.join(held, "same")


def _spots(texts: DataFrame, window: int) -> DataFrame:
    """Rows (part, key, lo, hi, same, t, n): the parts of texts (same, text, n, keys) whose keys are among keys; part is a digest of all bytes that its windows reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "text", 2 << 20):
            texts, data, ends = _texts(some, 1)
            starts = np.concatenate([[0], ends[:-1]])
            doc, t, lo, hi, key = _parts(data, ends, window)
            lists = some.column(3)
            wanted = lists.flatten().to_numpy().view(U64)
            owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
            with np.errstate(over="ignore"):  # a part too many does no harm
                keep = np.isin(key + doc.astype(U64) * MIX, wanted + owner.astype(U64) * MIX)
            doc, t, lo, hi, key = (x[keep] for x in (doc, t, lo, hi, key))
            name = [hashlib.blake2b(data[e - h : e + window - a], digest_size=16, person=b"%d %d" % (h, a)).digest() for e, h, a in zip(t.tolist(), hi.tolist(), lo.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(name, pa.binary()), pa.array(key.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), some.column(0).take(pa.array(doc)), pa.array(t - starts[doc]), some.column(2).take(pa.array(doc))],
                names=["part", "key", "lo", "hi", "same", "t", "n"],
            )

    return texts.select("same", "text", "n", "keys").mapInArrow(run, "part binary, key long, lo int, hi int, same binary, t long, n long")


def _bodies(parts: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """PART rows of parts (part, key, lo, hi, copies, at: a text and place that has it): the bytes before and after that place."""
    asked = parts.groupBy("at.same").agg(F.collect_list(F.struct("part", "key", "lo", "hi", "copies", F.col("at.t").alias("t"))).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "text", 2 << 20):
            lists, texts = some.column(1), encoded(some.column(0))
            rows = lists.flatten()
            part, key, lo, hi, copies, t = (rows.field(i) for i in range(6))
            owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy()).tolist()
            spots = list(zip(owner, t.to_pylist(), lo.to_pylist(), hi.to_pylist()))
            heads, tails = [texts[i][e - h : e] for i, e, _, h in spots], [texts[i][e : e + window - a] for i, e, a, _ in spots]
            yield pa.RecordBatch.from_arrays([part, pa.array([x.tobytes() for x in key.to_numpy()], pa.binary()), lo, hi, pa.array(heads, pa.binary()), pa.array(tails, pa.binary()), copies], names=["part", "key", "lo", "hi", "head", "tail", "copies"])

    return texts.select("same", "text").join(asked, "same").select("text", "asked").mapInArrow(run, PART)


def repeat_spans(docs: DataFrame, window: int = 400, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(spans, texts) of docs (same, text), equal texts having equal `same`: rows (same, start, end) that cover every repeated window of a different text, and rows (same, text) of those texts.

    Keys are counted before anything else moves, with partial counts, and only texts with a key that stands twice go on. Equal texts, and equal parts with their surroundings, go on once, with their number.
    A part that is alone with its key is repeated as a whole or not at all; only parts of crowded keys send their bytes, one of each kind.
    """
    texts, _ = written(_open_texts(docs, window), "texts")
    spots, _ = written(_spots(texts, window), "spots")
    named, _ = written(spots.groupBy("part").agg(F.sum("n").alias("copies"), F.first("key").alias("key"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.min(F.struct("same", "t")).alias("at")), "named")
    sizes, _ = written(named.groupBy("key").agg(F.count("*").alias("parts"), F.sum("copies").alias("places")).where("places > 1"), "sizes")
    sized = named.join(sizes, "key")
    found = [sized.where("parts = 1").select("part", "lo", "hi"), _ordered_groups(_bodies(sized.where((F.col("parts") > 1) & (F.col("parts") <= most)), texts, window), window)]
    if (sizes.agg(F.max("parts")).first()[0] or 0) > most:
        large, _ = written(_narrowed(_bodies(sized.where(F.col("parts") > most), texts, window), window, NARROWER[0]), "narrow")
        found.append(repeated_ranges(large, window, most, NARROWER[1:]))
    ranges, _ = written(reduce(DataFrame.unionByName, found), "ranges")
    covered = spots.select("part", "same", "t").join(ranges, "part")
    return covered.select("same", (F.col("t") - F.col("hi")).alias("start"), (F.col("t") - F.col("lo") + window).alias("end")), texts.select("same", "text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256, removed), one for each row of docs.

    A byte of a text's UTF-8 is removed if it lies in a string of `window` bytes (at least 64, at most 400 here) that also starts elsewhere, in this text or another, overlaps included; texts are judged as they
    came. n_spans counts the maximal removed runs, which `removed` lists as (start, end); kept_sha256 is the hash of what is left. A null text counts as
    empty; a text shorter than the window keeps all. Repeated rows are copies of each other, so they lose all of a text of the window's length or more. An empty table gives no rows.
    Other columns are not read.
    """
    if not 64 <= window <= 400:
        raise ValueError("window: 64 to 400 bytes")
    text = F.coalesce(of(text_col), F.lit(""))
    same = F.unhex(F.md5(text.cast("binary")))
    spans, texts = repeat_spans(docs.select(same.alias("same"), text.alias("text")), window)
    rows = spans.select("same", "start", "end", F.lit(None).cast("string").alias("text")).unionByName(texts.select("same", F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, raw, runs = None, b"", []

        def told() -> tuple:
            kept = bytearray()
            at = 0
            for a, b in runs:
                kept += raw[at:a]
                at = b
            kept += raw[at:]
            return key, sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in runs]

        for batch in batches:
            done = []
            for name, start, end, body in zip(*(c.to_pylist() for c in batch.columns)):
                if start < 0:  # a text comes before its spans
                    if key is not None:
                        done.append(told())
                    key, raw, runs = name, body.encode(), []
                elif runs and start <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
                else:
                    runs.append((start, end))
            yield pack(done)
        if key is not None:
            yield pack([told()])

    def pack(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 5
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["same", "n_removed", "n_spans", "kept", "removed"])

    cut = rows.repartition("same").sortWithinPartitions("same", "start").select("same", "start", "end", "text").mapInArrow(run, "same binary, n_removed long, n_spans long, kept string, removed array<struct<start: bigint, end: bigint>>")
    base = docs.select(of(id_col).alias("key"), same.alias("same"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("full"))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    return base.join(cut, "same", "left").select(
        F.col("key").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "full").alias("kept_sha256"), F.coalesce("removed", none).alias("removed")
    )
