"""SimHash near-duplicates: fingerprints, anchor-point covering, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import U64, as_row, encoded, forest, of, remove, slices, written, xxh64_spans
from lodestone.llm.components import connected_components

BITS = 64
SPREAD = U64(0x0101010101010101)


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Further hash bits from the same hash: a bijective finalizer, another one for each word; word 0 is the hash itself."""
    if not word:
        return hashes
    h = hashes + U64(word * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def shingle_hashes(texts: list[bytes], shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of all texts' word-shingles in order, repeats included; their number in each text)."""
    lists = [t.lower().split() for t in texts]  # bytes: only A-Z change, only ASCII white space parts words
    buffer = b"\n".join(b" ".join(x) for x in lists)
    words = np.fromiter(map(len, lists), np.int64, len(lists))
    number = np.maximum(words - shingle + 1, np.minimum(words, 1))
    if not words.sum():
        return np.zeros(0, U64), number
    flat = np.fromiter((len(w) for x in lists for w in x), np.int64, int(words.sum()))
    # a word takes its length and one separator; an empty text leaves a lone separator
    owner = np.repeat(np.arange(len(lists)), words)
    empties = np.cumsum(words == 0)
    starts = np.concatenate(([0], np.cumsum(flat + 1)[:-1])) + empties[owner]
    first = np.concatenate(([0], np.cumsum(words)[:-1]))
    head = np.repeat(first, number) + (np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number))
    doc = np.repeat(np.arange(len(lists)), number)
    tail = head + np.minimum(shingle, words)[doc] - 1
    begin = starts[head]
    return xxh64_spans(buffer, begin, starts[tail] + flat[tail] - begin, seed), number


def shingle_sets(texts: list[bytes], shingle: int, seed: int = 42) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    hashes, number = shingle_hashes(texts, shingle, seed)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(number)[:-1])]


def fingerprints(texts: list[bytes], shingle: int, seed: int = 42, count: int = 1, distinct: bool = False) -> np.ndarray:
    """`count` fingerprint words of each text, a column each: a bit is set where over half of its word-shingle hashes have it, repeats included unless distinct."""
    if distinct and texts:
        sets = shingle_sets(texts, shingle, seed)
        hashes, number = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    else:
        hashes, number = shingle_hashes(texts, shingle, seed)
    out = np.zeros((len(texts), count), U64)
    if not len(hashes):
        return out
    # counts of set bits: eight byte lanes at a time, at most 255 rows before the lanes are widened
    runs = -(-number // 255)
    run_doc = np.repeat(np.arange(len(texts)), runs)
    run_at = (np.cumsum(number) - number)[run_doc] + 255 * (np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs))
    full = np.flatnonzero(runs)
    at = (np.cumsum(runs) - runs)[full]
    for word in range(count):
        mine = _mixed(hashes, word)
        for k in range(8):
            lanes = np.add.reduceat((mine >> U64(k)) & SPREAD, run_at)
            wide = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), at, axis=0)
            most = 2 * wide > number[full][:, None]
            for byte in range(8):
                out[full, word] |= most[:, byte].astype(U64) << U64(8 * byte + k)
    return out


def jaccard(left: list[bytes], right: list[bytes], shingle: int) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each pair of whole texts; 1 for two wordless texts."""
    sets = shingle_sets([*left, *right], shingle)
    out = np.ones(len(left))
    for i, (a, b) in enumerate(zip(sets, sets[len(left) :])):
        if len(a) or len(b):
            both = len(np.intersect1d(a, b, assume_unique=True))
            out[i] = both / (len(a) + len(b) - both)
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = 3, words: tuple[str, ...] = ("fingerprint_bits",), distinct: bool = False) -> DataFrame:
    """Rows of keep plus the fingerprint's words (signed longs), of distinct shingles if asked; a null or wordless text gets zero."""
    names = list(keep or [])
    fields = [docs.schema[c] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text", 1 << 20):
            found = fingerprints(encoded(part.column("__text")), shingle, count=len(words), distinct=distinct).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + [pa.array(np.ascontiguousarray(x)) for x in found.T], names=[*names, *words])

    schema = T.StructType([*fields, *[T.StructField(w, T.LongType()) for w in words]])
    return docs.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def anchor_widths(n: int, per_anchor: int = 32) -> list[int]:
    """Widths of the anchor code's blocks: as many blocks as give about per_anchor homes to each of 2^blocks anchors."""
    blocks = min(24, max(4, int(np.ceil(np.log2(max(1, n) / per_anchor + 1)))))
    return [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]


def anchors(bits: np.ndarray, widths: list[int], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every anchor at which a fingerprint has to be compared.

    The code is a product of repetition codes: each block of bits stands for its majority, so a point lies
    within R = sum(width // 2) of its home anchor. A partner within threshold bits of it lies within R + threshold of
    that anchor. Of the anchors in that radius only those are kept whose cell comes within threshold of the
    fingerprint, as no other can be a partner's home: the cost of an anchor is the number of bits to flip until its blocks'
    majorities change, and all sets of blocks that cost at most threshold are flipped.
    """
    home = np.zeros(len(bits), np.int64)
    costs = np.empty((len(widths), len(bits)), np.int64)
    at = 0
    for i, w in enumerate(widths):
        ones = np.bitwise_count((bits >> U64(at)) & U64((1 << w) - 1)).astype(np.int64)
        major = ones > w // 2
        home |= major.astype(np.int64) << i
        costs[i] = np.where(major, ones - w // 2, w // 2 + 1 - ones)
        at += w
    rows, codes = [np.arange(len(bits))], [home]

    def flip(which: np.ndarray, code: np.ndarray, left: np.ndarray, begin: int) -> None:
        for i in range(begin, len(widths)):
            can = np.flatnonzero(costs[i][which] <= left)
            if len(can):
                sub, new = which[can], code[can] ^ (1 << i)
                rows.append(sub)
                codes.append(new)
                flip(sub, new, left[can] - costs[i][sub], i + 1)

    flip(rows[0], home, np.full(len(bits), threshold), 0)
    row = np.concatenate(rows)
    return row, np.concatenate(codes), np.arange(len(row)) < len(bits)


def _tile_links(n: int, home: np.ndarray, near: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the pairs that near gives for blocks of home rows."""
    here, root, every = np.flatnonzero(home), np.arange(n), np.arange(n)
    step = max(1, (1 << 21) // max(1, n))
    for k in range(0, len(here), step):
        a, b = near(here[k : k + step])
        if len(a):
            # reduced at once, so that a dense group never keeps all its pairs
            moved = np.flatnonzero(root != every)
            root = forest(n, np.concatenate([moved, a]), np.concatenate([root[moved], b]))
    moved = np.flatnonzero(root != every)
    return moved, root[moved]


def nearest_forest(n: int, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Positions of pairs that form a spanning forest with the least distances: every component takes its nearest way out, until none is left."""
    order = np.argsort(distance, kind="stable")
    x, y, root = a[order], b[order], np.arange(n)
    live, taken = np.arange(len(x)), [np.zeros(0, np.int64)]
    while True:
        live = live[root[x[live]] != root[y[live]]]
        if not len(live):
            return order[np.concatenate(taken)]
        best = np.full((2, n), len(x))
        for side, end in zip(best, (x, y)):
            side[root[end[live[::-1]]]] = live[::-1]  # the last one written is the nearest
        pick = np.unique(best.min(axis=0))
        pick = pick[pick < len(x)]
        taken.append(pick)
        root = forest(n, np.concatenate([np.arange(n), x[pick]]), np.concatenate([root, y[pick]]))


def _tile_pairs(n: int, home: np.ndarray, near: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest spanning forest's own pairs, of the pairs (a, b, distance) that near gives for blocks of home rows."""
    here, step = np.flatnonzero(home), max(1, (1 << 21) // max(1, n))
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    for k in range(0, len(here), step):
        found = near(here[k : k + step])
        if len(found[0]):
            every = tuple(np.concatenate(x) for x in zip(held, found))
            pick = nearest_forest(n, *every)
            held = tuple(x[pick] for x in every)
    return held[0], held[1]


def _tiles(spread: DataFrame, salt: str, tile_rows: int) -> DataFrame:
    """spread (anchor, home, ...) with the tile (h, v) of each row, dealt by anchor and tile.

    An anchor with more than two tiles' rows is cut into a grid: its homes by one hash of salt, all its rows by another, and every
    home meets every row in one cell. So a hot anchor becomes many tasks of bounded size.
    """
    load = spread.groupBy("anchor").agg(F.count_if("home").alias("homes"), F.count("*").alias("rows"))
    hot = load.where((F.col("homes") > 0) & (F.col("rows") > 2 * tile_rows)).select(
        "anchor", F.ceil(F.col("homes") / tile_rows).cast("int").alias("hs"), F.ceil(F.col("rows") / tile_rows).cast("int").alias("vs")
    )
    rest = [c for c in spread.columns if c not in ("anchor", "home")]
    placed = spread.join(hot, "anchor", "left").withColumns({"hs": F.coalesce("hs", F.lit(1)), "vs": F.coalesce("vs", F.lit(1))})
    spot = F.pmod(F.xxhash64(salt), F.col("hs")).cast("int"), F.pmod(F.xxhash64(salt, F.lit(1)), F.col("vs")).cast("int")
    none = F.expr("cast(array() as array<int>)")
    as_home = F.when(F.col("home"), F.sequence(F.lit(0), F.col("vs") - 1)).otherwise(none)
    grid = F.concat(
        F.transform(as_home, lambda v: F.struct(spot[0].alias("h"), v.alias("v"), F.lit(True).alias("home"))),
        F.transform(F.sequence(F.lit(0), F.col("hs") - 1), lambda h: F.struct(h.alias("h"), spot[1].alias("v"), F.lit(False).alias("home"))),
    )
    single = F.array(F.struct(F.lit(0).alias("h"), F.lit(0).alias("v"), F.col("home").alias("home")))
    cut = placed.select("anchor", *rest, F.explode(F.when((F.col("hs") == 1) & (F.col("vs") == 1), single).otherwise(grid)).alias("t"))
    return cut.select("anchor", "t.h", "t.v", "t.home", *rest).repartition("anchor", "h", "v").sortWithinPartitions("anchor", "h", "v")


def _linked(tiles: DataFrame, close: Callable[[int, list[np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows (a, b) from the tiles as they stream by; close gets a tile's anchor and its columns from home on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
            columns = [np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(3, parts[0].num_columns)]
            return close(parts[0].column(0)[0].as_py(), columns)

        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            done = []
            for begin, end in zip(cuts, cuts[1:]):
                if held and tuple(keys[begin]) != key:
                    done.append(made(held))
                    held = []
                key = tuple(keys[begin])
                held.append(batch.slice(begin, end - begin))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*done)], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made(held)], names=["a", "b"])

    return tiles.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def fingerprint_links(prints: DataFrame, threshold: int, n: int, per_anchor: int = 32, tile_rows: int = 4096) -> DataFrame:
    """Links (a, b) that connect the same distinct fingerprints as all pairs within threshold bits do.

    prints: fingerprint_bits, distinct. Each anchor's homes meet its visitors in tiles; a tile gives a spanning forest of its links,
    never its pairs. per_anchor weighs replicas (fewer when it is large) against comparisons; it does not change the result.
    """
    widths = anchor_widths(n, per_anchor)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 14):
                bits = batch.column(0).slice(k, 1 << 14).to_numpy(zero_copy_only=False).view(U64)
                row, code, home = anchors(bits, widths, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(home), pa.array(bits[row].view(np.int64))], names=["anchor", "home", "bits"])

    def close(_: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        home, bits = columns[0], columns[1].view(U64)

        def near(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x, y = np.nonzero(np.bitwise_count(bits[rows][:, None] ^ bits[None, :]) <= threshold)
            return rows[x], y

        a, b = _tile_links(len(bits), home, near)
        return columns[1][a], columns[1][b]

    spread = prints.select("fingerprint_bits").mapInArrow(replicate, "anchor long, home boolean, bits long")
    return _linked(_tiles(spread, "bits", tile_rows), close)


NARROWEST, WIDEST, FLIPPED = 16, 48, 1


@dataclass(frozen=True)
class Segments:
    """How fingerprints propose pairs: `number` segments of `width` bits, and the words that are compared as a whole."""

    width: int
    number: int
    compared: int
    blocks: int

    @property
    def words(self) -> int:
        """64-bit words that hold the segments, `compared` at least."""
        return max(self.compared, -(-self.width * self.number // BITS))

    def piece(self, words: list[np.ndarray], segment: int) -> np.ndarray:
        at, off = divmod(self.width * segment, BITS)
        out = words[at] >> U64(off)
        if off + self.width > BITS:
            out = out | (words[at + 1] << U64(BITS - off))
        return out & U64((1 << self.width) - 1)


def bit_share(similarity: float) -> float:
    """Expected share of differing bits between the fingerprints of two sets of equal size and this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def segments_for(n: int, similarity: float, recall: float = 0.9, per_value: int = 4, tile_rows: int = 16384) -> Segments:
    """Segments for n fingerprints: as wide as leaves about per_value of them to each value, and as many as propose a pair of exactly this
    similarity with probability `recall` or more (a more similar pair with a higher one).

    So a fingerprint meets about as many strangers whatever n is, and the number of segments, hence the work a row, grows
    as n to the power of some 0.3 for a similarity of 0.8. More words are compared where segments are wide, so that strangers who
    agree in one are still told apart.
    """
    width = int(min(WIDEST, max(NARROWEST, np.ceil(np.log2(max(1, n) / per_value)))))
    p = bit_share(similarity)
    met = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    number = int(np.ceil(np.log(1 - recall) / np.log(1 - met))) if met < 1 else 1
    blocks = int(min(width, max(8, np.ceil(np.log2(max(1, n) * 8 / tile_rows)))))
    return Segments(width, number, 2 if width < 24 else 4, blocks)


def most_bits(similarity: float, bits: int) -> int:
    """Differing bits that two sets of equal size and this Jaccard similarity stay within: the expected number and three standard deviations."""
    p = bit_share(similarity)
    return int(bits * p + 3 * np.sqrt(bits * p * (1 - p)))


def word_names(number: int) -> tuple[str, ...]:
    return tuple(f"word{i}" for i in range(number))


def similar_links(prints: DataFrame, similarity: float, plan: Segments, tile_rows: int = 16384) -> DataFrame:
    """Pairs (a, b), a < b, that may have this similarity; they connect the same rows as all pairs do that agree in a segment and whose words agree enough.

    prints: cid and the plan's words. A pair is compared if one segment differs in at most FLIPPED bits, and it is given if the compared words
    together differ in at most most_bits. Each segment has a covering code of its own as anchors, and a tile looks up the values within reach of a row's
    instead of meeting all its rows. A tile gives the pairs of its nearest spanning forest only.
    """
    widths = [plan.width // plan.blocks + (i < plan.width % plan.blocks) for i in range(plan.blocks)]
    most = most_bits(similarity, BITS * plan.compared)
    flips = np.array([0] + [1 << i for i in range(plan.width)], np.int64)
    shipped = word_names(plan.compared)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(k, 1 << 14)
                words = [part.column(1 + i).to_numpy(zero_copy_only=False).view(U64) for i in range(plan.words)]
                for segment in range(plan.number):
                    mine = plan.piece(words, segment)
                    row, code, home = anchors(mine, widths, FLIPPED)
                    kept = part.select([0, *range(1, 1 + plan.compared)]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(code + (segment << plan.blocks)), pa.array(home), pa.array(mine[row].view(np.int64)), *kept.columns], names=["anchor", "home", "piece", "cid", *shipped])

    def close(_: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        home, mine, cid, *words = columns
        words = [w.view(U64) for w in words]
        order = np.argsort(mine, kind="stable")
        sorted_mine = mine[order]

        def near(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            wanted = (mine[rows][:, None] ^ flips[None, :]).ravel()
            begin = np.searchsorted(sorted_mine, wanted)
            number = np.searchsorted(sorted_mine, wanted, side="right") - begin
            x = np.repeat(np.repeat(rows, len(flips)), number)
            y = order[np.repeat(begin, number) + np.arange(len(x)) - np.repeat(np.cumsum(number) - number, number)]
            apart = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in words)
            hit = apart <= most
            return x[hit], y[hit], apart[hit]

        a, b = _tile_pairs(len(cid), home, near)
        return np.minimum(cid[a], cid[b]), np.maximum(cid[a], cid[b])

    spread = prints.select("cid", *word_names(plan.words)).mapInArrow(replicate, f"anchor long, home boolean, piece long, cid long, {', '.join(w + ' long' for w in shipped)}")
    return _linked(_tiles(spread, "cid", tile_rows), close)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of pairs (a, b) whose whole texts' shingle sets have this Jaccard similarity or more; texts: cid, text."""
    both = pairs.join(texts.selectExpr("cid as a", "text as one"), "a").join(texts.selectExpr("cid as b", "text as other"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "one", 2 << 20):
            hit = pa.array(jaccard(encoded(part.column(2)), encoded(part.column(3)), shingle) >= similarity)
            yield pa.RecordBatch.from_arrays([part.column(i).filter(hit) for i in range(2)], names=["a", "b"])

    return both.select("a", "b", "one", "other").mapInArrow(run, "a long, b long")


TILE_TEXTS = 1024


def across_links(pairs: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float, shingle: int, tile_texts: int = TILE_TEXTS) -> DataFrame:
    """Links (a, b) between roots: they connect all roots of a proposed group that have texts of this similarity.

    pairs are the proposed (a, b), roots (cid, root) what the verified among them connect. Where proposed pairs lead from one root to another, a
    pair left out of a forest may still hold, so all rows of such a group meet each other on their whole texts, in tiles of at
    most two blocks of about tile_texts rows. A tile counts common shingles by looking them up, skips rows of one root, and gives a forest's links.
    """
    ends = pairs.join(roots.selectExpr("cid as a", "root as one"), "a").join(roots.selectExpr("cid as b", "root as other"), "b")
    groups = connected_components(ends.where("one <> other").selectExpr("one as a", "other as b"))
    rows, _ = written(roots.join(groups.selectExpr("node as root", "component as anchor"), "root"), "open")
    blocks = rows.groupBy("anchor").agg(F.ceil(F.count("*") / tile_texts).cast("int").alias("blocks"))
    placed = rows.join(blocks, "anchor").withColumn("spot", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).join(texts, "cid")
    met = placed.select("anchor", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"), "spot", "root", "text")
    tiles = met.select("anchor", F.least("spot", "k").alias("h"), F.greatest("spot", "k").alias("v"), "spot", "root", "text")

    def close(_: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        spot, root, bodies = columns
        sets = shingle_sets([(t or "").encode() for t in bodies], shingle)
        sizes = np.array([len(x) for x in sets])
        _, name = np.unique(np.concatenate(sets), return_inverse=True)
        holder = np.repeat(np.arange(len(sets)), sizes)[np.argsort(name, kind="stable")]
        many = np.bincount(name)
        first, at = np.cumsum(many) - many, np.cumsum(sizes) - sizes
        _, group = np.unique(root, return_inverse=True)
        a, b = [], []
        two = spot.min() != spot.max()
        for i in np.flatnonzero(spot == spot[0]) if two else range(len(sets)):
            open_ = (group != group[i]) & ((spot != spot[i]) | (not two))
            if not open_.any():
                continue
            mine = name[at[i] : at[i] + sizes[i]]
            n = many[mine]
            both = np.bincount(holder[np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], minlength=len(sets))
            either = sizes[i] + sizes - both
            hit = np.flatnonzero(open_ & (np.where(either > 0, both / np.maximum(either, 1), 1.0) >= similarity))
            found, one = np.unique(group[hit], return_index=True)
            a += [root[i]] * len(found)
            b += root[hit[one]].tolist()
            group[np.isin(group, found)] = group[i]
        return np.array(a, np.int64), np.array(b, np.int64)

    return _linked(tiles.repartition("anchor", "h", "v").sortWithinPartitions("anchor", "h", "v"), close)


def _named(prints: DataFrame, threshold: int) -> DataFrame:
    """Rows (fingerprint_bits, component_id) from distinct fingerprints with the least id of each."""
    parts = connected_components(fingerprint_links(prints, threshold, prints.count()))
    classes = prints.join(parts.withColumnRenamed("node", "fingerprint_bits"), "fingerprint_bits", "left").select("fingerprint_bits", "least", F.coalesce("component", "fingerprint_bits").alias("root"))
    return classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fingerprint_bits", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """Rows (id, fingerprint_bits, component_id): one per row of docs.

    component_id is the smallest id whose fingerprint is reachable over links of at most threshold bits. Null and
    wordless texts have fingerprint zero and link like any other. Null ids stay as rows and never become a component's
    id unless it has no other. Repeated rows stay. Other columns are not read, so their names cannot clash.
    """
    base = docs.select(of(id_col).alias("key"), of(text_col).alias("body"))
    rows, _ = written(with_fingerprint(base, "body", ["key"], shingle), "prints")
    prints, _ = written(rows.groupBy("fingerprint_bits").agg(F.min("key").alias("least")), "classes")
    return rows.join(_named(prints, threshold), "fingerprint_bits").select(F.col("key").alias(id_col), "fingerprint_bits", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.9, plan: Segments | None = None) -> DataFrame:
    """docs with one row of each component: the one with the smallest id, of equal ids any one, null ids last. Columns of any name come back as they are.

    Rows link when their sets of word-shingles have a Jaccard similarity of `similarity` or more. Fingerprints, taken of
    distinct shingles as the similarity is, propose the pairs, see segments_for and similar_links, and each pair of their forests is verified on both whole texts, so no row goes without a similar one.
    Where one fails, all rows of its proposed group meet, see across_links, so no proposed pair stays untested.
    Which pairs are proposed follows from `plan` alone. Where it is not given it is derived from the number of rows; give one to a run over a part of a table, so that the part's
    pairs are those of the whole. Every plan proposes a pair of the asked similarity with probability `recall` or more.
    Equal texts are compared once. Null and wordless texts are one component.
    """
    spark, plan = docs.sparkSession, plan or segments_for(docs.count(), similarity, recall)
    key, text, names = of(id_col), of(text_col), word_names(plan.words)
    spot = F.struct(key.isNull().alias("none"), key.alias("id"), F.monotonically_increasing_id().alias("row"))
    held = as_row(docs, text.alias("body"), spot.alias("spot"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("same"))
    rows, _ = written(with_fingerprint(held, "body", ["row", "spot", "same"], shingle, names, distinct=True), "rows")
    prints = rows.groupBy("same", *names).agg(F.min("spot").alias("least")).drop("same")
    prints, _ = written(prints.withColumn("cid", F.monotonically_increasing_id()), "classes")
    pairs, at_pairs = written(similar_links(prints, similarity, plan), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(prints.select("cid", F.col("least.row").alias("at")), "cid")
    texts, at_texts = written(rows.select(F.col("spot.row").alias("at"), F.col("row")[text_col].alias("text")).join(ends, "at").select("cid", "text"), "texts")
    parts = connected_components(verified(pairs, texts, similarity, shingle))
    roots, _ = written(texts.select("cid").join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("component", "cid").alias("root")), "roots")
    joint = connected_components(across_links(pairs, roots, texts, similarity, shingle)).withColumnRenamed("node", "root")
    remove(spark, at_pairs, at_texts)
    named = roots.join(joint, "root", "left").select("cid", F.coalesce("component", "root").alias("root"))
    classes = prints.select("cid", "least").join(named, "cid", "left").select("least", F.coalesce("root", "cid").alias("root"))
    first = classes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("at"))
    return rows.withColumn("at", F.col("spot.row")).join(first, "at", "left_semi").select("row.*")


def hex_bits(column: str) -> F.Column:
    return F.lower(F.lpad(F.hex(column), BITS // 4, "0"))
