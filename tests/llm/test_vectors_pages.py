"""Embedding near-duplicates, exact top-k, WARC and components, against brute force."""

import base64
import hashlib
import math
import os
import zlib

import numpy as np
import pytest

from lodestone.llm import topk, vector_dedup, warc
from lodestone.llm.common import forest, shared_path
from lodestone.llm.components import connected_components


def vectors(n=300, d=16, seed=0):
    """(vec_id, embedding, label): clusters near the threshold, copies, scaled copies and broken vectors."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, d))
    x = (centre[rng.integers(0, 12, n)] + rng.normal(scale=0.14, size=(n, d))).astype(np.float32)
    x[10:20], x[20:25] = x[3], 2 * x[4]
    out = [(i, v.tolist(), [0, 1, 1, None][i % 4]) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * d, [nan] * d, [inf] * d, [None] + [1.0] * (d - 1), [1.0, 2.0], [1.0, 2.0], [1e30] * d, [1e-30] * d]
    out += [(1000 + 50 * i, v, 1) for i, v in enumerate(odd)] + [(None, x[3].tolist(), 1), (5, x[5].tolist(), 1), (5, x[5].tolist(), 1)]
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, cid long, key string, n int, kind int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "k", 1, 2) for r in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("tile", [40, 2048, None])
def test_links(spark, tile):
    rows = vectors()
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    got = vector_dedup.link_vectors(table(spark, rows), tile_rows=tile).collect()
    n = len(rows)
    good = [usable(v) and any(v) and l is not None for _, v, l in rows]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                link[i, j] = link[j, i] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98
    a, b = np.nonzero(link)
    root = forest(n, a, b)
    least = [min((rows[j][0] for j in np.flatnonzero(root == root[i]) if rows[j][0] is not None), default=None) for i in range(n)]
    want = sorted(((rows[i][0], int(link[i].sum()), least[i], rows[i][0] == least[i]) for i in range(n)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want and link.sum() > 100
    assert vector_dedup.link_vectors(table(spark, [])).count() == 0


def test_bounds_hold_and_spare_most_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64))
    links, _, recomputed = vector_dedup.tile_links(x, np.ones(400), np.arange(400), np.arange(400), 0.4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (links == ((unit @ unit.T >= 0.4) & ~np.eye(400, dtype=bool)).sum(axis=1)).all() and recomputed < 400 * 399 / 2 / 20
    codes, scale, error, length = vector_dedup.quantised(unit)
    about = (codes * scale[:, None]) @ (codes * scale[:, None]).T
    assert (np.abs(unit @ unit.T - about) <= error[:, None] + length[:, None] * error[None, :] + 1e-12).all()


def test_shards_grow_up_to_their_bytes():
    assert [topk.rows_of_a_shard(n, 64) for n in (0, 51_282, 2**21, 10**7, 10**11)] == [4096, 4096, 8192, 39063, 65536]
    assert topk.rows_of_a_shard(10**9, 4096) == 1024 and topk.rows_of_a_shard(10**9, 10**9) == 1


@pytest.mark.parametrize("shard", [64, 4096, None])
def test_top_k(spark, shard):
    rows = vectors(d=8)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows if i != 1400]
    rows += [(50 * k, rows[k][1], 0) for k in range(40, 44)]
    got = topk.top_k(table(spark, rows), shard_rows=shard, leaf=16).collect()
    cells = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and usable(v)]
    want = set()
    for q, v in {(i, tuple(v)) for i, v in cells if i % 50 == 0}:
        held = sorted(((sum(a * b for a, b in zip(v, w)), i) for i, w in cells if i != q and len(w) == len(v)), key=lambda x: (-x[0], x[1]))[:5]
        want |= {(q, k, i, max(-(1 << 63), min((1 << 63) - 1, s))) for k, (s, i) in enumerate(held, 1)}
    assert {tuple(r) for r in got} == want
    assert topk.top_k(table(spark, [])).count() == 0


@pytest.mark.parametrize("shard", [2, 4096])
def test_scores_beyond_64_bits_rank_as_they_are(spark, shard):
    sizes = [1e150, -1e150, 3e200, -3e200, 1e10, 2e10, 1.0, 0.0, -1e307, 1e307, 5e9]
    rows = [(i, [x, 2 * x], 0) for i, x in enumerate(sizes)] + [(50, [1e200, 1e200], 0), (100, [-1e200, 7.0], 0)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard_rows=shard, leaf=2).collect()
    cells = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if all(math.isfinite(256 * x) for x in v)]
    want = set()
    for q, v in cells:
        if q % 50 == 0:
            held = sorted(((sum(a * b for a, b in zip(v, w)), i) for i, w in cells if i != q), key=lambda x: (-x[0], x[1]))[:5]
            want |= {(q, k, i, max(-(1 << 63), min((1 << 63) - 1, s))) for k, (s, i) in enumerate(held, 1)}
    assert {tuple(r) for r in got} == want and len(cells) == len(rows) - 2


def test_best_first_search_skips_leaves():
    rng = np.random.default_rng(4)
    points = np.floor(256 * rng.normal(size=(4000, 3)))
    tree = topk.Tree(points, np.arange(4000), 32)
    for q in points[:20]:
        best = sorted(((-int(points[i] @ q), i) for i in range(1, 4000)))[:5]
        assert tree.search(q, 0, 5, -np.inf) == [(-s, i) for s, i in best]
        floor = -best[2][0]
        assert tree.search(q, 0, 5, floor) == [(-s, i) for s, i in best if -s >= floor]
    for (a, b), low, high in zip(tree.spans, tree.low, tree.high):
        assert (tree.points[a:b].min(axis=0) == low).all() and (tree.points[a:b].max(axis=0) == high).all()


PAGES = [(1, "u1", "<html>é\r\n\r\n</html>"), (2, "u\r\n2", ""), (3, None, None), (4, "u4", "ab" * 30_000), (5, "u5", "ab" * 30_000), (6, "u6", "\r\n\r\nWARC/1.1\r\n"), (7, "u7", "x\r\n"), (7, "u7", "x\r\n"), (None, "u", "null id"), (None, "u", "x\r\n"), (9, "u9", "WARC/1.1\r\n\r\n" * 4000)]


def archive(spark, tag, pages, **more):
    path = shared_path(spark, tag)
    warc.write_warc(pages, path, **more)
    return path, [f.path for f in os.scandir(path.removeprefix("file:").replace("//", "/")) if f.name.endswith(".warc.gz")]


@pytest.mark.parametrize("most", [200_000, 0])
def test_warc_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MOST_BROADCAST", most)
    pages = spark.createDataFrame([(*p, "clash", 1, "k") for p in PAGES], "page_id long, url string, html string, payload string, row int, kind string").repartition(3)
    path, files = archive(spark, "warc-test", pages)
    got = warc.read_warc(spark, path).collect()
    body = lambda h: (h or "").encode()
    latest = {}
    for i, _, h in PAGES:
        if i is not None:
            latest[body(h)] = max(i, latest.get(body(h), i))
    want = []
    for i, _, h in PAGES:
        first = latest.get(body(h))
        again = first is not None and i != first
        want.append((i, len(body(h)), base64.b32encode(hashlib.sha1(body(h)).digest()).decode(), "revisit" if again else "response", first if again else None, None if again else body(h)))
    assert sorted(((*r[:5], None if r[5] is None else bytes(r[5])) for r in got), key=repr) == sorted(want, key=repr)
    # the archives by themselves: one gzip member a record, names that differ, and revisits of responses that are there
    records = []
    for file in files:
        data = open(file, "rb").read()
        while data:
            one = zlib.decompressobj(31)
            whole = one.decompress(data) + one.flush()
            records += list(warc.records_of([(file, whole.removesuffix(warc.END))]))
            data = one.unused_data
    names = [r["record_id"] for r in records]
    assert len(set(names)) == len(names) and {r["kind"] for r in records} == {"response", "revisit", "continuation"}
    responses = {r["record_id"]: r["sha"] for r in records if r["kind"] == "response"}
    assert all(responses[r["refers"]] == r["sha"] for r in records if r["kind"] == "revisit")


def test_empty_archives(spark):
    path, _ = archive(spark, "warc-empty", spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_warc(spark, path).count() == 0


def test_small_pages_need_no_revisits(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "a", "x")], "page_id long, url string, html string")
    path, _ = archive(spark, "warc-small", pages, least_revisit=2)
    assert [r["record_type"] for r in warc.read_warc(spark, path).collect()] == ["response"] * 2


@pytest.mark.parametrize("broken", ["digest", "response", "segment"])
def test_broken_archives_raise(spark, broken):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "long " * 9000)], "page_id long, url string, html string").coalesce(1)
    path, (file,) = archive(spark, "warc-broken", pages)
    data, records = open(file, "rb").read(), []
    while data:
        one = zlib.decompressobj(31)
        records.append(one.decompress(data) + one.flush())
        data = one.unused_data
    if broken == "digest":
        records = [r.replace(b"\r\nx\r\n0", b"\r\ny\r\n0") for r in records]
    elif broken == "response":
        records = [r for r in records if b"page:2:" not in r.split(b"WARC-Date")[0]]
    else:
        records = [r for r in records if b"Segment-Number: 2" not in r]
    with open(file, "wb") as out:
        out.write(b"".join(warc.member(r.removesuffix(warc.END)) + warc.LAST for r in records))
    (crc := os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")) and os.path.exists(crc) and os.remove(crc)
    with pytest.raises(Exception, match="digest is|not there|segments"):
        warc.read_warc(spark, path).collect()


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 4097, 10_000])
def test_chunks(size):
    data = bytes(i % 251 for i in range(size))
    assert warc.unchunked(warc.chunked(data)) == data
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"2\r\nabc\r\n0\r\n\r\n")


def test_records_that_end_early_raise():
    record = warc.page_records(1, "0", "u", b"abc", None, "response")[0]
    assert len(list(warc.records_of([("f", record)]))) == 1
    with pytest.raises(ValueError):
        list(warc.records_of([("f", record[:-4])]))


def test_components(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    chain = [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    edges = [(int(x), int(y)) for x, y in zip(a, b)] + chain
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    root = forest(len(nodes), np.array([at[x] for x, _ in edges]), np.array([at[y] for _, y in edges]))
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: nodes[root[at[x]]] for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def busiest(spark, action):
    """Most rows that one task read from a shuffle during action."""
    seen = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    out = action()
    store = spark._jsc.sc().statusStore()
    most = 0
    for job in set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - seen:
        for stage in spark.sparkContext.statusTracker().getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 10_000)
            for i in range(tasks.size()):
                metrics = tasks.apply(i).taskMetrics()
                if metrics.isDefined():
                    most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return out, most


def test_a_hub_meets_in_no_task(spark):
    """A star with most of the edges and some small components: no task gets more than a share of the hub's edges."""
    rng = np.random.default_rng(7)
    leaves = np.unique(rng.integers(1, 1 << 60, 60_000)).tolist()
    edges = [(0, v) for v in leaves] + [(-5, -6), (-6, -7), (-7, -8)] + [(leaves[i], leaves[i + 1]) for i in range(0, 2000, 2)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(16).persist()
    table.count()
    # rows stay dealt as the plan deals them: no partitions are put together, no join becomes a broadcast
    wanted = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        got, most = busiest(spark, lambda: {r["node"]: r["component"] for r in connected_components(table, hub=1000).collect()})
        _, whole = busiest(spark, lambda: connected_components(table, hub=10**9).count())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {**{v: 0 for v in [0, *leaves]}, **{v: -8 for v in (-5, -6, -7, -8)}}
    assert most < len(leaves) / 4 < len(leaves) < whole


def test_trees_are_built_twice_at_most(spark):
    rows = table(spark, vectors(400, d=8))
    plan = topk.top_k(rows, every=50, shard_rows=64)._jdf.queryExecution().toString()
    # what is left to run searches away from home only: the points and the queries are read, and one search runs
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") <= 3


def test_the_widest_vector_sets_a_shard(spark, monkeypatch):
    seen = []
    plain = topk.rows_of_a_shard
    monkeypatch.setattr(topk, "rows_of_a_shard", lambda n, dim: seen.append((n, dim)) or plain(n, dim))
    wide = spark.createDataFrame([(i, [1.0] * 2) for i in range(1500)] + [(9000, [1.0] * 50)], "`vec.id` long, `a.b` array<float>").coalesce(1)
    assert topk.top_k(wide, "vec.id", "a.b", k=2).count() == 30 * 2 and seen == [(1501, 50)]
