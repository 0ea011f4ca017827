"""Compaction plans and ball k-means against brute force: null, empty and very large values, ties, repeats, empty tables, clashing names."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import clustering, compaction


def plan_by_hand(rows, r=compaction.Rules()):
    files = defaultdict(list)
    for key, text, source in rows:
        h = zlib.crc32(str(key).encode()) if key is not None else 0
        block = None if key is None else key // r.block_ids
        slot = min(h % r.slots, h // r.slots % r.slots)
        live = not h // r.slots**2 % 100 < r.kill * ((slot + (block or 0)) % r.slots)
        files[(source or "").encode(), (block is not None, block or 0), slot].append((key, text or "", live))
    size = lambda x: len(x[1].encode())
    dirty = {f: 100 * sum(not x[2] for x in v) >= r.dirty * len(v) for f, v in files.items()}
    groups, full = [], {}
    for f in sorted(files):
        live = sum(size(x) for x in files[f] if x[2])
        if dirty[f] or sum(map(size, files[f])) < r.small * r.target:
            if f[0] in full and full[f[0]] + live <= r.target:
                next(g for g in reversed(groups) if g[0][0] == f[0]).append(f)
                full[f[0]] += live
            else:
                groups.append([f])
                full[f[0]] = live
    total = lambda g: sum(size(x) for f in g for x in files[f])
    queue = sorted((g for g in groups if len(g) > 1 or dirty[g[0]]), key=lambda g: (-len(g), total(g), g[0]))
    whole, run, out, moved = sum(map(total, queue)), 0, [], set()
    for n, g in enumerate(queue):
        run += total(g)
        if 100 * run > r.share * whole:
            break
        moved.update(g)
        out.append((g, n))
    out += [([f], None) for f in files if f not in moved]
    done = []
    for g, n in out:
        live = sorted((x for f in g for x in files[f] if x[2]), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
        digest = hashlib.sha256("".join(f"{'' if k is None else k}:{t}\n" for k, t, _ in live).encode()).hexdigest()
        b = g[0][1]
        done.append((g[0][0].decode(), b[1] if b[0] else None, g[0][2], len(g), len(live), total(g), None if n is None else total(g) + sum(map(size, live)) + r.file_cost * len(g), None if n is None else n // r.wave, digest))
    return sorted(done, key=repr)


@pytest.mark.parametrize("leaf", [3, 1 << 16])
def test_plan_equals_brute_force(spark, leaf):
    rng = np.random.default_rng(1)
    rows = [(int(i), "é" * int(rng.integers(0, 40)), ["hot", "hot", "hot", "a", "é", None][int(rng.integers(0, 6))]) for i in rng.integers(-3000, 60_000, 1500)]
    rows += [(5, "same", "hot"), (5, "same", "hot"), (5, None, "hot"), (None, "x", "a"), (None, None, None), (2**62, "far", "a"), (70, "z" * 400_000, "b"), (71, "", "")]
    rows += [(200_000 + 2000 * i, "" if i % 2 else "y" * 10, "empties") for i in range(60)]
    rules = compaction.Rules(target=300)
    wide = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], "doc_id long, text string, source string, block int, file string, slot int, pos int, key string").repartition(5)
    got = sorted(map(tuple, compaction.compaction_plan(wide, rules, leaf_rows=leaf).collect()), key=repr)
    want = plan_by_hand(rows, rules)
    assert got == want and any(r[7] for r in want) and max(r[3] for r in want) > 5
    assert compaction.compaction_plan(wide.limit(0), rules).count() == 0


def test_scan_equals_running_merge(spark):
    """Any associative merge, here of texts, over more leaves than one level of the tree holds."""
    n = 300
    leaves = spark.range(n).selectExpr("id as node", "cast(concat(id, ',') as binary) as value").repartition(7)
    got = {r["node"]: bytes(r["before"]) for r in compaction.blelloch(leaves, lambda a, b: a + b, b"", n, fan=4).collect()}
    assert got == {i: "".join(f"{j}," for j in range(i)).encode() for i in range(n)}


def test_next_fit_functions_compose():
    """However a source's files are cut into leaves, their functions lead to the same groups as one pass."""
    rng, rule = np.random.default_rng(3), compaction.NextFit(50)
    for _ in range(200):
        live = rng.choice([0, 1, 7, 20, 50, 51, 80], rng.integers(1, 30)).astype(np.int64)
        cuts = sorted({0, len(live), *rng.integers(0, len(live), 3).tolist()})
        value = b""
        for a, b in zip(cuts, cuts[1:]):
            value = rule.merge(value, rule.pack("s", "s", *rule.leaf(np.arange(a, b), live[a:b])))
        fresh = rule.breaks(live, None)
        last = int(np.flatnonzero(fresh)[-1])
        assert rule.entry(value, "s") == (min(int(live[last:].sum()), rule.over), last) and rule.entry(value, "t") == (None, -1)


def lloyd(rows, k=16, rounds=3, scale=64.0, seed="1"):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows]
    draw = lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), clustering.packed(np.array([r[1]], np.float64))[0])
    centre = [v for _, v in sorted(kept, key=draw)[:k]]
    for turn in range(rounds + 1):
        apart = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centre] for _, v in kept]
        own = [min(range(len(centre)), key=lambda j: (d[j], j)) for d in apart]
        if turn < rounds:
            for j in range(len(centre)):
                if mine := [v for (_, v), o in zip(kept, own) if o == j]:
                    centre[j] = [sum(x) // len(mine) for x in zip(*mine)]
    most = (1 << 63) - 1
    each = [d[o] for d, o in zip(apart, own)]
    inertia = {j: sum(d for d, o in zip(each, own) if o == j) for j in set(own)}
    return sorted(((i, o, min(d, most), min(inertia[o], most), min(sum(each), most), hashlib.sha256(",".join(map(str, centre[o])).encode()).hexdigest()) for (i, _), o, d in zip(kept, own, each)), key=repr)


@pytest.mark.parametrize("far", [False, True])
def test_clusters_equal_lloyd(spark, far):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(9, 4))
    good = [(int(i), (centre[i % 9] + rng.normal(scale=0.2, size=4)).astype(np.float32).tolist()) for i in range(240)]
    good += [(7, good[7][1]), (7, good[7][1]), (None, good[3][1]), (900, [0.0] * 4), (901, [0.5] * 4), (902, [0.5] * 4)] + ([(950, [1e12, -3e30, 1.0, 0.0]), (951, [1e12, -3e30, 2.0, 0.0])] if far else [])
    bad = [(1000, None), (1001, []), (1002, [1.0] * 3), (1003, [float("nan")] * 4), (1004, [float("inf")] + [0.0] * 3), (1005, [None, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in good + bad], "vec_id long, embedding array<float>, cluster int, vector string, n int").repartition(3)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in good]
    for k in (7, 1000):
        got = sorted(map(tuple, clustering.ball_kmeans(table, dim=4, k=k).collect()), key=repr)
        assert got == lloyd(rows, k)
    assert clustering.ball_kmeans(table.limit(0), dim=4).collect() == []


def test_balls_spare_far_centroids():
    rng = np.random.default_rng(0)
    centre = np.round(rng.normal(scale=1000, size=(40, 8)))
    own = rng.integers(0, 40, 4000)
    x = np.round(centre[own] + rng.normal(scale=100, size=(4000, 8)))
    met = []
    plain, clustering.squared = clustering.squared, lambda a, b: (met.append(len(a)), plain(a, b))[1]
    try:
        near, best = clustering.ball_assign(x, own, centre)
    finally:
        clustering.squared = plain
    every = ((x[:, None] - centre[None]) ** 2).sum(axis=2)
    assert (near == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all() and sum(met) < 3 * len(x)
