"""Sharding, packing, SimHash, licenses, mixing and the classifiers on awkward documents, against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import langid, licenses, mixing, packing, quality, sharding, simhash
from lodestone.llm.common import xxh64_spans

utf8 = lambda t: (t or "").encode()


def test_xxh64_of_all_lengths():
    data = bytes(range(256))
    starts, lengths = np.arange(120), np.arange(120)
    assert [int(x) for x in xxh64_spans(data, starts, lengths, 42)] == [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(starts, lengths)]


def test_sharding(docs, empty, rows):
    got = sharding.shard_documents(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(utf8(t)) + 1, zlib.crc32(utf8(t))) for i, t, _, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 3}) == 1
    assert sharding.shard_documents(empty).count() == 0


def test_draws_follow_weights_and_move_only_into_changed_subtrees(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "k")
    tree = sharding.topology(16)
    before = {r["k"]: r["shard"] for r in sharding.with_shard(ids, "k", tree).collect()}
    heavy = [sharding.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in tree]
    after = {r["k"]: r["shard"] for r in sharding.with_shard(ids, "k", heavy).collect()}
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    assert moved and all(z // 8 == 0 for _, z in moved)  # only into the region whose weight rose
    assert all(z // 4 == 1 for a, z in moved if a // 8 == 0)  # from within it only into the rack whose weight rose
    assert all(z == 5 for a, z in moved if a // 4 == 1)  # and from within that only into the shard
    sizes = Counter(after.values())
    assert 1.7 < sizes[5] / np.mean([sizes[s] for s in range(16) if s != 5]) < 2.3


@pytest.mark.parametrize("with_ids", [True, False])
def test_packing(docs, empty, rows, with_ids):
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [real.encode(t or "", add_special_tokens=False).ids + [0] for _, t, _, _ in rows]
    got = packing.pack_documents(docs, with_ids=with_ids).collect()
    want = Counter()
    for (i, _, _, _), x in zip(rows, ids):
        first = len(x) % 2048 or 2048
        cuts = [0, *range(first, len(x) + 1, 2048)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    spots = {}
    for r in got:
        spots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spots.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1].tolist()] and sum(n for _, n in s) <= 2048
    assert packing.pack_documents(empty).count() == 0


@pytest.fixture(scope="module")
def real():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda texts: [np.array(x.ids, "<u4").tobytes() for x in made.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("sign", [" ", "\n", "a", "1", "-", "\u3000", "\u00e9", "\u6f22", "a ", "a  b", "\0"])
def test_runs_of_a_million_characters(real, sign):
    run = sign * (1_000_000 // len(sign))
    texts = [run, "word" + run, run + "word", "two words" + run + "two words"]
    for text in texts:
        assert packing.token_bytes([text]) == real([text])


def test_ids_of_a_whole_table(real):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist()]
    for k in range(0, len(texts), 500):
        assert packing.token_bytes(texts[k : k + 500]) == real(texts[k : k + 500])


def test_added_tokens_are_read_as_the_plain_call_reads_them(real):
    added = [t.content for t in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).get_added_tokens_decoder().values()]
    texts = ["a<|endoftext|>b", "<|endo ftext|>", "words before <|endof", "text|> words after"]
    for token in added:
        texts += [token, token * 3, f"a{token}b", f"some words {token} more words", f" {token}\n{token} ", f"{token[:-1]} {token}", token[:-1], token[1:]]
    assert added and packing.token_bytes(["a<|endoftext|>b"])[0] == np.array([64, 50256, 65], "<u4").tobytes()
    assert packing.token_bytes(texts) == real(texts) and packing.token_bytes(texts[::-1]) == real(texts[::-1])


@pytest.mark.parametrize("most", [packing.HELD, 40])
def test_ids_of_any_signs(real, most):
    """Cuts at spaces change no id, whatever stands beside them, and whether parts are kept or not."""
    import random

    rng = random.Random(1)
    signs = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\u2003", "\u3000", "\x85", "\x1c", "\u200b", "\u2028", "\ufeff", "\u180e", "'s", "'re", "'", "a", "Word", "\xdf", "\u6f22", "\u0661", "\xb2", "\xbd", "\xe9", "\U0001f600", "-", "...", "12", "\0", "\x7f", "\u0301", "<|endoftext|>", "x" * 70]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), most)
    got = [x for k in range(0, len(texts), 100) for x in encoder.encode(texts[k : k + 100])]
    assert got == real(texts) and all(len(p) <= packing.LONGEST for p in encoder.held) and len(encoder.held) <= most and bool(encoder.old) == (most == 40)


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(1)
    bins, open_bins, made = packing.OpenBins(64, 8), {}, 0
    for size in rng.integers(1, 65, 3000).tolist():
        fit = [f for f in open_bins.values() if f >= size]
        number, offset = bins.place(size)
        if fit:
            assert number in open_bins and open_bins[number] == min(fit) and offset == 64 - min(fit)
        else:
            if len(open_bins) == 8:
                least = min(open_bins.values())
                held = {n for stack in bins.bins for n in stack} | {number}
                closed = [n for n in open_bins if n not in held]
                assert len(closed) == 1 and open_bins[closed[0]] == least
                del open_bins[closed[0]]
            assert number == made and offset == 0
            made += 1
            open_bins[number] = 64
        open_bins[number] -= size
        if not open_bins[number]:
            del open_bins[number]


def slow_print(text, k):
    w = utf8(text).lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def classes(prints, threshold):
    n = len(prints)
    link = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= threshold
    root = np.arange(n)
    while True:
        new = np.array([root[link[i]].min() for i in range(n)])
        if (new == root).all():
            return root
        root = new


def test_simhash(docs, empty, rows):
    got = simhash.simhash_components(docs).select("doc_id", simhash.hex_bits("fingerprint_bits").alias("f"), "component_id").collect()
    prints = np.array([slow_print(t, 3) for _, t, _, _ in rows], np.uint64)
    root = classes(prints, 2)
    least = {c: min((rows[i][0] for i in np.flatnonzero(root == c) if rows[i][0] is not None), default=None) for c in set(root.tolist())}
    assert Counter(map(tuple, got)) == Counter((r[0], f"{int(p):016x}", least[c]) for r, p, c in zip(rows, prints, root.tolist()))
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("threshold,per_anchor,tile", [(2, 4, 4096), (3, 32, 64), (2, 1024, 40)])
def test_anchors_lose_no_link(spark, threshold, per_anchor, tile):
    rng = np.random.default_rng(threshold)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = base[rng.integers(0, 150, 500)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) * (rng.random(500) < 0.7)
    prints = np.unique(np.concatenate([base, near, np.array([0, 1, 3, 7, 15], np.uint64)]))
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fingerprint_bits long")
    links = simhash.fingerprint_links(table, threshold, len(prints), per_anchor, tile).collect()
    at = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    a, b = np.array([at[r["a"]] for r in links]), np.array([at[r["b"]] for r in links])
    assert (np.bitwise_count(prints[a] ^ prints[b]) >= 0).all()
    from lodestone.llm.common import forest

    assert (forest(len(prints), a, b) == classes(prints, threshold)).all()


@pytest.mark.parametrize("told,tile", [(100, 16384), (1 << 21, 16384), (1 << 34, 16384), (100, 40)])
def test_segments_lose_no_link(spark, told, tile):
    plan = simhash.segments_for(told, 0.8)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, (60, plan.words), dtype=np.uint64)
    near = base[rng.integers(0, 60, 400)]
    for _ in range(24):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, near.shape).astype(np.uint64)) * (rng.random(near.shape) < 0.35)
    words = np.unique(np.concatenate([base, near, np.zeros((1, plan.words), np.uint64)]), axis=0)
    whole = [sum(int(v) << (64 * k) for k, v in enumerate(w)) for w in words]
    share = np.zeros((len(words), len(words)), bool)
    for segment in range(plan.number):
        piece = np.array([(v >> (plan.width * segment)) & ((1 << plan.width) - 1) for v in whole], np.uint64)
        share |= np.bitwise_count(piece[:, None] ^ piece[None, :]) <= 1
    apart = sum(np.bitwise_count(words[:, None, w] ^ words[None, :, w]).astype(int) for w in range(plan.compared))
    from lodestone.llm.common import forest

    linked = share & (apart <= simhash.most_bits(0.8, 64 * plan.compared))
    want = forest(len(words), *np.nonzero(linked))
    names = simhash.word_names(plan.words)
    table = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words.view(np.int64))], f"cid long, {', '.join(n + ' long' for n in names)}")
    links = simhash.similar_links(table, 0.8, plan, tile).collect()
    a, b = np.array([r["a"] for r in links]), np.array([r["b"] for r in links])
    assert (forest(len(words), a, b) == want).all() and 60 < len(set(want.tolist())) < len(words)
    assert linked[a, b].all() and (a < b).all()


@pytest.mark.parametrize("n", [0, 1000, 10**6, 10**8, 10**10, 10**14])
def test_segments_follow_the_number_of_fingerprints(n):
    plan = simhash.segments_for(n, 0.8)
    p = simhash.bit_share(0.8)
    met = (1 - p) ** plan.width + plan.width * p * (1 - p) ** (plan.width - 1)
    assert 1 - (1 - met) ** plan.number >= 0.9 and plan.words * 64 >= plan.width * plan.number
    assert n <= 4 * 2**plan.width or plan.width == simhash.WIDEST
    assert plan.number <= max(8, 8 * (max(n, 1) / 2**18) ** 0.3)


def test_a_dense_tile_gives_a_forest_only():
    every = np.arange(3000)
    a, b = simhash._tile_pairs(3000, every >= 0, lambda rows: (np.repeat(rows, 3000), np.tile(every, len(rows)), np.full(3000 * len(rows), 4)))
    assert len(a) == 2999


def test_nearest_forest_takes_the_least_distances():
    rng = np.random.default_rng(2)
    a, b, d = rng.integers(0, 50, 400), rng.integers(0, 50, 400), rng.integers(0, 30, 400)
    root, want = list(range(50)), []
    for i in sorted(range(400), key=lambda i: d[i]):
        x, y = root[a[i]], root[b[i]]
        if x != y:
            want.append(d[i])
            root = [x if r == y else r for r in root]
    got = simhash.nearest_forest(50, a, b, d)
    assert sorted(d[got]) == want and len(got) == 49
    assert not len(simhash.nearest_forest(5, a[:0], b[:0], d[:0]))


def test_similarity_sets_the_bits():
    assert simhash.most_bits(1.0, 128) == 0 and simhash.most_bits(0.8, 128) == 31
    got = simhash.jaccard([b"a b c d e f", b"", b"A  b", b"x"], [b"a b c d e g", b" ", b"a b", b"y"], 5)
    assert got.tolist() == [1 / 3, 1.0, 1.0, 0.0]


@pytest.mark.parametrize("told", [10_000, 10**7])
def test_plans_propose_pairs_of_just_the_asked_similarity(told):
    """Edited, cut and lengthened copies of a similarity from 0.80 to 0.83, at least 1,000 pairs: nine of ten or more are proposed."""
    rng, pairs = np.random.default_rng(told), []
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    while len(pairs) < 1050:
        a = word(int(rng.choice([60, 300, 900])))
        b, n = list(a), len(a)
        if (kind := len(pairs) % 3) == 0:
            for i in rng.choice(n, max(1, int(n * rng.uniform(0.01, 0.035))), replace=False):
                b[i] = "edited"
        elif kind == 1:
            b = a[: int(n * rng.uniform(0.78, 0.86))]
        else:
            b = a + word(int(n * rng.uniform(0.17, 0.28)))
        one, other = " ".join(a).encode(), " ".join(b).encode()
        if 0.8 <= simhash.jaccard([one], [other], 5)[0] < 0.83:
            pairs.append((one, other))
    plan = simhash.segments_for(told, 0.8)
    x, y = (simhash.fingerprints(list(side), 5, count=plan.words, distinct=True) for side in zip(*pairs))
    met = np.zeros(len(pairs), bool)
    for segment in range(plan.number):
        met |= np.bitwise_count(plan.piece(list(x.T), segment) ^ plan.piece(list(y.T), segment)) <= simhash.FLIPPED
    met &= np.bitwise_count(x[:, : plan.compared] ^ y[:, : plan.compared]).sum(axis=1) <= simhash.most_bits(0.8, 64 * plan.compared)
    assert met.mean() >= 0.9


def proposed(texts):
    """The pairs that the segments of a small table propose, by their definition."""
    plan = simhash.segments_for(len(texts), 0.8)
    prints = simhash.fingerprints([t.encode() for t in texts], 5, count=plan.words, distinct=True)
    share = np.zeros((len(texts), len(texts)), bool)
    for segment in range(plan.number):
        piece = plan.piece(list(prints.T), segment)
        share |= np.bitwise_count(piece[:, None] ^ piece[None, :]) <= 1
    return share & (sum(np.bitwise_count(w[:, None] ^ w[None, :]).astype(int) for w in prints.T[: plan.compared]) <= simhash.most_bits(0.8, 64 * plan.compared))


def holds(kept, texts, exact):
    """One row of every true component, and no two that a proposed pair of true similarity connects."""
    from lodestone.llm.common import forest

    a, b = np.nonzero(np.triu(proposed(texts), 1))
    sure = simhash.jaccard([texts[i].encode() for i in a], [texts[i].encode() for i in b], 5) >= 0.8
    told = forest(len(texts), a[sure], b[sure])
    return {exact[i] for i in kept} == set(exact.tolist()) and len({told[i] for i in kept}) == len(kept)


def test_keep_one_against_all_pairs(spark):
    """Copies with more and more changed words: just those with a true similarity of 0.8 or more go, whatever repeats dominate their fingerprints."""
    rng = np.random.default_rng(4)
    texts = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        other = list(words)
        for at in range(5, 5 + 12 * (k % 10), 12):
            other[at] = "changed"
        texts += [" ".join(words), " ".join(other)]
    texts += ["the same line again and again " * 200 + " ".join(f"v{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(5)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert holds(kept, texts, all_pairs(texts, 0.8)) and set(range(120, 125)) <= kept


def edits(rng, number, least, most):
    """Texts of 400 words that differ from one text in least to most of them."""
    base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    out = []
    for _ in range(number):
        words = list(base)
        for at in rng.choice(400, rng.integers(least, most + 1), replace=False):
            words[at] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(words))
    return out


def all_pairs(texts, similarity):
    from lodestone.llm.common import forest

    a, b = np.triu_indices(len(texts), 1)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    hit = np.array([len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity for i, j in zip(a, b)])
    return forest(len(texts), a[hit], b[hit])


def test_a_family_of_edits_keeps_one_of_each_true_component(spark):
    """Pairs near 0.8, where fingerprint distances say little: the nearest pairs fail, those behind them must be tried."""
    texts = edits(np.random.default_rng(5), 300, 4, 8)
    want = all_pairs(texts, 0.8)
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert holds(kept, texts, want)


@pytest.mark.parametrize("tile", [1024, 50])
def test_rows_of_an_open_group_all_meet(spark, tile):
    texts = [*edits(np.random.default_rng(6), 150, 4, 8), "", " "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "cid long, text string")
    pairs = spark.createDataFrame([(0, i) for i in range(1, len(texts))], "a long, b long")
    got = simhash.across_links(pairs, rows.selectExpr("cid", "cid as root"), rows, 0.8, 5, tile).collect()
    from lodestone.llm.common import forest

    want = all_pairs(texts[:150], 0.8).tolist() + [150, 150]
    assert forest(len(texts), np.array([r["a"] for r in got]), np.array([r["b"] for r in got])).tolist() == want


def test_rows_that_differ_in_repetition_only_are_one(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):
        body, line = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in (300, 8))
        rows += [(2 * k, " ".join([body, *[line] * 3])), (2 * k + 1, " ".join([body, *[line] * 60]))]
    assert simhash.jaccard([rows[0][1].encode()], [rows[1][1].encode()], 5).tolist() == [1.0]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * k for k in range(40)}


def test_keep_one(docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and simhash.keep_one(empty).count() == 0
    texts = [r["text"] for r in kept.collect()]
    assert texts.count("same") == 1 and sum(t is None or not t.strip() for t in texts) == 1
    assert sum(t is not None and t.startswith("Der schnelle") for t in texts) == 1


def test_licenses(docs, empty, rows):
    got = licenses.license_summary(docs).collect()
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for i, t, _, _ in rows:
        w = word.findall(utf8(t).lower())
        hits = [(p, l) for phrase, l in licenses.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.encode().split()]
        want[i, len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({l for _, l in hits}))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert licenses.license_summary(empty).count() == 0


def test_a_changed_notice_is_found_by_merged_diagonals(spark):
    notice = licenses.NOTICES["mit-notice"].split()
    changed = " ".join(notice[:20] + ["really", "quite"] + notice[20:40] + notice[41:])
    got = licenses.license_spans(spark.createDataFrame([(1, "intro words here " + changed + " outro"), (2, "free of charge, to any person")], "doc_id long, text string")).where("label = 'mit-notice'").collect()
    assert [(r["doc_id"], r["first"]) for r in got] == [(1, 3)] and 0.8 < got[0]["coverage"] < 1


def test_repeats_of_a_short_notice_keep_their_label(spark):
    texts = ["Released under the MIT License. " * 5, "Licensed under the Apache License, Version 2.0; " * 4, "\u0130 K \u212a MIT License"]
    got = licenses.license_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("label is not null").collect()
    spans = lambda label: sorted(r["first"] for r in got if r["label"] == label)
    assert spans("mit-line") == [0, 5, 10, 15, 20] and spans("apache-2.0") == [0, 8, 16, 24]
    assert [(r["doc_id"], r["n_words"]) for r in got if r["label"] == "mit" and r["doc_id"] == 2] == [(2, 5)]


def test_mixing(docs, empty, rows):
    got = mixing.mix_documents(docs).collect()
    size = lambda t: len(utf8(t).split())
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    total = {s: sum(size(t) for _, t, _, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, rest, left = {}, set(sources), 1.5 * sum(total.values())
    while True:
        over = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            rest.discard(s)
        left = 1.5 * sum(total.values()) - sum(target.values())
        if not rest:
            break
    target |= {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(total[s], round(target[s], 6)) for s in sources}
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _, _ in rows)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    assert Counter(got) == Counter(mixing.mix_documents(docs).collect())
    assert mixing.mix_documents(empty).count() == 0 and mixing.emit_mix(docs).columns == docs.columns


def test_mix_comes_near_its_targets(spark):
    got = mixing.mix_documents(spark.range(30_000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 5 as int)) as text", "concat('s', id % 7) as source"))
    for r in got.groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert r["sum(taken)"] == pytest.approx(r["target"], rel=0.05)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").persist()


def test_quality_on_held_out_rows(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify_quality(corpus, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.93
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None, :]) > 0.95


def test_labels_of_held_out_rows_teach_nothing(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in quality.classify_quality(corpus, x).collect()) for x in (labels, turned))
    assert a == b


def test_quality_on_awkward_rows(spark, docs, empty, rows):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (5, 1), (5, 1)], "doc_id long, quality int")
    got = quality.classify_quality(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert quality.classify_quality(empty, labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in quality.classify_quality(docs, none).collect()} == {0.5}


def test_word_buckets_part_words_by_class():
    bucket, doc = quality.word_buckets([b"and*** and", b"", b"*** and 12"])
    assert doc.tolist() == [0, 0, 0, 2, 2, 2] and bucket[0] == bucket[2] == bucket[4] and bucket[1] == bucket[3] != bucket[0]


def test_languages_on_held_out_rows(corpus):
    got = langid.identify_languages(corpus).join(corpus.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


def test_languages_on_awkward_rows(spark, docs, empty, rows):
    got = langid.identify_languages(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    letter = Counter((i, bool(t and any(c.isalpha() for c in t))) for i, t, _, _ in rows)
    assert Counter((r["doc_id"], r["lang_pred"] != "und") for r in got) == letter
    assert all(0 <= r["score"] <= 1 for r in got) and {r["lang_pred"] for r in got} <= {"en", "de", "und"}
    assert langid.identify_languages(empty).count() == 0


def test_texts_of_no_learned_language_are_rejected(spark, corpus):
    rng = np.random.default_rng(3)
    made = lambda signs, low, high: " ".join("".join(rng.choice(list(signs), rng.integers(low, high))) for _ in range(80))
    texts = [
        "La mattina presto il mercato si riempie di persone che cercano frutta fresca, pane caldo e formaggi delle colline vicine, mentre i bambini corrono tra le bancarelle",
        "Wczesnym rankiem rynek zapełnia się ludźmi, którzy szukają świeżych owoców, ciepłego chleba i serów z pobliskich wzgórz, a dzieci biegają między straganami",
        "Varhain aamulla tori täyttyy ihmisistä, jotka etsivät tuoreita hedelmiä, lämmintä leipää ja juustoja läheisiltä kukkuloilta, kun lapset juoksevat kojujen välissä",
        "Рано утром городской рынок заполняется людьми, которые ищут свежие фрукты",
        *[made("abcdefghijklmnopqrstuvwxyz", 2, 10) for _ in range(10)], *[made("0123456789abcdef", 16, 17) for _ in range(5)],
    ]
    model = langid.fit_languages(corpus)
    got = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    assert not [(r["row"]["doc_id"], r["score"]) for r in got if r["accepted"]]
    known = langid.identify(corpus.select("doc_id", "text"), model).collect()
    assert all(r["lang_pred"] in model.names for r in known)
    assert np.mean([r["accepted"] for r in known]) > 0.995


def test_held_out_texts_teach_no_language(corpus):
    from pyspark.sql import functions as F

    out = quality.held_out(F.col("doc_id"))
    other = corpus.withColumn("text", F.when(out, F.lit("ein anderer Text über etwas ganz anderes zzz")).otherwise(F.col("text")))
    a, b = (sorted(langid.identify_languages(x).where("not held_out").collect()) for x in (corpus, other))
    assert [(r["doc_id"], r["lang_pred"], r["accepted"]) for r in a] == [(r["doc_id"], r["lang_pred"], r["accepted"]) for r in b]
    assert [r["score"] for r in a] == pytest.approx([r["score"] for r in b], abs=2e-6)  # single precision, summed in batches


def test_languages_of_any_size_are_learned(spark):
    """A language with most rows, rare ones, repeated rows, and one without a letter, at a sample far below the number of rows."""
    rows = [(i, f"the rows of a large language number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}", "en") for i in range(3000)]
    rows += [(5000, "one row repeats itself", "en")] * 3000 + [(6000 + i, f"kleine Sprache {chr(97 + i)}", "de") for i in range(8)] + [(7000 + i, "123 456", "xx") for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learn = langid.learning_rows(table, "doc_id", "text", "lang")
    total, held, limits = langid.gram_statistics(learn, 10)
    keys = {}
    for r in learn.collect():
        keys.setdefault(r["lang"], set()).add(r["key"])
    assert set(limits) == {"en", "de"} and total == learn.where("lang <> 'xx'").count() and held.max() <= total
    for lang in limits:
        assert sum(k <= limits[lang] for k in keys[lang]) == min(10, len(keys[lang]))
    with pytest.warns(UserWarning, match="xx"):
        model = langid.fit_languages(table, sample=30)
    assert model.names == ["de", "en"]


def test_sampled_rows_of_languages_stay_in_the_tasks(corpus, monkeypatch):
    got, collect = [], type(corpus).collect

    def counted(self):
        rows = collect(self)
        got.append(sum(len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(type(corpus), "collect", counted)
    model = langid.fit_languages(corpus)
    assert max(got) == model.table.nbytes


def test_grams_weights_and_cosine_by_hand():
    texts = ["Ab, 12 ç!", "", "12", " über ab ", "ab"]
    counts, has = langid.gram_counts([t.encode() for t in texts])
    def slow(text):
        words = re.findall(r"[^\W\d_]+", text.lower())
        out = np.zeros(langid.BUCKETS)
        line = " " + "".join(w + " " for w in words)
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                gram = line[i : i + n]
                if gram[n // 2] != " ":
                    key = n
                    for c in gram:
                        key = (key * 1114112 + ord(c)) % 2**64
                    out[(key * 0x9E3779B97F4A7C15 % 2**64 >> 32) % langid.BUCKETS] += 1
        return out

    want = np.array([slow(t) for t in texts])
    assert (counts == want).all() and has.tolist() == [True, False, False, True, True]
    idf = np.random.default_rng(1).random(langid.BUCKETS).astype(np.float32) + 1
    table = np.random.default_rng(2).random((3, langid.BUCKETS)).astype(np.float32)
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    model = langid.Centroids(idf, ["a", "b"], np.array([0, 0, 1]), table, np.array([[0.05, 0.1], [0.1, 0.2]]), np.array([8, 40]))
    lang, score, near = model.predict(counts)
    for i in (0, 3, 4):
        x = [np.log(1 + c) * w for c, w in zip(want[i], idf)]
        cosine = [sum(a * b for a, b in zip(x, row)) / np.sqrt(sum(a * a for a in x)) for row in table]
        best = int(np.argmax(cosine))
        assert lang[i] == [0, 0, 1][best] and score[i] == pytest.approx(cosine[best], abs=1e-5)
        part = min(max((want[i].sum() - 8) / 32, 0), 1)
        assert near[i] == (score[i] >= [0.1, 0.1, 0.2][best] * (1 + part) / 2)


def test_short_texts_are_judged_by_their_length(spark):
    """Held-out texts cut short stay; letters of no language and other scripts go, at any length."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit_languages(docs)
    assert (np.diff(model.grams) > 0).all() and (np.diff(model.least, axis=1) > 0).mean() > 0.7
    rng = np.random.default_rng(4)
    texts = [r["text"] for r in docs.where(quality.held_out(F.col("doc_id"))).orderBy("doc_id").limit(600).collect()]
    junk = lambda n: " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(n))
    for letters in (8, 16, 40, 100):
        cut = [t[:letters].encode() for t in texts]
        counts, has = langid.gram_counts(cut)
        _, _, stays = model.predict(counts)
        assert stays[has].mean() > 0.99
        other, _ = langid.gram_counts([junk(max(1, letters // 6)).encode() for _ in range(400)])
        assert model.predict(other)[2].mean() < {8: 0.2, 16: 0.15, 40: 0.1, 100: 0.07}[letters]
    odd, _ = langid.gram_counts([t.encode() for t in ("zzzz", "qzx vkj wqp", "\u043f\u0440\u0438\u0432\u0435\u0442", "\u4f60\u597d\u4e16\u754c")])
    assert not model.predict(odd)[2].any()


def test_languages_without_a_bound_are_refused(spark):
    table = spark.createDataFrame([(i, f"text {i}", f"x{i}") for i in range(2 * langid.MOST_LANGUAGES)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.fit_languages(table)


def test_contexts_pooling_and_the_network_by_hand():
    texts = [b"a bb a ccc", b"", b"bb bb bb, a"]
    at, sign = quality.index_vectors()
    bucket, doc = quality.word_buckets(texts)
    want = np.zeros((quality.BUCKETS, quality.DIMS))
    for i, word in enumerate(bucket):
        for j, near in enumerate(bucket):
            if i != j and abs(i - j) <= quality.WINDOW and doc[i] == doc[j]:
                for spot, s in zip(at[near], sign[near]):
                    want[word, spot] += s
    assert (quality.context_sums(texts, at, sign) == want).all()
    vectors = np.random.default_rng(0).normal(size=(quality.BUCKETS, 4)).astype(np.float32)
    got = quality.pooled(texts, vectors)
    for k in range(3):
        mine = bucket[doc == k]
        again = sum(any(i >= s and mine[i] == mine[i - s] for s in (1, 2)) for i in range(len(mine)))
        mean = vectors[mine].mean(axis=0) if len(mine) else np.zeros(4)
        assert got[k] == pytest.approx([*mean, again / max(1, len(mine)), np.log(1 + len(mine)) / 10], abs=1e-6)
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(size=2), rng.random(2) + 1, rng.normal(size=(2, 3)), rng.normal(size=3), rng.normal(size=3), 0.3, 1.7)
    for x in rng.normal(size=(4, 2)):
        hidden = [max(0, sum((x[i] - net.mean[i]) / net.spread[i] * net.w1[i, j] for i in range(2)) + net.b1[j]) for j in range(3)]
        assert net.scores(x[None])[0] == pytest.approx(1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, net.w2)) + 0.3) / 1.7)))


def test_labels_to_the_driver_are_bounded(spark, monkeypatch):
    """One id with a third of all labels and many texts, at a sample below the number of labels: the fit sees at most `sample` rows."""
    docs = spark.createDataFrame([(i % 40 if i < 60 else 7, f"word {i} text", i) for i in range(120)], "doc_id long, text string, n int")
    labels = spark.createDataFrame([(7, 1)] * 50 + [(7, 0)] * 9 + [(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append(len(x)))
    vectors = np.ones((quality.BUCKETS, 4), np.float32)
    quality.fit_quality(docs, labels, vectors, sample=10)
    quality.fit_quality(docs, labels, vectors, sample=1000)
    ids = [r["doc_id"] for r in labels.select("doc_id").distinct().where(~quality.held_out(labels.doc_id)).collect()]
    assert seen == [10, len(ids) + (7 in ids)]


def spans_by_hand(text):
    """Verified notice spans (label, first, coverage) of one text, from their definition."""
    w, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()), []
    k = licenses.LONG
    for label, notice in licenses.NOTICES.items():
        n = re.findall(r"[0-9a-z]+", notice.lower())
        lines = {}
        for p in range(len(w) - k + 1):
            for q in range(len(n) - k + 1):
                if w[p : p + k] == n[q : q + k]:
                    lines.setdefault(p - q, []).append((p, q))
        chains = []
        for d in sorted(lines):
            here = lines[d]
            if chains:
                was, before = chains[-1][-1]
                ahead = all(p - x >= k and q - y >= k for p, q in here for x, y in before)
                behind = all(x - p >= k and y - q >= k for p, q in here for x, y in before)
                if d - was <= licenses.NEAR and (ahead or behind):
                    chains[-1].append((d, here))
                    continue
            chains.append([(d, here)])
        for chain in chains:
            hits = [x for _, line in chain for x in line]
            coverage = len({q for _, q in hits}) / (len(n) - k + 1)
            if coverage >= licenses.LEAST:
                out.append((label, min(p for p, _ in hits), coverage))
    return sorted(out)


def test_repeated_notices_keep_label_and_score(spark):
    near, texts = "Released under the MIT Licence. ", []
    for n in range(1, 11):
        texts += [near * n, "Released under the MIT License. " * n, near * n + "Released under the MIT License. " * n, "Licensed under the Apache License, version three; " * n]
    rng = random.Random(2)
    for notice in licenses.NOTICES.values():
        for _ in range(6):
            w = notice.split() * rng.randint(1, 3)
            for _ in range(rng.randint(0, 6)):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 3)] = ["other"] * rng.randint(0, 4)
            texts.append(" ".join(["intro"] * rng.randint(0, 3) + w))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in licenses.license_spans(rows).where("label is not null and not base").collect():
        got.setdefault(r["doc_id"], []).append((r["label"], r["first"], r["coverage"]))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == spans_by_hand(text), text
    score = {r["doc_id"]: (r["score"], r["labels"]) for r in licenses.license_summary(rows).collect()}
    for n in range(10):
        assert score[4 * n] == (0.5, "mit-line") and len(got[4 * n]) == n + 1
        assert score[4 * n + 1] == (1.0, "mit,mit-line") and len(got[4 * n + 1]) == n + 1
