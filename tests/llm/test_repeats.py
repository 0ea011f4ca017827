"""Exact repeats by prefix-free parsing against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import repeats


def removed_by_hand(rows, window):
    """(id, n_bytes, n_removed, n_spans, sha256) of every row, by counting all windows."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(x[k : k + window] for _, x in raw for k in range(len(x) - window + 1))
    out = []
    for i, x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for k in range(len(x) - window + 1):
            if seen[x[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((i, len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def awkward(window):
    rng = np.random.default_rng(window)
    words = ["".join(rng.choice(list("abcdeé \0")) for _ in range(rng.integers(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words, n))
    a, b, passage = prose(200), prose(200), prose(60)
    rows = [(i, prose(int(n))) for i, n in enumerate(rng.integers(0, 90, 40))]
    rows += [(100, a), (101, a), (102, a[:300] + "!" + a[300:]), (103, b[37:]), (104, b + a[90:]), (105, passage + b), (106, prose(30) + passage + prose(30)), (106, prose(30) + passage)]
    rows += [(110 + i, prose(3) + passage[5 * i :]) for i in range(8)]
    rows += [(120, "x" * 3000), (121, "y" * window), (122, "z" * (window + 1)), (123, "ab" * 500), (124, "word " * 400), (125, "q" * (window - 1)), (126, "q" * (window - 1)), (127, "\0" * 900), (128, "ab\0" * 300)]
    blob = bytes(rng.integers(97, 100, 40)).decode()
    rows += [(130, prose(20) + "-" * 150 + blob + "-" * 200), (131, "-" * 150 + blob + "-" * 200 + prose(9)), (132, ""), (133, None), (None, a[50:]), (None, None), (142, a[:500] + prose(5) + b[:500]), (140, "é" * 700), (141, "€" * 700)]
    return rows


@pytest.mark.parametrize("window", [64, 100, 400])
def test_removal_equals_brute_force(spark, window):
    rows = awkward(window)
    table = spark.createDataFrame([(i, t, "x", 1, 2, "y", b"z", 3) for i, t in rows], "doc_id long, text string, same string, n int, t int, part string, key binary, start int").repartition(5)
    found = repeats.remove_repeats(table, window=window)
    got = sorted(map(tuple, found.drop("removed").collect()), key=repr)
    want = removed_by_hand(rows, window)
    assert got == want and sum(w[2] > 0 for w in want) > 15 and sum(w[3] > 1 for w in want) >= 1
    assert all(sum(e - s for s, e in r["removed"]) == r["n_removed"] and len(r["removed"]) == r["n_spans"] for r in found.collect())
    assert repeats.remove_repeats(table.limit(0), window=window).count() == 0


@pytest.mark.parametrize("most", [1, 2])
def test_large_groups_are_narrowed(spark, most):
    """With groups cut as soon as they hold more than a part or two, spans cover the same bytes as with each in one task."""
    rows = awkward(64)
    texts = spark.createDataFrame([(hashlib.md5((t or "").encode()).digest(), t or "") for _, t in rows], "same binary, text string").persist()

    def covered(most):
        spans, _ = repeats.repeat_spans(texts, 64, most)
        return {(bytes(r["same"]), k) for r in spans.collect() for k in range(r["start"], r["end"])}

    whole = covered(repeats.MOST)
    assert len(whole) > 5000 and covered(most) == whole


def test_every_window_has_one_place_that_follows_from_its_bytes():
    rng, window = np.random.default_rng(1), 64
    texts = [bytes(rng.integers(97, 97 + k, n).astype(np.uint8)) for k, n in ((2, 500), (26, 700), (1, 200), (3, 63), (2, 0), (26, 64))]
    texts.append(texts[0][100:300] + texts[1][300:600])
    data, ends = b"".join(texts), np.cumsum([len(x) for x in texts])
    doc, t, lo, hi = repeats.phrase_ends(data, ends, window)
    place, met = {}, Counter()
    for d, at, a, b in zip(doc.tolist(), t.tolist(), lo.tolist(), hi.tolist()):
        for x in range(a, b + 1):
            begin = at - x
            assert ends[d] - len(texts[d]) <= begin and begin + window <= ends[d]
            met[begin] += 1
            assert place.setdefault(data[begin : begin + window], x) == x
    assert set(met.values()) == {1} and len(met) == sum(max(0, len(x) - window + 1) for x in texts)
