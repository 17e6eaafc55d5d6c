import random

import numpy as np

from tessera.llm.leakage import Passages, aligned, leaked_passages, running_hashes, seed_length, tiles
from tessera.llm.words import words


def test_words():
    assert words("<b>Only</b> `Cor​vel` _kept_ 48 index-cards &amp; “memos”\\nnow [x](http://a.b/c)") == ["only", "corvel", "kept", "48", "index", "cards", "memos", "now", "x"]
    assert words(None) == [] and words(" \n") == []


def test_seed_misses_nothing():
    r = random.Random(1)
    assert seed_length() == 6
    for _ in range(300):
        bad = set(r.sample(range(20), 2))
        runs, n = [], 0
        for i in range(20):
            n = 0 if i in bad else n + 1
            runs.append(n)
        assert max(runs) >= 6


def test_tiles_cover_reordered_text():
    p = np.arange(40)
    t = np.concatenate([p[20:], np.full(5, -1), p[:20]])
    got = sorted(tiles(p, t, 6))
    assert got == [(0, 25, 20), (20, 0, 20)]
    assert tiles(p, np.full(30, -1), 6) == [] and tiles(p[:0], t, 6) == []
    assert tiles(np.array([1, 2, 3] * 4), np.array([1, 2, 3] * 2), 3) == [(0, 0, 6)]


def test_running_hashes():
    w = np.array([5, 1, 2, 3, 9, 1, 2, 3, 0])
    h = running_hashes(w, [3, 9, 12])
    assert h[3][1] == h[3][5] and len(set(h[3].tolist())) == 6 and len(h[9]) == 1 and 12 not in h
    assert running_hashes(w[5:8], [3])[3][0] == h[3][1]


def test_the_coverage_decides(spark):
    ws = [f"w{i}" for i in range(34)]
    docs = [(1, " ".join(ws[17:] + ["and"] + ws[:17])), (2, " ".join(["x"] * 9 + ws[3:15] + ["y"] * 9)), (3, " ".join(ws)), (4, " ".join(ws[:8])), (5, "a b c d e f g h")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(ws)), (8, "A b, c d e f g!")], "item_id long, passage string")
    got = {(x.doc_id, x.item_id): (round(x.covered, 3), x.n_tiles, x.best_window) for x in leaked_passages(df, items).collect()}
    assert got == {(1, 7): (1.0, 2, 0), (3, 7): (1.0, 1, 20), (5, 8): (1.0, 1, 0)}


def brute(docs, items):
    out = set()
    for d, t in docs:
        a = words(t)
        for i, p in items:
            b = words(p)
            if any(sum(x == y for x, y in zip(a[k : k + 20], b[j : j + 20])) >= 18 for k in range(len(a) - 19) for j in range(len(b) - 19)):
                out.add((d, i))
    return out


def test_matches_brute_force(spark, monkeypatch):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(15, 45)))) for i in range(12)] + [(99, None), (98, "short one")]
    docs = [(0, None), (1, ""), (2, "nothing here")]
    for d in range(3, 60):
        ws = r.choices(vocabulary, k=r.randint(0, 80))
        if r.random() < 0.8:
            _, p = items[r.randrange(12)]
            part = p.split()[r.randrange(0, 10):][: r.randint(15, 40)]
            for _ in range(r.randint(0, 4)):
                part[r.randrange(len(part))] = "XX"
            ws[5:5] = part
        docs.append((d, " ".join(w.upper() if r.random() < 0.2 else f"<i>{w}</i>," if r.random() < 0.1 else w for w in ws)))
    want = brute(docs, [x for x in items if x[1]])
    assert len(want) > 8
    df = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items + items[:2], "item_id long, passage string")
    first = leaked_passages(df, it).collect()
    assert {(x.doc_id, x.item_id) for x in first if x.best_window >= 18} == want
    assert all(x.best_window >= 18 or x.covered >= 0.75 for x in first)
    monkeypatch.setattr("tessera.llm.leakage.SLICE_WORDS", 40)
    got = leaked_passages(df, it, block_words=50).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, first))
    assert leaked_passages(df, it.limit(0)).count() == 0 and leaked_passages(df.limit(0), it).count() == 0


def test_alignment():
    p = np.arange(30)
    t = p.copy()
    t[[3, 12]] = -1
    assert aligned(p, p, 0, 20, 18) == 20 and aligned(p, t, 0, 20, 18) == 19 and aligned(p, t[:25], 0, 20, 18) == 19 and aligned(p, t[:10], 0, 20, 18) == 0
    assert len(Passages([], 6).code) == 0
