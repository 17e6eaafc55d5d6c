import random

import pytest

from tessera.operators import forest
from tessera.operators.forest import resolve_forest


def brute(parents):
    out = {}
    for k in parents:
        seen, x = [], k
        while x in parents and x not in seen:
            seen.append(x)
            x = parents[x]
        if x in seen:
            ring = seen[seen.index(x):]
            out[k] = (min(ring), -1 if k in ring else -2)
        else:
            out[k] = (seen[-1], len(seen) - 1)
    return out


def forest_rows(n, seed):
    r = random.Random(seed)
    names = [f"n{i:04d}" for i in range(n)]
    r.shuffle(names)
    parents = {}
    for i, k in enumerate(names):
        u = r.random()
        parents[k] = None if u < 0.05 else "gone" if u < 0.08 else names[max(0, i - 1 - int(r.expovariate(0.5)))] if u < 0.98 else r.choice(names)
    return parents


@pytest.mark.parametrize("seed,buckets,bound", [(1, 1, 200000), (2, 7, 200000), (3, 40, 200000), (4, 60, 12)])
def test_matches_brute_force(spark, monkeypatch, seed, buckets, bound):
    monkeypatch.setattr(forest, "NODES_PER_TASK", bound)
    parents = forest_rows(400, seed)
    r = random.Random(seed)
    rows = [(k, p, r.randrange(buckets)) for k, p in parents.items()]
    df = spark.createDataFrame(rows, "key string, parent string, bucket long")
    got = {x.key: x for x in resolve_forest(df, with_path=True).collect()}
    want = brute(parents)
    assert {k: (x.root, x.depth) for k, x in got.items()} == want
    for k, x in got.items():
        if x.depth >= 0:
            assert x.path[0] == x.root and x.path[-1] == k and len(x.path) == x.depth + 1
            assert all(parents[b] == a for a, b in zip(x.path, x.path[1:]))
            assert x.dangling == (parents[x.root] == "gone")
        else:
            assert x.path == [k]


def test_empty_and_self_parent(spark):
    s = "key string, parent string, bucket long"
    assert resolve_forest(spark.createDataFrame([], s)).collect() == []
    got = resolve_forest(spark.createDataFrame([("a", "a", 1), ("b", "a", 2)], s)).collect()
    assert {(x.key, x.root, x.depth) for x in got} == {("a", "a", -1), ("b", "a", -2)}


def test_cycle_across_partitions_with_smaller_keys_below(spark, monkeypatch):
    monkeypatch.setattr(forest, "NODES_PER_TASK", 3)
    parents = {f"m{i:02d}": f"m{(i + 1) % 20:02d}" for i in range(20)}
    parents |= {f"a{i:02d}": f"a{i + 1:02d}" for i in range(19)} | {"a19": "m05", "z1": "a00", "r": None, "c1": "r", "c2": "c1"}
    rows = [(k, p, i) for i, (k, p) in enumerate(parents.items())]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put all rows into one partition
    try:
        got = {x.key: (x.root, x.depth) for x in resolve_forest(spark.createDataFrame(rows, "key string, parent string, bucket long")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == brute(parents)
