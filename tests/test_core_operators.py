"""Small fixtures for the core operators: nulls, ties, repeated rows, empty tables, clashing names."""

import json
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.functions.porter import stem
from tessera.operators import fulltext
from tessera.operators import clustering as C
from tessera.operators.block_search import numbered
from tessera.operators import decay as D
from tessera.operators import evaluation as E
from tessera.operators import graph as G
from tessera.operators import lookups as L
from tessera.operators import maintenance as M
from tessera.operators import repomap as R
from tessera.operators import retrieval
from tessera.operators import transcripts as T
from tessera.operators import vector_search as VS
from tessera.operators.components import connected_components
from tessera.operators.deliveries import first_deliveries
from tessera.operators.fulltext import bm25, bm25_many
from tessera.operators.ranking import rank_within, running_sum
from tessera.operators.references import dangling_references
from tessera.plans import recall
from tessera.functions import deep_json
from tessera.operators.shred import assemble, blocks_of, flatten, shred_blocks, shred_leaves, split_plain, stripe


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_first_deliveries(spark, tmp_path):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", None, "z"), (None, 1, "w"), ("c", 5, None)]
    spark.createDataFrame(rows, "id string, t int, v string").repartition(3).write.parquet(str(tmp_path / "t"))
    got = first_deliveries(spark.read.parquet(str(tmp_path / "t")), F.col("id"), "t").collect()
    assert sorted((r.id, r.t, r.v) for r in got if r.id != "c") == [("a", 1, "y"), ("b", None, "z")] and len(got) == 3
    spark.createDataFrame([], "id string, t int").write.parquet(str(tmp_path / "e"))
    assert first_deliveries(spark.read.parquet(str(tmp_path / "e")), F.col("id"), "t").count() == 0


@pytest.mark.parametrize(
    "content,n",
    [(None, None), ("", None), ("plain", None), ("[]", 0), ("[1, 2]", None), ('{"type":"text"}', 1), ('[{"type":"a"},{"b":1}]', 2), ('"[{\\"type\\":\\"x\\"}]"', 1), ('"words"', None), ('[{"type":', None), ("[Image] hello", None)],
)
def test_blocks_of(content, n):
    got = blocks_of(content)
    assert (None if got is None else len(got)) == n


def test_shredding_is_a_round_trip(spark):
    r = random.Random(4)

    def block(depth):
        b = {"type": r.choice(["text", "tool_result", "tool_use"]), "text": r.choice(["x", None]), "tool_use_id": r.choice(["T1", None])}
        k = r.random()
        b["content"] = [block(depth + 1) for _ in range(r.randrange(4))] if k < 0.5 and depth < 4 else "payload" if k < 0.7 else None
        return b

    def walk(array, path):
        for i, b in enumerate(array or []):
            if isinstance(b, dict):
                p = [*path, str(i)]
                yield ".".join(p), b
                if isinstance(b.get("content"), list):
                    yield from walk(b["content"], p)

    records = [None if r.random() < 0.2 else [block(0) if r.random() < 0.9 else 7 for _ in range(r.randrange(5))] for _ in range(80)]
    got = flatten(records)
    have = {(i, p): (t, x, u) for i, p, t, x, u in zip(got["record"], got["block_path"], got["type"], got["text"], got["tool_use_id"])}
    want = {(i, p): (b["type"], b["text"], b["tool_use_id"]) for i, rec in enumerate(records) for p, b in walk(rec, [])}
    assert have == want and len(got["record"]) == len(want)
    assert all(p.rpartition(".")[0] == (q or "") for p, q in zip(got["block_path"], got["parent_path"]))
    back = assemble(stripe(records), len(records))
    assert back == records
    df = spark.createDataFrame([("m", '[{"type":"tool_result","content":[{"type":"text","text":"y"}]}]', 1), ("n", None, 2), ("o", "text", 3)], "id string, content string, type int")
    assert [(x.message_id, x.block_path) for x in shred_blocks(df, "id", "content").collect()] == [("m", "0"), ("m", "0.0")]


def test_nothing_is_lost_in_shredding(spark):
    texts = ["[note] hello", '[{"type":"image","source":{"url":"u"},"signature":"s"},"bare",{}]', "[]", None, '{"type":', '["a"]']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, content string")
    got = {r.id: (r.plain_text, r.n_blocks) for r in split_plain(df).collect()}
    assert got == {"0": (texts[0], 0), "1": (None, 2), "2": (None, 0), "3": (None, 0), "4": (texts[4], 0), "5": (texts[5], 0)}
    leaves = {(r.block_path, r.leaf_path): (r.value, r.definition) for r in shred_leaves(df, "id", "content").collect()}
    assert leaves == {("0", "type"): ("image", 3), ("0", "source"): ('{"url":"u"}', 3), ("0", "signature"): ("s", 3), ("1", "*"): ("bare", 3)}
    assert {r.block_path: r.extra for r in shred_blocks(df, "id", "content").collect()} == {"0": {"source": '{"url":"u"}', "signature": "s"}, "2": {}}


def test_deep_nesting(spark):
    deep = '{"type":"t","content":"end"}'
    for _ in range(20_000):
        deep = '{"type":"t","content":[' + deep + "]}"
    payload = "[" * 30_000 + "]" * 30_000
    df = spark.createDataFrame([("a", '[{"type":"t","input":' + payload + "}]")], "id string, content string")
    assert shred_blocks(df, "id", "content").first().input == payload
    v = deep_json.loads(deep)
    assert deep_json.dumps(v) == deep
    for _ in range(20_000):
        v = v["content"][0]
    assert v["content"] == "end"
    for bad in ('{"a" 1}', "[1 2]", "[1] x", "[", '{"a":', "nope"):
        with pytest.raises(ValueError):
            deep_json._loads(bad)
    text = ' {"a": [1, -2.5e3, true, null, "x\u00e9"], "b": {}, "c": []} '
    assert deep_json._loads(text) == json.loads(text)


def test_references(spark):
    ref = "table_name string, column_name string, row_key string, parent_table string, ref_key string, ref_time timestamp"
    t = lambda s: __import__("datetime").datetime.fromisoformat(s)
    refs = spark.createDataFrame([("e", "c", f"r{i}", "p", k, t("2024-03-02")) for i, k in enumerate(["a", "b", "x", "y", None])] + [("e", "c", "r0", "p", "a", t("2024-05-01")), ("e", "c", "r9", "p", "a", None)], ref)
    rows = spark.createDataFrame([("p", "a", t("2024-03-05")), ("p", "a", t("2024-04-05")), ("p", "b", t("2024-01-01")), ("p", "b", None)], "parent_table string, ref_key string, row_time timestamp")
    gone = spark.createDataFrame([("p", "x"), ("p", "a"), ("q", "y")], "parent_table string, ref_key string")
    got = {(r.row_key, r.ref_key): (r.status, r.period) for r in dangling_references([refs], [rows], gone).collect()}
    assert got == {("r0", "a"): ("late", "2024-03"), ("r2", "x"): ("deleted", "2024-03"), ("r3", "y"): ("missing", "2024-03")}
    assert dangling_references([refs.limit(0)], [rows], gone).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500, 500), (None, 3)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 90)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: root(k) for k in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ranks_and_running_sums(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(40), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = rank_within(df, ["g"], ["v", "i"]).collect()
    for g in ("a", "b", None):
        mine = sorted((x.v, x.i) for x in got if x.g == g)
        assert [(x.v, x.i) for x in sorted((x for x in got if x.g == g), key=lambda x: x.rank)] == mine and {x.rank for x in got if x.g == g} == set(range(len(mine)))
    s = sorted(running_sum(df.groupBy("v").agg(F.count("*").alias("n")), ["v"], "n", "before").collect(), key=lambda x: x.v)
    total = 0
    for x in s:
        assert x.before == total
        total += x.n
    assert rank_within(df.limit(0), ["g"], ["v"]).count() == 0


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple apple fig"), (3, None), (4, ""), (5, "Pear APPLE")], "id int, text string")
    got = {r.id: r.score for r in bm25(docs, ["Apple", "pear"]).collect()}
    assert set(got) == {1, 5} and got[1] == pytest.approx(got[5])
    assert bm25(docs, []).count() == 0 and bm25(docs.limit(0), ["x"]).count() == 0
    q = spark.createDataFrame([("a", "apple"), ("a", "pear"), ("b", "fig"), ("b", "none")], "qid string, term string")
    many = {(r.qid, r.id): r.score for r in bm25_many(docs, q).collect()}
    assert set(many) == {("a", 1), ("a", 5)} and many["a", 1] == pytest.approx(got[1])


def test_stemmer():
    pairs = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit triplicate:triplic hopeful:hope goodness:good revival:reviv adjustment:adjust adoption:adopt controll:control roll:roll probate:probat rate:rate"
    for p in pairs.split():
        w, s = p.split(":")
        assert stem(w) == s, w


def test_vector_expressions(spark):
    a, b = F.col("a"), F.col("b")
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])]
    assert one(spark, F.round(V.angular(a, b), 6), rows, "a array<double>, b array<double>") == [0.5, 0.0, 1.0, 0.5]
    assert one(spark, V.cosine(a, b), rows[3:], "a array<double>, b array<double>") == [0.0]
    bad = [([1.0, None],), ([float("nan"), 1.0],), ([0.0, 0.0],), (None,), ([1.0],), ([1.0, 2.0],)]
    assert one(spark, V.is_usable("a", 2), bad, "a array<double>") == [False, False, False, False, False, True]


def test_knn_join_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(VS, "QUERY_BLOCK", 3)
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(5)
    got = VS.knn_join(df.filter("id < 8"), df, 4, "euclidean").collect()
    for i in range(8):
        d = np.round(np.linalg.norm(x - x[i], axis=1), 6)
        d[i] = np.inf
        assert [g.id for g in sorted((g for g in got if g.qid == i), key=lambda g: g.rank)] == np.lexsort((np.arange(60), d))[:4].tolist()
    assert VS.knn_join(df.limit(0), df, 3).count() == 0


@pytest.mark.parametrize("text,shift,cont", [("Actually, let's stop", True, False), ("  btw, hello", True, False), ("yes please", False, True), ("It works", False, True), ("plain words", False, False), ("", False, False)])
def test_markers(spark, text, shift, cont):
    assert spark.createDataFrame([(text,)], "t string").select(X.has_topic_shift(F.col("t")), X.has_continuation(F.col("t"))).first()[:] == (shift, cont)


def test_entities_and_paths(spark):
    t = "@ann and Bob Smith said hi in #ops, not #fff; with The. mail a.b@c.org https://x.y/z standup. src/a/b.ts and ./c/d"
    got = spark.createDataFrame([(t,)], "t string").select(X.entities(F.col("t")), X.paths(F.col("t"))).first()
    assert {(e.entity_type, e.name) for e in got[0]} == {("person", "ann"), ("person", "bob smith"), ("channel", "ops"), ("person", "a.b@c.org"), ("person", "c.org"), ("url", "https://x.y/z"), ("meeting", "standup")}
    assert {"src/a/b.ts", "c/d"} <= set(got[1])


def test_relevant_text(spark):
    t = "[User]\nhello\n\n[Thinking]\n@secret\n\n[Assistant]\nbye ```@code``` end"
    got = spark.createDataFrame([(t,)], "t string").select(X.relevant_text(F.col("t"))).first()[0]
    assert "hello" in got and "bye" in got and "secret" not in got and "code" not in got


def test_fusion_and_expansion(spark):
    lists = spark.createDataFrame([("a", 1, "vector", 1.0), ("b", 2, "vector", 1.0), ("b", 1, "keyword", 2.0)], "id string, rank int, source string, weight double")
    got = {r.id: (round(r.score, 9), r.source) for r in retrieval.fuse(lists).collect()}
    assert got == {"a": (round(1 / 61, 9), "vector"), "b": (round(1 / 62 + 2 / 61, 9), "keyword")}
    hits = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "id string, score double")
    assigned = spark.createDataFrame([("a", "k1", 0.1), ("b", "k2", 0.0), ("c", "k1", 0.2), ("d", "k2", None), ("e", "k2", 0.4), ("gone", "k1", 0.0)], "chunk_id string, cluster_id string, distance double")
    chunks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "id string")
    out = {r.id: round(r.score, 6) for r in retrieval.expand_clusters(hits, assigned, chunks).collect()}
    assert out == {"c": 0.8, "e": 0.3}


def test_mmr():
    r = np.random.default_rng(3)
    scores, v = np.sort(r.random(14))[::-1], [x for x in r.normal(size=(14, 4))]
    tokens = np.full(14, 100)
    assert retrieval.mmr_order(scores, v, tokens, lam=1.0) == list(range(14))
    v[1] = v[0]
    assert retrieval.mmr_order(scores, v, tokens, lam=0.3).index(1) > 1
    assert len(retrieval.mmr_order(scores, v, tokens, budget=450)) == 4
    assert retrieval.mmr_order(scores[:5], v[:5], tokens[:5]) == list(range(5)) and retrieval.mmr_order(scores[:0], [], tokens[:0]) == []


def test_skip_packing(spark):
    assert one(spark, retrieval.fits(F.col("t"), 10), [([4, 8, 5, 2, 1],), ([],)], "t array<int>") == [[True, False, True, False, True], []]


def test_graph_operators(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "y")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "id string")
    assert sorted(tuple(r.path) for r in G.walk_paths(e, s, 10).collect()) == [("a", "b", "c"), ("a", "b", "d")]
    assert sorted(tuple(r.path) for r in G.walk_paths(e, s, 1).collect()) == [("a", "b")]
    n = spark.createDataFrame([("a", 5), ("b", 5), ("c", 50), ("d", 1)], "id string, tokens int")
    assert sorted(tuple(r.path) for r in G.walk_paths(e, s, 10, n, 20).collect()) == [("a", "b", "d")]
    assert {r.id: r.hop for r in G.neighbourhood(e, s, 1).collect()} == {"a": 0, "b": 1, "c": 1}
    assert G.first_walk(e, s, 9).first().path == ["a", "b", "c"]
    assert G.walk_paths(e, s.limit(0), 3).count() == 0
    sc = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("d", 0.9)], "id string, score double")
    assert G.best_paths(G.walk_paths(e, s, 10), sc).first().path == ["a", "b", "d"]


def test_causal_edges(spark):
    t = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    rows = [("c1", [0], 0, 1, "[User]\nhi"), ("c2", [0, 1], 2, 3, "x"), ("c3", [2], 10, 11, "[User]\nbtw new"), ("c4", [3], 60, 61, "[User]\nok"), ("c5", [4, None], 62, 63, None), ("c6", None, 64, 65, "")]
    df = spark.createDataFrame([("s", i, turns, t(a), t(b), c) for i, turns, a, b, c in rows], "session_id string, id string, turn_indices array<int>, start_time string, end_time string, content string")
    df = df.withColumn("start_time", F.to_timestamp("start_time")).withColumn("end_time", F.to_timestamp("end_time"))
    assert {(r.src, r.dst) for r in G.causal_edges(df).collect()} == {("c1", "c2"), ("c4", "c5")}


def test_greedy_packing(spark):
    r = random.Random(2)
    rows = []
    for s in range(5):
        for t in range(r.randrange(1, 60)):
            rows.append((f"s{s}", t, "\n\n".join("x" * r.choice([1, 5, 30, 90]) for _ in range(r.choice([1, 1, 1, 8])))))
    rows += [("long", 0, "\n\n".join(f"[User]\nword {i} " + "y" * 90 for i in range(30))), ("none", 0, None)]
    want = []
    for s in sorted({x[0] for x in rows}):
        held, out = None, []
        for _, t, text in sorted(x for x in rows if x[0] == s and x[2] is not None):
            if T.tokens(text) > 40:
                out += ([held] if held else []) + [([t], p) for p in T.split_text(text, 40)]
                held = None
            elif held and T.tokens(held[1] + "\n\n" + text) <= 40:
                held = ([*held[0], t], held[1] + "\n\n" + text)
            else:
                out += [held] if held else []
                held = ([t], text)
        out += [held] if held else []
        want += [(s, i, turns, text) for i, (turns, text) in enumerate(out)]
    df = spark.createDataFrame(rows, "session string, turn int, text string").repartition(5)
    got = sorted((x.session, x.piece, x.turn_indices, x.text) for x in T.chunk_turns(df, 40).collect())
    assert got == want and any(len(w[2]) > 3 for w in want)
    assert T.chunk_turns(df.limit(0)).count() == 0


def test_hdbscan_shapes(spark):
    r = np.random.default_rng(42)
    blobs = np.concatenate([r.normal(c, 0.7, size=(50, 3)) for c in ([10, 0, 0], [-10, 0, 0], [0, 10, 0])])
    points = np.concatenate([blobs, blobs[:10]])
    df = spark.createDataFrame([(int(i), b.tolist()) for i, b in enumerate(points)], "id long, embedding array<double>")
    for block in (10_000, 37):
        rows = {x.id: x for x in C.hdbscan(df, 5, block=block).collect()}
        labels = np.array([rows[i].label for i in range(len(points))])
        assert labels.max() == 2 and (labels < 0).mean() < 0.3
        assert all(len(set(labels[i : i + 50]) - {-1}) == 1 for i in (0, 50, 100)) and (labels[:10] == labels[150:]).all()
        assert all((x.label < 0) == (x.distance is None) and 0 <= x.probability <= 1 and 0 <= x.outlier <= 1 for x in rows.values())
        assert all(x.outlier == 1 and x.probability == 0 for x in rows.values() if x.label < 0)
    fine = [x.label for x in C.hdbscan(df, 5, leaves=True).collect()]
    assert max(fine) >= 2
    assert C.hdbscan(df.limit(0)).count() == 0
    assert [x.label for x in C.hdbscan(df.limit(1)).collect()] == [-1]


def test_spanning_tree_equals_prim(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(60, 4)), r.normal(size=(60, 4)) + 30, r.normal(size=(3, 4)) + 90])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, 4]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    best, total, inside = np.full(len(x), np.inf), 0.0, np.zeros(len(x), bool)
    at = 0
    for _ in range(len(x) - 1):
        inside[at] = True
        best = np.minimum(best, reach[at])
        at = int(np.where(inside, np.inf, best).argmin())
        total += best[at]
    points = numbered(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>"))
    tree, got = C.spanning_links(points, len(x), 4, block=50)
    rows = tree.collect()
    assert len(rows) == len(x) - 1 and np.isclose(sum(t.weight for t in rows), total)
    assert np.allclose([c.core for c in got.orderBy("num").collect()], core)


def test_assignment_and_models(spark, tmp_path):
    r = np.random.default_rng(5)
    blobs = np.concatenate([r.normal(c, 0.5, size=(30, 3)) for c in ([9, 0, 0], [-9, 0, 0])])
    df = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(blobs)], "id int, embedding array<double>")
    labels = C.hdbscan(df)
    model = C.cluster_model(df, labels)
    C.save_model(model, str(tmp_path / "m"), 60)
    back, n = C.load_model(spark, str(tmp_path / "m"))
    new = spark.createDataFrame([(100, [9.0, 0.1, 0.0]), (101, [-9.0, 0.0, 0.2]), (102, [0.0, 50.0, 0.0])], "id int, embedding array<double>")
    own = {x.id: x.label for x in labels.collect()}
    got = {x.id: x.label for x in C.assign(new, back).collect()}
    assert n == 60 and got[100] in {own[i] for i in range(30)} - {-1} and got[101] in {own[i] for i in range(30, 60)} - {-1} and got[102] == -1
    assert C.needs_refit(40, 20) and not C.needs_refit(40, 5) and C.needs_refit(0, 1)
    assert C.update(new, back, 60)[1] is False and C.update(df, back, 60)[1] is True
    assert {x.label for x in C.assign(new, model.limit(0)).collect()} == {-1}


def test_metrics(spark):
    s = spark.createDataFrame([(float(i), i >= 5) for i in range(10)] + [(None, True), (3.0, None)], "score double, positive boolean")
    assert E.roc_auc(s, "score", "positive").first().auc == 1.0
    y = E.youden(s, "score", "positive").first()
    assert (y.threshold, y.j, y.f1) == (5.0, 1.0, 1.0)
    flat = spark.createDataFrame([(1.0, True), (1.0, False)], "score double, positive boolean")
    assert E.roc_auc(flat, "score", "positive").first().auc == 0.5
    assert E.roc_auc(flat.filter("positive"), "score", "positive").first().auc is None
    p = spark.createDataFrame([(i, [float(i // 5 * 10 + i % 5 * 0.1), 1.0], i // 5) for i in range(10)], "id long, embedding array<double>, label int")
    assert all(r.silhouette > 0.8 for r in E.silhouette(p.filter("id in (0, 7)"), p, "euclidean").collect())
    assert all(r.silhouette == 0 for r in E.silhouette(p.filter("id = 0"), p.filter("label = 0"), "euclidean").collect())


def test_decay(spark):
    c = {(r.model, r.hops): r.weight for r in D.curves(spark, 60).collect()}
    assert c["linear-simple", 20] == 0 and c["delayed-linear", 3] == 1.0 and c["exponential", 5] == pytest.approx(0.9) and c["power-law", 5] == pytest.approx(0.9)
    assert D.death("linear-simple") == 20 and D.death("multi-linear-default") == 50 and D.death("power-law") is None
    assert all(c[m, h] >= c[m, h + 1] for m in D.MODELS for h in range(60))


def test_repo_map(spark):
    files = spark.createDataFrame([("a", "scala", "class Foo\n// class Bar\ndef run"), ("b", "scala", "import x.Foo\nobject Foo"), ("c", "lua", "")], "file string, language string, source string")
    t = R.tags(files)
    assert {(x.file, x.name, x.kind, x.line) for x in t.collect()} == {("a", "Foo", "def", 1), ("a", "run", "def", 3), ("b", "Foo", "ref", 1), ("b", "Foo", "def", 2)}
    assert [(x.src, x.dst) for x in R.file_edges(t).collect()] == [("b", "a")]


def test_upserts_and_retention(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, v int, t string")
    new = spark.createDataFrame([("a", 1, "z"), ("c", 1, "w"), ("c", 1, "w")], "id string, v int, t string")
    assert {(r.id, r.t) for r in L.upsert(old, new, ["id"], "v").collect()} == {("a", "z"), ("b", "y"), ("c", "w")}
    assert [r.id for r in L.insert_missing(old, new, ["id"]).collect()] == ["c"]
    one_to_one = L.one_to_one(spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.1)], "l string, r string, s double"), "l", "r", "s")
    assert {(r.l, r.r) for r in one_to_one.collect()} == {("a", "x"), ("b", "y")}
    assert M.beyond_cap(old, "v", 1).count() == 1 and M.beyond_cap(old, "v", 0).count() == 0
    ran = M.run_due([M.Task("ok", 1, lambda: 1), M.Task("bad", 1, lambda: 1 / 0), M.Task("later", 5, lambda: 2)], {"later": 1.0})
    assert ran["ok"] == 1 and isinstance(ran["bad"], ZeroDivisionError) and "later" not in ran


def test_nearest_in_time(spark):
    e = spark.createDataFrame([("k", 1, "2024-01-01 00:00:10"), ("k", 2, "2024-01-01 01:00:00"), ("j", 3, "2024-01-01 00:00:10")], "u string, event_id int, at string").withColumn("at", F.to_timestamp("at"))
    t = spark.createDataFrame([("k", 7, "2024-01-01 00:00:05"), ("k", 8, "2024-01-01 00:00:15"), ("k", 9, "2024-01-01 00:00:21")], "u string, target_id int, at string").withColumn("at", F.to_timestamp("at"))
    assert [(r.event_id, r.target_id, r.away_ms) for r in L.nearest_in_time(e, t, ["u"], 10).collect()] == [(1, 7, 5000)]


def test_stored_index_equals_a_scan(spark, tmp_path):
    r = random.Random(9)
    docs = [(f"d{i:02d}", " ".join(r.choices(["plan", "Compare", "the", "router", "x"], k=r.randrange(0, 12))) if r.random() < 0.9 else None) for i in range(60)]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(docs, "id string, text string").write.parquet(path)
    get = lambda: fulltext.Index.stored(spark, "test", path, lambda: spark.read.parquet(path))
    t = spark.read.parquet(path)
    for terms in (["plan"], ["PLAN", "compare", "plan"], ["none"], []):
        want = {x.id: round(x.score, 9) for x in fulltext.bm25(t, terms).collect()}
        assert {x.id: round(x.score, 9) for x in get().search({"q": terms}).collect()} == want
    both = get().search({"a": ["plan"], "b": ["plan", "router"], "c": []}).collect()
    assert {x.qid for x in both} == {"a", "b"}
    spark.createDataFrame([("new", "plan")], "id string, text string").write.mode("append").parquet(path)
    assert "new" in {x.id for x in get().search({"q": ["plan"]}).collect()}  # a changed table is indexed anew
    spark.createDataFrame([], "id string, text string").write.mode("overwrite").parquet(path)
    assert get().search({"q": ["plan"]}).count() == 0


def test_heuristic_description_of_many_lines(spark):
    r = random.Random(8)
    line = lambda: r.choice(["----", "```python", "Tool: Read", "", "  ", "x" * r.randrange(1, 90), " some words " * r.randrange(1, 9), "é" * 20])
    texts = [None, "", "\n---\n", "y" * 900, *["\n".join(line() for _ in range(n)) for n in (1, 3, 9, 20, 1000)]]

    def want(t):
        if t is None:
            return None
        kept, total = [], 0
        for x in (x.strip() for x in t.split("\n")):
            if x == "" or x.startswith(("```", "Tool:")) or (len(x) > 2 and not x.strip("-=_*")):
                continue
            total += -(-len(x) * 2 // 7)
            if not kept or total <= 130:
                kept.append(x)
        return " ".join(kept)[:650]

    began = time.monotonic()
    assert one(spark, X.heuristic_description(F.col("t")), [(t,) for t in texts], "t string") == [want(t) for t in texts]
    assert time.monotonic() - began < 20  # the lines are gone through once


def test_backfill_of_chunks_with_many_lines(spark, tmp_path):
    kinds = "id string, session_id string, session_slug string, turn_indices array<int>, start_time timestamp, end_time timestamp, content string, code_block_count int, tool_use_count int, approx_tokens int, created_at timestamp, agent_id string, spawn_depth int, project_path string, team_name string"
    text = "\n".join(f"line {i}" for i in range(600))
    rows = [(i, None, "p", None, None, None, text, 0, 0, 0, None, None, 0, None, None) for i in ("a", "B ", "c")]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([("c", "k", 0.1, None)], "chunk_id string, cluster_id string, distance double, assigned_at timestamp").write.parquet(str(tmp_path / "chunk_clusters.parquet"))
    began = time.monotonic()
    got = {r.id: r.description for r in recall.backfill_entries(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"} and all(t.startswith("line 0 line 1 ") and len(t) < 650 for t in got.values())
    assert time.monotonic() - began < 20


def test_heuristic_description_of_long_texts(spark, tmp_path):
    def want(t):
        kept, total = [], 0
        for x in (x.strip() for x in t.split("\n")):
            if x and not x.startswith(("```", "Tool:")) and (len(x) < 3 or x.strip("-=_*")):
                total += -(-len(x) * 2 // 7)
                kept += [x] if not kept or total <= 130 else []
        return " ".join(kept)[:650]

    heads = ["", "-----\n" * 2000, "y" * 6000 + "\n", "y" * 5199 + "\n", "y" * 5200, "a\n" * 129, "a\n" * 130, " \n" * 2599 + "a\n"]
    texts = [h + body for h in heads for body in ("\n", "some words\n" * 700, "é" * 455 + "\nz\n" + "=\n" * 5000, "Tool: x\n" * 900 + "end")]
    assert one(spark, X.heuristic_description(F.col("t")), [(t,) for t in texts], "t string") == [want(t) for t in texts]

    t = F.concat(F.col("id").cast("string"), F.repeat(F.lit("\nsome words of a line"), 16_000))
    spark.range(0, 200, 1, 2).select(t.alias("t")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))

    def took(x):
        began = time.monotonic()
        assert rows.agg(F.max(x)).collect()[0][0]
        return time.monotonic() - began

    lines = F.size(F.transform(F.split("t", "\n"), X.trimmed))
    known, description = min(took(lines) for _ in range(2)), X.heuristic_description(F.col("t"))
    assert min(took(description) for _ in range(3)) < known / 2  # not all lines are gone through


def test_backfill_takes_the_newest(spark, tmp_path):
    kinds = "id string, session_id string, session_slug string, turn_indices array<int>, start_time timestamp, end_time timestamp, content string, code_block_count int, tool_use_count int, approx_tokens int, created_at timestamp, agent_id string, spawn_depth int, project_path string, team_name string"
    at = lambda i: datetime(2026, 1, 1) + timedelta(minutes=i // 2) if i % 7 else None
    rows = [(f"C{i:04d} ", None, "p", None, None, None, f"text {i}", 0, 0, 0, at(i), None, 0, None, None) for i in range(900)]
    spark.createDataFrame(rows + rows[:90], kinds).repartition(5).write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(f"c{i:04d}", "k", 0.1, None) for i in range(0, 900, 3)], "chunk_id string, cluster_id string, distance double, assigned_at timestamp").write.parquet(str(tmp_path / "chunk_clusters.parquet"))
    rest = sorted((i for i in range(900) if i % 3), key=lambda i: (at(i) is None, -(i // 2), i) if at(i) else (True, 0, i))
    got = [(r.id, r.description) for r in recall.backfill_entries(spark, str(tmp_path)).collect()]
    assert got == [(f"c{i:04d}", f"text {i}") for i in rest[:500]] and len(rest) == 600
