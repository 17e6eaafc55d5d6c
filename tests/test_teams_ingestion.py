import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.functions.text import lcg_shuffle
from tessera.operators import graph as G
from tessera.operators import ingestion, teams, tuning
from tessera.operators import vector_search as VS
from tessera.operators.retrieval import rerank_with

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)


def test_team_edges(spark):
    chunks = spark.createDataFrame(
        [("s", None, "L1", [0, 1], at(0), at(50)), ("s", None, "L2", [2], at(60), at(300)), ("s", "ann", "A1", [0], at(20), at(40)), ("s", "ann", "A2", [1], at(100), at(110)), ("s", "bob", "B1", [0], at(105), at(400)), ("s", "eve", "E1", None, None, None)],
        "session string, agent string, id string, turn_indices array<int>, start timestamp, end timestamp",
    )
    use = lambda agent, turn, tool, second, **x: ("s", agent, turn, tool, json.dumps(x), at(second))
    uses = spark.createDataFrame(
        [
            use(None, 1, "Task", 10, team_name="t", name="ann"), use(None, 1, "Task", 11, team_name="t", name="nobody"), use(None, 1, "Task", 12, name="ann"), use("ann", 1, "Task", 13, team_name="t", name="bob"),
            use("ann", 1, "SendMessage", 104, recipient="bob"), use("ann", 1, "SendMessage", 305, recipient="team-lead"), use("ann", 9, "SendMessage", 104, recipient="bob"), use("bob", 0, "SendMessage", 900, recipient="ann"),
        ],
        "session string, agent string, turn int, name string, input string, at timestamp",
    )
    got = {(r.src, r.dst, r.reference_type, r.weight) for r in teams.team_edges(uses, chunks).collect()}
    assert got == {("L1", "A1", "team-spawn", 0.9), ("A2", "B1", "peer-message", 0.85), ("A2", "L2", "team-report", 0.9)}
    assert teams.team_edges(uses.limit(0), chunks).count() == 0
    first = {(r.agent, r.src, r.dst) for r in teams.first_contacts(chunks).collect()}
    assert first == {("ann", "L1", "A1"), ("bob", "L2", "B1")}


def test_agent_edges(spark):
    lines = spark.createDataFrame([("m1", None, "s", None, 1), ("a1", "m1", "s", "x", 2), ("a2", "a1", "s", "x", 3), ("m2", "m1", "s", None, 4), ("m3", "m2", "s", None, 5)], "uuid string, parent string, session string, agent string, at long")
    of = spark.createDataFrame([("m1", "c1"), ("a1", "c2"), ("a2", "c3"), ("m2", "c4"), ("m3", "c5")], "uuid string, chunk string")
    assert {tuple(r) for r in teams.agent_edges(lines, of).collect()} == {("c1", "c2", "brief"), ("c3", "c4", "debrief")}


MESSAGES = "session string, uuid string, type string, content string, at long, slug string"


def test_increments_append_late_turns_only(spark, tmp_path):
    first = [("s", "u1", "user", "one", 1, "p"), ("s", "u2", "assistant", "two", 2, "p"), ("t", "v1", "user", "x", 1, "p"), (None, "w", "user", "y", 1, "p"), ("s", None, "user", "z", 1, "p")]
    none = spark.createDataFrame([], ingestion.CHECKPOINT)
    a = ingestion.ingest_increment(spark.createDataFrame(first, MESSAGES), none)
    assert {(r.session_id, tuple(r.turn_indices)) for r in a.tables["chunks"].collect()} == {("s", (0,)), ("t", (0,))}
    assert {r.reason for r in a.rejected.collect()} == {"no session", "no uuid"}
    again = ingestion.ingest_increment(spark.createDataFrame(first, MESSAGES), a.checkpoint)
    assert again.tables["chunks"].count() == 0 and sorted(map(tuple, again.checkpoint.collect())) == sorted(map(tuple, a.checkpoint.collect()))
    more = [*first, ("s", "u3", "user", "three", 9, "p"), ("s", "u4", "assistant", "four", 10, "p")]
    b = ingestion.ingest_increment(spark.createDataFrame(more, MESSAGES), a.checkpoint)
    assert [(r.session_id, r.turn_indices) for r in b.tables["chunks"].collect()] == [("s", [1])]
    assert {r.session: (r.last_turn, r.last_at) for r in b.checkpoint.collect()} == {"s": (1, 10), "t": (0, 1)}


def test_batches_keep_errors_apart(spark):
    kept = {}
    ok = lambda s: (lambda: spark.createDataFrame([(s, s + "1", "user", "hello", 1, "p")], MESSAGES))
    bad = lambda: 1 / 0
    sink = lambda n, t: kept.update({n: t["chunks"].count()})
    _, said = ingestion.ingest_batches([("a", ok("s")), ("b", bad), ("c", ok("t")), ("d", ok("u"))], spark.createDataFrame([], ingestion.CHECKPOINT), sink, done={"d"})
    assert said["a"] == said["c"] == "ok" and said["b"].startswith("ZeroDivisionError") and said["d"] == "skipped" and kept == {"a": 1, "c": 1}


def test_reembedding_goes_on(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"word{i} text") for i in range(30)], "id string, text string")
    path = str(tmp_path / "e")
    made = ingestion.reembed(spark, docs, path, "m", VS.embed_by_hashing, 4)
    assert made == [0, 1, 2, 3] and ingestion.reembed(spark, docs, path, "m", VS.embed_by_hashing, 4) == []
    import shutil

    shutil.rmtree(f"{path}/model=m/part=2")
    assert ingestion.reembed(spark, docs, path, "m", VS.embed_by_hashing, 4) == [2]
    assert spark.read.parquet(path).select("id").distinct().count() == 30


def test_tuning_and_deltas(spark):
    f = spark.createDataFrame([(0.4, 0.5, 0.2, 100, 50, 3, 0, 2.0)], "cluster_coverage double, orphan_share double, edges_per_chunk double, n_chunks long, n_edges long, n_clusters long, n_within_chain long, median_session_size double")
    got = [(r.metric, r.priority) for r in tuning.recommendations(f).collect()]
    assert got == [("Cluster coverage", "high"), ("Orphan chunk rate", "high"), ("Cluster coverage (small sessions)", "medium"), ("Within-chain edges", "low"), ("Stale clusters", "low")]
    assert len(tuning.RULES) == 17
    h = spark.createDataFrame([("r1", 1, "orphan_share", 0.3), ("r2", 2, "orphan_share", 0.1), ("r1", 1, "precision_10", 0.5), ("r2", 2, "precision_10", 0.5), ("r2", 2, "other", 1.0)], "run string, at int, metric string, value double")
    d = {(r.run, r.metric): (r.delta, r.improved) for r in tuning.deltas(h).collect()}
    assert d[("r1", "orphan_share")] == (None, None) and round(d[("r2", "orphan_share")][0], 6) == -0.2 and d[("r2", "orphan_share")][1] is True
    assert d[("r2", "precision_10")] == (0.0, False) and d[("r2", "other")] == (None, None)


def walk(spark, edges, tokens=None, seeds=("a",), agents=None, scores=None, **kw):
    names = sorted({x for e in edges for x in e} | set(seeds))
    nodes = [(n, (tokens or {}).get(n, 10), (agents or {}).get(n), float((scores or {}).get(n, 0))) for n in names if n != "gone"]
    e = spark.createDataFrame(edges, "src string, dst string")
    n = spark.createDataFrame(nodes, "id string, tokens int, agent string, score double")
    s = spark.createDataFrame([(x,) for x in seeds], "id string")
    return sorted((r.seed, r.place, "".join(r.path), r.tokens, r.median) for r in G.walk_chains(e, n, s, kw.pop("budget", 1000), **kw).collect())


def test_chain_walks(spark):
    line = [("a", "b"), ("b", "c"), ("c", "d")]
    assert walk(spark, line) == [("a", 0, "abcd", 40, 0.0)]
    assert walk(spark, line, depth=2) == [("a", 0, "ab", 20, 0.0)]
    assert walk(spark, [*line, ("d", "a")]) == [("a", 0, "abcd", 40, 0.0)]
    assert [w[2] for w in walk(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])] == ["abd", "acd"]
    assert walk(spark, line, {"c": 5000}) == [("a", 0, "abd", 30, 0.0)]  # larger than the budget: passed through
    assert walk(spark, line, budget=25) == [("a", 0, "ab", 20, 0.0)]
    assert walk(spark, line, agents={"a": "x", "b": "y", "c": "x", "d": "x"}, agent="x") == [("a", 0, "acd", 30, 0.0)]
    assert walk(spark, line, agents={"a": "x", "b": "y", "c": "y", "d": "x"}, agent="x", skips=1) == [("a", 0, "a", 10, 0.0)]
    assert walk(spark, [("a", "b"), ("b", "gone")]) == [("a", 0, "ab", 20, 0.0)]
    assert walk(spark, line, seeds=("gone",)) == [] and len(walk(spark, line, seeds=("a", "b"))) == 2
    fan = [("a", f"b{i:02d}") for i in range(15)]
    assert len(walk(spark, fan)) == 10 and len(walk(spark, fan, candidates=3)) == 3 and len(walk(spark, fan, expansions=4)) == 3
    assert walk(spark, line, scores={"a": 0.1, "b": 0.3, "c": 0.8, "d": 0.9})[0][4] == 0.55
    assert walk(spark, line, {"a": 0}) == [("a", 0, "abcd", 130, 0.0)]


def test_small_hooks(spark):
    assert lcg_shuffle(list(range(10)), 42) == lcg_shuffle(list(range(10)), 42) and sorted(lcg_shuffle(list(range(10)), 7)) == list(range(10)) and lcg_shuffle([], 1) == []
    hits = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "id string, score double")
    again = rerank_with(hits, lambda h: h.select("id", (1 - F.col("score")).alias("score")))
    assert [r.id for r in again.orderBy(F.desc("score"), "id").collect()] == ["b", "a"]
    assert {r.id: r.score for r in rerank_with(hits, lambda h: h.filter("id = 'a'").select("id", F.lit(0.1).alias("score"))).collect()} == {"a": 0.1, "b": None}
