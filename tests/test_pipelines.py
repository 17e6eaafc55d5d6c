import json
from datetime import datetime

import pytest

from tessera.operators import decay as D
from tessera.operators import pipelines as P


def test_time_windows():
    now = datetime(2024, 5, 2)
    assert P.time_window(now, previous=True) == {"kind": "previous", "before": now}
    assert P.time_window(now, session="s")["session"] == "s"
    assert P.time_window(now, days_back=1) == {"kind": "range", "start": datetime(2024, 5, 1), "end": now}
    assert P.time_window(now, start=datetime(2024, 1, 1))["end"] == now
    with pytest.raises(ValueError):
        P.time_window(now)


def test_entry_parser():
    got = P.parse_entries("### Chunk 0\n- how to x?\n2. why y?\nSUMMARY: about x\n\nChunk 1\nSKIP\nchunk 2\nnothing")
    assert got == {0: {"queries": ["how to x?", "why y?"], "summary": "about x"}}
    assert P.parse_entries("") == {}


def test_report_and_history(spark, tmp_path):
    text = P.report("Run", {"score": 0.5, "n": 3})
    assert "| score | 0.5000 |" in text and json.loads(text.split("```json\n")[1].split("\n```")[0]) == {"score": 0.5, "n": 3}
    P.store_run(spark, str(tmp_path / "h"), "r1", {"score": 1.0})
    P.store_run(spark, str(tmp_path / "h"), "r2", {"score": 2.0})
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    P.export_curves(D.curves(spark, 3), str(tmp_path / "c"))
    assert len(spark.read.option("header", "true").csv(str(tmp_path / "c")).columns) == len(D.MODELS) + 1


def test_recall_falls_back_to_search(spark):
    hits = spark.createDataFrame([("a", 0.5), ("z", 0.9)], "id string, score double")
    edges = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    nodes = spark.createDataFrame([(i, 10) for i in "abcz"], "id string, tokens int")
    scores = spark.createDataFrame([("a", 0.9), ("b", 0.8)], "id string, score double")
    got = sorted((r.place, r.id, r.source) for r in P.recall(hits, edges, scores, nodes, 9, 100).collect())
    assert got == [(0, "c", "chain"), (1, "b", "chain"), (2, "a", "chain")]
    none = sorted((r.place, r.id, r.source) for r in P.recall(hits, edges, scores, nodes, 9, 100, backward=False).collect())
    assert none == [(0, "z", "search"), (1, "a", "search")]
