import json
import os

from pyspark.sql import functions as F

from tessera.operators import transcripts as T
from tessera.sources import archive, jsonl

SID = "0b5c1f2a-1111-4222-8333-444455556666"


def lines():
    m = lambda **k: json.dumps({"sessionId": "s1", "slug": "p", "cwd": "/w/p", "isSidechain": False, **k})
    use = [{"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/w/a.py"}}, {"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "git commit -m x"}}]
    res = [{"type": "tool_result", "tool_use_id": "t1", "content": "bad", "is_error": True}]
    return [
        m(type="user", uuid="u1", timestamp="2024-01-01T00:00:00Z", message={"role": "user", "content": "hello"}),
        m(type="assistant", uuid="u2", timestamp="2024-01-01T00:00:01Z", message={"role": "assistant", "content": json.dumps(use)}),
        m(type="user", uuid="u3", timestamp="2024-01-01T00:00:02Z", message={"role": "user", "content": json.dumps(res)}),
        m(type="progress", uuid="u4"), "", "{broken", m(type="user", uuid="u5", isSidechain=True),
        m(type="user", uuid="u6", timestamp="2024-01-01T00:00:09Z", message={"role": "user", "content": json.dumps([{"type": "text", "text": "again"}])}),
    ]


def test_session_files(spark, tmp_path):
    os.makedirs(tmp_path / "x")
    (tmp_path / "x" / f"{SID}.jsonl").write_text("\n".join(lines()))
    (tmp_path / "other.jsonl").write_text("\n")
    rows = jsonl.read_sessions(spark, str(tmp_path))
    assert [r.uuid for r in rows.orderBy("offset").collect()] == ["u1", "u2", "u3", "u6"]
    assert jsonl.read_sessions(spark, str(tmp_path), sidechains=True, noise=True).count() == 6
    info = jsonl.session_info(rows).first()
    assert (info.sessionId, info.slug, info.first_at, info.last_at, info.n_messages) == ("s1", "p", "2024-01-01T00:00:00Z", "2024-01-01T00:00:09Z", 4)
    assert [r.path.rsplit("/", 1)[1] for r in jsonl.discover(spark, str(tmp_path)).collect()] == [f"{SID}.jsonl"]
    m = rows.select("uuid", F.col("sessionId").alias("session"), "type", F.col("message.content").alias("content"), F.unix_micros(F.to_timestamp("timestamp")).alias("at"))
    t = T.turns(m)
    assert {r.uuid: r.turn for r in t.collect()} == {"u1": 0, "u2": 0, "u3": 0, "u6": 1}
    text = {r.turn: r.text for r in T.rendered_turns(t).collect()}
    assert text[1] == "[User]\nagain" and text[0].startswith("[User]\nhello\n\n[Tool:Edit]\n") and text[0].endswith("[Result:Edit]\nbad")
    x = T.tool_exchanges(m)
    assert {(r.tool_use_id, r.result) for r in x.collect()} == {("t1", "bad"), ("t2", None)}
    s = T.session_state(x).first()
    assert s.files_touched == ["/w/a.py"] and s.outcomes == ["git commit"] and s.errors[0].message == "bad"
    assert T.chunk_turns(T.rendered_turns(t)).first().turn_indices == [0, 1]


def test_slugs(spark):
    d = spark.createDataFrame([("/a/x",), ("/b/x",), ("/c/y",), (None,), ("/",)], "cwd string")
    assert {r.cwd: r.slug for r in jsonl.project_slugs(d).collect()} == {"/a/x": "a-x", "/b/x": "b-x", "/c/y": "y"}


def test_archive(spark, tmp_path):
    c = spark.createDataFrame([("c1", "p", "see /a/b.py\n```x```"), ("c2", "q", None)], "id string, session_slug string, content string")
    tables = {
        "chunks": c, "edges": spark.createDataFrame([("e1", "c1", "c2"), ("e2", "c1", "c1")], "id string, src string, dst string"),
        "assignments": spark.createDataFrame([("c1", "k1")], "chunk_id string, cluster_id string"), "clusters": spark.createDataFrame([("k1",), ("k2",)], "id string"),
        "vectors": spark.createDataFrame([("c1", [1.0]), ("c2", None)], "id string, embedding array<double>"),
    }
    part = archive.select_archive(tables, ["p"], paths=True, code=True)
    archive.write_archive(part, str(tmp_path / "a"))
    back = archive.read_archive(spark, str(tmp_path / "a"))
    assert back["chunks"].first().content == "see [REDACTED_PATH]\n```\n[REDACTED_CODE]\n```"
    assert [r.id for r in back["edges"].collect()] == ["e2"] and [r.id for r in back["clusters"].collect()] == ["k1"]
    assert archive.dangling(tables | {"chunks": part["chunks"]}).first()[:] == (1, 0)
