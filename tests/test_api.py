import os
from datetime import datetime

import pytest

from tessera.api import Memory
from tessera.config import Config

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


def test_config():
    assert Config().rrf_k == 60
    with pytest.raises(ValueError, match="cluster_threshold, min_cluster_size"):
        Config(cluster_threshold=1.0, min_cluster_size=1)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_tools(spark):
    m = Memory(spark, DATA, now=datetime(2026, 2, 1))
    projects = m.list_projects().collect()
    top = max(projects, key=lambda r: r.n_chunks).session_slug
    assert sum(r.n_chunks for r in m.list_sessions(top).collect()) == max(r.n_chunks for r in projects)
    got = m.search("plan compare", max_tokens=4000).orderBy("place").collect()
    assert got and [r.place for r in got] == list(range(len(got))) and sum(r.approx_tokens for r in got if not r.cut) <= 4000
    assert m.search("", max_tokens=4000).count() == 0
    chain = m.recall("plan compare").orderBy("place").collect()
    assert chain and {r.source for r in chain} <= {"chain", "search"}
    rows = m.reconstruct(top, 3000).collect()
    assert rows and sum(r.approx_tokens for r in rows) <= 3000 and rows == sorted(rows, key=lambda r: (r.start_time, r.id))
    assert m.reconstruct(top, days_back=36500, newest=False).count() > 0 and m.reconstruct(top, previous=True).count() > 0
    before = {r.name: r.n for r in m.stats().collect()}
    left = m.forget(top)
    assert left["chunks"].count() == before["chunks"] - left["gone"].count() and left["edges"].count() <= before["edges"]


def test_repo_map(spark, tmp_path):
    (tmp_path / "a.scala").write_text("class Foo\ndef run")
    (tmp_path / "b.scala").write_text("import x.Foo\n")
    (tmp_path / "c.txt").write_text("class Nothing")
    m = Memory(spark, str(tmp_path))
    assert [(r.name, r.line) for r in m.repo_map(str(tmp_path)).collect()] == [("Foo", 1), ("run", 2)]
