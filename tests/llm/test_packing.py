import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import packing_queries
from tessera.llm.packing import Slots, pack, plan


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 40), max_size=12))
def test_plan_places_every_piece(counts):
    patterns = plan(counts, 50)
    used = Counter()
    for times, pieces in patterns:
        assert times > 0 and sum(n * k for n, k in pieces) <= 50 and len({n for n, _ in pieces}) == len(pieces)
        for n, k in pieces:
            used[n] += times * k
    assert used == Counter({n: c for n, c in counts.items() if c})
    total = sum(n * c for n, c in counts.items())
    containers = Slots(patterns).containers
    assert containers >= -(-total // 50) and (not total or containers <= 2 * -(-total // 50))


def test_every_document_once(spark):
    r = random.Random(2)
    texts = [None, "", "word"] + [" ".join(r.choices(["alpha", "beta", "gamma", "x"], k=r.choice([1, 3, 3, 3, 40, 90]))) for _ in range(120)] + ["word " * 500]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, container long").repartition(4)
    rows = pack(df, 100).collect()
    assert {x.doc_id for x in rows} == set(range(len(texts)))
    full = [x for x in rows if x.container is not None]
    assert {x.doc_id for x in rows if x.container is None} == {0, 1}
    load = Counter()
    for x in full:
        load[x.container] += x.n_tokens
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    assert all(v == 1 for v in Counter((x.container, x.position) for x in full).values())
    for c in load:
        assert sorted(x.position for x in full if x.container == c) == list(range(sum(x.container == c for x in full)))
    cut = sorted((x for x in full if x.doc_id == len(texts) - 1), key=lambda x: x.piece)
    assert len(cut) > 1 and all(x.n_tokens == 100 for x in cut[:-1]) and [x.first_token for x in cut] == [100 * i for i in range(len(cut))]
    assert all(x.piece == 0 for x in full if x.doc_id != len(texts) - 1)
    assert pack(df.limit(0), 100).count() == 0


@pytest.mark.parametrize("lost", [None, "piece < 2", "n_tokens = 2048", "false"])
def test_checks_count_what_is_not_placed(spark, tmp_path, monkeypatch, lost):
    texts = [None, "one", "word " * 5000, "other words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def faulty(*a, **k):
        rows = pack(*a, **k)
        return rows.withColumns({c: F.expr(f"if({lost}, {c}, null)") for c in ("container", "position")}) if lost else rows

    monkeypatch.setattr(packing_queries, "pack", faulty)
    row = packing_queries.p8_checks(spark, str(tmp_path)).first()
    assert row.n_documents == 4
    assert row.n_gaps == {None: 0, "piece < 2": 1, "n_tokens = 2048": 3, "false": 3}[lost]


def test_the_whole_result_stands_for_the_problem():
    assert next(iter(packing_queries.QUERIES)) == "p8_containers"
