"""Registered queries against their SQL on the smallest test data, where it is at hand."""

import os

import pytest

from compare import compare, duck
from tessera import plans

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
NAMES = (
    "p1_found p1_descendants p6_found p7_found chunk_scan cluster_project_relevance nearest_event_asof previous_session weekly_tuesday percentiles_floor sessionize_gap "
    "cluster_overlap bm25 knn pairwise_topk exemplars rrf cluster_expand hybrid_search pack_with_truncation reconstruct_timeline entities keyword_overlap code_and_path_redaction "
    "causal_edges bfs_neighborhood chain_walk_forward transition_matrix trigram_predict session_turns tool_exchanges silhouette roc_auc youden_threshold health ablation decay_areas hop_bins "
    "file_rank cascade_delete archive_round_trip stream_tumbling"
).split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(DATA), DATA, plans.queries()[name], plans.oracles()[name]) is None


def test_every_sql_has_its_query():
    assert set(plans.oracles()) <= set(plans.queries())
