"""Registered queries: contract, and values against SQL on the smallest folder.

``python tests/check_queries.py`` compares every query on a bigger folder.
"""

import pytest

import __spark_entry__ as entry
from check_queries import compare, duck
from conftest import SMALL

CHECKED = [
    "flow_features", "flow_embedding", "flow_embedding_v1", "quantized_bins", "lsh_index", "lsh_probe",
    "lsh_verdict", "lsh_verdict_v1", "score_flows", "roc_auc", "confusion_matrix", "metrics_over_seeds",
    "feature_ablation", "stream_score", "feature_corr_matrix", "anomaly_rate_per_minute", "vector_sign_code",
]


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.entry(spark).columns) == {"id", "model", "is_anomaly", "score"}


@pytest.mark.parametrize("name", CHECKED)
def test_values(spark, name):
    status, _, rows, note = compare(spark, duck(SMALL), SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "equal", note
