"""Answers with awkward words, white space and letters against the queries' SQL."""

import duckdb
import pytest

from marlstone.plans import registry
from tests.test_queries import rows

TEXTS = [
    "que un es es noñesñado", "la ciónno ñ", "es ßno é", "NO\rhay speech", "NOÑ speech", "not\ntrue", "not\rtrue", "trué", "‿true", "true²", "\U00010400true", "\U0001f600true",
    " B) x", "\vB) x", "　no, speech", " \r\nA\f", "abﬆ yeß", "abſent", "aﬃrmative", "musİc", "ticK", "ŉo", "ΐyes", "no speech", "b ", "non　speech", "NO b SPEECH",
]


@pytest.mark.parametrize("name", ["sc11_normalize_response", "sc11_normalize_response_mapped", "sc11_normalize_response_one_verbalizer", "sc12_parse_response", "sc13_resolve_prediction"])
def test_awkward_answers(spark, tmp_path, name):
    made = [(16 * i, 0, "user", t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(made, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(registry.ORACLE[name]).df()
    assert len(got) == len(TEXTS) and rows(got) == rows(want)
