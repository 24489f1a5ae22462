import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
import oracle  # noqa: E402

from vacantia.llm.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    oracle.compare(QUERIES[name](spark, SF), oracle.connect(SF), SQL[name])


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars")
    got = QUERIES["op10_language_id"](spark, SF).join(docs, "doc_id").filter("held_out and n_chars > 60")
    rows = got.collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)


def test_fingerprints_tell_edits_from_neighbours(spark):
    rows = [r for r in QUERIES["op7_fingerprints"](spark, SF).collect() if r.n_chars > 1000]
    assert sum(r.near_edited > r.near_next for r in rows) > 0.8 * len(rows)


def test_interpolation_beats_add_one(spark):
    rows = [r for r in QUERIES["op4_lm_scoring"](spark, SF).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
