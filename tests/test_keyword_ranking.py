"""Keyword scores, ranks and metrics at size: what is shuffled, blocks of queries, lists that are cut to what is used."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vacantia.operators import analytics

DOCS = [(1, "red green red"), (2, "green blue"), (3, None), (4, ""), (5, "the und"), (6, "blue blue blue sky"), (7, "nothing here"), (8, "sky red")]
QUERIES = [(1, "red sky"), (2, "blue blue"), (3, "green"), (4, "absent"), (5, None)]
KEYS = {"query": "item", "doc": "doc"}


def tables(spark):
    return spark.createDataFrame(DOCS, "doc int, text string"), spark.createDataFrame(QUERIES, "item int, text string")


def by_hand() -> dict:
    words = {d: None if t is None else [w for w in t.split() if w not in ("the", "und")] for d, t in DOCS}
    known = [w for w in words.values() if w is not None]
    mean, df, out = sum(map(len, known)) / len(known), Counter(w for ws in known for w in set(ws)), defaultdict(float)
    for q, text in QUERIES:
        for w in set((text or "").split()):
            for d, ws in words.items():
                if tf := (ws or []).count(w):
                    out[q, d] += math.log(1 + (len(DOCS) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / max(mean, 1)))
    return out


@pytest.mark.parametrize("most", [500_000, 2])
def test_scores_in_blocks_of_queries(spark, most):
    got = {(r.item, r.doc): r.score for r in analytics.bm25(*tables(spark), doc="doc", query="item", most=most).collect()}
    assert got == pytest.approx(by_hand()) and len(got) == 7


def test_terms_of_pairs_are_not_shuffled(spark):
    """Before, every term that a document and a query share went through a shuffle by both."""
    scored = analytics.bm25(*tables(spark), doc="doc", query="item")
    dealt = [x for x in scored._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert any("REPARTITION_BY_NUM" in x for x in dealt) and not any("item#" in x for x in dealt)


def test_metrics_of_cut_ranks_and_common_labels(spark):
    """Labels for all queries alike, ranks up to k: the same as labels of each query and all ranks."""
    pairs = spark.createDataFrame([(q, d, float((d * 7 + q) % 5)) for q in range(3) for d in range(q, 30)], "item int, doc int, score double")
    labels = spark.createDataFrame([(d, g) for d, g in enumerate([0, 2, 1, None, 0, 1, 2, 0] * 5)], "doc int, gain int")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc"))
    whole = analytics.ranking_metrics(pairs.select("item", "doc", rank.alias("rank")), labels.crossJoin(pairs.select("item").distinct()), **KEYS)
    cut = analytics.ranking_metrics(analytics.top_ranks(pairs, **KEYS, k=10).select("item", "doc", "rank"), labels, **KEYS, found=pairs.select("item", "doc"))
    assert sorted(whole.collect()) == sorted(cut.collect()) and cut.count() == 3
    assert analytics.ranking_metrics(analytics.top_ranks(pairs, **KEYS, k=10), labels.limit(0), **KEYS, found=pairs).count() == 0


def test_counted_places_fuse_like_whole_ranks(spark):
    pairs = spark.createDataFrame([(q, d, float((d * 7 + q) % 5)) for q in range(3) for d in range(q, 30)], "item int, doc int, score double")
    first, thirds = analytics.top_ranks(pairs, **KEYS, k=8), pairs.filter("doc % 3 = 0").select("item", "doc")
    ranked = thirds.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("doc")))
    size = thirds.groupBy("item").agg((F.count("*") + 1).alias("last"))
    cut = analytics.fuse_ranks(first, analytics.places(thirds, first.filter("doc % 3 = 0"), **KEYS), **KEYS, weight=0.5, size=size)
    whole = analytics.fuse_ranks(first, ranked, **KEYS, weight=0.5)
    assert sorted(cut.collect()) == sorted(whole.collect()) and cut.count() == 24
