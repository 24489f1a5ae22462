import numpy as np
import pytest

from vacantia.operators import company_search as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    kinds = rng.normal(size=(12, 16))
    rows = [(k, f"Firm {k % 40} {'Bau' if k % 9 == 0 else 'Software'}", 50 + (k % 20) / 10, 7 + (k % 30) / 10, [float(x) for x in kinds[k % 12] + 0.4 * rng.normal(size=16)] if k % 5 else None) for k in range(1500)]
    companies = spark.createDataFrame([r[:4] for r in rows], "id long, name string, lat double, lon double")
    docs = spark.createDataFrame([(r[0], r[4]) for r in rows], "id long, embedding array<double>")
    return rows, companies, docs, S.build_index(docs, lists=24, probes=6)


def order(rows, q, keep):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    return [k for _, k in sorted((1 - float(unit(q) @ unit(r[4])), r[0]) for r in rows if r[4] and keep(r))]


def test_every_vector_is_indexed_and_recall_is_high(spark, data):
    rows, _, docs, index = data
    assert index.rows.count() == sum(r[4] is not None for r in rows)
    asked = docs.filter("id % 50 = 1").withColumnRenamed("id", "query_id")
    assert S.recall(index, docs, asked, 5) >= 0.9
    full = S.VectorIndex(index.rows, index.centres, len(index.centres))
    assert S.recall(full, docs, asked, 5) == 1.0


def test_semantic_step(data):
    rows, companies, _, index = data
    q = rows[7][4]
    page, total, mode = S.search_companies(companies, index, text="anything", vector=q, limit=10)
    got = [r.id for r in page.collect()]
    assert mode == "semantic" and total == index.rows.count() and len(set(got) & set(order(rows, q, lambda r: True)[:10])) >= 9
    page, total, mode = S.search_companies(companies, index, vector=q, within=(50.0, 7.0, 30.0), offset=2, limit=200)
    inside = {x.id for x in S.search_companies(companies, None, within=(50.0, 7.0, 30.0), limit=10**6)[0].collect()}
    near = order(rows, q, lambda r: r[0] in inside)
    assert [r.id for r in page.collect()] == near[2:] and total == len(near)  # few in scope: compared in full


def test_keyword_and_browse(data):
    rows, companies, _, index = data
    page, total, mode = S.search_companies(companies, index, text=" bau ", limit=5)
    want = sorted((r[1].lower(), r[0]) for r in rows if "bau" in r[1].lower())
    assert (mode, total, [(r.name.lower(), r.id) for r in page.collect()]) == ("keyword", len(want), want[:5])
    page, total, mode = S.search_companies(companies, None, vector=[1.0] * 16, within=(50.0, 7.0, 5.0), limit=4)
    assert mode == "browse" and [r.distance_m for r in page.collect()] == sorted(r.distance_m for r in page.collect()) and total > 0


def test_scope_without_vectors_falls_back(data):
    rows, companies, _, index = data
    page, total, mode = S.search_companies(companies, index, text="firm 5 ", vector=rows[7][4], where=companies["id"] % 5 == 0)
    assert mode == "keyword" and total == sum(r[0] % 5 == 0 and "firm 5" in r[1].lower() for r in rows)


def test_no_vectors(spark, data):
    _, companies, _, _ = data
    empty = S.build_index(spark.createDataFrame([(1, None), (2, [])], "id long, embedding array<double>"))
    assert S.search_companies(companies, empty, text="firm", vector=[1.0])[2] == "keyword" and S.topk(empty, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"), 3).count() == 0


def test_queries_meet_lists_in_products_of_matrices(spark, monkeypatch):
    """No row is made for a pair of a query and a vector; ties by id, whatever blocks and steps there are."""
    rng = np.random.default_rng(7)
    kinds = [[float(x) for x in rng.integers(-2, 3, size=6)] for _ in range(40)]
    rows = [(k, kinds[k % 40]) for k in range(400) if any(kinds[k % 40])]
    docs = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    asked = docs.filter("id % 7 = 0").withColumnRenamed("id", "query_id")
    index = S.build_index(docs, lists=8, probes=3)
    found = S.topk(index, asked, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    stored = {r.id: (r.list, r.vector) for r in index.rows.collect()}
    unit = {q: np.array(v) / np.sqrt(sum(x * x for x in v)) for q, v in rows if q % 7 == 0}
    near = lambda q, v: 1 - float(np.cumsum(unit[q] * np.array(v))[-1])
    want = sorted((q, i, d) for q in unit for d, i in sorted((near(q, v), i) for i, (n, v) in stored.items() if n in index.nearest_lists(unit[q]))[:4])
    got = lambda f: sorted((r.query_id, r.id, r.distance) for r in f.collect())
    assert got(found) == want and len(want) == 4 * len(unit)
    monkeypatch.setattr(S.search, "CELLS", 50)
    monkeypatch.setattr(S.search, "MAX_QUERIES", 9)
    assert got(S.topk(index, asked, 4)) == want


def test_nearest_of_batches():
    """Rows in any batches, fewer than k of them, and vectors without a distance, which come last."""
    rng = np.random.default_rng(8)
    rows, asked = rng.normal(size=(3_000, 5)), rng.normal(size=(30, 5))
    rows[::2], rows[7] = rows[0], np.nan
    for size, k in ((3_000, 4), (3_000, 1_200), (3, 5), (1, 1)):
        d = 1 - np.cumsum(asked[:, None, :] * rows[None, :size], axis=2)[:, :, -1]
        want = np.lexsort((np.broadcast_to(np.arange(size), d.shape), d), axis=1)[:, :k]
        for step in (7, 1_100, 3_000):
            best = S.search.Nearest(range(30), asked, k, 2_000)
            for at in range(0, size, step):
                best.meet(np.arange(size)[at : at + step], rows[at : min(size, at + step)])
            got = [b.to_pydict() for b in best.found(["q", "id", "distance"])][0]
            assert got["id"] == want.ravel().tolist() and got["q"] == np.repeat(np.arange(30), want.shape[1]).tolist()


def test_odd_vectors_are_neither_indexed_nor_asked(spark):
    odd = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1e200, 1.0]]
    docs = spark.createDataFrame([*enumerate([[3.0, 4.0], [1.0, 0.0]]), *((k + 2, v) for k, v in enumerate(odd))], "id long, embedding array<double>").repartition(3)
    index = S.build_index(docs, lists=2, probes=2)
    assert sorted((r.id, r.vector) for r in index.rows.collect()) == [(0, [3.0 / 5.0, 4.0 / 5.0]), (1, [1.0, 0.0])]
    found = S.topk(index, docs.withColumnRenamed("id", "query_id"), 5).collect()
    assert sorted((r.query_id, r.id) for r in found) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_few_of_many_copies():
    """Of equal rows those with the smallest ids are compared; rows that differ in any entry all are."""
    rows = np.ones((500, 3))
    rows[100, 2] = 1 + 1e-15
    ids = np.arange(500)[::-1].copy()
    kept, some = S.search._few(ids, rows, 4)
    assert sorted(kept) == [0, 1, 2, 3, 399] and (some[kept == 399] == rows[100]).all()
