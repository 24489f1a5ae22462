import datetime as dt

import pytest

from vacantia.operators.partitions import PartitionedTable

SCHEMA = "d date, k int, v string"


def rows(spark, days, tag):
    return spark.createDataFrame([(dt.date(2024, 1, d), k, f"{tag}{k}") for d in days for k in range(3)], SCHEMA)


def state(table, version=None):
    return sorted((r.d.day, r.k, r.v) for r in table.read(version).collect())


def want(days, tag):
    return [(d, k, f"{tag}{k}") for d in days for k in range(3)]


def test_a_range_is_replaced_and_the_rest_untouched(spark, tmp_path):
    t = PartitionedTable(spark, str(tmp_path / "t"), SCHEMA, "d")
    assert t.version() == -1 and t.read().collect() == []
    t.replace(rows(spark, range(1, 11), "a"), dt.date(2024, 1, 1), dt.date(2024, 2, 1), "load")
    outside = {f for f in t.read().inputFiles() if "-04" not in f and "-05" not in f and "-06" not in f}
    reader = t.read()
    v = t.replace(rows(spark, (4, 6), "b"), dt.date(2024, 1, 4), dt.date(2024, 1, 7), "fix")
    assert state(t) == sorted(want((1, 2, 3, 7, 8, 9, 10), "a") + want((4, 6), "b"))
    assert outside <= set(t.read().inputFiles()) and len(set(t.read().inputFiles()) - outside) == 2
    assert sorted((r.d.day, r.k, r.v) for r in reader.collect()) == want(range(1, 11), "a") == state(t, 0)  # a reader of the version before
    assert t.replace(rows(spark, (4,), "c"), dt.date(2024, 1, 4), dt.date(2024, 1, 7), "fix") == v and state(t) == sorted(want((1, 2, 3, 7, 8, 9, 10), "a") + want((4, 6), "b"))
    t.replace(rows(spark, (), "x"), dt.date(2024, 1, 1), dt.date(2024, 1, 9), "purge")
    assert state(t) == want((9, 10), "a")


def test_rows_outside_the_range_and_rival_writers(spark, tmp_path):
    t = PartitionedTable(spark, str(tmp_path / "t"), SCHEMA, "d")
    with pytest.raises(ValueError):
        t.replace(rows(spark, (1, 9), "a"), dt.date(2024, 1, 1), dt.date(2024, 1, 5), "x")
    with pytest.raises(ValueError):
        t.replace(spark.createDataFrame([(None, 1, "n")], SCHEMA), dt.date(2024, 1, 1), dt.date(2024, 1, 5), "x")
    assert t.version() == -1
    t.replace(rows(spark, (1,), "a"), dt.date(2024, 1, 1), dt.date(2024, 1, 5), "x")
    with pytest.raises(RuntimeError):
        t._commit(0, {"parts": [], "tokens": []})
    assert state(t) == want((1,), "a")


def test_whole_numbers_order_as_numbers(spark, tmp_path):
    t = PartitionedTable(spark, str(tmp_path / "t"), "k int, v string", "k")
    df = spark.createDataFrame([(k, "a") for k in (1, 2, 9, 10, 11)], "k int, v string")
    t.replace(df, 0, 100, "a")
    t.replace(df.filter("k = 10"), 9, 11, "b")
    assert sorted(r.k for r in t.read().collect()) == [1, 2, 10, 11]
