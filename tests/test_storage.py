"""Intermediate tables, joins of large with perhaps small tables, and the run's folder."""

import random

import pytest

from tidemark import storage


@pytest.mark.parametrize("limit", [1 << 24, 0])
@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_joins_with_small_tables(spark, monkeypatch, limit, how, null_safe):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", limit)
    rng = random.Random(1)
    large = [(rng.choice(["hot", "hot", "hot", "a", "b", "none", None]), i) for i in range(300)]
    small = [("hot", 1), ("a", 2), ("b", 3), (None, 4)]
    got = storage.join_small(spark.createDataFrame(large, "k string, i int"), spark.createDataFrame(small, "k string, v int"), ["k"], how, null_safe)
    assert got.columns == (["k", "i", "v"])
    values = {k: v for k, v in small if k is not None or null_safe}
    want = [(k, i, values.get(k)) for k, i in large if how == "left" or k in values]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().toString()
    assert ("BroadcastHashJoin" in plan) == (limit > 0)


def test_bytes_of_texts_are_counted(spark):
    df = spark.createDataFrame([("x" * 1000, 1), (None, 2), ("é", 3)], "t string, n int")
    assert storage.memory_bytes(df) == 3 * (32 + 16 * 2) + 1002
    assert storage.memory_bytes(df.where("false")) == 0


def test_settings_come_back(spark):
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), storage.settings(spark, objectHashAggregate_sortBased_fallbackThreshold="7"):
        assert spark.conf.get(name) == "7"
        raise KeyError
    assert spark.conf.get(name) == before


def test_tables_lie_in_the_folder_of_the_run(spark):
    table = storage.materialize(spark.range(5), "five")
    path = storage.run_dir(spark)
    assert table._tidemark_path.startswith(path + "/five-") and spark.sparkContext.applicationId in path
    storage.discard(table)
    fs, target = storage._file_system(spark, table._tidemark_path)
    assert not fs.exists(target) and fs.exists(storage._file_system(spark, path)[1])
