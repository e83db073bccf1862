"""The keyed store: groups put whole or not at all, point reads of one bucket, against a plain dict."""

from __future__ import annotations

import random

import pytest

from spokeline.operators.keyed import Keyed, Refused

SCHEMA = "id string, name string, __v int"


def held(store) -> dict:
    rows = [tuple(r) for r in store.read().select("id", "name", "__v").collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {i: (n, v) for i, n, v in rows}


def test_changes_against_a_dict(spark, tmp_path):
    rng = random.Random(4)
    rows = [(str(i), f"n{i}", i) for i in range(200)]
    store, plain = Keyed.create(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/s", "id", buckets=8), {i: (n, v) for i, n, v in rows}
    for step in range(3):
        group = [(str(i), None if i % 5 == 0 else f"s{step}", None) for i in rng.sample(range(260), 20)]
        store.put(spark.createDataFrame(group, SCHEMA))
        plain |= {i: (n, v) for i, n, v in group}
        gone = [str(i) for i in rng.sample(range(300), 15)]
        store.delete(spark.createDataFrame([(i,) for i in gone + gone + [None]], "id string"))
        plain = {i: r for i, r in plain.items() if i not in gone}
        assert held(store) == plain
    store.tidy()
    assert held(Keyed(spark, f"{tmp_path}/s", "id")) == plain
    store.delete(spark.createDataFrame([(i,) for i in plain], "id string"))
    assert held(store) == {} and store.get("1").count() == 0
    store.put(spark.createDataFrame([("", "blank", 1)], SCHEMA))
    assert held(store) == {"": ("blank", 1)}


def test_a_group_is_put_whole_or_not(spark, tmp_path):
    store = Keyed.create(spark.createDataFrame([("a", "x", 1)], SCHEMA), f"{tmp_path}/s", "id", buckets=4)
    for bad in ([("b", "y", 2), (None, "z", 3)], [("b", "y", 2), ("b", "z", 3)]):
        with pytest.raises(Refused):
            store.put(spark.createDataFrame(bad, SCHEMA))
        assert held(store) == {"a": ("x", 1)}
    store.put(spark.createDataFrame([], SCHEMA))
    assert store._state()["number"] == 1
    # a change that was planned before another one was made
    before, rows = store._state(), spark.createDataFrame([("c", "late", 9)], SCHEMA)
    store.put(spark.createDataFrame([("b", "y", 2)], SCHEMA))
    with pytest.raises(Refused):
        store._change(before, rows, store._keys(rows, 4))
    # a job that is lost while it writes
    from pyspark.sql import functions as F

    broken = spark.createDataFrame([("d", "y", 2)], SCHEMA).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.put(broken)
    assert held(store) == {"a": ("x", 1), "b": ("y", 2)}


def test_point_read_opens_one_bucket(spark, tmp_path):
    rows = spark.range(5000).selectExpr("cast(id as string) id", "'n' name", "cast(id as int) __v")
    store = Keyed.create(rows, f"{tmp_path}/s", "id", buckets=16)
    one = store.get("4711")
    assert [tuple(r) for r in one.collect()] == [("4711", "n", 4711)]
    assert len({f.rsplit("/", 2)[1] for f in one.inputFiles()}) == 1 and len({f.rsplit("/", 2)[1] for f in store.read().inputFiles()}) == 16
    plan = one._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,4711)]" in plan
    assert store.get("no", "1", "2").count() == 2 and store.get().count() == 0
    assert store.lookup(spark.createDataFrame([("7",), ("7",), ("x",), (None,)], "id string")).count() == 1


def test_empty_store(spark, tmp_path):
    store = Keyed.create(spark.createDataFrame([], SCHEMA), f"{tmp_path}/s", "id")
    assert store.read().count() == 0 and store.get("a").count() == 0
    store.put(spark.createDataFrame([("a", "x", 1)], SCHEMA))
    assert held(store) == {"a": ("x", 1)}
