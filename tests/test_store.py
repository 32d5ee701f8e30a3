import glob
import os

import pytest
from pyspark.sql.types import StructType

from helixframe.sources.store import Store

SCHEMA = StructType().add("id", "long").add("name", "string").add("added", "long")


def held(store, spark):
    return sorted(tuple(r) for r in store.read(spark).collect())


def stamps(store):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(store.path + "/bucket=*/part-*")}


def test_upserts_rewrite_touched_folders_only(spark, tmp_path):
    store = Store(str(tmp_path / "s"), SCHEMA, "id", 8)
    assert held(store, spark) == [] and store.corrupt(spark).count() == 0 and store.quarantined(spark).count() == 0
    first = [(i, f"n{i}", i) for i in range(100)]
    assert store.upsert(spark.createDataFrame(first, SCHEMA)) == list(range(8)) and held(store, spark) == first
    before = stamps(store)
    touched = store.upsert(spark.createDataFrame([(7, "older", 1), (7, "newer", 2), (7, "older", 2)], SCHEMA), "added")
    assert len(touched) == 1
    after = stamps(store)
    assert {f for f in before if f not in after} == {f for f in before if f"bucket={touched[0]}/" in f}
    assert all(after[f] == t for f, t in before.items() if f in after)
    assert held(store, spark) == sorted([r for r in first if r[0] != 7] + [(7, "older", 2)])
    assert store.upsert(spark.createDataFrame([], SCHEMA)) == []
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([(None, "x", 1)], SCHEMA))


def test_corrupt_lines_are_skipped_listed_and_kept(spark, tmp_path):
    store = Store(str(tmp_path / "s"), SCHEMA, "id", 2)
    store.upsert(spark.createDataFrame([(i, "a", 0) for i in range(10)], SCHEMA))
    bad = ['{"id": 3, "na', '{"name": "no key"}', '{"id": "text", "name": "b"}', "[1]", "null", "not json"]
    for b in (0, 1):
        (tmp_path / "s" / f"bucket={b}" / "by-hand.txt").write_text("\n".join([*bad, "", f'{{"id": {100 + b}, "more": 1}}']) + "\n")
    want = [(i, "a", 0) for i in range(10)] + [(100, None, None), (101, None, None)]
    assert held(store, spark) == want
    assert sorted(r[0] for r in store.corrupt(spark).collect()) == sorted(bad * 2)
    touched = store.upsert(spark.createDataFrame([(3, "b", 1)], SCHEMA))
    assert len(touched) == 1 and sorted(r[0] for r in store.quarantined(spark).collect()) == sorted(bad)
    assert store.corrupt(spark).count() == len(bad) and held(store, spark) == sorted([r for r in want if r[0] != 3] + [(3, "b", 1)])


def test_deletes(spark, tmp_path):
    store = Store(str(tmp_path / "s"), SCHEMA, "id", 4)
    store.upsert(spark.createDataFrame([(i, "a", 0) for i in range(20)], SCHEMA))
    assert store.delete(spark, spark.createDataFrame([(99,), (5,), (5,), (None,)], "id long")) and [r[0] for r in held(store, spark)] == [i for i in range(20) if i != 5]
    (tmp_path / "s" / "bucket=1" / "by-hand.txt").write_text("not json\n")
    store.delete(spark, store.read(spark))
    assert held(store, spark) == [] and [r[0] for r in store.corrupt(spark).collect()] == ["not json"]
