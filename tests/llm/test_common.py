"""Shared helpers: lookups with hot keys, stored tables, small tables, keys of documents."""

import gc
import random
import time

from lodegrid.llm import common
from lodegrid.llm.queries import ORACLE_SQL, QUERIES


def test_lookup_is_a_join(spark):
    rng = random.Random(1)
    rows = [(k, 1 if rng.random() < 0.4 else rng.randrange(5000)) for k in range(4000)]
    df = common.stored(spark.createDataFrame(rows, "i int, key int"))
    groups = common.stored(df.groupBy("key").count().filter("count > 1"))
    want = sorted(tuple(r) for r in df.join(groups, "key").select("i", "key", "count").collect())
    assert sorted(tuple(r) for r in common.lookup(df, groups, ["key"], "count", 4000).select("i", "key", "count").collect()) == want


def test_stored_tables_are_swept(spark):
    df = common.stored(spark.range(3))
    assert df.inputFiles() and df.count() == 3
    common.sweep(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{common.shared_dir(spark)}/lodegrid/{spark.sparkContext.applicationId}")
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _exists(spark, path):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def test_unread_tables_are_reclaimed(spark):
    """A table goes when nothing reads it, and stays as long as anything made of it might be."""
    kept, gone = common.stored(spark.range(5)), common.stored(spark.range(7))
    paths = [df.inputFiles()[0].rpartition("/")[0] for df in (kept, gone)]
    derived = kept.filter("id > 1").groupBy().count()
    del kept, gone
    for _ in range(20):
        gc.collect()
        spark._jvm.System.gc()
        common.reclaim(spark)
        if not _exists(spark, paths[1]):
            break
        time.sleep(0.2)
    assert not _exists(spark, paths[1]) and _exists(spark, paths[0])
    assert derived.first()[0] == 3


def test_names_are_free_in_any_case(spark):
    df = spark.createDataFrame([(1, 2)], "Score int, score_ int")
    assert common.free_name(df, "score") == "score__" and common.free_name(df, "rid") == "rid"


def test_small_table(spark):
    df = common.small_table(spark, [{"a": 1, "b": [1, 2]}, {"a": None, "b": []}], "a: int, b: array<bigint>")
    assert [tuple(r) for r in df.collect()] == [(1, [1, 2]), (None, [])] and common.small_table(spark, [], "a: int").count() == 0


def test_keys_follow_the_order_of_documents(spark):
    plain, none = common.keyed_documents(spark.createDataFrame([(3, "a"), (1, None)], "doc_id long, text string"), "doc_id", "text")
    assert none is None and sorted(tuple(r) for r in plain.collect()) == [(1, ""), (3, "a")]
    texts, ids = common.keyed_documents(spark.createDataFrame([(3, "a"), (3, "b"), (None, "c"), (1, "d")], "doc_id long, text string"), "doc_id", "text")
    assert [r["doc_id"] for r in ids.orderBy("key").collect()] == [None, 1, 3, 3] and texts.select("key").distinct().count() == 4


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13 and set(ORACLE_SQL) <= set(QUERIES)
