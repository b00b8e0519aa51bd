"""What the corpus operators share: durable intermediate tables and skew-proof lookups."""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A key with at least 1/HOT_SHARE of all rows is hot; so there are HOT_SHARE hot keys at most.
HOT_SHARE = 1000

#: So few rows in all have so few keys that one broadcast of them serves: on little input a shuffle costs the driver more than the tasks.
FEW_ROWS = 20_000

#: Rows of an Arrow batch that the JVM hands over, and rows and bytes of the slices in which they are worked on.
BATCH_ROWS = 2000
SLICE_ROWS = 256
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in single-JVM local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodegrid-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The folders that tables are stored in at the moment, innermost last.
_scopes: list[str] = []

#: Stored tables: path, and a weak reference to the list of files that every plan over the table holds.
_watched: list[tuple[str, Any]] = []


@contextmanager
def scope(name: str) -> Iterator[str]:
    """Tables that are stored meanwhile go to a folder of their own, which can be swept alone. Yields its name."""
    _scopes.append(f"{name}-{uuid.uuid4().hex}")
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def _folder(spark: SparkSession, name: str = "") -> str:
    return "/".join(x for x in (shared_dir(spark), "lodegrid", spark.sparkContext.applicationId, name) if x)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and losing executors loses nothing.

    The table is deleted by ``reclaim`` or ``sweep``.
    """
    spark = df.sparkSession
    reclaim(spark)
    path = f"{_folder(spark, _scopes[-1] if _scopes else 'shared')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().relation().location()
    _watched.append((path, spark._jvm.java.lang.ref.WeakReference(files)))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def reclaim(spark: SparkSession) -> None:
    """Delete the stored tables that no DataFrame reads any more: the JVM has collected what each plan over them refers to.

    As Spark's own cleaner does with shuffles and checkpoints, by reachability, never by age. An RDD made of a DataFrame doesn't
    keep its tables: keep the DataFrame.
    """
    gone = [x for x in _watched if x[1]._gateway_client is spark._jvm._gateway_client and x[1].get() is None]
    for path, _ in gone:
        _delete(spark, path)
    _watched[:] = [x for x in _watched if x not in gone]


def sweep(spark: SparkSession, name: str = "") -> None:
    """Delete the tables that were stored in a scope, or every one of this application. Call it when results are written."""
    _delete(spark, _folder(spark, name))


def numbered_rows(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row (from 0, without gaps) in a total order: a sort in ranges, stored once; a range's places follow those before it."""
    rows = stored(df.orderBy(*by).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33).cast("int")
    starts, before = [], 0
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):  # a number a partition
        starts.append({"part": r["part"], "start": before})
        before += r["count"]
    start = F.broadcast(small_table(df.sparkSession, starts, "part: int, start: bigint"))
    out = rows.withColumn("__part", part).join(start, F.col("__part") == F.col("part"))
    return out.select(*df.columns, (F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start")).alias(name))


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with as many underscores as it takes to be no column's name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def own_columns(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """The columns of that name, whatever characters are in it."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in names or df.columns]


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """(``docs`` written with a number for each row, the name of that column): rows keep their identity, whatever their ids are."""
    rid = free_name(docs, "__rid")
    return stored(docs.withColumn(rid, F.monotonically_increasing_id())), rid


def with_plain_names(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: Python workers are handed no column whose name holds dots or backticks."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def short_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of BATCH_ROWS rows at most, so that neither side holds many long ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def slices(batches: Iterator[pa.RecordBatch], most_rows: int = SLICE_ROWS, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of at most so many rows and bytes (or one row)."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(most_rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() > most_bytes and batch.slice(at, n).nbytes > most_bytes:
                n //= 2
            yield batch.slice(at, n)
            at += n


def give_back() -> None:
    """Return freed memory to the system: workers are used again, for other stages too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        return


def small_table(spark: SparkSession, rows: list[dict], columns: str) -> DataFrame:
    """A few figures of the driver as a table, without RDDs: ``columns`` like "a: int, b: array<bigint>"."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{columns}>>")))


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key of ``groups``, where few keys may hold most rows.

    ``size`` is the column of ``groups`` with the number of rows of a key, ``total`` the sum of all.
    Keys with total / HOT_SHARE rows or more are broadcast: HOT_SHARE at most, whatever the input.
    The rest is shuffled; no key of it has more than total / HOT_SHARE rows. Both inputs are read
    twice, so hand over stored tables. FEW_ROWS or less are not parted: all their keys are broadcast.
    """
    if total <= FEW_ROWS:
        return rows.join(F.broadcast(groups), keys)
    limit = max(total / HOT_SHARE, 1.0)
    hot = F.broadcast(groups.filter(F.col(size) >= limit))
    cold = groups.filter(F.col(size) < limit)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def smallest(rows: DataFrame, order: Column, most: int) -> DataFrame:
    """Of a stored table the ``most`` rows with the smallest values of ``order``, a 64-bit hash of what tells the rows apart.

    Rows are thinned out by the hash first, to a little more than wanted, so no more than that is ever sorted together.
    """
    n = rows.count()
    if n > most:
        share = min(1.0, (most + 6 * most**0.5 + 20) / n)
        rows = rows.filter(order <= F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))))
    return rows.orderBy(order).limit(most)


def keyed_documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(key, text) with unique keys in the order of documents, and their doc_ids where these can't be the keys: if any is null or repeated."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if slim.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return slim.select(F.col("doc_id").alias("key"), "text").filter("key is not null"), None
    ordered = slim.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    rows = stored(ordered.withColumn("key", F.monotonically_increasing_id()))
    return rows.select("key", "text"), rows.select("key", "doc_id")


def draw_without_replacement(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric counts: how often each colour is among n items drawn without replacement."""
    colors, total = np.asarray(colors, dtype=np.int64), int(np.sum(colors))
    if total < 10**9:  # the most that numpy's generator takes
        return rng.multivariate_hypergeometric(colors, n, method="marginals")
    if 2 * n > total:
        return colors - draw_without_replacement(rng, colors, total - n)
    picked = np.unique(rng.integers(total, size=n))
    while len(picked) < n:  # a uniform subset: what was drawn twice is drawn anew
        picked = np.union1d(picked, rng.integers(total, size=n - len(picked)))
    return np.bincount(np.searchsorted(np.cumsum(colors), picked, side="right"), minlength=len(colors))
