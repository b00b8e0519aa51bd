"""Order: emergence curves, rankings, top rows, reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.session import scratch


def numbered(df: DataFrame, by: list[Column], name: str, first: int = 1) -> DataFrame:
    """Number rows from ``first`` in a total order: a distributed sort, written once; a partition's numbers start after those before it."""
    spark, part, at = df.sparkSession, f"__part_{name}", f"__at_{name}"
    path = scratch(spark)
    sorted_ = df.orderBy(*by).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id())
    sorted_.write.parquet(path)
    rows = spark.read.schema(sorted_.schema).parquet(path)
    starts, before = [], first
    for p, n in sorted(tuple(r) for r in rows.groupBy(part).count().collect()):  # a number per partition
        starts.append((p, before))
        before += n
    start = spark.createDataFrame(starts, f"{part} int, __start long")
    return rows.join(F.broadcast(start), part).withColumn(name, (F.col("__start") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).select(*[c for c in df.columns if c != name], name)


def ranked(order: DataFrame, by: list[Column], name: str = "rank", buckets: str | None = None) -> DataFrame:
    """Number rows from 1. With ``buckets``, a column that the order starts with, each bucket is numbered apart and shifted by the sizes of those before it."""
    if buckets is None:
        return numbered(order, by, name)
    sizes = order.groupBy(buckets).agg(F.count("*").alias("__size"))
    before = Window.partitionBy(F.lit(0)).orderBy(buckets).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col(buckets).alias("__b"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__shift"))
    own = F.row_number().over(Window.partitionBy(buckets).orderBy(*by))
    return order.withColumn("__own", own).join(shifts, F.col(buckets).eqNullSafe(F.col("__b"))).withColumn(name, (F.col("__own") + F.col("__shift")).cast("long")).drop("__own", "__shift", "__b")


#: Ranks whose running sum is made in one task.
RANKS_A_TASK = 10_000


def saturation(pairs: DataFrame, order: DataFrame, entity: str, label: str, window: float = 0.1) -> DataFrame:
    """rank, entity, new_count, cumulative_count, in_final_window.

    ``order`` is (entity, rank) with ranks 1 .. n. A label is new where it is first seen; labels of entities
    that aren't in the order don't count. The final window is the last ``window`` of the ranks.
    """
    first = pairs.dropna(subset=[entity, label]).join(order, entity).groupBy(label).agg(F.min("rank").alias("rank"))
    new = first.groupBy("rank").agg(F.count("*").alias("new_count"))
    curve = order.join(new, "rank", "left").withColumn("new_count", F.coalesce("new_count", F.lit(0)))
    n = order.agg(F.count("*").alias("__n"))
    # Running sums by blocks of ranks, shifted by the sums of the blocks before.
    curve = curve.withColumn("__block", F.floor((F.col("rank") - 1) / RANKS_A_TASK))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shift = curve.groupBy("__block").agg(F.sum("new_count").alias("__sum")).withColumn("__shift", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    within = Window.partitionBy("__block").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = curve.withColumn("__within", F.sum("new_count").over(within)).join(shift, "__block").withColumn("cumulative_count", F.col("__within") + F.col("__shift"))
    start = F.ceil((F.lit(1.0) - F.lit(float(window))) * F.col("__n")) + 1
    return curve.crossJoin(n).select("rank", entity, "new_count", "cumulative_count", (F.col("rank") >= start).alias("in_final_window"))


def saturation_verdict(curve: DataFrame) -> DataFrame:
    """entities, window, new_in_window, per_entity, total, saturated."""
    inside = F.col("in_final_window")
    out = curve.agg(F.count("*").alias("entities"), F.count_if(inside).alias("window"), F.coalesce(F.sum(F.when(inside, F.col("new_count"))), F.lit(0)).alias("new_in_window"), F.max("cumulative_count").alias("total"))
    return out.withColumn("per_entity", F.coalesce(F.try_divide(F.col("new_in_window"), F.col("window")), F.lit(0.0))).withColumn("saturated", F.col("new_in_window") == 0)


def order_violations(df: DataFrame, order: str, value: str) -> DataFrame:
    """Rows whose value is below the one before, and that one as ``before``. Neighbours meet by their numbers, so no task has all rows."""
    rows = numbered(df, [F.col(order), F.col(value)], "__n")
    before = rows.select((F.col("__n") + 1).alias("__n"), F.col(value).alias("before"))
    return rows.join(before, "__n").filter(F.col(value) < F.col("before")).drop("__n")


def top_per_group(df: DataFrame, keys: list[str], score: Column, tie: str) -> DataFrame:
    """The row of the highest score of each group, ties to the lowest ``tie``; combines on the map side."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(score.alias("s"), (-F.col(tie)).alias("t"))).alias("r"))
    return best.select("r.*")


def seeded_order(key: Column, seed: int | str) -> Column:
    """A reproducible random order that other engines can repeat too."""
    return F.md5(F.encode(F.concat(F.lit(f"{seed}:"), key.cast("string")), "UTF-8"))


ORDERS = ("doi", "recent", "rank", "random")


def order_keys(strategy: str, row_idx: str, doi: str = "doi", year: str = "year", rank: str = "rank", seed: int = 42) -> list[Column]:
    """By DOI; latest first; by venue rank; or at random, reproducibly. Ties keep the order of rows."""
    level = F.when(F.col(rank) == "A*", 0).when(F.col(rank) == "A", 1).when(F.col(rank) == "B", 2).otherwise(3)
    keys = {"doi": F.col(doi).asc_nulls_last(), "recent": F.col(year).desc_nulls_last(), "rank": level, "random": seeded_order(F.col(row_idx), seed)}
    if strategy not in keys:
        raise ValueError(f"order is one of {', '.join(ORDERS)}")
    return [keys[strategy], F.col(row_idx)]


def ordered(df: DataFrame, strategy: str, row_idx: str, **columns) -> DataFrame:
    return df.orderBy(*order_keys(strategy, row_idx, **columns))


def renumbered(df: DataFrame, by: list[Column], prefix: str, width: int = 5, name: str = "ref_id") -> DataFrame:
    """Ids like snow_00000 in the given order; numbers with more digits keep them all."""
    out, digits = numbered(df, by, "__n", 0), F.col("__n").cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return out.withColumn(name, F.concat(F.lit(prefix), padded)).drop("__n")


def simple_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


#: Parts of a stratum whose first rows are found apart.
PARTS = 64


def stratified_sample(df: DataFrame, stratum: str, key: str, rates: list[tuple[str, float]], budget: int, seed: int = 42) -> DataFrame:
    """From each stratum its rate of rows, at least one, in the order of the list until the budget is used up; later strata may get nothing."""
    axis = df.sparkSession.createDataFrame([(k, s, float(r)) for k, (s, r) in enumerate(rates)], f"__at int, {stratum} string, __rate double")
    sizes = axis.join(df.groupBy(stratum).agg(F.count("*").alias("__size")), stratum)
    sizes = sizes.withColumn("__want", F.least(F.col("__size"), F.greatest(F.lit(1), F.floor(F.col("__size") * F.col("__rate")))))
    before = F.coalesce(F.sum("__want").over(Window.partitionBy(F.lit(0)).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    takes = sizes.withColumn("__take", F.least(F.col("__want"), F.greatest(F.lit(0), F.lit(budget) - before))).select(stratum, "__take")
    # The first rows of each part of a stratum, then of the stratum: no task sorts a whole one.
    rows = df.join(F.broadcast(takes.filter("__take > 0")), stratum).withColumn("__part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    for part in ([stratum, "__part"], [stratum]):
        place = F.row_number().over(Window.partitionBy(*part).orderBy(seeded_order(F.col(key), seed), key))
        rows = rows.withColumn("__place", place).filter("__place <= __take")
    return rows.select(*df.columns)
