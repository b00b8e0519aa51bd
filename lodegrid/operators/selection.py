"""Exact order statistics of any number of values: brackets from mergeable sketches, exact counts, until few values are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.session import scratch

#: Distinct values of a group that are sorted in one buffer.
MOST_VALUES = 10_000
#: A sketch misses a rank by one part in so many, at most; it keeps about as many values.
ACCURACY = 2_000


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_ranks(values: DataFrame, value: str, targets: DataFrame, by: list[str], count: str | None = None) -> DataFrame:
    """targets plus ``found``: of each group (columns ``by``, maybe none) the value at place ``k`` (from 0) of its sorted ones.

    ``targets`` has the columns by, target (a name unique in its group) and k, 0 <= k < values of the group. Null values
    don't count; with ``count`` a row stands for so many. A round brackets each open target by two quantiles of a sketch, counts exactly how many values lie below,
    at and between them, and so either names the value or goes on with the values strictly between. No buffer holds more
    than a sketch or MOST_VALUES distinct values, whatever the size of a group.
    """
    rows = values.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg((F.sum(count) if count else F.count("*")).alias("n"))
    rows, keys = _kept(rows), [*by, "target"]
    kind = rows.schema["v"].dataType
    still = targets.select(*keys, F.col("k").cast("long").alias("k"), F.lit(None).cast(kind).alias("low"), F.lit(None).cast(kind).alias("high"))
    done: list[DataFrame] = []
    while True:
        inside = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
        active = (rows.join(still, by) if by else rows.crossJoin(F.broadcast(still))).filter(inside).select(*keys, "k", "low", "high", "v", "n")
        sizes = _kept(active.groupBy(*keys).agg(F.count("*").alias("values")))
        # Few values: sorted with their counts, the first one whose running count is beyond the rank.
        few = active.join(sizes.filter(F.col("values") <= MOST_VALUES), keys)
        lists = few.groupBy(*keys).agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("v", "n"))).alias("vs"))
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast(kind).alias("at"))
        state = F.aggregate("vs", start, lambda s, x: F.struct((s["sum"] + x["n"]).alias("sum"), F.when((s["sum"] <= F.col("k")) & (s["sum"] + x["n"] > F.col("k")), x["v"]).otherwise(s["at"]).alias("at")))
        done.append(_kept(lists.select(*keys, state["at"].alias("found"))))
        if sizes.filter(F.col("values") > MOST_VALUES).isEmpty():
            break
        many = active.join(sizes.filter(F.col("values") > MOST_VALUES), keys)
        # The sketch is one of distinct values: it only has to part them, the counts are exact. Slot s holds (cut s - 1, cut s].
        sketch = many.groupBy(*keys).agg(F.percentile_approx("v", [x / 64 for x in range(65)], ACCURACY).alias("cuts"))
        cut = many.join(sketch, keys).withColumn("slot", F.size(F.filter("cuts", lambda c: c < F.col("v"))))
        at_cut = F.sum(F.when(F.col("v") == F.get("cuts", "slot"), F.col("n")).otherwise(0)).alias("at_cut")
        same = [F.first(c).alias(c) for c in ("k", "cuts", "low", "high")]
        slots = cut.groupBy(*keys, "slot").agg(F.sum("n").alias("n"), at_cut, *same)
        listed = slots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", "n", "at_cut"))).alias("slots"), *same)
        names = ("slot", "before", "size", "at_cut")
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("slot"), *[F.lit(0).cast("long").alias(c) for c in names[1:]])

        def step(s: Column, x: Column) -> Column:
            hit = (s["sum"] <= F.col("k")) & (s["sum"] + x["n"] > F.col("k"))
            now = {"slot": x["slot"], "before": s["sum"], "size": x["n"], "at_cut": x["at_cut"]}
            return F.struct((s["sum"] + x["n"]).alias("sum"), *[F.when(hit, now[c]).otherwise(s[c]).alias(c) for c in names])

        picked = _kept(listed.withColumn("p", F.aggregate("slots", zero, step)).select(*keys, "k", "cuts", "low", "high", "p"))
        within, end = F.col("k") - F.col("p.before"), F.get("cuts", F.col("p.slot"))
        named = within >= F.col("p.size") - F.col("p.at_cut")  # values at the cut come last in their slot
        done.append(picked.filter(named).select(*keys, end.alias("found")))
        lower = F.when(F.col("p.slot") > 0, F.get("cuts", F.col("p.slot") - 1)).otherwise(F.col("low"))
        still = _kept(picked.filter(~named).select(*keys, within.alias("k"), lower.alias("low"), F.coalesce(end, "high").alias("high")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return targets.join(out, keys)


def percentiles(df: DataFrame, value: Column, fractions: list[float], by: list[str] | None = None) -> DataFrame:
    """by, fraction, percentile: linearly interpolated, as ``percentile`` does, of the values that aren't null; groups without any are left out."""
    by = by or []
    values = df.select(*by, value.alias("value")).filter("value is not null")
    distinct = _kept(values.groupBy(*by, "value").agg(F.count("*").alias("n")))
    if distinct.limit(MOST_VALUES + 1).count() <= MOST_VALUES:  # few values in all: one aggregation of them
        shares = [float(f) for f in fractions]
        lists = distinct.groupBy(*by).agg(F.percentile("value", shares, F.col("n")).alias("ps"))
        pairs = F.arrays_zip(F.array(*[F.lit(f) for f in shares]).alias("fraction"), F.col("ps").alias("percentile"))
        return lists.filter("ps is not null").select(*by, F.explode(pairs).alias("x")).select(*by, F.col("x.fraction").alias("fraction"), F.col("x.percentile").alias("percentile"))
    counts = distinct.groupBy(*by).agg(F.sum("n").alias("n"))
    at = F.col("fraction") * (F.col("n") - 1)
    wanted = counts.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn("at", at)
    wanted = _kept(wanted.withColumn("k", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).withColumn("target", F.concat_ws(" ", F.col("fraction").cast("string"), F.col("k").cast("string"))))
    found = at_ranks(distinct, "value", wanted, by, "n").withColumn("found", F.col("found").cast("double"))
    share = F.when(F.floor("at") == F.ceil("at"), 1.0).when(F.col("k") == F.floor("at"), F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    return found.groupBy(*by, "fraction").agg(F.sum(share * F.col("found")).alias("percentile"))
