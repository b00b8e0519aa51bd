"""Counting: zero-filled grids, cross-tabs of multi-valued facets, thresholds, agreement, funnels, coverage.

Null keys never count as a group of their own; grids and axes are declared, and what lies outside is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.operators.selection import at_ranks, percentiles


def distinct_per_group(df: DataFrame, keys: list[str], entity: str, name: str = "n") -> DataFrame:
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count_distinct(entity).alias(name))


def zero_filled(counts: DataFrame, rows: DataFrame, columns: DataFrame, name: str = "n") -> DataFrame:
    """Every cell of two declared axes (one column each, unique), 0 where ``counts`` has none."""
    grid = rows.crossJoin(columns)
    return grid.join(counts, [*rows.columns, *columns.columns], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def threshold(counts: DataFrame, quantile: float, name: str = "n", by: list[str] | None = None) -> DataFrame:
    """Linear-interpolated quantile of the non-zero cells, 0.0 if there are none; a row, or a row per group."""
    cells = F.when(F.col(name) > 0, F.col(name))
    found = percentiles(counts, cells, [quantile], by)
    if not by:
        return found.agg(F.coalesce(F.max("percentile"), F.lit(0.0)).alias("threshold"))
    groups = counts.select(*by).distinct()
    return groups.join(found, by, "left").select(*by, F.coalesce("percentile", F.lit(0.0)).alias("threshold"))


def flagged(counts: DataFrame, thresholds: DataFrame, name: str = "n", by: list[str] | None = None) -> DataFrame:
    """is_empty: no evidence; is_gap: some, but no more than the threshold. Never both."""
    joined = counts.join(thresholds, by) if by else counts.crossJoin(thresholds)
    return joined.withColumn("is_empty", F.col(name) == 0).withColumn("is_gap", (F.col(name) > 0) & (F.col(name) <= F.col("threshold")))


def threshold_sweep(counts: DataFrame, quantiles: list[float], name: str = "n") -> DataFrame:
    """quantile, threshold, gaps, empties, normals: one pass over the cells for all quantiles."""
    levels = percentiles(counts, F.when(F.col(name) > 0, F.col(name)), quantiles).select(F.col("fraction").alias("quantile"), F.col("percentile").alias("threshold"))
    cell = F.col(name)
    return (
        counts.crossJoin(F.broadcast(levels.select("quantile", "threshold")))
        .groupBy("quantile", "threshold")
        .agg(F.count_if((cell > 0) & (cell <= F.col("threshold"))).alias("gaps"), F.count_if(cell == 0).alias("empties"), F.count_if(cell > F.col("threshold")).alias("normals"))
    )


def threshold_flips(counts: DataFrame, cells: list[str], base: float, other: float, name: str = "n") -> DataFrame:
    """cells, n, was, now of what another quantile calls otherwise: gap or normal; empty cells stay empty."""
    found = percentiles(counts, F.when(F.col(name) > 0, F.col(name)), [base, other])
    levels = found.agg(F.array(*[F.max(F.when(F.col("fraction") == float(q), F.col("percentile"))) for q in (base, other)]).alias("__v"))
    state = lambda at: F.when(F.col(name) == 0, "empty").when(F.col(name) <= F.col("__v")[at], "gap").otherwise("normal")
    out = counts.crossJoin(F.broadcast(levels)).select(*cells, name, state(0).alias("was"), state(1).alias("now"))
    return out.filter("was != now")


def prioritised(gaps: DataFrame, prevalence: str, name: str = "n") -> DataFrame:
    """shortfall = (threshold - n) / threshold, priority = shortfall * prevalence; 0 where the threshold is 0."""
    short = F.when(F.col("threshold") > 0, (F.col("threshold") - F.col(name)) / F.col("threshold")).otherwise(0.0)
    return gaps.withColumn("shortfall", short).withColumn("priority", short * F.col(prevalence))


def crosstab(df: DataFrame, row: str, column: str, entity: str, columns: list[str], rows: DataFrame | None = None) -> DataFrame:
    """Distinct entities by row and declared column values; absent cells are 0. ``rows`` declares the row axis."""
    cells = df.filter(F.col(row).isNotNull() & F.col(column).isin(columns))
    out = cells.groupBy(row).pivot(column, columns).agg(F.count_distinct(entity))
    if rows is not None:
        out = rows.join(out, row, "left")
    return out.na.fill(0, columns)


def with_share(df: DataFrame, part: str, whole: str, name: str = "share") -> DataFrame:
    return df.withColumn(name, F.coalesce(F.try_divide(F.col(part) * 100.0, F.col(whole)), F.lit(0.0)))


def footer(df: DataFrame, column: str, entity: str) -> DataFrame:
    """Entities with any value at all in the column."""
    return df.filter(F.col(column).isNotNull()).agg(F.count_distinct(entity).alias("unique_entities"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Most frequent first, equal ones by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def tally(df: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """One row with a count for each kind, also for kinds that never occur."""
    return df.agg(*[F.count_if(F.col(column) == k).alias(k) for k in kinds])


def summary(df: DataFrame, column: str) -> DataFrame:
    """lowest, highest, average, upper_median: the value at place n // 2 of the sorted ones."""
    v = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    place = v.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("median").alias("target"), F.floor(F.col("n") / 2).alias("k"))
    middle = at_ranks(v, "v", place, []).agg(F.max("found").alias("upper_median"))
    return v.agg(F.min("v").alias("lowest"), F.max("v").alias("highest"), F.avg("v").alias("average")).crossJoin(middle)


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """bucket (its lower edge, the last one open), n: half-open buckets, empty ones too; values below the first edge are left out."""
    lower = F.array_max(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(column)))
    counts = df.select(lower.alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    axis = df.sparkSession.createDataFrame([(float(e),) for e in edges], "bucket double")
    return axis.join(counts, "bucket", "left").na.fill(0, ["n"])


def agreement(pairs: DataFrame, first: str, second: str, positive: str = "include", negative: str = "exclude") -> DataFrame:
    """n, agreements, n_binary, kappa. All pairs count for agreement; kappa only pairs of the two decisions, null if chance alone would agree or none are left."""
    both = F.col(first).isin(positive, negative) & F.col(second).isin(positive, negative)
    share = lambda c: F.avg(F.when(both, c.cast("double")))
    out = pairs.agg(
        F.count("*").alias("n"), F.count_if(F.col(first) == F.col(second)).alias("agreements"), F.count_if(both).alias("n_binary"),
        share(F.col(first) == F.col(second)).alias("po"), share(F.col(first) == positive).alias("p1"), share(F.col(second) == positive).alias("p2"),
    )
    chance = F.col("p1") * F.col("p2") + (1 - F.col("p1")) * (1 - F.col("p2"))
    return out.withColumn("kappa", F.when(chance < 1, (F.col("po") - chance) / (1 - chance))).select("n", "agreements", "n_binary", "kappa")


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """stage, at, n_in, n_out, removed: each stage keeps rows for which its condition and all before are true. One pass."""
    kept, sums = F.lit(True), [F.count("*").alias("s0")]
    for k, (_, condition) in enumerate(stages, 1):
        kept = kept & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(kept).alias(f"s{k}"))
    rows = [F.struct(F.lit(name).alias("stage"), F.lit(k).alias("at"), F.col(f"s{k - 1}").alias("n_in"), F.col(f"s{k}").alias("n_out")) for k, (name, _) in enumerate(stages, 1)]
    return df.agg(*sums).select(F.inline(F.array(*rows))).withColumn("removed", F.col("n_in") - F.col("n_out"))


def breakdown(df: DataFrame, column: str) -> DataFrame:
    """column, n, percent of all rows that have a value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))))


def coverage(df: DataFrame, columns: list[str], subset: Column | None = None) -> DataFrame:
    """column_name, filled, total: cells that aren't null or blank, in the subset."""
    rows = df.filter(subset) if subset is not None else df
    filled = [F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").alias(c) for c in columns]
    one = rows.agg(F.count("*").alias("__total"), *filled)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled"), F.col("__total").alias("total")) for c in columns])))


def lookup_coverage(df: DataFrame, source: str, differs: Column, status: str = "lookup") -> DataFrame:
    """status, source, n, deltas: rows by outcome of a lookup and by source, and how many of the matched ones differ from what was found."""
    return df.groupBy(status, source).agg(F.count("*").alias("n"), F.count_if((F.col(status) == "matched") & differs).alias("deltas"))


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, value, n for several columns at once, by grouping sets."""
    view = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    out = view.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    which = F.lit(None).cast("string")
    for k, c in enumerate(columns):
        which = F.when(F.col("gid") == F.lit((1 << len(columns)) - 1 - (1 << (len(columns) - 1 - k))), F.lit(c)).otherwise(which)
    return out.select(which.alias("column_name"), F.coalesce(*columns).alias("value"), "n").filter("value is not null")


def verdicts(checks: DataFrame, entity: str, question: str = "rqs") -> dict[str, DataFrame]:
    """Failures of checks (entity, check_id, category, rqs, verdict): by verdict, category, question, check, and the worst entities."""
    failed = checks.filter("verdict = 'fail'")
    return {
        "by_verdict": value_counts(checks, "verdict"),
        "by_category": value_counts(failed, "category"),
        "by_question": value_counts(failed.withColumn("question", F.explode(F.split(question, r"\|"))), "question"),
        "by_check": value_counts(failed, "check_id"),
        "worst": failed.groupBy(entity).agg(F.count("*").alias("n")).orderBy(F.desc("n"), entity).limit(20),
    }


def cost(df: DataFrame, tokens_in: str, tokens_out: str, price_in: float, price_out: float) -> DataFrame:
    """Sum of tokens times prices per million."""
    return df.agg((F.coalesce(F.sum(F.col(tokens_in) * price_in + F.col(tokens_out) * price_out), F.lit(0.0)) / 1e6).alias("cost"))
