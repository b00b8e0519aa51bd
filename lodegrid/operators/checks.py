"""Integrity rules as data: each is a query for its violations, and all give one table (rule, item, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.operators import phrases


def rows_failing(df: DataFrame, rule: str, fails: Column, item: str, detail: Column | None = None) -> DataFrame:
    return df.filter(F.coalesce(fails, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(item).cast("string").alias("item"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def not_null(df: DataFrame, rule: str, columns: list[str], item: str) -> DataFrame:
    blank = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in columns]
    return rows_failing(df, rule, F.size(F.array_compact(F.array(*blank))) > 0, item, F.array_join(F.array_compact(F.array(*blank)), ","))


def in_vocabulary(df: DataFrame, rule: str, column: str, values: list[str], item: str) -> DataFrame:
    return rows_failing(df, rule, F.col(column).isNotNull() & ~F.col(column).isin(values), item, F.col(column))


def unique(df: DataFrame, rule: str, key: str) -> DataFrame:
    many = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return rows_failing(many, rule, F.lit(True), key, F.col("n"))


def resolves(df: DataFrame, rule: str, column: str, target: DataFrame, key: str) -> DataFrame:
    """Each value of the column exists in the target."""
    known = target.select(F.col(key).alias("__k")).distinct()
    lost = df.filter(F.col(column).isNotNull()).select(column).distinct().join(known, F.col(column) == F.col("__k"), "left_anti")
    return rows_failing(lost, rule, F.lit(True), column)


def once_each(pairs: DataFrame, rule: str, member: str, expected: DataFrame, key: str) -> DataFrame:
    """A partition: each expected key is in exactly one group."""
    n = expected.select(F.col(key).alias("__k")).distinct().join(pairs.groupBy(F.col(member).alias("__m")).agg(F.count("*").alias("n")), F.col("__k") == F.col("__m"), "left")
    return rows_failing(n, rule, F.coalesce("n", F.lit(0)) != 1, "__k", F.coalesce("n", F.lit(0)))


def measure(df: DataFrame, rule: str, value: Column, low: float | None = None, high: float | None = None) -> DataFrame:
    """One figure of the whole table lies between the bounds; no figure at all fails."""
    one = df.agg(value.cast("double").alias("v"))
    bad = F.col("v").isNull()
    bad = bad | (F.col("v") < low) if low is not None else bad
    bad = bad | (F.col("v") > high) if high is not None else bad
    return one.filter(bad).select(F.lit(rule).alias("rule"), F.lit("").alias("item"), F.format_string("%s", F.col("v").cast("string")).alias("detail"))


def unchanged(before: DataFrame, after: DataFrame, rule: str, key: str) -> DataFrame:
    """No row is lost or added, and no column of ``before`` differs in ``after``."""
    now = after.select(*before.columns)
    moved = before.exceptAll(now).select(key).unionByName(now.exceptAll(before).select(key)).distinct()
    return rows_failing(moved, rule, F.lit(True), key)


def has_columns(df: DataFrame, rule: str, columns: list[str]) -> DataFrame:
    lost = [(rule, c, "missing column") for c in columns if c not in df.columns]
    return df.sparkSession.createDataFrame(lost, "rule string, item string, detail string")


def mentions(texts: DataFrame, rule: str, text: str, wanted: DataFrame, key: str) -> DataFrame:
    """Each wanted phrase is in at least one of the texts, in any case of letters; a null phrase is in none."""
    lower = F.lower(F.col(key))
    there = phrases.found(texts.select(F.lower(F.col(text)).alias("t")), "t", wanted.select(lower.alias("p")), "p")
    return rows_failing(wanted.join(there.toDF("__found"), lower == F.col("__found"), "left_anti"), rule, F.lit(True), key)


def mentioned_together(texts: DataFrame, rule: str, text: str, pairs: DataFrame, one: str, other: str) -> DataFrame:
    """Each pair of phrases is in one and the same text, in any case of letters."""
    low = lambda c: F.lower(F.col(c))
    there = phrases.found_together(texts.select(low(text).alias("t")), "t", pairs.select(low(one).alias("a"), low(other).alias("b")), "a", "b")
    there = there.toDF("__one", "__other")
    lost = pairs.join(there, (low(one) == F.col("__one")) & (low(other) == F.col("__other")), "left_anti")
    return rows_failing(lost.withColumn("__pair", F.concat_ws(" x ", one, other)), rule, F.lit(True), "__pair")


def has_headings(texts: DataFrame, rule: str, item: str, text: str, headings: list[str]) -> DataFrame:
    """Each text has a Markdown heading that begins with each of the titles."""
    lost = [F.when(~F.coalesce(F.col(text), F.lit("")).rlike(rf"(?m)^#+ +\Q{h}\E"), F.lit(h)) for h in headings]
    missing = F.array_compact(F.array(*lost))
    return rows_failing(texts, rule, F.size(missing) > 0, item, F.array_join(missing, ","))


def files_present(files: DataFrame, rule: str, wanted: DataFrame, least_bytes: int = 1) -> DataFrame:
    """Each wanted name (name) is among the files (name, length), and no wanted one is shorter than so many bytes."""
    found = wanted.select("name").distinct().join(files.groupBy("name").agg(F.max("length").alias("length")), "name", "left")
    short = F.coalesce(F.col("length"), F.lit(-1)) < least_bytes
    return rows_failing(found, rule, short, "name", F.when(F.col("length").isNull(), "missing").otherwise(F.col("length").cast("string")))


def at_least(df: DataFrame, rule: str, group: str, entity: str, groups: DataFrame, least: int) -> DataFrame:
    """Each declared group has so many distinct entities."""
    n = groups.select(group).distinct().join(df.groupBy(group).agg(F.count_distinct(entity).alias("n")), group, "left")
    return rows_failing(n, rule, F.coalesce("n", F.lit(0)) < least, group, F.coalesce("n", F.lit(0)))


def file_is_valid(files: DataFrame, rule: str, magic: bytes = b"%PDF", least_bytes: int = 10_000) -> DataFrame:
    """Rows of the binaryFile source (path, length, content) that are too short or begin otherwise."""
    start = F.substring("content", 1, len(magic))
    return rows_failing(files, rule, (F.col("length") < least_bytes) | (start != F.lit(magic)), "path", F.col("length"))


def violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
