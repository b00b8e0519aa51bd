"""Leader election and merging of records that share a key.

The leader is found by max_by over a score, which combines on the map side: a key with very many rows
sends one candidate a task, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Characters of a digest that names of groups show.
SHOWN = 12


def leaders(df: DataFrame, key: str, score: list[Column], row_idx: str, provenance: str | None = None, joiner: str = "+") -> DataFrame:
    """The best row of each key by the scores in turn, ties to the lowest row_idx; null keys are left out.

    With ``provenance``, that column becomes the sorted distinct values of the group, joined. group_size is added.
    """
    known = df.filter(F.col(key).isNotNull())
    rank = F.struct(*score, (-F.col(row_idx)).alias("__idx"))
    aggregates = [F.max_by(F.struct(*df.columns), rank).alias("__best"), F.count("*").alias("group_size")]
    if provenance:
        values = F.filter(F.collect_set(provenance), lambda x: x != "")
        aggregates.append(F.array_join(F.array_sort(values), joiner).alias("__prov"))
    out = known.groupBy(key).agg(*aggregates)
    columns = [F.col("__prov").alias(c) if c == provenance else F.col(f"__best.{c}").alias(c) for c in df.columns]
    return out.select(*columns, "group_size")


def record_score(abstract: str, pages: str, rank: str, source: str, preferred: str = "A") -> list[Column]:
    """Has an abstract, has pages, rank of its venue, comes from the preferred source."""
    filled = lambda c: (F.coalesce(F.col(c), F.lit("")) != "").cast("int")
    # Ranks.
    level = F.when(F.col(rank) == "A*", 3).when(F.col(rank) == "A", 2).when(F.col(rank) == "B", 1).otherwise(0)
    return [filled(abstract).alias("s1"), filled(pages).alias("s2"), level.alias("s3"), (F.trim(F.col(source)) == preferred).cast("int").alias("s4")]


def deduplicated(df: DataFrame, key: Column, fallback: Column, score: list[Column], row_idx: str, provenance: str | None = None) -> DataFrame:
    """Leaders by the key, and by the fallback key where there is none; dedup_group names the key that was used.

    Rows are grouped by the whole fallback key, a digest; only its first SHOWN characters are shown, so two groups may look alike.
    """
    group = lambda shown: F.coalesce(F.concat(F.lit("doi:"), key), F.concat(F.lit("fallback:"), shown))
    keyed = df.withColumns({"dedup_group": group(F.substring(fallback, 1, SHOWN)), "__group": group(fallback)})
    return leaders(keyed, "__group", score, row_idx, provenance).drop("__group")


def first_wins(df: DataFrame, key: Column, row_idx: str) -> DataFrame:
    """The first row of each key, and all rows without one."""
    keyed = df.withColumn("__key", F.nullif(key, F.lit("")))
    first = keyed.filter("__key is not null").groupBy("__key").agg(F.min_by(F.struct(*df.columns), row_idx).alias("r")).select("r.*")
    return first.unionByName(keyed.filter("__key is null").drop("__key"))


def merged_references(refs: DataFrame, key: str, seed: str, row_idx: str, joiner: str = "|") -> DataFrame:
    """The first row of each key with the union of all seeds; rows with a null key are dropped. key is reference_key's."""
    known = refs.filter(F.col(key).isNotNull())
    seeds = F.array_join(F.array_sort(F.filter(F.collect_set(seed), lambda x: x != "")), joiner)
    out = known.groupBy(key).agg(F.min_by(F.struct(*refs.columns), row_idx).alias("r"), seeds.alias("__seeds"))
    return out.select(*[F.col("__seeds").alias(c) if c == seed else F.col(f"r.{c}").alias(c) for c in refs.columns])
