"""Building a corpus of records: lookups, ranks, leaders, page filter, funnel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.functions import keys as K
from lodegrid.functions import text as T
from lodegrid.operators import aggregates as A
from lodegrid.operators import dedup as D
from lodegrid.operators import joins as J


def united(sources: list[DataFrame]) -> DataFrame:
    """All rows of all sources; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def lookup_keys(df: DataFrame, doi: str = "doi") -> DataFrame:
    """The distinct DOIs to look up."""
    return df.select(K.doi_for_lookup(F.col(doi)).alias("doi")).filter("doi != ''").distinct()


def enriched(df: DataFrame, works: DataFrame) -> DataFrame:
    """Records with their work's columns (work_*), and the abstract filled from it."""
    keyed = df.withColumn("__doi", F.nullif(K.doi_for_lookup(F.col("doi")), F.lit("")))
    columns = [c for c in works.columns if c != "doi"]
    table = J.one_per_key(works, ["doi"], [F.col("title")]).select("doi", *[F.col(c).alias(f"work_{c}") for c in columns]).withColumnRenamed("doi", "__key_doi")
    out = J.lookup_with_status(keyed, "__doi", table, "__key_doi", [f"work_{c}" for c in columns]).drop("__doi")
    return out.withColumn("abstract", F.coalesce(F.nullif(F.trim("abstract"), F.lit("")), "work_abstract"))


def deduplicated(df: DataFrame) -> DataFrame:
    """One record per DOI, or per title, year and surname: see operators.dedup."""
    score = D.record_score("abstract", "pageRange", "rank", "search_path")
    return D.deduplicated(df, K.doi_for_dedup(F.col("doi")), K.fallback_digest(F.col("title"), F.col("year"), F.col("authors")), score, "row_idx", "search_path")


def page_filtered(df: DataFrame, least: int = 4) -> DataFrame:
    return df.withColumn("page_count", T.page_count(F.col("pageRange"))).withColumn("page_status", T.three_way(F.col("page_count"), least))


def screenable(df: DataFrame) -> DataFrame:
    """All but those that fail; what is unknown stays."""
    return df.filter(F.col("page_status").isNull() | (F.col("page_status") != "fail"))


def flow(df: DataFrame) -> DataFrame:
    """The funnel of a table with is_leader, page_status and decision."""
    return A.funnel(df, [("unique", F.col("is_leader")), ("long enough", F.coalesce(F.col("page_status") != "fail", F.lit(True))), ("included", F.col("decision") == "include")])
