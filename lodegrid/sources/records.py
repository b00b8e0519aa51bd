"""Nested answers of metadata services as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.functions import keys as K
from lodegrid.functions.text import rebuilt_text

WORK_SCHEMA = (
    "doi string, title string, publication_year int, type string, is_retracted boolean, is_paratext boolean, cited_by_count int, "
    "authorships array<struct<author: struct<display_name: string>>>, primary_location struct<source: struct<display_name: string, type: string>>, abstract_inverted_index map<string, array<int>>"
)
ENTRY_SCHEMA = "`dc:title` string, `prism:doi` string, `prism:coverDate` string, `prism:pageRange` string, `prism:issn` string, `prism:publicationName` string, subtypeDescription string, `citedby-count` string, authkeywords string"


def works(df: DataFrame, column: str) -> DataFrame:
    """Flat rows of works: doi, title, year, kind, retracted, paratext, cited_by, authors, source, source_kind, abstract."""
    w = df.withColumn("w", F.from_json(column, WORK_SCHEMA)).filter("w is not null")
    names = F.array_join(F.transform("w.authorships", lambda a: a["author"]["display_name"]), "; ")
    return w.select(
        K.doi_for_lookup(F.col("w.doi")).alias("doi"), F.col("w.title").alias("title"), F.col("w.publication_year").alias("year"), F.col("w.type").alias("kind"), F.coalesce("w.is_retracted", F.lit(False)).alias("retracted"),
        F.coalesce("w.is_paratext", F.lit(False)).alias("paratext"), F.col("w.cited_by_count").alias("cited_by"), F.coalesce(names, F.lit("")).alias("authors"), F.col("w.primary_location.source.display_name").alias("source"),
        F.col("w.primary_location.source.type").alias("source_kind"), F.coalesce(rebuilt_text(F.col("w.abstract_inverted_index")), F.lit("")).alias("abstract"),
    )


def search_entries(df: DataFrame, column: str) -> DataFrame:
    e = df.withColumn("e", F.from_json(column, ENTRY_SCHEMA)).filter("e is not null")
    get = lambda name: F.col("e").getField(name)
    return e.select(
        F.coalesce(get("prism:doi"), F.lit("")).alias("doi"), get("dc:title").alias("title"), F.substring(get("prism:coverDate"), 1, 4).try_cast("int").alias("year"), get("prism:pageRange").alias("pageRange"),
        get("prism:issn").alias("issn"), get("prism:publicationName").alias("source"), get("subtypeDescription").alias("doctype"), get("citedby-count").try_cast("int").alias("cited_by"), F.array_join(F.transform(F.split(F.coalesce(get("authkeywords"), F.lit("")), r"\|"), lambda x: F.trim(x)), "; ").alias("keywords"),
    )


def flags(kind: Column, source_kind: Column, doctype: Column, retracted: Column, paratext: Column) -> dict[str, Column]:
    """The kind of source and the kind of document disagree; it's a preprint; it's retracted; it isn't a paper."""
    d = F.lower(F.coalesce(doctype, F.lit("")))
    mismatch = (d.contains("conference") & (source_kind == "journal")) | (d.contains("article") & (source_kind == "conference"))
    return {"source_mismatch": F.coalesce(mismatch, F.lit(False)), "preprint": F.coalesce((kind == "preprint") | (source_kind == "repository"), F.lit(False)), "retracted": F.coalesce(retracted, F.lit(False)), "paratext": F.coalesce(paratext, F.lit(False))}


def batch_results(df: DataFrame, column: str, definitions: DataFrame) -> DataFrame:
    """custom_id, check_id, verdict, reason and the definition's columns, a row per check of each JSON answer."""
    schema = "custom_id string, checks array<struct<check_id: string, verdict: string, reason: string>>"
    rows = df.withColumn("r", F.from_json(column, schema)).select("r.custom_id", F.explode("r.checks").alias("c")).select("custom_id", "c.*")
    return rows.join(definitions, "check_id", "left")
