"""Definitions of done: what must hold of each phase's tables. Every function gives a table of violations (rule, item, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.functions import keys as K
from lodegrid.functions import text as T
from lodegrid.operators import checks as Q
from lodegrid.operators import windows as W

# Vocabularies.
DECISIONS = ["include", "exclude", "defer"]
CRITERIA = ["EC1", "EC2", "EC3", "EC4", "EC5", "EC6"]
CLASSES = ["evaluation", "validation", "solution", "philosophical", "opinion", "experience"]
NEEDS_CLASS = ["EC1", "EC2"]
STATUSES = ["already_included", "already_decided", "new_include", "new_exclude", "unresolved"]


def screening(candidates: DataFrame, decisions: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Each candidate is decided once; exclusions name a criterion, and inclusions and some exclusions a class; nothing is deferred."""
    excluded, d = F.col("decision") == "exclude", decisions
    needs = (F.col("decision") == "include") | F.col("criterion").isin(NEEDS_CLASS)
    return Q.violations(
        Q.once_each(d, "decided once", id_col, candidates, id_col),
        Q.in_vocabulary(d, "known decision", "decision", DECISIONS, id_col),
        Q.rows_failing(d, "exclusion has a criterion", excluded & ~F.coalesce(F.col("criterion").isin(CRITERIA), F.lit(False)), id_col),
        Q.rows_failing(d, "class is given", needs & ~F.coalesce(F.lower("class").isin(CLASSES), F.lit(False)), id_col),
        Q.rows_failing(d, "deferred", F.col("decision") == "defer", id_col),
    )


def snowballing(refs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Known states, all seeds seen, each DOI once."""
    seen = refs.select(F.explode(T.cells(F.col("source_seed"))).alias("seed"))
    return Q.violations(
        Q.not_null(refs, "status present", ["status"], "ref_id"),
        Q.in_vocabulary(refs, "known status", "status", STATUSES, "ref_id"),
        Q.unique(refs.withColumn("doi", F.nullif(F.trim("doi"), F.lit(""))), "DOI once", "doi"),
        Q.resolves(seeds, "seed seen", "seed", seen, "seed"),
    )


def match_rate(records: DataFrame, least: float = 0.95) -> DataFrame:
    """Share of distinct DOIs that were found."""
    doi = F.nullif(K.doi_for_lookup(F.col("doi")), F.lit(""))
    found = F.count_distinct(F.when(F.col("lookup") == "matched", doi))
    return Q.measure(records, "match rate", F.try_divide(found, F.count_distinct(doi)), least)


def enrichment(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return Q.unchanged(before, after, "original columns unchanged", key)


def extraction(matrix: DataFrame, facets: list[str], passages: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """All facets filled, and passages for each paper."""
    return Q.violations(Q.not_null(matrix, "facets filled", facets, id_col), Q.resolves(matrix.withColumn("file", K.file_safe(F.col(id_col))), "passages exist", "file", passages, "file"))


def consolidation(codes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each code (code) in one cluster (canonical_label, codes as a JSON list); labels are unique and well formed; passage ids are valid; someone confirmed."""
    from lodegrid.operators.clustering import is_well_formed

    members = clusters.select("canonical_label", F.explode(T.json_strings(F.col("codes"))).alias("code"))
    passages = clusters.select("canonical_label", F.explode(T.json_strings(F.col("passage_ids"))).alias("passage"))
    return Q.violations(
        Q.once_each(members, "code in one cluster", "code", codes, "code"),
        Q.unique(clusters, "label once", "canonical_label"),
        Q.rows_failing(clusters, "label well formed", ~is_well_formed(F.col("canonical_label")), "canonical_label"),
        Q.rows_failing(passages, "passage id valid", ~K.passage_is_valid(F.col("passage")), "passage"),
        Q.not_null(clusters, "confirmed", ["confirmed_by"], "canonical_label"),
    )


def classification(labels: DataFrame, assigned: DataFrame, modes: list[str], low: float = 0.005, high: float = 0.05) -> DataFrame:
    """Each label has one known mode; the share of modes among labels lies in a band."""
    return Q.violations(
        Q.once_each(assigned, "label has one mode", "canonical_label", labels, "canonical_label"),
        Q.in_vocabulary(assigned, "known mode", "mode", modes, "canonical_label"),
        Q.measure(assigned, "modes to labels", F.count_distinct("mode") / F.count("*"), low, high),
    )


def taxonomy(texts: DataFrame, headings: list[str], traces: DataFrame, passages: DataFrame, labels: DataFrame, assigned: DataFrame, modes: list[str], overlaps: DataFrame, verdicts: DataFrame) -> DataFrame:
    """classification, and: texts (file, text) have their headings, traces (passage) resolve, nothing is copied verbatim (overlaps: target_id, ngram), and no verdict (item, verdict) is a failure."""
    return Q.violations(
        classification(labels, assigned, modes),
        Q.has_headings(texts, "headings", "file", "text", headings),
        Q.resolves(traces, "trace resolves", "passage", passages, "passage"),
        Q.rows_failing(overlaps, "verbatim", F.lit(True), "target_id", F.col("ngram")),
        Q.rows_failing(verdicts, "verdict", F.col("verdict") == "fail", "item"),
    )


def crosstabs(footers: DataFrame, low: int = 150, high: int = 310) -> DataFrame:
    """Rows (name, unique_entities) lie in the band."""
    return Q.rows_failing(footers, "entities in band", ~F.col("unique_entities").between(low, high), "name", F.col("unique_entities"))


def gap_matrix(matrix: DataFrame, cells: int, register: DataFrame, kind: str = "gap_identified") -> DataFrame:
    """All cells, no cell both empty and a gap, and an event for each gap."""
    gaps = matrix.agg(F.count_if("is_gap").alias("n")).crossJoin(register.filter(F.col("kind") == kind).agg(F.count("*").alias("logged")))
    return Q.violations(
        Q.has_columns(matrix, "columns", ["n", "is_gap", "is_empty", "threshold"]),
        Q.measure(matrix, "cells", F.count("*"), cells, cells),
        Q.rows_failing(matrix.withColumn("cell", F.concat_ws(" x ", *[F.col(c).cast("string") for c in matrix.columns[:2]])), "empty or gap", F.col("is_gap") & F.col("is_empty"), "cell"),
        Q.rows_failing(gaps, "gaps logged", F.col("n") != F.col("logged"), "n", F.col("logged")),
    )


def saturation(curve: DataFrame, most: int) -> DataFrame:
    """The curve never falls, ends at or below the number of labels, and has a final window."""
    falls = W.order_violations(curve, "rank", "cumulative_count")
    return Q.violations(Q.rows_failing(falls, "never falls", F.lit(True), "rank"), Q.measure(curve, "total", F.max("cumulative_count"), None, most), Q.measure(curve, "final window", F.count_if("in_final_window"), 1))


def bibliography(texts: DataFrame, entries: DataFrame, least: int = 15) -> DataFrame:
    """Every key that is cited in brackets is defined, and there are enough entries."""
    cited = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\[([a-z][a-z0-9_;\s]+)\]"), 1)).alias("inner")).select(F.explode(T.cells(F.col("inner"), ";")).alias("citekey"))
    return Q.violations(Q.resolves(cited, "key defined", "citekey", entries, "citekey"), Q.measure(entries, "entries", F.count("*"), least))


def bibliography_files(files: DataFrame, wanted: DataFrame, least_bytes: int, listed: DataFrame, archived: DataFrame) -> DataFrame:
    """The wanted files (name) are there and large enough (files: name, length), and the archive's list (name) has all that belong in it."""
    return Q.violations(Q.files_present(files, "file present", wanted, least_bytes), Q.resolves(listed, "in archive", "name", archived, "name"))


def trust(mode_passages: DataFrame, modes: DataFrame, texts: DataFrame, phrases: DataFrame, least: int = 2) -> DataFrame:
    """Each mode is backed by passages, and each phrase (gap pairs, headings, thresholds, boundaries) is mentioned."""
    return Q.violations(Q.at_least(mode_passages, "passages a mode", "mode", "passage", modes, least), Q.mentions(texts, "mentioned", "text", phrases, "phrase"))


def invariants(mode_passages: DataFrame, modes: DataFrame, gap_pairs: DataFrame, agenda: DataFrame, criteria: DataFrame, statements: dict[str, tuple[DataFrame, DataFrame]], least: int = 2) -> DataFrame:
    """The six invariants apart: passages a mode; gap pairs (row, column) both named in one text of the agenda (text); each
    criterion (phrase), threshold, boundary and survey, given as name to (texts, phrases), mentioned.
    """
    parts = [Q.at_least(mode_passages, "passages a mode", "mode", "passage", modes, least), Q.mentioned_together(agenda, "gap pair named", "text", gap_pairs, "row", "column")]
    parts += [Q.mentions(texts, name, "text", phrases, "phrase") for name, (texts, phrases) in {"criterion": (agenda, criteria), **statements}.items()]
    return Q.violations(*parts)


def skeleton(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every file of the skeleton is there and isn't empty."""
    return Q.files_present(files, "skeleton", wanted)


def query_template(template: DataFrame, placeholders: list[str]) -> DataFrame:
    """The query (name, text) names each placeholder, and its brackets are balanced."""
    lost = F.array_compact(F.array(*[F.when(~F.col("text").contains(p), F.lit(p)) for p in placeholders]))
    opened, closed = (F.regexp_count("text", F.lit(x)) for x in (r"\(", r"\)"))
    return Q.violations(Q.rows_failing(template, "placeholder", F.size(lost) > 0, "name", F.array_join(lost, ",")), Q.rows_failing(template, "brackets", opened != closed, "name"))


def funnel(stages: DataFrame) -> DataFrame:
    """What goes in is what comes out and what is removed, and a stage begins with what the one before left."""
    from pyspark.sql import Window

    before = F.lag("n_out").over(Window.partitionBy(F.lit(0)).orderBy("at"))
    linked = stages.withColumn("before", before)
    return Q.violations(
        Q.rows_failing(stages, "adds up", F.col("n_in") - F.col("removed") != F.col("n_out"), "stage"),
        Q.rows_failing(linked, "follows", F.col("before").isNotNull() & (F.col("before") != F.col("n_in")), "stage"),
    )


def search_output(df: DataFrame, columns: list[str]) -> DataFrame:
    return Q.has_columns(df, "columns", columns)
