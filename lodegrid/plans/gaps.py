"""Evidence gaps: from annotated entities to a ranked list of thin cells of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.operators import aggregates as A


def gap_matrix(evidence: DataFrame, row: str, column: str, entity: str, rows: DataFrame, columns: DataFrame, quantile: float = 0.25) -> DataFrame:
    """row, column, n, threshold, is_empty, is_gap for every cell of the declared axes."""
    counts = A.zero_filled(A.distinct_per_group(evidence, [row, column], entity), rows, columns)
    return A.flagged(counts, A.threshold(counts, quantile))


def gap_matrix_by(evidence: DataFrame, group: str, row: str, column: str, entity: str, groups: DataFrame, rows: DataFrame, columns: DataFrame, quantile: float = 0.25) -> DataFrame:
    """The same for each group with a threshold of its own, in one pass."""
    counts = A.distinct_per_group(evidence, [group, row, column], entity)
    grid = groups.crossJoin(rows).crossJoin(columns).join(counts, [group, row, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return A.flagged(grid, A.threshold(grid, quantile, by=[group]), by=[group])


def bucketed(design: Column, automation: Column) -> Column:
    """The kind of gap: the column's design test comes first."""
    return F.when(design, "design_gap").when(automation, "automation_gap").otherwise("evidence_gap")


def rationale(row: Column, column: Column, n: Column, threshold: Column, prevalence: Column) -> Column:
    return F.format_string("%s x %s: %d of the %.2f that are usual; named by %d sources.", row, column, n, threshold, prevalence)


def parsed_rationale(c: Column) -> Column:
    part = lambda k: F.regexp_extract(c, r"^(.+) x (.+): (\d+) of the", k)
    return F.when(part(1) != "", F.struct(part(1).alias("row"), part(2).alias("column"), part(3).cast("int").alias("n")))


def ranked_gaps(matrix: DataFrame, prevalence: DataFrame, row: str, column: str) -> DataFrame:
    """Gaps with shortfall, prevalence (by row) and priority, highest first, then by row and column."""
    gaps = matrix.filter("is_gap").join(prevalence, row, "left").withColumn("prevalence", F.coalesce("prevalence", F.lit(0)))
    return A.prioritised(gaps, "prevalence").orderBy(F.desc("priority"), row, column)
