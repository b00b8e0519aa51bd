"""Reference strings: authors, title, year and DOI by a cascade of layouts, as column expressions.

Every layout is tried as an expression of its own; the first that gives a title wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.functions.keys import _blank, doi_for_references, trimmed
from lodegrid.functions.text import spaced

# Fixed values.
YEAR = r"\b(?:19|20)\d{2}\b"
DOI = r"10\.\d{4,9}/[^\s\"<>]+"
QUOTES = "‘’“”'\"`"
VENUE = (
    r"(?i)\s(?:In\s*:|(?:International\s+|IEEE\s+|ACM\s+)?(?:Proceedings|Proc\.|Conf\.|Conference|Symposium|Workshop|Journal|J\.\s)"
    r"|IEEE\b|ACM\b|arXiv\b|https?://|doi\.org|vol\.|pp\.)"
)
COLON = r"(?<=[A-Za-z.]):\s+(?=[A-Z])"
SHORTEST_TITLE = 10


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(c, pattern, group)


def _before(c: Column, pattern: str) -> Column:
    """Text before the first match; null without one."""
    return F.when(c.rlike(pattern), F.element_at(F.split(c, pattern, 2), 1))


def _after(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), F.element_at(F.split(c, pattern, 2), 2))


def _bare(c: Column, marks: str) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), f"[{marks}]+$", ""))


def title_in(tail: Column) -> Column:
    """The shortest of: up to a sentence's end, up to a venue, up to a URL. Cuts under ten characters don't count; a year at the end goes."""
    cuts = F.array(F.element_at(F.split(tail, r"\.\s+(?=[A-Z])", 2), 1), _before(tail, VENUE), _before(tail, r"\s*https?://"))
    long_enough = F.filter(F.transform(cuts, lambda x: _bare(x, ".,;:)")), lambda x: F.length(x) >= SHORTEST_TITLE)
    shortest = F.array_min(F.transform(long_enough, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))))["x"]
    out = _bare(F.regexp_replace(F.coalesce(shortest, F.lit("")), r"[\s,.]*\(?\b(?:19|20)\d{2}[a-z]?\)?\s*$", ""), ".,;:)")
    return F.when(F.length(out) >= SHORTEST_TITLE, out).otherwise("")


def with_citation(df: DataFrame, raw: str, out: str) -> DataFrame:
    """df plus a column struct(authors, title, year, doi); empty strings for what isn't found.

    What several layouts need is a column of its own, so that it is worked out once a row.
    """
    text = df.withColumn("__text", trimmed(F.col(raw)))
    head = text.withColumn("__head", spaced(F.regexp_replace("__text", r"^\s*(\[\d+\]|\d+\.)\s*", "")))
    region = F.substring(F.col("__head"), 1, 250)
    parts = head.withColumns({"__authors": _before(region, COLON), "__rest": _after(F.col("__head"), COLON), "__by_year": _bare(_before(F.col("__head"), YEAR), " ,.:;()"), "__after_year": F.regexp_replace(_after(F.col("__head"), YEAR), r"^[ ,.:;()]+", "")})
    titles = parts.withColumns({"__colon_title": title_in(F.col("__rest")), "__year_title": title_in(_bare(F.col("__after_year"), " ,.:;()"))})
    found = titles.withColumn(out, _best_layout())
    return found.select(*[c for c in df.columns if c != out], out)


def _best_layout() -> Column:
    text, head, authors, rest = (F.col(c) for c in ("__text", "__head", "__authors", "__rest"))
    year_of = lambda c: _found(_blank(c), YEAR)
    record = lambda a, t, y: F.struct(F.coalesce(a, F.lit("")).alias("authors"), F.coalesce(t, F.lit("")).alias("title"), F.coalesce(y, F.lit("")).alias("year"))

    quoted = f"[{QUOTES}]{{1,2}}([^{QUOTES}]{{10,400}}?)[{QUOTES}]{{1,2}}"
    body = _bare(_found(head, quoted, 1), ",.:;")
    is_quoted = (F.length(body) >= SHORTEST_TITLE) & body.contains(" ") & (body != F.upper(body))
    by_quotes = record(_bare(_before(head, quoted), " ,.:;()"), F.substring(body, 1, 500), year_of(head))

    region = F.substring(head, 1, 250)
    is_colon = ~region.rlike(r"https?://") & region.rlike(COLON) & authors.rlike("[,.]") & (F.length(authors) > 5)
    colon_title = F.when(is_colon, F.col("__colon_title"))
    by_colon = record(F.regexp_replace(authors, "[: ]+$", ""), colon_title, year_of(rest))

    before_year = F.col("__by_year")
    by_year = record(F.when(F.length(before_year) >= 3, before_year), F.col("__year_title"), year_of(head))

    has_authors = F.when(head.rlike(YEAR), F.length(before_year) >= 3).otherwise(F.lit(False))
    leftover = record(F.when(has_authors, before_year).when(is_colon, F.regexp_replace(authors, "[: ]+$", "")).otherwise(F.trim(F.substring(head, 1, 200))), F.lit(""), F.when(head.rlike(YEAR), year_of(head)))
    best = F.when(is_quoted, by_quotes).when(is_colon & (colon_title != ""), by_colon).when(head.rlike(YEAR) & (by_year["title"] != ""), by_year).otherwise(leftover)
    return F.struct(
        F.trim(F.substring(best["authors"], 1, 300)).alias("authors"),
        F.trim(F.substring(best["title"], 1, 500)).alias("title"),
        best["year"].alias("year"),
        F.coalesce(doi_for_references(_found(text, DOI)), F.lit("")).alias("doi"),
    )
