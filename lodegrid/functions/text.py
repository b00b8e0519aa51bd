"""Text as column expressions: lists in cells, page ranges, Markdown, tokens, n-grams, chunks, JSON in text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.functions.gestalt import ratios

from lodegrid.functions.keys import _blank, trimmed


def cells(c: Column, pattern: str = r"\|") -> Column:
    """The parts of a multi-valued cell, trimmed, without blanks; null cells have none."""
    return F.filter(F.transform(F.split(_blank(c), pattern), lambda x: F.trim(x)), lambda x: x != "")


def json_strings(c: Column) -> Column:
    """A JSON array of strings; malformed and null cells are empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_object_in(c: Column, schema: str) -> Column:
    """The object between the first and the last brace of a text."""
    return F.from_json(F.nullif(F.regexp_extract(_blank(c), r"(?s)(\{.*\})", 1), F.lit("")), schema)


def page_count(c: Column) -> Column:
    """Pages (long) of "45-55", "art7:17pp", "12"; null for anything else, numbers beyond 64 bits too. A number of pages in words has priority, then ranges."""
    s = trimmed(c)
    stated = F.regexp_extract(s, r"(?i)(\d+)\s*pp\b", 1)
    plain = F.regexp_replace(F.translate(s, "–—", "--"), "-+", "-")
    first, last = (F.regexp_extract(plain, r"^\s*(\d+)\s*-\s*(\d+)\s*$", k).try_cast("long") for k in (1, 2))
    return (
        F.when(stated != "", stated.try_cast("long"))
        .when(first.isNotNull(), F.when(last >= first, last - first + 1))
        .when(plain.rlike(r"^\s*\d+\s*$"), F.lit(1).cast("long"))
    )


def three_way(number: Column, least: int = 4) -> Column:
    return F.when(number.isNull(), "manual_review").when(number >= least, "pass").otherwise("fail")


def without_markdown(c: Column) -> Column:
    # What goes, in this order.
    steps = [
        (r"(?s)```.*?```", " "),
        (r"`[^`]*`", " "),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"(?m)^\s*#+\s*", ""),
        (r"(?m)^\s*[-*+]\s+", ""),
        (r"(?m)^\s*\d+\.\s+", ""),
        (r"[*_~]{1,3}", ""),
        (r"(?m)^>\s*", ""),
    ]
    out = _blank(c)
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return out


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 in lower case, in order."""
    return F.regexp_extract_all(F.lower(_blank(c)), F.lit("([a-z0-9]+)"), 1)


def ngrams(words: Column, n: int) -> Column:
    """All n-grams, space-joined, with repeats; none if there are fewer words."""
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def title_year_key(title: Column, year: Column) -> Column:
    """First ten tokens and the year; null for fewer than three tokens."""
    t = tokens(title)
    return F.when(F.size(t) >= 3, F.concat_ws("|", F.array_join(F.slice(t, 1, 10), " "), _blank(year)))


def reference_key(doi: Column, title: Column, year: Column) -> Column:
    """doi:... or tit:tokens|year; null if DOI, title and year are all empty."""
    t = F.concat(F.lit("tit:"), F.array_join(F.slice(tokens(title), 1, 10), " "), F.lit("|"), _blank(year))
    return F.when(trimmed(doi) != "", F.concat(F.lit("doi:"), doi)).otherwise(F.nullif(t, F.lit("tit:|")))


def low_confidence_title(c: Column) -> Column:
    t = _blank(c)
    return (F.length(t) < 15) | t.contains("://") | t.rlike(r"\b(19|20)\d{2}\b") | t.rlike(r"(?U)^[\W\d]")


def capital_tokens(c: Column) -> Column:
    return F.regexp_extract_all(_blank(c), F.lit(r"\b([A-Z]{2,8})\b"), 1)


def frequencies(words: Column) -> Column:
    """Distinct words with their numbers: map<string, int>."""
    kinds = F.array_distinct(words)
    return F.map_from_arrays(kinds, F.transform(kinds, lambda w: F.size(F.filter(words, lambda x: x == w))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the word frequencies of two arrays; 0 if one is empty."""
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w)).cast("double")
    total = lambda kinds, f: F.aggregate(kinds, F.lit(0.0), lambda s, w: s + f(w))
    dot = total(F.array_intersect(a, b), lambda w: count(a, w) * count(b, w))
    norm = lambda words: total(F.array_distinct(words), lambda w: count(words, w) * count(words, w))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / F.sqrt(norm(a) * norm(b))).otherwise(0.0)


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words by the larger set."""
    most = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(0.0)


def overlap_matches(a: Column, b: Column, least: float = 0.6, words: int = 3) -> Column:
    return (word_overlap(a, b) >= least) & (F.size(F.array_intersect(a, b)) >= words)


def chunks(c: Column, size: int = 12_000, overlap: int = 500) -> Column:
    """Overlapping pieces of a text; the last one ends with it. Empty texts have none."""
    n = F.length(_blank(c))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - overlap), F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def rebuilt_text(index: Column) -> Column:
    """Text from an inverted index, map of word to positions."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["word"]), " ")


def first_line_with(c: Column, word: Column) -> Column:
    """Number (from 1) of the first line that has the word, in any case; null if none has."""
    lines = F.split(F.lower(_blank(c)), "\n")
    hit = F.filter(F.transform(lines, lambda x, i: F.when(x.contains(F.lower(word)), i + 1)), lambda i: i.isNotNull())
    return F.try_element_at(hit, F.lit(1))


def spaced(c: Column) -> Column:
    """Blanks put back after points and commas that capitals follow."""
    out = F.regexp_replace(F.regexp_replace(_blank(c), r"\.(?=[A-Z])", ". "), r",(?=[A-Z])", ", ")
    return F.regexp_replace(out, r"\s{2,}", " ")


def flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(_blank(c), r"\s+", " "))


def between(c: Column, start: str, end: str, fallback: int = 3000) -> Column:
    """From the first start mark, which stays, up to the first end mark of the text; its beginning if a mark is missing."""
    first, last = F.instr(c, start), F.instr(c, end)
    return F.when((first == 0) | (last == 0), F.substring(_blank(c), 1, fallback)).otherwise(trimmed(F.substring(c, first, F.greatest(F.lit(0), last - first))))


def page_string(pages: Column, article: Column, number: Column) -> Column:
    """Pages with one hyphen; without any, "art<article>:<number>pp" if both are known, else null."""
    given = F.nullif(_blank(pages), F.lit(""))
    both = (_blank(article) != "") & (_blank(number) != "")
    fallback = F.when(both, F.concat(F.lit("art"), article, F.lit(":"), number, F.lit("pp")))
    return F.when(given.isNotNull(), trimmed(F.replace(F.replace(given, F.lit("–"), F.lit("-")), F.lit("--"), F.lit("-")))).otherwise(fallback)


def env_value(c: Column) -> Column:
    """The value of a NAME=value line without blanks and quotes around it."""
    return F.regexp_replace(F.regexp_replace(trimmed(F.regexp_extract(_blank(c), r"(?s)^[^=]*=(.*)$", 1)), r'^"+|"+$', ""), r"^'+|'+$", "")


def escaped_for_bibtex(c: Column) -> Column:
    out = F.replace(_blank(c), F.lit("\\"), F.lit("\\textbackslash{}"))
    for mark in "&%$#_":
        out = F.replace(out, F.lit(mark), F.lit(f"\\{mark}"))
    return out


def escaped_for_table(c: Column) -> Column:
    return F.replace(_blank(c), F.lit("|"), F.lit("\\|"))


def truthy(c: Column, words: tuple[str, ...] = ("true", "1", "yes", "y")) -> Column:
    return F.lower(trimmed(c)).isin(*words)


def year_of_date(c: Column) -> Column:
    return F.substring(_blank(c), 1, 4).try_cast("int")


def capitalised(c: Column) -> Column:
    """Each letter after a non-letter in upper case, the others in lower: unlike initcap also after hyphens."""
    parts = F.regexp_extract_all(_blank(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt ratio of two titles without marks. For pairs that equal keys have brought together; the JVM has no such measure."""
    clean = lambda t: re.sub("[^a-z0-9 ]", "", (t or "").lower()).strip()
    return pd.Series(ratios([clean(x) for x in a], [clean(y) for y in b]))


def preprint_default(preprint: Column, mismatch: Column) -> Column:
    """preprint if either flag is set, else published."""
    return F.when(truthy(preprint, ("true", "1")) | (trimmed(mismatch) != ""), "preprint").otherwise("published")
