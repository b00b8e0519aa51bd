"""Which of many phrases stand in texts: one pass over the texts with an automaton of all phrases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the phrases of one automaton, about: it is broadcast, so more phrases take more passes.
MOST_CHARS = 1 << 21


def _parts(phrases: DataFrame, length: Column, most: int) -> int:
    """Into how many parts by hash the phrases must go so that none has over twice ``most`` characters (or is one phrase)."""
    rows, total = phrases.agg(F.count("*"), F.sum(length)).first()
    parts = max(1, -(-(total or 0) // most))
    while 1 < parts < rows:
        sizes = phrases.groupBy(F.pmod(F.xxhash64(*phrases.columns), F.lit(parts))).agg(F.sum(length).alias("w"), F.count("*").alias("n"))
        if (sizes.filter("n > 1").agg(F.max("w")).first()[0] or 0) <= 2 * most:
            break
        parts *= 2
    return parts


def _automaton(words: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, w in enumerate(words):
        if w:
            a.add_word(w, k)
    a.make_automaton()
    return a if len(a) else None


def found(texts: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """The distinct phrases (one column, phrase) that at least one text contains, in just these letters.

    Null texts and null phrases count for nothing; the empty phrase is in any text. A task stops when it has found them all.
    """
    spark = texts.sparkSession
    wanted = phrases.select(F.col(phrase).alias("phrase")).filter("phrase is not null").distinct()
    parts, out = _parts(wanted, F.length("phrase"), MOST_CHARS), None
    for part in range(parts):
        words = [r[0] for r in wanted.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part).collect()]
        shared = spark.sparkContext.broadcast(words)  # MOST_CHARS bounds it

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            words, seen, some = shared.value, set(), False
            automaton = _automaton(words)
            full = sum(map(bool, words))
            for batch in batches:
                for t in batch["t"]:
                    some = True
                    if len(seen) < full and automaton is not None:
                        seen.update(k for _, k in automaton.iter(t))
            yield pd.DataFrame({"phrase": [w for k, w in enumerate(words) if k in seen or (some and not w)]}, dtype=object)

        hits = texts.select(F.col(text).alias("t")).filter("t is not null").mapInPandas(run, "phrase string")
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()


def found_together(texts: DataFrame, text: str, pairs: DataFrame, one: str, other: str) -> DataFrame:
    """The distinct pairs (one, other) of phrases that stand in one and the same text. Nulls are in none."""
    spark = texts.sparkSession
    wanted = pairs.select(F.col(one).alias("one"), F.col(other).alias("other")).dropna().distinct()
    parts, out = _parts(wanted, F.length("one") + F.length("other"), MOST_CHARS), None
    for part in range(parts):
        chosen = [tuple(r) for r in wanted.filter(F.pmod(F.xxhash64("one", "other"), F.lit(parts)) == part).collect()]
        shared = spark.sparkContext.broadcast(chosen)  # MOST_CHARS bounds it

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            words = sorted({w for pair in shared.value for w in pair})
            place = {w: k for k, w in enumerate(words)}
            left: dict[int, set[int]] = {}
            for a, b in shared.value:
                left.setdefault(place[a], set()).add(place[b])
            automaton, always, seen = _automaton(words), {place[w] for w in words if not w}, []
            for batch in batches:
                for t in batch["t"]:
                    here = always | ({k for _, k in automaton.iter(t)} if automaton is not None else set())
                    for a in here & left.keys():
                        both = left[a] & here
                        seen += [(words[a], words[b]) for b in both]
                        left[a] -= both
                        if not left[a]:
                            del left[a]
            yield pd.DataFrame(seen, columns=["one", "other"], dtype=object)

        hits = texts.select(F.col(text).alias("t")).filter("t is not null").mapInPandas(run, "one string, other string")
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()
