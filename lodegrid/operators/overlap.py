"""Verbatim overlap of two collections by shared n-grams, and similarity by shared tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.functions import text as T


#: Hashes of n-grams that are broadcast, 8 bytes each; more are shuffled.
MOST_BROADCAST = 1_000_000


def shared_ngrams(target: DataFrame, target_id: str, target_text: str, corpus: DataFrame, corpus_id: str, corpus_text: str, n: int = 15) -> DataFrame:
    """target_id, ngram, first_source: each n-gram of a target that occurs in the corpus, and the least corpus id that has it.

    The target's n-grams are 64-bit hashes until one is found in the corpus; only then the text is made and compared.
    """
    at = F.sequence(F.lit(1), F.size("words") - n + 1)
    gram = lambda i: F.array_join(F.slice("words", i, n), " ")
    digest = lambda i: F.xxhash64(F.slice("hashes", i, n))  # noqa: E731  of words' hashes: no text is made for it

    def words(df: DataFrame, key: str, column: str) -> DataFrame:
        split = df.select(F.col(key).alias("id"), T.tokens(F.col(column)).alias("words")).filter(F.size("words") >= n)
        # Exploding an array of one keeps the planner from working it out anew for each n-gram.
        return split.select("id", "words", F.explode(F.array(F.transform("words", lambda w: F.xxhash64(w)))).alias("hashes"))

    source = words(corpus, corpus_id, corpus_text).select("id", F.explode(F.transform(at, lambda i: F.struct(gram(i).alias("ngram"), digest(i).alias("h")))).alias("g"))
    source = source.groupBy("g.ngram", "g.h").agg(F.min("id").alias("first_source"))
    known = source.select("h").distinct()
    if known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    wanted = words(target, target_id, target_text)
    hashed = wanted.select("id", F.posexplode(F.transform(at, digest)).alias("at", "h"))
    hits = hashed.join(known, "h", "left_semi").groupBy("id").agg(F.collect_set("at").alias("hits"))
    found = wanted.join(hits, "id").select(F.col("id").alias("target_id"), F.explode(F.array_distinct(F.transform("hits", lambda i: gram(i + 1)))).alias("ngram"))
    return found.distinct().join(source, "ngram").select("target_id", "ngram", "first_source")


def overlap_lines(found: DataFrame, target: DataFrame, target_id: str, target_text: str) -> DataFrame:
    """found plus the line of the target with the n-gram's first word."""
    first = F.split_part("ngram", F.lit(" "), F.lit(1))
    return found.join(target.select(F.col(target_id).alias("target_id"), F.col(target_text).alias("__t")), "target_id").withColumn("line", T.first_line_with(F.col("__t"), first)).drop("__t")


def token_cosine(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left_id, right_id, cosine of all pairs with a cosine of ``least`` or more. Inputs are (id, text) with unique ids.

    Tokens are ordered by rarity over both sides. In a vector's tail whose norm is below ``least`` times its own no pair's
    first common token can be, so only tokens before it are joined; the frequent ones are hardly ever among them.
    """
    def counts(df: DataFrame) -> DataFrame:
        return df.select("id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count("*").cast("double").alias("n"))

    a, b = counts(left), counts(right)
    rarity = a.select("token").unionByName(b.select("token")).groupBy("token").agg(F.count("*").alias("rarity"))

    def vectors(tf: DataFrame, name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct("rarity", "token", "n")))
        return tf.join(rarity, "token").groupBy(F.col("id").alias(name)).agg(items.alias(f"v_{name}"))

    def leading(df: DataFrame, name: str) -> DataFrame:
        v = F.col(f"v_{name}")
        whole = F.aggregate(v, F.lit(0.0), lambda s, x: s + x["n"] * x["n"])
        steps = df.withColumn("__whole", whole).select(name, "__whole", F.posexplode(v).alias("at", "x"))
        before = Window.partitionBy(name).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumn("__rest", F.col("__whole") - F.coalesce(F.sum(F.col("x.n") * F.col("x.n")).over(before), F.lit(0.0)))
        return steps.filter(F.col("__rest") >= (least * least - 1e-9) * F.col("__whole")).select(name, F.col("x.token").alias("token"))

    va, vb = vectors(a, "left_id"), vectors(b, "right_id")
    pairs = leading(va, "left_id").join(leading(vb, "right_id"), "token").select("left_id", "right_id").distinct()
    amount = lambda v, f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))
    as_map = lambda v: F.map_from_arrays(F.transform(v, lambda x: x["token"]), F.transform(v, lambda x: x["n"]))
    of_right = as_map(F.col("v_right_id"))
    both = pairs.join(va, "left_id").join(vb.select("right_id", "v_right_id", of_right.alias("__map")), "right_id")
    dot = amount(F.col("v_left_id"), lambda x: x["n"] * F.coalesce(F.element_at(F.col("__map"), x["token"]), F.lit(0.0)))
    norm = lambda v: F.sqrt(amount(v, lambda x: x["n"] * x["n"]))
    return both.select("left_id", "right_id", (dot / norm(F.col("v_left_id")) / norm(F.col("v_right_id"))).alias("cosine")).filter(F.col("cosine") >= least)


def best_candidates(refs: DataFrame, candidates: DataFrame, threshold: float = 0.85, boost: float = 0.03) -> DataFrame:
    """For each reference (ref_id, title, year) the best of its candidates (ref_id, at, title, year, doi) by title cosine; the same year adds a boost, so a score may exceed 1.

    Returns ref_id, doi (null below the threshold) and score, rounded to three places.
    """
    from lodegrid.functions.keys import doi_for_references

    c = candidates.select("ref_id", "at", F.col("title").alias("c_title"), F.col("year").alias("c_year"), "doi")
    score = T.cosine(T.tokens(F.col("title")), T.tokens(F.col("c_title"))) + F.when((F.col("year") != "") & (F.col("year") == F.col("c_year")), boost).otherwise(0.0)
    best = refs.join(c, "ref_id").withColumn("score", score).groupBy("ref_id").agg(F.max_by(F.struct("doi", "score"), F.struct("score", (-F.col("at")).alias("t"))).alias("b"))
    return best.select("ref_id", F.when(F.col("b.score") >= threshold, doi_for_references(F.col("b.doi"))).alias("doi"), F.round("b.score", 3).alias("score"))
