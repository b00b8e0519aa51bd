"""Matching: lookups with a status, cascades by priority, containment, reconciliation of key sets.

Equal keys are joined by shuffle or broadcast as the planner sees fit. What is looked up is made unique
first, by an explicit order, so no join multiplies rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.session import scratch


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; rows with a null key are dropped."""
    known = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return known.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def lookup_with_status(rows: DataFrame, key: str, table: DataFrame, table_key: str, columns: list[str], status: str = "lookup") -> DataFrame:
    """Left join plus matched / no_match / no_key. ``table`` has unique keys."""
    side = table.select(F.col(table_key).alias("__key"), *columns, F.lit(True).alias("__hit"))
    out = rows.join(side, F.col(key) == F.col("__key"), "left")
    state = F.when(F.col(key).isNull() | (F.trim(key) == ""), "no_key").when(F.col("__hit"), "matched").otherwise("no_match")
    return out.withColumn(status, state).drop("__key", "__hit")


def cascade(rows: DataFrame, row_id: str, steps: list[tuple[str, Column, DataFrame]], values: list[str], default: str | None = None, method: str = "method") -> DataFrame:
    """Match by the first step that hits. A step is (name, array of candidate keys in order, table with unique ``key`` and ``values``).

    Within a step the first candidate that hits wins. ``values`` of unmatched rows are ``default``, their method is none.
    """
    out = rows
    for k, (_, candidates, table) in enumerate(steps):
        wanted = rows.select(F.col(row_id).alias("__id"), F.posexplode(candidates).alias("__pos", "__key")).filter("__key is not null and __key != ''")
        hit = wanted.join(table.select(F.col("key").alias("__key"), F.struct(*values).alias("__v")), "__key")
        first = hit.groupBy("__id").agg(F.min_by("__v", "__pos").alias(f"__v{k}"))
        out = out.join(first, F.col(row_id) == F.col("__id"), "left").drop("__id")
    found = [F.col(f"__v{k}") for k in range(len(steps))]
    best = F.coalesce(*found)
    name = reduce(lambda rest, k: F.when(found[k].isNotNull(), steps[k][0]).otherwise(rest), reversed(range(len(steps))), F.lit("none"))
    picked = [F.when(best.isNull(), F.lit(default)).otherwise(best[v].cast("string") if default is not None else best[v]).alias(v) for v in values]
    return out.select(*rows.columns, *picked, name.alias(method))


def venue_ranks(papers: DataFrame, journals: DataFrame, conferences: DataFrame, row_id: str = "row_idx") -> DataFrame:
    """Rank of each paper's venue: by any of its ISSNs, then by name, then by an acronym in the venue's name.

    papers: row_id, issn, source. journals: row_idx, issn, name, acronym, rank; conferences: the same without issn.
    Of journals with one key the last wins; a conference only counts where no journal has its key, and the first wins.
    """
    from lodegrid.functions import keys as K
    from lodegrid.functions.text import capital_tokens

    ranked = lambda df, kind: df.filter((K.trimmed(F.col("name")) != "") & (F.lower(K.trimmed(F.col("rank"))).isin("", "nan") == F.lit(False))).select("*", K.acronym_shown(F.col("acronym"), F.col("name")).alias("venue_acronym"), F.lit(kind).alias("venue_type"), F.trim("rank").alias("venue_rank"))
    j, c = ranked(journals, "Journal"), ranked(conferences, "Conference")
    values = ["venue_acronym", "venue_type", "venue_rank"]

    def index(of_journals: Column, of_conferences: Column | None) -> DataFrame:
        last = one_per_key(j.withColumn("key", F.nullif(of_journals, F.lit(""))), ["key"], [F.col("row_idx").desc()]).select("key", *values)
        if of_conferences is None:
            return last
        first = one_per_key(c.withColumn("key", F.nullif(of_conferences, F.lit(""))), ["key"], [F.col("row_idx").asc()]).select("key", *values)
        return last.unionByName(first.join(last.select("key"), "key", "left_anti"))

    name, acronym = K.venue_key(F.col("name")), K.acronym_key(F.col("acronym"))
    issn = F.when(F.lower(K.trimmed(F.col("issn"))).isin("n/a", "nan"), "").otherwise(K.issn_key(F.col("issn")))
    steps = [
        ("issn", F.transform(F.split(F.coalesce("issn", F.lit("")), r"\s+"), K.issn_key), index(issn, None)),
        ("name", F.array(K.venue_key(F.col("source"))), index(name, name)),
        ("acronym", capital_tokens(F.col("source")), index(acronym, acronym)),
    ]
    return cascade(papers, row_id, steps, values, K.NOT_FOUND)


def bibliography_matches(entries: DataFrame, known: DataFrame, least: float = 0.8) -> DataFrame:
    """For each entry the known record with its DOI, else with its preprint number, else the most alike title of equal year and first surname.

    Both have id, row_idx, doi, arxiv, year, surname, title. The first record wins among equal keys and equal ratios.
    """

    by = lambda c: one_per_key(known.withColumn("key", F.nullif(F.col(c), F.lit(""))), ["key"], [F.col("row_idx")]).select("key", F.col("id").alias("match"))
    scored = alike_titles(entries, known, least).select(F.col("entry").alias("key"), F.col("known").alias("match"), "at", "ratio")
    alike = one_per_key(scored, ["key"], [F.col("ratio").desc(), F.col("at")]).select("key", "match")
    return cascade(entries, "id", [("doi", F.array("doi"), by("doi")), ("arxiv", F.array("arxiv"), by("arxiv")), ("title", F.array(F.col("id")), alike)], ["match"])


#: Pairs of titles that one task compares, about: blocks of one year and surname with more are dealt out.
PAIRS_A_TASK = 1_000_000


def alike_titles(entries: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """entry, known, at, ratio: pairs of equal year and surname whose titles have a gestalt ratio of ``least`` or more.

    Bounds that no ratio can be beyond rule pairs out before one is made: by the lengths, as part of the join's key (one title can
    be longer than the other by a fixed factor only), then by the characters that both have, as multisets.
    """
    from lodegrid.functions.text import sequence_ratio

    clean = F.trim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9 ]", ""))
    # The characters that titles are compared by.
    counted = F.transform(F.split(F.lit("abcdefghijklmnopqrstuvwxyz0123456789 "), ""), lambda c: F.length("clean") - F.length(F.replace(F.col("clean"), c, F.lit(""))))
    factor = (2 - least) / least * (1 + 1e-9) if least > 0 else float("inf")
    step = F.floor(F.log(F.length("clean")) / F.log(F.lit(factor))) if 1 < factor < float("inf") else F.lit(0)
    bucket = F.when(F.length("clean") == 0, F.lit(-9)).otherwise(step).cast("long")  # empty titles are alike each other only

    def slim(df: DataFrame) -> DataFrame:
        one = df.filter((F.col("year") != "") & (F.col("surname") != "")).select("id", "row_idx", "year", "surname", "title", F.explode(F.array(clean)).alias("clean"))
        return one.select("*", bucket.alias("bucket"), counted.alias("counted"))

    keys = ["year", "surname", "bucket"]
    e = slim(entries.withColumn("row_idx", F.lit(0))).filter("title != ''").withColumn("bucket", F.explode(F.array_distinct(F.when(F.col("bucket") < 0, F.array("bucket")).otherwise(F.sequence(F.greatest(F.lit(0), F.col("bucket") - 1), F.col("bucket") + 1)))))
    k = slim(known)
    sizes = e.groupBy(*keys).agg(F.count("*").alias("n")).join(k.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    hot = sizes.withColumn("parts", F.least("m", F.ceil(F.col("n") * F.col("m") / PAIRS_A_TASK))).filter("parts > 1").select(*keys, "parts")
    dealt = lambda df: df.join(hot, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    e = dealt(e).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    k = dealt(k).withColumn("part", F.pmod(F.xxhash64("id", "row_idx"), F.col("parts")))
    left, right = (df.select(*keys, "part", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "row_idx", "clean", "counted")]) for df, side in ((e, "e"), (k, "k")))
    near = left.join(right, [*keys, "part"])
    total = F.length("clean_e") + F.length("clean_k")
    common = F.aggregate(F.zip_with("counted_e", "counted_k", lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    near = near.filter((total == 0) | (2 * common >= (least - 1e-9) * total))
    scored = near.select(F.col("id_e").alias("entry"), F.col("id_k").alias("known"), F.col("row_idx_k").alias("at"), sequence_ratio(F.col("clean_e"), F.col("clean_k")).alias("ratio"))
    return scored.filter(F.col("ratio") >= least)


def filled(rows: DataFrame, key: str, column: str, sources: list[tuple[str, DataFrame]], origin: str = "origin") -> DataFrame:
    """Fill blanks of a column from several tables (unique ``key`` and ``value``), the first that knows it; ``origin`` names it."""
    own = F.nullif(F.trim(column), F.lit(""))
    out = rows
    for k, (_, table) in enumerate(sources):
        out = out.join(table.select(F.col("key").alias("__key"), F.nullif(F.trim("value"), F.lit("")).alias(f"__s{k}")), F.col(key) == F.col("__key"), "left").drop("__key")
    parts = [own, *[F.col(f"__s{k}") for k in range(len(sources))]]
    names = ["original", *[n for n, _ in sources]]
    label = reduce(lambda rest, k: F.when(parts[k].isNotNull(), names[k]).otherwise(rest), reversed(range(len(parts))), F.lit("none"))
    kept = [c for c in rows.columns if c not in (column, origin)]
    return out.select(*kept, F.coalesce(*parts).alias(column), label.alias(origin))


def already_known(refs: DataFrame, decided: DataFrame) -> DataFrame:
    """refs plus is_known: by DOI, by record id, or, only without a DOI, by title and year. Both have doi, record_id and title_year."""
    out = refs
    for c in ("doi", "record_id", "title_year"):
        side = decided.select(F.nullif(F.col(c), F.lit("")).alias(f"__{c}")).filter(F.col(f"__{c}").isNotNull()).distinct()
        out = out.join(side, F.col(c) == F.col(f"__{c}"), "left")
    without = F.coalesce(F.col("doi"), F.lit("")) == ""
    known = F.col("__doi").isNotNull() | F.col("__record_id").isNotNull() | (without & F.col("__title_year").isNotNull())
    return out.withColumn("is_known", known).drop("__doi", "__record_id", "__title_year")


def reconciled(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, state, n_left, n_right of every key that isn't once on both sides: missing (not right), extra (not left), duplicate."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    both = a.join(b, key, "full_outer").na.fill(0, ["n_left", "n_right"])
    state = F.when(F.col("n_right") == 0, "missing").when(F.col("n_left") == 0, "extra").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicate")
    return both.withColumn("state", state).filter("state is not null").select(key, "state", "n_left", "n_right")


#: Characters of the substrings that keys are looked up by.
GRAM = 8
#: Rows of one key that a task joins, about: names, and rows of keys. A key with more is dealt out over both.
NAMES_AT_ONCE, KEYS_AT_ONCE = 20_000, 1_000


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contained_keys(names: DataFrame, name: str, keys: DataFrame, key: str) -> DataFrame:
    """Pairs where the key is a substring of the name, with the columns of both; blank and null keys are in none.

    No nested loop: a key is looked up by that of its substrings of GRAM characters (or by itself, if it is shorter) that the
    fewest names hold. A key with a substring that no name holds is dropped at once; what meets is tested as a whole. Equal names
    and equal keys are looked up once.
    """
    texts, wanted = names.select(F.col(name).alias("__name")).filter("__name is not null").distinct(), keys.filter(F.col(key) != "")
    rows, _, candidates = _gram_candidates(texts, "__name", wanted, key)
    found = _written(rows.join(candidates, "__n").filter(F.col("__name").contains(F.col("__key"))).select("__name", "__key"))
    met = _written(names.join(found, F.col(name) == F.col("__name")).drop("__name").withColumn("__at", F.monotonically_increasing_id()))
    left, right = _dealt_pairs(met, wanted.withColumn("__key", F.col(key)).join(found.select("__key").distinct(), "__key", "left_semi"))
    return left.join(right.hint("merge"), ["__key", "__a", "__b"]).select(*names.columns, *keys.columns)


def _dealt_pairs(met: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (with __key) with __a, __b: cells of a key's rows times its names, in which every pair of them meets once.

    Pairs can be as many as one side's rows times the other's, so no cell has more than NAMES_AT_ONCE times KEYS_AT_ONCE, about.
    """
    wanted = _written(wanted.withColumn("__of", F.monotonically_increasing_id()))
    sizes = met.groupBy("__key").agg(F.ceil(F.count("*") / NAMES_AT_ONCE).alias("__as")).join(wanted.groupBy("__key").agg(F.ceil(F.count("*") / KEYS_AT_ONCE).alias("__bs")), "__key")
    sizes = _written(sizes)
    cells = sizes.agg(F.sum(F.col("__as") * F.col("__bs"))).first()[0] or 1
    hot = sizes.filter("__as * __bs > 1")
    parts = lambda df: df.join(hot, "__key", "left").na.fill(1, ["__as", "__bs"])
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = parts(met).withColumn("__a", F.pmod("__at", "__as")).withColumn("__b", each("__bs")).drop("__at", "__as", "__bs")
    right = parts(wanted).withColumn("__b", F.pmod("__of", "__bs")).withColumn("__a", each("__as")).drop("__of", "__as", "__bs")
    spread = lambda df: df.repartition(max(1, min(5000, cells)), "__key", "__a", "__b")
    return spread(left), spread(right)


def _gram_candidates(names: DataFrame, name: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names with their number __n, keys that aren't blank, __n and __key of what is to be tested)."""
    rows, wanted = _written(names.withColumn("__n", F.monotonically_increasing_id())), keys.filter(F.col(key) != "")
    parts = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))
    of_keys = wanted.select(F.col(key).alias("__key")).distinct()
    of_keys = _written(of_keys.select("__key", F.explode(F.array_distinct(parts(F.col("__key"), F.least(F.length("__key"), F.lit(GRAM))))).alias("__gram")))
    lengths = sorted(r[0] for r in of_keys.select(F.length("__gram")).distinct().collect())  # GRAM at most
    empty = F.array().cast("array<string>")
    each = [F.when(F.length(name) >= n, parts(F.col(name), F.lit(n))).otherwise(empty) for n in lengths] or [empty]
    held = rows.select("__n", F.explode(F.array_distinct(F.concat(*each))).alias("__gram"))
    held = _written(held.join(of_keys.select("__gram").distinct(), "__gram", "left_semi"))
    counts = held.groupBy("__gram").agg(F.count("*").alias("__count"))
    rarest = of_keys.join(counts, "__gram", "left").groupBy("__key").agg(F.min(F.struct("__count", "__gram")).alias("r"), F.count_if(F.col("__count").isNull()).alias("lost"))
    chosen = rarest.filter("lost = 0").select("__key", F.col("r.__gram").alias("__gram"))
    return rows, wanted, held.join(chosen, "__gram").select("__n", "__key")


def chained(rows: DataFrame, steps: list[tuple[str, DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """(rows with the columns of each table in turn, unmatched keys). A step is (column, table, its unique key): left joins.

    unmatched has column, value and n of every value that a table lacks; the caller decides whether that is an error.
    """
    out, lost = rows, []
    for k, (column, table, key) in enumerate(steps):
        side = table.withColumnRenamed(key, f"__k{k}").withColumn(f"__hit{k}", F.lit(True))
        out = out.join(side, F.col(column) == F.col(f"__k{k}"), "left").drop(f"__k{k}")
        lost.append(out.filter(F.col(f"__hit{k}").isNull() & F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(column).alias("column"), "value", "n"))
    return out.drop(*[f"__hit{k}" for k in range(len(steps))]), reduce(DataFrame.unionByName, lost)


def enriched_by_key(rows: DataFrame, records: DataFrame, values: list[str], row_id: str, missing: dict[str, str], rank: str = "rank", row_idx: str = "row_idx") -> DataFrame:
    """rows plus ``values`` of the record with the same DOI, else the same title, and match_method (doi, title, unmatched).

    Both sides have doi and title. Of records with one key the one with an abstract wins, then one whose venue
    has a rank, then the first. Blanks and unmatched rows get the values of ``missing``.
    """
    from lodegrid.functions import keys as K

    filled = lambda c: (F.coalesce(F.trim(F.col(c)), F.lit("")) != "").cast("int")
    has_rank = (~F.coalesce(F.trim(F.col(rank)), F.lit("")).isin("", K.NOT_FOUND, "nan")).cast("int")
    best = [filled("abstract").desc(), has_rank.desc(), F.col(row_idx)]

    def index(key: Column) -> DataFrame:
        return one_per_key(records.withColumn("key", F.nullif(key, F.lit(""))), ["key"], best).select("key", *values)

    doi, title = K.doi_for_enrichment(F.col("doi")), K.title_key(F.col("title"))
    found = cascade(rows.select(F.col(row_id).alias("__row"), F.array(doi).alias("__doi"), F.array(title).alias("__title")), "__row", [("doi", F.col("__doi"), index(doi)), ("title", F.col("__title"), index(title))], values)
    shown = [F.coalesce(F.nullif(F.trim(v), F.lit("")), F.lit(missing[v])).alias(v) for v in values]
    found = found.select("__row", *shown, F.when(F.col("method") == "none", "unmatched").otherwise(F.col("method")).alias("match_method"))
    return rows.join(found, F.col(row_id) == F.col("__row")).drop("__row")


def all_matched(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """rows with a value by key, where every key must be known: a blank or missing one fails the job."""
    out = rows.join(table.select(key, value), key, "left")
    lost = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return out.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value)).otherwise(lost.cast(table.schema[value].dataType)))


def with_new_keys(state: DataFrame, wanted: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Add a default row for each wanted key that state lacks, and fill blanks of state from ``wanted``."""
    shared = [c for c in state.columns if c in wanted.columns and c != key]
    side = wanted.select(key, *[F.col(c).alias(f"__{c}") for c in shared])
    old = state.join(side, key, "left").select(key, *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in state.columns if c != key])
    new = wanted.join(state.select(key), key, "left_anti")
    new = new.select(key, *[F.col(c) if c in wanted.columns else F.lit(defaults.get(c)).cast(state.schema[c].dataType).alias(c) for c in state.columns if c != key])
    return old.unionByName(new)


def assembled(base: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """One row per key with the rows of each part as an array of structs, sorted."""
    out = base
    for name, df in parts.items():
        many = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias(name))
        out = out.join(many, key, "left")
    return out
