"""Queries over the driver's tables, one or more for each family of operators, with their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.functions import citations as C
from lodegrid.functions import keys as K
from lodegrid.functions import text as T
from lodegrid.operators import aggregates as A
from lodegrid.operators import checks as Q
from lodegrid.operators import clustering as L
from lodegrid.operators import dedup as D
from lodegrid.operators import joins as J
from lodegrid.operators import overlap as V
from lodegrid.operators import state as S
from lodegrid.operators import windows as W
from lodegrid.plans import done as Z
from lodegrid.plans import gaps as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- evidence gaps ----------------------------------------------------------------------------------------------------
_EVIDENCE = """
    evidence AS (
        SELECT p_brand AS brand, n_name AS nation, o_orderstatus AS status, o_orderkey
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
             JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    grid AS (SELECT brand, nation FROM (SELECT DISTINCT p_brand AS brand FROM part), (SELECT n_name AS nation FROM nation)),
    cells AS (
        SELECT brand, nation, coalesce(n, 0) AS n FROM grid
        LEFT JOIN (SELECT brand, nation, count(DISTINCT o_orderkey) AS n FROM evidence GROUP BY ALL) USING (brand, nation))"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    part = t("part").select("p_partkey", F.col("p_brand").alias("brand"))
    orders = t("orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    buyer = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"))
    lines = t("lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyer, F.col("o_custkey") == F.col("c_custkey")).select("brand", "nation", "status", "o_orderkey")


def _axes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct(), table(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gap_matrix(_evidence(spark, sf_dir), "brand", "nation", "o_orderkey", *_axes(spark, sf_dir))


@query(f"""WITH {_EVIDENCE}, t AS (SELECT coalesce(quantile_cont(n, 0.25), 0.0) AS threshold FROM cells WHERE n > 0)
    SELECT brand, nation, n, threshold, n = 0 AS is_empty, n > 0 AND n <= threshold AS is_gap FROM cells, t""")
def gap_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(f"""WITH {_EVIDENCE}, t AS (SELECT coalesce(quantile_cont(n, 0.25), 0.0) AS threshold FROM cells WHERE n > 0),
    p AS (SELECT p_brand AS brand, count(DISTINCT p_size) AS prevalence FROM part GROUP BY 1)
    SELECT brand, nation, n, prevalence, round((threshold - n) / threshold, 6) AS shortfall, round((threshold - n) / threshold * prevalence, 6) AS priority,
           CASE WHEN nation IN ('NATION_0', 'NATION_1') THEN 'design_gap' WHEN prevalence >= 6 THEN 'automation_gap' ELSE 'evidence_gap' END AS bucket
    FROM cells CROSS JOIN t JOIN p USING (brand) WHERE n > 0 AND n <= threshold""")
def gap_priority(spark, sf_dir):
    prevalence = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count_distinct("p_size").alias("prevalence"))
    ranked = G.ranked_gaps(_matrix(spark, sf_dir), prevalence, "brand", "nation")
    bucket = G.bucketed(F.col("nation").isin("NATION_0", "NATION_1"), F.col("prevalence") >= 6)
    return ranked.select("brand", "nation", "n", "prevalence", F.round("shortfall", 6).alias("shortfall"), F.round("priority", 6).alias("priority"), bucket.alias("bucket"))


@query(f"""WITH {_EVIDENCE}, t AS (
        SELECT unnest([0.2, 0.25, 0.33, 0.4])::DOUBLE AS quantile, unnest(quantile_cont(n, [0.2, 0.25, 0.33, 0.4])) AS threshold FROM cells WHERE n > 0)
    SELECT quantile, round(threshold, 6) AS threshold, count(*) FILTER (n > 0 AND n <= threshold) AS gaps, count(*) FILTER (n = 0) AS empties, count(*) FILTER (n > threshold) AS normals
    FROM cells, t GROUP BY quantile, threshold""")
def threshold_sweep(spark, sf_dir):
    return A.threshold_sweep(_matrix(spark, sf_dir).select("brand", "nation", "n"), [0.2, 0.25, 0.33, 0.4]).withColumn("threshold", F.round("threshold", 6))


@query(f"""WITH {_EVIDENCE}, g AS (SELECT DISTINCT o_orderstatus AS status FROM orders),
    c AS (SELECT status, brand, nation, coalesce(n, 0) AS n FROM g CROSS JOIN grid
          LEFT JOIN (SELECT status, brand, nation, count(DISTINCT o_orderkey) AS n FROM evidence GROUP BY ALL) USING (status, brand, nation)),
    t AS (SELECT status, coalesce(quantile_cont(n, 0.25) FILTER (n > 0), 0.0) AS threshold FROM c GROUP BY 1)
    SELECT status, brand, nation, n, threshold, n = 0 AS is_empty, n > 0 AND n <= threshold AS is_gap FROM c JOIN t USING (status)""")
def gap_by_group(spark, sf_dir):
    groups = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")).distinct()
    return G.gap_matrix_by(_evidence(spark, sf_dir), "status", "brand", "nation", "o_orderkey", groups, *_axes(spark, sf_dir))


# -- cross-tabs and counts --------------------------------------------------------------------------------------------
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_TYPE_COUNTS = ", ".join(f"count(DISTINCT p_partkey) FILTER (p_type = '{t}') AS {t}" for t in _TYPES)


@query(f"""WITH f AS (SELECT unnest(string_split(p_name, ' ')) AS word, p_type, p_partkey FROM part), w AS (SELECT word, count(DISTINCT p_partkey) AS total_n FROM f GROUP BY 1)
    SELECT word, {_TYPE_COUNTS}, total_n, round(count(DISTINCT p_partkey) FILTER (p_type = 'ECONOMY') * 100.0 / total_n, 6) AS economy_share FROM f JOIN w USING (word) GROUP BY word, total_n""")
def crosstab_facet(spark, sf_dir):
    facets = table(spark, sf_dir, "part").select(F.explode(T.cells(F.col("p_name"), " ")).alias("word"), "p_type", "p_partkey")
    out = A.crosstab(facets, "word", "p_type", "p_partkey", _TYPES, facets.select("word").distinct())
    return A.with_share(out.join(A.distinct_per_group(facets, ["word"], "p_partkey", "total_n"), "word"), "ECONOMY", "total_n", "economy_share").withColumn("economy_share", F.round("economy_share", 6))


@query("""WITH c AS (SELECT n_name AS nation, r_name || ' / ' || c_mktsegment AS pair, count(DISTINCT c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
    SELECT n.nation, p.pair, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT nation FROM c) n CROSS JOIN (SELECT DISTINCT pair FROM c) p LEFT JOIN c USING (nation, pair)""")
def crosstab_pair(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("n_name").alias("nation"), F.concat_ws(" / ", "r_name", "c_mktsegment").alias("pair"), "c_custkey")
    counts = A.distinct_per_group(rows, ["nation", "pair"], "c_custkey")
    return A.zero_filled(counts, counts.select("nation").distinct(), counts.select("pair").distinct())


@query("""SELECT year(o_orderdate)::INT AS year, o_orderpriority AS priority, c_mktsegment AS segment, count(*) AS n, 20 + 30 * count(*) AS size
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def facet_panels(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = rows.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return out.withColumn("size", 20 + 30 * F.col("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def value_counts(spark, sf_dir):
    return A.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 6) AS percent FROM orders GROUP BY 1")
def breakdown(spark, sf_dir):
    return A.breakdown(table(spark, sf_dir, "orders"), "o_orderstatus").withColumn("percent", F.round("percent", 6))


@query("""SELECT 'lang' AS column_name, lang AS value, count(*) AS n FROM documents GROUP BY 2
    UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2""")
def distributions(spark, sf_dir):
    return A.distributions(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("""WITH d AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT unnest(['text', 'quality', 'toxic']) AS column_name, unnest([count(*) FILTER (trim(text) <> ''), count(quality), count(toxic)]) AS filled, count(*) AS total FROM d""")
def coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return A.coverage(rows, ["text", "quality", "toxic"])


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'X') AS X FROM orders")
def status_tally(spark, sf_dir):
    return A.tally(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "X"])


@query("""SELECT min(n_chars) AS lowest, max(n_chars) AS highest, round(avg(n_chars), 6) AS average,
    (SELECT n_chars FROM (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS k, count(*) OVER () AS c FROM documents) WHERE k = c // 2) AS upper_median FROM documents""")
def size_summary(spark, sf_dir):
    return A.summary(table(spark, sf_dir, "documents"), "n_chars").withColumn("average", F.round("average", 6))


@query("""WITH e AS (SELECT unnest([0, 100, 500, 1000, 5000, 20000])::DOUBLE AS bucket),
    b AS (SELECT max(bucket) AS bucket FROM documents, e WHERE bucket <= n_chars GROUP BY doc_id)
    SELECT e.bucket, count(b.bucket) AS n FROM e LEFT JOIN b USING (bucket) GROUP BY 1""")
def size_histogram(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "documents"), "n_chars", [0, 100, 500, 1000, 5000, 20000])


_RATED = """r AS (SELECT CASE quality WHEN 1 THEN 'include' ELSE 'exclude' END AS one,
               CASE WHEN toxic = 1 THEN 'defer' WHEN n_chars >= 1000 THEN 'include' ELSE 'exclude' END AS two FROM labels JOIN documents USING (doc_id))"""


@query(f"""WITH {_RATED}, b AS (SELECT * FROM r WHERE two <> 'defer'),
    m AS (SELECT avg((one = two)::INT) AS po, avg((one = 'include')::INT) AS p1, avg((two = 'include')::INT) AS p2, count(*) AS n_binary FROM b)
    SELECT (SELECT count(*) FROM r) AS n, (SELECT count(*) FROM r WHERE one = two) AS agreements, n_binary,
           round((po - (p1 * p2 + (1 - p1) * (1 - p2))) / (1 - (p1 * p2 + (1 - p1) * (1 - p2))), 6) AS kappa FROM m""")
def kappa(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    two = F.when(F.col("toxic") == 1, "defer").when(F.col("n_chars") >= 1000, "include").otherwise("exclude")
    pairs = rows.select(F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("one"), two.alias("two"))
    return A.agreement(pairs, "one", "two").withColumn("kappa", F.round("kappa", 6))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS leader FROM documents LEFT JOIN labels USING (doc_id)),
    c AS (SELECT count(*) AS s0, count(*) FILTER (leader) AS s1, count(*) FILTER (leader AND n_chars >= 200) AS s2,
          count(*) FILTER (leader AND n_chars >= 200 AND quality IS NOT NULL) AS s3, count(*) FILTER (leader AND n_chars >= 200 AND quality = 1) AS s4 FROM d)
    SELECT unnest(['unique', 'long enough', 'labelled', 'good']) AS stage, unnest([1, 2, 3, 4])::INT AS at, unnest([s0, s1, s2, s3]) AS n_in, unnest([s1, s2, s3, s4]) AS n_out,
           unnest([s0 - s1, s1 - s2, s2 - s3, s3 - s4]) AS removed FROM c""")
def funnel(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("leader"))
    rows = docs.select("doc_id", "n_chars").join(first, "doc_id", "left").join(labels, "doc_id", "left")
    return A.funnel(rows, [("unique", F.col("leader")), ("long enough", F.col("n_chars") >= 200), ("labelled", F.col("quality").isNotNull()), ("good", F.col("quality") == 1)])


@query("""WITH f AS (SELECT count(DISTINCT text) AS leaders, count(*) AS docs FROM documents), b AS (SELECT count(*) AS n_in, count(*) FILTER (quality = 1) AS good FROM labels)
    SELECT 'follows' AS rule, 'labelled' AS item, '' AS detail FROM f, b WHERE leaders <> n_in UNION ALL SELECT 'adds up', 'labelled', '' FROM b WHERE good < n_in""")
def done_funnel(spark, sf_dir):
    """A funnel of two tables: rows of the second that aren't of the first break the chain, and a stage that doesn't count what it removes fails."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("leader"))
    one = A.funnel(docs.join(first, "doc_id", "left"), [("unique", F.col("leader"))])
    two = A.funnel(labels, [("labelled", F.col("quality") == 1)]).withColumn("at", F.lit(2)).withColumn("removed", F.lit(0).cast("long"))
    return Z.funnel(one.unionByName(two))


@query("SELECT round(sum(l_quantity * 2 + l_linenumber * 12) / 1e6, 6) AS cost FROM lineitem")
def token_cost(spark, sf_dir):
    return A.cost(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber", 2.0, 12.0).withColumn("cost", F.round("cost", 6))


# -- de-duplication ---------------------------------------------------------------------------------------------------
@query(r"""WITH k AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key, (quality IS NOT NULL)::INT AS has_label,
               CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 1 ELSE 0 END AS lang_rank FROM documents LEFT JOIN labels USING (doc_id)),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY has_label DESC, n_chars DESC, lang_rank DESC, doc_id) AS k, count(*) OVER (PARTITION BY key) AS group_size FROM k)
    SELECT doc_id, md5(key) AS key_md5, group_size, sources FROM n JOIN (SELECT key, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM k GROUP BY 1) USING (key) WHERE k = 1""")
def leader_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = rows.select("doc_id", "source", "n_chars", "lang", "quality", F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).alias("key"))
    rows = rows.withColumn("key", F.md5(F.encode("key", "UTF-8")))
    score = [F.col("quality").isNotNull().cast("int").alias("s1"), F.col("n_chars").alias("s2"), F.when(F.col("lang") == "en", 2).when(F.col("lang") == "de", 1).otherwise(0).alias("s3")]
    return D.leaders(rows, "key", score, "doc_id", "source").select("doc_id", F.col("key").alias("key_md5"), "group_size", F.col("source").alias("sources"))


@query("""WITH d AS (SELECT doc_id, lang, CASE WHEN l.doc_id IS NOT NULL THEN 'doi:' || doc_id ELSE 'fallback:' || left(md5(text || '||' || lang), 12) END AS dedup_group
               FROM documents LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id))
    SELECT dedup_group, min(doc_id) AS doc_id, count(*) AS group_size FROM d GROUP BY 1""")
def fallback_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    rows = rows.select("doc_id", "has", F.md5(F.encode(F.concat_ws("||", "text", "lang"), "UTF-8")).alias("digest"))
    return D.deduplicated(rows, F.when(F.col("has"), F.col("doc_id").cast("string")), F.col("digest"), [F.lit(0).alias("s")], "doc_id").select("dedup_group", "doc_id", "group_size")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(lower(url), 'https?://([^/]+)', 1) AS host FROM pages)
    SELECT host, page_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS k FROM p) WHERE k = 1 OR host = ''""")
def first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(F.lower("url"), "https?://([^/]+)", 1).alias("host"))
    return D.first_wins(rows, F.col("host"), "page_id").select("host", "page_id")


@query(r"""WITH r AS (SELECT page_id, regexp_extract(url, 'https?://[^/]*/([a-z]+)/', 1) AS seed, 'tit:' || array_to_string(list_slice(regexp_extract_all(lower(regexp_extract(url, '^([^?#]*)', 1)), '([a-z0-9]+)', 1), 1, 10), ' ') || '|' AS key FROM pages)
    SELECT min(page_id) AS page_id, string_agg(DISTINCT seed, '|' ORDER BY seed) FILTER (seed <> '') AS seeds FROM r GROUP BY key""")
def merged_references(spark, sf_dir):
    plain = F.regexp_extract("url", "^([^?#]*)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "https?://[^/]*/([a-z]+)/", 1).alias("seeds"), T.reference_key(F.lit(""), plain, F.lit("")).alias("key"))
    return D.merged_references(rows, "key", "seeds", "page_id").select("page_id", F.nullif("seeds", F.lit("")).alias("seeds"))


# -- keys ---------------------------------------------------------------------------------------------------------------
_DOI_FORM = """CASE n_nationkey % 5 WHEN 0 THEN 'https://doi.org/10.1000/' || n_name || '.' WHEN 1 THEN ' HTTP://DX.DOI.ORG/10.1000/' || n_name
    WHEN 2 THEN 'doi:https://doi.org/10.1/' || n_name || '/' WHEN 3 THEN 'DOI:10.5/' || n_name || ';)' ELSE 'fallback:' || n_name END"""
_ANY = "^(https?://(dx\\.)?doi\\.org/|doi:)"


@query(f"""WITH f AS (SELECT n_nationkey, {_DOI_FORM} AS raw FROM nation)
    SELECT n_nationkey, nullif(lower(trim(regexp_replace(trim(raw), '{_ANY}', '', 'i'))), '') AS for_dedup,
        nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '^https://doi\\.org/', ''), '^http://doi\\.org/', ''), '^doi:', ''), '[.,;)]+$', ''), '') AS for_references,
        regexp_replace(regexp_replace(lower(trim(raw)), '{_ANY}', '', 'i'), '/+$', '') AS for_enrichment,
        regexp_replace(regexp_replace(lower(trim(raw)), '^https://doi\\.org/', ''), '^doi:', '') AS for_reconciliation,
        CASE WHEN starts_with(trim(raw), 'fallback:') THEN '' ELSE lower(regexp_replace(regexp_replace(trim(raw), '^doi:', ''), '^https://doi\\.org/', '')) END AS for_bibliography,
        replace(lower(trim(raw)), 'https://doi.org/', '') AS for_lookup FROM f""")
def doi_normalise(spark, sf_dir):
    raw = F.col("raw")
    forms = table(spark, sf_dir, "nation").select("n_nationkey", F.expr(_DOI_FORM).alias("raw"))
    names = {"for_dedup": K.doi_for_dedup, "for_references": K.doi_for_references, "for_enrichment": K.doi_for_enrichment, "for_reconciliation": K.doi_for_reconciliation, "for_bibliography": K.doi_for_bibliography, "for_lookup": K.doi_for_lookup}
    return forms.select("n_nationkey", *[f(raw).alias(n) for n, f in names.items()])


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS key_md5 FROM documents""")
def text_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(K.title_key(F.col("text")), "UTF-8")).alias("key_md5"))


@query("""SELECT c_custkey, left(md5(lower(trim(regexp_replace(c_name, '[^A-Za-z0-9_ ]', ' ', 'g'))) || '||' || (1990 + c_nationkey) || '||' || lower(c_mktsegment)), 12) AS fallback_id,
        'hash:' || left(md5(c_name), 12) AS record_id, left(md5(c_name || c_nationkey), 12) AS title_year_id,
        CASE WHEN c_acctbal < 0 THEN NULL ELSE 'doi:10.1/' || c_custkey END AS owner_doi, 'x' || c_custkey AS owner_any FROM customer""")
def record_keys(spark, sf_dir):
    name, nation = F.col("c_name"), F.col("c_nationkey").cast("string")
    authors = F.concat(F.col("c_mktsegment"), F.lit(", A.; Other, B."))
    passage = F.concat(F.when(F.col("c_acctbal") < 0, "doi:").otherwise("doi:10.1/"), F.col("c_custkey").cast("string"), F.when(F.col("c_acctbal") < 0, ":x").otherwise(":P01"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", K.fallback_key(name, (F.col("c_nationkey") + 1990).cast("string"), authors).alias("fallback_id"), K.record_id(F.lit(None), F.lit(""), name).alias("record_id"),
        K.title_year_hash(name, nation).alias("title_year_id"), K.passage_owner_doi(passage).alias("owner_doi"), K.passage_owner_any(F.concat(F.lit("x"), F.col("c_custkey").cast("string"), F.lit(":P001"))).alias("owner_any"),
    )


@query("""SELECT s_suppkey, 'supplier' || printf('%09d', s_suppkey) || ' of the ' || s_nationkey AS venue, 'B, A; D, C' AS authors, 'a b' AS name_key, 'confirmed' AS delta FROM supplier""")
def name_keys(spark, sf_dir):
    name = F.translate("s_name", "#", "")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", K.venue_key(F.concat(F.lit("Proceedings of the "), name, F.lit(" of the "), F.col("s_nationkey").cast("string"))).alias("venue"), K.authors_from_bibtex(F.lit("B, A and D, C")).alias("authors"),
        K.name_set_key(F.lit("B. Á")).alias("name_key"), K.author_delta(F.lit("B, A; D, C"), F.lit("C D; A B")).alias("delta"),
    )


# -- matching -----------------------------------------------------------------------------------------------------------
_FLAT = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(rf"""WITH b AS (SELECT item_id, text, {_FLAT} AS flat, regexp_extract_all(lower(text), '([a-z0-9]+)', 1)[1] AS word FROM benchmark),
    t AS (SELECT text AS key, min(item_id) AS item_id FROM b GROUP BY 1), p AS (SELECT flat AS key, min(item_id) AS item_id FROM b GROUP BY 1), w AS (SELECT word AS key, min(item_id) AS item_id FROM b GROUP BY 1),
    d AS (SELECT doc_id, text, {_FLAT} AS flat, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS words FROM documents),
    u AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d), h AS (SELECT doc_id, arg_min(item_id, pos) AS item_id FROM u JOIN w ON word = key GROUP BY 1)
    SELECT d.doc_id, coalesce(t.item_id, p.item_id, h.item_id) AS item_id, CASE WHEN t.item_id IS NOT NULL THEN 'text' WHEN p.item_id IS NOT NULL THEN 'flat' WHEN h.item_id IS NOT NULL THEN 'word' ELSE 'none' END AS method
    FROM d LEFT JOIN t ON d.text = t.key LEFT JOIN p ON d.flat = p.key LEFT JOIN h ON d.doc_id = h.doc_id""")
def cascade_match(spark, sf_dir):
    """The same text, else the same but for case and blanks, else the first of all words that begins a passage."""
    docs, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    flat = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    index = lambda key: b.groupBy(key.alias("key")).agg(F.min("item_id").alias("item_id"))
    words = T.tokens(F.col("text"))
    rows = docs.select("doc_id", F.array("text").alias("a"), F.array(flat).alias("b"), F.array_distinct(words).alias("c"))
    steps = [("text", F.col("a"), index(F.col("text"))), ("flat", F.col("b"), index(flat)), ("word", F.col("c"), index(F.try_element_at(words, F.lit(1))))]
    return J.cascade(rows, "doc_id", steps, ["item_id"]).select("doc_id", "item_id", "method")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_name END, s_name, n_name) AS name, CASE WHEN c_acctbal > 5000 THEN 'original' WHEN s_name IS NOT NULL THEN 'supplier' ELSE 'nation' END AS origin
    FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey LEFT JOIN nation ON c_custkey % 25 = n_nationkey""")
def backfill_source(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("k1"), F.when(F.col("c_acctbal") > 5000, F.col("c_name")).otherwise("").alias("name"))
    by_nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 25).cast("int").alias("n")).join(table(spark, sf_dir, "nation"), F.col("n") == F.col("n_nationkey")).select("key", F.col("n_name").alias("value"))
    sources = [("supplier", table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))), ("nation", by_nation)]
    return J.filled(rows, "c_custkey", "name", sources).select("c_custkey", "name", "origin")


@query("""SELECT doc_id, toxic, CASE WHEN toxic IS NULL THEN 'no_match' ELSE 'matched' END AS lookup FROM documents LEFT JOIN labels USING (doc_id)""")
def lookup_status(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("k"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("lk"), "toxic")
    return J.lookup_with_status(docs, "k", labels, "lk", ["toxic"]).select("doc_id", "toxic", "lookup")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return S.remaining(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_filter(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, 1 AS n FROM customer)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' ELSE 'duplicate' END AS state, coalesce(a.n, 0)::BIGINT AS n_left, coalesce(b.n, 0)::BIGINT AS n_right
    FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS NULL OR b.n IS NULL OR a.n > 1""")
def set_reconcile(spark, sf_dir):
    return J.reconciled(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("""SELECT page_id, lang FROM pages JOIN (SELECT DISTINCT lang FROM documents) ON lang <> '' AND contains(url, lang)""")
def key_containment(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    return J.contained_keys(table(spark, sf_dir, "pages").select("page_id", "url"), "url", langs, "lang").select("page_id", "lang")


@query("""WITH a AS (SELECT c.conv_id, c.turn, c.text AS asked, d.text AS answered FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1 WHERE c.role = 'user' AND d.role = 'assistant'),
    w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(asked), '([a-z0-9]+)', 1)) AS x, list_distinct(regexp_extract_all(lower(answered), '([a-z0-9]+)', 1)) AS y FROM a)
    SELECT conv_id, turn, round(CASE WHEN greatest(len(x), len(y)) > 0 THEN len(list_intersect(x, y)) / greatest(len(x), len(y)) ELSE 0 END, 6) AS overlap FROM w""")
def turn_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    answered = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answered"))
    return asked.join(answered, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.word_overlap(T.tokens(F.col("asked")), T.tokens(F.col("answered"))), 6).alias("overlap"))


@query("""SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) OR (lang = 'fr' AND source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND lang = 'de')) AS is_known FROM documents d""")
def already_decided(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    refs = docs.select("doc_id", F.when(F.col("lang") == "fr", "").otherwise("doi").alias("doi"), F.col("doc_id").cast("string").alias("record_id"), F.col("source").alias("title_year"))
    toxic = labels.filter("toxic = 1").select(F.lit("").alias("doi"), F.col("doc_id").cast("string").alias("record_id"), F.lit("").alias("title_year"))
    bad = labels.filter("quality = 0").join(docs.filter("lang = 'de'"), "doc_id").select(F.lit("").alias("doi"), F.lit("").alias("record_id"), F.col("source").alias("title_year"))
    return J.already_known(refs, toxic.unionByName(bad)).select("doc_id", "is_known")


# -- order --------------------------------------------------------------------------------------------------------------
_TOKENS = r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1))) AS label FROM documents"
_CURVE = """f AS (SELECT label, min(rank) AS rank FROM pairs JOIN ord USING (entity) GROUP BY 1), n AS (SELECT rank, count(*) AS new_count FROM f GROUP BY 1)
    SELECT rank, entity, coalesce(new_count, 0) AS new_count, sum(coalesce(new_count, 0)) OVER (ORDER BY rank)::BIGINT AS cumulative_count,
           rank >= ceil((1.0::DOUBLE - 0.1::DOUBLE) * (SELECT count(*) FROM ord)) + 1 AS in_final_window FROM ord LEFT JOIN n USING (rank)"""


@query(f"WITH pairs AS (SELECT doc_id AS entity, label FROM ({_TOKENS})), ord AS (SELECT doc_id AS entity, row_number() OVER (ORDER BY doc_id)::BIGINT AS rank FROM documents), {_CURVE}")
def saturation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pairs = docs.select(F.col("doc_id").alias("entity"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("label"))
    order = W.ranked(docs.select(F.col("doc_id").alias("entity"), F.floor(F.col("doc_id") / 10_000).alias("b")), [F.col("entity")], buckets="b").select("entity", "rank")
    return W.saturation(pairs, order, "entity", "label")


_USERS = "pairs AS (SELECT DISTINCT user_id AS entity, json_extract(props, '$.k')::INT AS label FROM events), ord AS (SELECT user_id AS entity, row_number() OVER (ORDER BY min(ts), user_id)::BIGINT AS rank FROM events GROUP BY 1)"


def _user_curve(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    pairs = events.select(F.col("user_id").alias("entity"), F.get_json_object("props", "$.k").cast("int").alias("label")).distinct()
    order = W.ranked(events.groupBy(F.col("user_id").alias("entity")).agg(F.min("ts").alias("ts")), [F.col("ts").asc_nulls_last(), F.col("entity")]).select("entity", "rank")
    return W.saturation(pairs, order, "entity", "label")


@query(f"WITH {_USERS}, {_CURVE}")
def saturation_users(spark, sf_dir):
    return _user_curve(spark, sf_dir)


@query(f"""WITH c AS (WITH {_USERS}, {_CURVE}), v AS (SELECT count(*) AS entities, count(*) FILTER (in_final_window) AS inside, coalesce(sum(new_count) FILTER (in_final_window), 0)::BIGINT AS new_in_window, max(cumulative_count) AS total FROM c)
    SELECT entities, inside AS "window", new_in_window, total, round(coalesce(new_in_window / inside, 0), 6) AS per_entity, new_in_window = 0 AS saturated FROM v""")
def saturation_verdict(spark, sf_dir):
    return W.saturation_verdict(_user_curve(spark, sf_dir)).withColumn("per_entity", F.round("per_entity", 6))


@query("""SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, n_chars DESC, doc_id)::BIGINT AS by_lang FROM documents""")
def rank_orders(spark, sf_dir):
    level = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", level.alias("level"))
    return W.ranked(rows, [F.col("level"), F.col("n_chars").desc(), F.col("doc_id")], "by_lang").select("doc_id", "by_lang")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def top_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return W.top_per_group(rows, ["o_custkey"], F.col("o_totalprice"), "o_orderkey")


@query("""WITH r AS (SELECT unnest(['en', 'de', 'fr', 'es']) AS lang, unnest([0.05, 0.1, 0.1, 0.5])::DOUBLE AS rate, unnest(range(4)) AS place),
    s AS (SELECT lang, place, count(*) AS size, least(count(*), greatest(1, floor(count(*) * any_value(rate))))::BIGINT AS want FROM documents JOIN r USING (lang) GROUP BY lang, place),
    t AS (SELECT lang, least(want, greatest(0, 60 - coalesce(sum(want) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM s),
    d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents)
    SELECT doc_id, lang FROM d JOIN t USING (lang) WHERE k <= take""")
def stratified_sample(spark, sf_dir):
    return W.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", [("en", 0.05), ("de", 0.1), ("fr", 0.1), ("es", 0.5)], 60)


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def simple_sample(spark, sf_dir):
    return W.simple_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 7)


@query("SELECT n_nationkey, 'snow_' || printf('%05d', row_number() OVER (ORDER BY n_name) - 1) AS ref_id FROM nation")
def renumbered(spark, sf_dir):
    return W.renumbered(table(spark, sf_dir, "nation"), [F.col("n_name")], "snow_").select("n_nationkey", "ref_id")


# -- text ---------------------------------------------------------------------------------------------------------------
_PAGES = """CASE n_chars % 8 WHEN 0 THEN '12-' || (9999999990 + n_chars) WHEN 1 THEN n_chars || '--' || (n_chars + 3) WHEN 2 THEN 'art' || n_chars || ':17pp' WHEN 3 THEN n_chars::VARCHAR
    WHEN 4 THEN 'e' || n_chars WHEN 5 THEN 'iii-xxii' WHEN 6 THEN '9-3' ELSE '' END"""


@query(f"""WITH p AS (SELECT doc_id, {_PAGES} AS s FROM documents), q AS (SELECT doc_id, s, regexp_replace(s, '-+', '-', 'g') AS t FROM p),
    c AS (SELECT doc_id, CASE WHEN regexp_matches(s, '\\d+\\s*pp\\b') THEN regexp_extract(s, '(\\d+)\\s*pp\\b', 1)::BIGINT
            WHEN regexp_full_match(t, '\\d+-\\d+') THEN CASE WHEN regexp_extract(t, '-(\\d+)', 1)::BIGINT >= regexp_extract(t, '^(\\d+)', 1)::BIGINT THEN regexp_extract(t, '-(\\d+)', 1)::BIGINT - regexp_extract(t, '^(\\d+)', 1)::BIGINT + 1 END
            WHEN regexp_full_match(t, '\\d+') THEN 1 END AS page_count FROM q)
    SELECT doc_id, page_count, CASE WHEN page_count IS NULL THEN 'manual_review' WHEN page_count >= 4 THEN 'pass' ELSE 'fail' END AS page_status FROM c""")
def page_range(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PAGES.replace("::VARCHAR", " || ''")).alias("s"))
    return pages.withColumn("page_count", T.page_count(F.col("s"))).select("doc_id", "page_count", T.three_way(F.col("page_count")).alias("page_status"))


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'manual_review' WHEN n_chars // 500 >= 4 THEN 'pass' ELSE 'fail' END AS status FROM documents LEFT JOIN labels USING (doc_id)""")
def status_three_way(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", T.three_way(F.when(F.col("quality").isNotNull(), F.floor(F.col("n_chars") / 500))).alias("status"))


_GRAMS = r"""(SELECT {id}, unnest(list_distinct(list_transform(range(1, greatest(1, len(t) - 13)), lambda i: array_to_string(t[i:i + 14], ' ')))) AS ngram
    FROM (SELECT {id}, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS t FROM {table}))"""


@query(f"""SELECT d.doc_id AS target_id, ngram, min(item_id) AS first_source FROM {_GRAMS.format(id="doc_id", table="documents")} d JOIN {_GRAMS.format(id="item_id", table="benchmark")} b USING (ngram) GROUP BY 1, 2""")
def ngram_overlap(spark, sf_dir):
    return V.shared_ngrams(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 15)


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '```.*?```', ' ', 'gs'), '`[^`]*`', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '(?m)^\s*#+\s*', '', 'g'), '(?m)^\s*[-*+]\s+', '', 'g'), '(?m)^\s*\d+\.\s+', '', 'g'), '[*_~]{1,3}', '', 'g'), '(?m)^>\s*', '', 'g')) AS plain_md5 FROM pages""")
def markdown_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.encode(T.without_markdown(F.col("html")), "UTF-8")).alias("plain_md5"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS w FROM documents) SELECT doc_id, len(w)::INT AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM t""")
def tokens(spark, sf_dir):
    w = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n_tokens"), F.md5(F.encode(F.array_join(w, " "), "UTF-8")).alias("tokens_md5"))


@query(r"""WITH t AS (SELECT item_id, w, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS w FROM benchmark) GROUP BY ALL), m AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM t GROUP BY 1)
    SELECT a.item_id AS left_id, b.item_id AS right_id, round(sum(a.n * b.n) / any_value(x.norm) / any_value(y.norm), 6) AS cosine FROM t a JOIN t b USING (w) JOIN m x ON x.item_id = a.item_id JOIN m y ON y.item_id = b.item_id GROUP BY 1, 2 HAVING sum(a.n * b.n) / any_value(x.norm) / any_value(y.norm) >= 0.5""")
def tf_cosine(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return V.token_cosine(b, b, 0.5).withColumn("cosine", F.round("cosine", 6))


@query("SELECT json_extract(props, '$.k')::INT AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def json_facet(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.from_json("props", "k int").getField("k").alias("k"), "event_type")
    return events.groupBy("k", "event_type").agg(F.count("*").alias("n"))


@query(r"""SELECT conv_id, turn, md5(array_to_string(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), ' ')) AS rebuilt_md5 FROM conversations WHERE len(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) > 0""")
def inverted_index(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.tokens(F.col("text"))).alias("at", "word"))
    index = words.groupBy("conv_id", "turn", "word").agg(F.sort_array(F.collect_list("at")).alias("places")).groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return index.select("conv_id", "turn", F.md5(F.encode(T.rebuilt_text(F.col("index")), "UTF-8")).alias("rebuilt_md5"))


@query("""WITH c AS (SELECT doc_id, text, unnest(range(1, greatest(2, length(text) - 500 + 1), 11500)) AS place FROM documents WHERE length(text) > 0)
    SELECT doc_id, count(*)::INT AS n_chunks, sum(length(substring(text, place::BIGINT, 12000)))::BIGINT AS chars FROM c GROUP BY 1""")
def chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("length(text) > 0").select("doc_id", T.chunks(F.col("text")).alias("c"))
    return docs.select("doc_id", F.size("c").alias("n_chunks"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


@query(r"""WITH u AS (SELECT page_id, regexp_extract_all(upper(url), '\b([A-Z]{2,8})\b', 1) AS caps, lower(url) AS low FROM pages)
    SELECT page_id, array_to_string(caps, ' ') AS caps, length(low) < 15 OR contains(low, '://') OR regexp_matches(low, '\b(19|20)\d{2}\b') AS low_confidence FROM u""")
def title_tests(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.capital_tokens(F.upper("url")), " ").alias("caps"), T.low_confidence_title(F.lower("url")).alias("low_confidence"))


# -- state, rules, clusters, references ------------------------------------------------------------------------------------
@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def event_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("seq"))
    return L.folded(events, "user_id", "seq").select("user_id", "event_id", "event_type")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'bad' WHEN l.quality = 1 THEN 'good' END, d.source) AS source, d.lang FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def upsert(spark, sf_dir):
    changes = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "bad").when(F.col("quality") == 1, "good").alias("source"))
    return S.upserted(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), changes, "doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) FROM orders)")
def undo_last(spark, sf_dir):
    return S.without_last(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('P', 'O') AND date_diff('day', o_orderdate::DATE, DATE '1998-08-01') >= 14""")
def overdue(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus").isin("P", "O"), "pending").otherwise("done").alias("state"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("first_attempt"))
    return S.overdue(rows, "1998-08-01").select("o_orderkey")


@query("""SELECT 'quality present' AS rule, doc_id::VARCHAR AS item, '' AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'known language', doc_id::VARCHAR, lang FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
    UNION ALL SELECT 'unique text', md5(text), count(*)::VARCHAR FROM documents GROUP BY text HAVING count(*) > 1
    UNION ALL SELECT 'one order a line', l_orderkey::VARCHAR, '' FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
    UNION ALL SELECT 'two parts a brand and size', b, n::VARCHAR FROM (SELECT p_brand || '/' || p_size AS b, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1) WHERE n < 2""")
def dod_violations(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    docs = t("documents")
    labelled = docs.join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    texts = docs.select(F.md5(F.encode("text", "UTF-8")).alias("digest"))
    parts = t("part").select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("kind"))
    return Q.violations(
        Q.rows_failing(labelled, "quality present", F.col("quality").isNull(), "doc_id"),
        Q.in_vocabulary(docs, "known language", "lang", ["en", "de", "fr"], "doc_id"),
        Q.unique(texts, "unique text", "digest"),
        Q.resolves(t("lineitem"), "one order a line", "l_orderkey", t("orders"), "o_orderkey"),
        Q.at_least(parts, "two parts a brand and size", "kind", "p_partkey", parts, 2),
    )


@query("""WITH RECURSIVE v AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), near AS (SELECT a.i, b.i AS j, 1 - list_cosine_similarity(a.e, b.e) AS d FROM v a JOIN v b ON a.i <> b.i),
    linked AS (SELECT DISTINCT i FROM near WHERE d < 0.6), dist AS (SELECT near.* FROM near JOIN linked x ON near.i = x.i JOIN linked y ON near.j = y.i),
    merged(step, item, cluster) AS (SELECT 0, i, i FROM linked UNION ALL
        (WITH best AS (SELECT a, b FROM (SELECT x.cluster AS a, y.cluster AS b, max(d) AS far FROM merged x JOIN dist ON x.item = dist.i JOIN merged y ON y.item = dist.j WHERE x.cluster < y.cluster GROUP BY ALL) WHERE far < 0.6 ORDER BY far, a, b LIMIT 1)
         SELECT m.step + 1, m.item, CASE WHEN m.cluster = best.b THEN best.a ELSE m.cluster END FROM merged m, best))
    SELECT i AS item, coalesce(cluster, i) AS cluster FROM v LEFT JOIN (SELECT item, cluster FROM merged WHERE step = (SELECT max(step) FROM merged)) ON i = item""")
def cosine_clusters(spark, sf_dir):
    """Complete linkage over all vectors. No two are nearer than 0.47 here, so the threshold is 0.6."""
    return L.clusters_of_all(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.6)


@query(r"""WITH t AS (SELECT item_id, 'On ' || trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]', '', 'g'), '\s+', ' ', 'g')) AS title, CAST(1990 + item_id % 30 AS STRING) AS year FROM benchmark)
    SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Smith, J' ELSE 'Doe, A., Roe, B.' END AS authors, left(title, 500) AS title, year, '10.1000/x' || item_id AS doi FROM t""")
def citation_parse(spark, sf_dir):
    """Two layouts of the same record: with the year after the authors, and with a colon."""
    year, title = (F.lit(1990) + F.col("item_id") % 30).cast("string"), F.concat(F.lit("On "), F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z ]", ""), r"\s+", " ")))
    doi = F.concat(F.lit(" https://doi.org/10.1000/x"), F.col("item_id").cast("string"))
    by_year = F.concat(F.lit("[1] Smith, J. "), year, F.lit(". "), title, F.lit(". Journal of Tests."), doi)
    by_colon = F.concat(F.lit("Doe, A., Roe, B.: "), title, F.lit(". Journal of Tests ("), year, F.lit(")"), F.replace(doi, F.lit("https://doi.org/"), F.lit("")))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, by_year).otherwise(by_colon).alias("raw"))
    return C.with_citation(rows, "raw", "c").select("item_id", "c.*")


@query("""SELECT cluster AS kind, count(*) AS size FROM (SELECT p_type AS cluster FROM part) GROUP BY 1""")
def cluster_members(spark, sf_dir):
    return L.members(table(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), "p_partkey"), "kind", "p_partkey").select("kind", "size")


