"""Queries over records made from the driver's tables: files written and read again, keys, decisions, rules; with their SQL.

A record's columns are expressions that both engines read alike, so the SQL states the rule and not the code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.functions import citations as C
from lodegrid.functions import keys as K
from lodegrid.functions import text as T
from lodegrid.operators import aggregates as A
from lodegrid.operators import checks as Q
from lodegrid.operators import clustering as L
from lodegrid.operators import embedding as E
from lodegrid.operators import joins as J
from lodegrid.operators import overlap as V
from lodegrid.operators import references as R
from lodegrid.operators import state as S
from lodegrid.operators import windows as W
from lodegrid.plans import charts as H
from lodegrid.plans import corpus as P
from lodegrid.plans import decisions as X
from lodegrid.plans import done as Z
from lodegrid.plans import gaps as G
from lodegrid.plans import reports as M
from lodegrid import queries as Y
from lodegrid.queries import query, table
from lodegrid.session import scratch
from lodegrid.sources import readers as I
from lodegrid.sources import records as N
from lodegrid.sources import writers as O
from lodegrid.streaming import streams

Columns = dict[str, str]


def made(spark: SparkSession, sf_dir: str, name: str, columns: Columns) -> DataFrame:
    return table(spark, sf_dir, name).select(*[F.expr(e).alias(n) for n, e in columns.items()])


def sql_of(name: str, columns: Columns) -> str:
    return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {name})"


# -- files: CSV ---------------------------------------------------------------------------------------------------------
_PAPER: Columns = {
    "id": "CAST(c_custkey AS STRING)",
    "title": "c_name || CASE WHEN c_custkey % 4 = 0 THEN ', \"quoted\" part' WHEN c_custkey % 4 = 1 THEN ' of {Braces}' ELSE '' END",
    "rank": "CASE c_custkey % 6 WHEN 0 THEN 'A*' WHEN 1 THEN 'N/A' WHEN 2 THEN 'nan' WHEN 3 THEN 'Not found' WHEN 4 THEN NULL ELSE 'B' END",
    "year": "CAST(1990 + c_nationkey AS STRING)",
}


@query(f"SELECT id, title, coalesce(rank, '') AS rank, year FROM {sql_of('customer', _PAPER)}")
def csv_strings(spark, sf_dir):
    """Written with all cells quoted, read as strings, blanks filled: what is quoted inside comes back."""
    path = scratch(spark)
    O.quoted_csv(made(spark, sf_dir, "customer", _PAPER), path)
    return I.csv(spark, path, list(_PAPER), blanks=True)


@query(f"SELECT id, title, CASE WHEN rank IN ('N/A', 'nan') THEN NULL ELSE rank END AS rank, year::INT AS year FROM {sql_of('customer', _PAPER)}")
def csv_missing_tokens(spark, sf_dir):
    """Types from the header and the values, and the tokens for missing values as nulls."""
    path = scratch(spark)
    O.quoted_csv(made(spark, sf_dir, "customer", _PAPER), path)
    rows = I.csv(spark, path, missing_tokens=True, required=["id", "rank"])
    return rows.withColumn("year", K.year_number(F.col("year")))


@query("""SELECT CAST(p_partkey AS STRING) AS id, p_name AS title, CASE WHEN p_size % 3 = 0 THEN p_size || '-' || (p_size + 9) WHEN p_size % 3 = 1 THEN CAST(p_size AS STRING) ELSE '' END AS pageRange FROM part""")
def export_table(spark, sf_dir):
    path = scratch(spark)
    rows = made(spark, sf_dir, "part", {"EID": "CAST(p_partkey AS STRING)", "Document Title": "p_name", "Page start": "CASE WHEN p_size % 3 < 2 THEN CAST(p_size AS STRING) END", "Page end": "CASE WHEN p_size % 3 = 0 THEN CAST(p_size + 9 AS STRING) END"})
    O.quoted_csv(rows, path)
    out = I.export_table(spark, path, {"eid": "id", "DOCUMENT TITLE": "title", "page START": "page_start", "page end": "page_end"})
    return out.select("id", "title", "pageRange")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey % 2 = 0")
def newest_file(spark, sf_dir):
    """Of files whose names carry a date the last one with the prefix."""
    folder = scratch(spark)
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    for name, part in (("works_20240101", rows.filter("k % 3 = 0")), ("works_20250301", rows.filter("k % 2 = 0")), ("works_20241231", rows), ("zzz_20260101", rows)):
        part.write.parquet(f"{folder}/{name}")
    return spark.read.parquet(I.newest(spark, folder, "works_"))


# -- files: BibTeX, Markdown, JSON --------------------------------------------------------------------------------------
@query(r"""SELECT 'k' || p_partkey AS citekey, CASE WHEN p_size % 2 = 0 THEN 'article' ELSE 'inproceedings' END AS type, '{' || p_name || '} \& {' || p_brand || '}' AS title, CAST(1980 + p_size AS STRING) AS year FROM part""")
def bibtex_files(spark, sf_dir):
    """Entries written to several files and parsed again: nested braces, escapes, quoted and bare values."""
    path = scratch(spark)
    t = table(spark, sf_dir, "part")
    title = F.concat(F.lit("{"), F.col("p_name"), F.lit("} \\& {"), F.col("p_brand"), F.lit("}"))
    entry = F.format_string("@%s{k%s,\n  title = {%s},\n  year = %s\n}\n", F.when(F.col("p_size") % 2 == 0, "Article").otherwise("InProceedings"), F.col("p_partkey").cast("string"), title, F.concat(F.when(F.col("p_size") % 3 == 0, '"').otherwise(""), (F.col("p_size") + 1980).cast("string"), F.when(F.col("p_size") % 3 == 0, '"').otherwise("")))
    files = t.groupBy((F.col("p_partkey") % 4).alias("file")).agg(F.array_join(F.array_sort(F.collect_list(F.struct(F.col("p_partkey"), entry.alias("e")))).getField("e"), "\n").alias("value"))
    files.repartition(4, "file").write.partitionBy("file").option("compression", "none").text(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return I.parsed_bibtex(found).select("citekey", "type", F.col("fields")["title"].alias("title"), F.col("fields")["year"].alias("year"))


@query(r"""SELECT p_name || CAST(p_partkey AS STRING) AS title, replace(replace(replace(p_brand || ' 5% a_b', '%', '\%'), '#', '\#'), '_', '\_') AS venue FROM part""")
def bibtex_written(spark, sf_dir):
    """What the writer of entries escapes, as the parser reads it; blank fields are left out."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("title"), F.concat("p_brand", F.lit(" 5% a_b")).alias("venue"))
    entry = O.bibtex_text(F.lit("article"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")), {"title": F.col("title"), "journal": F.col("venue"), "note": F.lit(" ")})
    found = I.parsed_bibtex(t.select(F.lit("x.bib").alias("path"), F.encode(entry, "UTF-8").alias("content")))
    return found.filter("fields['note'] is null").select(F.col("fields")["title"].alias("title"), F.col("fields")["journal"].alias("venue"))


_PASSAGE = r"""(SELECT 'c' || conv_id AS file, 'P' || lpad(CAST(turn AS STRING), 3, '0') AS passage, role AS section, regexp_replace(text, '\s+', ' ', 'g') AS quote FROM conversations)"""


@query(rf"""SELECT file, passage, section, md5(trim(quote)) AS quote_md5 FROM {_PASSAGE}""")
def passage_files(spark, sf_dir):
    """Markdown with a block for each passage, written, then located block by block."""
    path = scratch(spark)
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), F.lit("t").alias("title"), F.concat(F.lit("P"), F.lpad(F.col("turn").cast("string"), 3, "0")).alias("passage"), F.col("role").alias("section"), F.lit("x").alias("relevance"), F.regexp_replace("text", r"\s+", " ").alias("quote"))
    O.passage_files(rows).write.parquet(path)
    found = I.passage_blocks(spark.read.parquet(path), "file", "value")
    return found.select("file", "passage", I.bold_field(F.col("text"), "Section").alias("section"), F.md5(F.encode(F.trim(F.regexp_extract("text", r"(?s)> (.*)\z", 1)), "UTF-8")).alias("quote_md5"))


@query("""SELECT n_name AS label, arg_min(r_name, r_regionkey) AS section FROM (SELECT n_name, r_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT n_name, 'Late', 99 FROM nation WHERE n_nationkey % 2 = 0) GROUP BY 1""")
def markdown_placements(spark, sf_dir):
    """Tables under headings of one file: the first section of a label counts."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "r_regionkey")
    rows = rows.unionByName(t("nation").filter("n_nationkey % 2 = 0").select("n_name", F.lit("Late").alias("r_name"), F.lit(99).alias("r_regionkey")))
    line = lambda c: F.concat(F.lit("| "), c, F.lit(" | text |"))
    blocks = rows.groupBy("r_regionkey", "r_name").agg(F.array_join(F.array_sort(F.collect_list(line(F.col("n_name")))), "\n").alias("b"))
    block = F.concat(F.lit("## "), F.col("r_name"), F.lit("\n\n|---|---|\n"), F.col("b"), F.lit("\n"))
    whole = blocks.groupBy(F.lit("f.md").alias("file")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("r_regionkey", block.alias("t")))).getField("t"), "\n").alias("text"))
    return I.table_labels(I.sections(whole, "file", "text"))


@query("""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN md5('## F1 ' || rtrim(regexp_replace(text, '\\s+', ' ', 'g'))) ELSE md5(left('x ## F1 ' || regexp_replace(text, '\\s+', ' ', 'g'), 100)) END AS excerpt_md5, regexp_replace(trim(text), '\\s+', ' ', 'g') = flat AS is_flat
    FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM benchmark)""".replace("\\\\", "\\"))
def excerpts(spark, sf_dir):
    """From the first mark, which stays, to the other; without one of them the beginning of the text."""
    flat = F.regexp_replace("text", r"\s+", " ")
    b = table(spark, sf_dir, "benchmark").withColumn("flat", T.flat(F.col("text")))
    whole = F.concat(F.lit("x ## F1 "), flat, F.when(F.col("item_id") % 3 == 0, " ## F2 y ## F2 z").otherwise(""))
    b = b.withColumn("whole", whole)
    return b.select("item_id", F.md5(F.encode(T.between(F.col("whole"), "## F1", "## F2", 100), "UTF-8")).alias("excerpt_md5"), (F.trim(flat) == F.col("flat")).alias("is_flat"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 100, 'last'")
def json_snapshot(spark, sf_dir):
    """A snapshot is replaced as a whole; a broken and a missing file are empty tables; finished state is deleted."""
    folder = scratch(spark)
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    S.replaced(rows.limit(3), f"{folder}/state")
    S.replaced(rows.withColumn("k", F.col("k").cast("int")), f"{folder}/state")
    spark.read.parquet(f"{folder}/state").write.json(f"{folder}/json")
    spark.range(1).select(F.lit("{broken").alias("value")).write.text(f"{folder}/broken")
    schema = "k int, name string"
    found = spark.read.schema(schema).json(f"{folder}/json").unionByName(I.json_state(spark, f"{folder}/broken", schema)).unionByName(I.json_state(spark, f"{folder}/none", schema))
    S.replaced(rows, f"{folder}/done")
    S.dropped(spark, f"{folder}/done")
    gone = I.json_state(spark, f"{folder}/done", schema)
    return found.unionByName(gone).unionByName(spark.range(1).select(F.lit(100).alias("k"), F.lit("last").alias("name")))


# -- services' answers ---------------------------------------------------------------------------------------------------
@query("""SELECT c_custkey, 'https://doi.org/10.1/X' || c_custkey AS raw, '10.1/x' || c_custkey AS doi, 1990 + c_nationkey AS year, CASE WHEN c_nationkey % 2 = 0 THEN c_name || '; ' || c_mktsegment ELSE c_name END AS authors,
    c_nationkey % 5 = 0 AS retracted, c_mktsegment || ' of ' || c_mktsegment AS abstract, c_nationkey % 3 = 0 AS preprint, c_nationkey % 4 = 0 AS mismatch FROM customer""")
def service_works(spark, sf_dir):
    """Nested JSON as flat rows, and the flags that follow from it."""
    c = table(spark, sf_dir, "customer")
    raw = F.concat(F.lit("https://doi.org/10.1/X"), F.col("c_custkey").cast("string"))
    person = lambda name: F.struct(F.struct(name.alias("display_name")).alias("author"))
    names = F.when(F.col("c_nationkey") % 2 == 0, F.array(person(F.col("c_name")), person(F.col("c_mktsegment")))).otherwise(F.array(person(F.col("c_name"))))
    index = F.map_from_arrays(F.array(F.col("c_mktsegment"), F.lit("of")), F.array(F.array(F.lit(0), F.lit(2)), F.array(F.lit(1))))
    source = F.struct(F.struct(F.lit("V").alias("display_name"), F.when(F.col("c_nationkey") % 4 == 0, "journal").otherwise("conference").alias("type")).alias("source"))
    work = F.struct(raw.alias("doi"), F.lit("t").alias("title"), (F.col("c_nationkey") + 1990).alias("publication_year"), F.when(F.col("c_nationkey") % 3 == 0, "preprint").otherwise("article").alias("type"), (F.col("c_nationkey") % 5 == 0).alias("is_retracted"), names.alias("authorships"), source.alias("primary_location"), index.alias("abstract_inverted_index"))
    flat = N.works(c.select("c_custkey", raw.alias("raw"), F.to_json(work).alias("j")), "j").join(c.select("c_custkey", F.concat(F.lit("10.1/x"), F.col("c_custkey").cast("string")).alias("doi"), raw.alias("raw")), "doi")
    flags = N.flags(F.col("kind"), F.col("source_kind"), F.lit("Conference Paper"), F.col("retracted"), F.col("paratext"))
    return flat.select("c_custkey", "raw", "doi", "year", "authors", "retracted", "abstract", flags["preprint"].alias("preprint"), flags["source_mismatch"].alias("mismatch"))


@query("""SELECT 'r' || o_orderkey AS custom_id, 'c' || (o_orderkey % 3) AS check_id, CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'pass' END AS verdict, CASE o_orderkey % 3 WHEN 0 THEN 'facts' WHEN 1 THEN 'style' ELSE 'sources' END AS category FROM orders
    UNION ALL SELECT 'r' || o_orderkey, 'extra', 'fail', NULL FROM orders""")
def batch_answers(spark, sf_dir):
    """A line of JSON an answer, a row a check, with the check's definition."""
    o = table(spark, sf_dir, "orders")
    check = lambda name, verdict: F.struct(name.alias("check_id"), verdict.alias("verdict"), F.lit("r").alias("reason"))
    body = F.struct(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("custom_id"), F.array(check(F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")), F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass")), check(F.lit("extra"), F.lit("fail"))).alias("checks"))
    path = scratch(spark)
    o.select(F.to_json(body).alias("value")).write.text(path)
    kinds = spark.createDataFrame([("c0", "facts"), ("c1", "style"), ("c2", "sources")], "check_id string, category string")
    return N.batch_results(spark.read.text(path), "value", kinds).select("custom_id", "check_id", "verdict", "category")


@query("""SELECT 'p' || p_partkey AS custom_id, 'POST' AS method, 'm' AS model, 'be brief' AS system, 'Rate "' || p_name || '"' AS "user" FROM part""")
def batch_requests(spark, sf_dir):
    path = scratch(spark)
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), "p_name")
    O.request_lines(rows, "id", "be brief", F.concat(F.lit('Rate "'), F.col("p_name"), F.lit('"')), "m").select("value").write.text(path)
    r = spark.read.text(path).select(F.from_json("value", "custom_id string, method string, body struct<model: string, messages: array<struct<role: string, content: string>>>").alias("r"))
    return r.select("r.custom_id", "r.method", "r.body.model", F.col("r.body.messages")[0]["content"].alias("system"), F.col("r.body.messages")[1]["content"].alias("user"))


# -- registers --------------------------------------------------------------------------------------------------------------
@query("""SELECT phase, kind, subject, count(*) AS n FROM (SELECT '3' AS phase, 'gap' AS kind, n_name AS subject FROM nation UNION ALL SELECT '3', 'gap', n_name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT '4', 'cluster', r_name FROM region) GROUP BY ALL""")
def register_events(spark, sf_dir):
    """Appending adds, appending once does nothing where the phase has events of that kind."""
    path = scratch(spark)
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    S.append(S.events(nations, phase="3", kind="gap", subject=F.col("n_name")), path)
    S.append(S.events(nations.filter("n_regionkey = 0"), phase="3", kind="gap", subject=F.col("n_name")), path)
    S.append_once(S.events(nations, phase="3", kind="gap", subject=F.col("n_name")), path)
    S.append_once(S.events(regions, phase="4", kind="cluster", subject=F.col("r_name")), path)
    S.append_once(S.events(regions, phase="4", kind="cluster", subject=F.lit("again")), path)
    return S.read_register(spark, path).groupBy("phase", "kind", "subject").agg(F.count("*").alias("n"))


@query("SELECT n_name AS name, CAST(n_regionkey AS STRING) AS region FROM nation UNION ALL SELECT 'more', '7'")
def csv_appended(spark, sf_dir):
    """A row appended to a quoted table of the same columns; the header isn't repeated."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    O.append_csv(rows, path)
    O.append_csv(spark.range(1).select(F.lit("more").alias("name"), F.lit("7").alias("region")), path)
    return I.csv(spark, path, ["name", "region"])


@query("SELECT 'job.py' AS script, 2 AS n_inputs, 42 AS seed, count(*) AS n FROM nation")
def provenance(spark, sf_dir):
    n = table(spark, sf_dir, "nation").count()
    text = O.provenance("job.py", ["a", "b"], 42, rows=n)
    r = spark.range(1).select(F.from_json(F.lit(text), "script string, inputs array<string>, seed int, rows long, git_sha string, created timestamp").alias("r"))
    return r.filter("r.git_sha is not null and r.created is not null").select("r.script", F.size("r.inputs").alias("n_inputs"), "r.seed", F.col("r.rows").alias("n"))


@query("SELECT n_name AS name, n_nationkey::BIGINT AS k, NULL::VARCHAR AS note FROM nation")
def schema_migrated(spark, sf_dir):
    return S.migrated(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey", F.col("n_name").alias("name")), "name string, k long, note string")


@query("""SELECT n_nationkey AS k, n_name AS was, n_name || '!' AS now FROM nation WHERE n_nationkey % 3 = 0""")
def changed_labels(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    now = F.when(F.col("k") % 3 == 0, F.concat("label", F.lit("!"))).when(F.col("k") % 3 == 1, "").otherwise(F.col("label"))
    before = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("label"))
    return S.changed(before, before.withColumn("label", now), "k", "label")


# -- matching -----------------------------------------------------------------------------------------------------------
@query("""SELECT doc_id, label, quality, weight FROM documents JOIN labels USING (doc_id) LEFT JOIN (SELECT unnest([0, 1]) AS quality, unnest(['poor', 'good']) AS label) USING (quality) LEFT JOIN (SELECT unnest(['poor', 'good']) AS label, unnest([0.5, 2.0])::DOUBLE AS weight) USING (label)""")
def lookup_chain(spark, sf_dir):
    """Label to name to weight by left joins; a name that a table lacks would stop the job."""
    names = spark.createDataFrame([(0, "poor"), (1, "good")], "q int, label string")
    weights = spark.createDataFrame([("poor", 0.5), ("good", 2.0)], "l string, weight double")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    out, lost = J.chained(rows, [("quality", names, "q"), ("label", weights, "l")])
    if not lost.isEmpty():
        raise ValueError(f"unmatched: {lost.limit(5).collect()}")
    return out


_MATRIX: Columns = {
    "id": "c_custkey",
    "doi": "CASE c_custkey % 4 WHEN 0 THEN 'https://doi.org/10.1/' || CAST(c_custkey AS STRING) WHEN 1 THEN '' WHEN 2 THEN '10.9/none' ELSE 'DOI:10.1/' || CAST(c_custkey + 1 AS STRING) || '/' END",
    "title": "c_name || CASE WHEN c_custkey % 3 = 0 THEN ' (draft)' ELSE '!' END",
}
_RECORD: Columns = {
    "row_idx": "c_custkey * 2",
    "doi": "'10.1/' || CAST(c_custkey - c_custkey % 3 AS STRING)",
    "title": "c_name",
    "abstract": "CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 5 = 1 THEN NULL ELSE 'about ' || c_name END",
    "rank": "CASE WHEN c_custkey % 2 = 0 THEN 'A' WHEN c_custkey % 7 = 0 THEN '' ELSE 'Not found' END",
}


@query(rf"""WITH r AS (SELECT *, lower(doi) AS kd, trim(regexp_replace(regexp_replace(lower(title), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS kt,
        (trim(coalesce(abstract, '')) <> '')::INT AS has_abstract, (coalesce(trim(rank), '') NOT IN ('', 'Not found', 'nan'))::INT AS has_rank FROM {sql_of('customer', _RECORD)}),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kd ORDER BY has_abstract DESC, has_rank DESC, row_idx) AS k FROM r) WHERE k = 1),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kt ORDER BY has_abstract DESC, has_rank DESC, row_idx) AS k FROM r) WHERE k = 1),
    m AS (SELECT id, regexp_replace(regexp_replace(lower(trim(doi)), '^(https?://(dx\.)?doi\.org/|doi:)', ''), '/+$', '') AS kd, trim(regexp_replace(regexp_replace(lower(title), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS kt FROM {sql_of('customer', _MATRIX)})
    SELECT id, CASE WHEN d.kd IS NOT NULL THEN 'doi' WHEN t.kt IS NOT NULL THEN 'title' ELSE 'unmatched' END AS match_method,
           coalesce(nullif(trim(CASE WHEN d.kd IS NOT NULL THEN d.abstract ELSE t.abstract END), ''), 'Not available') AS abstract, coalesce(nullif(trim(CASE WHEN d.kd IS NOT NULL THEN d.rank ELSE t.rank END), ''), 'Not found') AS rank
    FROM m LEFT JOIN d ON m.kd <> '' AND m.kd = d.kd LEFT JOIN t ON m.kt <> '' AND m.kt = t.kt""")
def doi_then_title(spark, sf_dir):
    """The record with the same DOI, else the same title; of several the one with an abstract, then with a rank."""
    out = J.enriched_by_key(made(spark, sf_dir, "customer", _MATRIX), made(spark, sf_dir, "customer", _RECORD), ["abstract", "rank"], "id", {"abstract": "Not available", "rank": "Not found"})
    return out.select("id", "match_method", "abstract", "rank")


_FILES = "SELECT p_partkey AS file_id, p_name || ' - ' || p_brand || '.' || CAST(p_size AS STRING) || '.pdf' AS file FROM part"
_SUFFIX = "SELECT s_suppkey, split_part('10.1000/x.' || CAST(s_suppkey AS STRING) || '/' || CASE WHEN s_suppkey % 2 = 0 THEN 'Brand#' || CAST(s_suppkey % 9 AS STRING) || '.' ELSE CAST(s_suppkey AS STRING) || '.pdf' END, '/', 3) AS part_of_doi FROM supplier"


@query(f"SELECT file_id, s_suppkey FROM ({_FILES}) f JOIN ({_SUFFIX}) s ON part_of_doi <> '' AND contains(file, part_of_doi)")
def file_names(spark, sf_dir):
    """Files whose names have the last part of a DOI anywhere in them, in this case of letters."""
    files = made(spark, sf_dir, "part", {"file_id": "p_partkey", "file": "p_name || ' - ' || p_brand || '.' || CAST(p_size AS STRING) || '.pdf'"})
    doi = "'10.1000/x.' || CAST(s_suppkey AS STRING) || '/' || CASE WHEN s_suppkey % 2 = 0 THEN 'Brand#' || CAST(s_suppkey % 9 AS STRING) || '.' ELSE CAST(s_suppkey AS STRING) || '.pdf' END"
    keys = made(spark, sf_dir, "supplier", {"s_suppkey": "s_suppkey", "doi": doi}).select("s_suppkey", F.element_at(F.split("doi", "/"), -1).alias("part_of_doi"))
    return J.contained_keys(files, "file", keys, "part_of_doi").select("file_id", "s_suppkey")


_ENTRY: Columns = {
    "id": "'e' || CAST(s_suppkey AS STRING)", "doi": "CASE WHEN s_suppkey % 5 = 0 THEN '10.1/' || CAST(s_suppkey AS STRING) ELSE '' END", "arxiv": "CASE WHEN s_suppkey % 5 = 1 THEN '2401.' || CAST(10000 + s_suppkey AS STRING) ELSE '' END",
    "year": "CAST(2000 + s_nationkey AS STRING)", "surname": "'smith' || CAST(s_suppkey % 9 AS STRING)", "title": "'A Study of: ' || s_name || CASE s_suppkey % 5 WHEN 2 THEN ' xyz' WHEN 3 THEN ' vwxyz vwxyz vwxyz vwxyz' ELSE '' END",
}
_KNOWN = {**_ENTRY, "id": "'k' || CAST(s_suppkey AS STRING)", "row_idx": "s_suppkey", "doi": "CASE WHEN s_suppkey % 10 = 0 THEN '10.1/' || CAST(s_suppkey AS STRING) ELSE '' END", "arxiv": "''", "title": "CASE WHEN s_suppkey % 5 IN (2, 3) THEN 'a study of ' || s_name ELSE 'Quite another text' END"}


@query(f"""SELECT e.id, CASE WHEN d.id IS NOT NULL THEN d.id WHEN s_suppkey % 5 = 2 THEN 'k' || s_suppkey END AS "match", CASE WHEN d.id IS NOT NULL THEN 'doi' WHEN s_suppkey % 5 = 2 THEN 'title' ELSE 'none' END AS method
    FROM supplier JOIN {sql_of('supplier', _ENTRY)} e ON e.id = 'e' || s_suppkey LEFT JOIN {sql_of('supplier', _KNOWN)} d ON e.doi <> '' AND e.doi = d.doi""")
def bibliography_match(spark, sf_dir):
    """By DOI, else by preprint number, else by year, surname and an alike title: one with a word more is, one with four words more isn't alike enough."""
    # Names of few suppliers are alike too, so each has a surname of its own.
    own = lambda columns: {**columns, "surname": "'smith' || CAST(s_suppkey AS STRING)"}
    return J.bibliography_matches(made(spark, sf_dir, "supplier", own(_ENTRY)), made(spark, sf_dir, "supplier", own(_KNOWN))).select("id", "match", "method")


@query("""SELECT 'e' || s_suppkey AS entry, 'k' || s_suppkey AS known, round(2 * n / (2 * n + CASE s_suppkey % 5 WHEN 2 THEN 4 ELSE 24 END), 9) AS ratio FROM (SELECT s_suppkey, length('a study of ' || replace(s_name, '#', '')) AS n FROM supplier) WHERE s_suppkey % 5 IN (2, 3)""")
def alike_titles(spark, sf_dir):
    """Ratios between 0 and 1 of titles of one year and surname: the shorter one begins the longer one."""
    own = lambda columns: {**columns, "surname": "'smith' || CAST(s_suppkey AS STRING)"}
    out = J.alike_titles(made(spark, sf_dir, "supplier", own(_ENTRY)), made(spark, sf_dir, "supplier", own(_KNOWN)), 0.7)
    return out.select("entry", "known", F.round("ratio", 9).alias("ratio"))


_AT_VENUE: Columns = {
    "row_idx": "c_custkey", "issn": "CASE c_custkey % 5 WHEN 0 THEN '0000-0000 ' || CAST(1000 + c_nationkey AS STRING) || '-000x' WHEN 1 THEN 'N/A' ELSE '' END",
    "source": "CASE c_custkey % 5 WHEN 0 THEN 'anything' WHEN 1 THEN 'Proceedings of the  Conference on Topic ' || CAST(c_nationkey AS STRING) WHEN 2 THEN 'Talks at NAT' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', c_nationkey + 1, 1) || ' 2020' WHEN 3 THEN 'JOURNAL of nation_' || CAST(c_nationkey AS STRING) ELSE 'nowhere' END",
}


@query("""WITH p AS (SELECT c_custkey AS row_idx, c_custkey % 5 AS k, c_nationkey AS n FROM customer)
    SELECT row_idx, CASE WHEN k IN (0, 3) AND n % 4 > 0 THEN 'A' WHEN k IN (1, 2) AND n % 3 > 0 THEN 'B' ELSE 'Not found' END AS venue_rank, CASE WHEN k IN (0, 3) AND n % 4 > 0 THEN 'Journal' WHEN k IN (1, 2) AND n % 3 > 0 THEN 'Conference' ELSE 'Not found' END AS venue_type,
        CASE WHEN k = 0 AND n % 4 > 0 THEN 'issn' WHEN (k = 1 AND n % 3 > 0) OR (k = 3 AND n % 4 > 0) THEN 'name' WHEN k = 2 AND n % 3 > 0 THEN 'acronym' ELSE 'none' END AS method FROM p""")
def venue_ranks(spark, sf_dir):
    """Ranks by any ISSN, by the venue's name, by an acronym in it; venues without a rank don't count."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    journals = n.select(key.alias("row_idx"), F.concat((key + 1000).cast("string"), F.lit("000X")).alias("issn"), F.concat(F.lit("Journal of "), "n_name").alias("name"), F.lit("").alias("acronym"), F.when(key % 4 > 0, "A").otherwise("").alias("rank"))
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), key + 1, F.lit(1))
    conferences = n.select(key.alias("row_idx"), F.concat(F.lit("Conference on Topic "), key.cast("string")).alias("name"), F.concat(F.lit("NAT"), letter).alias("acronym"), F.when(key % 3 > 0, "B").otherwise("nan").alias("rank"))
    return J.venue_ranks(made(spark, sf_dir, "customer", _AT_VENUE), journals, conferences).select("row_idx", "venue_rank", "venue_type", "method")


@query("""WITH b AS (SELECT p_partkey, 'roe' || (1990 + p_size % 3) || split_part(p_name, ' ', 1) AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM b)
    SELECT p_partkey, base || CASE WHEN n = 1 THEN '' WHEN n <= 27 THEN substr('abcdefghijklmnopqrstuvwxyz', n::INT - 1, 1) ELSE '_' || n END AS citekey FROM n""")
def unique_citekeys(spark, sf_dir):
    """Keys of surname, year and first word: far more than 27 rows of each base, and none twice."""
    p = table(spark, sf_dir, "part")
    return O.citekeys(p, F.lit("Roe"), (F.col("p_size") % 3 + 1990).cast("string"), F.col("p_name"), [F.col("p_partkey")]).select("p_partkey", "citekey")


@query(r"""WITH g AS (SELECT item_id, w[k] || ' ' || w[k + 1] AS ngram, w[k] AS word, lines FROM (SELECT item_id, string_split(lower(text), chr(10)) AS lines, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS w, unnest(range(1, len(w))) AS k FROM benchmark))
    SELECT DISTINCT item_id AS target_id, ngram, list_position(list_transform(lines, lambda x: contains(x, word)), true)::INT AS line FROM g WHERE ngram IN (SELECT ngram FROM g WHERE item_id % 2 = 0) AND item_id % 2 = 1""")
def overlap_lines(spark, sf_dir):
    """Where the n-grams that odd items share with even ones stand in their texts."""
    b = table(spark, sf_dir, "benchmark")
    odd = b.filter("item_id % 2 = 1")
    found = V.shared_ngrams(odd, "item_id", "text", b.filter("item_id % 2 = 0"), "item_id", "text", 2)
    return V.overlap_lines(found, odd, "item_id", "text").select("target_id", "ngram", "line")


@query("""SELECT s_suppkey AS ref_id, CASE WHEN s_suppkey % 3 < 2 THEN '10.1/b' || s_suppkey END AS doi, round(CASE s_suppkey % 3 WHEN 0 THEN 1.03 WHEN 1 THEN 4 / sqrt(20.0) + 0.0 ELSE 2 / sqrt(12.0) + 0.03 END, 3) AS score FROM supplier""")
def best_candidates(spark, sf_dir):
    """Of three candidates the one with the most alike title; an equal year adds a little, too little a likeness gives none."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref_id"), (F.col("s_suppkey") % 3).alias("k"))
    refs = s.select("ref_id", F.lit("one two three four").alias("title"), F.lit("2020").alias("year"))
    best = F.when(F.col("k") == 0, "four three two one").when(F.col("k") == 1, "one two three four five").otherwise("one two nine")
    rows = F.array(
        F.struct(F.lit(0).alias("at"), F.lit("eight nine").alias("title"), F.lit("2020").alias("year"), F.lit("10.1/a").alias("doi")),
        F.struct(F.lit(1).alias("at"), best.alias("title"), F.when(F.col("k") == 1, "1999").otherwise("2020").alias("year"), F.concat(F.lit("https://doi.org/10.1/b"), F.col("ref_id").cast("string")).alias("doi")),
        F.struct(F.lit(2).alias("at"), F.lit("seven").alias("title"), F.lit("").alias("year"), F.lit("10.1/c").alias("doi")),
    )
    return V.best_candidates(refs, s.select("ref_id", F.inline(rows)))


_CITED = """CASE s_suppkey % 5 WHEN 0 THEN '[' || s_suppkey || '] J. Roe, A. Doe, "A Study of ' || s_name || '," in Proc. of X, 2019. doi:10.1/' || s_suppkey WHEN 1 THEN s_suppkey || '. Roe, J., Doe, A.: Ways of ' || s_name || '. In: Proceedings of X, pp. 1-2 (2020)'
    WHEN 2 THEN 'Roe, J. (2018). Notes on ' || s_name || '. Journal of X, 3.' WHEN 3 THEN '2021, The page of ' || s_name || '. https://x.org/' || s_suppkey ELSE 'Roe J without a year or marks, ' || s_name END"""


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'J. Roe, A. Doe' WHEN 1 THEN 'Roe, J., Doe, A.' WHEN 2 THEN 'Roe, J' WHEN 3 THEN '' ELSE 'Roe J without a year or marks, ' || s_name END AS authors,
    CASE s_suppkey % 5 WHEN 0 THEN 'A Study of ' || s_name WHEN 1 THEN 'Ways of ' || s_name WHEN 2 THEN 'Notes on ' || s_name WHEN 3 THEN 'The page of ' || s_name ELSE '' END AS title,
    CASE s_suppkey % 5 WHEN 0 THEN '2019' WHEN 1 THEN '2020' WHEN 2 THEN '2018' WHEN 3 THEN '2021' ELSE '' END AS year, CASE WHEN s_suppkey % 5 = 0 THEN '10.1/' || s_suppkey ELSE '' END AS doi FROM supplier""".replace("'10.1/'", "'10.1000/'"))
def citation_layouts(spark, sf_dir):
    """References as they are laid out: a title in quotes, a colon after the authors, a year in the middle, a page without authors, and none of these."""
    raw = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_CITED.replace("doi:10.1/", "doi:10.1000/")).alias("raw"))
    return C.with_citation(raw, "raw", "c").select("s_suppkey", "c.*")


@query("""SELECT c_custkey, o_orderkey, coalesce(CAST(o_totalprice AS STRING), '-') <> '-' AS has_order FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1) ON c_custkey = o_custkey""")
def first_order(spark, sf_dir):
    """A left join with the first row of each key of the other side, and a default where there is none."""
    first = J.one_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")
    out = table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", "o_orderkey", (F.coalesce(F.col("o_totalprice").cast("string"), F.lit("-")) != "-").alias("has_order"))


@query("""SELECT CAST(n_nationkey AS STRING) AS key, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 > 0 THEN 'old' ELSE n_name END AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'done' ELSE 'pending' END AS status FROM nation""")
def new_keys(spark, sf_dir):
    """Default rows for keys that the state lacks; blanks of the state are filled."""
    n = table(spark, sf_dir, "nation")
    state = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("key"), F.when(F.col("n_nationkey") % 3 > 0, "old").otherwise("").alias("title"), F.lit("done").alias("status"))
    wanted = n.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("title"))
    return J.with_new_keys(state, wanted, "key", {"status": "pending"})


@query("""SELECT n_nationkey AS k, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey""")
def every_key_known(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    return J.all_matched(rows, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("region")), "r", "region").select("k", "region")


@query("""SELECT n_nationkey AS k, coalesce(c.n, 0) AS customers, coalesce(s.names, '') AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_suppkey) AS names FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def assembled(spark, sf_dir):
    """One row a key with the rows of several tables as sorted arrays."""
    t = lambda name: table(spark, sf_dir, name)
    parts = {"c": t("customer").select(F.col("c_nationkey").alias("k"), "c_custkey"), "s": t("supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_name")}
    out = J.assembled(t("nation").select(F.col("n_nationkey").alias("k")), "k", parts)
    return out.select("k", F.coalesce(F.size("c"), F.lit(0)).cast("long").alias("customers"), F.coalesce(F.array_join(F.col("s")["s_name"], ","), F.lit("")).alias("suppliers"))


# -- counts and order -----------------------------------------------------------------------------------------------------
@query("""SELECT count(DISTINCT o_custkey) AS unique_entities FROM orders WHERE o_orderstatus IS NOT NULL""")
def entity_footer(spark, sf_dir):
    return A.footer(table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey")


_CHECKS = "(SELECT o_custkey AS entity, 'c' || (o_orderkey % 4) AS check_id, CASE WHEN o_orderkey % 4 < 2 THEN 'facts' ELSE 'style' END AS category, CASE WHEN o_orderkey % 3 = 0 THEN 'q1|q2' ELSE 'q2' END AS rqs, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'unsure' END AS verdict FROM orders)"


@query(f"""SELECT 'by_verdict' AS part, verdict AS value, count(*) AS n FROM {_CHECKS} GROUP BY 2 UNION ALL SELECT 'by_category', category, count(*) FROM {_CHECKS} WHERE verdict = 'fail' GROUP BY 2
    UNION ALL SELECT 'by_question', q, count(*) FROM (SELECT unnest(string_split(rqs, '|')) AS q FROM {_CHECKS} WHERE verdict = 'fail') GROUP BY 2
    UNION ALL SELECT 'by_check', check_id, count(*) FROM {_CHECKS} WHERE verdict = 'fail' GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'worst', CAST(entity AS STRING), count(*) AS n FROM {_CHECKS} WHERE verdict = 'fail' GROUP BY 2, entity ORDER BY n DESC, entity LIMIT 20)""")
def check_verdicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    checks = o.select(F.col("o_custkey").alias("entity"), F.concat(F.lit("c"), k.cast("string")).alias("check_id"), F.when(k < 2, "facts").otherwise("style").alias("category"), F.when(F.col("o_orderkey") % 3 == 0, "q1|q2").otherwise("q2").alias("rqs"), F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass").otherwise("unsure").alias("verdict"))
    parts = [df.select(F.lit(name).alias("part"), F.col(df.columns[0]).cast("string").alias("value"), "n") for name, df in A.verdicts(checks, "entity").items()]
    return P.united(parts)


@query("""SELECT lookup, source, count(*) AS n, count(*) FILTER (lookup = 'matched' AND n_chars % 2 = 0) AS deltas FROM (SELECT *, CASE WHEN l.doc_id IS NULL THEN 'no_match' ELSE 'matched' END AS lookup FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY ALL""")
def lookup_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("k"), "source", "n_chars")
    rows = J.lookup_with_status(docs, "k", table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("lk"), "toxic"), "lk", ["toxic"])
    return A.lookup_coverage(rows, "source", F.col("n_chars") % 2 == 0)


@query("""SELECT DISTINCT '10.1/' || c_mktsegment || c_nationkey % 3 AS doi FROM (SELECT lower(c_mktsegment) AS c_mktsegment, c_nationkey, c_acctbal FROM customer) WHERE c_acctbal > 0""")
def lookup_dois(spark, sf_dir):
    """The distinct DOIs to be looked up, in lower case; blanks aren't."""
    raw = F.when(F.col("c_acctbal") > 0, F.concat(F.lit(" 10.1/"), "c_mktsegment", (F.col("c_nationkey") % 3).cast("string"))).otherwise(" ")
    return P.lookup_keys(table(spark, sf_dir, "customer").select(raw.alias("doi")))


@query("""SELECT doc, title, year FROM (SELECT *, row_number() OVER (PARTITION BY doc, lower(left(trim(title), 80)), year ORDER BY chunk, place) AS k
    FROM (SELECT c_nationkey AS doc, c_custkey % 3 AS chunk, c_custkey AS place, upper(left(c_mktsegment, 1 + CAST(c_custkey % 4 AS INT))) || repeat('x', 90) || c_custkey AS title, CAST(2000 + c_custkey % 2 AS STRING) AS year FROM customer)) WHERE k = 1""")
def chunk_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    title = F.concat(F.upper(F.substring("c_mktsegment", F.lit(1), (1 + F.col("c_custkey") % 4).cast("int"))), F.repeat(F.lit("x"), 90), F.col("c_custkey").cast("string"))
    found = c.select(F.col("c_nationkey").alias("doc"), (F.col("c_custkey") % 3).alias("chunk"), F.col("c_custkey").alias("at"), title.alias("title"), (F.col("c_custkey") % 2 + 2000).cast("string").alias("year"))
    return R.chunk_references(found).select("doc", "title", "year")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS before FROM orders) WHERE o_totalprice < before""")
def falling_values(spark, sf_dir):
    return W.order_violations(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice").select("o_orderkey")


_STRATEGIES = """SELECT 'doi' AS strategy, id, row_number() OVER (ORDER BY doi NULLS LAST, row_idx) AS place FROM r UNION ALL SELECT 'recent', id, row_number() OVER (ORDER BY year DESC NULLS LAST, row_idx) FROM r
    UNION ALL SELECT 'rank', id, row_number() OVER (ORDER BY CASE rank WHEN 'A*' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END, row_idx) FROM r UNION ALL SELECT 'random', id, row_number() OVER (ORDER BY md5('42:' || row_idx), row_idx) FROM r"""
_ORDERED: Columns = {"id": "c_custkey", "row_idx": "c_custkey * 7 % 1000003", "doi": "CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END", "year": "CASE WHEN c_custkey % 6 > 0 THEN 2000 + c_nationkey END", "rank": "CASE c_custkey % 4 WHEN 0 THEN 'A*' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'A' END"}


@query(f"WITH r AS {sql_of('customer', _ORDERED)} {_STRATEGIES}")
def order_strategies(spark, sf_dir):
    """The place of each row in each of the four orders of work."""
    rows = made(spark, sf_dir, "customer", _ORDERED)
    return P.united([W.ranked(rows, W.order_keys(s, "row_idx"), "place").select(F.lit(s).alias("strategy"), "id", "place") for s in W.ORDERS])


@query("""SELECT label, n, row_number() OVER (ORDER BY n DESC, label)::BIGINT AS place FROM (SELECT p_name AS label, count(*) AS n FROM part GROUP BY 1)""")
def by_size(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("label")).agg(F.count("*").alias("n"))
    return W.ranked(counts, [F.desc("n"), F.col("label")], "place")


@query("""SELECT n_name AS name, n_regionkey AS region, NULL AS segment FROM nation UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer""")
def united_sources(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return P.united([n, table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))])


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' WHEN 2 THEN 'manual_review' END AS page_status FROM documents WHERE doc_id % 4 <> 0""")
def kept_unknown(spark, sf_dir):
    k = F.col("doc_id") % 4
    return P.screenable(table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "fail").when(k == 1, "pass").when(k == 2, "manual_review").alias("page_status")))


# -- keys and names -------------------------------------------------------------------------------------------------------
_RAW: Columns = {
    "id": "c_custkey",
    "issn": "' 12' || CAST(c_nationkey AS STRING) || '-34 5x'",
    "acronym": "CASE c_custkey % 4 WHEN 0 THEN 'icse' WHEN 1 THEN ' nan ' WHEN 2 THEN '' ELSE 'Tse' END",
    "name": "CASE WHEN c_custkey % 8 = 2 THEN ' ' ELSE 'International Conference on ' || c_name END",
    "title": "'{A {Large}-Scale}   Study of ' || c_name",
    "authors": "'Smith, ' || c_mktsegment || ' and van Roe, B and Lee ' || CAST(c_nationkey AS STRING)",
    "single": "CASE WHEN c_custkey % 2 = 0 THEN 'Doe, Jane and Roe, B' ELSE 'Jane Q Public and Roe, B' END",
    "keywords": "c_mktsegment || ', ' || ',testing , ' || CAST(c_nationkey AS STRING)",
    "url": "CASE c_custkey % 3 WHEN 0 THEN '(https://doi-org.proxy.edu/10.1145/Ab' || CAST(c_custkey AS STRING) || '.99.), x=1' WHEN 1 THEN 'see arXiv:2401.' || CAST(10000 + c_custkey AS STRING) ELSE 'none' END",
    "kind": "CASE c_custkey % 5 WHEN 0 THEN 'inproceedings' WHEN 1 THEN 'article' WHEN 2 THEN 'phdthesis' WHEN 3 THEN 'inbook' ELSE 'online' END",
    "venue": "CASE c_custkey % 7 WHEN 0 THEN 'Journal of Book Proceedings' WHEN 1 THEN 'Workshop' WHEN 2 THEN 'Bookish' WHEN 3 THEN 'arXiv' WHEN 4 THEN 'PhD Thesis' WHEN 5 THEN '' ELSE 'Conference' END",
    "seed": "CASE c_custkey % 6 WHEN 0 THEN 'Wang et al. - 2025 - LLM-based Agents in Software.pdf' WHEN 1 THEN 'Li et al. - 2024 - A survey of low-code tools.pdf' WHEN 2 THEN 'Roe - 2023 - Agents for software.pdf' WHEN 3 THEN 'Kim - 2022 - Other.pdf' WHEN 4 THEN 'some file-name of ' || c_name || ' and more words.pdf' ELSE 'Doe et al. - 2021 - Agentic programming.pdf' END",
}


@query(rf"""SELECT id, replace(replace(lower(trim(issn)), '-', ''), ' ', '') AS issn, upper(trim(acronym)) AS acronym,
        CASE WHEN lower(trim(acronym)) NOT IN ('', 'nan', 'none', 'n/a') THEN trim(acronym) WHEN trim(name) <> '' THEN left(trim(name), 30) ELSE '(no acronym)' END AS shown,
        trim(regexp_replace(replace(replace(title, '{{', ''), '}}', ''), '\s+', ' ', 'g')) AS title, regexp_replace(authors, ' and ', '; ', 'g') AS authors, CASE WHEN id % 2 = 0 THEN 'doe' ELSE 'public' END AS surname,
        replace(split_part(keywords, ',', 1) || '; testing; ' || trim(split_part(keywords, ',', 4)), ',', '') AS keywords,
        CASE WHEN id % 3 = 0 THEN '10.1145/Ab' || id || '.99' END AS doi, CASE WHEN id % 3 = 1 THEN '2401.' || (10000 + id) ELSE '' END AS arxiv,
        CASE kind WHEN 'inproceedings' THEN 'p/Conference Paper' WHEN 'article' THEN 'j/Article' WHEN 'phdthesis' THEN 'j/Thesis' WHEN 'inbook' THEN 'p/Book Chapter' ELSE 'p/Other' END AS entry,
        CASE id % 7 WHEN 0 THEN '@article/journal' WHEN 1 THEN '@inproceedings/booktitle' WHEN 2 THEN '@inbook/booktitle' WHEN 3 THEN '@misc/howpublished' WHEN 4 THEN '@phdthesis/school' WHEN 5 THEN '@misc/howpublished' ELSE '@inproceedings/booktitle' END AS venue,
        CASE id % 6 WHEN 0 THEN 'WangLLMAgents2025' WHEN 1 THEN 'LiLCNC2024' WHEN 2 THEN 'RoeAgentsSE2023' WHEN 3 THEN 'Kim2022' WHEN 4 THEN left(regexp_replace(replace(seed, '.pdf', ''), '[^A-Za-z0-9]+', '', 'g'), 30) ELSE 'DoeAgenticProg2021' END AS seed,
        'doi_10.1_' || id || '.pdf' AS file FROM {sql_of('customer', _RAW)}""")
def names_and_kinds(spark, sf_dir):
    r = made(spark, sf_dir, "customer", _RAW)
    entry, venue = K.entry_kind(F.col("kind")), K.venue_entry(F.col("venue"))
    return r.select(
        "id", K.issn_key(F.col("issn")).alias("issn"), K.acronym_key(F.col("acronym")).alias("acronym"), K.acronym_shown(F.col("acronym"), F.col("name")).alias("shown"), K.unbraced(F.col("title")).alias("title"),
        K.authors_from_bibtex(F.col("authors")).alias("authors"), K.surname_of_bibtex(F.col("single")).alias("surname"), K.keywords_to_semicolons(F.col("keywords")).alias("keywords"),
        K.doi_in_url(F.col("url")).alias("doi"), K.arxiv_id(F.col("url")).alias("arxiv"), F.concat_ws("/", entry["source_type"], entry["doctype"]).alias("entry"), F.concat_ws("/", venue["entry"], venue["field"]).alias("venue"),
        K.seed_id(F.col("seed")).alias("seed"), K.file_safe(F.concat(F.lit("doi:10.1/"), F.col("id").cast("string")), ".pdf").alias("file"),
    )


_PEOPLE: Columns = {
    "id": "s_suppkey",
    "ours": "CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Roe, A; Doe, B' WHEN 2 THEN 'O''Neil, P; Smith-Jones, A' WHEN 3 THEN '' ELSE 'Müller, J; Roe, A' END",
    "theirs": "CASE s_suppkey % 5 WHEN 0 THEN ' ; ' WHEN 1 THEN 'B Doe; A Roe' WHEN 2 THEN 'Neil, P O; Jones, A Smith' WHEN 3 THEN 'Roe, A' ELSE '' END",
    "given": "CASE WHEN s_suppkey % 3 = 0 THEN 'J.' END",
    "family": "CASE WHEN s_suppkey % 3 < 2 THEN s_name END",
    "whole": "CASE WHEN s_suppkey % 2 = 0 THEN 'The ' || s_name ELSE ' ' END",
}


@query(f"""SELECT id, CASE id % 5 WHEN 0 THEN 'still_blank' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'updated' WHEN 3 THEN 'blank_filled' ELSE 'no_change' END AS delta,
        CASE id % 5 WHEN 1 THEN 'a roe' WHEN 2 THEN 'oneil p' WHEN 4 THEN 'j muller' ELSE '' END AS first_key, CASE WHEN id % 5 IN (0, 3) THEN '' WHEN id % 5 = 1 THEN 'Roe, A and Doe, B' WHEN id % 5 = 2 THEN 'O''Neil, P and Smith-Jones, A' ELSE 'Müller, J and Roe, A' END AS bibtex,
        CASE WHEN family IS NOT NULL THEN concat_ws(', ', family, given) WHEN given IS NOT NULL THEN given WHEN trim(whole) <> '' THEN whole ELSE 'D ' || id END AS person FROM {sql_of('supplier', _PEOPLE)}""")
def people(spark, sf_dir):
    """Author lists: which of five ways they differ, keys, formats, names from services' objects."""
    r = made(spark, sf_dir, "supplier", _PEOPLE)
    return r.select(
        "id", K.author_delta(F.col("ours"), F.col("theirs")).alias("delta"), K.name_set_key(F.split_part("ours", F.lit(";"), F.lit(1))).alias("first_key"), K.authors_to_bibtex(F.col("ours")).alias("bibtex"),
        K.person_name(F.col("given"), F.col("family"), F.col("whole"), F.concat(F.lit("D "), F.col("id").cast("string"))).alias("person"),
    )


@query("""SELECT p_brand AS brand, sha1(string_agg(DISTINCT p_name, chr(10) ORDER BY p_name)) AS digest, 'https://a/' || min(p_partkey) || ' https://b/' || p_brand AS urls FROM part GROUP BY 1""")
def digests_and_urls(spark, sf_dir):
    a = F.concat(F.lit("https://a/"), F.min("p_partkey").cast("string"))
    out = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.collect_set("p_name").alias("names"), a.alias("a"))
    return out.select("brand", K.list_digest(F.col("names")).alias("digest"), F.array_join(K.candidate_urls(F.col("a"), F.lit(" "), F.concat(F.lit("https://b/"), "brand"), F.col("a")), " ").alias("urls"))


# -- text -----------------------------------------------------------------------------------------------------------------
_CELLS: Columns = {
    "id": "p_partkey",
    "pages": "CASE p_size % 4 WHEN 0 THEN ' 45–' || CAST(p_size AS STRING) WHEN 1 THEN '7--9 ' WHEN 2 THEN '' END",
    "article": "CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS STRING) END",
    "date": "CASE WHEN p_size % 5 = 0 THEN 'n.d.' ELSE CAST(1990 + p_size AS STRING) || '-05-01' END",
    "flag": "CASE p_size % 6 WHEN 0 THEN ' TRUE' WHEN 1 THEN 'yes' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN NULL ELSE 'Y ' END",
    "mismatch": "CASE WHEN p_size % 7 = 0 THEN 'x' ELSE ' ' END",
    "answer": "'Sure: {\"label\": \"' || p_brand || '\", \"n\": ' || CAST(p_size AS STRING) || '} ok'",
    "env": "'NAME = \"' || p_name || '\" '",
    "why": "p_brand || ' x ' || p_type || ': ' || CAST(p_size AS STRING) || ' of the 2.50 that are usual; named by 3 sources.'",
    "joined": "'Smith, J.A study.In ' || p_brand || ',Vol   2'",
    "pipe": "p_name || '|' || p_brand",
}


@query(rf"""SELECT id, CASE WHEN p IN (0, 1) THEN trim(replace(replace(pages, '–', '-'), '--', '-')) WHEN article IS NOT NULL THEN 'art' || article || ':12pp' END AS pages, CASE WHEN date = 'n.d.' THEN NULL ELSE left(date, 4)::INT END AS year,
        coalesce(lower(trim(flag)), '') IN ('true', '1', 'yes', 'y') AS truthy, CASE WHEN coalesce(lower(trim(flag)), '') IN ('true', '1') OR trim(mismatch) <> '' THEN 'preprint' ELSE 'published' END AS kind,
        json_extract_string(regexp_extract(answer, '(\{{.*\}})', 1), '$.label') AS label, trim(split_part(env, '"', 2)) AS env, regexp_extract(why, '^(.+) x (.+): (\d+) of the', 2) AS gap_column, regexp_extract(why, ': (\d+) of', 1)::INT AS gap_n,
        regexp_replace(regexp_replace(regexp_replace(joined, '\.([A-Z])', '. \1', 'g'), ',([A-Z])', ', \1', 'g'), '\s{{2,}}', ' ', 'g') AS spaced, replace(pipe, '|', '\|') AS escaped
    FROM (SELECT c.*, p_size % 4 AS p FROM {sql_of('part', _CELLS)} c JOIN part ON id = p_partkey)""")
def cells_and_marks(spark, sf_dir):
    r = made(spark, sf_dir, "part", _CELLS)
    gap = G.parsed_rationale(F.col("why"))
    return r.select(
        "id", T.page_string(F.col("pages"), F.col("article"), F.lit("12")).alias("pages"), T.year_of_date(F.col("date")).alias("year"), T.truthy(F.col("flag")).alias("truthy"), T.preprint_default(F.col("flag"), F.col("mismatch")).alias("kind"),
        T.json_object_in(F.col("answer"), "label string, n int").getField("label").alias("label"), T.env_value(F.col("env")).alias("env"), gap["column"].alias("gap_column"), gap["n"].alias("gap_n"),
        T.spaced(F.col("joined")).alias("spaced"), T.escaped_for_table(F.col("pipe")).alias("escaped"),
    )


@query(r"""WITH b AS (SELECT item_id, text, regexp_extract_all(lower(text), '([a-z0-9]+)', 1)[9] AS word, string_split(lower(text || chr(10) || text), chr(10)) AS lines FROM benchmark)
    SELECT item_id, CASE WHEN word IS NOT NULL THEN list_position(list_transform(lines, lambda x: contains(x, word)), true) END::INT AS line FROM b""")
def line_of_word(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    word = F.try_element_at(T.tokens(F.col("text")), F.lit(9))
    return b.select("item_id", T.first_line_with(F.concat("text", F.lit("\n"), "text"), word).alias("line"))


@query(r"""SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 3 THEN NULL ELSE 'see [' || CASE WHEN turn % 2 = 0 THEN 'new' || (conv_id % 5) ELSE 'k' || (conv_id % 5 + 5) END || '; other] and [Fig 1]' END AS text, (turn % 2 = 0 AND (conv_id + turn) % 7 <> 3)::BIGINT AS replaced FROM conversations""")
def citekeys_rewritten(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    key = F.when(F.col("turn") % 2 == 0, F.col("conv_id") % 5).otherwise(F.col("conv_id") % 5 + 5).cast("string")
    texts = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.when((F.col("conv_id") + F.col("turn")) % 7 != 3, F.concat(F.lit("see [k"), key, F.lit("; other] and [Fig 1]"))).alias("text"))
    mapping = spark.createDataFrame([(f"k{k}", f"new{k}") for k in range(5)], "old string, new string")
    out = R.rewritten_citekeys(texts, "id", "text", mapping)
    return out.select(F.split_part("id", F.lit("/"), F.lit(1)).cast("long").alias("conv_id"), F.split_part("id", F.lit("/"), F.lit(2)).cast("long").alias("turn"), "text", "replaced")


_REF_LINES = "'Smith, J. 20' || lpad(CAST(item_id % 25 AS STRING), 2, '0') || '. Title of number ' || CAST(item_id AS STRING)"


@query(f"""SELECT item_id % 4 AS doc, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id)::INT AS ref, {_REF_LINES} || ' goes on' AS raw FROM benchmark""")
def author_references(spark, sf_dir):
    """A line that begins with surname and initials begins a reference; the next ones belong to it."""
    b = made(spark, sf_dir, "benchmark", {"doc": "item_id % 4", "item_id": "item_id", "l": _REF_LINES})
    lines = b.select("doc", F.explode(F.array(F.struct((F.col("item_id") * 3).alias("at"), F.col("l").alias("line")), F.struct((F.col("item_id") * 3 + 1).alias("at"), F.lit(" goes on ").alias("line")), F.struct((F.col("item_id") * 3 + 2).alias("at"), F.lit("17").alias("line")))).alias("x"))
    return R.author_references(lines.select("doc", "x.at", "x.line"))


#: The number at each line: rising by 1 to 6, sometimes back by some, and 1 again after 60 lines.
_NUMBER = "(CASE WHEN k % 60 = 0 THEN 1 ELSE (k % 60) * 3 + (k * k) % 7 - 3 * (k % 11 = 5)::INT * 9 + doc % 3 END)"


@query(rf"""WITH l AS (SELECT doc_id AS doc, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k, unnest(string_split(text, chr(10))) AS line FROM documents),
    n AS (SELECT doc, k, greatest(1, {_NUMBER})::INT AS n, line FROM l),
    folded AS (SELECT doc, list_reduce(list_prepend({{'k': 0::BIGINT, 'n': 0, 'last': NULL::INT, 'starts': []::BIGINT[]}}, list({{'k': k, 'n': n, 'last': NULL::INT, 'starts': []::BIGINT[]}} ORDER BY k)), lambda s, x:
        CASE WHEN s.last IS NULL OR (x.n > s.last AND x.n <= s.last + 5) OR (x.n = 1 AND s.last > 100) THEN {{'k': x.k, 'n': x.n, 'last': x.n, 'starts': list_append(s.starts, x.k)}} ELSE {{'k': x.k, 'n': x.n, 'last': s.last, 'starts': s.starts}} END).starts AS starts FROM n GROUP BY doc),
    r AS (SELECT doc, k, len(list_filter(starts, lambda x: x <= k)) AS ref, trim('[' || n || '] 2001 ' || line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM n JOIN folded USING (doc))
    SELECT doc, ref::INT AS ref, string_agg(t, ' ' ORDER BY k) AS raw FROM r WHERE ref > 0 GROUP BY ALL HAVING length(string_agg(t, ' ' ORDER BY k)) > 30""")
def numbered_lines(spark, sf_dir):
    """Numbers that jump, fall back and begin again: a line begins a reference only one to five above the last, or at 1 after a hundred."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "l")).withColumn("k", F.col("at") + 1)
    number = F.greatest(F.lit(1), F.expr(_NUMBER)).cast("int")
    return R.numbered_references(lines.select("doc", "at", F.concat(F.lit("["), number.cast("string"), F.lit("] 2001 "), F.col("l")).alias("line")))


@query("""WITH n AS (SELECT n_nationkey AS doc, n_nationkey AS numbered, (n_nationkey * 7) % 30 AS author, 5 AS manual FROM nation)
    SELECT doc, CASE WHEN numbered >= 20 THEN 'numbered' WHEN author >= 20 THEN 'author' WHEN numbered >= author AND numbered >= manual THEN 'numbered' WHEN author >= manual THEN 'author' ELSE 'manual' END AS strategy,
        CASE WHEN numbered >= 20 THEN numbered WHEN author >= 20 THEN author ELSE greatest(numbered, author, manual) END::BIGINT AS n FROM n""")
def reference_strategy(spark, sf_dir):
    """The first way that gives 20 references, else the one with most; a table by hand comes last."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"))
    refs = lambda size: n.withColumn("n", size).filter("n > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("ref"), F.lit("r").alias("raw"))
    return R.chosen_references(refs(F.col("doc")), refs((F.col("doc") * 7 % 30).cast("int")), refs(F.lit(5))).groupBy("doc", "strategy").agg(F.count("*").alias("n"))


_WORDS = """(SELECT n_nationkey AS page, CASE WHEN col = 0 THEN 50.0 WHEN n_nationkey % 3 = 0 THEN 320.0 WHEN n_nationkey % 3 = 1 THEN 75.0 ELSE 480.0 END + 40 * w AS x0, 99 + 12 * r + 6 * col + 0.4 * w AS top, 600.0 AS width,
    n_name || '.' || col || '.' || r || '.' || w AS text, r, col FROM nation CROSS JOIN (SELECT unnest(range(8)) AS r) CROSS JOIN (SELECT unnest(range(2)) AS col) CROSS JOIN (SELECT unnest(range(3)) AS w))"""


@query(f"""SELECT page, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN page % 3 = 0 THEN col ELSE 0 END, r, col)::INT - 1 AS "at", string_agg(text, ' ' ORDER BY x0) AS line FROM {_WORDS} GROUP BY page, r, col""")
def page_columns(spark, sf_dir):
    """Rows that begin at two margins: a wide gap in the middle of the page parts columns, which are read one after the other."""
    n = table(spark, sf_dir, "nation")
    grid = n.select(F.col("n_nationkey").alias("page"), "n_name", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("r")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("col")).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("w"))
    margin = F.when(F.col("col") == 0, 50.0).when(F.col("page") % 3 == 0, 320.0).when(F.col("page") % 3 == 1, 75.0).otherwise(480.0)
    words = grid.select("page", (margin + 40 * F.col("w")).alias("x0"), (99 + 12 * F.col("r") + 6 * F.col("col") + 0.4 * F.col("w")).alias("top"), F.lit(600.0).alias("width"), F.concat_ws(".", "n_name", *[F.col(c).cast("string") for c in ("col", "r", "w")]).alias("text"))
    return R.page_lines(words)


# -- decisions ------------------------------------------------------------------------------------------------------------
_ANSWER: Columns = {
    "doi": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '10.1/' || CAST(o_orderkey AS STRING) END", "title": "'T' || CAST(o_orderkey AS STRING)", "year": "CAST(1990 + o_orderkey % 30 AS STRING)",
    "decision": "CASE o_orderstatus WHEN 'F' THEN 'include' WHEN 'O' THEN 'defer' ELSE 'exclude' END", "criterion": "CASE WHEN o_orderkey % 5 = 0 THEN 'EC2' END", "f1_provisional": "''",
    "preprint_paper": "CASE WHEN o_orderkey % 4 = 0 THEN 'preprint' END", "rationale": "CASE WHEN o_orderkey % 7 = 0 THEN '[manual] r' ELSE 'r' END",
}


@query(f"""WITH a AS {sql_of('orders', _ANSWER)}, b AS (SELECT *, CASE WHEN decision = 'defer' THEN '[snowball-forced-exclude] LLM deferred due to insufficient context (abstract unavailable from seed citation). ' || rationale ELSE rationale END AS r FROM a)
    SELECT CASE WHEN doi <> '' THEN 'doi:' || doi ELSE 'hash:' || left(md5(title || year), 12) END AS paper_id, CASE WHEN decision = 'defer' THEN 'exclude' ELSE decision END AS decision,
        CASE WHEN criterion IS NULL AND decision = 'defer' THEN 'EC4' ELSE coalesce(criterion, '') END AS criterion, coalesce(preprint_paper, 'unknown') AS preprint_paper, CASE WHEN starts_with(r, '[') THEN r ELSE '[LLM-snowball] ' || r END AS rationale, 'snowball' AS pass_number, 16 AS n_columns FROM b""")
def decisions_from_answers(spark, sf_dir):
    out = X.from_answers(made(spark, sf_dir, "orders", _ANSWER), "s1", "AB", "2026-01-01")
    return out.select("paper_id", "decision", "criterion", "preprint_paper", "rationale", "pass_number", F.lit(len(out.columns)).alias("n_columns"))


@query("""SELECT 'p' || o_orderkey AS paper_id, CASE WHEN o_orderkey % 2 = 0 THEN '[rater-override] why' ELSE 'why' END AS rationale, 'llm-approved' AS pass_number, 't' || o_orderkey AS first_decision_timestamp, '' AS doi FROM orders""")
def decisions_from_reviews(spark, sf_dir):
    rows = made(spark, sf_dir, "orders", {"paper_id": "'p' || CAST(o_orderkey AS STRING)", "rater_override": "CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE '' END", "rationale": "'why'", "timestamp": "'t' || CAST(o_orderkey AS STRING)"})
    return X.from_reviews(rows, "s1", "AB", "2026-01-01").select("paper_id", "rationale", "pass_number", "first_decision_timestamp", "doi")


@query("""SELECT 'T' || p_partkey AS title, CAST(p_size AS STRING) AS year, '(not available — snowball reference from seed PDF)' AS abstract, '' AS source, '' AS paratext_flag FROM part""")
def shown_references(spark, sf_dir):
    rows = made(spark, sf_dir, "part", {"title": "'T' || CAST(p_partkey AS STRING)", "year": "CAST(p_size AS STRING)", "doi": "''"})
    return X.shown_reference(rows).select("title", "year", "abstract", "source", "paratext_flag")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'exclude' ELSE o_orderstatus END AS decision, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'EC1' ELSE 'EC4' END WHEN o_orderkey % 2 = 0 THEN 'EC1' ELSE '' END AS criterion,
    CASE WHEN o_orderstatus = 'O' THEN '[forced exclude] ' ELSE '' END || 'r' AS rationale FROM orders""")
def forced_exclusions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "defer").otherwise(F.col("o_orderstatus")).alias("decision"), F.when(F.col("o_orderkey") % 2 == 0, "EC1").otherwise("").alias("criterion"), F.lit("r").alias("rationale"))
    return S.forced_exclusions(rows)


# -- codes, clusters, modes -------------------------------------------------------------------------------------------------
@query("""SELECT DISTINCT p_name || ' ' || p_type AS code, 256 AS dims, 1.0::DOUBLE AS norm, true AS cached FROM part""")
def embedded_codes(spark, sf_dir):
    """Made once a text; asked again, with other texts or without, those that were made come from where they were kept."""
    path = scratch(spark)
    codes = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("c"))
    first = E.embedded(codes.filter("c > 'm'"), "c", path)
    again = E.embedded(codes, "c", path)
    if not first.filter("cached").isEmpty() or again.filter("cached").count() != first.count():
        raise ValueError("not taken from the cache text by text")
    out = E.embedded(codes, "c", path)
    return out.select("code", F.size("embedding").alias("dims"), F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), "cached")


@query("""SELECT lang, count(*) AS n, true AS told_apart FROM documents WHERE doc_id % 2 = 0 AND lang IS NOT NULL GROUP BY lang""")
def learnt_embeddings(spark, sf_dir):
    """Word vectors learnt from all documents; whether the nearest centre of the odd documents' languages is that of each language's even ones, for nine of ten."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").filter("lang is not null")
    path = scratch(spark)
    E.text_vectors(docs, "text", E.word_vectors(docs, "text", vocabulary=4000, dims=32)).drop("text").write.parquet(path)
    rows = spark.read.parquet(path)
    sums = rows.filter("doc_id % 2 = 1").select("lang", F.posexplode("embedding").alias("k", "v")).groupBy("lang", "k").agg(F.avg("v").alias("v"))
    means = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "v")))["v"].alias("centre"))
    norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x))
    centres = means.select("lang", F.transform("centre", lambda x: x / norm).alias("centre"))
    told = E.nearest_labels(rows.filter("doc_id % 2 = 0"), "embedding", centres, "lang")
    return told.groupBy("lang").agg(F.count("*").alias("n"), (F.avg((F.col("nearest") == F.col("lang")).cast("double")) >= 0.9).alias("told_apart"))


@query("""SELECT p_type AS cluster, count(*) AS size, md5(string_agg(CAST(p_partkey AS STRING), ',' ORDER BY p_partkey)) AS items_md5, (SELECT string_agg(b, ',' ORDER BY k) FROM (SELECT p_brand AS b, min(p_partkey) AS k FROM part q WHERE q.p_type = part.p_type GROUP BY 1)) AS brands FROM part GROUP BY 1""")
def cluster_contents(spark, sf_dir):
    """Members in order, and another column's distinct values in the order in which members have them."""
    out = L.members(table(spark, sf_dir, "part").select(F.col("p_type").alias("cluster"), "p_partkey", "p_brand"), "cluster", "p_partkey", "p_brand")
    return out.select("cluster", "size", F.md5(F.encode(F.array_join(F.col("items").cast("array<string>"), ","), "UTF-8")).alias("items_md5"), F.array_join("p_brands", ",").alias("brands"))


_EDITS = """(SELECT n_nationkey AS cluster_id, CASE WHEN n_nationkey % 6 = 0 THEN 'split' WHEN n_nationkey % 6 = 1 AND (n_nationkey + 1) % 6 <> 0 THEN 'merged' WHEN n_nationkey % 6 = 2 THEN 'approved' WHEN n_nationkey % 6 = 3 THEN 'approved' ELSE 'pending' END AS status FROM nation)"""


@query(f"""SELECT cluster_id, CASE WHEN cluster_id % 6 = 3 THEN 'Renamed' ELSE n_name END AS label, status, CASE WHEN status = 'merged' THEN cluster_id + 1 END AS target FROM {_EDITS} e JOIN nation ON n_nationkey = cluster_id""")
def cluster_edits(spark, sf_dir):
    """split and merge end a cluster; merging into an ended one is refused; reopening undoes an approval."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("label"))
    k = F.col("cluster_id") % 6
    event = lambda seq, when, action, target=None, label=None: n.filter(when).select(F.lit(seq).alias("seq"), "cluster_id", F.lit(action).alias("action"), (target if target is not None else F.lit(None)).cast("int").alias("target"), F.lit(label).cast("string").alias("label"))
    events = P.united([
        event(1, k == 0, "split"), event(2, k == 1, "merge", F.col("cluster_id") + 1), event(3, k == 2, "approve"), event(4, k == 3, "approve"), event(5, k == 3, "rename", None, "Renamed"),
        event(6, k == 4, "approve"), event(7, k == 4, "reopen"), event(8, k == 5, "merge", F.col("cluster_id") - 5), event(9, k == 0, "approve"),
    ])
    return L.edited(n, events)


@query("""SELECT n_nationkey AS cluster_id, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN 'Label ' || n_regionkey ELSE 'Label ' || n_regionkey || ' (' || n_nationkey || ')' END AS label FROM nation WHERE n_nationkey % 4 > 1""")
def cluster_labels(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    state = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cluster_id"), F.concat(F.lit("Label "), F.col("n_regionkey").cast("string")).alias("label"), F.when(k == 0, "split").when(k == 1, "pending").otherwise("approved").alias("status"))
    return L.emitted(state)


@query("""SELECT n_name AS canonical_label, CASE WHEN n_nationkey % 3 = 0 THEN 'explore' WHEN n_nationkey % 3 = 1 THEN '?' ELSE '' END AS choice, CASE WHEN n_nationkey % 2 = 0 THEN 'repair' END AS suggested, CASE WHEN n_nationkey % 6 = 0 THEN 'overrides repair' ELSE '' END AS note FROM nation""")
def mode_choices(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("canonical_label"), F.col("n_nationkey").alias("k"))
    placed = n.filter("k % 3 < 2").select("canonical_label", F.when(F.col("k") % 3 == 0, "explore").otherwise("?").alias("mode"))
    suggested = n.select("canonical_label", F.when(F.col("k") % 2 == 0, "repair").otherwise("no such mode").alias("suggested"))
    return L.with_suggestions(L.classification_state(n, placed), suggested, ["explore", "repair"])


@query("""SELECT n_name AS canonical_label, 'explore' AS mode FROM nation WHERE n_nationkey % 3 = 0""")
def mode_partition(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    choice = F.when(F.col("n_nationkey") % 3 == 0, "explore").when(F.col("n_nationkey") % 3 == 1, "?")
    return L.emitted_modes(n.select(F.col("n_name").alias("canonical_label"), choice.alias("choice")))


@query("""SELECT n_name AS canonical_label, CASE WHEN n_nationkey % 2 = 0 THEN 'explore' WHEN n_nationkey % 3 = 0 THEN 'bogus' END AS mode FROM nation WHERE n_regionkey = 0 OR n_nationkey % 2 = 1""")
def unusable_answers(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    items = n.select(F.col("n_name").alias("canonical_label"), F.when(F.col("n_nationkey") % 2 == 0, "explore").when(F.col("n_nationkey") % 3 == 0, "bogus").alias("mode"))
    return L.unusable_items(items, n.filter("n_regionkey > 0").select(F.col("n_name").alias("canonical_label")), ["explore"])


_LABELS: Columns = {"id": "p_partkey", "label": "CASE p_size % 8 WHEN 0 THEN 'General Usage' WHEN 1 THEN ' General Pattern ' WHEN 2 THEN 'Misc' WHEN 3 THEN p_name WHEN 4 THEN p_name || ' one two three four' WHEN 5 THEN '' WHEN 6 THEN 'Code  Review' END"}


@query(f"SELECT id, coalesce(p_size % 8 IN (3, 6), false) AS well_formed FROM {sql_of('part', _LABELS)} JOIN part ON id = p_partkey")
def label_form(spark, sf_dir):
    return made(spark, sf_dir, "part", _LABELS).select("id", F.coalesce(L.is_well_formed(F.col("label")), F.lit(False)).alias("well_formed"))


@query("""WITH w AS (SELECT p_brand AS brand, p_partkey, unnest(string_split(lower(p_name), ' ')) AS word, unnest([0, 1]) AS place FROM part WHERE p_size > 2),
    c AS (SELECT brand, word, count(*) AS n, min(p_partkey * 10 + place) AS first FROM w WHERE length(word) >= 4 GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, first) AS k FROM c)
    SELECT brand, string_agg(upper(left(word, 1)) || substring(word, 2), ' ' ORDER BY k) AS label FROM t WHERE k <= 3 GROUP BY 1 UNION ALL SELECT 'short', 'A B C' UNION ALL SELECT 'none', 'Unlabeled Cluster'""")
def fallback_labels(spark, sf_dir):
    """The most common words; without two of them the first text's beginning, else a fixed label."""
    rows = table(spark, sf_dir, "part").filter("p_size > 2").select(F.col("p_brand").alias("brand"), "p_name", "p_partkey")
    more = spark.createDataFrame([("short", "a b c d", 1), ("short", "about", 2), ("none", "x", 1)], "brand string, p_name string, p_partkey long")
    return L.fallback_labels(rows.unionByName(more), "brand", "p_name", "p_partkey")


# -- definitions of done ------------------------------------------------------------------------------------------------------
_DECIDED: Columns = {
    "paper_id": "'p' || CAST(c_custkey AS STRING)", "decision": "CASE c_custkey % 5 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' WHEN 2 THEN 'defer' WHEN 3 THEN 'maybe' ELSE 'exclude' END",
    "criterion": "CASE WHEN c_custkey % 10 = 1 THEN 'EC1' WHEN c_custkey % 10 = 4 THEN 'EC4' WHEN c_custkey % 10 = 6 THEN 'bad' END", "class": "CASE WHEN c_custkey % 3 = 0 THEN 'Evaluation' END",
}


@query(f"""WITH d AS {sql_of('customer', _DECIDED)} SELECT 'decided once' AS rule, 'p' || s_suppkey * 1000 AS item, '0' AS detail FROM supplier WHERE 'p' || s_suppkey * 1000 NOT IN (SELECT paper_id FROM d)
    UNION ALL SELECT 'known decision', paper_id, decision FROM d WHERE decision = 'maybe' UNION ALL SELECT 'exclusion has a criterion', paper_id, '' FROM d WHERE decision = 'exclude' AND coalesce(criterion, '') NOT IN ('EC1', 'EC2', 'EC3', 'EC4', 'EC5', 'EC6')
    UNION ALL SELECT 'class is given', paper_id, '' FROM d WHERE (decision = 'include' OR criterion = 'EC1') AND class IS NULL UNION ALL SELECT 'deferred', paper_id, '' FROM d WHERE decision = 'defer'""")
def done_screening(spark, sf_dir):
    candidates = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), (F.col("s_suppkey") * 1000).cast("string")).alias("paper_id"))
    return Z.screening(candidates, made(spark, sf_dir, "customer", _DECIDED))


@query("""WITH r AS (SELECT 'r' || n_nationkey AS ref_id, CASE n_nationkey % 4 WHEN 0 THEN 'new_include' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'odd' END AS status, CASE WHEN n_nationkey % 3 > 0 THEN '10.1/' || n_nationkey % 7 END AS doi, n_nationkey AS k FROM nation)
    SELECT 'status present' AS rule, ref_id AS item, 'status' AS detail FROM r WHERE status IS NULL UNION ALL SELECT 'known status', ref_id, 'odd' FROM r WHERE status = 'odd'
    UNION ALL SELECT 'DOI once', doi, count(*)::VARCHAR FROM r WHERE doi IS NOT NULL GROUP BY doi HAVING count(*) > 1 UNION ALL SELECT 'seed seen', r_name, '' FROM region WHERE r_regionkey > 2""")
def done_snowballing(spark, sf_dir):
    k = F.col("n_nationkey")
    names = {r["r_regionkey"]: r["r_name"] for r in table(spark, sf_dir, "region").collect()}
    seeds = F.lit(f"{names[0]}| {names[1]} |{names[2]}")
    refs = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), k.cast("string")).alias("ref_id"), F.when(k % 4 == 0, "new_include").when(k % 4 == 1, "unresolved").when(k % 4 == 2, "odd").alias("status"), F.when(k % 3 > 0, F.concat(F.lit("10.1/"), (k % 7).cast("string"))).otherwise(" ").alias("doi"), seeds.alias("source_seed"))
    return Z.snowballing(refs, table(spark, sf_dir, "region").select(F.col("r_name").alias("seed")))


@query("""SELECT 'match rate' AS rule, '' AS item, CAST((SELECT count(*) FROM labels)::DOUBLE / count(*) AS VARCHAR) AS detail FROM documents""")
def done_match_rate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("k"))
    rows = J.lookup_with_status(docs, "k", table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("lk"), "toxic"), "lk", ["toxic"])
    return Z.match_rate(rows.withColumn("doi", F.concat(F.lit("https://doi.org/10.1/"), "k")))


@query("""SELECT 'facets filled' AS rule, 'doi:10.1/' || p_partkey AS item, CASE WHEN p_size % 2 = 0 THEN 'a,b' ELSE 'b' END AS detail FROM part WHERE p_size % 5 = 0 UNION ALL SELECT 'passages exist', 'doi_10.1_' || p_partkey, '' FROM part WHERE p_size % 7 = 0""")
def done_extraction(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    matrix = p.select(F.concat(F.lit("doi:10.1/"), F.col("p_partkey").cast("string")).alias("paper_id"), F.when((F.col("p_size") % 5 == 0) & (F.col("p_size") % 2 == 0), " ").otherwise("x").alias("a"), F.when(F.col("p_size") % 5 > 0, "y").alias("b"))
    files = p.filter("p_size % 7 > 0").select(F.concat(F.lit("doi_10.1_"), F.col("p_partkey").cast("string")).alias("file"))
    return Z.extraction(matrix, ["a", "b"], files)


@query("""SELECT 'original columns unchanged' AS rule, CAST(p_partkey AS STRING) AS item, '' AS detail FROM part WHERE p_size = 3 OR p_partkey % 50 = 1 OR p_partkey % 60 = 2""")
def done_enrichment(spark, sf_dir):
    """A changed cell, a lost row and an added one all show."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    before = p.filter("p_size = 3 or p_partkey % 60 != 2")
    after = p.filter("p_size = 3 or p_partkey % 60 = 2 or p_partkey % 50 != 1").withColumn("p_name", F.when(F.col("p_size") == 3, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).withColumn("rank", F.lit("A"))
    return Z.enrichment(before, after, "p_partkey")


@query("""SELECT 'code in one cluster' AS rule, n_name AS item, CASE WHEN n_nationkey % 4 = 0 THEN '2' ELSE '0' END AS detail FROM nation WHERE n_nationkey % 4 < 2 UNION ALL SELECT 'label once', 'Same Label', '2'
    UNION ALL SELECT 'label well formed', 'other', '' UNION ALL SELECT 'passage id valid', 'doi:10.1:P1', '' UNION ALL SELECT 'confirmed', 'other', 'confirmed_by'""")
def done_consolidation(spark, sf_dir):
    codes = table(spark, sf_dir, "nation").select(F.col("n_name").alias("code"), "n_nationkey")
    listed = lambda when: codes.filter(when).agg(F.to_json(F.collect_list("code")).alias("codes"))
    row = lambda when, label, passages, who: listed(when).select(F.lit(label).alias("canonical_label"), "codes", F.lit(passages).alias("passage_ids"), F.lit(who).alias("confirmed_by"))
    clusters = P.united([row("n_nationkey % 4 != 1", "Same Label", '["doi:10.1:P001"]', "AB"), row("n_nationkey % 4 = 0", "Same Label", '["doi:10.1:P1"]', "AB"), row("false", "other", "[]", " ")])
    return Z.consolidation(codes, clusters)


@query("""SELECT 'label has one mode' AS rule, n_name AS item, '0' AS detail FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'known mode', n_name, 'odd' FROM nation WHERE n_nationkey % 5 = 1
    UNION ALL SELECT 'modes to labels', '', CAST(2.0::DOUBLE / count(*) AS VARCHAR) FROM nation WHERE n_nationkey % 5 > 0""")
def done_classification(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("canonical_label"), F.col("n_nationkey").alias("k"))
    return Z.classification(n, n.filter("k % 5 > 0").withColumn("mode", F.when(F.col("k") % 5 == 1, "odd").otherwise("explore")), ["explore"])


@query("""SELECT 'entities in band' AS rule, n_name AS item, CAST(n AS STRING) AS detail FROM (SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) WHERE n NOT BETWEEN 5 AND 7""")
def done_crosstabs(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return Z.crosstabs(rows.groupBy(F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("unique_entities")), 5, 7)


@query("""SELECT 'cells' AS rule, '' AS item, CAST(count(*)::DOUBLE AS VARCHAR) AS detail FROM nation UNION ALL SELECT 'empty or gap', n_name || ' x ' || n_regionkey, '' FROM nation WHERE n_nationkey % 6 = 0
    UNION ALL SELECT 'gaps logged', CAST(count(*) FILTER (n_nationkey % 3 = 0) AS VARCHAR), '2' FROM nation""")
def done_gap_matrix(spark, sf_dir):
    k = F.col("n_nationkey")
    matrix = table(spark, sf_dir, "nation").select("n_name", "n_regionkey", F.lit(1).alias("n"), (k % 3 == 0).alias("is_gap"), (k % 6 == 0).alias("is_empty"), F.lit(1.0).alias("threshold"))
    register = S.events(spark.range(2), kind="gap_identified").unionByName(S.events(spark.range(3), kind="other"))
    return Z.gap_matrix(matrix, 171, register)


@query("""SELECT 'never falls' AS rule, CAST(n_nationkey AS STRING) AS item, '' AS detail FROM nation WHERE n_nationkey % 10 = 9 UNION ALL SELECT 'total', '', CAST(max(n_nationkey)::DOUBLE AS VARCHAR) FROM nation WHERE n_nationkey % 10 < 9 UNION ALL SELECT 'final window', '', '0.0'""")
def done_saturation(spark, sf_dir):
    k = F.col("n_nationkey")
    curve = table(spark, sf_dir, "nation").select(k.alias("rank"), F.when(k % 10 == 9, k - 5).otherwise(k).alias("cumulative_count"), F.lit(False).alias("in_final_window"))
    return Z.saturation(curve, 20)


@query("""SELECT 'key defined' AS rule, 'k' || n_nationkey AS item, '' AS detail FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT 'entries', '', CAST(count(*)::DOUBLE AS VARCHAR) FROM nation WHERE n_nationkey % 2 = 0""")
def done_bibliography(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("citekey"), "n_nationkey")
    texts = n.select(F.concat(F.lit("As [k0; "), "citekey", F.lit("] and [Fig] say")).alias("text"))
    return Z.bibliography(texts, n.filter("n_nationkey % 2 = 0"), 20)


@query("""SELECT 'passages a mode' AS rule, n_name AS item, CAST(n AS STRING) AS detail FROM (SELECT n_name, count(DISTINCT s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) WHERE n < 2
    UNION ALL SELECT 'mentioned', n_name, '' FROM nation WHERE n_regionkey > 1""")
def done_trust(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    passages = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("mode"), F.col("s_suppkey").alias("passage"))
    texts = n.filter("n_regionkey <= 1").select(F.concat(F.lit("we found <"), F.lower("n_name"), F.lit(">")).alias("text"))
    phrases = n.select(F.concat(F.lit("<"), "n_name", F.lit(">")).alias("phrase"))
    return Z.trust(passages, n.select(F.col("n_name").alias("mode")), texts, phrases).withColumn("item", F.translate("item", "<>", ""))


@query("""SELECT 'columns' AS rule, 'abstract' AS item, 'missing column' AS detail UNION ALL SELECT 'columns', 'doi', 'missing column'""")
def done_search_output(spark, sf_dir):
    return Z.search_output(table(spark, sf_dir, "nation").withColumnRenamed("n_name", "title"), ["title", "abstract", "doi"])


@query("""SELECT url AS item, CAST(octet_length(encode(html)) AS STRING) AS detail FROM pages WHERE octet_length(encode(html)) < 1500 OR left(html, 23) <> '<!DOCTYPE html><html la'""")
def valid_files(spark, sf_dir):
    """Pages as files: of 1500 bytes at least, and beginning with the format's mark."""
    content = F.encode("html", "UTF-8")
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return Q.file_is_valid(files, "valid", b"<!DOCTYPE html><html la", 1500).select("item", "detail")


# -- reports ----------------------------------------------------------------------------------------------------------------
@query(r"""SELECT md5(concat_ws(chr(10), '# Evidence', '', '## Sizes', '', '| label | n |', '| --- | --- |', string_agg('| ' || label || ' | ' || n || ' |', chr(10) ORDER BY n DESC, label), '', '')) AS report_md5 FROM (SELECT p_name || '\|x' AS label, count(*) AS n FROM part GROUP BY 1)""")
def markdown_report(spark, sf_dir):
    """A heading, a section and its table in Markdown, with pipes escaped."""
    sizes = table(spark, sf_dir, "part").groupBy(F.concat("p_name", F.lit("|x")).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
    text = M.report("Evidence", [("Sizes", sizes)])
    return spark.range(1).select(F.md5(F.encode(F.lit(text), "UTF-8")).alias("report_md5"))


# -- more rules and files -----------------------------------------------------------------------------------------------------
@query("""SELECT 'label has one mode' AS rule, n_name AS item, '0' AS detail FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'modes to labels', '', CAST(1.0::DOUBLE / count(*) AS VARCHAR) FROM nation WHERE n_nationkey % 5 > 0 HAVING 1.0::DOUBLE / count(*) > 0.05
    UNION ALL SELECT 'headings', 'b.md', 'Sources' UNION ALL SELECT 'trace resolves', 'P' || n_nationkey, '' FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'verbatim', 'a.md', 'x y' UNION ALL SELECT 'verdict', n_name, '' FROM nation WHERE n_nationkey % 7 = 0""")
def done_taxonomy(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("canonical_label"), F.col("n_nationkey").alias("k"), F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("passage"))
    texts = spark.createDataFrame([("a.md", "# Modes\n\ntext\n\n## Sources of it\n"), ("b.md", "# Modes\nSources\n")], "file string, text string")
    overlaps = spark.createDataFrame([("a.md", "x y")], "target_id string, ngram string")
    verdicts = n.select(F.col("canonical_label").alias("item"), F.when(F.col("k") % 7 == 0, "fail").otherwise("pass").alias("verdict"))
    return Z.taxonomy(texts, ["Modes", "Sources"], n, n.filter("k % 4 != 1"), n, n.filter("k % 5 > 0").withColumn("mode", F.lit("explore")), ["explore"], overlaps, verdicts)


@query("""SELECT 'file present' AS rule, 'refs.bib' AS item, '99' AS detail UNION ALL SELECT 'file present', 'refs.zip', 'missing' UNION ALL SELECT 'in archive', p_brand, '' FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 3)""")
def done_bibliography_files(spark, sf_dir):
    files = spark.createDataFrame([("refs.bib", 99), ("style.csl", 5000)], "name string, length long")
    wanted = spark.createDataFrame([("refs.bib",), ("refs.zip",), ("style.csl",)], "name string")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), "p_size")
    return Z.bibliography_files(files, wanted, 100, p, p.filter("p_size < 3"))


@query("""SELECT 'passages a mode' AS rule, n_name AS item, CAST(n AS STRING) AS detail FROM (SELECT n_name, count(DISTINCT s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) WHERE n < 2
    UNION ALL SELECT 'gap pair named', n_name || ' x ' || r_name, '' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 > 0
    UNION ALL SELECT 'criterion', 'novelty', '' UNION ALL SELECT 'threshold', 'P40', '' UNION ALL SELECT 'survey', 'second survey', ''""")
def done_invariants(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    passages = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("mode"), F.col("s_suppkey").alias("passage"))
    # A name is also part of longer ones, so all stand in marks.
    marked = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    pairs = n.filter("n_nationkey % 2 = 0").select(marked("n_name").alias("row"), F.col("r_name").alias("column"))
    agenda = n.filter("n_nationkey % 3 = 0").select(F.concat(F.lit("Validity: "), marked(F.lower("n_name")), F.lit(" and "), "r_name").alias("text"))
    one = lambda *x: spark.createDataFrame([(y,) for y in x], "phrase string")
    text = lambda x: spark.createDataFrame([(x,)], "text string")
    found = Z.invariants(passages, t("nation").select(F.col("n_name").alias("mode")), pairs, agenda, one("validity", "novelty"), {"threshold": (text("P20 and p33"), one("P33", "P40")), "boundary": (text("limits: none"), one("Limits")), "survey": (text("first survey"), one("first survey", "second survey"))})
    return found.withColumn("item", F.translate("item", "<>", ""))


@query("""SELECT 'skeleton' AS rule, n_name AS item, 'missing' AS detail FROM nation UNION ALL SELECT 'skeleton', url, CAST(max(length(html)) AS STRING) FROM (SELECT url, CASE WHEN page_id % 3 = 0 THEN '' ELSE html END AS html FROM pages) GROUP BY url HAVING max(length(html)) < 1
    UNION ALL SELECT 'placeholder', CAST(item_id AS STRING), '{years}' FROM benchmark WHERE item_id % 2 = 1
    UNION ALL SELECT 'brackets', CAST(item_id AS STRING), '' FROM benchmark WHERE len(text) - len(replace(text, '(', '')) + (item_id % 2 = 0)::INT <> len(text) - len(replace(text, ')', ''))""")
def done_skeleton(spark, sf_dir):
    """Pages as the files of a skeleton, some of them empty and others missing; item texts as query templates without a placeholder, or with a bracket too many."""
    pages, items = table(spark, sf_dir, "pages"), table(spark, sf_dir, "benchmark")
    files = pages.select(F.col("url").alias("name"), F.when(F.col("page_id") % 3 == 0, 0).otherwise(F.length("html")).cast("long").alias("length"))
    wanted = pages.select(F.col("url").alias("name")).unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    template = F.concat("text", F.when(F.col("item_id") % 2 == 0, " {terms} {years})").otherwise(" {terms}"))
    return Z.skeleton(files, wanted).unionByName(Z.query_template(items.select(F.col("item_id").cast("string").alias("name"), template.alias("text")), ["{terms}", "{years}"]))


@query(f"""WITH {'{evidence}'}, t AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.5) AS b FROM cells WHERE n > 0)
    SELECT brand, nation, n, 'normal' AS was, 'gap' AS now FROM cells, t WHERE n > a AND n <= b""".replace("{evidence}", Y._EVIDENCE.strip()))
def threshold_flips(spark, sf_dir):
    """Cells that a higher quantile calls a gap and the usual one doesn't."""
    return A.threshold_flips(Y._matrix(spark, sf_dir).select("brand", "nation", "n"), ["brand", "nation"], 0.25, 0.5)


@query("""SELECT 'k' || (p_partkey % 50) AS citekey, arg_max('files/' || p_partkey || '.pdf', p_partkey) AS attached FROM part WHERE p_size % 2 = 0 GROUP BY 1""")
def attached_files(spark, sf_dir):
    """The file of each entry that names one; the last entry of a key counts."""
    p = table(spark, sf_dir, "part")
    fields = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("file"), F.concat(F.lit("files/"), F.col("p_partkey").cast("string"), F.lit(".pdf")))).otherwise(F.create_map(F.lit("year"), F.lit("2000")))
    return I.file_fields(p.select(F.concat(F.lit("k"), (F.col("p_partkey") % 50).cast("string")).alias("citekey"), F.lit("a.bib").alias("file"), F.col("p_partkey").alias("at"), fields.alias("fields")))


@query("""SELECT 'seed_' || n_regionkey AS seed, n_name AS title, CAST(n_nationkey AS STRING) AS year FROM nation""")
def seed_tables(spark, sf_dir):
    folder = scratch(spark)
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.col("n_nationkey").cast("string").alias("year"), "n_regionkey")
    for r in range(5):
        O.quoted_csv(n.filter(F.col("n_regionkey") == r).select("title", "year"), f"{folder}/seed_{r}.csv")
    return I.seed_tables(spark, folder, ["title", "year"])


@query("""WITH p AS (SELECT p_partkey AS k, length(p_name) AS n FROM part) SELECT k, round(CASE k % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 2 * n / (2 * n + 4) ELSE 2 * n / (2 * n + 2) END, 9) AS ratio FROM p""")
def title_ratio(spark, sf_dir):
    """The gestalt ratio of titles that are equal but for case and marks, wholly different, longer at the end, and parted by a number in the middle."""
    p, name = table(spark, sf_dir, "part"), F.col("p_name")
    k = F.col("p_partkey") % 4
    parted = F.concat(F.substring(name, 1, 2), F.lit("99"), F.expr("substring(p_name, 3)"))
    other = F.when(k == 0, F.concat(F.lit("'"), F.upper(name), F.lit("!"))).when(k == 1, "0123456789").when(k == 2, F.concat(name, F.lit(" 777"))).otherwise(parted)
    return p.select(F.col("p_partkey").alias("k"), F.round(T.sequence_ratio(name, other), 9).alias("ratio"))


@query("""WITH e AS (SELECT ts, event_type FROM events) SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM e GROUP BY ALL""")
def streamed_counts(spark, sf_dir):
    """A stream over the events in event-time windows, run to its end: what its table then holds."""
    folder, name = scratch(spark), f"counts_{scratch(spark)[-8:]}"
    table(spark, sf_dir, "events").select("ts", "event_type").repartition(3).write.parquet(folder)
    counts = streams.windowed_counts(streams.events_stream(spark, folder, "ts timestamp, event_type string"), "ts", "event_type", late="3650 days")
    run = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query("""SELECT phase, kind, subject FROM (SELECT DISTINCT '1' AS phase, event_type AS kind, CAST(user_id AS STRING) AS subject FROM events)""")
def streamed_register(spark, sf_dir):
    """A stream into the register, then once more over the same files: each event's key is there once."""
    folder, register = scratch(spark), scratch(spark)
    S.events(table(spark, sf_dir, "events"), phase="1", kind=F.col("event_type"), subject=F.col("user_id")).repartition(3).write.parquet(folder)
    for _ in range(2):
        stream = streams.events_stream(spark, folder, S.REGISTER_SCHEMA)
        stream.writeStream.foreachBatch(streams.append_new(register, ["phase", "kind", "subject"])).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(register).select("phase", "kind", "subject")


@query(Y.ORACLE_SQL["saturation_users"])
def streamed_saturation(spark, sf_dir):
    """The curve of users and their keys from a stream over the events, in whatever order they come, run to its end."""
    folder, found = scratch(spark), scratch(spark)
    table(spark, sf_dir, "events").select("user_id", "ts", F.get_json_object("props", "$.k").alias("label")).repartition(3).write.parquet(folder)
    before = spark.conf.get(streams.STATE_STORE[0])
    spark.conf.set(*streams.STATE_STORE)
    try:
        stream = streams.events_stream(spark, folder, "user_id long, ts timestamp, label string")
        rows = streams.first_labels(stream, "user_id", "ts", "label")
        rows.writeStream.format("parquet").option("path", found).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(streams.STATE_STORE[0], before)
    return streams.curve_of(spark, found, "entity long, first timestamp, label string")


@query("""SELECT n_name AS name, CAST(n_regionkey AS STRING) AS region, NULL::VARCHAR AS note FROM nation UNION ALL SELECT r_name, CAST(r_regionkey AS STRING), 'a & <b>' FROM region""")
def workbook_sheets(spark, sf_dir):
    """Two sheets of a workbook, written and read: columns by their names, blanks as nulls, marks escaped."""
    n = [[r["n_name"], str(r["n_regionkey"]), None] for r in table(spark, sf_dir, "nation").collect()]
    r = [["a & <b>", r["r_name"], str(r["r_regionkey"])] for r in table(spark, sf_dir, "region").collect()]
    path = f"{scratch(spark)}.xlsx"
    O.write_bytes(spark, O.workbook_bytes({"Journals": [["name", "region", "note"], *n], "Conf & more": [["note", "name", "region"], *r]}), path)
    found = I.sheets(spark, path, {"Journals": ["name", "region", "note"], "Conf & more": ["name", "region", "note"]})
    return found["Journals"].unionByName(found["Conf & more"])


_CHARTED = "(SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)"


@query(f"""SELECT 'bars' AS chart, count(*) AS marks, sum(n)::BIGINT AS total FROM (SELECT p_brand, sum(n) AS n FROM {_CHARTED} GROUP BY 1) UNION ALL SELECT 'stacked', count(*), NULL FROM (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT p_type FROM part)
    UNION ALL SELECT 'heatmap', count(*), sum(n)::BIGINT FROM {_CHARTED} UNION ALL SELECT 'bubbles', count(*), sum(n)::BIGINT FROM {_CHARTED}""")
def charts(spark, sf_dir):
    """Marks of each chart and the sum of the numbers written at them; the legend's marks don't count."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    whole = counts.groupBy("p_brand").agg(F.sum("n").alias("n"))
    drawn = {"bars": (H.bars(whole, "Brands"), '<rect x='), "stacked": (H.stacked_bars(counts, "Types"), 'height="15"'), "heatmap": (H.heatmap(counts, "Cells"), '<rect x='), "bubbles": (H.bubbles(counts, "Cells"), "<circle")}
    rows = [(name, svg.count(mark), None if name == "stacked" else sum(int(x) for x in re.findall(r">(\d+)</text>", svg))) for name, (svg, mark) in drawn.items()]
    return spark.createDataFrame(rows, "chart string, marks long, total long")
