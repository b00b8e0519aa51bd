"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.llm import exact_dedup, language, lexical, line_dedup, mixing, neighbours, quality, repeats, sentence_pieces, sharding, simhash, toxicity, whitening
from lodegrid.llm.simhash_sql import simhash_sql

PIECE_MODEL = "piece_bpe_32k.model"
N_SHARDS = 40
N_COMPONENTS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law rows: the shuffle keeps nothing together, so shard counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = sharding.shuffle_into_shards(slim, N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_totals(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_of_every(table(spark, sf_dir, "embeddings"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_digests(table(spark, sf_dir, "documents"), piece_model_path())


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"), N_COMPONENTS)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_repeats": op4_repeats,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_neighbours": op9_neighbours,
    "op10_sentence_pieces": op10_sentence_pieces,
    "op11_language": op11_language,
    "op12_whitening": op12_whitening,
    "op13_lexical": op13_lexical,
}

ORACLE_SQL: dict[str, str] = {
    "op1_simhash": simhash_sql(),
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)
    """,
    "op9_neighbours": """
        WITH all_ AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        fine AS (SELECT vec_id, e FROM all_ WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        v AS (SELECT row_number() OVER () AS rid, vec_id, e, len(e) AS dims, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS length FROM fine),
        near AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, c.rid AS other,
            list_reduce(list_transform(range(1, q.dims + 1), lambda i: c.e[i] * q.e[i]), lambda a, b: a + b) / (c.length * q.length) AS score
            FROM v q JOIN v c ON q.rid <> c.rid AND q.dims = c.dims WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other) AS rank FROM near) WHERE rank <= 5
    """,
    "op13_lexical": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        n AS (SELECT * FROM d WHERE len(t) > 0),
        total AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS terms FROM n),
        i AS (SELECT DISTINCT item, item_id, term FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
        tf AS (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM n) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
        df AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, docs),
        impact AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))) AS x FROM tf JOIN df USING (term), total),
        score AS (SELECT item, item_id, rid, doc_id, sum(x)::BIGINT AS score FROM i JOIN impact USING (term) GROUP BY ALL HAVING sum(x) > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM score) WHERE rank <= 50
    """,
    "op4_repeats": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
        f AS (SELECT s, min({'doc_id': doc_id, 'p': p}) AS first FROM w GROUP BY s HAVING count(*) > 1),
        later AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM w JOIN f USING (s) WHERE doc_id <> first.doc_id OR p <> first.p),
        runs AS (SELECT doc_id, p, sum((step IS NULL OR step > 100)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM later),
        spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY ALL),
        pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM spans),
        cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS head FROM pieces JOIN d USING (doc_id) GROUP BY 1)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
    """,
}
