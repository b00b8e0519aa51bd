"""A corpus pipeline: toxicity, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of
``documents``. Stages may be run one by one, each on the written result of the one before. The intermediate tables of a
stage stay as long as any DataFrame reads them (``lodegrid.llm.common.reclaim``); ``run`` deletes them when a result is written.

Null texts count as empty in every stage. Rows are told apart by number, so null and repeated doc_ids are rows like
others; of equal rows the stages that remove copies keep one. Further columns pass through, whatever their names. An
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegrid.llm import exact_dedup, mixing, sentence_pieces, simhash, toxicity
from lodegrid.llm.common import scope, stored, sweep
from lodegrid.llm.queries import piece_model_path, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learnt from the training part of ``labels``, is below one half. Empty texts stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the one with the smallest doc_id; null ids come last."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints are linked, the one with the smallest doc_id; null ids come last."""
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mixture of sources takes; a row that is taken twice is there twice. Texts without words are never taken."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text that they decode to."""
    return sentence_pieces.piece_digests(docs, piece_model_path())


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("sentence_pieces", tokens),
]

#: Seeded draws, XXH64 fingerprints, a trained classifier and a tokenizer: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next and deleted after it."""
    docs, before = table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES[:-1]:
        with scope(f"stage-{name}") as meanwhile:
            kept = stage(spark, docs, sf_dir)
        with scope(f"result-{name}") as now:
            docs = stored(kept)
        for done in filter(None, (meanwhile, before)):
            sweep(spark, done)
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
