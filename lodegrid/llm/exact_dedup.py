"""Exact de-duplication by deterministic block naming (DataFrame functions only).

Each normalised text is cut into blocks of a fixed size. The distinct blocks are sorted and get
integer names; then adjacent pairs of names are named the same way, level by level, until every
document has one name. Two documents with the same number of blocks have the same last name if
and only if their texts are equal: names stand for whole blocks and pairs, never for their hashes.

Hashes only route: an occurrence finds its block's name by a 128-bit key instead of shuffling the
block once more. That no key belongs to two distinct blocks is verified on the distinct blocks
themselves; otherwise the keys are drawn again with another salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.llm.common import SPACE, lookup, numbered, own_columns, stored

BLOCK_BYTES = 4096


def _keys(block: Column, salt: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * salt), block).alias("k1"), F.xxhash64(F.lit(2 * salt + 1), block).alias("k2")]


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Integer names in sorted order, partition by partition; they follow from the rows alone."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _occurrences(docs: DataFrame, rid: Column, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """rid, n_blocks, pos, block, k1, k2 of every block, and doc_id and sha with the first. Blocks are cut from bytes, so each is found without counting characters."""
    norm = F.encode(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " "), "UTF-8")
    # Exploding an array of one keeps the planner from working the text out anew for each use.
    once = docs.select(F.col(id_col).alias("doc_id"), rid.alias("rid"), F.explode(F.array(norm)).alias("norm"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / block_bytes).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring(F.col("norm"), i * block_bytes + 1, F.lit(block_bytes)))
    rows = once.withColumn("n_blocks", n_blocks).select("doc_id", "rid", "norm", "n_blocks", F.posexplode(cut).alias("pos", "block"))
    first = F.col("pos") == 0
    return rows.select("rid", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.sha2("norm", 256)).alias("sha"), "n_blocks", "pos", "block", *_keys(F.col("block"), 0))


def _block_names(occurrences: DataFrame, max_salts: int = 8) -> tuple[DataFrame, DataFrame]:
    """(names by key, occurrences with the keys that tell all distinct blocks apart)."""
    for salt in range(max_salts):
        keyed = occurrences if not salt else occurrences.drop("k1", "k2").select("*", *_keys(F.col("block"), salt))
        names = stored(_named(keyed.select("block", "k1", "k2").distinct(), ["block"]).select("k1", "k2", "name"))
        if names.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
            return names, keyed.drop("block")
    raise RuntimeError("no salt gives each distinct block a key of its own")


def _join_names(rows: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Attach names to rows; copies of one document can make a few keys hot."""
    sizes = stored(rows.groupBy(*keys).count().join(names, keys))
    return lookup(rows, sizes, keys, "count", max(1, rows.count())).drop("count", *keys)


def document_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, rid_col: str | None = None) -> DataFrame:
    """One row per input row: rid (number of the row, or rid_col), doc_id, text_sha256, n_blocks, name.

    Texts are equal after whitespace normalisation iff (n_blocks, name) are equal.
    """
    rid = F.col(rid_col) if rid_col else F.monotonically_increasing_id()
    names, occurrences = _block_names(stored(_occurrences(docs, rid, id_col, text_col, block_bytes)))
    facts = occurrences.filter("pos = 0").select("rid", "doc_id", F.col("sha").alias("text_sha256"), "n_blocks")
    level = stored(_join_names(occurrences.select("rid", "n_blocks", "pos", "k1", "k2"), names, ["k1", "k2"]))
    done = [level.filter("n_blocks = 1").select("rid", "name")]
    width = level.agg(F.max("n_blocks")).first()[0] or 1
    step = 1
    current = level.filter("n_blocks > 1")
    while width > 1:
        step *= 2
        width = (width + 1) // 2
        pairs = stored(
            current.groupBy("rid", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")
            )
        )
        named = stored(_join_names(pairs, _named(pairs.select("left", "right").distinct(), ["left", "right"]), ["left", "right"]))
        done.append(named.filter(F.col("n_blocks") <= step).select("rid", "name"))
        current = named.filter(F.col("n_blocks") > step)
    identity = done[0]
    for d in done[1:]:
        identity = identity.unionByName(d)
    return facts.join(identity, "rid").select("rid", "doc_id", "text_sha256", "n_blocks", "name")


def _grouped(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, rid_col: str | None = None) -> DataFrame:
    """rid, doc_id, text_sha256, group_size, first (of the group: null_last, id, first_rid), a row per input row."""
    rows = stored(document_identities(docs, id_col, text_col, block_bytes, rid_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_last"), F.col("doc_id").alias("id"), F.col("rid").alias("first_rid")))
    groups = stored(rows.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), first.alias("first")))
    return lookup(rows, groups, ["n_blocks", "name"], "group_size", max(1, rows.count()))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; empty texts are equal to each other. A null doc_id comes after all
    others when the smallest is sought. Of repeated rows with the smallest doc_id exactly one is
    kept. An empty table gives an empty result. Only id_col and text_col are read, so other
    columns, whatever their names, change nothing.
    """
    out = _grouped(docs, id_col, text_col, block_bytes)
    return out.select("doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.first_rid")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: the one with the smallest id, of several such rows the first.

    Rows are told apart by number, so different texts that share an id, or have none, all stay.
    """
    rows, rid = numbered(docs)
    slim = rows.select(F.col(rid).alias("rid"), *[c.alias(name) for c, name in zip(own_columns(rows, [id_col, text_col]), ("doc_id", "text"), strict=True)])
    kept = _grouped(slim, "doc_id", "text", BLOCK_BYTES, "rid").filter(F.col("rid") == F.col("first.first_rid")).select(F.col("rid").alias(rid))
    kept = stored(kept).hint("merge")  # the same plan at every size
    return rows.join(kept, rid, "left_semi").select(*own_columns(docs))
