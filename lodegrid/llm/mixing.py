"""Mixing sources to target weights by a splitting tree of multivariate hypergeometric draws (DataFrame functions only).

Every source is dealt into blocks by a seeded hash of doc_id. Its target fixes an exact quota of
blocks: each block once per whole pass over the source, and for the rest of the target a seeded
permutation of blocks, cut within its last block at the document nearest to the target. The
quotas of all sources are then split recursively over the output shards, left half and right half,
by multivariate hypergeometric draws; each leaf takes disjoint runs of the permuted blocks, and the
rows of a shard are permuted locally. Beyond STRATA sources the tree splits the quotas of groups of
sources, and the permutation of a group's blocks splits them among its sources by the same law.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.llm.common import WORD, draw_without_replacement, free_name, lookup, numbered, own_columns, small_table, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_PASSES = 2
N_SHARDS = 16
#: Rows of a block, about, and the least and most blocks of a source: a larger source has larger blocks.
BLOCK_ROWS = 200
LEAST_BLOCKS = 32
MOST_BLOCKS = 1 << 16
#: The tree's draws are made for so many groups of sources at most; up to this number each source is a group.
STRATA = 1000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """sid, source, source_size, n_rows, target: the sources in order of code point, null last, weigh ``weights`` in turn.

    Together they get ``share`` times all sizes; a source stops at ``most`` times its own size and
    the excess goes to the others by weight, until none is above. Sources are sorted and numbered
    partition by partition and each resharing is a sum over them, so there may be any number.
    """
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sorted_ = stored(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
    starts, before = [], 0
    for part, n in sorted(tuple(r) for r in sorted_.groupBy("__part").count().collect()):  # a number per partition
        starts.append({"__part": part, "__before": before})
        before += n
    if not starts:
        return totals.select(F.lit(1).alias("sid"), "source", "source_size", "n_rows", F.lit(0.0).alias("target")).limit(0)
    start = F.broadcast(small_table(slim.sparkSession, starts, "__part: int, __before: bigint"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sid = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    s = sorted_.join(start, "__part").select(sid.alias("sid"), "source", "source_size", "n_rows")
    s = stored(s.withColumn("weight", F.element_at(turn, ((F.col("sid") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", (F.col("source_size") * most).cast("double")))
    total = share * float(s.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        capped, free = s.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        higher = (total - capped) / free if free else level
        if higher <= level:
            break
        level = higher
    return s.select("sid", "source", "source_size", "n_rows", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def split_quotas(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Counts [shard, source] of blocks: leaves of the tree of multivariate hypergeometric draws. Columns add up to the quotas."""
    out = np.zeros((n_shards, len(quotas)), dtype=np.int64)

    def split(quota: np.ndarray, first: int, last: int, node: int) -> None:
        if last - first == 1:
            out[first] = quota
            return
        middle, total = (first + last) // 2, int(quota.sum())
        n_left = total * (middle - first) // (last - first)
        left = draw_without_replacement(np.random.default_rng([seed, node]), quota, n_left)
        split(left, first, middle, 2 * node)
        split(quota - left, middle, last, 2 * node + 1)

    split(np.array(quotas, dtype=np.int64), 0, n_shards, 1)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES, n_shards: int = N_SHARDS, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rid_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, drawn). facts has a row per input row: rid (number of the row, or rid_col), doc_id, source, size, source_size, target.
    drawn has a row for each copy that the mix takes: rid, doc_id, size, copy, shard, sid, block (of its
    source) and slot, its place in the permuted block.

    Size is the number of words; null and empty texts have size 0 and are never drawn. A null source
    is a source of its own, the last one. Null and repeated doc_ids are rows like others. A table
    without words or rows gives targets of 0 and no drawn rows. Only the three named columns are read.
    The same rows give the same sizes drawn, whatever their order or partitions.
    """
    spark = docs.sparkSession
    rid = F.col(rid_col) if rid_col else F.monotonically_increasing_id()
    source = F.col(source_col).cast("string")
    # The text's hash tells rows apart that share an id; a null source has a key of its own.
    named = docs.select(rid.alias("rid"), F.col(id_col).alias("doc_id"), source.alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("at"))
    slim = stored(named.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    targets = stored(source_targets(slim, weights, share, most))
    n_blocks = F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("n_rows") / BLOCK_ROWS))).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("n_blocks", n_blocks).withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = stored(plan.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source"))
    facts = lookup(slim, plan, ["skey"], "n_rows", max(1, slim.count())).drop("skey")
    facts = stored(facts.withColumn("block", F.pmod("at", "n_blocks")))

    # Blocks with rows, in a seeded permutation; the last one that the rest of the target reaches is cut.
    blocks = facts.groupBy("sid", "block").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("passes", "rest")])
    permuted = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed + 1), "sid", "block"), "block")
    blocks = blocks.withColumn("before", F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))
    blocks = stored(blocks.withColumn("partial", F.col("before") < F.col("rest")).withColumn("stratum", F.pmod("sid", F.lit(STRATA)).cast("int")))
    quotas = blocks.groupBy("stratum").agg(F.sum(F.col("passes") + F.col("partial").cast("long")).alias("n")).orderBy("stratum").collect()  # STRATA rows at most
    matrix = split_quotas([r["n"] for r in quotas], n_shards, seed)
    leaves = small_table(spark, [{"stratum": r["stratum"], "ends": np.cumsum(matrix[:, k]).tolist()} for k, r in enumerate(quotas)], "stratum: int, ends: array<bigint>")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes") + F.col("partial").cast("long")))
    drawing = Window.partitionBy("stratum").orderBy(F.xxhash64(F.lit(seed + 4), "sid", "block", "copy"), "sid", "block", "copy")
    units = blocks.filter("passes > 0 or partial").withColumn("copy", copies).withColumn("unit", F.row_number().over(drawing) - 1).join(F.broadcast(leaves), "stratum")
    units = units.select("sid", "block", "copy", "before", (F.col("copy") > F.col("passes")).alias("cut"), F.size(F.filter("ends", lambda end: end <= F.col("unit"))).alias("shard"))

    within = Window.partitionBy("sid", "block").orderBy(F.xxhash64(F.lit(seed + 2), "at", "size"), "doc_id", "size", "rid")
    drawn = facts.withColumn("so_far", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(units, ["sid", "block"])
    # A document of the cut block is in if its middle is before the target: the sum misses it by half a document at most.
    drawn = drawn.filter((F.col("size") > 0) & (~F.col("cut") | (F.col("before") + F.col("so_far") - F.col("size") / 2 <= F.col("rest"))))
    locally = Window.partitionBy("shard", "sid", "block").orderBy(F.xxhash64(F.lit(seed + 3), "at", "copy"), "rid", "copy")
    drawn = drawn.select("rid", "doc_id", "size", "copy", "shard", "sid", "block", F.row_number().over(locally).alias("slot"))
    return facts.select("rid", "doc_id", "source", "size", "source_size", "target"), drawn


def mixed_totals(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repeats counted)."""
    facts, drawn = mix(docs, **options)
    taken = drawn.groupBy("rid").agg(F.sum("size").alias("taken"))
    return facts.join(taken, "rid", "left").select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their own columns; a row taken twice is there twice.

    Rows are told apart by number, so null and repeated ids are rows like others.
    """
    rows, rid = numbered(docs)
    slim = rows.select(F.col(rid).alias("rid"), *[c.alias(name) for c, name in zip(own_columns(rows, [id_col, text_col, source_col]), ("doc_id", "text", "source"), strict=True)])
    _, drawn = mix(slim, rid_col="rid", **options)
    times = free_name(rows, "__times")
    taken = stored(drawn.groupBy("rid").agg(F.count("*").cast("int").alias(times)).withColumnRenamed("rid", rid))
    out = rows.join(taken.hint("merge"), rid)  # the same plan at every size
    return out.select(*own_columns(docs), F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(rid)).select(*own_columns(docs))
