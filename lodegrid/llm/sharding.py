"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first, on the driver, from the
distribution that a uniformly random permutation of all rows would give. Then each partition
permutes its rows and deals them out by those counts, the rows are exchanged, and each shard
permutes what it got. Shard sizes are exact: they differ by one row at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.llm.common import draw_without_replacement, free_name, own_columns, stored

#: Rows of a range of (shard, slot), about: larger shards are several ranges.
PIECE_ROWS = 200_000


def communication_matrix(rows: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Counts [partition, shard]: row sums are ``rows``, column sums differ by one at most."""
    total = sum(rows)
    left = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)], dtype=np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(rows), n_shards), dtype=np.int64)
    for p, n in enumerate(rows):
        out[p] = draw_without_replacement(rng, left, n)
        left -= out[p]
    return out


#: So many that also small permutations are even.
ROUNDS = 12


def permuted(places: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Where a seeded permutation of 0 .. size - 1 sends each place: ROUNDS Feistel rounds over the smallest square of a power of two
    that holds the size, again and again while a place is beyond it. Any place is found without making the permutation."""
    known, which = np.unique(sizes, return_inverse=True)
    half = np.array([(max(int(n) - 1, 1).bit_length() + 1) // 2 for n in known], dtype=np.uint64)[which]
    low = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = places.astype(np.uint64), np.arange(len(places))
    while len(open_):
        x, h, m, s = out[open_], half[open_], low[open_], seeds[open_].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(ROUNDS):
            left, right = right, left ^ (_mixed(right ^ _mixed(s ^ np.uint64(r << 32))) & m)
        out[open_] = (left << h) | right
        open_ = open_[out[open_] >= sizes[open_].astype(np.uint64)]
    return out.astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """All rows and columns of ``df`` (but clashing ones) plus shard (0 .. n_shards - 1) and slot (gapless from 0 in each shard), in the order of both.

    Rows are numbered as they are stored, once. A row's place in its partition is permuted; the matrix says which shard that
    place goes to and at which place of the shard it arrives, which is permuted again to its slot. Only these numbers are worked
    on; the rows themselves go through the one exchange into ranges of (shard, slot). Nulls, ties and repeated rows are dealt like
    all others. An empty table gives an empty result. Input columns named shard or slot, in any case, are replaced.
    """
    df = df.drop("shard", "slot")
    spark, pid, rid = df.sparkSession, free_name(df, "__pid"), free_name(df, "__rid")
    rows = stored(df.withColumn(pid, F.spark_partition_id()).withColumn(rid, F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in rows.groupBy(pid).count().collect()}  # a number per input partition
    pids = np.array(sorted(counts), dtype=np.int64)
    matrix = communication_matrix([counts[p] for p in pids.tolist()], n_shards, seed)
    ends, starts, totals = np.cumsum(matrix, axis=1), np.cumsum(matrix, axis=0) - matrix, matrix.sum(axis=0)
    shared = spark.sparkContext.broadcast((pids, matrix, ends, starts, totals))  # n_shards numbers per input partition

    @F.pandas_udf("shard int, slot long")
    def place(of: pd.Series, row: pd.Series) -> pd.DataFrame:
        pids, matrix, ends, starts, totals = shared.value
        p = np.searchsorted(pids, of.to_numpy())
        at = permuted(row.to_numpy() & ((1 << 33) - 1), ends[:, -1][p], _mixed(p.astype(np.uint64) * np.uint64(2) + np.uint64(seed)))
        shard = np.zeros(len(p), dtype=np.int64)
        for k in np.unique(p):
            shard[p == k] = np.searchsorted(ends[k], at[p == k], side="right")
        arrived = starts[p, shard] + at - (ends[p, shard] - matrix[p, shard])
        slot = permuted(arrived, totals[shard], _mixed(shard.astype(np.uint64) * np.uint64(2) + np.uint64(seed + 1)))
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    to = free_name(df, "__to")
    dealt = rows.withColumn(to, place(pid, rid)).select(*own_columns(df), F.col(f"{to}.shard").alias("shard"), F.col(f"{to}.slot").alias("slot"))
    tasks = max(n_shards, -(-sum(counts.values()) // PIECE_ROWS))
    return dealt.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot")


def write_shards(df: DataFrame, n_shards: int, path: str, seed: int = 17) -> None:
    """Shard ``df`` and write one folder a shard, rows in the order of their slots within and across its files. A large shard is written by several tasks."""
    shuffle_into_shards(df, n_shards, seed).write.mode("overwrite").partitionBy("shard").parquet(path)
