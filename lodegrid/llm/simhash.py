"""Near-duplicates by SimHash, linked by tiled exact comparison.

Distinct fingerprints are sorted by population count (of the whole fingerprint, then of its four
16-bit words) and cut into tiles. A pair of tiles is skipped if their population counts differ
by more than the radius: each differing bit changes the count by one. Within a pair of tiles the
same bound holds for the four words together, so only cells whose word counts differ by no more
than the radius in sum are compared, by numpy exclusive-or and bit counts. A pair of tiles returns
a spanning forest of its links, never all pairs of a group; components are then the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.llm.common import give_back, lookup, numbered, own_columns, short_batches, slices, stored
from lodegrid.llm.graph import components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
TILE_ROWS = 65_536
LEAST_TILES = 12
MOST_TASKS = 5000
#: Hashes whose bits are unpacked at once.
UNPACKED = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64 bits, each set if it is set in over half the shingle hashes; 0 without words.

    Words are what stands between ASCII white space; only A-Z are lower-cased. A text with fewer
    words than a shingle has its whole sequence as one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, for both
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begin = np.concatenate([[0], ends[: n - 1]]).tolist()
    end = (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, n, UNPACKED):
        counts += np.unpackbits(hashes[k : k + UNPACKED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The columns of ``docs`` but text, and fp (the 64 bits of its text as a signed long), one row per input row."""
    short_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text"]
    slim = docs.select(*kept, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values = np.array([fingerprint(t.as_py(), shingle_words) for t in part.column(len(kept))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(values)], [*kept, "fp"])
        give_back()

    return slim.mapInArrow(run, T.StructType([*[f for f in slim.schema.fields if f.name != "text"], T.StructField("fp", T.LongType())]))


def _words(fp) -> list:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]


def _tiles(distinct: DataFrame, tile_rows: int, radius: int) -> tuple[DataFrame, int]:
    """(rows, number of tile pairs); rows are fp, tile, low, high: the tiles low .. high have population counts within the radius of the tile's.

    Cells of equal word counts (at most 17 ** 4, whatever the input) are laid out in sorted order and
    cut into tiles; a cell larger than a tile is spread by hash.
    """
    cells = distinct.withColumn("words", F.array(*_words(F.col("fp")))).withColumn("cell", F.expr("((words[0] * 17 + words[1]) * 17 + words[2]) * 17 + words[3]").cast("int"))
    sizes = cells.groupBy("cell").count().collect()
    total = sum(r["count"] for r in sizes)
    tile_rows = max(1, min(tile_rows, -(-total // LEAST_TILES)))
    bits = lambda cell: cell % 17 + cell // 17 % 17 + cell // 289 % 17 + cell // 4913
    layout, tiles, filled = [], [], 0
    for population, cell, n in sorted((bits(r["cell"]), r["cell"], r["count"]) for r in sizes):
        parts = -(-n // tile_rows)
        if not tiles or parts > 1 or filled + n > tile_rows:
            tiles += [[population, population] for _ in range(parts)]
            filled = 0
        tiles[-1][1] = population
        filled += n // parts
        layout.append((cell, len(tiles) - parts, parts))
    reach, first, last = [], 0, 0
    for t, (least, most) in enumerate(tiles):
        while tiles[first][1] < least - radius:
            first += 1
        while last + 1 < len(tiles) and tiles[last + 1][0] <= most + radius:
            last += 1
        reach.append((t, first, last))
    spark = distinct.sparkSession
    where = F.broadcast(spark.createDataFrame(layout, "cell int, first int, parts int"))
    near = spark.createDataFrame(reach, "tile int, low int, high int")
    tiled = cells.join(where, "cell").withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int"))
    return tiled.join(near, "tile").select("fp", "tile", "low", "high"), sum(1 + last - t for t, _, last in reach)


def _within(fps: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of two tiles (side 0 and 1), or within one tile (all 0), as a spanning forest."""
    word = np.stack([np.bitwise_count((fps >> np.uint64(16 * k)) & np.uint64(0xFFFF)) for k in range(4)], axis=1).astype(np.int16)
    code = ((word[:, 0].astype(np.int64) * 17 + word[:, 1]) * 17 + word[:, 2]) * 17 + word[:, 3]
    order = np.lexsort((code, side))
    fps, side, code, word = fps[order], side[order], code[order], word[order]
    start = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (side[1:] != side[:-1])]))
    end, counts, sides = np.append(start[1:], len(fps)), word[start], side[start]
    both = sides.any()
    right = np.flatnonzero(sides == 1) if both else np.arange(len(start))
    label = np.arange(len(fps))
    for c in np.flatnonzero(sides == 0):
        near = right[np.abs(counts[right] - counts[c]).sum(axis=1) <= radius]
        if not both:
            near = near[near >= c]
        if not len(near):
            continue
        columns = np.concatenate([np.arange(start[k], end[k]) for k in near])
        width = max(1, (1 << 20) // len(columns))
        for r in range(start[c], end[c], width):
            rows = np.arange(r, min(r + width, end[c]))
            i, j = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[columns][None, :]) <= radius)
            i, j = rows[i], columns[j]
            _unite(label, i[i != j], j[i != j])
    tied = np.flatnonzero(label != np.arange(len(fps)))
    return fps[tied], fps[label[tied]]


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give both ends of each link, and all that carry their labels, the smallest of the labels."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(label, high, low)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label[:] = nxt


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links."""
    tiled, n_pairs = _tiles(distinct, tile_rows, radius)
    pairs = tiled.withColumn("other", F.explode(F.sequence("low", "high"))).select("fp", "tile", F.least("tile", "other").alias("t0"), F.greatest("tile", "other").alias("t1"))
    pairs = pairs.repartition(max(1, min(n_pairs, MOST_TASKS)), "t0", "t1")  # little data and much work: not to be coalesced

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy().view(np.uint64)
        side = (pdf["tile"] != pdf["t0"]).to_numpy().astype(np.int8)
        a, b = _within(fps, side, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return pairs.groupBy("t0", "t1").applyInPandas(compare, "a long, b long")


def _linked(docs: DataFrame, columns: list[str], id_col: str, text_col: str, radius: int, shingle_words: int) -> DataFrame:
    """fp, ``columns`` of docs, component_id and component_size, a row per input row."""
    rows = stored(fingerprints(docs.select(*columns, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), shingle_words))
    total = max(1, rows.count())
    distinct = stored(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    roots = components(stored(link_fingerprints(distinct.select("fp"), radius)))
    member = stored(distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    whole = stored(member.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"), F.count("*").alias("__members")))
    member = lookup(member, whole, ["root"], "__members", max(1, member.count()))
    return lookup(rows, stored(member.select("fp", "n", "root", "component_id", "component_size")), ["fp"], "n", total)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), component_size.

    Null and empty texts, and texts of white space only, have the fingerprint 0 and are linked like
    any other. Null doc_ids keep their rows and count only where a component has no other id; then
    component_id is null. Repeated rows share their component. Columns but the two named are not read.
    """
    out = _linked(docs, [], id_col, text_col, radius, shingle_words)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id (null ids last), of several such rows the first.

    Rows are told apart by number, so rows that share an id go only with their own component.
    """
    rows, rid = numbered(docs)
    slim = rows.select(F.col(rid).alias("rid"), *[c.alias(name) for c, name in zip(own_columns(rows, [id_col, text_col]), ("doc_id", "text"), strict=True)])
    linked = stored(_linked(slim, ["rid"], "doc_id", "text", RADIUS, SHINGLE_WORDS).select("rid", "root", "doc_id"))
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid").alias("rid"))).alias("first"))
    kept = stored(first.select(F.col("first.rid").alias(rid))).hint("merge")  # the same plan at every size
    return rows.join(kept, rid, "left_semi").select(*own_columns(docs))
