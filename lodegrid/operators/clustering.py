"""Complete-linkage clusters under a distance threshold, and the edits people make to clusters."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.operators.state import dropped
from lodegrid.session import scratch, short_batches

log = logging.getLogger(__name__)


def complete_linkage(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Labels (the least row of the cluster) by nearest-neighbour chains over cosine distances; merges at or above the threshold don't happen."""
    n = len(vectors)
    unit = vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-300)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    label, alive, chain, merges = np.arange(n), np.ones(n, dtype=bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        row = np.where(alive, d[a], np.inf)
        b = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            low, high = min(a, b), max(a, b)
            merges.append((float(d[low, high]), low, high))
            d[low] = np.maximum(d[low], d[high])
            d[:, low] = d[low]
            d[low, low] = np.inf
            alive[high] = False
        elif row[b] >= threshold:
            alive[a] = False  # nothing is near enough, and distances to merged clusters only grow
            chain = []
        else:
            chain.append(b)
    for distance, low, high in merges:
        if distance < threshold:
            label[label == high] = low
    return label


#: Rows of a block, at most: its distances take 8 bytes for each pair.
MOST_BLOCK = 15_000


#: Removes what a query has shuffled once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _kept(df: DataFrame, path: str | None = None) -> DataFrame:
    """Written and read again; what was shuffled for it goes at once and not when the driver next collects garbage."""
    spark, path = df.sparkSession, path or scratch(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clusters(df: DataFrame, block: str, item: str, vector: str, threshold: float = 0.35) -> DataFrame:
    """block, item, cluster (its least item): exact within each block. A block's distances need memory of the square of its rows, so a block of more than MOST_BLOCK fails the job; ``clusters_of_all`` has a way for these."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_BLOCK:
            raise ValueError(f"block {pdf['block'].iloc[0]} has {len(pdf)} rows; complete linkage takes {MOST_BLOCK} at most")
        pdf = pdf.sort_values("item", kind="stable").reset_index(drop=True)
        label = complete_linkage(np.stack(pdf["v"].to_numpy()).astype(float), threshold)
        return pd.DataFrame({"block": pdf["block"], "item": pdf["item"], "cluster": pdf["item"].to_numpy()[label]})

    rows = df.filter(F.col(vector).isNotNull()).select(F.col(block).alias("block"), F.col(item).alias("item"), F.col(vector).alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy("block").applyInPandas(run, f"block {kinds['block']}, item {kinds['item']}, cluster {kinds['item']}")


#: Rows of a tile, about: two of them are compared by one matrix product.
TILE_ROWS = 4096
#: Neighbouring tiles go to tasks in groups, as each row is sent once for each group it is compared with. So many groups are enough for
#: many tasks; a group has GROUP_BYTES of vectors and MOST_TILES (bits of a long) at most.
GROUPS, GROUP_BYTES, MOST_TILES = 24, 16 << 20, 60
#: Vectors whose angles to all others tell which tiles can hold near pairs. Their number doesn't grow with the rows.
PIVOTS = 24
#: Angles come from arccosines, which near 0 are this exact.
ANGLE_ROUNDING = 1e-6


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the least row that the links i, j connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-300)


def tiled(rows: DataFrame, threshold: float, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows item, v with their tile; tile, others: the tiles that may hold a vector nearer than the threshold to one of its own).

    Vectors go to the pivot of the smallest angle and, within its cell, into tiles by ranges of that angle. Angles on the unit
    sphere keep the triangle inequality: where the angles of two tiles to any pivot are farther apart than the threshold's angle,
    no pair of theirs can be near, and the tiles aren't compared. Nothing else is left out.
    """
    spark = rows.sparkSession
    if rows.limit(tile_rows + 1).count() <= tile_rows:  # one tile has nothing to be ruled out
        one = rows.withColumn("tile", F.lit(0).cast("long"))
        return one, one.select("tile").distinct().withColumn("others", F.array(F.lit(0).cast("long")))
    reach = float(np.arccos(np.clip(1 - threshold, -1, 1))) + ANGLE_ROUNDING
    pivots = rows.filter(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64(F.lit(17), "item"), "item").limit(PIVOTS).collect()
    if not pivots:
        one = rows.withColumn("tile", F.lit(0).cast("long"))
        return one, one.select("tile").distinct().withColumn("others", F.array(F.lit(0).cast("long")))
    centres = spark.sparkContext.broadcast(_unit(np.array([r["v"] for r in pivots], dtype=float)))  # PIVOTS vectors

    def angles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy()).astype(float)
                to = np.arccos(np.clip(_unit(v) @ centres.value.T, -1, 1))
                zero = ~v.any(axis=1)  # a vector without direction is in no cell
                near = to.argmin(axis=1)
                yield pdf.assign(cell=np.where(zero, -1, near), near=np.where(zero, 0.0, to[np.arange(len(v)), near]), to=list(to))

    kind, vectors = (rows.schema[c].dataType.simpleString() for c in ("item", "v"))
    placed = _kept(rows.mapInPandas(angles, f"item {kind}, v {vectors}, cell int, near double, to array<double>"))
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    most = max(1, -(-max(sizes.values(), default=1) // tile_rows))
    cuts = placed.groupBy("cell").agg(F.percentile_approx("near", [float(k + 1) / most for k in range(most)], 100 * most).alias("cuts"), F.count("*").alias("n"))
    # Of the cuts of the largest cell's fineness each cell uses as many as its own size asks for.
    step = F.greatest(F.lit(1), F.floor(F.lit(most) * tile_rows / F.col("n")))
    used = cuts.select("cell", F.filter(F.transform("cuts", lambda c, k: F.when((k + 1) % step == 0, c)), lambda c: c.isNotNull()).alias("cuts"))
    ranged = placed.join(F.broadcast(used), "cell").withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("near")))).drop("cuts")
    # Equal angles can't be cut: a range that is too large is dealt out by hash.
    parts = ranged.groupBy("cell", "range").agg(F.ceil(F.count("*") / (2 * tile_rows)).alias("parts"))
    dealt = ranged.join(F.broadcast(parts), ["cell", "range"]).withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")))
    # The order of tiles is that of cells and ranges: neighbours have names next to each other.
    dealt = _kept(dealt.withColumn("tile", F.shiftleft((F.col("cell") + 1).cast("long"), 56) + F.shiftleft(F.col("range").cast("long"), 28) + F.col("part")))
    low, high = ([f(F.col("to")[k]) for k in range(len(pivots))] for f in (F.min, F.max))
    bounds = _kept(dealt.groupBy("tile").agg(F.max(F.col("cell") < 0).alias("free"), F.array(*low).alias("low"), F.array(*high).alias("high")))
    facts = bounds.collect()  # PIVOTS intervals for each TILE_ROWS vectors
    names = np.array([r["tile"] for r in facts], dtype=np.int64)
    lows, highs = (np.array([r[c] for r in facts]) for c in ("low", "high"))
    free = np.array([r["free"] for r in facts])
    lows[free], highs[free] = 0.0, np.pi
    shared = spark.sparkContext.broadcast((names, lows, highs))

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, lows, highs = shared.value
        for pdf in batches:
            others = []
            for t in pdf["tile"]:
                k = int(np.flatnonzero(names == t)[0])
                gap = np.maximum(lows - highs[k], lows[k] - highs).max(axis=1)
                others.append(names[gap < reach].tolist())
            yield pdf.assign(others=others)

    return dealt.select("item", "v", "tile"), bounds.select("tile").mapInPandas(partners, "tile long, others array<long>")


def _vectors(df: DataFrame, item: str, vector: str) -> DataFrame:
    """item, v of rows with a vector; single precision stays so until it is compared, as that halves what is sent."""
    kind = df.schema[vector].dataType.simpleString()
    v = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    return df.filter(F.col(vector).isNotNull()).select(F.col(item).alias("item"), v.alias("v"))


def _near_tiles(df: DataFrame, item: str, vector: str, threshold: float, tile_rows: int) -> tuple[DataFrame, str]:
    """(item, v, tile (its group), at (its tile in the group), near (bits: the tiles of the other group that it is compared with), t0, t1: each row once for each pair of groups; the type of items)."""
    rows = _vectors(df, item, vector)
    short_batches(rows.sparkSession)
    placed, others = tiled(rows, threshold, tile_rows)
    others = _kept(others)
    tiles = sorted(r["tile"] for r in others.select("tile").collect())
    dims = placed.agg(F.max(F.size("v"))).first()[0] or 1
    each = max(1, min(-(-len(tiles) // GROUPS), MOST_TILES, GROUP_BYTES // (8 * dims * tile_rows)))
    groups = rows.sparkSession.createDataFrame([(t, k // each, k % each) for k, t in enumerate(tiles)], "tile long, group int, at int")  # a row a tile
    other = groups.select(F.col("tile").alias("other"), F.col("group").alias("with"), F.expr("shiftleft(1L, at)").alias("bit"))
    ends = others.withColumn("other", F.explode("others")).join(other, "other").groupBy("tile", "with").agg(F.bit_or("bit").alias("near"))
    ends = _kept(ends.join(groups, "tile"))
    n_ends, n_pairs = ends.agg(F.coalesce(F.sum(F.bit_count("near")), F.lit(0)), F.count_if(F.col("group") <= F.col("with"))).first()
    log.info("complete linkage compares %d of %d pairs of tiles", (n_ends + len(tiles)) // 2, len(tiles) * (len(tiles) + 1) // 2)
    pairs = placed.join(ends, "tile").select("item", "v", F.col("group").alias("tile"), "at", "near", F.least("group", "with").alias("t0"), F.greatest("group", "with").alias("t1"))
    return pairs.repartition(max(1, min(5000, n_pairs)), "t0", "t1").sortWithinPartitions("t0", "t1"), rows.schema["item"].dataType.simpleString()


def _by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pd.DataFrame]]:
    """(items, rows as ``_close`` takes them) of each pair of groups, from batches in order of pairs."""
    parts, key = [], None
    for batch in batches:
        t0, t1 = batch["t0"].to_numpy(), batch["t1"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (t0[1:] != t0[:-1]) | (t1[1:] != t1[:-1])]) if len(t0) else []
        for start, end in zip(starts, [*starts[1:], len(t0)], strict=True):
            if parts and key != (t0[start], t1[start]):
                yield _joined(parts)
                parts = []
            key = t0[start], t1[start]
            parts.append(batch.slice(start, end - start))
    if parts:
        yield _joined(parts)


def _joined(parts: list[pa.RecordBatch]) -> tuple[pa.Array, pd.DataFrame]:
    v = [x for b in parts for x in b["v"].to_numpy(zero_copy_only=False)]
    return pa.concat_arrays([b["item"] for b in parts]), pd.DataFrame({"v": v, **{c: np.concatenate([b[c].to_numpy() for b in parts]) for c in ("tile", "at", "near", "t0", "t1")}})


def _close(pdf: pd.DataFrame, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the near pairs of a pair of tiles, or of one tile, some rows at a time; each pair once, and never two rows of one of two tiles.

    With ``at`` and ``near`` (``_near_tiles``) the same of two groups of tiles, or of one: only tiles that ``near`` names are compared.
    """
    unit = _unit(np.stack(pdf["v"].to_numpy()).astype(float))
    first = (pdf["tile"] == pdf["t0"]).to_numpy()
    both = not first.all()
    rows, others = (np.flatnonzero(first), np.flatnonzero(~first)) if both else (np.arange(len(unit)),) * 2
    at, near = (pdf[c].to_numpy() if c in pdf else np.full(len(pdf), x) for c, x in (("at", 0), ("near", 1)))
    for p in np.unique(at[rows]):
        mine = rows[at[rows] == p]
        left = unit[mine]
        for q in np.unique(at[others]):
            if not int(near[mine[0]]) >> int(q) & 1 or not both and q < p:
                continue
            theirs = others[at[others] == q]
            right, one = unit[theirs], not both and p == q
            for k in range(0, len(left), 512):
                start = k if one else 0  # within one tile only what comes later
                d = left[k : k + 512] @ right[start:].T
                np.subtract(1, d, out=d)
                i, j = np.divmod(np.flatnonzero(d.ravel() < threshold), d.shape[1])
                if one:
                    later = i < j
                    i, j = i[later], j[later]
                yield mine[i + k], theirs[j + start], d[i, j]


#: Pairs that a task holds or hands on at once, about.
PAIRS_AT_ONCE = 250_000


def _some(found: Iterator[tuple[np.ndarray, ...]], most: int) -> Iterator[list[np.ndarray]]:
    """Arrays joined until they have so many entries."""
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n >= most:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def near_links(df: DataFrame, item: str, vector: str, threshold: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """a, b: links whose components are those of all pairs with a cosine distance below the threshold.

    Pairs of tiles that can hold such a pair (``tiled``) are compared as a whole. No task holds more than two groups of tiles, and
    a pair of groups returns a link a row at most.
    """
    pairs, kind = _near_tiles(df, item, vector, threshold, tile_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for items, pdf in _by_pair(batches):
            label = rows = np.arange(len(pdf))
            for i, j, _ in _some(_close(pdf, threshold), 16 * PAIRS_AT_ONCE):
                tied = np.flatnonzero(label != rows)
                label = _forest(np.concatenate([i, tied]), np.concatenate([j, label[tied]]), len(pdf))
            tied = np.flatnonzero(label != rows)
            yield pa.RecordBatch.from_arrays([items.take(pa.array(tied)), items.take(pa.array(label[tied]))], ["a", "b"])

    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def near_pairs(df: DataFrame, item: str, vector: str, threshold: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """a < b, distance: all pairs with a cosine distance below the threshold."""
    pairs, kind = _near_tiles(df, item, vector, threshold, tile_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for items, pdf in _by_pair(batches):
            names = items.to_numpy(zero_copy_only=False)
            for i, j, d in _some(_close(pdf, threshold), PAIRS_AT_ONCE):
                low, high = np.minimum(names[i], names[j]), np.maximum(names[i], names[j])
                yield pa.RecordBatch.from_arrays([pa.array(low, items.type), pa.array(high, items.type), pa.array(d)], ["a", "b", "distance"])

    return pairs.mapInArrow(run, f"a {kind}, b {kind}, distance double")


#: Rows whose near rows are counted to tell how many pairs there will be, and pairs a row up to which all pairs are stored at once.
COUNTED, PAIRS_A_ROW = 256, 500


def expected_pairs(rows: DataFrame, threshold: float) -> float:
    """About how many pairs of rows (item, v) are nearer than the threshold, from COUNTED rows against all. It chooses a way, no result depends on it."""
    some = rows.orderBy(F.xxhash64(F.lit(19), "item"), "item").limit(COUNTED).collect()
    if not some:
        return 0.0
    given = rows.sparkSession.sparkContext.broadcast(_unit(np.array([r["v"] for r in some], dtype=float)))  # COUNTED vectors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"rows": [len(pdf)], "near": [int((1 - _unit(np.stack(pdf["v"].to_numpy()).astype(float)) @ given.value.T < threshold).sum())]})

    n, near = rows.select("v").mapInPandas(run, "rows long, near long").agg(F.sum("rows"), F.sum("near")).first()
    return max(0, near - len(some)) * n / (2 * len(some))


def connected(links: DataFrame) -> DataFrame:
    """item, component: the least item reachable, for each item of the links (a, b). Each round takes the least label around and then the label's label."""
    both = links.select(F.col("a").alias("item"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("item"), F.col("a").alias("near")))
    both = _kept(both.distinct())
    label = _kept(both.groupBy("item").agg(F.least(F.min("near"), F.first("item")).alias("component")))
    while True:
        around = both.join(label.select(F.col("item").alias("near"), "component"), "near").groupBy("item").agg(F.min("component").alias("around"))
        lower = label.join(around, "item").select("item", F.col("component").alias("was"), F.least("component", "around").alias("component"))
        further = lower.select(F.col("item").alias("component"), F.col("component").alias("further"))
        new = _kept(lower.join(further, "component").select("item", "was", F.col("further").alias("component")))
        label = new.select("item", "component")
        if new.filter("component != was").isEmpty():
            return label


#: Pairs of clusters from which on one task does the rest, with about 100 bytes a pair.
EDGES_IN_ONE = 1_000_000
#: Pairs of clusters that a task holds at once to find each one's nearest among them.
EDGES_AT_ONCE = 500_000
#: Merges of a round up to which their names are broadcast.
MOST_MERGES = 1_000_000


def _first_links(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the place of its least (d, a, b); nodes without an edge have none."""
    order = np.lexsort((b, a, d))
    rank = np.empty(len(a), dtype=np.int64)
    rank[order] = np.arange(len(a))
    best = np.full(n, len(a))
    np.minimum.at(best, a, rank)
    np.minimum.at(best, b, rank)
    return np.append(order, -1)[best]


def _merged(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes its cluster, its least node: the rounds of ``linked_by_rounds`` over edges that one task holds."""
    cluster = np.arange(n)
    while len(a):
        best = _first_links(a, b, d, n)
        at = np.arange(len(a))
        mutual = (best[a] == at) & (best[b] == at)
        into, parts = np.arange(n), np.ones(n, dtype=np.int64)
        into[b[mutual]], parts[a[mutual]] = a[mutual], 2
        cluster = into[cluster]
        a, b, d = into[a[~mutual]], into[b[~mutual]], d[~mutual]
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((d, b, a))
        a, b, d = a[order], b[order], d[order]
        last = np.flatnonzero(np.append((a[1:] != a[:-1]) | (b[1:] != b[:-1]), True)) if len(a) else np.zeros(0, dtype=np.int64)  # the largest distance
        whole = np.diff(last, prepend=-1) == parts[a[last]] * parts[b[last]]
        a, b, d = a[last][whole], b[last][whole], d[last][whole]
    return cluster


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together until they have so many rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _numbered(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """names in order, and the edges a, b, d of batches with places among them."""
    a, b, d = (np.concatenate([x[c].to_numpy(zero_copy_only=False) for x in batches]) for c in ("a", "b", "d"))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return names, at[: len(a)], at[len(a) :], d


def linked_by_rounds(pairs: DataFrame) -> DataFrame:
    """item, cluster (its least item) by complete linkage from all pairs below the threshold (a < b, distance), for any number of rows.

    In each round all pairs of clusters that are each other's nearest (ties to the least names) are merged: complete linkage is
    reducible, so no merge can bring two others nearer, and the rounds end where one merge after the other would. The distance of
    merged clusters is the largest of their parts'; a pair of clusters stays a pair only if all of its parts have one. Only pairs
    of clusters that a round has merged are shuffled, and what a round has written goes when the next one is. The last
    EDGES_IN_ONE pairs are merged in one task, by the same rounds.
    """
    spark, kind = pairs.sparkSession, pairs.schema["a"].dataType.simpleString()
    short_batches(spark)
    paths = [scratch(spark), scratch(spark)]
    edges = _kept(pairs.select("a", "b", F.col("distance").alias("d")), paths[0])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest of each node among the edges that a task holds at once."""
        for held in _held(batches, EDGES_AT_ONCE):
            names, a, b, d = _numbered(held)
            best, kind = _first_links(a, b, d, len(names)), held[0]["a"].type
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(d[best]), pa.array(names[a[best]], kind), pa.array(names[b[best]], kind)], ["node", "d", "a", "b"])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, EDGES_AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(_numbered(held)[0], held[0]["a"].type)], ["item"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            names, a, b, d = _numbered(held)
            cluster = _merged(a, b, d, len(names))
            gone = np.flatnonzero(cluster != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[x], held[0]["a"].type) for x in (gone, cluster[gone])], ["old", "new"])

    def renamed(label: DataFrame, into: DataFrame) -> DataFrame:
        return label.join(into, F.col("cluster") == F.col("old"), "left").select("item", F.coalesce("new", "cluster").alias("cluster"))

    label = _kept(edges.mapInArrow(nodes, f"item {kind}").distinct().withColumn("cluster", F.col("item")), paths[1])
    while edges.count() > EDGES_IN_ONE:
        link = F.struct("d", "a", "b")
        first = edges.mapInArrow(nearest, f"node {kind}, d double, a {kind}, b {kind}").groupBy("node").agg(F.min(link).alias("link"))
        held = [scratch(spark) for _ in range(4)]
        merged = _kept(first.groupBy("link").agg(F.count("*").alias("ends")).filter("ends = 2").select("link.a", "link.b"), held[0])
        few = merged.count() <= MOST_MERGES
        fate = merged.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("name"))
        moved = edges
        for end in ("a", "b"):
            to = fate.select(F.col("node").alias(f"{end}_node"), F.col("name").alias(f"{end}_name"))
            moved = moved.join(F.broadcast(to) if few else to, F.col(end) == F.col(f"{end}_node"), "left").drop(f"{end}_node")
        moved = moved if few else _kept(moved, held[1])
        still = F.col("a_name").isNull() & F.col("b_name").isNull()
        x, y = F.coalesce("a_name", "a"), F.coalesce("b_name", "b")
        parts = (1 + F.col("a_name").isNotNull().cast("int")) * (1 + F.col("b_name").isNotNull().cast("int"))
        touched = moved.filter(~still).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "d", parts.alias("parts")).filter("a != b")
        touched = touched.groupBy("a", "b").agg(F.max("d").alias("d"), F.count("*").alias("n"), F.max("parts").alias("parts")).filter("n = parts")
        edges = _kept(moved.filter(still).select("a", "b", "d").unionByName(touched.select("a", "b", "d")), held[2])
        label = _kept(renamed(label, merged.select(F.col("b").alias("old"), F.col("a").alias("new"))), held[3])
        for path in (*paths, *held[:2]):
            dropped(spark, path)
        paths = held[2:]
    return renamed(label, edges.coalesce(1).mapInArrow(rest, f"old {kind}, new {kind}"))


def clusters_of_all(df: DataFrame, item: str, vector: str, threshold: float = 0.35, tile_rows: int = TILE_ROWS) -> DataFrame:
    """item, cluster (its least item) by complete linkage over all rows with a vector; items are unique.

    Equal vectors are one, whose cluster all share. Where few pairs are below the threshold (``expected_pairs``), they are found
    and stored once, and merged by rounds. Else no cluster reaches over two components of these pairs, so each component is
    clustered apart, exactly: one of up to MOST_BLOCK rows in one task, a larger one by rounds over all executors.
    """
    all_ = _vectors(df, item, vector)
    same = _kept(all_.groupBy("v").agg(F.min("item").alias("first"), F.count("*").alias("n")))
    rows = same.select(F.col("first").alias("item"), "v")
    if expected_pairs(rows, threshold) <= PAIRS_A_ROW * rows.count():
        found = linked_by_rounds(near_pairs(rows, "item", "v", threshold, tile_rows))
    else:
        component = _kept(connected(near_links(rows, "item", "v", threshold, tile_rows)))
        sizes = component.groupBy("component").agg(F.count("*").alias("n"))
        large = _kept(sizes.filter(F.col("n") > MOST_BLOCK).select("component"))
        found = clusters(rows.join(component.join(large, "component", "left_anti"), "item"), "component", "item", "v", threshold).select("item", "cluster")
        if not large.isEmpty():
            held = rows.join(component.join(large, "component"), "item").select("item", "v")
            found = found.unionByName(linked_by_rounds(near_pairs(held, "item", "v", threshold, tile_rows)))
    out = rows.select("item").join(found, "item", "left").select("item", F.coalesce("cluster", "item").alias("cluster"))
    repeated = all_.join(same.filter("n > 1"), "v").filter(F.col("item") != F.col("first")).select("item", "first")
    return out.unionByName(repeated.join(out.withColumnRenamed("item", "first"), "first").select("item", "cluster"))


def members(assigned: DataFrame, cluster: str, item: str, extra: str | None = None) -> DataFrame:
    """cluster, size, items (sorted) and, in the order of items, the distinct values of another column."""
    out = [F.count("*").alias("size"), F.sort_array(F.collect_set(item)).alias("items")]
    if extra:
        out.append(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(item, extra))), lambda x: x[extra])).alias(f"{extra}s"))
    return assigned.groupBy(cluster).agg(*out)


def folded(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The last event of each key: the state that an event log leaves. Combines on the map side."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), seq).alias("e")).select(key, "e.*")


# What ends the life of a cluster.
TERMINAL = ("split", "merged")


def edited(clusters_: DataFrame, events: DataFrame) -> DataFrame:
    """Clusters (cluster_id, label) with status, label and target after events (seq, cluster_id, action, target, label).

    Merging into a cluster that was split or merged before is refused. approve, rename and reopen set
    approved, the label, and pending; split and merge are final.
    """
    ends = events.filter(F.col("action").isin("split", "merge")).groupBy("cluster_id").agg(F.min("seq").alias("ended_at"))
    valid = events.join(ends.select(F.col("cluster_id").alias("target"), F.col("ended_at").alias("target_ended")), "target", "left")
    valid = valid.filter((F.col("action") != "merge") | F.col("target_ended").isNull() | (F.col("target_ended") > F.col("seq")))
    stop = valid.filter(F.col("action").isin("split", "merge")).groupBy("cluster_id").agg(F.min(F.struct("seq", "action", "target")).alias("stop"))
    before = valid.join(stop, "cluster_id", "left").filter(F.col("stop").isNull() | (F.col("seq") < F.col("stop.seq")))
    state = before.filter(F.col("action").isin("approve", "reopen", "rename")).groupBy("cluster_id").agg(
        F.max_by(F.when(F.col("action") == "reopen", "pending").otherwise("approved"), "seq").alias("state"), F.max_by("label", F.when(F.col("action") == "rename", F.col("seq"))).alias("renamed")
    )
    out = clusters_.join(state, "cluster_id", "left").join(stop, "cluster_id", "left")
    status = F.when(F.col("stop.action") == "split", "split").when(F.col("stop.action") == "merge", "merged").otherwise(F.coalesce("state", F.lit("pending")))
    return out.select("cluster_id", F.coalesce("renamed", "label").alias("label"), status.alias("status"), F.when(F.col("stop.action") == "merge", F.col("stop.target")).alias("target"))


def emitted(state: DataFrame) -> DataFrame:
    """cluster_id, label of live clusters; of equal labels the first keeps it, the others get their id behind."""
    live = state.filter(~F.col("status").isin(*TERMINAL) & (F.col("status") != "pending"))
    n = F.row_number().over(Window.partitionBy(F.lower("label")).orderBy("cluster_id"))
    return live.withColumn("n", n).select("cluster_id", F.when(F.col("n") == 1, F.col("label")).otherwise(F.format_string("%s (%s)", "label", F.col("cluster_id").cast("string"))).alias("label"))


# Labels that say nothing, and words that don't make one.
VAGUE = (
    "general", "other", "misc", "miscellaneous", "uncategorized", "uncategorised", "general usage", "general pattern", "general interaction",
    "various", "mixed", "usage", "pattern", "unlabeled", "unlabelled",
)
STOP_WORDS = ("with", "using", "from", "this", "that", "when", "into", "such", "about", "what", "code", "user")


def is_well_formed(label: Column) -> Column:
    """Two to five words that aren't vague."""
    words = F.filter(F.split(F.trim(F.coalesce(label, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.size(words).between(2, 5) & ~F.lower(F.trim(label)).isin(*VAGUE)


def fallback_labels(texts: DataFrame, cluster: str, text: str, order: str) -> DataFrame:
    """cluster, label: its three most common words of four letters or more, first come first among equals.

    With fewer than two such words the first three words of its first text; with fewer than two of these, "Unlabeled Cluster".
    """
    words = texts.select(cluster, F.posexplode(F.split(F.lower(text), r"[\s\-_/]+")).alias("at", "word"), F.col(order).alias("o"))
    words = words.filter(F.col("word").rlike(r"^\p{L}{4,}$") & ~F.col("word").isin(*STOP_WORDS))
    counts = words.groupBy(cluster, "word").agg(F.count("*").alias("n"), F.min(F.struct("o", "at")).alias("first"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), "first"))).filter("k <= 3")
    common = top.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("common"))
    first = texts.groupBy(cluster).agg(F.slice(F.split(F.trim(F.coalesce(F.min_by(text, order), F.lit(""))), r"\s+"), 1, 3).alias("begin"))
    chosen = F.when(F.size("common") >= 2, F.col("common")).when(F.size(F.filter("begin", lambda w: w != "")) >= 2, F.col("begin")).otherwise(F.array(F.lit("Unlabeled"), F.lit("Cluster")))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    return first.join(common, cluster, "left").select(cluster, F.array_join(F.transform(chosen, capital), " ").alias("label"))


def classification_state(labels: DataFrame, placements: DataFrame) -> DataFrame:
    """canonical_label, choice: where a label was placed before, else blank. placements: canonical_label, mode."""
    return labels.select("canonical_label").join(placements.select("canonical_label", F.col("mode").alias("choice")), "canonical_label", "left").withColumn("choice", F.coalesce("choice", F.lit("")))


def with_suggestions(state: DataFrame, suggestions: DataFrame, modes: list[str]) -> DataFrame:
    """state plus suggested (only known modes), and a note where the choice differs from it. suggestions: canonical_label, suggested."""
    known = suggestions.filter(F.col("suggested").isin(modes)).groupBy("canonical_label").agg(F.min("suggested").alias("suggested"))
    out = state.join(known, "canonical_label", "left")
    differs = (F.col("choice") != "") & (F.col("choice") != "?") & (F.col("choice") != F.col("suggested"))
    return out.withColumn("note", F.when(differs, F.concat(F.lit("overrides "), "suggested")).otherwise(""))


def emitted_modes(state: DataFrame) -> DataFrame:
    """canonical_label, mode of labels that are classified: neither blank nor in doubt."""
    return state.filter(~F.coalesce("choice", F.lit("")).isin("", "?")).select("canonical_label", F.col("choice").alias("mode"))


def unusable_items(items: DataFrame, expected: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Answers (canonical_label, mode) for labels that weren't asked for, or with modes that don't exist."""
    asked = expected.select("canonical_label", F.lit(True).alias("asked"))
    return items.join(asked, "canonical_label", "left").filter(F.col("asked").isNull() | F.col("mode").isNull() | ~F.col("mode").isin(vocabulary)).select("canonical_label", "mode")
