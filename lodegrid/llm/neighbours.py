"""Nearest neighbours by low-dimensional stable projections in kd-trees, with a chi-square stopping test.

Vectors are scaled to length 1, where the largest cosine is the smallest distance, and projected to a
few dimensions by a Gaussian (2-stable) matrix: the squared projected distance of two vectors is their
squared distance times a chi-square variable. Equal vectors are one entry of the index. A coarse kd-tree, fitted on a bounded
sample of projections, deals all entries out into cells; a kd-tree within each block of a cell hands out leaves
in the order of projected distance, whose vectors are verified on the originals.

A query first searches its own block. With the distance of the worst neighbour found there it then goes to those other
cells only whose bounding boxes the chi-square law doesn't rule out, and so to leaves within them. A leaf or cell is ruled
out when a vector nearer than the worst one so far would, by that law, have come up with high probability.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.llm.common import give_back, lookup, short_batches, small_table, stored

PROJECTED = 8
LEAF_ROWS = 256
#: With this probability a nearer vector would have come up before a query stops.
CERTAINTY = 0.97
#: Vectors of a block, about. A larger cell is several blocks.
BLOCK_ROWS = 16_384
#: The coarse tree has so many cells at most and is fitted on about so many projections at most; all vectors are indexed.
MOST_CELLS = 4096
SAMPLE_ROWS = 1 << 16
#: Cosines of a matrix product are this near the exact ones.
ROUNDING = 1e-9


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """Distribution function of the chi-square law for an even number of dimensions."""
    half = np.minimum(np.asarray(x, dtype=np.float64) / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for k in range(1, dims // 2):
        term = term * half / k
        total = total + term
    return 1 - np.exp(-half) * total


def projection(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, PROJECTED))


def projected(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Projections of the vectors scaled to length 1; equal vectors get equal ones."""
    return (vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]) @ projection(vectors.shape[1], seed)


class KdTree:
    """Median splits along the widest side down to leaves; each leaf keeps its bounding box."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order, leaves, open_ = np.arange(len(points)), [], [(0, len(points))]
        while open_:
            a, b = open_.pop()
            if b - a <= leaf_rows:
                leaves.append((a, b))
                continue
            part = points[order[a:b]]
            widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, widest], middle)]
            open_ += [(a, a + middle), (a + middle, b)]
        self.order, self.leaves = order, leaves
        self.low = np.array([points[order[a:b]].min(axis=0) for a, b in leaves])
        self.high = np.array([points[order[a:b]].max(axis=0) for a, b in leaves])


class Cells:
    """A coarse kd-tree over a sample of projections: it names the cell of any point."""

    def __init__(self, points: np.ndarray, n_cells: int):
        points = np.unique(points, axis=0)
        self.side, self.cut, self.below, self.above = [-1], [0.0], [0], [0]
        open_ = [(-len(points), 0, np.arange(len(points)))]
        n_leaves = 1
        while n_leaves < n_cells and open_:
            _, node, rows = heapq.heappop(open_)
            part = points[rows]
            widths = part.max(axis=0) - part.min(axis=0) if len(rows) > 1 else np.zeros(points.shape[1])
            side = int(np.argmax(widths))
            if not widths[side] > 0:
                continue
            values = part[:, side]
            middle = np.median(values)
            cut = float(middle if (values > middle).any() else values[values < middle].max())
            left = values <= cut
            self.side[node], self.cut[node] = side, cut
            self.below[node], self.above[node] = len(self.side), len(self.side) + 1
            for child in (rows[left], rows[~left]):
                heapq.heappush(open_, (-len(child), len(self.side), child))
                for field, value in ((self.side, -1), (self.cut, 0.0), (self.below, 0), (self.above, 0)):
                    field.append(value)
            n_leaves += 1
        self.side, self.cut, self.below, self.above = (np.array(x) for x in (self.side, self.cut, self.below, self.above))

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        while (inner := self.side[node] >= 0).any():
            goes = points[np.arange(len(points)), np.maximum(self.side[node], 0)] <= self.cut[node]
            node = np.where(inner, np.where(goes, self.below[node], self.above[node]), node)
        return node


def sums(products: np.ndarray) -> np.ndarray:
    """Sums of rows, added up from left to right: as any other engine gets them."""
    return np.add.accumulate(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[point, box]: squared distances."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        gap = np.maximum(low[:, k] - points[:, k, None], 0) + np.maximum(points[:, k, None] - high[:, k], 0)
        out += gap * gap
    return out


def ruled_out(squared: np.ndarray, cosine: np.ndarray, certainty: float) -> np.ndarray:
    """Whether a box at a squared projected distance can be left, given the worst cosine so far (-inf: none)."""
    worst = np.maximum(0.0, 2 - 2 * cosine)
    sure = chi_square(squared / np.maximum(worst, 1e-300), PROJECTED) >= certainty
    # At distance 0 only boxes that hold the query can have vectors as near.
    return (squared > 1e-9) & np.isfinite(worst) & ((worst <= 1e-12) | sure)


def search_block(queries: np.ndarray, q_points: np.ndarray, bound: np.ndarray, vectors: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, certainty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, cosine, worst): for each query the k nearest vectors found, those below its bound (a cosine) left out, and
    by query the cosine of the k-th, or the bound. Cosines in double precision on the originals; ``ids`` break ties.

    All queries go on to their next leaf together; what a matrix product finds near enough is measured exactly.
    """
    tree = KdTree(points)
    starts, ends = np.array(tree.leaves).T
    vectors, ids_of = vectors[tree.order], ids[tree.order]
    lengths, q_lengths = np.sqrt(sums(vectors * vectors)), np.sqrt(sums(queries * queries))
    unit, q_unit = vectors / lengths[:, None], queries / q_lengths[:, None]
    worst = bound.astype(np.float64).copy()
    best_q, best_row, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    squared = box_distances(q_points, tree.low, tree.high)
    turn = np.argsort(squared, axis=1, kind="stable")
    active = np.arange(len(queries))
    for step in range(len(starts)):
        leaf = turn[active, step]
        go = ~ruled_out(squared[active, leaf], worst[active], certainty)
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        by_leaf = np.argsort(leaf, kind="stable")
        new_q, new_row = [], []
        for group in np.split(active[by_leaf], np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
            at = turn[group[0], step]
            near = q_unit[group] @ unit[starts[at] : ends[at]].T
            least = worst[group]
            if near.shape[1] > k:
                least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k])
            i, j = np.nonzero(near >= least[:, None] - ROUNDING)
            new_q.append(group[i])
            new_row.append(starts[at] + j)
        q, row = np.concatenate(new_q), np.concatenate(new_row)
        cosine = np.concatenate([sums(vectors[row[n : n + 8192]] * queries[q[n : n + 8192]]) for n in range(0, len(row), 8192)] or [np.zeros(0)]) / (lengths[row] * q_lengths[q])
        q, row, cosine = np.concatenate([best_q, q]), np.concatenate([best_row, row]), np.concatenate([best, cosine])
        order = np.lexsort((ids_of[row], -cosine, q))
        q, row, cosine = q[order], row[order], cosine[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = place < k
        best_q, best_row, best = q[keep], row[keep], cosine[keep]
        full = place[keep] == k - 1
        worst[best_q[full]] = np.maximum(worst[best_q[full]], best[full])
    return best_q, tree.order[best_row], best, worst


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of doubles), dims: without null ids, and null, empty or zero vectors, and such with components that aren't finite."""
    v = F.col("v")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine).withColumn("dims", F.size("v"))


def _matrix(column) -> np.ndarray:
    """Vectors of equal length as rows, from Arrow or pandas."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float64)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_dims(batch: pa.RecordBatch, dims: pa.Array) -> Iterator[tuple[int, pa.RecordBatch]]:
    of = dims.to_numpy()
    for d in np.unique(of).tolist():
        yield d, batch.filter(pa.array(of == d))


_POINT = pa.list_(pa.float64())


def _points(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, PROJECTED, dtype=np.int32)), pa.array(p.ravel()))


def _sampled(rows: DataFrame, total: int, seed: int) -> dict[int, np.ndarray]:
    """By number of components, projections of about SAMPLE_ROWS rows in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_dims(batch, batch.column(0)):
                p = projected(_matrix(part.column(1)), seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), d, dtype=np.int32)), _points(p)], ["dims", "p"])

    some = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(max(1, total))) < SAMPLE_ROWS).select("dims", "v")
    found = some.mapInArrow(run, "dims int, p array<double>").toArrow()
    of = found["dims"].to_numpy()
    points = found["p"].combine_chunks().flatten().to_numpy().reshape(-1, PROJECTED) if len(of) else np.zeros((0, PROJECTED))
    return {d: points[of == d] for d in np.unique(of).tolist()}


def _indexed(entries: DataFrame, cells: dict[int, Cells], seed: int) -> DataFrame:
    """Entries (h1, h2, dims, v, members) with p and cell; a number of components that the sample lacks has one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_dims(batch, batch.column(2)):
                p = projected(_matrix(part.column(3)), seed)
                cell = cells[d].of(p) if d in cells else np.zeros(len(p), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, _points(p), pa.array(cell.astype(np.int32))], [*part.schema.names, "p", "cell"])
        give_back()

    columns = "h1 long, h2 long, dims int, v array<double>, members array<struct<vec_id: long, rid: long>>"
    return stored(entries.select("h1", "h2", "dims", "v", "members").mapInArrow(run, f"{columns}, p array<double>, cell int"))


def _searched(indexed: DataFrame, asked: DataFrame, blocks: DataFrame, n_blocks: int, k: int, certainty: float) -> DataFrame:
    """h1, h2 (of the query), score, vec_id, rid, worst: what each query (h1, h2, dims, p, v, cell, part, bound) finds in its block."""

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["h1", "h2", "score", "vec_id", "rid", "worst"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: pd.Series(dtype="float64" if n in ("score", "worst") else "int64") for n in names})
        ids = np.array([m[0]["vec_id"] for m in left["members"]])
        q, row, cosine, worst = search_block(_matrix(right["v"]), _matrix(right["p"]), right["bound"].to_numpy(), _matrix(left["v"]), _matrix(left["p"]), ids, k, certainty)
        members = left["members"].to_numpy()
        n = np.array([len(members[r]) for r in row], dtype=np.int64)
        found = [(m["vec_id"], m["rid"]) for r in row for m in members[r]]
        q, cosine = np.repeat(q, n), np.repeat(cosine, n)
        out = {"h1": right["h1"].to_numpy()[q], "h2": right["h2"].to_numpy()[q], "score": cosine, "vec_id": [f[0] for f in found], "rid": [f[1] for f in found], "worst": worst[q]}
        return pd.DataFrame(out).astype({n: "float64" if n in ("score", "worst") else "int64" for n in names})

    keys = ["dims", "cell", "part"]
    tasks = max(1, min(5000, n_blocks))
    dealt = indexed.join(F.broadcast(blocks.select("dims", "cell", "parts")), ["dims", "cell"]).withColumn("part", F.pmod("h1", F.col("parts")).cast("int"))
    left = dealt.select(*keys, "p", "v", "members").repartition(tasks, *keys).groupBy(*keys)
    right = asked.select(*keys, "h1", "h2", "p", "v", "bound").repartition(tasks, *keys).groupBy(*keys)
    return left.cogroup(right).applyInPandas(search, "h1 long, h2 long, score double, vec_id long, rid long, worst double")


def nearest(vectors: DataFrame, asked: Column, k: int = 5, certainty: float = CERTAINTY, seed: int = 11, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row for which ``asked`` holds, that row itself left out.

    ``vectors`` as ``usable`` returns them. Only vectors of the query's number of components are
    compared. Rows are told apart by number: of rows that share an id, or are wholly repeated, each is a candidate,
    and each a query. Ties go to the smaller vec_id. Equal vectors are searched once: only the k + 1 of
    smallest ids can be among the k nearest of anything.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    hashed = vectors.withColumn("h1", F.xxhash64(F.lit(1), "v")).withColumn("h2", F.xxhash64(F.lit(2), "v"))  # 128 bits stand for a vector
    rows = stored(hashed.withColumn("asked", F.coalesce(asked, F.lit(False))).withColumn("rid", F.monotonically_increasing_id()))
    total = rows.count()
    sample = _sampled(rows, total, seed)
    n_cells = max(1, min(MOST_CELLS, -(-total // block_rows)))
    cells = {d: Cells(p, max(1, n_cells * len(p) // sum(map(len, sample.values())))) for d, p in sample.items()}

    alike = Window.partitionBy("h1", "h2").orderBy("vec_id", "rid")
    few = rows.withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= k + 1)
    entries = few.groupBy("h1", "h2").agg(F.first("dims").alias("dims"), F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct("vec_id", "rid"))).alias("members"))
    indexed = _indexed(entries, cells, seed)
    sides = [f(F.col("p")[d]).alias(f"{n}{d}") for n, f in (("low", F.min), ("high", F.max)) for d in range(PROJECTED)]
    boxes = indexed.groupBy("dims", "cell").agg(F.count("*").alias("n"), *sides).orderBy("dims", "cell").toPandas()  # a row per cell
    boxes["parts"] = -(-boxes["n"] // block_rows)
    blocks = stored(small_table(spark, boxes[["dims", "cell", "parts"]].astype(int).to_dict("records"), "dims: int, cell: int, parts: int"))
    n_blocks = int(boxes["parts"].sum())

    queries = stored(rows.filter("asked").groupBy("h1", "h2").agg(F.count("*").alias("n_asked")))
    at_home = indexed.join(queries.select("h1", "h2"), ["h1", "h2"], "left_semi").join(F.broadcast(blocks), ["dims", "cell"])
    at_home = stored(at_home.select("h1", "h2", "dims", "cell", "p", "v", F.pmod("h1", F.col("parts")).cast("int").alias("part"), F.lit(float("-inf")).alias("bound")))
    found = stored(_searched(indexed, at_home, blocks, n_blocks, k + 1, certainty))
    if n_blocks > 1:
        worst = found.groupBy("h1", "h2").agg(F.max("worst").alias("worst"))
        away = _away(at_home.drop("bound").join(worst, ["h1", "h2"]), boxes, certainty)
        found = found.unionByName(_searched(indexed, away, blocks, n_blocks, k + 1, certainty))
    top = Window.partitionBy("h1", "h2").orderBy(F.col("score").desc(), "vec_id", "rid")
    found = found.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1).groupBy("h1", "h2").agg(F.collect_list(F.struct("score", "vec_id", "rid")).alias("found"))
    found = stored(found.join(queries, ["h1", "h2"]))
    own = rows.filter("asked").select("h1", "h2", F.col("vec_id").alias("query_id"), F.col("rid").alias("own"))
    out = lookup(own, found, ["h1", "h2"], "n_asked", max(1, own.count()))
    others = F.array_sort(F.transform(F.filter("found", lambda x: x["rid"] != F.col("own")), lambda x: F.struct((-x["score"]).alias("minus"), x["vec_id"].alias("vec_id"), x["rid"].alias("rid"))))
    ranked = out.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def _away(asked: DataFrame, boxes: pd.DataFrame, certainty: float) -> DataFrame:
    """The queries once for each block, but the searched one, of the cells that aren't ruled out."""
    by_dims = {}
    for d, part in boxes.groupby("dims"):
        low, high = (part[[f"{n}{k}" for k in range(PROJECTED)]].to_numpy() for n in ("low", "high"))
        by_dims[int(d)] = (part["cell"].to_numpy(), part["parts"].to_numpy(), low, high)
    shared = asked.sparkSession.sparkContext.broadcast(by_dims)  # a row per cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for d, part in _by_dims(batch.slice(at, 256), batch.slice(at, 256).column(2)):
                    cell, parts, low, high = shared.value[d]
                    worst = part.column(7).to_numpy()
                    open_ = ~ruled_out(box_distances(_matrix(part.column(4)), low, high), worst[:, None], certainty)
                    q, c = np.nonzero(open_)
                    n = parts[c]
                    q, c, block = np.repeat(q, n), np.repeat(c, n), np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(x) for x in n]])
                    new = (cell[c] != part.column(3).to_numpy()[q]) | (block != part.column(6).to_numpy()[q])
                    q, c, block = q[new], c[new], block[new]
                    for k in range(0, len(q), 2000):
                        some = part.take(pa.array(q[k : k + 2000]))
                        columns = [*some.columns[:3], pa.array(cell[c[k : k + 2000]].astype(np.int32)), some.column(4), some.column(5), pa.array(block[k : k + 2000].astype(np.int32)), some.column(7)]
                        yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "dims", "cell", "p", "v", "part", "bound"])

    schema = "h1 long, h2 long, dims int, cell int, p array<double>, v array<double>, part int, bound double"
    return asked.select("h1", "h2", "dims", "cell", "p", "v", "part", "worst").mapInArrow(run, schema)


def nearest_of_every(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of each row whose id is divisible by ``every``, among all other rows.

    Rows with null ids and vectors that can't be compared take no part, as queries or candidates.
    An empty table gives an empty result; fewer candidates than k are all returned. Other columns are not read.
    """
    return nearest(usable(df, id_col, vector_col), F.col("vec_id") % every == 0, k)
