"""Whitening of embeddings by the eigenvectors of their covariance.

Entries become whole numbers x = floor(256 c), so counts, sums and deviations are exact. The covariance is that of the
distinct vectors (the fit list). Rows are centred exactly before anything is multiplied: n x - S is a whole number, so
the centred row (n x - S) / n is rounded once. ``RowMatrix`` adds up the Gramian of the centred rows where they are; only
a matrix of dimensions times dimensions comes to the driver, which takes its eigenvectors. The projection of all rows
gets the model as a broadcast of that size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.llm.common import short_batches, stored

SCALE = 256
#: Whole numbers below this are safe from overflow after one more addition.
SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """One fit, for vectors of one length: n, the sums S of each dimension, unit eigenvectors (columns) by falling
    eigenvalue, these eigenvalues, the trace of the covariance, and the largest entry by which the covariance of the
    whitened fit list differs from the identity (None without any component of positive variance)."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def usable(self) -> np.ndarray:
        """Components whose variance is beyond rounding; no others have a direction to be whitened along."""
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps

    @property
    def explained(self) -> np.ndarray:
        return np.maximum(self.values, 0.0) / self.trace if self.trace > 0 else np.zeros(len(self.values))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S: whole numbers, as Python's where 64 bits don't hold them."""
        far = max([0, *map(abs, self.sums)]) + self.n * int(max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0)
        if far < SAFE:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(whitened rows with NaN for components that aren't usable, deviations: null beyond 64 bits)."""
        whole = self.centred(x)
        rows, usable = (whole / self.n).astype(np.float64), self.usable
        out = np.full((len(x), len(self.values)), np.nan)
        out[:, usable] = rows @ self.vectors[:, usable] / np.sqrt(self.values[usable])
        return out, _sums_of_squares(whole)


def _sums_of_squares(whole: np.ndarray) -> list[int | None]:
    """Exact sums of squares a row. Arithmetic modulo 2^64 is exact where the sum is below 2^63, which a rough sum tells."""
    exact = lambda row: s if (s := sum(int(v) ** 2 for v in row)) < 1 << 63 else None
    if whole.dtype == object:
        return [exact(row) for row in whole]
    bits = whole.astype(np.uint64)
    with np.errstate(over="ignore"):
        wrapped = (bits * bits).sum(axis=1, dtype=np.uint64)
    rough = (whole.astype(np.float64) ** 2).sum(axis=1) / 2.0**63
    return [int(w) if r < 0.999 else None if r > 1.001 else exact(row) for w, r, row in zip(wrapped, rough, whole, strict=True)]


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, x: rows without a null vector or a null or non-finite entry, entries as floor(256 c)."""
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = slim.filter(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return fine.select("id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _covariance(rows: DataFrame, n: int, dims: int) -> np.ndarray:
    """Of centred rows (a column y of doubles), divisor n."""
    as_vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("y").alias("y")), "y")
    return RowMatrix(as_vectors, n, dims).computeGramianMatrix().toArray() / n


def fit(x: DataFrame, components: int | None = None) -> dict[int, Whitening]:
    """A fit for each length of vectors (column x, as ``whole_vectors`` makes them); with the leading components, or all."""
    distinct = stored(x.select("x").distinct().withColumn("dims", F.size("x")).filter("dims > 0"))
    largest = F.array_max(F.transform("x", lambda v: F.abs(v.cast("double"))))
    sizes = {r["dims"]: r for r in distinct.groupBy("dims").agg(F.count("*").alias("n"), F.max(largest).alias("top")).collect()}
    wide = any(r["n"] * r["top"] * 2 >= SAFE for r in sizes.values())
    kind = "decimal(38,0)" if wide else "bigint"
    entries = distinct.select("dims", F.posexplode("x").alias("k", "v"))
    sums: dict[int, list[int]] = {d: [0] * d for d in sizes}
    for r in entries.groupBy("dims", "k").agg(F.sum(F.col("v").cast(kind)).alias("s")).collect():
        sums[r["dims"]][r["k"]] = int(r["s"])
    found = {}
    for dims, size in sizes.items():
        n, rows = size["n"], distinct.filter(F.col("dims") == dims)
        times = F.lit(n).cast("decimal(18,0)" if wide else "bigint")
        centred = F.zip_with(F.transform("x", lambda v: v.cast(kind) * times), _literal(sums[dims], kind), lambda v, s: (v - s).cast("double") / n)  # noqa: B023
        covariance = _covariance(rows.select(centred.alias("y")), n, dims)
        values, vectors = np.linalg.eigh(covariance)
        most = min(components or dims, dims)
        values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(most)] < 0, -1.0, 1.0)
        model = Whitening(n, sums[dims], np.ascontiguousarray(vectors), values, float(np.trace(covariance)))
        error = _identity_error(rows, model)
        found[dims] = Whitening(model.n, model.sums, model.vectors, model.values, model.trace, error)
    return found


def _identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """From the whitened fit list itself: its covariance, centred before multiplying, minus the identity."""
    k = int(model.usable.sum())
    if not k:
        return None
    white = stored(_projected(rows.select(F.lit(0).cast("long").alias("id"), "x"), {len(model.sums): model}).select(F.filter("whitened", lambda w: w.isNotNull()).alias("w")))
    means = {r["k"]: r["m"] for r in white.select(F.posexplode("w").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).collect()}
    centred = F.zip_with("w", _literal([means[j] for j in range(k)], "double"), lambda w, m: w - m)
    return float(np.abs(_covariance(white.select(centred.alias("y")), model.n, k) - np.eye(k)).max())


def _projected(x: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """id, dims, deviation, whitened (an array) of each row whose length has a model."""
    short_batches(x.sparkSession)
    shared = x.sparkSession.sparkContext.broadcast(models)  # dimensions times components, whatever the number of rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["x"].map(len)
            for dims, part in batch.groupby(lengths, sort=False):
                if dims not in shared.value:
                    continue
                white, deviations = shared.value[dims].of(np.stack(part["x"].to_list()).astype(np.int64))
                as_lists = [[None if v != v else v for v in row] for row in white.tolist()]  # NaN: no such direction
                yield pd.DataFrame({"id": part["id"].to_numpy(), "dims": dims, "deviation": pd.array(deviations, dtype="Int64"), "whitened": as_lists})

    kind = x.schema["id"].dataType.simpleString()
    return x.select("id", "x").mapInPandas(run, f"id {kind}, dims int, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: its id, n, deviation, whitened and explained (arrays over the components), identity_error.

    Rows whose vector is null or holds a null or non-finite entry are dropped, and so are empty vectors, which have no
    component. Null and repeated ids and repeated rows are rows like others; equal vectors are one row of the fit. Vectors
    of each length are fitted apart. Components without variance (fewer distinct vectors than dimensions, one vector
    alone) are null in whitened, 0 in explained, and not part of identity_error. A deviation beyond 64 bits is null;
    entries beyond them are set to their nearest end. Further columns aren't read.
    """
    x = whole_vectors(vectors, id_col, vector_col)
    models = fit(x, components)
    out = _projected(x, models)
    facts = {d: (m.n, m.explained.tolist(), m.identity_error) for d, m in models.items()}

    def fact(at: int, kind: str) -> Column:
        chosen = F.lit(None).cast(kind)
        for d, f in facts.items():
            value = _literal(f[at], "double") if isinstance(f[at], list) else F.lit(f[at]).cast(kind)
            chosen = F.when(F.col("dims") == d, value).otherwise(chosen)
        return chosen

    return out.select(F.col("id").alias(id_col), fact(0, "bigint").alias("n"), "deviation", "whitened", fact(1, "array<double>").alias("explained"), fact(2, "double").alias("identity_error"))


def whitened_components(vectors: DataFrame, components: int) -> DataFrame:
    """A row per vector and component, numbered from 1."""
    rows = whiten(vectors, components).select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
