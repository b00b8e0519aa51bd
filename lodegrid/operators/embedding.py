"""Embeddings of texts by word vectors learnt from tables, and a cache of embeddings by text.

Words that stand in the same surroundings get near vectors: the leading directions of the matrix of positive pointwise
mutual information of words and the words around them. The matrix is sparse and stays in Spark; randomised subspace iteration
multiplies it by a thin matrix (VOCABULARY words times DIMS, so it can be broadcast) in a few passes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.functions import text as T
from lodegrid.session import scratch, short_batches

#: As ``functions.text.tokens`` has them.
TOKEN = re.compile("[a-z0-9]+")
#: The most words that get a vector: those that occur most often. It bounds what is broadcast.
VOCABULARY = 20_000
DIMS = 64
#: Words to each side that count as surroundings.
AROUND = 4
#: Tokens of texts whose pairs are made at once, and pairs with their counts that a task holds before it hands them on.
TOKENS_AT_ONCE = 100_000
HELD_PAIRS = 2_000_000
#: Passes over the matrix, and directions beyond DIMS that make them converge.
PASSES = 4
SPARE = 16
#: Frequent words count less in a text: a word of relative frequency p has the weight SMOOTH / (SMOOTH + p).
SMOOTH = 1e-3


def trigrams(texts: list[str], dims: int = 256) -> np.ndarray:
    """Without any table to learn from: hashed character trigrams, scaled to length 1."""
    out = np.zeros((len(texts), dims))
    for row, text in zip(out, texts, strict=True):
        padded = f"  {text.lower()} "
        for k in range(len(padded) - 2):
            row[zlib.crc32(padded[k : k + 3].encode()) % dims] += 1
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


@dataclass(frozen=True)
class WordVectors:
    """Words, their weights and vectors. A text's vector is the weighted mean of its words', scaled to length 1, or zero if none is known."""

    words: list[str]
    weights: np.ndarray
    vectors: np.ndarray
    place: dict[str, int] = field(default_factory=dict)

    def __call__(self, texts: list[str]) -> np.ndarray:
        place = self.place or {w: k for k, w in enumerate(self.words)}
        out = np.zeros((len(texts), self.vectors.shape[1]))
        for row, text in zip(out, texts, strict=True):
            at = [k for k in map(place.get, TOKEN.findall(text.lower())) if k is not None]
            if at:
                row += self.weights[at] @ self.vectors[at]
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)

    @property
    def name(self) -> str:
        """Tells models apart: what they have learnt, not what they are called."""
        return hashlib.sha1("\n".join(self.words).encode() + np.round(self.vectors, 6).tobytes()).hexdigest()[:16]


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _surroundings(tokens: DataFrame, words: list[str]) -> DataFrame:
    """w, c, n: how often each word of the vocabulary has another one up to AROUND places away, both ways; each row of ``tokens`` is a text."""
    shared = tokens.sparkSession.sparkContext.broadcast(words)  # VOCABULARY bounds it
    size = len(words)
    short_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = pa.array(shared.value, type=pa.string()), []
        for batch in batches:
            at, text = _placed(batch.column(0), known)
            for k in range(0, len(at), TOKENS_AT_ONCE):
                keys = []
                for d in range(1, AROUND + 1):
                    a, b = at[k : k + TOKENS_AT_ONCE], at[k + d : k + d + TOKENS_AT_ONCE]
                    a = a[: len(b)]
                    both = (a >= 0) & (b >= 0) & (text[k : k + len(a)] == text[k + d : k + d + len(b)])
                    keys += [a[both] * size + b[both], b[both] * size + a[both]]
                held.append(np.unique(np.concatenate(keys), return_counts=True))
                if sum(len(key) for key, _ in held) > HELD_PAIRS:
                    key, n = _added(held)
                    held = [(key, n)]
                    if len(key) > HELD_PAIRS // 2:
                        yield from _pairs(key, n, size)
                        held = []
        if held:
            yield from _pairs(*_added(held), size)

    return tokens.select("tokens").mapInArrow(run, "w long, c long, n long").groupBy("w", "c").agg(F.sum("n").alias("n"))


def _placed(tokens: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all tokens of a batch the place in the vocabulary, or -1, and the number of the text."""
    bounds = tokens.offsets.to_numpy().astype(np.int64)
    words = tokens.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
    at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return at, np.repeat(np.arange(len(tokens)), np.diff(bounds))


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts."""
    key, place = np.unique(np.concatenate([key for key, _ in held]), return_inverse=True)
    return key, np.bincount(place, weights=np.concatenate([n for _, n in held])).astype(np.int64)


def _pairs(key: np.ndarray, n: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(key), TOKENS_AT_ONCE):
        part = key[k : k + TOKENS_AT_ONCE]
        yield pa.RecordBatch.from_arrays([pa.array(part // size), pa.array(part % size), pa.array(n[k : k + TOKENS_AT_ONCE])], ["w", "c", "n"])


def word_vectors(texts: DataFrame, text: str, vocabulary: int = VOCABULARY, dims: int = DIMS, seed: int = 5) -> WordVectors:
    """Learn from all texts. Null texts hold no word; a table without words gives a model that knows none."""
    tokens = _kept(texts.select(T.tokens(F.col(text)).alias("tokens")).filter(F.size("tokens") > 0))
    counts = tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()  # VOCABULARY rows
    words = [r["word"] for r in common]
    weights = np.array([SMOOTH / (SMOOTH + r["n"] / total) for r in common])
    if not words:
        return WordVectors([], weights, np.zeros((0, dims)))
    pairs = _kept(_surroundings(tokens, words))
    n_of = np.zeros(len(words))
    for r in pairs.groupBy("w").agg(F.sum("n").alias("n")).collect():
        n_of[r["w"]] = r["n"]
    mass = n_of.sum()
    spark = texts.sparkSession
    shares = spark.sparkContext.broadcast(np.maximum(n_of, 1.0))
    tasks = max(1, min(200, len(words) // 500))

    def informative(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            value = np.log(pdf["n"].to_numpy() * mass / shares.value[pdf["w"].to_numpy()] / shares.value[pdf["c"].to_numpy()])
            yield pdf.assign(value=value)[value > 0][["w", "c", "value"]]

    matrix = _kept(pairs.mapInPandas(informative, "w long, c long, value double").repartition(tasks, "w").sortWithinPartitions("w"))
    thin = np.random.default_rng(seed).standard_normal((len(words), min(dims + SPARE, len(words))))
    for _ in range(PASSES):
        thin, _ = np.linalg.qr(_times(matrix, thin))
    image = _times(matrix, thin)  # the matrix is symmetric: its leading directions are those of thin' M thin
    values, turn = np.linalg.eigh((thin.T @ image + image.T @ thin) / 2)
    order = np.argsort(-np.abs(values))[:dims]
    vectors = (thin @ turn[:, order]) * np.sqrt(np.abs(values[order]))
    if vectors.shape[1] < dims:
        vectors = np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1])))
    return WordVectors(words, weights, vectors)


def _times(matrix: DataFrame, thin: np.ndarray) -> np.ndarray:
    """matrix (w, c, value, a word's rows in one partition) times a thin matrix: a row of the result a word comes to the driver."""
    shared = matrix.sparkSession.sparkContext.broadcast(thin)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w, start = np.unique(pdf["w"].to_numpy(), return_index=True)
            order = np.argsort(pdf["w"].to_numpy(), kind="stable")
            products = pdf["value"].to_numpy()[order, None] * shared.value[pdf["c"].to_numpy()[order]]
            bounds = np.searchsorted(pdf["w"].to_numpy()[order], w)
            yield pd.DataFrame({"w": w, "v": list(np.add.reduceat(products, bounds, axis=0))}) if len(start) else pd.DataFrame({"w": [], "v": []})

    out = np.zeros_like(thin)
    for r in matrix.mapInPandas(run, "w long, v array<double>").toLocalIterator():
        out[r["w"]] += r["v"]
    shared.destroy()
    return out


CACHE = "model string, code string, embedding array<double>"


def embedded(codes: DataFrame, code: str, path: str, model: str = "trigrams", embed: Callable[[list[str]], np.ndarray] = trigrams) -> DataFrame:
    """code, embedding, cached: of each distinct text that isn't null. What ``path`` has of this model is read, the rest is made and added there.

    Texts are looked up one by one, so other texts that come or go change nothing for those that stay. One writer at a time; rows that two
    writers have added twice are one here.
    """
    spark = codes.sparkSession
    wanted = codes.select(F.col(code).alias("code")).filter("code is not null").distinct()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    known = spark.read.schema(CACHE).parquet(path).filter(F.col("model") == model).dropDuplicates(["code"]).select("code", "embedding") if there else None
    old = _kept(known.join(wanted, "code", "left_semi")) if there else spark.createDataFrame([], "code string, embedding array<double>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"code": pdf["code"], "embedding": list(embed(pdf["code"].tolist()))})

    new = _kept(wanted.join(old.select("code"), "code", "left_anti").mapInPandas(run, "code string, embedding array<double>"))
    new.select(F.lit(model).alias("model"), "code", "embedding").write.mode("append").parquet(path)
    return old.withColumn("cached", F.lit(True)).unionByName(new.withColumn("cached", F.lit(False)))


#: Labels whose centres are sent to all tasks, at most.
MOST_CENTRES = 10_000


def text_vectors(df: DataFrame, text: str, embed: Callable[[list[str]], np.ndarray], out: str = "embedding") -> DataFrame:
    """df plus the vector of each text; null texts are empty."""
    short_batches(df.sparkSession)

    @F.pandas_udf("array<double>")
    def vectors(t: pd.Series) -> pd.Series:
        return pd.Series(list(embed(t.fillna("").tolist())))

    return df.withColumn(out, vectors(F.col(text)))


def nearest_labels(rows: DataFrame, vector: str, centres: DataFrame, label: str) -> DataFrame:
    """rows plus nearest: the label of the largest cosine among ``centres`` (label, centre; unit vectors, MOST_CENTRES at most)."""
    held = centres.orderBy(label).limit(MOST_CENTRES + 1).collect()
    if len(held) > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    shared = rows.sparkSession.sparkContext.broadcast(([r[label] for r in held], np.array([r["centre"] for r in held])))

    @F.pandas_udf("string")
    def nearest(v: pd.Series) -> pd.Series:
        labels, centres = shared.value
        return pd.Series([labels[k] for k in (np.stack(v.to_list()) @ centres.T).argmax(axis=1)])

    return rows.withColumn("nearest", nearest(F.col(vector)))
