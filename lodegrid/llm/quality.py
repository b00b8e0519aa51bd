"""Quality by co-training of two views of a document.

One logistic classifier sees the text's content (hashed words and word shapes), another its metadata
(language, source, length, layout). Over some rounds each scores all unlabelled documents that are still free and hands
those it is surest of, with its own judgement as label, to the other one's training rows. Then both are calibrated on
labelled rows that neither was trained on, and a logistic combination of the two scores all documents.

The labelled rows are a bounded sample, chosen by hash. All unlabelled documents take part: what is sure enough
follows from histograms of all their scores, and gradients are summed where the rows are.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.llm.common import give_back, short_batches, slices, smallest, stored

#: Labelled rows that are learnt from, at most.
MOST_LABELLED = 10_000
ROUNDS = 5
#: Share of the unlabelled documents that each view hands over in a round.
HANDED = 0.05
#: Share of the labelled rows that is kept for the calibration.
CALIBRATION = 0.25
CONTENT_FEATURES = 1 << 16
META_FEATURES = 1 << 12
#: Numbers of features fit two bytes.
PACKED = np.dtype("<u2")
STEPS = 40
#: Steps over labelled and handed rows after each round; each is a pass over the handed rows.
FURTHER_STEPS = 6
#: Bins of the histograms of logits, from -30 to 30.
BINS = 60_000
REMEMBERED = 200_000

def _character_classes() -> np.ndarray:
    """By code point, what a character looks like in a shape: U, a, 0, a blank, or itself. The last place stands for all further ones."""
    table = np.full(0x251, ord("a"), dtype=np.uint8)
    for code in range(0x250):
        c = chr(code)
        table[code] = ord("U" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else "a" if c.isalpha() or code >= 128 else c)
    return table


_LOOKS = _character_classes()
_MARKS = np.array([chr(c) not in "Ua0 " for c in range(128)])


def looks(text: str) -> np.ndarray:
    """The class of each character."""
    return _LOOKS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0x250)]


def shapes(seen: np.ndarray) -> set[bytes]:
    """Distinct shapes of words: classes of characters, of letters and digits one for each run. A word in capitals is U, a capitalised one Ua."""
    same = np.concatenate([[False], seen[1:] == seen[:-1]]) & ~_MARKS[seen]
    return set(seen[~same].tobytes().split(b" ")) - {b""}


def _hash(feature: bytes | str, size: int) -> int:
    return xxhash.xxh64_intdigest(feature if isinstance(feature, bytes) else feature.encode("utf-8", "surrogatepass")) % size


_known: dict[str | bytes, int] = {}


def _numbers(kind: str, features: set) -> np.ndarray:
    """Feature numbers; a bounded number of them is remembered between texts."""
    global _known
    if len(_known) > REMEMBERED:
        _known = {}
    for f in features.difference(_known):
        _known[f] = _hash(kind.encode() + (f if isinstance(f, bytes) else f.encode("utf-8", "surrogatepass")), CONTENT_FEATURES)
    return np.fromiter(map(_known.__getitem__, features), dtype=np.int32, count=len(features))


def content_features(text: str | None, seen: np.ndarray | None = None) -> np.ndarray:
    """Distinct features of the whole text: its words in lower case (text) and their shapes (bytes)."""
    text = text or ""
    seen = looks(text) if seen is None else seen
    return np.unique(np.concatenate([_numbers("w", set(text.lower().split())), _numbers("s", shapes(seen))]))


def meta_features(text: str | None, lang: str | None, source: str | None, n_chars: int | None, seen: np.ndarray | None = None) -> np.ndarray:
    """Language, source, length, and the layout: lines, their length, shares of kinds of characters. Nulls are a value of their own."""
    text = text or ""
    seen = looks(text) if seen is None else seen
    length, lines = max(1, len(text)), text.count("\n") + 1
    count = np.bincount(seen, minlength=128)
    upper, digits, marks = count[ord("U")] / length, count[ord("0")] / length, count[:128][_MARKS].sum() / length
    level = lambda x: int(math.log2(1 + x) * 2)
    values = {"lang": lang, "source": source, "chars": level(n_chars) if n_chars and n_chars > 0 else n_chars, "lines": level(lines), "line": level(length / lines), "upper": level(upper * 100), "marks": level(marks * 100), "digits": level(digits * 100)}
    return np.unique(np.array([_hash(f"{k}={v}", META_FEATURES) for k, v in values.items()], dtype=np.int32))


def both_features(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    seen = looks(text or "")
    return content_features(text, seen), meta_features(text, lang, source, n_chars, seen)


def _logit(p: np.ndarray | float):
    return np.log(p) - np.log1p(-p)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


Packed = tuple[np.ndarray, np.ndarray]


def pack(rows: list[np.ndarray]) -> Packed:
    """All features in a row, and how many each document has."""
    return np.concatenate([np.zeros(0, dtype=PACKED), *rows]), np.array([len(r) for r in rows], dtype=np.int64)


def packed_column(column: pa.BinaryArray) -> Packed:
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1] // 2
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=PACKED)[at[0] : at[-1]] if data and at[-1] else np.zeros(0, dtype=PACKED), np.diff(at).astype(np.int64)


class Linear:
    """Logistic regression over sets of hashed features, each scaled by the root of its set's size; steps are AdaGrad's."""

    def __init__(self, size: int):
        self.weights, self.bias = np.zeros(size), 0.0
        self.square, self.square_bias = np.full(size, 1e-8), 1e-8

    def logits(self, rows: Packed) -> np.ndarray:
        flat, count = rows
        owner = np.repeat(np.arange(len(count)), count)
        return np.bincount(owner, weights=self.weights[flat], minlength=len(count)) / np.sqrt(np.maximum(1, count)) + self.bias

    def gradient(self, rows: Packed, y: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, float]:
        """Sums over the rows; ``weights`` are those of a row of class 0 and 1."""
        flat, count = rows
        error = (_sigmoid(self.logits(rows)) - y) * np.where(y == 1, weights[1], weights[0])
        return np.bincount(flat, weights=np.repeat(error / np.sqrt(np.maximum(1, count)), count), minlength=len(self.weights)), float(error.sum())

    def step(self, gradient: np.ndarray, of_bias: float, rate: float = 0.5, ridge: float = 1e-4) -> None:
        gradient = gradient + ridge * self.weights
        self.square += gradient**2
        self.square_bias += of_bias**2
        self.weights -= rate * gradient / np.sqrt(self.square)
        self.bias -= rate * of_bias / math.sqrt(self.square_bias)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-9] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = _sigmoid(x @ w)
        w += (step := np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    views: tuple[Linear, Linear]
    calibration: tuple[np.ndarray, np.ndarray]
    combination: np.ndarray
    #: How many unlabelled documents took part.
    pooled: int

    def scores(self, content: Packed, meta: Packed) -> np.ndarray:
        z = [np.ones(len(content[1]))]
        for view, (a, b), rows in zip(self.views, self.calibration, (content, meta), strict=True):
            z.append(a + b * view.logits(rows))
        return _sigmoid(np.stack(z, axis=1) @ self.combination)


@dataclass
class Round:
    """The views of a round, and for each: (bin, share of it) up to which, and from which, documents are handed over."""

    views: tuple[Linear, Linear]
    cuts: list[tuple[tuple[int, float], tuple[int, float]]]


def _bins(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((z + 30) * (BINS / 60)), 0, BINS - 1).astype(np.int64)


def _judged(rounds: list[Round], both: tuple[Packed, Packed], u: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(free before the last round, by view the last round's judgement: 1, 0, or -1 if it hands nothing over)."""
    free = np.ones(len(u), dtype=bool)
    for k, r in enumerate(rounds):
        out = []
        for view, rows, ((low, low_share), (high, high_share)) in zip(r.views, both, r.cuts, strict=True):
            b = _bins(view.logits(rows))
            good = ((b > high) | ((b == high) & (u < high_share))) & (b >= BINS // 2)  # only what the view itself judges so
            poor = ((b < low) | ((b == low) & (u < low_share))) & (b < BINS // 2)
            out.append(np.where(good, 1, np.where(poor, 0, -1)))
        if k == len(rounds) - 1:
            return free, out
        free &= (out[0] < 0) & (out[1] < 0)
    return free, []


def _cut(counts: np.ndarray, n: int) -> tuple[int, float]:
    """(bin, share) so that the bins before it and the share of it make n rows."""
    if not n:
        return -1, 0.0
    up_to = np.cumsum(counts)
    at = int(np.searchsorted(up_to, n))
    return at, (n - (up_to[at] - counts[at])) / counts[at]


def _over(rows: DataFrame, state, work, columns: list[str], schema: str) -> DataFrame:
    """``work`` on (state, batches) in each task; the state goes as a broadcast of bounded size."""
    shared = rows.sparkSession.sparkContext.broadcast(state)
    return rows.select(*columns).mapInArrow(lambda batches: work(shared.value, batches), schema)


def _batch(columns: list, schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, schema.values(), strict=True)], list(schema))


def _histograms(rounds: list[Round], views: tuple[Linear, Linear], pool: DataFrame) -> np.ndarray:
    """By view, the counts of the bins of all free documents' logits."""

    def work(state, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, views = state
        total = np.zeros((2, BINS), dtype=np.int64)
        for batch in batches:
            both, u = (packed_column(batch.column(0)), packed_column(batch.column(1))), batch.column(2).to_numpy()
            last = Round(views, [((-1, 0.0), (BINS, 0.0))] * 2)
            free, _ = _judged([*rounds, last], both, u)
            for v in (0, 1):
                total[v] += np.bincount(_bins(views[v].logits(both[v]))[free], minlength=BINS)
        v, at = np.nonzero(total)
        yield _batch([v, at, total[v, at]], {"view": pa.int32(), "bin": pa.int32(), "n": pa.int64()})

    found = _over(pool, (rounds, views), work, ["content", "meta", "u"], "view int, bin int, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, BINS), dtype=np.int64)
    out[found["view"].to_numpy(), found["bin"].to_numpy()] = found["n"].to_numpy()
    return out


def _handed(rounds: list[Round], pool: DataFrame) -> DataFrame:
    """view (that receives), label, features: what the last round hands over."""

    def work(rounds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, u = (packed_column(batch.column(0)), packed_column(batch.column(1))), batch.column(2).to_numpy()
            free, judged = _judged(rounds, both, u)
            for v in (0, 1):
                taken = np.flatnonzero(free & (judged[v] >= 0))
                features = batch.column(1 - v).take(pa.array(taken))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(taken), 1 - v), type=pa.int32()), pa.array(judged[v][taken], type=pa.int32()), features], ["view", "label", "features"])

    return stored(_over(pool, rounds, work, ["content", "meta", "u"], "view int, label int, features binary"))


def _gradients(views: tuple[Linear, Linear], weights: list[tuple[float, float]], handed: DataFrame) -> list[tuple[np.ndarray, float]]:
    """By view, the sums over all handed rows."""

    def work(state, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, weights = state
        total = [np.zeros(len(view.weights) + 1) for view in views]
        for batch in batches:
            for v in (0, 1):
                part = batch.filter(pa.array(batch.column(0).to_numpy() == v))
                if part.num_rows:
                    gradient, of_bias = views[v].gradient(packed_column(part.column(2)), part.column(1).to_numpy(), weights[v])
                    total[v] += np.append(gradient, of_bias)
        for v in (0, 1):
            at = np.flatnonzero(total[v])
            yield _batch([np.full(len(at), v), at, total[v][at]], {"view": pa.int32(), "feature": pa.int32(), "g": pa.float64()})

    found = _over(handed, (views, weights), work, ["view", "label", "features"], "view int, feature int, g double").groupBy("view", "feature").agg(F.sum("g").alias("g")).toArrow()
    view, feature, g = (found[c].to_numpy() for c in ("view", "feature", "g"))
    out = []
    for v in (0, 1):
        total = np.bincount(feature[view == v], weights=g[view == v], minlength=len(views[v].weights) + 1)
        out.append((total[:-1], float(total[-1])))
    return out


def co_train(content: list[np.ndarray], meta: list[np.ndarray], y: np.ndarray, pool: DataFrame, n_rounds: int = ROUNDS, handed_share: float = HANDED) -> Model:
    """Rows come in random order; the first part of them is kept for the calibration. ``pool`` has content, meta and u, a draw from 0 to 1."""
    n_kept = min(len(y) - 1, max(1, int(len(y) * CALIBRATION))) if len(y) > 1 else 0
    taught, labels = [pack(view[n_kept:]) for view in (content, meta)], y[n_kept:].astype(float)
    views = (Linear(CONTENT_FEATURES), Linear(META_FEATURES))
    share, size = float(labels.mean()), [[int((labels == c).sum()) for c in (0, 1)] for _ in (0, 1)]
    balance = lambda v: (0.5 / size[v][0], 0.5 / size[v][1])
    for v in (0, 1):
        for _ in range(STEPS):
            views[v].step(*views[v].gradient(taught[v], labels, balance(v)))
    rounds: list[Round] = []
    handed, pooled = None, 0
    for k in range(n_rounds):
        counts = _histograms(rounds, views, pool)
        free = int(counts[0].sum())
        pooled = free if k == 0 else pooled
        n = min(int(handed_share * pooled), free // 2)
        if not n:
            break
        n_good = round(n * share)
        cuts = []
        for v in (0, 1):
            at, part = _cut(counts[v][::-1], n_good)
            cuts.append((_cut(counts[v], n - n_good), (BINS - 1 - at, part)))
        rounds.append(Round(copy.deepcopy(views), cuts))
        new = _handed(rounds, pool)
        handed = new if handed is None else handed.unionByName(new)
        for r in new.groupBy("view", "label").count().collect():
            size[r["view"]][r["label"]] += r["count"]
        for _ in range(FURTHER_STEPS):
            further = _gradients(views, [balance(0), balance(1)], handed)
            for v in (0, 1):
                gradient, of_bias = views[v].gradient(taught[v], labels, balance(v))
                views[v].step(gradient + further[v][0], of_bias + further[v][1])
    held = [pack(view[:n_kept]) for view in (content, meta)]
    z = [views[v].logits(held[v]) for v in (0, 1)]
    calibration = tuple(_newton(np.stack([np.ones(n_kept), x], axis=1), y[:n_kept]) for x in z)
    calibrated = np.stack([np.ones(n_kept), *[a + b * x for (a, b), x in zip(calibration, z, strict=True)]], axis=1)
    return Model(views, calibration, _newton(calibrated, y[:n_kept]), pooled)


def training_part(id_col: str = "doc_id"):
    """True for rows whose label may be learnt from: crc32 of the id as text isn't divisible by 5."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 != 0


def _features(docs: DataFrame) -> DataFrame:
    """doc_id and the packed features of both views."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _known
        for part in slices(batches):
            found = [both_features(*row) for row in zip(*[c.to_pylist() for c in part.columns[1:]], strict=True)]
            content, meta = [c.astype(PACKED).tobytes() for c, _ in found], [m.astype(PACKED).tobytes() for _, m in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, type=pa.binary()), pa.array(meta, type=pa.binary())], ["doc_id", "content", "meta"])
        _known = {}
        give_back()

    slim = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], T.StructField("content", T.BinaryType()), T.StructField("meta", T.BinaryType())]))


def featured(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, content, meta, quality (of labelled rows that are learnt from), pooled (whether the row has no label at all), u. The texts aren't shuffled."""
    order = F.xxhash64(F.lit(3), "doc_id")
    good = labels.filter("doc_id is not null and quality in (0, 1)").filter(training_part())
    one = good.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    few = stored(smallest(stored(one), order, most_labelled).select(F.col("doc_id").alias("__id"), "quality"))
    known = labels.select(F.col("doc_id").alias("__known")).filter("__known is not null").distinct()
    rows = _features(docs).join(F.broadcast(few), F.col("doc_id") == F.col("__id"), "left").join(known, F.col("doc_id") == F.col("__known"), "left")
    u = F.pmod(F.xxhash64(F.lit(4), "content", "meta"), F.lit(1 << 30)) / (1 << 30)
    return stored(rows.select("doc_id", "content", "meta", "quality", F.col("__known").isNull().alias("pooled"), u.alias("u")))


def train(rows: DataFrame) -> Model | None:
    """Learn from rows of ``featured``. None if the labels of the training part have one class only, or there are none."""
    # Rows that share an id count once, so no more rows are collected than ids were chosen.
    one = rows.filter("quality is not null").groupBy("doc_id").agg(F.min(F.struct("content", "meta", "quality")).alias("row"))
    found = one.select("row.*").collect()
    unpack = lambda x: np.frombuffer(bytes(x), dtype=PACKED)
    found.sort(key=lambda r: xxhash.xxh64_intdigest(bytes(r["content"]) + bytes(r["meta"])))
    y = np.array([r["quality"] for r in found], dtype=np.int64)
    n_kept = max(1, int(len(y) * CALIBRATION))
    if not len(y) or y[n_kept:].size == 0 or y[n_kept:].min() == y[n_kept:].max():
        return None
    return co_train([unpack(r["content"]) for r in found], [unpack(r["meta"]) for r in found], y, rows.filter("pooled"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher is better), predicted.

    ``docs`` has doc_id, text, lang, source and n_chars; nulls in them are values like others, and null texts
    count as empty. Without labels of both classes every score is 0.5. Repeated rows get equal scores; rows
    with a null doc_id are scored and not held out. Other columns are not read.
    """
    rows = featured(docs, labels)

    def work(m: Model | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = m.scores(packed_column(batch.column(1)), packed_column(batch.column(2))) if m else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = _over(rows, train(rows), work, ["doc_id", "content", "meta"], T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", F.coalesce(~training_part(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
