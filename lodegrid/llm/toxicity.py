"""Toxicity by maximum-scoring segments.

Tokens score by how much likelier a toxic passage makes them: a passage is a mixture of usual text and
toxic words, whose log-odds have an informative Dirichlet prior (token frequencies over all documents)
and are shrunk to the lower end of their confidence interval. A linear-time scan finds all maximal
scoring segments of a document. Scores of segments in clean text follow an extreme-value law;
its two parameters, fitted on clean rows, turn the segments of a document into one evidence value, and a
logistic curve fitted on held-apart folds of the labelled rows turns that into a probability.

Tokens and stems are counted as they are, not by hash: first in the labelled rows, then, of all documents, those that
toxic rows hold often enough to speak for anything.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.llm.common import free_name, give_back, own_columns, short_batches, slices, smallest, stored, with_plain_names

#: Labelled rows that are learnt from, at most: those with the smallest hashes.
MOST_LABELLED = 200_000
#: Rows of these on which the calibration is fitted, at most.
MOST_CALIBRATED = 20_000
PRIOR_STRENGTH = 1000.0
CONFIDENCE = 3.0
TOXIC_SHARE = 0.2
LEAST_COUNT = 5
#: A passage is reported if chance gives less than so many like it in a document of clean text.
MOST_EXPECTED = 0.05
#: A segment counts for its document's score if chance gives less than so many: of a thousand clean documents one.
MOST_EXPECTED_SCORED = 0.001
#: A token is a run of ASCII letters, digits and underscores, and of all characters beyond ASCII, in lower case and UTF-8.
TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+")
_APART = bytes(c if TOKEN.match(bytes([c])) else 32 for c in range(256))
REMEMBERED = 300_000
#: Lengths of stems, in characters.
STEMS = (4, 5)
#: The share of clean texts whose best segments the extreme-value law is fitted to, and how many these must be.
TAIL = 0.05
LEAST_TAIL = 20
#: The rate of the law is between this and its inverse.
MOST_RATE = 4.0
#: Occurrences that are gathered before they are added to the counts of all features.
HELD = 1 << 20


def tokens_of(text: str | None) -> list[bytes]:
    """The tokens of the whole text, in order."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_APART).split()


def features_of(token: bytes) -> list[bytes]:
    """The token and its stems, its first characters and a mark, so that inflected forms share what is learnt; a token no longer than a stem stands for it."""
    if token.isascii():
        return [token, *[token[:n] + b"*" if len(token) > n else token for n in STEMS]]
    word = token.decode("utf-8", "surrogatepass")
    return [token, *[word[:n].encode("utf-8", "surrogatepass") + b"*" if len(word) > n else token for n in STEMS]]


class _Features:
    """Token to a row of ``rows``: the places of its features in a vocabulary, 0 for those that aren't there."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.row: dict[bytes, int] = {}
        self.rows = np.zeros((1024, 1 + len(STEMS)), dtype=np.int32)

    def learn(self, tokens: list[bytes]) -> None:
        first = len(self.row)
        while first + len(tokens) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        place = self.vocabulary.get
        self.rows[first : first + len(tokens)] = [[place(f, 0) for f in features_of(t)] for t in tokens]
        self.row.update(zip(tokens, range(first, first + len(tokens)), strict=True))


_features = _Features({})


def token_rows(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Rows of _features, one a token of the whole text. Between texts a bounded number of tokens is remembered."""
    global _features
    if _features.vocabulary is not vocabulary or len(_features.row) > REMEMBERED:
        _features = _Features(vocabulary)
    tokens = tokens_of(text)
    at = np.fromiter(map(_features.row.get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
    unknown = np.flatnonzero(at < 0).tolist()
    if unknown:
        _features.learn(list(dict.fromkeys([tokens[k] for k in unknown])))
        at[unknown] = [_features.row[tokens[k]] for k in unknown]
    return at


def token_places(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """[token, feature]."""
    at = token_rows(text, vocabulary)
    return _features.rows[at]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bounded part of a batch at a time; at the end the tokens of the task are forgotten."""
    global _features
    yield from slices(batches)
    _features = _Features({})
    _row_scores.clear()
    give_back()


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in order: the linear-time scan of Ruzzo and Tompa.

    Runs of scores of one sign are added up first, so the loop runs over runs of positive scores only.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)]).tolist()
    fresh = np.concatenate([[True], positive[1:] != positive[:-1] + 1])
    first, last = positive[fresh], positive[np.append(fresh[1:], True)]
    found: list[list] = []  # first, last, sum before, sum after, place of the nearest one to the left with a lower sum before
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        now = [a, b, total[a], total[b + 1], -1]
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= now[2]:
                k = found[k][4]  # all between have a sum before that is higher still
            if k < 0 or found[k][3] >= now[3]:
                now[4] = k
                found.append(now)
                break
            now = [found[k][0], now[1], found[k][2], now[3], -1]
            del found[k:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


def best_segment(scores: np.ndarray) -> float:
    """The highest score of any segment; 0 if none is positive."""
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    return float((total - np.minimum.accumulate(total)).max())


#: For a scorer's table: the table, the features that its row scores belong to, these scores, and how many are filled.
_row_scores: dict[int, tuple[np.ndarray, _Features, np.ndarray, int]] = {}


@dataclass(frozen=True)
class Scorer:
    """Scores by place in the vocabulary (0: all other features), and the extreme-value law: in clean text of n tokens,
    K n exp(-rate s) segments of a score over s are to be expected. Without a fit K and the rate are 1, as for scores that
    are logarithms of likelihood ratios.
    """

    vocabulary: dict[bytes, int]
    scores: np.ndarray
    log_k: float = 0.0
    rate: float = 1.0

    def of_text(self, text: str | None) -> np.ndarray:
        """A score a token: the highest of its features. Scores of remembered tokens are looked up once."""
        at = token_rows(text, self.vocabulary)
        scores, features, known, filled = _row_scores.get(id(self.scores), (None, None, np.zeros(0, dtype=np.float32), 0))
        if scores is not self.scores or features is not _features or len(known) != len(_features.rows):
            known, filled = np.zeros(len(_features.rows), dtype=np.float32), 0
            if len(_row_scores) > 3:
                _row_scores.clear()
        if filled < len(_features.row):
            known[filled : len(_features.row)] = self.scores[_features.rows[filled : len(_features.row)]].max(axis=1)
        _row_scores[id(self.scores)] = (self.scores, _features, known, len(_features.row))
        return known[at]

    def best(self, text: str | None) -> tuple[float, int]:
        """The best segment's score and the number of tokens."""
        scores = self.of_text(text)
        return best_segment(scores), len(scores)

    def evidence(self, text: str | None) -> tuple[float, float]:
        """log(1 + x) of the best segment's, and of all significant segments', scores x beyond what chance gives in a text this long."""
        scores = self.of_text(text)
        chance = self.log_k + math.log(max(1, len(scores)))
        if self.rate * scores[scores > 0].sum(dtype=np.float64) <= chance:
            return 0.0, 0.0  # not even all positive scores together are beyond it, so no segment is
        beyond = [self.rate * s - chance for _, _, s in maximal_segments(scores)]
        significant = [b for b in beyond if b > -math.log(MOST_EXPECTED_SCORED)]
        return math.log1p(max([0.0, *beyond])), math.log1p(sum(significant))


@dataclass(frozen=True)
class Model:
    scorer: Scorer
    weights: tuple[float, float, float]

    def score(self, text: str | None) -> float:
        best, all_ = self.scorer.evidence(text)
        z = self.weights[0] + self.weights[1] * best + self.weights[2] * all_
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Characters (from, to) and expected number by chance of each significant segment."""
        text = text or ""
        # Lower-casing may change lengths, so offsets are found in the original text token by token.
        raw = text.encode("utf-8", "surrogatepass")
        spans = [m.span() for m in TOKEN.finditer(raw)]
        scores = np.concatenate([np.zeros(0, dtype=np.float32), *[self.scorer.of_text(raw[a:b].decode("utf-8", "surrogatepass"))[:1] for a, b in spans]])
        place = lambda k: len(raw[:k].decode("utf-8", "surrogatepass"))
        chance = self.scorer.log_k + math.log(max(1, len(spans)))
        out = []
        for a, b, s in maximal_segments(scores):
            expected = math.exp(min(50.0, chance - self.scorer.rate * s))
            if expected < MOST_EXPECTED:
                out.append((place(spans[a][0]), place(spans[b][1]), expected))
        return out


def training_part(id_col: str = "doc_id"):
    """True for rows whose label may be learnt from: crc32 of the id as text isn't divisible by 5."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 != 0


def _labelled(labels: DataFrame) -> DataFrame:
    """id, toxic (0 or 1), fold; at most MOST_LABELLED rows, one per id; contradictory and null labels don't count."""
    one = labels.filter("doc_id is not null and toxic in (0, 1)").filter(training_part()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most")
    part = F.xxhash64(F.lit(5), "doc_id")
    return smallest(stored(one), part, MOST_LABELLED).select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic"), F.pmod(part, F.lit(2)).cast("int").alias("fold"))


def _labelled_counts(labelled: DataFrame) -> DataFrame:
    """feature, and its occurrences in clean and toxic rows of each fold: c0, c1, t0, t1."""
    names = ["c0", "c1", "t0", "t1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter[bytes]] = [Counter() for _ in names]

        def counts() -> pa.RecordBatch:
            sums: dict[bytes, list[int]] = {}
            for k, tokens in enumerate(found):
                for token, n in tokens.items():
                    for f in features_of(token):
                        sums.setdefault(f, [0] * len(names))[k] += n
                tokens.clear()
            columns = zip(*sums.values(), strict=True) if sums else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(sums, type=pa.binary()), *[pa.array(c, type=pa.int64()) for c in columns]], ["feature", *names])

        for part in _slices(batches):
            for text, toxic, fold in zip(*part.columns, strict=True):
                found[2 * toxic.as_py() + fold.as_py()].update(tokens_of(text.as_py()))
            if sum(map(len, found)) > REMEMBERED:
                yield counts()
        yield counts()

    partial = labelled.select("text", "toxic", "fold").mapInArrow(run, "feature binary, " + ", ".join(f"{n} long" for n in names))
    return partial.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])


def _seen(docs: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """How often each feature of the vocabulary occurs in all documents, by its place; at place 0 all others together."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        counts = np.zeros(len(places) + 1, dtype=np.int64)
        found: list[np.ndarray] = []
        for part in _slices(batches):
            for text in part.column(0):
                found.append(token_places(text.as_py(), places).ravel())
            if sum(map(len, found)) > HELD:  # adding up costs a pass over all counts
                counts += np.bincount(np.concatenate(found), minlength=len(counts))
                found.clear()
        if found:
            counts += np.bincount(np.concatenate(found), minlength=len(counts))
        place = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(counts[place])], ["place", "n"])

    seen = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for r in docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        seen[r["place"]] = r["n"]
    shared.destroy()
    return seen


def _scorer(vocabulary: dict[bytes, int], seen: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> Scorer:
    """Log-odds of the features from their counts (by place) and the counts of all features together."""
    scores = np.full(len(vocabulary) + 1, math.log(1 - TOXIC_SHARE), dtype=np.float32)
    if not n_toxic or not n_clean:
        return Scorer(vocabulary, scores)
    prior = seen / seen.sum() * PRIOR_STRENGTH
    t, c = toxic + prior, clean + prior
    # The odds at the near ends of both counts' confidence intervals.
    t, c = t - CONFIDENCE * np.sqrt(t), c + CONFIDENCE * np.sqrt(c)
    use = (toxic >= LEAST_COUNT) & (t > 0)
    use[0] = False
    odds = lambda x, total: np.log(x / (total + PRIOR_STRENGTH - x))
    low = odds(t[use], n_toxic) - odds(c[use], n_clean)
    scores[np.flatnonzero(use)[low > 0]] = np.log(1 - TOXIC_SHARE + TOXIC_SHARE * np.exp(np.minimum(low[low > 0], 20.0)))
    return Scorer(vocabulary, scores)


def extreme_value_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(log K, rate) from the best scores of clean texts of n tokens each.

    Beyond a high threshold, scores less what their text's length gives fall as exp(-rate x): the rate is that of the median
    excess, which few wrongly labelled texts don't move, K what makes the share beyond the threshold right. (0, 1) where
    there is too little to fit.
    """
    some = best > 0
    share = min(TAIL, some.sum() / (2 * max(1, len(best))))
    rate, log_k = 1.0, 0.0
    for _ in range(8):  # the length's part depends on the rate
        x = np.sort(best[some] - np.log(np.maximum(1, n[some])) / rate)
        most = int(share * len(best))
        if most < LEAST_TAIL:
            return 0.0, 1.0
        threshold = float(x[-most - 1]) if most < len(x) else float(x[0])
        middle = float(np.median(x[-most:])) - threshold
        if middle <= 0:
            return 0.0, 1.0
        rate = min(MOST_RATE, max(1 / MOST_RATE, math.log(2) / middle))
        log_k = rate * threshold + math.log(share)
    return log_k, rate


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows of the training part. ``docs`` has doc_id and text, ``labels`` doc_id and toxic.

    Without toxic or without clean labels the score of every text is the share of toxic labels.
    """
    short_batches(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    sample = stored(_labelled(labels))
    counts = stored(_labelled_counts(slim.join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))))
    names = ["c0", "c1", "t0", "t1"]
    totals = dict(zip(names, (float(x or 0) for x in counts.agg(*[F.sum(k) for k in names]).first()), strict=True))
    # Of the labelled rows' features, those that can get a score: bounded by the sample, whatever the corpus.
    known = counts.filter(F.col("t0") + F.col("t1") >= LEAST_COUNT).orderBy("feature").collect()
    vocabulary = {bytes(r["feature"]): k for k, r in enumerate(known, 1)}
    by = {k: np.array([0, *[r[k] for r in known]], dtype=np.float64) for k in names}
    seen = _seen(slim, vocabulary)
    whole = _scorer(vocabulary, seen, by["t0"] + by["t1"], by["c0"] + by["c1"], totals["t0"] + totals["t1"], totals["c0"] + totals["c1"])
    # A fold is scored by what the other one taught.
    by_fold = [_scorer(vocabulary, seen, by[t], by[c], totals[t], totals[c]) for t, c in (("t1", "c1"), ("t0", "c0"))]

    few = F.broadcast(smallest(sample, F.xxhash64(F.lit(6), "__id"), MOST_CALIBRATED))
    chosen = stored(slim.join(few, F.col("doc_id") == F.col("__id")).select("text", "toxic", "fold", "__id"))

    def of_each(what) -> tuple[np.ndarray, ...]:
        """Label and two figures of each chosen row's text. Rows that share an id count once, so no more are collected than ids were chosen."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _slices(batches):
                rows = [(i.as_py(), y.as_py(), *map(float, what(f.as_py(), t.as_py()))) for t, y, f, i in zip(*part.columns, strict=True)]
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.float64(), pa.float64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in columns], ["id", "toxic", "one", "two"])

        found = chosen.mapInArrow(run, "id long, toxic int, one double, two double")
        rows = found.groupBy("id").agg(F.min(F.struct("toxic", "one", "two")).alias("row")).orderBy("id").select("row.*").collect()
        return tuple(np.array([r[k] for r in rows], dtype=np.float64) for k in range(3))

    y, best, n = of_each(lambda fold, text: by_fold[fold].best(text))
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1e-6
        return Model(whole, (math.log(share / (1 - share)), 0.0, 0.0))
    log_k, rate = extreme_value_law(best[y == 0], n[y == 0])
    fitted = [replace(s, log_k=log_k, rate=rate) for s in by_fold]
    y, best, total = of_each(lambda fold, text: fitted[fold].evidence(text))
    return Model(replace(whole, log_k=log_k, rate=rate), tuple(_rising_logistic(np.stack([np.ones(len(y)), best, total], axis=1), y).tolist()))


def _rising_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of which none but the intercept (column 0) is negative: more evidence never lowers a score. Features that would have such are left out."""
    w = _logistic(x, y)
    use = np.append(True, w[1:] >= 0)
    if not use.all():
        w = np.zeros(len(w))
        w[use] = _logistic(x[:, use], y)
    return np.append(w[:1], np.maximum(w[1:], 0.0))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small penalty on all but the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-9] + [ridge] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_documents(docs: DataFrame, model: Model, score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` (a column of that name in any case is replaced) and the score of the whole text; null texts count as empty."""
    docs = docs.drop(score_col)
    short_batches(docs.sparkSession)
    plain, at = with_plain_names(docs), docs.columns.index("text")
    names = plain.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            score = pa.array([shared.value.score(t.as_py()) for t in part.column(at)], type=pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, score], [*names, "score"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])).toDF(*docs.columns, score_col)


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and, for each significant toxic passage, its characters (first, end), text and expected number by chance."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("end", pa.int64()), ("passage", pa.string()), ("expected", pa.float64())])
        for batch in batches:
            rows = [(i.as_py(), a, b, (t.as_py() or "")[a:b], e) for i, t in zip(*batch.columns, strict=True) for a, b, e in shared.value.passages(t.as_py())]
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], schema=kind)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, first long, end long, passage string, expected double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Empty and null texts get the score of a text without any toxic segment. Rows with a null doc_id are
    scored like others and are not held out. Repeated rows get equal scores. Labels of ids that aren't
    in ``docs``, null labels and ids with contradictory labels teach nothing. Only doc_id and text are read.
    """
    slim = docs.select("doc_id", "text")
    scored = score_documents(slim, train(slim, labels)).drop("text")
    return scored.select("doc_id", F.coalesce(~training_part(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""
    model = train(docs.select("doc_id", "text"), labels)
    score = free_name(docs, "score")
    return score_documents(docs, model, score).filter(F.col(score) < threshold).select(*own_columns(docs))
