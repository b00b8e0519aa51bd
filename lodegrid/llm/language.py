"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams of 1 to MAX_GRAM letters (a run of other characters is one
blank) that both hold, whatever their counts: a blended spectrum of presences, scaled to length 1. Nyström: texts are
compared with some hundred landmarks, so the n-grams of the landmarks are all that counts, and ridge regression, one
language versus the rest, is solved for one coefficient a landmark and language. The kernels of a batch of texts are the
product of their matrix of presences with that of the landmarks. For scoring, the product of the landmarks' matrix and the
coefficients is made once, as matrix products associate; a batch is then one product with that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.llm.common import give_back, short_batches, slices, small_table, stored, with_plain_names

MAX_GRAM = 4
#: Labelled rows that are learnt from, at most, in even shares of the languages; and those of them that are landmarks.
FIT_ROWS = 12_000
LANDMARKS = 384
#: The most languages that are learnt: those with most rows.
MOST_LANGUAGES = 256
#: Longer texts are learnt from only where a language has too few shorter ones. All are scored whole.
FIT_BYTES = 1 << 16
RIDGE = 1e-3
#: Kernel values of one language are about this steep in the score.
STEEPNESS = 4.0
#: Bytes of a matrix of presences, and entries of a table of transitions beyond which they are searched for.
MATRIX_BYTES = 1 << 24
TABLE_ENTRIES = 1 << 24
FIT_PARTITIONS = 16
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points in lower case, any run of characters that aren't letters being one blank; texts begin and end with one."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int32)
    codes[~_letters()[codes]] = 32
    return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


class Grams:
    """The n-grams of the landmarks, numbered from 0, as a trie: each gram is the gram of one letter less, and a letter."""

    def __init__(self, texts: list[np.ndarray]):
        # Characters are numbered from 1; 0 stands for those that no landmark holds, and parts texts.
        self.alphabet = np.unique(np.concatenate(texts)) if texts else np.zeros(0, dtype=np.int32)
        self.steps: list[np.ndarray] = []  # of each level from 2 on: sorted keys, gram before times letters plus letter
        chars = self._joined(texts)
        nodes = chars
        for _ in range(2, MAX_GRAM + 1):
            key = self._keys(nodes, chars)
            self.steps.append(np.unique(key[key >= 0]))
            nodes = self._find(len(self.steps) - 1, key)
        sizes = [len(self.alphabet), *map(len, self.steps)]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.n = int(self.first[-1])
        self._places: np.ndarray | None = None
        self._tables: list[np.ndarray | None] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_places": None, "_tables": []}

    def _chars(self, codes: np.ndarray) -> np.ndarray:
        if getattr(self, "_places", None) is None:
            self._places = np.zeros(0x110000, dtype=np.int32)
            self._places[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return self._places[codes]

    def _joined(self, texts: list[np.ndarray]) -> np.ndarray:
        apart = np.zeros(1, dtype=np.int32)
        return np.concatenate([x for t in texts for x in (self._chars(t), apart)] or [apart])

    def _keys(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Of the gram that ends at each place but the first; -1: none."""
        before, now = nodes[:-1].astype(np.int64), chars[-len(nodes) + 1 :] if len(nodes) > 1 else chars[:0]
        return np.where((before > 0) & (now > 0), before * (len(self.alphabet) + 1) + now, -1)

    def _find(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Numbers from 1 in the level; 0: not a gram of the landmarks."""
        known = self.steps[level]
        if not len(known):
            return np.zeros(len(keys), dtype=np.int32)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, at + 1, 0).astype(np.int32)

    def _next(self, level: int, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """As _find, by a table where one isn't too large."""
        if not self._tables:
            width = len(self.alphabet) + 1
            for k, keys in enumerate(self.steps):
                rows = (width if k == 0 else len(self.steps[k - 1]) + 1) * width
                table = None
                if rows <= TABLE_ENTRIES:
                    table = np.zeros(rows, dtype=np.int32)
                    table[keys] = np.arange(1, len(keys) + 1)
                self._tables.append(table)
        table = self._tables[level]
        if table is None:
            return self._find(level, self._keys(nodes, chars))
        return table[nodes[:-1].astype(np.int64) * (len(self.alphabet) + 1) + chars[-len(nodes) + 1 :]] if len(nodes) > 1 else nodes[:0]

    def presences(self, texts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(first text, matrix of 0 and 1: texts times grams), for some texts at a time."""
        most = max(1, MATRIX_BYTES // (4 * max(self.n, 1)))
        for at in range(0, len(texts), most):
            part = texts[at : at + most]
            out = np.zeros((len(part), self.n), dtype=np.float32)
            chars = self._joined(part)
            rows = np.repeat(np.arange(len(part), dtype=np.int64) * self.n, [len(t) + 1 for t in part])
            nodes = chars
            for level in range(MAX_GRAM):
                if level:
                    nodes = self._next(level - 1, nodes, chars)
                held = np.flatnonzero(nodes)
                out.ravel()[rows[held + level] + self.first[level] + nodes[held] - 1] = 1.0
            yield at, out


@dataclass(frozen=True)
class Model:
    """Languages, the grams of the landmarks, and a weight for each gram and language."""

    languages: list[str]
    grams: Grams
    weights: np.ndarray

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language]: the sum over landmarks of coefficient times kernel."""
        out = np.zeros((len(texts), len(self.languages)))
        for at, held in self.grams.presences(texts):
            own = np.sqrt(np.maximum(held.sum(axis=1), 1.0))
            out[at : at + len(held)] = (held @ self.weights) / own[:, None]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        codes = [_codes(t or "") for t in texts]
        worded = [bool((c != 32).any()) for c in codes]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        z = STEEPNESS * self.scores(codes)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [(self.languages[k], float(row[k])) if w else (UNKNOWN, 0.0) for k, row, w in zip(best, p, worded, strict=True)]


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows that aren't learnt from: crc32 of the id as text leaves 1 when divided by 3. Null ids aren't held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """(languages, place, lang (its number), text): FIT_ROWS rows at most, in even shares of the languages, by hash.

    Rows are thinned out by hash, a little less than wanted, before they are ordered within a language, so no task meets more than a few
    times its share.
    """
    spark = docs.sparkSession
    rows = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64(F.lit(11), "doc_id", "text").alias("h"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return [], rows
    share = FIT_ROWS // len(languages)
    wanted = share + 6 * share**0.5 + 20
    least = [{"lang": r["lang"], "k": languages.index(r["lang"]), "bar": int(min(1.0, wanted / r["count"]) * (2**63 - 1024))} for r in counts]
    bars = F.broadcast(small_table(spark, least, "lang: string, k: int, bar: bigint"))
    few = rows.join(bars, "lang").filter(F.col("h").bitwiseAND(F.lit(2**63 - 1)) <= F.col("bar"))
    order = Window.partitionBy("k").orderBy((F.octet_length("text") > FIT_BYTES).cast("int"), "h", "text")
    return languages, stored(few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= share).select("place", F.col("k").alias("lang"), "text"))


def train(docs: DataFrame) -> Model:
    """Learn from (doc_id, text, lang): rows that aren't held out, with an id, a language and a letter."""
    languages, sample = _sample(docs)
    if not languages:
        return Model([], Grams([]), np.zeros((0, 0)))
    each = max(1, LANDMARKS // len(languages))
    marks = sample.filter(F.col("place") <= each).orderBy("lang", "place").collect()
    texts = list({r["text"]: _codes(r["text"]) for r in marks}.values())
    grams = Grams(texts)
    landmarks = np.concatenate([held for _, held in grams.presences(texts)]).astype(bool)
    lengths = np.sqrt(landmarks.sum(axis=1, dtype=np.float64))
    m, n = len(texts), len(languages)
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast((grams, np.packbits(landmarks, axis=1), lengths))  # of LANDMARKS texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, packed, lengths = shared.value
        against = np.unpackbits(packed, axis=1, count=grams.n).astype(np.float32).T
        sums: dict[int, list] = {}
        for part in slices(batches):
            of = np.array(part.column(0).to_pylist())
            codes = [_codes(t.as_py()) for t in part.column(1)]
            for at, held in grams.presences(codes):
                kernel = (held @ against).astype(np.float64) / np.sqrt(np.maximum(held.sum(axis=1), 1.0))[:, None] / lengths
                for k in np.unique(of[at : at + len(held)]):
                    rows = kernel[of[at : at + len(held)] == k]
                    squares, total = sums.setdefault(int(k), [np.zeros((m, m)), np.zeros(m)])
                    squares += rows.T @ rows
                    total += rows.sum(axis=0)
        for k, (squares, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], type=pa.int32()), pa.array([squares.ravel()]), pa.array([total])], ["lang", "squares", "sums"])
        give_back()

    # A language's rows meet in few tasks, so that few matrices of squares come back.
    spread = sample.repartition(FIT_PARTITIONS, "lang", F.col("place") % max(1, FIT_PARTITIONS // n))
    left, right = np.zeros((m, m)), np.zeros((n, m))
    parts = spread.select("lang", "text").mapInArrow(run, "lang int, squares array<double>, sums array<double>")
    totals = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    for r in parts.toLocalIterator():
        left += np.array(r["squares"]).reshape(m, m) / totals[r["lang"]]  # each language weighs the same
        right[r["lang"]] += np.array(r["sums"]) / totals[r["lang"]]
    among = np.concatenate([held @ landmarks.T.astype(np.float32) for _, held in grams.presences(texts)]).astype(np.float64) / lengths[:, None] / lengths
    targets = 2 * right - right.sum(axis=0)  # +1 for a language's own rows, -1 for those of the rest
    coefficients = np.linalg.solve(left + RIDGE * among + 1e-9 * np.trace(left) * np.eye(m), targets.T)
    weights = landmarks.T.astype(np.float32) @ (coefficients / lengths[:, None])
    return Model(languages, grams, weights.astype(np.float32))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` that aren't named lang_pred or score, and lang_pred and score of the whole text."""
    docs = docs.drop("lang_pred", "score")
    short_batches(docs.sparkSession)
    plain, at = with_plain_names(docs), docs.columns.index(text_col)
    names = plain.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the grams of LANDMARKS texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = shared.value.predict(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], [*names, "lang_pred", "score"])
        give_back()

    kinds = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *kinds])).toDF(*docs.columns, "lang_pred", "score")


def languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null texts and texts without any letter are ``und`` with score 0. A text none of whose n-grams a landmark holds gets
    the first language with an even score. Rows with a null doc_id are scored like others, aren't held out and teach
    nothing; repeated rows get equal predictions. Without rows to learn from all is ``und``. Further columns aren't read.
    """
    model = train(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
