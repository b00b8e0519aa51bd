"""Ranked lexical search: postings by exact impact, processed score at a time, with proofs for stopping.

A first pass over the texts keeps, of each document, its length and how often it holds each term of the items; document
frequencies, and with them the weights of terms, are counted from that in Spark. In a second pass each task inverts its
documents in bounded blocks: the postings of a term are ordered by their exact impact (what the term adds to the score of
the document, a whole number). For each item the groups of equal impact of its terms are taken in falling order and
added up. That stops only when the bounds of what is left prove that no document outside a short list can be among the
best: no unseen one, since all that is left adds up to less than the k-th best so far, and no seen one outside the list.
The scores of the list are then completed from the documents themselves. The k-th best score of the blocks before bounds
the later ones of the task. Each task hands over k rows an item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.llm.common import give_back, short_batches, slices, stored

#: The most documents and postings that a task inverts at a time (or one document).
BLOCK_ROWS = 1 << 16
BLOCK_POSTINGS = 1 << 22
#: Items are searched for together as long as their terms, and TOP for each of them, are at most so many (or one item).
MOST_TERMS = 1 << 20
#: A round takes all impacts down to this share of the highest that is left, groups of equal impact never being parted.
FALL = 0.75
#: A list of candidates this many times as long as the result is short enough to be completed.
SHORT_LIST = 4
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20
#: ASCII letters (A-Z in lower case) and digits, and all bytes of characters beyond ASCII, make terms; others part them.
_APART = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, some at a time."""
    apart = text.translate(_APART)
    at = 0
    while at < len(apart):
        end = at + PIECE
        if end < len(apart):
            space = apart.rfind(b" ", at, end)
            if space < 0:
                space = apart.find(b" ", end)
            end = len(apart) if space < 0 else space + 1
        yield apart[at:end].split()
        at = end


def _items(items: DataFrame) -> DataFrame:
    """item (a number), item_id, terms: the distinct terms of each item's text; items without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            terms = [list(dict.fromkeys(t for piece in terms_of(x.as_py()) for t in piece)) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(terms, type=pa.list_(pa.binary()))], ["item", "item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    slim = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"item long, item_id {kind}, terms array<binary>").filter(F.size("terms") > 0)


def _passes(items: DataFrame, top: int) -> int:
    """Into how many parts by hash the items must go so that none is over twice MOST_TERMS (or one item)."""
    weight = F.size("terms") + F.lit(top)
    rows, total = items.agg(F.count("*"), F.sum(weight)).first()
    parts = max(1, -(-(total or 0) // MOST_TERMS))
    while 1 < parts < rows:
        largest = items.groupBy(F.pmod(F.xxhash64("item"), F.lit(parts))).agg(F.sum(weight).alias("w"), F.count("*").alias("n")).filter("n > 1").agg(F.max("w")).first()[0]
        if (largest or 0) <= 2 * MOST_TERMS:
            break
        parts *= 2
    return parts


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the vocabulary) and tfs of each document that has any term at all."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # MOST_TERMS bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(shared.value)}.get
        for part in slices(batches):
            ids, sizes, terms, tfs, ends = [], [], [], [], [0]
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                n, found = 0, Counter()
                for piece in terms_of(text.as_py()):
                    n += len(piece)
                    found.update(map(place, piece))
                if not n:
                    continue
                found.pop(None, None)
                ids.append(doc_id)
                sizes.append(n)
                terms.extend(found.keys())
                tfs.extend(found.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(x, type=pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(sizes, type=pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
        give_back()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a document's score: whole numbers of 64 bits throughout."""
    m = 50 + 50 * sizes * n_docs // n_terms
    return weights * (1_000_000_000 * tfs // (1000 * tfs + 20 * m))


class Block:
    """An inverted block: for each term its postings by falling impact, and the postings of each document."""

    def __init__(self, ids: np.ndarray, absent: np.ndarray, ends: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.absent, self.starts, self.ends = ids, absent, ends[:-1], ends[1:]
        self.terms, self.impact = terms, impact
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ends))
        some = np.flatnonzero(impact > 0)  # no impact, no score
        order = some[np.lexsort((-impact[some], terms[some]))]
        self.docs, self.by_impact = docs[order], impact[order]
        self.bounds = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.wanted = np.zeros(n_terms, dtype=bool)
        self.sums = np.zeros(len(ids), dtype=np.int64)
        self.rounds = self.taken = 0

    def best(self, item_terms: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): a list that holds all of the block's ``top`` best whose score is ``least`` or more."""
        at, end = self.bounds[item_terms].copy(), self.bounds[item_terms + 1]
        if (at == end).all():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        sums, touched = self.sums, []
        while True:
            left = at < end
            next_ = np.where(left, self.by_impact[np.minimum(at, len(self.by_impact) - 1)], 0)
            rest = int(next_.sum())  # no document can gain more than that
            if rest < max(least, int(sums.max())):  # else an unseen document may yet be the best
                seen = np.flatnonzero(sums)
                have = sums[seen]
                bar = max(least, int(np.partition(have, len(have) - top)[len(have) - top]) if len(have) >= top else 1)
                if rest < bar:
                    short = seen[have + rest >= bar]
                    if not rest or len(short) <= SHORT_LIST * top:
                        break
            level = max(1, int(next_.max() * FALL))
            for k in np.flatnonzero(next_ >= level):
                a, b = at[k], end[k]
                stop = a + int(np.searchsorted(-self.by_impact[a:b], -level, side="right"))
                docs = self.docs[a:stop]  # a document has one posting a term
                sums[docs] += self.by_impact[a:stop]
                touched.append(docs)
                at[k] = stop
            self.rounds += 1
        for docs in touched:
            self.taken += len(docs)
            sums[docs] = 0
        return short, self.scores(short, item_terms)

    def scores(self, docs: np.ndarray, item_terms: np.ndarray) -> np.ndarray:
        """Complete scores, from the documents' own postings."""
        if not len(docs):
            return np.zeros(0, dtype=np.int64)
        self.wanted[item_terms] = True
        sizes = self.ends[docs] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        total = np.concatenate([[0], np.cumsum(np.where(self.wanted[self.terms[at]], self.impact[at], 0))])
        self.wanted[item_terms] = False
        return total[ends] - total[ends - sizes]


def _leading(score: np.ndarray, ids: np.ndarray, absent: np.ndarray, top: int) -> np.ndarray:
    """Places of the best: highest score first, then smaller ids, null ids last."""
    return np.lexsort((ids, absent, -score))[:top]


def _blocks(batches: Iterator[pa.RecordBatch], n_vocabulary: int, weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Block]:
    def block(parts: list[pa.RecordBatch]) -> Block:
        whole = pa.Table.from_batches(parts).combine_chunks()
        ids, sizes, terms, tfs = (whole.column(k) for k in range(4))
        lengths = pc.list_value_length(terms).to_numpy().astype(np.int64)
        flat = terms.combine_chunks().flatten().to_numpy()
        each = impacts(weights[flat], tfs.combine_chunks().flatten().to_numpy().astype(np.int64), np.repeat(sizes.to_numpy(), lengths), n_docs, n_terms)
        return Block(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), np.concatenate([[0], np.cumsum(lengths)]), flat, each, n_vocabulary)

    parts, rows, postings = [], 0, 0
    for part in slices(batches, most_rows=BLOCK_ROWS, most_bytes=8 * BLOCK_POSTINGS):
        more = int(pc.sum(pc.list_value_length(part.column(2))).as_py() or 0)
        if parts and (rows + part.num_rows > BLOCK_ROWS or postings + more > BLOCK_POSTINGS):
            yield block(parts)
            parts, rows, postings = [], 0, 0
        parts.append(part)
        rows, postings = rows + part.num_rows, postings + more
    if parts:
        yield block(parts)


def _search(counts: DataFrame, chosen: list, vocabulary: list[bytes], top: int, item_id: str) -> DataFrame:
    """The best documents of each task for each of the chosen items: item, item_id, doc_id, score."""
    spark = counts.sparkSession
    n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the vocabulary
        weights[r["t"]] = weight(n_docs, r["count"])
    place = {t: k for k, t in enumerate(vocabulary)}
    items = [(r["item"], r["item_id"], np.array([place[bytes(t)] for t in r["terms"]], dtype=np.int64)) for r in chosen]
    shared = spark.sparkContext.broadcast((items, weights))  # MOST_TERMS bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))
        best = [none] * len(items)  # score, id, whether the id is null
        for block in _blocks(batches, len(weights), weights, n_docs, n_terms):
            for k, (_, _, terms) in enumerate(items):
                score, ids, absent = best[k]
                docs, more = block.best(terms, top, int(score[-1]) if len(score) == top else 1)
                if len(docs):
                    score, ids, absent = np.concatenate([score, more]), np.concatenate([ids, block.ids[docs]]), np.concatenate([absent, block.absent[docs]])
                    order = _leading(score, ids, absent, top)
                    best[k] = (score[order], ids[order], absent[order])
        for (item, name, _), (score, ids, absent) in zip(items, best, strict=True):
            if len(score):
                columns = [pa.array([item] * len(score), type=pa.int64()), pa.array([name] * len(score), type=kind), pa.array(ids, mask=absent), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])
        give_back()

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(item_id))
    return counts.filter(F.size("terms") > 0).mapInArrow(run, f"item long, item_id {item_id}, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` highest-scoring documents (doc_id, text) of each item (item_id, text).

    Equal scores are ranked by ascending doc_id, null ids last. Null texts are empty and match nothing; an item without a
    term that any document holds has no rows. Every row is an item or a document of its own, so rows that are repeated,
    or that share an id, are ranked each by itself. Empty tables give an empty result; further columns aren't read.
    """
    found = stored(_items(items))
    kind = items.schema["item_id"].dataType.simpleString()
    parts, out = _passes(found, top), None
    for part in range(parts):
        chosen = found.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()
        vocabulary = sorted({bytes(t) for r in chosen for t in r["terms"]})
        best = _search(stored(term_counts(docs, vocabulary)), chosen, vocabulary, top, kind)
        out = best if out is None else out.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
