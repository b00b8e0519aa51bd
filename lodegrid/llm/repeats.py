"""Removal of long byte strings that repeat earlier ones, by a hash-compared suffix sort.

Two equal strings of ``width`` bytes have their least k-gram (by hash; the leftmost of equals) at
the same place. So each window of ``width`` bytes is dealt out by the hash of its least k-gram, in
runs of windows that share one; a run whose k-gram occurs nowhere else is done. The other
runs bring their bytes along. In a task, the suffixes that start at windows with the same k-gram at the
same offset are sorted by a merge sort whose comparisons find the length of the common extension by
binary search over prefix polynomial hashes. The order and the equalities found are verified byte by byte;
the earliest of equal windows stays, the bytes of all others go.

A k-gram of a third of all documents would bring all their runs to one task. So equal runs of a chunk of text collapse before
they are dealt out: all but the earliest are removed for certain and go elsewhere. What is left of a hot k-gram is
dealt out window by window, by the hash of the window: equal ones still meet, others spread. Which
k-grams are hot is asked of a sample of documents; it only decides how rows are dealt out, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.llm.common import give_back, keyed_documents, lookup, short_batches, stored

WIDTH = 100
GRAM = 24
#: Bytes of text or of runs that are hashed together; positions in them fit 21 bits.
CHUNK = 1 << 20
#: Runs with their bytes among which a task looks for equal ones before it sends them.
HELD_RUNS = 100_000
#: Runs of one k-gram in a chunk from which on equal ones are looked for there.
MANY = 4
#: Documents that are asked for hot k-grams, about: those that have at least 1 / HOT_SHARE of the sample's runs.
SAMPLED_DOCS = 20_000
HOT_SHARE = 5000
_BITS = np.uint64((1 << 21) - 1)
_BASE = 0x9E3779B97F4A7C15
_TOP = 1 << 21


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers 0 .. n of an odd base modulo 2**64."""
    global _powers
    if len(_powers) <= n:
        _powers = np.full(n + 1, _BASE, dtype=np.uint64)
        _powers[0] = 1
        _powers = np.multiply.accumulate(_powers)
    return _powers[: n + 1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Times a falling power, the difference of two of these is a hash of the bytes between, wherever they stand."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[:-1], out=out[1:])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs_of(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts with up to CHUNK bytes together: for each run of windows the hash of its least k-gram, text, first window, windows, and the k-gram's offset from the first."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    w = width - gram + 1
    down = powers(_TOP)[::-1]
    prefix = prefix_hashes(data)
    n = max(0, len(data) - gram + 1)
    h = _mixed((prefix[gram:] - prefix[:-gram]) * down[:n]) if n else np.zeros(0, dtype=np.uint64)
    packed = (h & ~_BITS) | np.arange(n, dtype=np.uint64)
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    begin = 0
    for t, text in enumerate(texts):
        m = len(text) - gram + 1  # k-grams of this text
        q = m - w + 1  # windows
        if q > 0:
            rows = -(-m // w)
            grid = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
            grid[:m] = packed[begin : begin + m]
            grid = grid.reshape(rows, w)
            ahead = np.minimum.accumulate(grid, axis=1).ravel()[w - 1 : w - 1 + q]
            behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:q]
            least = (np.minimum(behind, ahead) & _BITS).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            anchor = least[first]
            out[0].append(h[anchor])
            out[1].append(np.full(len(first), t))
            out[2].append(first)
            out[3].append(np.diff(np.append(first, q)))
            out[4].append(anchor - begin - first)
        begin += len(text)
    kinds = (np.uint64, np.int64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=k) for x, k in zip(out, kinds, strict=True))


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Keys, offsets and bytes of texts; long texts in pieces that share width - 1 bytes, so that each window is in one."""
    keys, offsets, texts, size = [], [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(raw) - width + 1), CHUNK):
                part = raw[at : at + CHUNK + width - 1]
                if size and size + len(part) > CHUNK:
                    yield keys, offsets, texts
                    keys, offsets, texts, size = [], [], [], 0
                keys.append(key)
                offsets.append(at)
                texts.append(part)
                size += len(part)
    yield keys, offsets, texts


def _elsewhere(key: int, first: int) -> int:
    """A place in the exchange for a run that is removed for certain."""
    return xxhash.xxh64_intdigest(b"%d/%d" % (key, first)) - (1 << 63)


def _dealt(found: tuple[np.ndarray, ...], own: np.ndarray, at: np.ndarray, texts: list[bytes], width: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """gram, key, first, shape of the runs of a chunk. Equal runs of a frequent k-gram but the earliest are joined to rows with a negative shape; the windows of hot k-grams are runs of their own."""
    m, t, first, n, d = found
    gram, key, begin, shape = m.view(np.int64), own[t], first + at[t], n * 256 + d
    order = np.argsort(gram, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]])) if len(gram) else np.zeros(0, dtype=np.int64)
    size = np.repeat(np.diff(np.append(cut, len(gram))), np.diff(np.append(cut, len(gram))))
    is_hot = np.isin(gram, hot)
    looked = np.zeros(len(gram), dtype=bool)
    looked[order] = size >= MANY
    earliest: dict[bytes, int] = {}
    certain = np.zeros(len(gram), dtype=bool)
    for k in np.flatnonzero(looked | is_hot).tolist():
        content = texts[t[k]][first[k] : first[k] + n[k] + width - 1]
        e = earliest.setdefault(content, k)
        if e != k:
            if (key[k], begin[k]) < (key[e], begin[e]):
                earliest[content], k = k, e
            certain[k] = True
    more: list[tuple[int, int, int, int]] = []
    single = [k for k in earliest.values() if is_hot[k]]
    for k in single:
        content = texts[t[k]][first[k] : first[k] + n[k] + width - 1]
        more += [(xxhash.xxh64_intdigest(content[j : j + width]) - (1 << 63), int(key[k]), int(begin[k]) + j, 256 + int(d[k]) - j) for j in range(int(n[k]))]
    gone = np.flatnonzero(certain)
    if len(gone):  # runs that follow one another are one
        cut = np.concatenate([[True], (np.diff(gone) != 1) | (np.diff(t[gone]) != 0)])
        for a, b in zip(gone[cut].tolist(), gone[np.append(cut[1:], True)].tolist(), strict=True):
            more.append((_elsewhere(int(key[a]), int(begin[a])), int(key[a]), int(begin[a]), -256 * int(begin[b] + n[b] - begin[a])))
    whole = ~certain
    whole[single] = False
    added = np.array(more, dtype=np.int64).reshape(-1, 4)
    return tuple(np.concatenate([x[whole], added[:, c]]) for c, x in enumerate((gram, key, begin, shape)))


def _run_rows(docs: DataFrame, width: int, gram: int, hot: np.ndarray) -> DataFrame:
    """gram, key, first, shape (windows * 256 + offset of the k-gram; negative if the run is removed for certain) of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, offsets, texts in _pieces(batches, width):
            own, at = np.array(keys, dtype=np.int64), np.array(offsets, dtype=np.int64)
            columns = _dealt(runs_of(texts, width, gram), own, at, texts, width, hot)
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns[:3]], pa.array(columns[3].astype(np.int32))], ["gram", "key", "first", "shape"])
        give_back()

    return docs.select("key", "text").mapInArrow(run, "gram long, key long, first long, shape int")


def _hot_grams(docs: DataFrame, width: int, gram: int) -> np.ndarray:
    """k-grams that many runs of a sample of documents share; HOT_SHARE at most."""
    every = max(1, docs.count() // SAMPLED_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _pieces(batches, width):
            kinds, n = np.unique(runs_of(texts, width, gram)[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], ["gram", "n"])

    some = docs.filter(F.pmod(F.xxhash64(F.lit(8), "key"), F.lit(every)) == 0)
    counts = stored(some.select("key", "text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r["gram"] for r in counts.filter(F.col("n") >= max(MANY, total / HOT_SHARE)).select("gram").collect()], dtype=np.int64))


_BYTES = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("first", pa.int64()), ("shape", pa.int32()), ("content", pa.binary())])


def _with_bytes(docs: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """The bytes that the windows of each run span. Of equal runs in a batch only the earliest has them; the rest, with null, is removed for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            earliest: dict[bytes, int] = {}
            for key, text, found in zip(*batch.columns, strict=True):
                raw, key = text.as_py().encode("utf-8", "surrogatepass"), key.as_py()
                for r in found.as_py():
                    if r["shape"] < 0:
                        rows.append((r["gram"], key, r["first"], -r["shape"], None))
                        continue
                    content = raw[r["first"] : r["first"] + r["shape"] // 256 + width - 1]
                    row = (r["gram"], key, r["first"], r["shape"], content)
                    k = earliest.setdefault(content, len(rows))
                    if k < len(rows):
                        if (key, r["first"]) < rows[k][1:3]:
                            rows[k], row = row, rows[k]
                        row = (_elsewhere(*row[1:3]), *row[1:4], None)
                    rows.append(row)
                    if len(rows) >= HELD_RUNS:
                        yield _batch(rows)
                        rows, earliest = [], {}
            if rows:
                yield _batch(rows)

    per_doc = runs.groupBy("key").agg(F.collect_list(F.struct("gram", "first", "shape")).alias("runs"))
    return docs.join(per_doc, "key").select("key", "text", "runs").mapInArrow(run, "gram long, key long, first long, shape int, content binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _BYTES, strict=True)], schema=_BYTES)


class SuffixSorter:
    """Suffixes of one buffer, compared on their first ``width`` bytes."""

    def __init__(self, data: np.ndarray, width: int):
        self.data, self.width, self.prefix = data, width, prefix_hashes(data)
        self.down = powers(len(data))[::-1]
        self.steps = [1 << k for k in range(width.bit_length() - 1, -1, -1)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over prefix hashes."""
        length = np.zeros(len(a), dtype=np.int64)
        for step in self.steps:
            i, j = a + length, b + length
            fits = length + step <= self.width
            ie, je = np.where(fits, i + step, i), np.where(fits, j + step, j)
            same = (self.prefix[ie] - self.prefix[i]) * self.down[i] == (self.prefix[je] - self.prefix[j]) * self.down[j]
            length += step * (same & fits)
        return length

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        length = self.common(a, b)
        equal = length == self.width
        last = len(self.data) - 1
        return np.where(equal, or_equal, self.data[np.minimum(a + length, last)] < self.data[np.minimum(b + length, last)])

    def shared(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Places, in their order, of the suffixes whose hash another one of their segment has: one of its own equals no other and needs no sort."""
        h = (self.prefix[at + self.width] - self.prefix[at]) * self.down[at]
        order = np.lexsort((h, segment))
        h, segment = h[order], segment[order]
        same = (h[1:] == h[:-1]) & (segment[1:] == segment[:-1])
        return np.sort(order[np.append(same, False) | np.append(False, same)])

    def sort(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """A stable order of the suffixes ``at`` within segments that stand together: bottom-up merge sort, all merges of a level at once."""
        n = len(at)
        order = np.arange(n)
        start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if n else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(start, n))
        base, whole = np.repeat(start, size), np.repeat(size, size)
        run = 1
        while n and run < size.max():
            live = np.flatnonzero(whole > run)  # slots of segments that aren't sorted yet
            place = live - base[live]
            half = place // run
            left = half % 2 == 0
            low = base[live] + np.where(left, half + 1, half - 1) * run
            high = np.minimum(low + run, base[live] + whole[live])
            low = np.minimum(low, high)
            own, lo, hi = at[order[live]], low.copy(), high.copy()
            # How many of the sibling run come first: those before a left item, those before or equal to a right one.
            while True:
                todo = np.flatnonzero(lo < hi)
                if not len(todo):
                    break
                middle = (lo[todo] + hi[todo]) // 2
                first = self.before(at[order[middle]], own[todo], ~left[todo])
                lo[todo] = np.where(first, middle + 1, lo[todo])
                hi[todo] = np.where(first, hi[todo], middle)
            merged = base[live] + (half // 2) * 2 * run + place % run + (lo - low)
            new = order.copy()
            new[merged] = order[live]
            order, run = new, 2 * run
        return order

    def verified(self, a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> bool:
        """Whether each suffix of ``a`` is before that of ``b`` or, where ``equal`` says so and only there, equal to it: byte by byte."""
        strings = np.lib.stride_tricks.sliding_window_view(self.data, self.width)
        for k in range(0, len(a), 8192):
            x, y = strings[a[k : k + 8192]], strings[b[k : k + 8192]]
            differs = x != y
            place = differs.argmax(axis=1)
            rows = np.arange(len(x))
            same = ~differs[rows, place]
            if not ((same == equal[k : k + 8192]) & (same | (x[rows, place] < y[rows, place]))).all():
                return False
        return True


def repeated_windows(rows: list[tuple[int, int, int, int, bytes]], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of each window that equals an earlier one. Rows are (gram, key, first, shape, content) in this order."""
    data = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])[:-1]])
    shape = np.array([r[3] for r in rows], dtype=np.int64)
    n, d = shape // 256, shape % 256
    gram = np.array([r[0] for r in rows], dtype=np.int64)
    group = np.cumsum(np.concatenate([[False], gram[1:] != gram[:-1]]))
    row = np.repeat(np.arange(len(rows)), n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    segment = group[row] * 256 + (d[row] - window)
    # Rows are in the order of key and first, so a stable sort by segment leaves each in the order of position.
    order = np.argsort(segment, kind="stable")
    ends = np.concatenate([[True], segment[order][1:] != segment[order][:-1], [True]])
    order = order[~(ends[:-1] & ends[1:])]
    row, window, segment = row[order], window[order], segment[order]
    at = begin[row] + window
    sorter = SuffixSorter(data, width)
    some = sorter.shared(at, segment)
    row, window, segment, at = row[some], window[some], segment[some], at[some]
    by_text = sorter.sort(at, segment)
    a, b = by_text[:-1], by_text[1:]
    near = np.flatnonzero(segment[a] == segment[b])
    equal = sorter.common(at[a[near]], at[b[near]]) == width
    if not sorter.verified(at[a[near]], at[b[near]], equal):
        return _by_bytes(rows, row, window, segment, width)
    later = b[near[equal]]
    return row[later], window[later]


def _by_bytes(rows: list[tuple], row: np.ndarray, window: np.ndarray, segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes, for the rare block in which two strings have one hash."""
    seen, later = set(), []
    for k, (r, p, s) in enumerate(zip(row.tolist(), window.tolist(), segment.tolist(), strict=True)):
        text = (s, rows[r][4][p : p + width])
        if text in seen:
            later.append(k)
        seen.add(text)
    return row[later], window[later]


_SPANS = pa.schema([("key", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _spans(runs: DataFrame, width: int, partitions: int | None) -> DataFrame:
    """key, begin, end of what is removed. Equal runs of a k-gram collapse as they stream by; the distinct ones are sorted in blocks of whole k-grams."""

    def solved(rows: list[tuple]) -> list[tuple[int, int, int]]:
        if len(rows) < 2:
            return []
        row, window = repeated_windows(rows, width)
        if not len(row):
            return []
        order = np.lexsort((window, row))
        row, window = row[order], window[order]
        cut = np.concatenate([[True], (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)])
        first, last = np.flatnonzero(cut), np.append(np.flatnonzero(cut)[1:], len(row)) - 1
        return [(rows[r][1], rows[r][2] + a, rows[r][2] + b + width) for r, a, b in zip(row[first].tolist(), window[first].tolist(), window[last].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        block: list[tuple] = []  # distinct runs of k-grams with at least two
        group: list[tuple] = []
        seen: set[bytes] = set()
        size, gram = 0, None
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[0] != gram:
                    if len(group) > 1:
                        size += sum(len(x[4]) for x in group)
                        block += group
                    if size > CHUNK // 2:
                        out += solved(block)
                        block, size = [], 0
                    gram, group, seen = r[0], [], set()
                if r[4] is None or r[4] in seen:
                    out.append((r[1], r[2], r[2] + r[3] // 256 + width - 1))
                else:
                    seen.add(r[4])
                    group.append(r)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], schema=_SPANS)
                out = []
        out += solved(block + (group if len(group) > 1 else []))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], schema=_SPANS)

    dealt = runs.repartition("gram") if partitions is None else runs.repartition(partitions, "gram")
    return dealt.sortWithinPartitions("gram", "key", "first").mapInArrow(run, "key long, begin long, end long")


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _later_copies(docs: DataFrame) -> DataFrame:
    """key, end: documents whose whole text is an earlier one's, and their numbers of bytes."""
    slim = stored(docs.select("key", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("end")))
    groups = stored(slim.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    return stored(lookup(slim, groups, ["digest"], "n", max(1, slim.count())).filter("key > first").select("key", "end"))


def find_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, partitions: int | None = None) -> DataFrame:
    """key, spans (array of begin, end; in no order, may overlap) of documents with removed bytes. ``docs`` has unique keys in the order of documents.

    Whole copies are found first: all their windows are in the earliest copy, so they neither need runs nor
    make those of others repeat. All joins need the texts by key, and one exchange of them serves all.
    """
    short_batches(docs.sparkSession)
    copies = _later_copies(docs)
    runs = _run_rows(docs.join(copies, "key", "left_anti"), width, gram, _hot_grams(docs, width, gram))
    together = runs.withColumn("n", F.expr("count(*) over (partition by gram)")).filter("n > 1 or shape < 0").drop("n")
    spans = _spans(_with_bytes(docs, together, width), width, partitions)
    spans = spans.unionByName(copies.filter(F.col("end") >= width).select("key", F.lit(0).cast("long").alias("begin"), "end"))
    return spans.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, removed (array of maximal spans, begin and end in bytes), kept (binary).

    A null text counts as empty. Texts shorter than ``width`` bytes stay whole. Rows with a null doc_id come
    first, and rows that share a doc_id are documents of their own, in the order of their texts' hashes. What is
    kept may begin or end within a character, so it is binary. Columns but the two named are not read.
    """
    keyed, ids = keyed_documents(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n_bytes, removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                cut = merged_spans([(s["begin"], s["end"]) for s in spans.as_py() or []])
                edges = [0, *[x for span in cut for x in span], len(raw)]
                n_bytes.append(len(raw))
                removed.append([{"begin": a, "end": b} for a, b in cut])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, type=pa.int64()), pa.array(removed, type=kind), pa.array(kept, type=pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    found = keyed.join(find_repeats(keyed, width), "key", "left").select("key", "text", "spans")
    out = found.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<begin: long, end: long>>, kept binary")
    if ids is None:
        return out
    return out.withColumnRenamed("doc_id", "key").join(ids, "key").select("doc_id", "n_bytes", "removed", "kept")


def repeat_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(docs, width=width)
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
