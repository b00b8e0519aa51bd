"""Line de-duplication by pairwise alignment of overlapping documents.

A line is deleted from a document if the alignment with any earlier document that shares a line with it
matches it. Documents are aligned by patience diff: lines unique in both are matched in order by a longest
increasing subsequence, and between such anchors equal ends are matched and the rest is split again; what has no
line unique in both is aligned by a longest common subsequence. All is judged on the input, not on what is left.

Not all pairs need to be aligned for that. First each document is aligned with the first holder of each of its
lines: one link per holder. Only documents with a shared line that is still there are aligned further: a copy with the
first document of equal lines, any other with all holders of its rare lines, and with one document for each class
of those that hold the frequent line. A class has equal sequences of frequent and blank lines and of gaps in between. Where no
rare line is shared its members match the same lines, and where the class's first document does share
one, all members are aligned.
"""

from __future__ import annotations

import logging
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.llm.common import keyed_documents, lookup, numbered_rows, stored

#: Links of one document that are aligned in one task; more are spread.
LINKS_A_TASK = 200

#: A line with more holders is frequent: its holders are dealt with by classes.
RARE = 64
log = logging.getLogger(__name__)

#: Rows of a batch that are unpacked at once.
UNPACKED = 256

BLANK = (0, 0)
GAP = (0, 1)


def line_hash(line: str) -> tuple[int, int]:
    """128 bits of the line without surrounding white space, as two signed longs; BLANK if nothing is left."""
    raw = line.strip().encode("utf-8", "surrogatepass")
    return _two_longs(raw) if raw else BLANK


def _two_longs(raw: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(raw)
    high, low = h >> 64, h & (1 << 64) - 1
    return high - (1 << 64) * (high >> 63), low - (1 << 64) * (low >> 63)


def _longest_rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for k, v in enumerate(values):
        where = bisect_left(tails, v)
        if where == len(tails):
            tails.append(v)
            at.append(k)
        else:
            tails[where], at[where] = v, k
        back[k] = at[where - 1] if where else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def _longest_common(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j) of a longest common subsequence, by rows of bits; one row in the root of their number is kept and the others are made again."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full, width = (1 << len(b)) - 1, isqrt(len(a)) + 1

    def step(row: int, x) -> int:
        hit = row & places.get(x, 0)
        return ((row + hit) | (row - hit)) & full

    marks = [row := full]
    for i, x in enumerate(a, 1):
        row = step(row, x)
        if i % width == 0:
            marks.append(row)
    out, i, j, block, rows = [], len(a), len(b), -1, []
    while i and j:
        for at in (i, i - 1):
            if at // width != block:
                block = at // width
                rows = [marks[block]]
                for x in a[block * width : (block + 1) * width - 1]:
                    rows.append(step(rows[-1], x))
            if rows[at - block * width] >> (j - 1) & 1:  # the column adds nothing to the row
                if at == i:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
                break
        else:
            i -= 1
    return out[::-1]


def patience_matches(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j), rising in both, of lines that patience diff aligns."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a.get(x) == 1}
        anchors = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x in place]
        anchors = [anchors[k] for k in _longest_rising([j for _, j in anchors])]
        if not anchors:
            left = [i for i in range(a0, a1) if a[i] in in_b]
            right = [j for j in range(b0, b1) if b[j] in in_a]
            out += [(left[i], right[j]) for i, j in _longest_common([a[i] for i in left], [b[j] for j in right])]
            continue
        # Each gap begins with its anchor, which the next round matches as an equal end.
        edges = [(a0, b0), *anchors, (a1, b1)]
        todo += [(i0, i1, j0, j1) for (i0, j0), (i1, j1) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, UNPACKED) for batch in batches for k in range(0, batch.num_rows, UNPACKED))


def _digest(lines: list[tuple[int, int]]) -> tuple[int, int]:
    return _two_longs(np.array(lines, dtype=np.int64).tobytes())


def _sequences(docs: DataFrame) -> DataFrame:
    """key, high, low: the hashes of all lines, in order; all_high, all_low: the hash of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in _slices(batches):
            lines = [[line_hash(x) for x in t.as_py().split("\n")] for t in batch.column(1)]
            whole = [_digest(x) for x in lines]
            columns = [pa.array([[h for h, _ in x] for x in lines], type=longs), pa.array([[h for _, h in x] for x in lines], type=longs), pa.array([h for h, _ in whole], type=pa.int64()), pa.array([h for _, h in whole], type=pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "high", "low", "all_high", "all_low"])

    return docs.select("key", "text").mapInArrow(run, "key long, high array<long>, low array<long>, all_high long, all_low long")


def _pairs_of_longs(high: pa.ListArray, low: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """The lines of each row, made one row at a time."""
    highs, lows = high.values.to_numpy(), low.values.to_numpy()
    starts, others = high.offsets.to_numpy().tolist(), low.offsets.to_numpy().tolist()
    for i, j, k in zip(starts, starts[1:], others, strict=False):
        yield list(zip(highs[i:j].tolist(), lows[k : k + j - i].tolist(), strict=True))


def _routed(links: DataFrame) -> DataFrame:
    """host, task, guest, host_is_first: the end of a link that has more links is the host, to which the other one comes.

    By that a document is guest no more often than the root of twice the number of links, and the lines of one with very many
    links are sent once for LINKS_A_TASK of them.
    """
    ends = stored(links.select(F.explode(F.array("first", "key")).alias("end")).groupBy("end").agg(F.count("*").alias("n")))
    total = max(1, 2 * links.count())
    known = stored(lookup(links, ends.select(F.col("end").alias("first"), F.col("n").alias("of_first")), ["first"], "of_first", total))
    known = lookup(known, ends.select(F.col("end").alias("key"), F.col("n").alias("of_key")), ["key"], "of_key", total)
    host_is_first = F.col("of_first") >= F.col("of_key")
    tasks = F.ceil(F.greatest("of_first", "of_key") / LINKS_A_TASK).cast("int")
    host, guest = F.when(host_is_first, F.col("first")).otherwise(F.col("key")), F.when(host_is_first, F.col("key")).otherwise(F.col("first"))
    return stored(known.select(host.alias("host"), F.pmod(F.xxhash64(guest), tasks).cast("int").alias("task"), guest.alias("guest"), host_is_first.alias("host_is_first")))


def _aligned(links: DataFrame, sequences: DataFrame) -> DataFrame:
    """key, line, first: the lines of ``key`` that are matched in the alignment with ``first``."""
    routed = _routed(links)
    lines = lambda name: sequences.select(F.col("key").alias(name), "high", "low").hint("merge")  # noqa: E731  the same plan at every size
    hosts = routed.select("host", "task").distinct().join(lines("host"), "host").select("host", "task", F.lit(None).cast("long").alias("guest"), F.lit(None).cast("boolean").alias("host_is_first"), "high", "low")
    guests = routed.join(lines("guest"), "guest").select("host", "task", "guest", "host_is_first", "high", "low")
    # The host's row, whose guest is null, comes first; its guests stream by.
    dealt = hosts.unionByName(guests).repartition("host", "task").sortWithinPartitions("host", "task", F.col("guest").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[int, int]] = []
        for batch in _slices(batches):
            found: list[tuple[int, int, int]] = []
            hosts, guests, flags = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for host, guest, is_first, other in zip(hosts, guests, flags, _pairs_of_longs(*batch.columns[4:]), strict=True):
                if guest is None:
                    own = other
                elif is_first:
                    found += [(guest, j, host) for _, j in patience_matches(own, other) if other[j] != BLANK]
                else:
                    found += [(host, j, guest) for _, j in patience_matches(other, own) if own[j] != BLANK]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], type=pa.int64()), pa.array(columns[1], type=pa.int32()), pa.array(columns[2], type=pa.int64())], ["key", "line", "first"])

    return dealt.mapInArrow(run, "key long, line int, first long")


def _classes(sequences: DataFrame, frequent: DataFrame) -> DataFrame:
    """key, c_high, c_low: the hash of each document's frequent and blank lines and the gaps between them. ``frequent`` has key, high, low."""
    held = frequent.groupBy("key").agg(F.collect_list(F.struct("high", "low")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = []
            for high, low, held in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                seen, kept = {(x["high"], x["low"]) for x in held} | {BLANK}, []
                for line in zip(high, low, strict=True):
                    if line in seen:
                        kept.append(line)
                    elif not kept or kept[-1] != GAP:
                        kept.append(GAP)
                found.append(_digest(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in found], type=pa.int64()), pa.array([h for _, h in found], type=pa.int64())], ["key", "c_high", "c_low"])

    return sequences.join(held, "key").select("key", "high", "low", "held").mapInArrow(run, "key long, c_high long, c_low long")


def _near_links(sequences: DataFrame, lines: DataFrame, shared: DataFrame, open_: DataFrame, rare: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first, key: what documents with open lines are to be aligned with besides the first holders: the first one of their copies, or all
    holders of their rare lines; the same for rare lines only; first, key: all copies). open_ has key, high, low, n."""
    line = ["high", "low"]
    equal = stored(sequences.groupBy("all_high", "all_low").agg(F.min("key").alias("first"), F.count("*").alias("n")))
    open_keys = stored(open_.select("key").distinct())
    whole = lookup(sequences.select("key", "all_high", "all_low"), equal, ["all_high", "all_low"], "n", max(1, sequences.count()))
    copies = stored(whole.filter("first < key").select("first", "key"))
    of_copies = copies.join(open_keys, "key", "left_semi").select("first", "key")
    open_keys = stored(open_keys.join(copies, "key", "left_anti"))
    wanted = shared.filter(F.col("n") <= rare).join(open_keys, "key", "left_semi").select("key", *line)
    holders = lines.join(copies, "key", "left_anti").withColumnRenamed("key", "first")
    partners = stored(wanted.join(holders, line).filter("first < key").select("first", "key").distinct())
    return of_copies.unionByName(partners).distinct(), partners, copies


def _numbered_firsts(firsts_of_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(high, low, place, first: the class firsts of each line in their order, from 0; high, low, most: how many a line has).

    A sort in ranges numbers all of them, so the firsts of one line, maybe as many as documents, are never in one task.
    """
    rows = numbered_rows(firsts_of_lines, [F.col("high"), F.col("low"), F.col("first")], "__at")
    starts = stored(rows.groupBy("high", "low").agg(F.min("__at").alias("start"), F.count("*").alias("most")))
    known = lookup(rows, starts, ["high", "low"], "most", max(1, rows.count()))
    return stored(known.select("high", "low", (F.col("__at") - F.col("start")).alias("place"), "first")), starts.select("high", "low", "most")


#: Class firsts that an open line is tried with in the first round; each further one takes twice as many.
FIRST_TRIES = 2


def _found_by_classes(sequences: DataFrame, lines: DataFrame, holders: DataFrame, open_: DataFrame, partners: DataFrame, copies: DataFrame, done: DataFrame, matched: DataFrame, rare: int) -> list[DataFrame]:
    """key, line, first, in rounds: open frequent lines are tried with one document a class of equal surroundings, the earliest first.

    A round aligns a few candidates a line; lines that are matched are tried no more. So the links are in proportion to the lines as
    long as some of the first candidates match, however many classes there are; a line that none of them matches is tried with all.
    """
    line = ["high", "low"]
    lines = stored(lines.join(copies, "key", "left_anti"))
    frequent = stored(lookup(lines, holders.filter(F.col("n") > rare), line, "n", max(1, lines.count())).select("key", *line))
    classes = stored(_classes(sequences, frequent))
    firsts = stored(classes.groupBy("c_high", "c_low").agg(F.min("key").alias("first")))
    placed, most = _numbered_firsts(stored(frequent.join(firsts, F.col("key") == F.col("first"), "left_semi").select(*line, F.col("key").alias("first"))))
    uses = stored(open_.filter(F.col("n") > rare).join(copies, "key", "left_anti").join(most, line).select("key", *line, "most"))
    found, tried, from_, tries = [], done, 0, FIRST_TRIES
    while not uses.isEmpty():
        wanted = stored(uses.withColumn("place", F.explode(F.sequence(F.lit(from_).cast("long"), F.least(F.lit(from_ + tries).cast("long"), F.col("most")) - 1))).select("key", *line, "place"))
        counts = placed.join(wanted.groupBy(*line, "place").agg(F.count("*").alias("n")), [*line, "place"])
        now = stored(lookup(wanted, stored(counts), [*line, "place"], "n", max(1, wanted.count())).filter("first < key").select("key", *line, "first"))
        by_class = now.select("first", "key").distinct()
        # A partner doesn't stand for its class: all members are aligned.
        doubtful = by_class.join(partners, ["first", "key"], "left_semi").join(firsts, "first").select("key", "c_high", "c_low")
        members = doubtful.join(classes.withColumnRenamed("key", "first"), ["c_high", "c_low"]).filter("first < key").select("first", "key")
        links = stored(by_class.unionByName(members).distinct().join(tried, ["first", "key"], "left_anti"))
        log.info("line dedup: %d links with class firsts %d to %d", links.count(), from_, from_ + tries - 1)
        found.append(stored(_aligned(links, sequences)))
        matched = matched.unionByName(found[-1].select("key", "line"))
        tried = stored(tried.unionByName(links))
        from_, tries = from_ + tries, 2 * tries
        # A line goes on where it stands unmatched somewhere in its document, and earlier firsts are left.
        spots = sequences.join(uses.select("key").distinct(), "key", "left_semi").select("key", F.posexplode(F.arrays_zip("high", "low")).alias("line", "at")).select("key", "line", "at.high", "at.low")
        still = spots.join(matched, ["key", "line"], "left_anti").select("key", *line).distinct()
        earlier = now.groupBy("key", *line).agg(F.count("*").alias("n"))
        uses = stored(uses.join(still, ["key", *line], "left_semi").join(earlier, ["key", *line]).filter((F.col("n") == tries // 2) & (F.col("most") > from_)).select("key", *line, "most"))
    return found


def find_repeated_lines(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """key, line (number from 0), first (an earlier document): the lines of each document to be deleted. ``docs`` has unique keys in the order of documents, and text."""
    sequences = stored(_sequences(docs))
    lines = stored(sequences.select("key", F.explode(F.array_distinct(F.arrays_zip("high", "low"))).alias("line")).select("key", "line.high", "line.low").filter("high != 0 or low != 0"))
    holders = stored(lines.groupBy("high", "low").agg(F.count("*").alias("n"), F.min("key").alias("first")).filter("n > 1"))
    shared = stored(lookup(lines, holders, ["high", "low"], "n", max(1, lines.count())).filter("first < key"))
    links = stored(shared.select("first", "key").distinct())
    found = stored(_aligned(links, sequences))
    spots = stored(sequences.join(links.select("key"), "key", "left_semi").select("key", F.posexplode(F.arrays_zip("high", "low")).alias("line", "at")).select("key", "line", "at.high", "at.low"))

    def open_lines(found: DataFrame) -> DataFrame:
        left = spots.join(found, ["key", "line"], "left_anti").join(shared.select("key", "high", "low", "n"), ["key", "high", "low"])
        return stored(left.select("key", "high", "low", "n").distinct())

    open_ = open_lines(found)
    if open_.isEmpty():
        return found
    near, partners, copies = _near_links(sequences, lines, shared, open_, rare)
    near = stored(near.join(links, ["first", "key"], "left_anti"))
    more = stored(_aligned(near, sequences).join(found, ["key", "line"], "left_anti"))
    matched = stored(found.select("key", "line").unionByName(more.select("key", "line")).distinct())
    parts = [more, *_found_by_classes(sequences, lines, holders, open_lines(matched), partners, copies, stored(links.unionByName(near)), matched, rare)]
    for part in parts[1:]:
        more = more.unionByName(part)
    more = more.join(found, ["key", "line"], "left_anti").groupBy("key", "line").agg(F.min("first").alias("first"))
    return found.unionByName(more)


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, removed (sorted line numbers), n_earlier, kept (text).

    n_earlier counts the first holders that removed lines are aligned with, and for each line that none of them
    matches the first of the other documents looked at that does.

    Lines end at a newline. Blank lines are never deleted, and lines are equal if they are without
    surrounding white space. A null text counts as empty: one blank line. Rows with a null doc_id come first, and
    rows that share a doc_id are documents of their own, in the order of their texts' hashes. An empty table
    gives an empty result. Columns but the two named are not read.
    """
    keyed, ids = keyed_documents(docs, id_col, text_col)
    gone = find_repeated_lines(keyed).groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("removed"), F.count_distinct("first").cast("long").alias("n_earlier"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, kept = [], []
            for text, removed in zip(batch.column(1), batch.column(2), strict=True):
                lines, out = text.as_py().split("\n"), set(removed.as_py())
                n_lines.append(len(lines))
                kept.append("\n".join(x for k, x in enumerate(lines) if k not in out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, type=pa.int64()), batch.column(2), batch.column(3), pa.array(kept, type=pa.string())], ["key", "n_lines", "removed", "n_earlier", "kept"])

    found = keyed.join(gone, "key", "left").select("key", "text", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("n_earlier", F.lit(0).cast("long")).alias("n_earlier"))
    out = found.mapInArrow(run, "key long, n_lines long, removed array<int>, n_earlier long, kept string")
    if ids is None:
        return out.withColumnRenamed("key", "doc_id")
    return out.join(ids, "key").select("doc_id", "n_lines", "removed", "n_earlier", "kept")


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_earlier, kept_sha256."""
    out = remove_repeated_lines(docs)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_earlier", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
