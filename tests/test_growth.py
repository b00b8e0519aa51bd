"""What only large tables showed: numbers with more digits, groups that grow with their tables."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lodegrid.functions import keys as K
from lodegrid.llm import common, repeats
from lodegrid import session
from lodegrid.operators import clustering as L
from lodegrid.operators import embedding
from lodegrid.operators import joins as J
from lodegrid.sources import readers
from lodegrid.streaming import streams


def test_preprint_numbers_keep_all_digits(spark):
    rows = spark.createDataFrame([("arXiv:2401.100013",), ("see arxiv/2401.1000131v2",), ("arXiv:2401.10013.",), ("arxiv/2401.1001",), ("arXiv:2401.100",)], "t string")
    assert [r[0] for r in rows.select(K.arxiv_id(F.col("t"))).collect()] == ["2401.100013", "2401.1000131", "2401.10013", "2401.1001", ""]


class Counted:
    """A handle's values and maps, and how often the store was asked."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def getValueState(self, name, _schema):  # noqa: N802
        return self.part(name)

    def getMapState(self, name, *_schemas):  # noqa: N802
        return self.part(name)

    def part(self, name):
        store = self.held.setdefault(name, {})

        def asks(f):
            def run(*x):
                self.asked += 1
                return f(*x)

            return staticmethod(run)

        class Part:
            exists, get, update = asks(lambda: None in store), asks(lambda: store[None]), asks(lambda v: store.__setitem__(None, v))
            containsKey, updateValue = asks(lambda k: k in store), asks(store.__setitem__)  # noqa: N815

        return Part


def test_labels_of_a_batch_take_few_calls_of_the_store(monkeypatch):
    monkeypatch.setattr(streams, "LISTED", 50)
    p, store = streams.FirstLabels(), Counted()
    p.init(store)
    batch = lambda *labels: iter([pd.DataFrame({"ts": [pd.Timestamp(2024, 1, 1)] * len(labels), "label": labels})])
    said = lambda *labels: [x for pdf in p.handleInputRows((1,), batch(*labels), None) for x in pdf["label"] if x is not None]
    assert said(*[f"a{k}" for k in range(40)]) == [f"a{k}" for k in range(40)]
    assert said(*[f"a{k}" for k in range(40)], "b") == ["b"]
    assert store.asked <= 6
    # Beyond what one value holds labels are kept and found one by one.
    more = [f"c{k}" for k in range(30)]
    assert said(*more, "b", "a7") == more
    assert said(*more, "b", "a7", "d") == ["d"]
    assert said("d", *more, "a39") == []


def test_windows_that_equal_no_other_are_not_sorted():
    rng = np.random.default_rng(3)
    alone = rng.integers(0, 256, 4000, dtype=np.uint8)
    data = np.concatenate([alone, alone[50:80]])
    sorter = repeats.SuffixSorter(data, 10)
    at = np.arange(len(data) - 9)
    assert at[sorter.shared(at, np.zeros(len(at), dtype=np.int64))].tolist() == [*range(50, 71), *range(4000, 4021)]
    assert not len(sorter.shared(at, at))


def test_few_rows_are_looked_up_by_one_broadcast(spark):
    rows, groups = spark.range(100).selectExpr("id", "id % 7 as k"), spark.range(5).selectExpr("id as k", "15L as n")
    out = common.lookup(rows, groups, ["k"], "n", 100)
    assert out.count() == 72 and out._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    many = common.lookup(rows, groups, ["k"], "n", common.FEW_ROWS + 1)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, out.collect()))


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_surroundings_come_in_batches_of_few_bytes(spark):
    spark.conf.set(BATCH_BYTES, str(1 << 30))
    texts = [["a", "b", "x", "a"], [], ["b"], ["c", "c", "a", "b", "c", "x", "x", "a"]]
    rows = spark.createDataFrame([(t,) for t in texts], "tokens array<string>").coalesce(1)
    words, expected = ["a", "b", "c"], Counter()
    for t in texts:
        for i, w in enumerate(t):
            for j in range(max(0, i - embedding.AROUND), min(len(t), i + embedding.AROUND + 1)):
                if i != j and w in words and t[j] in words:
                    expected[words.index(w), words.index(t[j])] += 1
    found = {(r["w"], r["c"]): r["n"] for r in embedding._surroundings(rows, words).collect()}
    assert found == dict(expected)
    assert int(spark.conf.get(BATCH_BYTES)) <= session.BATCH_BYTES


def test_blocks_of_bibtex_come_in_batches_of_few_bytes(spark):
    spark.conf.set(BATCH_BYTES, str(1 << 30))
    text = "".join(f"@article{{k{k}, title = {{T {k}}}}}\n" for k in range(readers.ENTRIES_AT_ONCE + 5))
    rows = spark.createDataFrame([("x/a.bib", bytearray(text.encode()))], "path string, content binary")
    assert [r["citekey"] for r in readers.parsed_bibtex(rows).orderBy("at").collect()] == [f"k{k}" for k in range(readers.ENTRIES_AT_ONCE + 5)]
    assert int(spark.conf.get(BATCH_BYTES)) <= session.BATCH_BYTES
    assert next(readers.each_entry(text))["citekey"] == "k0"


def test_short_bibtex_texts_are_parsed_together_and_by_many_tasks(spark):
    texts = [f"@article{{k{k}, title = {{T {k}}}}}\n".encode() for k in range(2 * readers.ENTRIES_AT_ONCE + 5)] + [b"@misc{long, note = {" + b"x" * readers.BLOCK_BYTES + b"}}", b"@misc{last, note = {\xe9}}"]
    given = pa.RecordBatch.from_pylist([{"path": "x.bib", "segment": 0, "content": t, "utf8": k < len(texts) - 1, "large": False} for k, t in enumerate(texts)])
    assert [b.num_rows for b in readers._entries_of(iter([given.slice(0, 10), given.slice(10)]))] == [2000, 2000, 6, 1]
    rows = spark.createDataFrame([("x.bib", bytearray(t)) for t in texts], "path string, content binary").coalesce(1)
    out = readers.parsed_bibtex(rows)
    assert len(out.inputFiles()) >= spark.sparkContext.defaultParallelism
    notes = {r["citekey"]: r["fields"] for r in out.collect()}
    assert len(notes) == len(texts) and notes["k7"] == {"title": "T 7"} and notes["last"] == {"note": "é"} and len(notes["long"]["note"]) == readers.BLOCK_BYTES


def test_pairs_of_one_key_are_dealt_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(J, "NAMES_AT_ONCE", 10)
    monkeypatch.setattr(J, "KEYS_AT_ONCE", 4)
    names = spark.createDataFrame([(k, f"x Brand#{k % 2}.pdf") for k in range(90)] + [(90, "x Brand#1.pdf"), (91, None)], "n int, name string").coalesce(1)
    keys = spark.createDataFrame([(k, "Brand#1.") for k in range(10)] + [(10, "Brand#0."), (11, "Brand#7."), (12, ""), (13, None)], "k int, key string").coalesce(1)
    out = J.contained_keys(names, "name", keys, "key")
    want = [(n, k) for n in range(91) for k in range(11) if (n % 2 == 1 or n == 90) == (k < 10)]
    assert sorted((r["n"], r["k"]) for r in out.select("n", "k").collect()) == want
    sizes = [n for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 5 and max(sizes) < len(want) / 2
    held = J._gram_candidates(names.select("name").distinct(), "name", keys, "key")[2]
    assert held.count() == 2


def test_tiles_are_compared_with_each_other_only(monkeypatch):
    """Two tiles take one product of their rows, not four; one tile half of its square."""
    seen = []

    class Counting(np.ndarray):
        def __matmul__(self, other):
            seen.append(self.shape[0] * other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    unit = L._unit
    monkeypatch.setattr(L, "_unit", lambda v: unit(v).view(Counting))
    v = np.random.default_rng(1).standard_normal((2000, 4))
    pdf = lambda tiles: pd.DataFrame({"v": list(v), "tile": tiles, "t0": min(tiles), "t1": max(tiles)})
    near = 1 - unit(v) @ unit(v).T < 0.2
    for tiles, most in ([3, 5] * 1000, 1000 * 1000), ([3] * 2000, 0.7 * 2000 * 2000):
        seen.clear()
        found = [(min(i, j), max(i, j)) for x in L._close(pdf(tiles), 0.2) for i, j in zip(x[0].tolist(), x[1].tolist(), strict=True)]
        assert sum(seen) <= most
        want = {(i, j) for i, j in np.argwhere(near).tolist() if i < j and (tiles[i] != tiles[j] or most > 1000 * 1000)}
        assert len(found) == len(want) and set(found) == want
