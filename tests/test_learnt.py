"""Word vectors learnt from tables, the cache by text, and the stateful stream."""

import math
from datetime import datetime

import numpy as np
import pandas as pd

from lodegrid.operators import embedding as E
from lodegrid.session import scratch
from lodegrid.streaming import streams


def corpus(spark, rng, n=400):
    """Two worlds of words that never meet."""
    words = [[f"a{k}" for k in range(12)], [f"b{k}" for k in range(12)]]
    return spark.createDataFrame([(k, " ".join(rng.choice(words[k % 2], 15))) for k in range(n)] + [(n, None), (n + 1, "")], "id long, t string")


def test_word_vectors_against_the_dense_matrix(spark):
    docs = corpus(spark, np.random.default_rng(1))
    model = E.word_vectors(docs, "t", vocabulary=100, dims=4)
    place, size = {w: k for k, w in enumerate(model.words)}, len(model.words)
    counts = np.zeros((size, size))
    for r in docs.filter("t is not null").collect():
        at = [place[w] for w in r["t"].split()]
        for i, a in enumerate(at):
            for b in at[i + 1 : i + 1 + E.AROUND]:
                counts[a, b] += 1
                counts[b, a] += 1
    with np.errstate(divide="ignore"):
        pmi = np.maximum(0, np.log(counts * counts.sum() / counts.sum(axis=1)[:, None] / counts.sum(axis=1)))
    values = np.linalg.eigvalsh(pmi)
    leading = values[np.argsort(-np.abs(values))[:4]]
    assert np.allclose(np.sort((model.vectors**2).sum(axis=0)), np.sort(np.abs(leading)), rtol=1e-6)
    v = model(["a1 a2 a3", "a7 a8", "b1 b2", "unknown", ""])
    assert v[0] @ v[1] > 0.9 and abs(v[0] @ v[2]) < 0.3 and not v[3:].any()
    assert E.word_vectors(docs.limit(0), "t")(["a"]).shape == (1, E.DIMS)


def test_unchanged_texts_come_from_the_cache(spark):
    path = scratch(spark)
    frame = lambda *x: spark.createDataFrame([(y,) for y in x], "c string")
    state = lambda df: {r["code"]: r["cached"] for r in df.collect()}
    assert state(E.embedded(frame("one", "two", None, "two"), "c", path)) == {"one": False, "two": False}
    assert state(E.embedded(frame("two", "three"), "c", path)) == {"two": True, "three": False}
    assert state(E.embedded(frame("two"), "c", path, model="other")) == {"two": False}
    rows = {r["code"]: r["embedding"] for r in E.embedded(frame("one", "two", "three"), "c", path).collect()}
    assert all(np.allclose(v, E.trigrams([k])[0]) for k, v in rows.items()) and len(rows) == 3


class Store:
    """Values and maps as a handle gives them."""

    def __init__(self):
        self.values, self.timers = {}, []

    def getValueState(self, name, _schema):  # noqa: N802
        store = self.values

        class Value:
            exists = staticmethod(lambda: name in store)
            get = staticmethod(lambda: store[name])
            update = staticmethod(lambda v: store.__setitem__(name, v))
            clear = staticmethod(lambda: store.pop(name, None))

        return Value

    def getMapState(self, name, *_schemas):  # noqa: N802
        store = self.values.setdefault(name, {})

        class Map:
            containsKey = staticmethod(lambda k: k in store)  # noqa: N815
            updateValue = staticmethod(store.__setitem__)  # noqa: N815
            clear = staticmethod(store.clear)

        return Map

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def test_first_labels_and_their_timer():
    p, store = streams.FirstLabels(idle=1000), Store()
    p.init(store)
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = lambda *x: iter([pd.DataFrame(x, columns=["ts", "label"])])
    said = lambda out: [(r.first.second, None if r.label is None or isinstance(r.label, float) and math.isnan(r.label) else r.label) for pdf in out for r in pdf.rename(columns={"first": "first"}).itertuples()]
    assert said(p.handleInputRows((1,), rows((at(5), "x"), (at(7), "x"), (at(6), None)), None)) == [(5, None), (5, "x")]
    assert said(p.handleInputRows((1,), rows((at(3), "y"), (at(4), "x")), None)) == [(3, None), (3, "y")]
    assert store.timers == [int(pd.Timestamp(at(7)).timestamp() * 1000) + 1000]
    list(p.handleExpiredTimer((1,), None, None))
    assert said(p.handleInputRows((1,), rows((at(9), "x")), None)) == [(9, None), (9, "x")]


def test_stream_forgets_idle_entities(spark, tmp_path):
    """Three files in turn: an entity that isn't seen for long is forgotten and handed on again when it is back; the curve stays right."""
    folder, found = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user long, ts timestamp, label string"
    day = lambda d: datetime(2024, 1, d)
    batches = [[(1, day(1), "a"), (2, day(2), "a")], [(2, day(20), "b")], [(3, day(25), "c")], [(1, day(26), "a"), (1, day(26), "d")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    before = spark.conf.get(streams.STATE_STORE[0])
    spark.conf.set(*streams.STATE_STORE)
    try:
        for k in range(len(batches)):
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/[0-{k}]")
            rows = streams.first_labels(stream, "user", "ts", "label", late="1 day", idle=3 * 86_400_000)
            rows.writeStream.format("parquet").option("path", found).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(streams.STATE_STORE[0], before)
    kind = "entity long, first timestamp, label string"
    written = sorted((r["entity"], r["first"].day, r["label"] or "") for r in spark.read.schema(kind).parquet(found).collect())
    assert written == [(1, 1, ""), (1, 1, "a"), (1, 26, ""), (1, 26, "a"), (1, 26, "d"), (2, 2, ""), (2, 2, "a"), (2, 2, "b"), (3, 25, ""), (3, 25, "c")]
    curve = {r["entity"]: (r["rank"], r["new_count"], r["cumulative_count"]) for r in streams.curve_of(spark, found, kind).collect()}
    assert curve == {1: (1, 2, 2), 2: (2, 1, 3), 3: (3, 1, 4)}
