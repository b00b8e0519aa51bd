"""Sharding, mixing, classifiers, neighbours, tokens and the pipeline: exact properties, brute force, held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegrid.llm import common, mixing, neighbours, quality, sentence_pieces, sharding, toxicity
from lodegrid.llm.queries import QUERIES, piece_model_path
from lodegrid.llm.sentence_pieces import PieceModel

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot int, score double, size int"


def frame(spark, rows):
    """(doc_id, text, source): documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 1, 0.5, 1) for i, t, s in rows], SCHEMA)


ODD = [(None, "a b", None), (3, None, "x"), (3, "", "x"), (4, "a b c", "x"), (4, "a b c", "x"), (None, "a b", "y")]


# -- sharding -----------------------------------------------------------------------------------------------------------
def check_shards(rows, n_rows, n_shards):
    sizes = [sum(r["shard"] == s for r in rows) for s in range(n_shards)]
    assert sum(sizes) == n_rows == len(rows) and max(sizes) - min(sizes) <= 1
    for s in range(n_shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


@pytest.mark.parametrize("n", [0, 1, 39, 1003])
def test_shards_are_exact(spark, n, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 7)
    df = frame(spark, [(k, "t", "s") for k in range(n)]).repartition(5)
    out = sharding.shuffle_into_shards(df, 40).collect()
    check_shards(out, n, 40)
    assert sorted(r["doc_id"] for r in out) == list(range(n))


def test_shards_of_odd_rows(spark):
    out = sharding.shuffle_into_shards(frame(spark, ODD), 4)
    assert out.columns == [c for c in frame(spark, ODD).columns if c not in ("shard", "slot")] + ["shard", "slot"]
    check_shards(out.collect(), len(ODD), 4)


def test_sharding_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    check_shards(rows, len(texts), 40)


def test_shards_are_written(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 50)
    sharding.write_shards(frame(spark, [(k, "t", "s") for k in range(403)]), 3, f"file://{tmp_path}/shards")
    sizes = {r["shard"]: (r["n"], r["last"]) for r in spark.read.parquet(f"file://{tmp_path}/shards").groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()}
    assert sorted(sizes.values()) == [(134, 133), (134, 133), (135, 134)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutations_are_permutations(n):
    at, sizes = np.arange(n), np.full(n, n)
    one, other = (sharding.permuted(at, sizes, np.full(n, s, dtype=np.uint64)) for s in (1, 2))
    assert sorted(one.tolist()) == sorted(other.tolist()) == list(range(n))
    assert n < 16 or (one != other).any()


def test_permutations_are_even():
    """Each place goes to each slot about as often as to any other."""
    counts = np.zeros((7, 7))
    for s in range(2000):
        counts[np.arange(7), sharding.permuted(np.arange(7), np.full(7, 7), sharding._mixed(np.full(7, s, dtype=np.uint64)))] += 1
    assert np.abs(counts / 2000 - 1 / 7).max() < 0.04


def test_rows_are_exchanged_once(spark):
    df = frame(spark, [(k, "t", "s") for k in range(100)]).repartition(3)
    plan = sharding.shuffle_into_shards(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan


def test_matrix_margins_and_law():
    rows = [5, 0, 17, 30, 8]
    total = np.zeros((5, 4))
    for seed in range(400):
        m = sharding.communication_matrix(rows, 4, seed)
        assert m.sum(axis=1).tolist() == rows and sorted(m.sum(axis=0).tolist()) == [15, 15, 15, 15]
        total += m
    assert np.allclose(total / 400, np.array(rows)[:, None] / 4, atol=0.6)


def test_large_draws_are_exact():
    rng = np.random.default_rng(1)
    colors = np.array([2 * 10**9, 10**9, 0, 10**6])
    out = common.draw_without_replacement(rng, colors, 50_000)
    assert out.sum() == 50_000 and out[2] == 0 and abs(out[0] - 33_322) < 700
    assert common.draw_without_replacement(rng, colors, int(colors.sum())).tolist() == colors.tolist()


# -- mixing -------------------------------------------------------------------------------------------------------------
def brute_targets(sizes, share=1.5, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, stopped, rest = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    while rest > 1e-9 and len(stopped) < len(names):
        free = [s for s in names if s not in stopped]
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in free:
            if target[s] > 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                stopped.add(s)
    return target


def test_mixing_meets_its_targets(spark):
    rng = random.Random(1)
    sources = ["a"] * 300 + ["b"] * 60 + ["c"] * 200 + ["é"] * 90 + [None] * 40 + ["Z"] * 5
    rows = [(k, " ".join(["w"] * rng.randint(0, 30)), s) for k, s in enumerate(sources)]
    df = frame(spark, rows)
    out = {r["doc_id"]: r for r in mixing.mixed_totals(df).collect()}
    sizes, taken = {}, {}
    for i, t, s in rows:
        assert out[i]["size"] == len(t.split()) and out[i]["taken"] in (0, out[i]["size"], 2 * out[i]["size"])
        sizes[s], taken[s] = sizes.get(s, 0) + out[i]["size"], taken.get(s, 0) + out[i]["taken"]
    want = brute_targets(sizes)
    for i, _, s in rows:
        assert out[i]["source_size"] == sizes[s] and out[i]["target"] == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixing.mixed_totals(df.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in out.items()}


def test_mix_deals_every_copy_to_one_shard(spark):
    facts, drawn = mixing.mix(frame(spark, [(k, "a b", "s" + str(k % 2)) for k in range(500)]), n_shards=5)
    rows = drawn.collect()
    assert len({(r["rid"], r["copy"]) for r in rows}) == len(rows) and {r["shard"] for r in rows} <= set(range(5))
    assert facts.count() == 500
    assert mixing.split_quotas([7, 0, 93], 6, 3).sum(axis=0).tolist() == [7, 0, 93]


def test_mixing_odd_rows(spark):
    out = mixing.mixed_totals(frame(spark, ODD)).collect()
    assert len(out) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mixed_totals(frame(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.mixed_totals(frame(spark, [(1, "", "s"), (2, None, "s")])).collect()} == {0}
    rows = mixing.mixed_rows(frame(spark, ODD))
    assert rows.columns == frame(spark, ODD).columns and rows.agg(F.sum(F.regexp_count("text", F.lit(r"\w+")))).first()[0] == sum(r["taken"] for r in out)


# -- classifiers --------------------------------------------------------------------------------------------------------
def brute_segments(x):
    """Maximal segments by their definition: the best segment (shortest of equals), then left and right of it."""
    if not len(x):
        return []
    best = max(((sum(x[a : b + 1]), a - b, -a, b) for a in range(len(x)) for b in range(a, len(x))))
    if best[0] <= 0:
        return []
    a, b = -best[2], best[3]
    return brute_segments(x[:a]) + [(a, b, best[0])] + [(p + b + 1, q + b + 1, s) for p, q, s in brute_segments(x[b + 1 :])]


def test_maximal_segments():
    rng = np.random.default_rng(2)
    for _ in range(150):
        x = np.round(rng.standard_normal(rng.integers(0, 12)) * 4, 3)
        got = toxicity.maximal_segments(x)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(x.tolist())]
        assert np.allclose([s for *_, s in got], [s for *_, s in brute_segments(x.tolist())])


def labelled(spark, n=600, seed=3):
    rng = random.Random(seed)
    usual = ["w" + str(k) for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(usual) for _ in range(rng.randint(5, 60))]
        toxic, poor = int(rng.random() < 0.25), int(rng.random() < 0.3)
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["vile", "nasty", "foulwei", "foulstra"]) for _ in range(3)]
        text = " ".join(w.upper() + "!!" for w in words) if poor else " ".join(words)
        rows.append((k, text, "s" + str(k % 3)))
        if k % 3:
            labels.append((k, 1 - poor, toxic))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: (q, t) for k, q, t in labels}


def accuracy(rows, truth):
    held = [r for r in rows if r["doc_id"] in truth and r["held_out"]]
    assert len(held) > 30 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert accuracy(rows, {k: t for k, (_, t) in truth.items()}) > 0.95
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    text = "w1 w2 w3 w4 w5 w6 w7 w8 Vile nasty vile foulx w9 w10 w11"
    found = model.passages(text)
    assert len(found) == 1 and "nasty" in text[found[0][0] : found[0][1]]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    rows = quality.quality(docs, labels).collect()
    assert accuracy(rows, {k: q for k, (q, _) in truth.items()}) > 0.95


def brute_toxicity(model, text):
    """Token by token, with segments by their definition."""
    import math
    import re

    tokens = re.findall(rb"[0-9A-Za-z_\x80-\xff]+", (text or "").lower().encode())
    stems = lambda t: [t.decode()[:n].encode() + b"*" for n in (4, 5) if len(t.decode()) > n]
    best_of = lambda t: max(model.scorer.scores[model.scorer.vocabulary.get(f, 0)] for f in {t, *stems(t)})
    beyond = [model.scorer.rate * s - model.scorer.log_k - math.log(max(1, len(tokens))) for _, _, s in brute_segments([float(best_of(t)) for t in tokens])]
    total = math.log1p(sum(b for b in beyond if b > -math.log(0.001)))
    z = model.weights[0] + model.weights[1] * math.log1p(max([0.0, *beyond])) + model.weights[2] * total
    return 1 / (1 + math.exp(-z))


def test_toxicity_against_brute_force(spark):
    docs, labels, _ = labelled(spark, 240)
    docs = docs.unionByName(frame(spark, [(900, "Vile, NASTY foulx w1 w2 vile w3 vile!", None), (901, "", None), (902, None, None), (903, "nasty " * 30 + "w1 " * 20 + "vile nasty vile", None)]))
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.toxicity(docs, labels).collect():
        assert r["score"] == pytest.approx(brute_toxicity(model, texts[r["doc_id"]]), abs=1e-6)


def test_tokens_are_counted_exactly(spark):
    """Each feature's counts in the labelled rows and in all documents are those of a plain count; stems are cut by characters."""
    docs, labels, _ = labelled(spark, 240)
    docs = docs.unionByName(frame(spark, [(1000 + k, "мерзкий мерзость w1 w2 Ärgerlich 呪い文字列だ", None) for k in range(40)]))
    labels = labels.unionByName(spark.createDataFrame([(1000 + k, 0, 1) for k in range(40)], labels.schema))
    model, seen = toxicity.train(docs.select("doc_id", "text"), labels), {}
    for r in docs.collect():
        for t in toxicity.tokens_of(r["text"]):
            word = t.decode()
            for f in [t, *[word[:n].encode() + b"*" if len(word) > n else t for n in (4, 5)]]:
                seen[f] = seen.get(f, 0) + 1
    places = model.scorer.vocabulary
    found = toxicity._seen(docs, places)
    assert sorted(places.values()) == list(range(1, len(places) + 1))
    assert all(found[k] == seen[f] for f, k in places.items()) and found.sum() == sum(seen.values())
    assert {"мерз*".encode(), "мерзк*".encode(), "呪い文字*".encode(), "vile".encode()} <= set(places)
    assert model.score("w3 w4 w5 мерзавец мерзкий мерзость w6") > model.score("w3 w4 w5 мед мер мел w6")


def test_extreme_value_law_is_found():
    """Best scores of n tokens drawn from a law with known parameters, a few of them wrongly labelled, and too few to fit."""
    rng = np.random.default_rng(3)
    n = rng.integers(20, 400, 20_000)
    for rate, k in ((1.6, 0.3), (0.8, 0.05)):
        best = np.maximum(0, (np.log(k * n) - np.log(-np.log(rng.random(len(n))))) / rate)
        best[:20] = 50.0
        log_k, found = toxicity.extreme_value_law(best, n)
        assert found == pytest.approx(rate, rel=0.15) and log_k == pytest.approx(np.log(k), abs=0.8)
    assert toxicity.extreme_value_law(np.zeros(1000), n[:1000]) == (0.0, 1.0)
    assert toxicity.extreme_value_law(np.zeros(0), n[:0]) == (0.0, 1.0)
    assert toxicity.extreme_value_law(np.full(1000, 2.0), np.full(1000, 5)) == (0.0, 1.0)


def test_more_evidence_never_lowers_a_score():
    rng = np.random.default_rng(5)
    one = rng.random(2000) * 3
    for two in (one + rng.random(2000) * 0.1, 3 - one, rng.random(2000)):
        y = (one > 1.5).astype(float)
        w = toxicity._rising_logistic(np.stack([np.ones(2000), one, two], axis=1), y)
        assert w[1] >= 0 and w[2] >= 0 and w[1] + w[2] > 0


def brute_quality(rows):
    """Co-training in memory with dense matrices: rows of (content, meta, quality or None, pooled, u), the labelled ones in their order."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def matrix(of):
        names = {f: k for k, f in enumerate(sorted(set().union(*[r[of] for r in rows])))}
        x = np.zeros((len(rows), len(names) + 1))
        for i, r in enumerate(rows):
            x[i, [names[f] for f in r[of]]] = 1 / np.sqrt(max(1, len(r[of])))
        return x

    x = [matrix(0), matrix(1)]
    known = [i for i, r in enumerate(rows) if r[2] is not None]
    n_kept = max(1, int(len(known) * 0.25))
    held, taught = known[:n_kept], known[n_kept:]
    w, square = [np.zeros(m.shape[1]) for m in x], [np.full(m.shape[1], 1e-8) for m in x]
    train = [[(i, rows[i][2]) for i in taught] for _ in x]  # by view
    logits = lambda v: x[v][:, :-1] @ w[v][:-1] + w[v][-1]

    def step(v):
        i, y = np.array([a for a, _ in train[v]]), np.array([b for _, b in train[v]], dtype=float)
        weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        error = (sigmoid(logits(v)[i]) - y) * weight
        g = np.append(x[v][i, :-1].T @ error + 1e-4 * w[v][:-1], error.sum())
        square[v] += g * g
        w[v] -= 0.5 * g / np.sqrt(square[v])

    for v in (0, 1):
        for _ in range(quality.STEPS):
            step(v)
    free = [i for i, r in enumerate(rows) if r[3]]
    pooled, share = len(free), np.mean([rows[i][2] for i in taught])
    for _ in range(quality.ROUNDS):
        n = min(int(quality.HANDED * pooled), len(free) // 2)
        if not n:
            break
        n_good, gone = round(n * share), set()
        for v in (0, 1):
            place = {i: int(np.floor((z + 30) * 1000)) for i, z in zip(free, logits(v)[free], strict=True)}
            for many, sign, label in ((n - n_good, 1, 0), (n_good, -1, 1)):
                levels = sorted(set(place.values()), key=lambda b: b * sign)
                left = many
                for b in levels:
                    inside = [i for i in free if place[i] == b]
                    taken = inside if len(inside) <= left else [i for i in inside if rows[i][4] < left / len(inside)]
                    taken = [i for i in taken if (b >= 30_000) == bool(label)]
                    train[1 - v] += [(i, label) for i in taken]
                    gone |= set(taken)
                    left -= len(inside)
                    if left <= 0:
                        break
        free = [i for i in free if i not in gone]
        for _ in range(quality.FURTHER_STEPS):
            for v in (0, 1):
                step(v)
    y = np.array([rows[i][2] for i in held])

    def fit(z):
        a = np.zeros(z.shape[1])
        penalty = np.diag([1e-9] + [0.1] * (z.shape[1] - 1))
        for _ in range(200):
            p = sigmoid(z @ a)
            a += np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ a)
        return a

    one = np.ones(len(rows))
    calibrated = []
    for v in (0, 1):
        z = np.stack([one, logits(v)], axis=1)
        calibrated.append(z @ fit(z[held]))
    both = np.stack([one, *calibrated], axis=1)
    return sigmoid(both @ fit(both[held]))


def test_quality_against_brute_force(spark):
    import xxhash

    docs, labels, _ = labelled(spark, 260)
    docs = docs.unionByName(frame(spark, [(1000 + k, f"w{k} w{k + 1} W{k}!!", "rare") for k in range(60)]))
    rows = quality.featured(docs, labels).collect()
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(bytes(r["content"]) + bytes(r["meta"])))
    unpack = lambda raw: np.frombuffer(bytes(raw), dtype="<u2").tolist()
    want = brute_quality([(unpack(r["content"]), unpack(r["meta"]), r["quality"], r["pooled"], r["u"]) for r in rows])
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    assert max(abs(got[r["doc_id"]] - x) for r, x in zip(rows, want, strict=True)) < 1e-6


def test_all_unlabelled_documents_take_part(spark):
    docs, labels, _ = labelled(spark, 300)
    more = frame(spark, [(1000 + k, f"w{k} w{k + 1}", "rare") for k in range(8500)] + [(None, "w1 w2", None)])
    rows = quality.featured(docs.unionByName(more), labels)
    model = quality.train(rows)
    assert model.pooled == 100 + 8501
    counts = quality._histograms([], model.views, rows.filter("pooled"))
    assert counts.sum(axis=1).tolist() == [8601, 8601]
    cuts = [(quality._cut(c, 300), (quality.BINS, 0.0)) for c in counts]
    handed = quality._handed([quality.Round(model.views, cuts)], rows.filter("pooled")).groupBy("view", "label").count().collect()
    assert {r["view"] for r in handed} <= {0, 1} and {r["label"] for r in handed} <= {0} and all(0 < r["count"] <= 400 for r in handed)


def test_classifiers_without_labels_or_texts(spark):
    odd, none = frame(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_class = spark.createDataFrame([(3, 1, 1), (4, 1, 1), (4, 0, 0), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one_class):
        for f in (toxicity.toxicity, quality.quality):
            rows = f(odd, labels).collect()
            assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows) and not any(r["held_out"] for r in rows if r["doc_id"] is None)
            assert f(frame(spark, []), labels).count() == 0


# -- neighbours ---------------------------------------------------------------------------------------------------------
def brute_nearest(rows, every=50, k=5):
    v = {i: np.array(x, dtype=float) for i, x in rows}
    out = {}
    for q in (i for i in v if i % every == 0):
        c = sorted((-float((v[i] * v[q]).sum() / (np.sqrt((v[i] ** 2).sum()) * np.sqrt((v[q] ** 2).sum()))), i) for i in v if i != q)
        out[q] = [i for _, i in c[:k]]
    return out


@pytest.mark.parametrize("block_rows", [100_000, 60])
def test_neighbours_recall_and_ties(spark, block_rows):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(1200)] + [(k, [1.0] * 16) for k in range(1200, 1320)]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    exact = [(r["vec_id"], r["v"]) for r in neighbours.usable(df).collect()]
    want = brute_nearest(exact)
    found = neighbours.nearest(neighbours.usable(df), F.col("vec_id") % 50 == 0, block_rows=block_rows).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(want) and got[1200] == [1201, 1202, 1203, 1204, 1205] and got[1300] == [1200, 1201, 1202, 1203, 1204]
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    v = dict(exact)
    for r in found:
        x, y = np.array(v[r["query_id"]]), np.array(v[r["vec_id"]])
        total = lambda z: float(np.cumsum(z)[-1])  # noqa: E731  from left to right
        assert r["score"] == total(x * y) / (np.sqrt(total(y * y)) * np.sqrt(total(x * x)))


def test_rows_that_share_an_id_are_neighbours_of_their_own(spark):
    rows = [(0, [1.0, 0.0])] + [(7, [1.0, 0.1 * k]) for k in range(1, 7)] + [(9, [0.0, 1.0]), (11, [1.0, 0.01])]
    out = [(r["rank"], r["vec_id"]) for r in neighbours.nearest_of_every(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(out) == [(1, 11), (2, 7), (3, 7), (4, 7), (5, 7)]


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, None), (100, []), (150, [0.0, 0.0]), (200, [float("nan"), 1.0]), (250, [None, 1.0]), (300, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest_of_every(df).collect()]
    assert sorted(out) == [(0, 1, 0), (0, 1, 0), (0, 2, 7), (0, 2, 7)]  # a repeated row is another row
    assert neighbours.nearest_of_every(df.limit(0)).count() == 0


def test_chi_square():
    x = np.random.default_rng(5).chisquare(8, 200_000)
    assert abs((x < 9.0).mean() - neighbours.chi_square(np.array([9.0]), 8)[0]) < 0.005


# -- sentence pieces ----------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


def hard_texts():
    rng = random.Random(6)
    pools = ["aab  c", "the and ing \n\t", "▁ ▁a é漢字🙂　ñ", "0123456789.,-", "\x00\x01a​﻿", "<s> </s> <unk> <0x41>"]
    out = ["", " ", "  ", "a" * 777, "ab" * 500, " " * 300, "▁", "é́", "🙂" * 40, "\n\n\n", "<s>a</s>"]
    return out + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 80))) for _ in range(1500)]


def test_pieces_are_the_librarys(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CHUNK_CHARS", 64)
    m = PieceModel(piece_model_path())
    for text in hard_texts():
        ids = m.encode(text)
        assert ids.tolist() == library.encode(text), repr(text)
        assert m.decode(ids) == library.decode(ids.tolist()), repr(text)


def test_any_ids_decode_as_in_the_library(library):
    m, rng = PieceModel(piece_model_path()), random.Random(7)
    for _ in range(800):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999), 29871]) for _ in range(rng.randint(1, 12))]
        if ids[0] > 2:  # special ids in front change what the library strips
            assert m.decode(np.array(ids)) == library.decode(ids), ids


def test_piece_digests(spark, library):
    rows = [(k, t, "s") for k, t in enumerate(hard_texts()[:60] + [None, "dup", "dup"])]
    out = {r["doc_id"]: r for r in sentence_pieces.piece_digests(frame(spark, rows), piece_model_path()).collect()}
    for i, t, _ in rows:
        ids = library.encode(t or "")
        assert out[i]["n_tokens"] == len(ids) and out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    coded = sentence_pieces.encode_texts(frame(spark, rows[:3]), piece_model_path(), ids_col="size")
    assert coded.columns[-1] == "size" and coded.count() == 3
    assert sentence_pieces.piece_digests(frame(spark, []), piece_model_path()).count() == 0


# -- the pipeline -------------------------------------------------------------------------------------------------------
def test_pipeline_stage_by_stage(spark, library):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "sentence_pieces"] and P.ORACLE_SQL is None
    results = [docs]
    for _, stage in P.STAGES:
        results.append(common.stored(stage(spark, results[-1], SF)))
    columns = [r.columns for r in results[:-1]]
    assert all(c == docs.columns for c in columns)
    ids = [[r["doc_id"] for r in x.select("doc_id").collect()] for x in results]
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op8_toxicity"](spark, SF).collect()}
    assert sorted(ids[1]) == sorted(i for i in ids[0] if not scores[i])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = {}
    for i in sorted(ids[1]):
        first.setdefault(" ".join(texts[i].split()), i)
    assert sorted(ids[2]) == sorted(first.values())
    assert set(ids[3]) <= set(ids[2]) and len(set(ids[4])) <= len(ids[3]) and set(ids[4]) <= set(ids[3]) and max(map(ids[4].count, ids[4])) <= 2
    assert sorted(ids[5]) == sorted(ids[4])
    assert all(r["n_tokens"] == len(library.encode(texts[r["doc_id"]])) for r in results[5].collect())
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(P.run(spark, SF)) == key(results[5])


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls anywhere, repeated rows and ids, empty and long texts, clashing names, no rows at all: each stage has its result."""
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long, name string, quality int, score double, __rid long, tags map<string, string>"
    long = "long text of words " * 20_000
    texts = [(None, "a b c"), (None, "d e f g h"), (3, None), (3, ""), (4, "x y z"), (4, "x y z"), (5, long), (6, "Ünï 🙂"), (4, "other words here")]
    docs = spark.createDataFrame([(i, t, None, None if k % 2 else "s", None, "n", 1, None, None, {"k": "v"}) for k, (i, t) in enumerate(texts)], schema)
    for rows in (docs, docs.limit(0)):
        kept = rows
        for k, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, kept, SF)
            if k < len(P.STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(f"file://{tmp_path}/{rows is docs}/{name}")
            kept = spark.read.parquet(f"file://{tmp_path}/{rows is docs}/{name}")
            if rows is not docs:
                assert kept.count() == 0
            elif name == "exact_dedup":
                assert sorted((str(r["doc_id"]), len(r["text"] or "")) for r in kept.collect()) == [("3", 0), ("4", 5), ("4", 16), ("5", len(long)), ("6", 5), ("None", 5), ("None", 9)]
    assert kept.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_of_two_corpora(spark, tmp_path):
    """Results that aren't written yet keep their tables, whatever is run or written meanwhile."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = P.without_copies(spark, docs, SF)
    docs.limit(30).write.parquet(f"file://{tmp_path}/second")
    second = P.without_copies(spark, spark.read.parquet(f"file://{tmp_path}/second"), SF).filter("doc_id >= 0")
    spark._jvm.System.gc()
    third = P.without_near_copies(spark, first, SF)
    assert 0 < second.count() <= 30 < first.count() and 0 < third.count() <= first.count()


def test_pipeline_of_clashing_columns(spark):
    import corpus_pipeline as P

    names = ["rid", "Score", "SLOT", "__n", "__RID", "__taken", "root", "FP", "first", "a.b", "c d", "__times", "Lang_pred", "n_blocks"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = common.stored(docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)]))
    kept = docs
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        assert {tuple(r)[5:] for r in kept.collect()} == {tuple(range(len(names)))}
    assert P.tokens(spark, kept, SF).count() == kept.count()
