"""Languages, whitening and lexical search: brute force, held-out accuracy, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodegrid.llm import language, lexical, whitening
from lodegrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# -- lexical search -----------------------------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranks(docs, items, top=50):
    """(item_id, rank, doc_id, score), sorted: the definition, document by document."""
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item_id, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def spark_ranks(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, 1, "x") for i, t in docs], "doc_id long, text string, score long, rank int, item_id string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in lexical.ranked(d.repartition(3) if docs else d, q, **options).collect()), key=str)


def random_texts(rng, n, longest=60):
    words = [f"w{k}" for k in range(80)]
    weights = [1 / (k + 1) for k in range(80)]
    return [" ".join(rng.choices(words, weights, k=rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("block, fall, short", [(1 << 16, 0.75, 4), (40, 0.75, 1), (150, 0.97, 1), (7, 0.5, 2)])
def test_ranks_against_brute_force(spark, monkeypatch, block, fall, short):
    monkeypatch.setattr(lexical, "BLOCK_ROWS", block)
    monkeypatch.setattr(lexical, "FALL", fall)
    monkeypatch.setattr(lexical, "SHORT_LIST", short)
    rng = random.Random(block)
    docs = list(enumerate(random_texts(rng, 400))) + [(1000 + k, "w3 w4 w70") for k in range(90)]
    items = list(enumerate(random_texts(rng, 12, 20)))
    assert spark_ranks(spark, docs, items, top=10) == brute_ranks(docs, items, 10)


def test_ranks_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MOST_TERMS", 60)
    rng = random.Random(5)
    docs, items = list(enumerate(random_texts(rng, 150))), list(enumerate(random_texts(rng, 9, 30)))
    assert spark_ranks(spark, docs, items, top=5) == brute_ranks(docs, items, 5)


def test_ranks_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 64)
    docs = [(None, "Alpha beta"), (2, None), (2, ""), (3, "alpha-BETAÉé K"), (3, "alpha"), (3, "alpha"), (4, "!!! ..."), (5, "gamma " * 5000 + "delta"), (6, "x" * 1000), (7, "Éé kÄ")]
    items = [(1, "ALPHA gamma"), (1, "ALPHA gamma"), (None, "delta x"), (2, None), (3, "?"), (4, "absent"), (5, "betaÉé K kÄ " + "x" * 1000)]
    assert spark_ranks(spark, docs, items) == brute_ranks(docs, items)
    assert spark_ranks(spark, [], items) == [] and spark_ranks(spark, docs, []) == []


def test_early_stop_skips_postings():
    """With one rare strong term and common weak ones the best are proven before most postings are taken."""
    n, terms = 5000, 4
    tf = np.ones((n, terms), dtype=np.int64)
    impact = np.tile(np.array([1, 1, 1, 1], dtype=np.int64), (n, 1)) + np.arange(n)[:, None] % 7
    impact[:20, 0] = 1000 + np.arange(20)
    block = lexical.Block(np.arange(n), np.zeros(n, dtype=bool), np.arange(n + 1) * terms, np.tile(np.arange(terms), n), impact.ravel(), terms)
    docs, scores = block.best(np.arange(terms), 10, 1)
    order = lexical._leading(scores, docs, np.zeros(len(docs), dtype=bool), 10)
    want = np.argsort(-impact.sum(axis=1), kind="stable")[:10]
    assert docs[order].tolist() == want.tolist() and scores[order].tolist() == impact.sum(axis=1)[want].tolist()
    assert block.taken < 0.1 * tf.size


def test_lexical_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_lexical"](spark, SF).collect()), key=str) == brute_ranks(docs, items)


# -- whitening ----------------------------------------------------------------------------------------------------------
def check_whitened(rows, vectors, k):
    """Rows of whitened_components against numpy and Python's whole numbers."""
    fine = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in fine}), dtype=object)
    n, dims = fit.shape
    sums = fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    most = min(k, dims)
    assert len(rows) == len(fine) * most
    white = {}
    for r in rows:
        white.setdefault(r["component"], []).append(r)
    for j in range(most):
        got, want = white[j + 1], {}
        for i, x in fine:
            want.setdefault(i, []).append((sum(int(n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), float(((n * np.array(x, dtype=object) - sums) / n).astype(float) @ axes[:, j]) / math.sqrt(values[j])))
        sign = 0.0
        for r in got:
            match = [w for d, w in want[r["vec_id"]] if (d if d < 2**63 else None) == r["deviation"] and abs(abs(w) - abs(r["whitened"])) < 1e-6 * max(1, abs(w))]
            assert match and r["n"] == n
            if abs(match[0]) > 1e-3 and len(match) == 1:
                assert sign in (0.0, math.copysign(1, match[0] * r["whitened"]))
                sign = math.copysign(1, match[0] * r["whitened"])
            assert abs(r["explained"] - values[j] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_query_against_brute_force(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(QUERIES["op12_whitening"](spark, SF).collect(), vectors, 4)


def test_whitening_of_odd_rows(spark):
    rng = random.Random(3)
    vectors = [(k, [rng.gauss(0, 2), rng.gauss(5, 1), rng.gauss(0, 0.3)]) for k in range(40)]
    vectors += [(7, [1.0, 2.0, 3.0])] * 30 + [(None, [0.5, -0.0, 1.0]), (50, None), (51, [1.0, None, 2.0]), (52, [1.0, math.nan, 2.0]), (53, [math.inf, 1.0, 2.0]), (54, [])]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in vectors], "vec_id long, embedding array<double>, whitened double, x string")
    check_whitened(whitening.whitened_components(df, 4).collect(), vectors, 4)
    assert whitening.whitened_components(df.limit(0), 4).count() == 0


def test_whitening_without_variance_and_of_two_lengths(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in whitening.whitened_components(one, 1).collect()] == [(1, 0, None, 0.0, None)] * 2
    rng = random.Random(1)
    long = [(k, [rng.random() for _ in range(3)]) for k in range(20)]
    line = [(100 + k, [float(k), 2.0 * k]) for k in range(5)]  # one direction only
    out = whitening.whiten(spark.createDataFrame(long + line, "vec_id long, embedding array<double>")).collect()
    check = [r for r in out if r["vec_id"] >= 100]
    assert len(out) == 25 and all(len(r["whitened"]) == 2 and r["whitened"][1] is None and r["identity_error"] < 1e-9 for r in check)
    assert {len(r["whitened"]) for r in out if r["vec_id"] < 100} == {3}


def test_whitening_of_large_entries(spark):
    vectors = [(k, [float(v), float(w)]) for k, (v, w) in enumerate([(2**50, 1), (-(2**50), 3), (2**49, -(2**40)), (5, 2**45)])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    check_whitened(whitening.whitened_components(df, 2).collect(), vectors, 2)
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 5.0])], "vec_id long, embedding array<double>")
    assert len(whitening.whitened_components(far, 2).collect()) == 6


def test_sums_of_squares_are_exact_or_null():
    rows = np.array([[3037000499, 0], [3037000500, 0], [-5, 12], [2**31, 2**31], [2**40, 2**40]], dtype=np.int64)
    assert whitening._sums_of_squares(rows) == [3037000499**2, None, 169, None, None]
    assert whitening._sums_of_squares(rows.astype(object)) == [3037000499**2, None, 169, None, None]


# -- languages ----------------------------------------------------------------------------------------------------------
def grams_of(text):
    codes = "".join(map(chr, language._codes(text)))
    return {codes[i : i + p] for p in range(1, language.MAX_GRAM + 1) for i in range(len(codes) - p + 1)}


TEXTS = ["Le chat, la nuit!", "der Hund  99 der", "Été ß中文", "", "...", "a", "zq xj" * 50, "\U0001f600 la chatte"]


@pytest.mark.parametrize("entries", [1 << 24, 0])
def test_presences_against_brute_force(monkeypatch, entries):
    monkeypatch.setattr(language, "TABLE_ENTRIES", entries)
    monkeypatch.setattr(language, "MATRIX_BYTES", 3000)
    marks = TEXTS[:3]
    grams = language.Grams([language._codes(t) for t in marks])
    known = set().union(*map(grams_of, marks))
    assert grams.n == len(known)
    held = np.concatenate([m for _, m in grams.presences([language._codes(t) for t in TEXTS])])
    mine = [grams_of(t) & known for t in TEXTS]
    assert (held @ held.T).astype(int).tolist() == [[len(a & b) for b in mine] for a in mine]


def test_regression_against_brute_force(spark):
    """Weights are the Nystroem ridge regression's, worked out from sets of n-grams."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(rows)
    langs, sample = language._sample(rows)
    got = sample.orderBy("lang", "place").collect()
    each = language.LANDMARKS // len(langs)
    marks = list(dict.fromkeys(r["text"] for r in got if r["place"] <= each))
    of = {t: grams_of(t) for t in {r["text"] for r in got}}
    known = set().union(*(of[t] for t in marks))
    kernel = lambda a, b: len(of[a] & of[b]) / math.sqrt(len(of[a] & known) * len(of[b] & known))
    k = np.array([[kernel(r["text"], t) for t in marks] for r in got])
    totals = Counter(r["lang"] for r in got)
    w = np.array([1 / totals[r["lang"]] for r in got])
    y = np.where(np.array([r["lang"] for r in got])[:, None] == np.arange(len(langs)), 1.0, -1.0)
    left = k.T @ (k * w[:, None])
    among = np.array([[kernel(a, b) for b in marks] for a in marks])
    alpha = np.linalg.solve(left + language.RIDGE * among + 1e-9 * np.trace(left) * np.eye(len(marks)), k.T @ (y * w[:, None]))
    texts = [r["text"] for r in got[:40]]
    assert np.allclose(model.scores([language._codes(t) for t in texts]), k[:40] @ alpha, atol=1e-3)


def test_language_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_language"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    out = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert out and sum(out) / len(out) > 0.97


def test_language_of_odd_rows(spark):
    rows = [(k, t, l) for k in range(60) for t, l in ((f"the cat and the dog {k}", "en"), (f"der hund und die katze {k}", "de"))]
    odd = [(None, "the dog", "xx"), (900, None, "en"), (901, "", None), (902, "12 ... !", "en"), (903, "中文", None), (904, "the cat " * 20000, None), (904, "der hund", "de"), (904, "der hund", "de")]
    df = spark.createDataFrame([(i, t, l, 0.5, "q") for i, t, l in rows + odd], "doc_id long, text string, lang string, score double, held_out string")
    out = language.languages(df).collect()
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["held_out"], r["lang_pred"], r["score"] > 0))
    assert len(out) == len(rows) + len(odd)
    assert got[None] == [(False, "en", True)] and [g[1] for k in (900, 901, 902) for g in got[k]] == ["und"] * 3
    assert got[903][0][1] in ("en", "de") and sorted(g[1] for g in got[904]) == ["de", "de", "en"]
    assert language.languages(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.languages(df.filter("lang is null")).collect()} == {"und"}


def test_samples_are_bounded_and_even(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_ROWS", 60)
    df = spark.range(9000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 10 = 0, 'b', if(id % 3 = 0, 'c', 'a')) as lang")
    langs, sample = language._sample(df)
    assert langs == ["a", "b", "c"] and {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()} == {0: 20, 1: 20, 2: 20}
