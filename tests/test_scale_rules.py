"""Selection, phrases, containment and titles by ways that hold at any size, against brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from lodegrid.functions import gestalt
from lodegrid.functions import keys as K
from lodegrid.functions import text as T
from lodegrid.operators import aggregates as A
from lodegrid.operators import checks as Q
from lodegrid.operators import joins as J
from lodegrid.operators import phrases as P
from lodegrid.operators import references as R
from lodegrid.operators import selection as S
from lodegrid.operators import windows as W


# -- order statistics ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("most", [10_000, 5])
def test_values_at_ranks(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST_VALUES", most)
    rng = random.Random(most)
    groups = {"a": [rng.gauss(0, 1) for _ in range(700)], "b": [7.0] * 300 + [rng.random() for _ in range(50)] + [9.0] * 300, "c": [1.5], "d": [float(2**k) for k in range(60)]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double")
    wanted = [(g, f"{g}{k}", k) for g, vs in groups.items() for k in sorted({0, len(vs) // 3, len(vs) // 2, len(vs) - 1})]
    found = S.at_ranks(rows, "v", spark.createDataFrame(wanted, "g string, target string, k long"), ["g"]).collect()
    assert sorted((r["g"], r["k"], r["found"]) for r in found) == sorted((g, k, sorted(groups[g])[k]) for g, _, k in wanted)


@pytest.mark.parametrize("most", [10_000, 7])
def test_percentiles_are_the_exact_ones(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST_VALUES", most)
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice("xyz"), rng.choice([1.0, 2.5, rng.expovariate(1)])) for _ in range(2000)] + [("n", None)], "g string, v double")
    for by in ([], ["g"]):
        got = {(*[r[b] for b in by], r["fraction"]): r["percentile"] for r in S.percentiles(df, F.col("v"), [0.0, 0.2, 0.33, 0.5, 1.0], by).collect()}
        want = df.groupBy(*by).agg(F.percentile("v", [0.0, 0.2, 0.33, 0.5, 1.0]).alias("p")).filter("p is not null").collect()
        assert len(got) == 5 * len(want) == 5 * (3 if by else 1)
        for r in want:
            for f, p in zip([0.0, 0.2, 0.33, 0.5, 1.0], r["p"], strict=True):
                assert got[(*[r[b] for b in by], f)] == pytest.approx(p, rel=1e-12)


def test_summary_without_rows_and_thresholds_by_group(spark):
    df = spark.createDataFrame([(3,), (1,), (2,), (None,), (9,)], "v int")
    assert A.summary(df, "v").first()["upper_median"] == 3
    assert A.summary(df.limit(0), "v").first()["upper_median"] is None
    assert "Window" not in A.summary(df, "v")._jdf.queryExecution().toString()
    cells = spark.createDataFrame([("a", 0), ("a", 4), ("a", 8), ("b", 0)], "g string, n int")
    assert {r["g"]: r["threshold"] for r in A.threshold(cells, 0.5, by=["g"]).collect()} == {"a": 6.0, "b": 0.0}


# -- phrases ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("most", [1 << 21, 12])
def test_phrases_in_texts(spark, monkeypatch, most):
    monkeypatch.setattr(P, "MOST_CHARS", most)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [word(rng.randrange(30)) for _ in range(40)] + [None, "ünï 🙂"]
    phrases = list({word(rng.randrange(1, 8)) for _ in range(60)} | {"ünï", "🙂", "zz", ""}) + [None]
    t, p = spark.createDataFrame([(x,) for x in texts], "t string").repartition(3), spark.createDataFrame([(x,) for x in phrases], "p string")
    want = {x for x in phrases if x is not None and any(x in y for y in texts if y is not None)}
    assert sorted(r[0] for r in P.found(t, "t", p, "p").collect()) == sorted(want)
    pairs = [(rng.choice(phrases), rng.choice(phrases)) for _ in range(120)]
    both = {(a, b) for a, b in pairs if a is not None and b is not None and any(a in y and b in y for y in texts if y is not None)}
    assert {tuple(r) for r in P.found_together(t, "t", spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()} == both
    assert P.found(t.limit(0), "t", p, "p").count() == 0 and P.found(t, "t", p.limit(0), "p").count() == 0


def test_mentions_have_no_nested_loop(spark):
    texts = spark.createDataFrame([("Limits: NONE of it",), (None,)], "text string")
    wanted = spark.createDataFrame([("limits",), ("None",), ("else",), (None,)], "phrase string")
    found = Q.mentions(texts, "m", "text", wanted, "phrase")
    assert sorted(str(r["item"]) for r in found.collect()) == ["None", "else"]
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# -- keys in names --------------------------------------------------------------------------------------------------------
def test_keys_that_begin_alike_meet_few_names(spark):
    """All keys share their first characters; the rarest substrings tell them apart."""
    names = spark.createDataFrame([(k, f"paper 10.1000/x.{k:05d}.pdf") for k in range(300)], "n int, name string")
    keys = spark.createDataFrame([(f"10.1000/x.{k:05d}",) for k in range(0, 600, 2)], "key string")
    rows, wanted, candidates = J._gram_candidates(names, "name", keys, "key")
    assert candidates.count() < 3 * 150
    assert sorted((r["n"], r["key"]) for r in J.contained_keys(names, "name", keys, "key").collect()) == [(k, f"10.1000/x.{k:05d}") for k in range(0, 300, 2)]


def test_contained_keys_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    names, keys = [(k, word(rng.randrange(25))) for k in range(60)] + [(99, None)], [(k, word(rng.randrange(1, 14))) for k in range(40)] + [(98, ""), (97, None), (96, "abab"), (95, "abab")]
    out = J.contained_keys(spark.createDataFrame(names, "n int, name string"), "name", spark.createDataFrame(keys, "k int, key string"), "key")
    assert sorted((r["n"], r["k"]) for r in out.collect()) == sorted((n, k) for n, a in names for k, b in keys if a and b and b in a)


# -- titles ---------------------------------------------------------------------------------------------------------------
def test_ratios_are_the_usual_ones():
    rng = random.Random(4)
    word = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    pairs = [(word("ab ", rng.randrange(30)), word("ab ", rng.randrange(30))) for _ in range(400)] + [(word("abcdefgh ", rng.randrange(90)), word("abcdefgh ", rng.randrange(90))) for _ in range(300)]
    pairs += [("", ""), ("a", ""), ("", "b"), ("x" * 300, "x" * 250), (word("abc", 50), word("abc", 400)), ("ünï", "ünï 🙂")]
    base = [word("abcdefghij ", 60) for _ in range(50)]
    pairs += [(b, b[: k % 60] + word("xyz", k % 5) + b[k % 60 + k % 3 :]) for k, b in enumerate(base)]
    want = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert gestalt.ratios([a for a, _ in pairs], [b for _, b in pairs]).tolist() == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("least, a_task", [(0.8, 1_000_000), (0.8, 3), (0.5, 10), (1.0, 5), (0.0, 50)])
def test_alike_titles_against_brute_force(spark, monkeypatch, least, a_task):
    monkeypatch.setattr(J, "PAIRS_A_TASK", a_task)
    rng = random.Random(6)
    words = ["graph", "neural", "of", "a", "study", "models", "large", "on"]
    title = lambda: " ".join(rng.choices(words, k=rng.randrange(6))).title()
    entry = lambda side, k: (f"{side}{k}", k, rng.choice(["2020", "2021", ""]), rng.choice(["roe", "doe"]), rng.choice([title(), title() + "!", "...", None]))
    ours, theirs = [entry("e", k) for k in range(40)], [entry("k", k) for k in range(40)]
    kind = "id string, row_idx int, year string, surname string, title string"
    out = J.alike_titles(spark.createDataFrame(ours, kind).drop("row_idx"), spark.createDataFrame(theirs, kind), least).collect()
    clean = lambda t: "".join(c for c in (t or "").lower() if c.isascii() and (c.isalnum() or c == " ")).strip()
    want = {}
    for e in ours:
        for k in theirs:
            if e[2] == k[2] != "" and e[3] == k[3] and e[4]:
                r = difflib.SequenceMatcher(None, clean(e[4]), clean(k[4])).ratio()
                empty = (not clean(e[4])) != (not clean(k[4]))
                if r >= least and not (empty and least == 0.0):
                    want[e[0], k[0]] = r
    assert {(r["entry"], r["known"]): pytest.approx(r["ratio"]) for r in out} == want and len(out) == len(want)


# -- what was wrong beyond small tables ------------------------------------------------------------------------------------
def test_numbers_of_six_digits(spark):
    out = W.renumbered(spark.range(100_002).withColumnRenamed("id", "k"), [F.col("k")], "snow_")
    assert out.select("ref_id").distinct().count() == 100_002
    assert {r["ref_id"] for r in out.filter("k in (7, 100001)").collect()} == {"snow_00007", "snow_100001"}


def test_null_texts_keep_their_rows(spark):
    texts = spark.createDataFrame([(1, "See [a1; b2]."), (2, None), (3, "")], "id int, t string")
    out = R.rewritten_citekeys(texts, "id", "t", spark.createDataFrame([("a1", "x9")], "old string, new string"))
    assert {r["id"]: (r["text"], r["replaced"]) for r in out.collect()} == {1: ("See [x9; b2].", 1), 2: (None, 0), 3: ("", 0)}


def test_large_page_numbers(spark):
    cells = ["1-9999999999", "99999999999999999999 pp", "1-99999999999999999999", "45--55", "7"]
    out = spark.createDataFrame([(c,) for c in cells], "c string").select("c", T.page_count(F.col("c")).alias("n")).collect()
    assert [r["n"] for r in out] == [9999999999, None, None, 11, 1]


def test_name_keys_and_deltas(spark):
    names = {"O'Neil, P": "oneil p", "Smith-Jones, Ann": "ann smithjones", "Ann Smith-Jones": "ann smithjones", "Müller,J.": "j muller", "  ": ""}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["k"] for r in df.select("n", K.name_set_key(F.col("n")).alias("k")).collect()} == names
    lists = spark.createDataFrame([("Smith-Jones, A", "Smith Jones, A"), ("Roe, A", "A Roe"), ("", "A"), ("A", ""), ("", "")], "a string, b string")
    assert [r[0] for r in lists.select(K.author_delta(F.col("a"), F.col("b"))).collect()] == ["updated", "confirmed", "blank_filled", "no_change", "still_blank"]


def test_doi_in_text(spark):
    cells = {"(see 10.1145/12.34).": "10.1145/12.34", "https://doi.org/10.1234567890/AbC?x=1": "10.1234567890/AbC?x=1", "10.1/x": None, "{10.5555/ab},": "10.5555/ab", "10.5555/a..": "10.5555/a"}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r["c"]: r["d"] for r in df.select("c", K.doi_in_url(F.col("c")).alias("d")).collect()} == cells


def test_groups_of_the_whole_digest(spark):
    """Digests that begin alike are groups of their own, though their names look alike."""
    from lodegrid.operators import dedup as D

    rows = spark.createDataFrame([(0, None, "abcdefabcdef1"), (1, None, "abcdefabcdef2"), (2, None, "abcdefabcdef1"), (3, "10.1/x", "abcdefabcdef1")], "i int, doi string, digest string")
    out = D.deduplicated(rows, F.col("doi"), F.col("digest"), [F.lit(0).alias("s")], "i").collect()
    assert sorted((r["i"], r["dedup_group"], r["group_size"]) for r in out) == [(0, "fallback:abcdefabcdef", 2), (1, "fallback:abcdefabcdef", 1), (3, "doi:10.1/x", 1)]
