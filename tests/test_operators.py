import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegrid.operators import aggregates as A
from lodegrid.operators import checks as Q
from lodegrid.operators import clustering as L
from lodegrid.operators import dedup as D
from lodegrid.operators import joins as J
from lodegrid.operators import overlap as V
from lodegrid.operators import references as R
from lodegrid.operators import state as S
from lodegrid.operators import windows as W
from lodegrid.plans import gaps as G
from lodegrid.plans import reports
from lodegrid.sources import readers, writers


def test_threshold_and_flags(spark):
    grid = spark.createDataFrame([("C1", "A", 0), ("C1", "B", 0), ("C2", "A", 2), ("C2", "B", 4), ("C3", "A", 6), ("C3", "B", 8)], "r string, c string, n int")
    t = A.threshold(grid, 0.25)
    assert t.first()[0] == 3.5
    flags = A.flagged(grid, t).collect()
    assert not any(r["is_gap"] and r["is_empty"] for r in flags) and sum(r["is_empty"] for r in flags) == 2 and sum(r["is_gap"] for r in flags) == 1
    assert A.threshold(grid.filter("n = 0"), 0.25).first()[0] == 0.0


def test_saturation(spark):
    pairs = spark.createDataFrame([("L1", "A"), ("L2", "A"), ("L1", "B"), ("L3", "C"), ("L2", "D"), ("L4", "D"), ("L5", "D"), ("L9", "unknown")], "label string, entity string")
    order = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3), ("D", 4)], "entity string, rank int")
    curve = W.saturation(pairs, order, "entity", "label", 0.25)
    rows = curve.orderBy("rank").collect()
    assert [r["new_count"] for r in rows] == [2, 0, 1, 2] and [r["cumulative_count"] for r in rows] == [2, 2, 3, 5]
    assert [r["in_final_window"] for r in rows] == [False, False, False, True]
    assert W.order_violations(curve, "rank", "cumulative_count").isEmpty()
    assert not W.saturation_verdict(curve).first()["saturated"]


def test_leaders_and_fallback(spark):
    rows = [(0, "https://doi.org/10.1/A", "T", "", "x", "", "B", "2020", "Doe, J"), (1, "10.1/a", "T", "abs", "", "", "A", "2020", "Doe, J"), (2, None, "Élan", "", "", "A*", "A", "2021.0", "Müller, A"), (3, "", "elan", "", "", "A*", "A", "2021", "muller, b"), (4, "10.2/b", "U", "abs", "1-9", "A", "A", "", "")]
    df = spark.createDataFrame(rows, "row_idx int, doi string, title string, abstract string, pageRange string, rank string, search_path string, year string, authors string")
    from lodegrid.plans import corpus

    out = {r["row_idx"]: r for r in corpus.deduplicated(df).collect()}
    assert set(out) == {1, 2, 4} and out[1]["search_path"] == "A+B" and out[2]["group_size"] == 2
    again = corpus.screenable(corpus.page_filtered(df))
    assert again.filter("row_idx = 4").first()["page_status"] == "pass" and again.count() == 5


def test_first_wins_and_references(spark):
    df = spark.createDataFrame([(0, "a", "s2"), (1, "A", "s1"), (2, None, "s1"), (3, "", "s3")], "i int, k string, seed string")
    assert sorted(r["i"] for r in D.first_wins(df, F.lower("k"), "i").collect()) == [0, 2, 3]
    merged = D.merged_references(df.withColumn("key", F.nullif(F.lower("k"), F.lit(""))), "key", "seed", "i").collect()
    assert [(r["i"], r["seed"]) for r in merged] == [(0, "s1|s2")]


def test_venue_cascade(spark):
    journals = spark.createDataFrame([(0, "1234-5678", "Journal of X", "JX", "A"), (1, "12345678", "The Y", "YY", "B"), (2, "n/a", "Bad", "B", "")], "row_idx int, issn string, name string, acronym string, rank string")
    conferences = spark.createDataFrame([(0, "journal of x", "JX", "C"), (1, "Conf Z", "CZ", "A*")], "row_idx int, name string, acronym string, rank string")
    papers = spark.createDataFrame([(0, "9999 1234-5678", "x"), (1, "", "Proceedings of the Conf  Z"), (2, None, "Talks at CZ 2020"), (3, None, "nothing"), (4, "", "journal of X")], "row_idx int, issn string, source string")
    out = {r["row_idx"]: (r["venue_rank"], r["method"]) for r in J.venue_ranks(papers, journals, conferences).collect()}
    assert out == {0: ("B", "issn"), 1: ("A*", "name"), 2: ("A*", "acronym"), 3: ("Not found", "none"), 4: ("A", "name")}


def test_bibliography_matches(spark):
    kind = "id string, row_idx int, doi string, arxiv string, year string, surname string, title string"
    ours = spark.createDataFrame([("a", 0, "10.1/x", "", "", "", ""), ("b", 1, "", "2101.00001", "", "", ""), ("c", 2, "", "", "2020", "doe", "A study of things"), ("d", 3, "", "", "2020", "doe", "Unrelated words entirely")], kind)
    known = spark.createDataFrame([("k1", 0, "10.1/x", "", "", "", ""), ("k2", 1, "", "2101.00001", "", "", ""), ("k3", 2, "", "", "2020", "doe", "A study of thing")], kind)
    assert {r["id"]: (r["match"], r["method"]) for r in J.bibliography_matches(ours, known).collect()} == {"a": ("k1", "doi"), "b": ("k2", "arxiv"), "c": ("k3", "title"), "d": (None, "none")}


def test_kappa_limits(spark):
    kind = "a string, b string"
    assert A.agreement(spark.createDataFrame([], kind), "a", "b").first()["kappa"] is None
    assert A.agreement(spark.createDataFrame([("include", "include")], kind), "a", "b").first()["kappa"] is None
    r = A.agreement(spark.createDataFrame([("include", "include"), ("exclude", "exclude"), ("include", "defer")], kind), "a", "b").first()
    assert (r["n"], r["agreements"], r["n_binary"], r["kappa"]) == (3, 2, 2, 1.0)


def brute_linkage(v, threshold):
    groups = [[i] for i in range(len(v))]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    while len(groups) > 1:
        far, a, b = min((max(d[i, j] for i in x for j in y), p, q) for p, x in enumerate(groups) for q, y in enumerate(groups) if p < q)
        if far >= threshold:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(4))
def test_complete_linkage(seed):
    v = np.random.default_rng(seed).standard_normal((40, 5))
    label = L.complete_linkage(v, 0.5)
    assert {frozenset(np.flatnonzero(label == x).tolist()) for x in set(label.tolist())} == brute_linkage(v, 0.5)


def test_cluster_edits(spark):
    c = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "two")], "cluster_id int, label string")
    e = spark.createDataFrame([(1, 1, "approve", None, None), (2, 2, "rename", None, "Two"), (3, 3, "merge", 1, None), (4, 4, "approve", None, None), (5, 4, "rename", None, "two"), (6, 1, "merge", 3, None)], "seq int, cluster_id int, action string, target int, label string")
    out = {r["cluster_id"]: (r["label"], r["status"]) for r in L.edited(c, e).collect()}
    assert out == {1: ("one", "approved"), 2: ("Two", "approved"), 3: ("three", "merged"), 4: ("two", "approved")}
    assert sorted(r["label"] for r in L.emitted(L.edited(c, e)).collect()) == ["Two", "one", "two (4)"]


def test_overlap_and_candidates(spark):
    t = spark.createDataFrame([(1, "the quick brown fox jumps over it")], "id int, text string")
    p = spark.createDataFrame([("f1", "a Quick brown, fox jumps over the dog"), ("f0", "other words")], "id string, text string")
    found = V.shared_ngrams(t, "id", "text", p, "id", "text", 5)
    assert [(r["ngram"], r["first_source"]) for r in found.collect()] == [("quick brown fox jumps over", "f1")]
    assert V.overlap_lines(found, t, "id", "text").first()["line"] == 1
    refs = spark.createDataFrame([("r1", "a b c d", "2020"), ("r2", "x y", "")], "ref_id string, title string, year string")
    cands = spark.createDataFrame([("r1", 0, "a b c d", "2020", "DOI:10.1/A"), ("r1", 1, "a b", "2019", "10.2/b"), ("r2", 0, "q", "", "10.3/c")], "ref_id string, at int, title string, year string, doi string")
    out = {r["ref_id"]: (r["doi"], r["score"]) for r in V.best_candidates(refs, cands).collect()}
    assert out == {"r1": ("10.1/a", 1.03), "r2": (None, 0.0)}


def test_reference_lines(spark):
    lines = ["junk", "[1] Doe, J. 2001. A long enough first title here", "goes on", "17", "[2] Roe, R. 2002. Another rather long title", "see [9] 1999 in text", "[40] not a start 2003", "[3] Poe, E. 2004. The third of the long titles"]
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines)], "doc string, at int, line string")
    refs = [r["raw"] for r in R.numbered_references(df).orderBy("ref").collect()]
    assert len(refs) == 3 and refs[0].endswith("goes on") and "see [9]" in refs[1] and "[40]" in refs[1]
    by_author = R.author_references(spark.createDataFrame([("d", 0, "Smith, J. A. (2020). A title that is long enough."), ("d", 1, "continued here"), ("d", 2, "Doe, B. 2021. Another title that is long.")], "doc string, at int, line string"))
    assert by_author.count() == 2
    assert R.chosen_references(R.numbered_references(df), by_author, by_author.limit(0), enough=2).first()["strategy"] == "numbered"


def test_state(spark, tmp_path):
    register = str(tmp_path / "register")
    e = S.events(spark.range(2), phase="p", kind="k", subject=F.col("id"))
    assert S.append_once(e, register) and not S.append_once(e, register)
    assert S.read_register(spark, register).count() == 2
    S.replaced(spark.range(3), str(tmp_path / "t"))
    S.replaced(spark.range(5), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    a, b = spark.createDataFrame([(1, "x", None), (2, "y", "z")], "k int, a string, b string"), spark.createDataFrame([(1, "q"), (3, "n")], "k int, b string")
    assert sorted(tuple(r) for r in S.upserted(a, b, "k").na.fill("").collect()) == [(1, "x", "q"), (2, "y", "z"), (3, "", "n")]
    assert S.migrated(a, "b string, c int, k long").columns == ["b", "c", "k"]
    forced = S.forced_exclusions(spark.createDataFrame([("defer", "", None), ("include", "", "r")], "decision string, criterion string, rationale string")).collect()
    assert [tuple(r) for r in forced] == [("exclude", "EC4", "[forced exclude] "), ("include", "", "r")]


def test_checks(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, "y")], "k int, v string")
    assert {(r["rule"], r["item"], r["detail"]) for r in Q.violations(Q.not_null(a, "n", ["v"], "k"), Q.unique(a, "u", "k"), Q.measure(a, "m", F.count("*"), 5), Q.has_columns(a, "c", ["k", "z"]), Q.unchanged(a, a, "same", "k")).collect()} == {("n", "2", "v"), ("u", "2", "2"), ("m", "", "3.0"), ("c", "z", "missing column")}


def test_sources(spark, tmp_path):
    (tmp_path / "a_20200101.csv").write_text('h,"b"\n"x, ""q""",N/A\n1,\n')
    df = readers.csv(spark, readers.newest(spark, str(tmp_path), "a_"), missing_tokens=True)
    assert [tuple(r) for r in df.collect()] == [('x, "q"', None), ("1", None)]
    bib = "@article{key1, title = {A {B} c}, year = 2020, note = \"n, m\"}\n@inproceedings{k2,\n title={T}}\n"
    (tmp_path / "x.bib").write_bytes(bib.encode() + "@book{k3, title={Caf\xe9}}".encode("latin-1"))
    entries = {r["citekey"]: r["fields"] for r in readers.bibtex(spark, str(tmp_path)).collect()}
    assert entries["key1"] == {"title": "A {B} c", "year": "2020", "note": "n, m"} and entries["k3"]["title"] == "Café" and set(entries) == {"key1", "k2", "k3"}
    md = spark.createDataFrame([("f", "# T\n\n## P001\ntext one\n\n## P002\ntwo\n")], "file string, t string")
    assert [(r["passage"], r["text"]) for r in readers.passage_blocks(md, "file", "t").orderBy("passage").collect()] == [("P001", "text one"), ("P002", "two")]
    sections = readers.sections(spark.createDataFrame([("f", "## A\n| Label | x |\n|---|---|\n| l1 | 1 |\n## B\n| l1 | 2 |\n| l2 | 3 |")], "file string, t string"), "file", "t")
    assert {r["label"]: r["section"] for r in readers.table_labels(sections).collect()} == {"Label": "A", "l1": "A", "l2": "B"}
    assert readers.json_state(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_writers_and_reports(spark):
    df = spark.createDataFrame([(0, "Doe", "2020", "On things"), (1, "Doe", "2020", "On others"), (2, "Roe", "2021", "A & B")], "i int, s string, y string, t string")
    keys = writers.citekeys(df, F.col("s"), F.col("y"), F.col("t"), [F.col("i")])
    assert [r["citekey"] for r in keys.orderBy("i").collect()] == ["doe2020on", "doe2020ona", "roe2021a"]
    assert keys.filter("i = 2").select(writers.bibtex_text(F.lit("article"), F.col("citekey"), {"title": F.col("t"), "note": F.lit("")})).first()[0] == "@article{roe2021a,\n  title = {A \\& B}\n}"
    assert reports.markdown_table(df.select("i", "t").limit(1)) == "| i | t |\n| --- | --- |\n| 0 | On things |\n"
    assert [r["batch"] for r in writers.batched(df, 2, [F.col("i")]).orderBy("i").collect()] == [0, 0, 1]
    text = df.select(G.rationale(F.lit("r"), F.lit("c"), F.lit(2), F.lit(3.0), F.lit(1)).alias("x")).select(G.parsed_rationale(F.col("x")).alias("p")).first()["p"]
    assert (text["row"], text["column"], text["n"]) == ("r", "c", 2)


def test_streams(spark, tmp_path):
    from lodegrid.streaming import streams

    spark.sql("select cast(id as string) as label, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts from range(6)").write.parquet(str(tmp_path / "in"))
    events = streams.events_stream(spark, str(tmp_path / "in"), "label string, ts timestamp", 100)
    register = str(tmp_path / "register")
    rows = streams.first_sightings(events, "ts", "label").select(*[F.lit("").alias(c) if c != "subject" else F.col("label").alias(c) for c in S.REGISTER])
    for n in range(2):
        q = rows.writeStream.foreachBatch(streams.append_new(register, ["subject"])).option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert S.read_register(spark, register).count() == 6
    q = streams.windowed_counts(events, "ts", "label").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").count() == 6


def test_definitions_of_done(spark):
    from lodegrid.plans import done

    papers = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "paper_id string")
    decisions = spark.createDataFrame([("p1", "include", None, "validation"), ("p2", "exclude", "EC9", None), ("p2", "defer", None, None)], "paper_id string, decision string, criterion string, class string")
    found = {(r["rule"], r["item"]) for r in done.screening(papers, decisions).collect()}
    assert found == {("decided once", "p2"), ("decided once", "p3"), ("exclusion has a criterion", "p2"), ("deferred", "p2")}
    refs = spark.createDataFrame([("r1", "s1|s2", "new_include", "10.1/a"), ("r2", "s1", "odd", "10.1/a"), ("r3", "s1", None, "")], "ref_id string, source_seed string, status string, doi string")
    assert {r["rule"] for r in done.snowballing(refs, spark.createDataFrame([("s1",), ("s3",)], "seed string")).collect()} == {"status present", "known status", "DOI once", "seed seen"}
    curve = spark.createDataFrame([(1, 2, False), (2, 1, True)], "rank int, cumulative_count int, in_final_window boolean")
    assert {r["rule"] for r in done.saturation(curve, 1).collect()} == {"never falls", "total"}
    stages = spark.createDataFrame([(1, "a", 10, 8, 2), (2, "b", 7, 7, 1)], "at int, stage string, n_in int, n_out int, removed int")
    assert {(r["rule"], r["item"]) for r in done.funnel(stages).collect()} == {("adds up", "b"), ("follows", "b")}
    codes, clusters = spark.createDataFrame([("c1",), ("c2",)], "code string"), spark.createDataFrame([("Two words", '["c1"]', '["doi:10.1/x:P001"]', "me"), ("misc", '["c1"]', '["bad"]', "")], "canonical_label string, codes string, passage_ids string, confirmed_by string")
    assert {(r["rule"], r["item"]) for r in done.consolidation(codes, clusters).collect()} == {("code in one cluster", "c1"), ("code in one cluster", "c2"), ("label well formed", "misc"), ("passage id valid", "bad"), ("confirmed", "misc")}
    texts = spark.createDataFrame([("x [k1; k2] y [Z] [k9]",)], "text string")
    assert {r["item"] for r in done.bibliography(texts, spark.createDataFrame([("k1",), ("k2",)], "citekey string"), 1).collect()} == {"k9"}


def test_citekeys_chunks_and_pages(spark):
    texts = spark.createDataFrame([(1, "see [k1; k2] and [k2], not [K1] or [x y"), (2, "none")], "i int, t string")
    mapping = spark.createDataFrame([("k1", "n1"), ("k2", "n2")], "old string, new string")
    out = {r["i"]: (r["text"], r["replaced"]) for r in R.rewritten_citekeys(texts, "i", "t", mapping).collect()}
    assert out == {1: ("see [n1; n2] and [n2], not [K1] or [x y", 3), 2: ("none", 0)}
    found = spark.createDataFrame([("d", 0, 1, "A title", "2020"), ("d", 1, 0, "a TITLE ", "2020"), ("d", 1, 1, "Other", "2020")], "doc string, chunk int, at int, title string, year string")
    assert sorted(r["title"] for r in R.chunk_references(found).collect()) == ["A title", "Other"]
    words = [(p, x + 30 * w, 10.0 * r + 5 * c, 600.0, f"{c}{r}{w}") for p, right in ((1, 300.0), (2, 60.0), (3, 460.0)) for c, x in enumerate((50.0, right)) for r in range(6) for w in range(3)]
    few = [(4, x, 10.0 * r, 600.0, "w") for x in (50.0, 300.0) for r in range(6)]
    df = spark.createDataFrame(words + few, "page int, x0 double, top double, width double, text string")
    assert [tuple(r) for r in R.column_gap(df).collect()] == [(1, 175.0)]
    first = [r["line"] for r in sorted(R.page_lines(df).filter("page = 1").collect(), key=lambda r: r["at"])]
    assert first == [f"{c}{r}0 {c}{r}1 {c}{r}2" for c in (0, 1) for r in range(6)]

    def fetch(offset, rows, total=23):
        return [(k, f"r{k}") for k in range(offset, min(total, offset + rows))], total

    spark.dataSource.register(readers.paged_source(fetch, "id int, name string", 10))
    df = spark.read.format("paged").load()
    assert df.count() == 23 and df.rdd.getNumPartitions() == 3


def test_classification_state(spark):
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "canonical_label string")
    state = L.classification_state(labels, spark.createDataFrame([("a", "M1"), ("b", "?")], "canonical_label string, mode string"))
    said = L.with_suggestions(state, spark.createDataFrame([("a", "M2"), ("b", "M1"), ("c", "bad")], "canonical_label string, suggested string"), ["M1", "M2"])
    assert {r["canonical_label"]: (r["suggested"], r["note"]) for r in said.collect()} == {"a": ("M2", "overrides M2"), "b": ("M1", ""), "c": (None, "")}
    assert [tuple(r) for r in L.emitted_modes(state).collect()] == [("a", "M1")]
    items = spark.createDataFrame([("a", "M1"), ("x", "M1"), ("b", "M9"), ("c", None)], "canonical_label string, mode string")
    assert {r["canonical_label"] for r in L.unusable_items(items, labels, ["M1"]).collect()} == {"x", "b", "c"}


def naive_linkage(vectors, threshold):
    """Complete linkage by its definition: the nearest two clusters are merged as long as they are near enough."""
    unit = vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    d = 1 - unit @ unit.T
    groups = [[k] for k in range(len(vectors))]
    while len(groups) > 1:
        far, a, b = min((d[np.ix_(x, y)].max(), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups[:i]))
        if far >= threshold:
            break
        groups[b] += groups.pop(a)
    return {k: min(g) for g in groups for k in g}


def test_clusters_of_all_against_the_definition(spark):
    from lodegrid.operators import clustering as L

    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 6))
    vectors = np.concatenate([c + 0.3 * rng.standard_normal((5, 6)) for c in centres])
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)] + [(99, None, 0)], "vec_id long, embedding array<double>, component int")
    for tile_rows in (7, 1000):
        links = L.connected(L.near_links(df, "vec_id", "embedding", 0.3, tile_rows)).collect()
        d = 1 - (u := vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))) @ u.T
        near = {(i, j) for i, j in zip(*np.nonzero(d < 0.3), strict=True) if i != j}
        component = {r["item"]: r["component"] for r in links}
        assert set(component) == {i for i, _ in near} and all(component[i] == component[j] for i, j in near)
    out = {r["item"]: r["cluster"] for r in L.clusters_of_all(df, "vec_id", "embedding", 0.3).collect()}
    assert out == naive_linkage(vectors, 0.3) and 1 < len(set(out.values())) < 60
    assert L.clusters_of_all(df.limit(0), "vec_id", "embedding").count() == 0


def test_ngrams_are_found_with_and_without_a_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = lambda n: " ".join(rng.choice(list("abcdef"), n))
    target = spark.createDataFrame([(k, words(40)) for k in range(12)] + [(90, None), (91, "a b")], "id long, text string")
    corpus = spark.createDataFrame([(k, words(60)) for k in range(9)] + [(90, "")], "id long, text string")
    grams = lambda t: {" ".join(t.split()[k : k + 4]) for k in range(len((t or "").split()) - 3)}
    source = {}
    for r in sorted(corpus.collect()):
        for g in grams(r["text"]):
            source.setdefault(g, r["id"])
    want = sorted((r["id"], g, source[g]) for r in target.collect() for g in grams(r["text"]) if g in source)
    for most in (10**6, 0):
        monkeypatch.setattr(V, "MOST_BROADCAST", most)
        assert sorted(tuple(r) for r in V.shared_ngrams(target, "id", "text", corpus, "id", "text", 4).collect()) == want and want


def test_cosines_above_a_threshold(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefghijklmnop"), rng.integers(1, 9))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    count = np.array([[t.split().count(c) for c in "abcdefghijklmnop"] for t in texts], dtype=float)
    unit = count / np.sqrt((count**2).sum(axis=1, keepdims=True))
    for least in (0.3, 0.7, 0.99):
        found = {(r["left_id"], r["right_id"]): r["cosine"] for r in V.token_cosine(df, df, least).collect()}
        exact = unit @ unit.T
        assert {(i, j) for i, j in zip(*np.nonzero(exact >= least + 1e-9), strict=True)} <= set(found)
        assert all(x >= least and abs(x - exact[i, j]) < 1e-9 for (i, j), x in found.items())


def test_numbers_follow_the_order(spark):
    rows = [(k * 7 % 1000,) for k in range(1000)]
    df = spark.createDataFrame(rows, "v int").repartition(6)
    assert all(r["n"] == r["v"] + 5 for r in W.numbered(df, [F.col("v")], "n", 5).collect())
    assert W.numbered(df.limit(0), [F.col("v")], "n").count() == 0
    falls = W.order_violations(spark.createDataFrame([(1, 5), (2, 7), (3, 6), (4, 6), (5, 1)], "o int, v int"), "o", "v").collect()
    assert sorted((r["o"], r["before"]) for r in falls) == [(3, 7), (5, 6)]


def test_running_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(W, "RANKS_A_TASK", 7)
    order = spark.createDataFrame([(k, k + 1) for k in range(50)], "e int, rank int")
    pairs = spark.createDataFrame([(k, (k * k) % 23) for k in range(50)] + [(99, 1)], "e int, l int")
    curve = sorted(W.saturation(pairs, order, "e", "l").collect())
    seen = set()
    for r in curve:
        seen.add((r["e"] ** 2) % 23)
        assert r["cumulative_count"] == len(seen)


def test_samples_by_stratum_are_the_first_of_each(spark):
    import hashlib

    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(300)], "k long, s string")
    got = sorted(r["k"] for r in W.stratified_sample(df, "s", "k", [("a", 0.2), ("b", 0.1)], 40).collect())
    order = lambda x: sorted((k for k in range(300) if "ab"[k % 2] == x), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
    assert got == sorted(order("a")[:30] + order("b")[:10])


def test_keys_in_names(spark):
    names = spark.createDataFrame([(1, "a 10.1234567890.pdf"), (2, "xy"), (3, ""), (4, None)], "n int, name string")
    keys = spark.createDataFrame([("1234567890",), ("y",), ("xyz",), ("",), (None,), ("0.p",)], "key string")
    assert sorted((r["n"], r["key"]) for r in J.contained_keys(names, "name", keys, "key").collect()) == [(1, "0.p"), (1, "1234567890"), (2, "y")]
    assert J.contained_keys(names, "name", keys.limit(0), "key").count() == 0


def test_scratch_is_cleared(spark):
    from lodegrid.session import clear_scratch, scratch

    path = scratch(spark)
    spark.range(3).write.parquet(path)
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and spark.read.parquet(path).count() == 3
    clear_scratch(spark)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
