"""SimHash, lines, exact copies and repeats against brute force, with the cases that break things."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from lodegrid.llm import exact_dedup, line_dedup, repeats, simhash
from lodegrid.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, key string, fp long, name string"


def frame(spark, rows):
    """Documents with columns whose names clash with those of results and of inner tables."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), False, "k", 1, "n") for i, t in rows], SCHEMA)


def corpus(seed, n=60, words=40):
    """Random texts with exact copies, near copies, shared passages, long and odd ones."""
    rng = random.Random(seed)
    vocabulary = ["w" + str(k) for k in range(400)] + ["Ünï", "ab🙂", "x" * 30]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(30)
    rows = []
    for _ in range(n):
        kind, t = rng.random(), "\n".join(text(rng.randint(1, words)) for _ in range(rng.randint(1, 5)))
        if rows and kind < 0.2:
            t = rng.choice(rows)
        elif rows and kind < 0.35:
            w = rng.choice(rows).split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind < 0.55:
            t = f"{text(5)}\n{passage}\n{text(9)}"
        rows.append(t)
    rows += ["", " \n\t ", "a" * 5000, "ab" * 3000, "one two", "one  two\n"]
    return [(k * 3, t) for k, t in enumerate(rows)]


ODD = [(5, None), (2, ""), (None, "p q r s t"), (None, "p q r s t"), (9, "p q  r s t"), (9, "p q r s t"), (9, "p q r s t")]


# -- exact copies ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("rows", [corpus(1), ODD, []], ids=["corpus", "odd", "empty"])
def test_exact_dedup(spark, rows):
    out = exact_dedup.exact_dedup(frame(spark, rows), block_bytes=64).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(repr((i, least[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest())) for i, t in rows)
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in out) == want
    assert sum(r["kept"] for r in out) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])


def test_drop_copies_keeps_one_of_each(spark):
    kept = exact_dedup.drop_copies(frame(spark, ODD))
    assert kept.columns == frame(spark, ODD).columns
    assert sorted((r["doc_id"], (r["text"] or "").strip() == "") for r in kept.collect()) == [(2, True), (9, False)]


def test_drop_copies_keeps_different_texts_of_one_id(spark):
    rows = [(1, "a"), (1, "a"), (None, "x"), (None, "y"), (None, "z"), (None, "z"), (1, "b"), (2, "b"), (1, "a "), (3, None), (3, "")]
    kept = exact_dedup.drop_copies(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "")) for r in kept) == [("1", "a"), ("1", "a "), ("1", "b"), ("3", ""), ("None", "x"), ("None", "y"), ("None", "z")]


def test_very_long_texts_are_named(spark):
    long = "wörd  " * 400_000  # 2.8 MB
    out = exact_dedup.exact_dedup(frame(spark, [(1, long), (2, long.replace("  ", "\n")), (3, long + "x"), (4, "")])).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)]
    assert {r["text_sha256"] for r in out if r["keep_id"] == 1} == {hashlib.sha256(("wörd " * 400_000).encode()).hexdigest()}


# -- SimHash ----------------------------------------------------------------------------------------------------------
def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


@pytest.mark.parametrize("rows", [corpus(2), [(i if i is not None else 100 + k, t) for k, (i, t) in enumerate(ODD)], []], ids=["corpus", "odd", "empty"])
def test_near_duplicates(spark, rows):
    out = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    members = {}
    for k, (i, _) in enumerate(rows):
        members.setdefault(find(k), []).append(i)
    want = sorted((i, f"{prints[k]:016x}", min(members[find(k)])) for k, (i, _) in enumerate(rows))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == want


def test_null_ids_keep_their_rows(spark):
    out = simhash.near_duplicates(frame(spark, ODD)).collect()
    assert len(out) == len(ODD) and {r["component_id"] for r in out if r["doc_id"] is None} == {9}
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(frame(spark, ODD)).collect()) == [2, 9]


def test_stages_lose_no_text_that_shares_an_id(spark):
    rows = [(5, "a"), (5, "b"), (8, "c"), (8, "c"), (None, "d"), (None, "e")]
    kept = exact_dedup.drop_copies(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("5", "a"), ("5", "b"), ("8", "c"), ("None", "d"), ("None", "e")]
    t, u = "one two three four five six seven", "completely other words stand in this one here"
    near = simhash.drop_near_copies(frame(spark, [(1, t), (5, t), (5, u), (None, u), (None, "z z")])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in near) == [("1", t), ("5", u), ("None", "z z")]
    assert simhash.drop_near_copies(frame(spark, [])).count() == 0 and exact_dedup.drop_copies(frame(spark, [])).columns == frame(spark, []).columns


@pytest.mark.parametrize("tile_rows", [7, 50, 10_000])
def test_links_lose_nothing(spark, tile_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = base[rng.integers(150, size=250)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (250, 5), dtype=np.uint64), axis=1)
    fps = np.unique(np.concatenate([base, near, np.array([0, 1, 3, (1 << 64) - 1], dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    root = {r["node"]: r["root"] for r in components(simhash.link_fingerprints(df, 4, tile_rows)).collect()}
    linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    for k, x in enumerate(fps.view(np.int64).tolist()):
        for y in fps.view(np.int64)[linked[k]].tolist():
            assert root.get(x, x) == root.get(y, y)
    assert len(root) == int((linked.sum(axis=1) > 1).sum())


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 400)] + [(7, 7)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[k] for k in range(100, 161)} == {100} and {out[k] for k in range(200, 400)} == {5} and 7 not in out


# -- lines ------------------------------------------------------------------------------------------------------------
def brute_lines(rows):
    first, out = {}, {}
    texts = [(i, [x.strip() for x in (t or "").split("\n")]) for i, t in rows]
    lines = dict(texts)
    for i, ls in texts:
        for x in ls:
            first.setdefault(x, i)
    for i, ls in texts:
        gone = set()
        for f in {first[x] for x in ls if x and first[x] != i}:
            gone |= {j for _, j in line_dedup.patience_matches(lines[f], ls) if ls[j]}
        out[i] = sorted(gone)
    return out


@pytest.mark.parametrize("rows", [corpus(4), [(2, None), (3, ""), (5, "a\n\nb"), (6, "b\na\n\nc\nb")], []], ids=["corpus", "odd", "empty"])
def test_line_dedup(spark, rows):
    out = line_dedup.remove_repeated_lines(frame(spark, rows)).collect()
    want = brute_lines(rows)
    assert {r["doc_id"]: r["removed"] for r in out} == want and len(out) == len(rows)
    text = dict(rows)
    for r in out:
        assert r["kept"] == "\n".join(x for k, x in enumerate((text[r["doc_id"]] or "").split("\n")) if k not in set(r["removed"]))


def test_line_dedup_of_repeated_and_null_ids(spark):
    out = line_dedup.remove_repeated_lines(frame(spark, [(None, "a\nb"), (4, "a\nb"), (4, "a\nb")])).collect()
    assert sorted((str(r["doc_id"]), r["removed"]) for r in out) == [("4", [0, 1]), ("4", [0, 1]), ("None", [])]


def brute_lines_of_all_pairs(rows):
    texts, out = [(i, [x.strip() for x in (t or "").split("\n")]) for i, t in rows], {}
    for k, (i, ls) in enumerate(texts):
        out[i] = sorted({j for _, a in texts[:k] for _, j in line_dedup.patience_matches(a, ls) if ls[j]})
    return out


def boilerplate(seed, n=120):
    """Few lines that many documents hold in several orders and numbers, some rare ones, blank ones and copies."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        t = [rng.choice("pqrstuvw") for _ in range(rng.randint(1, 6))]
        t = [x for y in t for x in ([y] if rng.random() < 0.7 else [rng.choice([f"own {k}", "", f"rare {rng.randrange(30)}"]), y])]
        rows.append((k * 2, rng.choice(rows)[1] if rows and rng.random() < 0.2 else "\n".join(t)))
    return rows


def menus(n, seed=3):
    """The same twelve lines in another order in each document: each is a class of its own."""
    rng, lines = random.Random(seed), [f"menu {k}" for k in range(12)]
    return [(k, "\n".join(rng.sample(lines, 12) + [f"own {k}"])) for k in range(n)]


def test_links_of_shuffled_lines_are_in_proportion(spark, monkeypatch):
    links, aligned = [], line_dedup._aligned

    def counted(found, sequences):
        links[-1] += found.count()
        return aligned(found, sequences)

    monkeypatch.setattr(line_dedup, "_aligned", counted)
    monkeypatch.setattr(line_dedup, "FIRST_TRIES", 4)
    for n in (60, 120):
        links.append(0)
        gone = {i: set() for i in range(n)}
        for r in line_dedup.find_repeated_lines(spark.createDataFrame(menus(n), "key long, text string"), 20).collect():
            gone[r["key"]].add(r["line"])
        assert n > 60 or {i: sorted(x) for i, x in gone.items()} == brute_lines_of_all_pairs(menus(n))
    assert links[1] < 2.6 * links[0] and links[1] < 0.5 * 120 * 119 / 2


@pytest.mark.parametrize("rare", [3, 20, 1000])
@pytest.mark.parametrize("rows", [[(1, "p\nq\nr"), (2, "r\nq\np"), (3, "r\nq\np")], boilerplate(1), boilerplate(2), corpus(4)], ids=["copy", "boilerplate 1", "boilerplate 2", "corpus"])
def test_lines_of_all_pairs(spark, rows, rare):
    keyed = spark.createDataFrame(rows, "key long, text string")
    gone = {i: set() for i, _ in rows}
    for r in line_dedup.find_repeated_lines(keyed, rare).collect():
        gone[r["key"]].add(r["line"])
    assert {i: sorted(x) for i, x in gone.items()} == brute_lines_of_all_pairs(rows)


def test_lines_of_documents_with_many_links(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LINKS_A_TASK", 3)
    rows = boilerplate(5, 60)
    out = line_dedup.remove_repeated_lines(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["removed"] for r in out} == brute_lines_of_all_pairs(rows)


def test_very_long_documents_are_aligned(spark):
    long = [f"line {k}" for k in range(30_000)]
    rows = [(1, "\n".join(long)), (2, "\n".join([*long[:100], "new", *long[100:]])), (3, "line 7\nother\nline 29999")]
    out = {r["doc_id"]: r for r in line_dedup.remove_repeated_lines(frame(spark, rows)).collect()}
    assert (out[1]["removed"], out[2]["kept"], out[3]["kept"]) == ([], "new", "other") and out[2]["n_lines"] == 30_001


def test_patience_matches_rise_and_agree():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 12))] for _ in range(2))
        m = line_dedup.patience_matches(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    assert line_dedup.patience_matches(list("xaby"), list("abz")) == [(1, 0), (2, 1)]


def test_gaps_without_unique_lines_are_aligned():
    a, b = ["a1", *"xyxy", "a2"], ["b1", *"xyxy", "b2"]
    assert line_dedup.patience_matches(a, b) == [(k, k) for k in range(1, 5)]
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 15))] for _ in range(2))
        length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
        m = line_dedup._longest_common(a, b)
        assert len(m) == length[-1][-1] and all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))


# -- repeats ----------------------------------------------------------------------------------------------------------
def brute_repeats(rows, width):
    seen, out = set(), []
    for _, t in rows:
        raw = (t or "").encode()
        mask = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            w = raw[p : p + width]
            if w in seen:
                mask[p : p + width] = b"\1" * width
            seen.add(w)
        out.append((bytes(b for b, m in zip(raw, mask, strict=True) if not m), len([x for x in bytes(mask).split(b"\0") if x])))
    return out


@pytest.mark.parametrize("rows", [corpus(6), [(1, None), (2, ""), (3, "é" * 60), (4, "x" + "é" * 70)], []], ids=["corpus", "odd", "empty"])
def test_repeats(spark, rows):
    out = {r["doc_id"]: r for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    for (i, t), (kept, n_spans) in zip(rows, brute_repeats(rows, 100), strict=True):
        assert bytes(out[i]["kept"]) == kept and len(out[i]["removed"]) == n_spans and out[i]["n_bytes"] == len((t or "").encode())


def test_repeats_of_repeated_and_null_ids(spark):
    t = "".join(random.Random(7).choices("abc", k=150))
    out = repeats.remove_repeats(frame(spark, [(None, t), (3, t), (3, t)])).collect()
    assert sorted((str(r["doc_id"]), len(r["kept"])) for r in out) == [("3", 0), ("3", 0), ("None", 150)]


@pytest.mark.parametrize("share", [1, 10**9])
def test_hot_grams_lose_nothing(spark, monkeypatch, share):
    """A short line in most documents, repeated within them, and a long passage: with and without hot k-grams."""
    monkeypatch.setattr(repeats, "HOT_SHARE", share)
    rng = random.Random(11)
    text = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    line, passage = " Is it so. ", text(180)
    rows = []
    for k in range(40):
        t = text(rng.randint(0, 90)) + line * rng.randint(0, 30) + text(rng.randint(0, 60))
        rows.append((k, t + passage + text(40) if k % 3 else t + line + text(120)))
    out = {r["doc_id"]: r for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    for (i, _), (kept, n_spans) in zip(rows, brute_repeats(rows, 100), strict=True):
        assert bytes(out[i]["kept"]) == kept and len(out[i]["removed"]) == n_spans


def test_wrong_orders_are_found():
    data = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, dtype=np.uint8)
    sorter = repeats.SuffixSorter(data, 100)
    at = lambda *x: np.array(x)
    assert sorter.verified(at(0, 0), at(200, 100), at(True, False))
    assert not sorter.verified(at(100), at(0), at(False)) and not sorter.verified(at(0), at(200), at(False)) and not sorter.verified(at(0), at(100), at(True))


@pytest.mark.parametrize("seed", range(3))
def test_suffixes_are_sorted(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    at = rng.integers(0, 2900, 800)
    segment = np.sort(rng.integers(0, 9, 800))
    order = repeats.SuffixSorter(data, 100).sort(at, segment)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(800), key=lambda k: (segment[k], raw[at[k] : at[k] + 100]))


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 512)
    text = "".join(random.Random(8).choices("abcd ", k=5000))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([4]), pa.array([text])], ["key", "text"])
    windows = set()
    for _, offsets, texts in repeats._pieces(iter([batch]), 100):
        _, t, first, n, _ = repeats.runs_of(texts, 100, 24)
        windows |= {offsets[a] + b + k for a, b, c in zip(t, first, n, strict=True) for k in range(c)}
    assert windows == set(range(len(text) - 99))
