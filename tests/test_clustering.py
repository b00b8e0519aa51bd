"""Complete linkage at any size: pruned tiles, rounds of reciprocal neighbours, equal vectors."""

from pathlib import Path

import numpy as np
import pytest

from lodegrid import session
from lodegrid.operators import clustering as L


def around(rng, n_groups, each, dims=16, width=0.05):
    """Groups of vectors around random directions."""
    centres = rng.standard_normal((n_groups, dims))
    return np.concatenate([c + width * rng.standard_normal((each, dims)) * np.linalg.norm(c) for c in centres])


def frame(spark, vectors):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, v array<double>")


def clusters_of(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["cluster"], []).append(r["item"])
    return sorted(sorted(x) for x in found.values())


def all_links(vectors, threshold):
    unit = L._unit(vectors)
    i, j = np.nonzero(1 - unit @ unit.T < threshold)
    return set(zip(i[i < j].tolist(), j[i < j].tolist(), strict=True))


@pytest.mark.parametrize("most", [15_000, 1, 8])
def test_rounds_give_what_one_task_gives(spark, monkeypatch, most):
    rng = np.random.default_rng(4)
    vectors = around(rng, 6, 12, width=0.2)
    want = L.complete_linkage(vectors, 0.3)
    monkeypatch.setattr(L, "MOST_BLOCK", most)
    out = clusters_of(L.clusters_of_all(frame(spark, vectors), "id", "v", 0.3, tile_rows=16))
    assert out == sorted(sorted(np.flatnonzero(want == k).tolist()) for k in set(want.tolist())) and 1 < max(map(len, out))


def test_equal_vectors_are_one(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_BLOCK", 2)
    rows = [[1.0, 0.0]] * 50 + [[0.99, 0.1]] * 3 + [[0.98, 0.2]] + [[0.0, 0.0]] * 2 + [[-1.0, 0.0]]
    out = clusters_of(L.clusters_of_all(frame(spark, np.array(rows)), "id", "v", 0.05, tile_rows=8))
    assert out == [list(range(54)), [54, 55], [56]]
    assert L.clusters_of_all(frame(spark, np.array(rows)).limit(0), "id", "v").count() == 0


@pytest.mark.parametrize("threshold", [0.05, 0.4, 1.2])
def test_near_pairs_against_brute_force(spark, threshold):
    rng = np.random.default_rng(7)
    vectors = np.concatenate([around(rng, 8, 10, dims=6), np.zeros((2, 6)), -around(rng, 2, 5, dims=6), np.eye(6)])
    got = {(r["a"], r["b"]) for r in L.near_pairs(frame(spark, vectors), "id", "v", threshold, tile_rows=7).collect()}
    assert got == all_links(vectors, threshold)


def test_far_tiles_are_not_compared(spark):
    """On clustered data most pairs of tiles are ruled out, and no link is lost."""
    rng = np.random.default_rng(2)
    vectors = around(rng, 12, 80, dims=8, width=0.02)
    df = frame(spark, vectors)
    rows = df.selectExpr("id as item", "v")
    tiles = [(r["tile"], r["others"]) for r in L.tiled(rows, 0.02, 40)[1].collect()]
    compared = (sum(len(o) for _, o in tiles) + len(tiles)) // 2
    assert len(tiles) > 20 and compared < 0.3 * len(tiles) * (len(tiles) + 1) / 2
    assert all(t in o for t, o in tiles)
    got = {r["item"]: r["component"] for r in L.connected(L.near_links(df, "id", "v", 0.02, tile_rows=40)).collect()}
    label = np.arange(len(vectors))
    i, j = (np.array(x) for x in zip(*all_links(vectors, 0.02), strict=True))
    want = L._forest(i, j, len(label))
    assert got == {k: int(want[k]) for k in range(len(want)) if k in got} and set(np.flatnonzero(want != label)) <= set(got)


@pytest.mark.parametrize(("edges_in_one", "pairs_a_row", "most_merges"), [(0, 500, 10), (40, 500, 10**6), (10**6, 500, 0), (0, -1, 0)])
def test_all_ways_give_one_result(spark, monkeypatch, edges_in_one, pairs_a_row, most_merges):
    """Pairs at once or components first, rounds over all executors or in one task, merges broadcast or not."""
    rng = np.random.default_rng(11)
    vectors = around(rng, 5, 12, width=0.25)
    want = L.complete_linkage(vectors, 0.4)
    for name, value in (("EDGES_IN_ONE", edges_in_one), ("PAIRS_A_ROW", pairs_a_row), ("MOST_MERGES", most_merges), ("MOST_BLOCK", 8)):
        monkeypatch.setattr(L, name, value, raising=False)
    out = clusters_of(L.clusters_of_all(frame(spark, vectors), "id", "v", 0.4, tile_rows=16))
    assert out == sorted(sorted(np.flatnonzero(want == k).tolist()) for k in set(want.tolist())) and 1 < max(map(len, out))


@pytest.mark.parametrize("kind", ["double", "float"])
def test_a_row_is_sent_once_for_each_group_of_tiles(spark, kind):
    """Copies of a row don't grow with the number of tiles, and no pair is lost or found twice."""
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.standard_normal((300, 5)), around(rng, 10, 10, dims=5)]).astype("f4").astype(float)
    df = frame(spark, vectors).selectExpr("id", f"cast(v as array<{kind}>) as v")
    sent, _ = L._near_tiles(df, "id", "v", 0.9, 7)
    assert sent.count() <= 26 * len(vectors) and dict(sent.dtypes)["v"] == f"array<{kind}>"
    got = [(r["a"], r["b"]) for r in L.near_pairs(df, "id", "v", 0.3, tile_rows=7).collect()]
    assert len(got) == len(set(got)) and set(got) == all_links(vectors, 0.3)


def test_rounds_delete_what_they_wrote(spark, monkeypatch):
    monkeypatch.setattr(L, "EDGES_IN_ONE", 0, raising=False)
    folder = Path(session._shared(spark).removeprefix("file://"))
    pairs = spark.createDataFrame([(k, k + 1, 0.1 + k / 1000) for k in range(6)], "a long, b long, distance double")
    before = len(list(folder.iterdir())) if folder.exists() else 0
    out = L.linked_by_rounds(pairs)
    assert len(list(folder.iterdir())) - before <= 2
    assert clusters_of(out) == [[0, 1], [2, 3], [4, 5], [6]]
