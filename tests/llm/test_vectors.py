"""Whitening and nearest neighbours against numpy over whole tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, row long, `list` int, score double, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 5, 2, 0.5, "x") for i, v in rows], SCHEMA)


def table(name):
    found = pq.read_table(f"/root/testdata/{name}/embeddings.parquet")
    return found["vec_id"].to_pylist(), np.array(found["embedding"].to_pylist(), dtype=np.float64)


def cosine_table(ids, a, queries):
    """{query place: [(place, cosine)]}, all others, best first."""
    size = np.sqrt((a * a).sum(axis=1))
    return {q: sorted(((j, (a[q] * a[j]).sum() / (size[q] * size[j])) for j in range(len(a)) if j != q), key=lambda x: (-x[1], ids[x[0]])) for q in queries}


@pytest.mark.parametrize("name, least", [("sf0.001", 0.9), ("sf0.1", 0.94)])
def test_recall_and_exact_scores(spark, name, least):
    ids, a = table(name)
    found = ann.query(spark, f"/root/testdata/{name}").collect()
    size = np.sqrt((a * a).sum(axis=1))
    place = {v: k for k, v in enumerate(ids)}
    asked = [i for i in ids if i % 50 == 0]
    assert len(found) == 5 * len(asked)
    hits = 0
    for i in asked:
        q = place[i]
        score = (a @ a[q]) / (size * size[q])
        score[q] = -np.inf
        top = {ids[k] for k in np.argsort(-score)[:5]}
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == i)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[place[v]]) < 1e-12 for _, v, s in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        hits += len(top & {v for _, v, _ in own})
    assert hits >= least * 5 * len(asked)


def test_small_tables_have_all_candidates(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((4, 6)).astype(np.float32).astype(np.float64)
    rows = [(k * 50, list(v)) for k, v in enumerate(a)] + [(7, None), (50 * 9, []), (50 * 10, [0.0] * 6), (50 * 11, [None] * 6), (50 * 12, [float("nan")] * 6), (50 * 13, [1, 2, float("inf")])]
    found = ann.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    truth = cosine_table([k * 50 for k in range(4)], a, range(4))
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == sorted((q * 50, k + 1, j * 50) for q, best in truth.items() for k, (j, _) in enumerate(best))
    assert ann.nearest(frame(spark, rows[4:]), F.lit(True)).collect() == []
    assert ann.nearest(frame(spark, rows[:1]), F.lit(True)).collect() == []
    assert ann.nearest(frame(spark, rows), F.lit(False)).collect() == []


def test_ties_repeats_and_odd_vectors(spark):
    """A third of all rows are one vector; equal cosines go to the smaller id, rows without one come last."""
    rng = np.random.default_rng(2)
    rows = [(k, list(v)) for k, v in enumerate(rng.standard_normal((600, 8)))] + [(1000 + k, [1, 2, 3, 4, 5, 6, 7, 8]) for k in range(298)] + [(None, [1, 2, 3, 4, 5, 6, 7, 8]), (1000, [1, 2, 3, 4, 5, 6, 7, 8])]
    rows += [(5000, [1e30, 1e30]), (5001, [1e-30, 1e-30, 0.0]), (5002, [3.0, 3.0])]
    found = ann.nearest(frame(spark, rows).repartition(7), F.col("vec_id").isin(1000, 1100, 5000)).collect()
    best = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 1100)
    assert [v for _, v, _ in best] == [1000, 1000, 1001, 1002, 1003] and all(abs(s - 1) < 1e-12 for _, _, s in best)
    twice = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == 1000)
    assert twice == sorted([(1, 1000), (2, 1001), (3, 1002), (4, 1003), (5, 1004)] * 2)
    scaled = sorted((r["rank"], r["vec_id"], round(r["score"], 9)) for r in found if r["query_id"] == 5000)
    assert [v for _, v, _ in scaled][:2] == [5001, 5002] and scaled[0][2] == 1


def test_tiles_and_rescans_change_nothing(spark, monkeypatch):
    """With tiny tiles, and with a test that abandons nearly all, the neighbours are those of one tile per list."""
    rng = np.random.default_rng(3)
    vectors = frame(spark, list(enumerate(rng.standard_normal((700, 24)).tolist())))
    asks = F.col("vec_id") % 10 == 0
    whole = sorted(map(tuple, ann.nearest(vectors, asks, recall=1.0).collect()))
    monkeypatch.setattr(ann, "TILE_ROWS", 16)
    monkeypatch.setattr(ann, "TILE_QUERIES", 8)
    again = sorted(map(tuple, ann.nearest(vectors, asks, recall=1.0).collect()))
    assert len(again) == len(whole) == 350
    assert len(set(whole) ^ set(again)) <= 14  # a bound that is nearer or further lets the test err on others
    monkeypatch.setattr(ann, "SURE", -3.0)
    strict = ann.nearest(vectors, asks, recall=1.0).collect()
    assert len(strict) == 350
    truth = cosine_table(list(range(700)), np.array([r["embedding"] for r in vectors.orderBy("vec_id").collect()], dtype=np.float64), range(0, 700, 10))
    few = {q for q in truth if sum(r["query_id"] == q for r in strict) == 5}
    assert few == set(truth)


def test_the_test_abandons_and_the_scan_is_exact_without_it():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((500, 64))
    scan = ann.Scan(a, np.arange(500), np.arange(500), ann.rotation_of(64, 1))
    bound = np.full(20, 8.0)
    query, here, score = scan.search(a[:20], np.arange(20), bound, 5, False)
    size = np.sqrt((a * a).sum(axis=1))
    all_scores = (a[:20] @ a.T) / np.outer(size[:20], size)
    all_scores[np.arange(20), np.arange(20)] = -2
    for q in range(20):
        assert set(here[query == q]) == set(np.argsort(-all_scores[q])[:5])
    query, here, _ = scan.search(a[:20], np.arange(20), 2 - 2 * np.sort(all_scores, axis=1)[:, -5], 5, True)
    kept = sum(len(set(here[query == q]) & set(np.argsort(-all_scores[q])[:5])) for q in range(20))
    assert kept >= 96


def plain_whitening(a, count=4):
    x = np.floor(256 * a).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    gap = fit - sums / n
    values, axes = np.linalg.eigh(gap.T @ gap / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(axis=1), ((x - sums / n) @ axes[:, :count]) / np.sqrt(values[:count]), values[:count] / values.sum()


@pytest.mark.parametrize("name", ["sf0.001", "sf0.1"])
def test_whitening_by_numpy(spark, name):
    ids, a = table(name)
    n, deviation, white, explained = plain_whitening(a)
    place = {v: k for k, v in enumerate(ids)}
    found = whitening.query(spark, f"/root/testdata/{name}").collect()
    assert len(found) == 4 * len(ids)
    got = np.zeros((len(ids), 4))
    for r in found:
        k, c = place[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[k] and abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9
        got[k, c] = r["whitened"]
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-9


def test_whitening_counts_distinct_vectors_once(spark):
    rng = np.random.default_rng(6)
    a = rng.standard_normal((40, 3)).astype(np.float32).astype(np.float64)
    rows = [(k, list(v)) for k, v in enumerate(a)] + [(100, list(a[0]))] * 50 + [(None, list(a[1])), (200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 1.0]), (203, [float("-inf")] * 3), (204, [])]
    found = whitening.whitened(frame(spark, rows).repartition(5)).collect()
    n, deviation, white, _ = plain_whitening(a)
    assert len(found) == 3 * 91 and {r["n"] for r in found} == {40}
    assert {r["vec_id"] for r in found} == {*range(40), 100, None}
    first = {r["component"]: r for r in found if r["vec_id"] == 0}
    assert all(r["whitened"] == first[r["component"]]["whitened"] and r["deviation"] == deviation[0] for r in found if r["vec_id"] == 100)
    assert np.allclose(np.abs([first[c + 1]["whitened"] for c in range(3)]), np.abs(white[0]), atol=1e-9)


def test_whitening_of_odd_tables(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    same = whitening.whitened(frame(spark, [(1, [1, 2]), (2, [1, 2])])).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 and r["explained"] == 0 for r in same)
    line = whitening.whitened(frame(spark, [(1, [1, 0]), (2, [3]), (3, [2, 0])])).collect()  # one dimension varies; a shorter vector ends in zeros
    assert sorted((r["vec_id"], r["component"], r["whitened"] is None) for r in line) == [(v, c, c == 2) for v in (1, 2, 3) for c in (1, 2)]
    large = whitening.whitened(frame(spark, [(1, [1e10, 1]), (2, [-1e10, 1]), (3, [1e30, 0])])).collect()
    assert len(large) == 6 and all(r["deviation"] is None for r in large if r["vec_id"] == 3)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_divide_and_conquer_by_numpy(n):
    rng = np.random.default_rng(n)
    for a in (rng.standard_normal((3 * n, n)), rng.standard_normal((n, n)), np.ones((2, n)), np.diag(np.arange(n) // 2)):
        c = a.T @ a
        values, axes = whitening.sharpened(c, whitening.components_of(c)[1])
        assert np.allclose(values, np.linalg.eigvalsh(c)[::-1], atol=1e-12 * max(1, np.abs(c).sum()))
        assert np.allclose(axes.T @ axes, np.eye(n), atol=1e-12) and np.allclose(c @ axes, axes * values, atol=1e-11 * max(1, np.abs(c).sum()))


def test_polar_factor():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    values, axes = np.linalg.eigh(a)
    assert np.allclose(whitening.polar(a), (axes * np.sign(values)) @ axes.T, atol=1e-12)
