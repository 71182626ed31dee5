"""Tiles, components, trees and clusters of wide universes against whole matrices."""

import datetime as dt
import math
import time

import numpy as np
import pytest

from marlstone.functions import numeric
from marlstone.operators import covariance, gram


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 3)) @ rng.standard_normal((3, 9)) + 0.3 * rng.standard_normal((60, 9))
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=k), f"t{j}", float(x[k, j])) for k in range(60) for j in range(9) if (k * j) % 11 != 3]
    rows += [(dt.date(2021, 1, 1), "lone", 1.0), (dt.date(2021, 1, 2), "t1", None), (dt.date(2021, 1, 2), "t2", float("nan"))]
    return spark.createDataFrame(rows, "date date, ticker string, ret double").repartition(5)


@pytest.mark.parametrize("tile, dates, tasks", [(256, 512, 1), (4, 7, 3), (1, 1, 5)])
def test_tiles_give_the_covariances_of_pairs(panel, monkeypatch, tile, dates, tasks):
    monkeypatch.setattr(gram, "TILE", tile)
    monkeypatch.setattr(gram, "DATES", dates)
    tickers = gram.universe(panel)
    found = {(r["a"], r["b"]): (r["cov"], r["n"]) for r in gram.covariance_table(gram.gram_tiles(panel, tickers, tasks), tickers).collect()}
    truth = {(r["a"], r["b"]): (r["cov"], r["n"]) for r in covariance.covariance(panel.dropna().where("not isnan(ret)")).collect()}
    assert found.keys() == truth.keys()
    for k, (cov, n) in truth.items():
        assert found[k][1] == n and (found[k][0] is None if n < 2 else math.isclose(found[k][0], cov, rel_tol=1e-9, abs_tol=1e-12))


def test_leading_components(panel, monkeypatch):
    monkeypatch.setattr(gram, "TILE", 4)
    whole = panel.where("ticker <> 'lone' and ret is not null and not isnan(ret)")
    tickers = gram.universe(whole)
    tiles = gram.gram_tiles(whole, tickers, 2)
    cov = covariance.matrix(covariance.covariance(whole), tickers, "cov")
    values, loadings = gram.leading_components(tiles, tickers, 2, extra=2)
    w, v = np.linalg.eigh(cov)
    assert np.allclose(values, w[::-1][:2], rtol=1e-9)
    assert np.allclose(loadings, numeric.sign_fixed(v[:, ::-1][:, :2]), atol=1e-7)


def test_empty_and_wide(spark, monkeypatch):
    none = spark.createDataFrame([], "date date, ticker string, ret double")
    assert gram.universe(none) == [] and gram.covariance_table(gram.gram_tiles(none, []), []).collect() == []
    monkeypatch.setattr(gram, "MOST", 2)
    with pytest.raises(ValueError):
        gram.universe(spark.createDataFrame([(dt.date(2020, 1, 1), t, 1.0) for t in "abc"], "date date, ticker string, ret double"))


def test_boruvka_is_prim(spark):
    rng = np.random.default_rng(2)
    points = rng.standard_normal((40, 3))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    edges = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(40) for j in range(i + 1, 40)], "a long, b long, distance double").repartition(4)
    found = sorted((r["a"], r["b"]) for r in gram.spanning_tree_edges(edges).collect())
    assert found == sorted((a, b) for a, b, _ in numeric.spanning_tree(d))
    merges = gram.single_linkage([tuple(r) for r in gram.spanning_tree_edges(edges).select("a", "b", "distance").collect()], range(40))
    assert np.allclose(merges, numeric.linkage(d, "single"))
    forest = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), ("b", "a", 1.0)], "a string, b string, distance double")
    assert len(gram.spanning_tree_edges(forest).select("a", "b").collect()) == 2
    equal = spark.createDataFrame([(i, j, 1.0) for i in range(7) for j in range(i + 1, 7)], "a long, b long, distance double")
    assert gram.spanning_tree_edges(equal).count() == 6


def closest_pairs(distance, method):
    """Merges by a search of all pairs at each step, written out."""
    n = len(distance)
    members = {k: [k] for k in range(n)}
    d = {(i, j): distance[i, j] for i in range(n) for j in range(i + 1, n)}
    out = []
    for step in range(n - 1):
        (a, b), h = min(d.items(), key=lambda x: (x[1], x[0]))
        new = n + step
        for c in members:
            if c not in (a, b):
                ac, bc = d[min(a, c), max(a, c)], d[min(b, c), max(b, c)]
                na, nb, nc = len(members[a]), len(members[b]), len(members[c])
                ward = math.sqrt(max(0, ((na + nc) * ac**2 + (nb + nc) * bc**2 - nc * h**2) / (na + nb + nc)))
                d[c, new] = {"single": min(ac, bc), "complete": max(ac, bc), "average": (na * ac + nb * bc) / (na + nb), "ward": ward}[method]
        members[new] = members.pop(a) + members.pop(b)
        d = {k: v for k, v in d.items() if a not in k and b not in k}
        out.append((a, b, h, len(members[new])))
    return np.array(out, dtype=float).reshape(-1, 4)


@pytest.mark.parametrize("method", ["single", "complete", "average", "ward"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 40])
def test_chains_merge_the_closest_pairs(method, n):
    rng = np.random.default_rng(n)
    points = rng.standard_normal((n, 4))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    assert np.allclose(numeric.linkage(d, method), closest_pairs(d, method))


def test_two_thousand_assets_take_seconds():
    points = np.random.default_rng(1).standard_normal((2000, 5))
    d = np.sqrt(np.maximum(((points**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None] - 2 * points @ points.T), 0))
    began = time.time()
    merges = numeric.linkage(d, "ward")
    assert len(merges) == 1999 and (np.diff(merges[:, 2]) >= -1e-9).all() and merges[-1, 3] == 2000
    assert time.time() - began < 30
