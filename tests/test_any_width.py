"""Universes of more tickers than a task holds a matrix of: the wide queries against their SQL, and blocks against whole matrices."""

import datetime as dt

import duckdb
import numpy as np
import pytest

from marlstone.functions import numeric
from marlstone.operators import gram, wide
from marlstone.plans import catalogue


@pytest.fixture(scope="module")
def lineitem(spark, tmp_path_factory):
    """One price a month of 30 suppliers, some months missing, and copies of the first ten."""
    rng = np.random.default_rng(4)
    prices = np.round(rng.uniform(1000, 100000, (30, 24)), 2)
    months = [dt.datetime(2000 + k // 12, k % 12 + 1, 5) for k in range(24)]
    rows = [(s, months[k], float(prices[s, k])) for s in range(30) for k in range(24) if (s * 5 + k) % 17 != 3]
    rows += [(s + 100, *rest) for s, *rest in rows if s < 10]
    folder = tmp_path_factory.mktemp("wide")
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.fixture(autouse=True)
def narrow(monkeypatch):
    monkeypatch.setattr(gram, "MOST", 20)
    monkeypatch.setattr(wide, "BLOCK", 7)


def twin(folder, name):
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return {r[:2]: r[2:] for r in con.execute(catalogue.oracle_sql()[name]).fetchall()}


def whole(folder):
    con = duckdb.connect()
    rows = con.execute(f"SELECT l_suppkey, l_shipdate, l_extendedprice / 100000 FROM '{folder}/lineitem.parquet/*.parquet'").fetchall()
    tickers, days = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.full((len(tickers), len(days)), np.nan)
    for t, d, v in rows:
        x[tickers.index(t), days.index(d)] = v
    return tickers, x


def panel(spark, x):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=int(k)), f"t{j:03d}", float(x[j, k])) for j, k in zip(*np.nonzero(~np.isnan(x)))]
    return spark.createDataFrame(rows, "date date, ticker string, ret double")


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_components_of_more_tickers_than_a_matrix_has(spark, lineitem, monkeypatch, most):
    monkeypatch.setattr(wide, "MOST", most)
    tickers, x = whole(lineitem)
    pairs = [[x[:, ~np.isnan(a) & ~np.isnan(b)][[i, j]] for j, b in enumerate(x)] for i, a in enumerate(x)]
    w, v = np.linalg.eigh(np.array([[np.cov(p)[0, 1] for p in row] for row in pairs]))
    truth = numeric.sign_fixed(v[:, ::-1][:, :3])
    found = {(r["ticker"], r["component"]): (r["variance"], r["loading"]) for r in catalogue.queries()["components_wide"](spark, lineitem).collect()}
    assert len(found) == 3 * len(tickers)
    for i, t in enumerate(tickers):
        for k in range(3):
            variance, loading = found[t, k + 1]
            assert abs(variance - w[::-1][k]) < 1e-6 and abs(loading - truth[i, k]) < 2e-6


def test_covariances_of_more_tickers_than_a_matrix_has(spark, lineitem):
    found = catalogue.queries()["cov_wide"](spark, lineitem)
    truth = twin(lineitem, "cov_wide")
    assert dict(found.dtypes) == {"a": "bigint", "b": "bigint", "cov": "double", "n": "bigint"}
    rows = {(r["a"], r["b"]): (r["cov"], r["n"]) for r in found.collect()}
    assert len(rows) == 40 * 41 // 2 and rows.keys() == truth.keys()
    for k, (cov, n) in truth.items():
        assert rows[k][1] == n and abs(rows[k][0] - cov) < 2e-9


def test_covariances_of_pairs_with_few_dates(spark, monkeypatch):
    x = np.full((6, 9), np.nan)
    x[0, :], x[1, :4], x[2, 5:], x[3, 3], x[4, [3, 5]] = np.arange(9) ** 2, [1, 5, 2, 2], [3, 3, 3, 3], 7, [1, 2]
    rows = panel(spark, x).union(spark.createDataFrame([(dt.date(2020, 1, 1), "t005", None), (dt.date(2020, 1, 2), "t005", float("nan")), (dt.date(2020, 1, 1), None, 1.0)], "date date, ticker string, ret double"))
    monkeypatch.setattr(wide, "BLOCK", 2)
    monkeypatch.setattr(gram, "MOST", 2)
    found = {(r["a"], r["b"]): (r["cov"], r["n"]) for r in wide.covariances(rows).collect()}
    for i in range(6):
        for j in range(i, 6):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            pair = found.get((f"t{i:03d}", f"t{j:03d}"))
            assert (pair is None) == (not both.any())
            if pair:
                assert pair[1] == both.sum() and (pair[0] is None if both.sum() < 2 else abs(pair[0] - np.cov(x[i, both], x[j, both])[0, 1]) < 1e-9)
    assert wide.covariances(rows.limit(0)).count() == 0


def test_every_pair_of_some_spanning_tree(spark, lineitem):
    """Copies of series are at distance 0 and tie all that leads to them."""
    rows = {(r["a"], r["b"]): (r["distance"], r["rho"]) for r in catalogue.queries()["spanning_tree_wide"](spark, lineitem).collect()}
    truth = twin(lineitem, "spanning_tree_wide")
    assert rows.keys() == truth.keys() and len(rows) > 39
    for k, (distance, rho) in truth.items():
        assert abs(rows[k][0] - distance) < 1e-7 and abs(rows[k][1] - rho) < 2e-9


def plain_trees(x):
    """Pairs that no path of shorter edges joins, written out."""
    edges = {}
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if both.any():
                a, b = x[i], x[j]
                root = np.nanstd(a, ddof=1) * np.nanstd(b, ddof=1) if min((~np.isnan(a)).sum(), (~np.isnan(b)).sum()) > 1 else 0
                rho = np.cov(a[both], b[both])[0, 1] / root if root and both.sum() > 1 else 0.0
                edges[i, j] = float(np.sqrt(2 * (1 - min(1, max(-1, round(rho, 13))))))
    out = set()
    for (i, j), d in edges.items():
        seen = {i}
        while more := {v for e, w in edges.items() if w < d - 1e-9 for u, v in (e, e[::-1]) if u in seen and v not in seen}:
            seen |= more
        if j not in seen:
            out.add((i, j))
    return out


@pytest.mark.parametrize("block, seed", [(2, 0), (5, 1), (64, 2)])
def test_trees_of_odd_panels(spark, monkeypatch, block, seed):
    """Copies that differ by a rounding, scaled and shifted copies, series without variance, of one date, and apart from all others."""
    rng = np.random.default_rng(seed)
    x = np.full((22, 16), np.nan)
    x[:12, :12] = rng.standard_normal((12, 12))
    x[:12, :12][rng.random((12, 12)) < 0.1] = np.nan
    x[12], x[13], x[14], x[15] = x[0] * (1 + 2e-16), 3 * x[1] + 5, x[2], -x[3]
    x[16, :12], x[17, 4], x[18:20, 12:], x[20:, 12:] = 0.1, 2.0, rng.standard_normal((2, 4)), rng.standard_normal(4)
    monkeypatch.setattr(wide, "BLOCK", block)
    found = sorted((int(r["a"][1:]), int(r["b"][1:])) for r in wide.spanning_trees(panel(spark, x)).collect())
    assert found == sorted(plain_trees(x))


def test_trees_of_nothing(spark):
    none = spark.createDataFrame([], "date date, ticker string, ret double")
    assert wide.spanning_trees(none).count() == 0
    assert wide.spanning_trees(spark.createDataFrame([(dt.date(2020, 1, 1), "a", 1.0)], none.schema)).count() == 0


def test_leaf_order_holds_the_longest_edge_of_each_path():
    points = np.random.default_rng(3).standard_normal((30, 2))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    tree = [t for t in numeric.spanning_tree(d) if 9 not in t[:2]]
    order, gaps = wide.leaf_order(tree, 30)
    path = np.full((30, 30), np.inf)
    for a, b, h in tree:
        path[a, b] = path[b, a] = h
    for k in range(30):
        path = np.minimum(path, np.maximum(path[:, k : k + 1], path[k : k + 1]))
    assert sorted(order) == list(range(30))
    for i in range(30):
        for j in range(i + 1, 30):
            assert gaps[i:j].max() == path[order[i], order[j]]


def test_a_basis_that_has_not_settled_is_an_error():
    matrix = np.diag(np.linspace(1, 1.001, 50))
    with pytest.raises(RuntimeError):
        gram.subspace(lambda v: matrix @ v, 50, 3, 5, 1e-10, 10)
