"""Wide universes: covariances from blocked Gram matrices, leading components by subspace iteration, trees by Boruvka rounds.

A task gathers whole dates of the panel as dense rows, multiplies them by themselves and gives the product in tiles of
``TILE`` x ``TILE`` numbers, which are summed by tile. Rows that are shuffled grow with dates and with tiles, not with pairs of
tickers a date. Missing returns are left out pair by pair, as the self-join by date does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.staging import staged

TILE = 256
#: Rows of dates that are multiplied at once, and the most tickers of a universe: its matrix is held by tasks.
DATES, MOST = 512, 8192
TILES = "i int, j int, n binary, s binary, si binary, sj binary"


def universe(returns: DataFrame) -> list:
    """The panel's tickers, sorted; more than ``MOST`` are an error."""
    tickers = [r["ticker"] for r in returns.select("ticker").distinct().orderBy("ticker").limit(MOST + 1).collect()]
    if len(tickers) > MOST:
        raise ValueError(f"a universe of more than {MOST} tickers")
    return tickers


def gram_tiles(returns: DataFrame, tickers: Sequence, tasks: int | None = None) -> DataFrame:
    """(i, j, n, s, si, sj) for tiles i <= j of tickers: counts, sums of products, and sums of either side's returns over the dates
    that both of a pair have; each a matrix of ``TILE`` x ``TILE`` doubles (the last ones narrower).

    Returns are taken from their ticker's mean first. A task reads about as many dates as there are tickers, so that what it
    gives is no more than what it reads."""
    p = len(tickers)
    spark = returns.sparkSession
    kind = returns.schema["ticker"].dataType.simpleString()
    place = F.broadcast(spark.createDataFrame([(t, k) for k, t in enumerate(tickers)], f"ticker {kind}, place int"))  # MOST rows at most
    clean = returns.where(F.col("ret").isNotNull() & ~F.isnan("ret")).select("date", "ticker", F.col("ret").cast("double").alias("ret"))
    means = F.broadcast(clean.groupBy("ticker").agg(F.avg("ret").alias("mean")))
    rows = clean.join(place, "ticker").join(means, "ticker").select("date", "place", (F.col("ret") - F.col("mean")).alias("ret"))
    if tasks is None:
        tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), returns.select("date").distinct().count() // max(p, DATES)))

    def products(batches):
        s, n, one = np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p))
        x, seen, day, row = np.zeros((DATES, p)), np.zeros((DATES, p)), None, -1

        def add():
            nonlocal s, n, one
            if row >= 0:
                a, m = x[: row + 1], seen[: row + 1]
                s += a.T @ a
                n += m.T @ m
                one += a.T @ m

        for batch in batches:
            dates = batch.column(0).cast(pa.int32()).to_numpy()
            places, values = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(dates[1:] != dates[:-1]) + 1, [len(dates)]]) if len(dates) else np.zeros(1, dtype=int)
            for a, b in zip(cuts[:-1], cuts[1:]):
                if dates[a] != day:
                    if row == DATES - 1:
                        add()
                        x[:], seen[:], row = 0, 0, -1
                    day, row = dates[a], row + 1
                x[row, places[a:b]], seen[row, places[a:b]] = values[a:b], 1
        add()
        if day is not None:
            for i in range(0, p, TILE):
                for j in range(i, p, TILE):
                    at, to = slice(i, i + TILE), slice(j, j + TILE)
                    parts = (n[at, to], s[at, to], one[at, to], one[to, at].T)
                    yield pa.RecordBatch.from_arrays([pa.array([i // TILE], pa.int32()), pa.array([j // TILE], pa.int32()), *[pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()) for m in parts]], names=["i", "j", "n", "s", "si", "sj"])

    def add_up(batches):
        held, key = None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [np.frombuffer(b) for b in row[2:]]
                if row[:2] == key:
                    held = [a + b for a, b in zip(held, parts)]
                else:
                    if held is not None:
                        yield told(key, held)
                    held, key = parts, row[:2]
        if held is not None:
            yield told(key, held)

    def told(key, held):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *[pa.array([m.tobytes()], pa.binary()) for m in held]], names=["i", "j", "n", "s", "si", "sj"])

    partial = rows.repartition(tasks, "date").sortWithinPartitions("date").mapInArrow(products, TILES)
    return partial.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(add_up, TILES)


def _tile(row: dict, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(covariances, counts) of a tile; nan where a pair has fewer than two dates."""
    shape = (min(TILE, p - TILE * row["i"]), min(TILE, p - TILE * row["j"]))
    n, s, si, sj = (np.frombuffer(row[c]).reshape(shape) for c in ("n", "s", "si", "sj"))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 1, (s - si * sj / n) / (n - 1), np.nan), n


def covariance_table(tiles: DataFrame, tickers: Sequence) -> DataFrame:
    """(a, b, cov, n) of the upper triangle, as ``covariance.covariance`` has it; null where a pair has fewer than two dates,
    and no row where it has none."""
    p, kind = len(tickers), "string" if not tickers or isinstance(tickers[0], str) else "long"

    def tell(batches):
        for batch in batches:
            for row in batch.to_pylist():
                cov, n = _tile(row, p)
                a, b = np.nonzero(n)
                a_all, b_all = a + TILE * row["i"], b + TILE * row["j"]
                keep = a_all <= b_all
                a, b, a_all, b_all = a[keep], b[keep], a_all[keep], b_all[keep]
                found = cov[a, b]
                names = pa.array([tickers[k] for k in range(p)], pa.string() if kind == "string" else pa.int64())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a_all)), names.take(pa.array(b_all)), pa.array(found, mask=np.isnan(found)), pa.array(n[a, b].astype(np.int64))], names=["a", "b", "cov", "n"])

    return tiles.mapInArrow(tell, f"a {kind}, b {kind}, cov double, n long")


def leading_components(tiles: DataFrame, tickers: Sequence, k: int = 3, tolerance: float = 1e-10, rounds: int = 200, extra: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; loadings as columns, the largest of each positive) of the covariance by subspace iteration.

    A round multiplies the matrix, a tile a row, by a few vectors that are sent to all tasks; the vectors are then turned to
    those of the small matrix between them. It ends when no residual is above ``tolerance`` of the largest eigenvalue. Missing
    covariances count as 0."""
    p = len(tickers)
    width = min(p, k + extra)
    tiles = tiles if width else tiles.limit(0)

    def times(vectors):
        def multiply(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    cov = np.nan_to_num(_tile(row, p)[0])
                    at, to = slice(TILE * row["i"], TILE * row["i"] + cov.shape[0]), slice(TILE * row["j"], TILE * row["j"] + cov.shape[1])
                    found = [(row["i"], row["j"], cov @ vectors[to])] + ([(row["j"], row["i"], cov.T @ vectors[at])] if row["i"] != row["j"] else [])
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2].tobytes() for f in found], pa.binary())], names=["i", "j", "part"])

        out = np.zeros((p, vectors.shape[1]))
        for r in sorted(tiles.mapInArrow(multiply, "i int, j int, part binary").collect(), key=lambda r: (r["i"], r["j"])):  # tiles times vectors: far less than the matrix
            part = np.frombuffer(r["part"]).reshape(-1, vectors.shape[1])
            out[TILE * r["i"] : TILE * r["i"] + len(part)] += part
        return out

    return subspace(times, p, k, width, tolerance, rounds)


def subspace(times: Callable[[np.ndarray], np.ndarray], p: int, k: int, width: int, tolerance: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """``k`` leading eigenpairs of the p x p matrix that ``times`` multiplies by, from a basis of ``width`` vectors; an error if they
    have not settled after ``rounds``."""
    basis, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((p, width)))
    values = np.zeros(width)
    for _ in range(rounds):
        image = times(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, image = basis @ turn, image @ turn
        residual = np.linalg.norm(image[:, :k] - vectors[:, :k] * values[:k], axis=0).max(initial=0)
        basis = vectors
        if residual <= tolerance * max(abs(values[0]) if len(values) else 0, 1e-300) or width == p:
            break
        basis, _ = np.linalg.qr(image)
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    loadings = basis[:, :k]
    at = np.abs(loadings).argmax(axis=0) if p else np.zeros(0, dtype=int)
    return values[:k], loadings * np.where(loadings[at, np.arange(loadings.shape[1])] < 0, -1.0, 1.0)


def distances(cov: DataFrame) -> DataFrame:
    """(a, b, distance, rho) of pairs a < b of a covariance table: sqrt(2 (1 - rho)); without variance a correlation is 0."""
    from marlstone.operators.covariance import correlation_of

    rho = correlation_of(cov).where("a < b")
    return rho.select("a", "b", F.sqrt(F.greatest(2 * (1 - F.col("rho")), F.lit(0.0))).alias("distance"), "rho")


def spanning_tree_edges(edges: DataFrame, columns: Sequence[str] = ("a", "b"), weight: str = "distance") -> DataFrame:
    """The rows of ``edges`` that are in the minimum spanning tree, or forest, by Boruvka's rounds: each component's least edge
    joins it to another one, so rounds are at most the logarithm of the number of nodes. Of equal edges the first by its ends.

    The table of edges is only scanned and aggregated by component; labels of nodes are joined to it, and one row for each
    component comes back from a round."""
    a, b = columns
    spark = edges.sparkSession
    edges = staged(edges.select(*edges.columns), "edges")
    kind = edges.schema[a].dataType.simpleString()
    nodes = edges.select(F.explode(F.array(a, b)).alias("x")).distinct().toArrow().column(0).to_pylist()
    label = {x: k for k, x in enumerate(sorted(nodes))}
    chosen: set[tuple] = set()

    def root(k, up):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    while len(set(label.values())) > 1:
        known = spark.createDataFrame(pa.table({"node": pa.array(list(label)), "label": pa.array(list(label.values()), pa.int32())})).select(F.col("node").cast(kind), "label")
        ends = edges.join(F.broadcast(known.select(F.col("node").alias(a), F.col("label").alias("__la"))), a).join(F.broadcast(known.select(F.col("node").alias(b), F.col("label").alias("__lb"))), b)
        across = ends.where("__la <> __lb").select(F.explode(F.array("__la", "__lb")).alias("label"), F.struct(F.col(weight).alias("w"), F.col(a).alias("a"), F.col(b).alias("b")).alias("e"))
        least = [r["e"] for r in across.groupBy("label").agg(F.min("e").alias("e")).collect()]  # one row for each component
        if not least:
            break  # a forest
        up = {k: k for k in label.values()}
        for e in least:
            one, other = root(label[e["a"]], up), root(label[e["b"]], up)
            if one != other:
                up[max(one, other)] = min(one, other)
                chosen.add((e["a"], e["b"]))
        label = {x: root(k, up) for x, k in label.items()}
    if not chosen:
        return edges.limit(0)
    ends = zip(*sorted(chosen))
    tree = spark.createDataFrame(pa.table({a: pa.array(next(ends)), b: pa.array(next(ends))})).select(F.col(a).cast(kind), F.col(b).cast(kind))
    return edges.join(F.broadcast(tree), [a, b])


def single_linkage(tree: Sequence[tuple], nodes: Sequence) -> np.ndarray:
    """The merges of single linkage from a spanning tree's edges (one end, other end, height), rows as ``numeric.linkage`` has them."""
    at, size, out = {x: k for k, x in enumerate(nodes)}, [1] * len(nodes), []
    up = list(range(2 * len(nodes)))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b, h in sorted(tree, key=lambda e: (e[2], e[0], e[1])):
        one, other = sorted((root(at[a]), root(at[b])))
        new = len(nodes) + len(out)
        up[one] = up[other] = new
        size.append(size[one] + size[other])
        out.append((one, other, h, size[new]))
    return np.array(out, dtype=float).reshape(-1, 4)
