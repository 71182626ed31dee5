"""Universes of any width: covariances, leading components and trees from pairs of blocks of tickers.

A strip is a block's returns on all dates, small enough for a task; each two strips meet in a task, which computes what
it is asked of their pairs and gives no matrix of the universe to anyone. Strips are shuffled once for each block they meet, so
rows that move grow with the panel times the number of blocks; what is computed grows with the pairs, as the results do. The driver
holds numbers in proportion to the tickers. For panels of more dates than tickers ``gram`` has tiles that are summed over dates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import gram
from marlstone.staging import staged

#: Tickers of a block at most, and numbers of a strip at most (long panels have narrower blocks).
BLOCK, CELLS = 1024, 1 << 22
#: Numbers that the driver and a task hold of sums over the tickers of one set of dates, at most; more sets go by pairs.
MOST = 1 << 24
#: Pairs of a batch that leaves a task, and how far above the path's longest edge another edge still counts as equal to it.
ROWS, EQUAL = 1 << 16, 1e-12


class Strips:
    """The panel in strips: ``table`` (block, x), x the returns of tickers[block * width :] less their means, a row each, nan where missing.

    ``unit`` divides them by their deviations; 0 where a series has none."""

    def __init__(self, returns: DataFrame, tickers: Sequence, unit: bool = False):
        spark = returns.sparkSession
        clean = returns.where(F.col("ret").isNotNull() & ~F.isnan("ret")).select(F.unix_date("date").alias("day"), "ticker", F.col("ret").cast("double").alias("ret"))
        days = np.sort(clean.select("day").distinct().toArrow().column(0).to_numpy())  # a type of date has few
        self.spark, self.tickers, self.days = spark, list(tickers), len(days)
        self.width = width = max(1, min(BLOCK, CELLS // max(1, len(days))))
        self.blocks = max(1, -(-len(self.tickers) // width))
        p = len(self.tickers)
        place = F.broadcast(table(spark, [self.tickers, range(p)], [("ticker", returns.schema["ticker"].dataType.simpleString()), ("place", "int")]))
        rows = clean.join(place, "ticker").select((F.col("place") / width).cast("int").alias("block"), "day", "place", "ret")

        def build(rows: pa.Table) -> pa.Table:
            block = rows.column("block")[0].as_py()
            x = np.full((min(width, p - block * width), len(days)), np.nan)
            x[rows.column("place").to_numpy() - block * width, np.searchsorted(days, rows.column("day").to_numpy())] = rows.column("ret").to_numpy()
            seen = ~np.isnan(x)
            n = seen.sum(axis=1)
            flat = np.where(seen, x, -np.inf).max(axis=1) == np.where(seen, x, np.inf).min(axis=1)
            x -= (np.nansum(x, axis=1) / np.maximum(n, 1))[:, None]
            if unit:
                root = np.sqrt(np.nansum(x * x, axis=1) / np.maximum(n - 1, 1))
                none = flat | (n < 2) | (root == 0)
                x = np.where(seen & none[:, None], 0.0, x / np.where(none, 1.0, root)[:, None])
            return pa.table({"block": pa.array([block], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})

        self.table = staged(rows.groupBy("block").applyInArrow(build, "block int, x binary"), "strips")

    def pairs(self, tell: Callable[[int, int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``tell(i, j, strip i, strip j)`` gives for the blocks i <= j."""
        days, blocks = self.days, self.blocks
        other = self.table.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        both = other.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "x")
        tasks = min(blocks * (blocks + 1) // 2, 1024)

        def run(batches):
            key, first = None, None
            for batch in batches:
                for at in range(batch.num_rows):
                    i, j = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                    x = np.frombuffer(batch.column(3)[at].as_buffer()).reshape(-1, days)
                    if i == j:
                        yield from tell(i, j, x, x)
                    elif key == (i, j):
                        yield from tell(i, j, first, x)
                    key, first = (i, j), x

        return both.repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "block").mapInArrow(run, schema)


def table(spark, columns: Sequence[Sequence], names: Sequence[tuple[str, str]]) -> DataFrame:
    """A small table of columns."""
    rows = spark.createDataFrame(pa.table({f"c{k}": pa.array(c) for k, c in enumerate(columns)})) if len(columns[0]) else spark.createDataFrame([], ", ".join(f"c{k} {kind}" for k, (_, kind) in enumerate(names)))
    return rows.select(*(F.col(f"c{k}").cast(kind).alias(name) for k, (name, kind) in enumerate(names)))


def universe(returns: DataFrame) -> list:
    """The panel's tickers, sorted: as many as there are, as everything here goes with their pairs."""
    return returns.where("ticker is not null").select("ticker").distinct().orderBy("ticker").toArrow().column(0).to_pylist()


def joint(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(covariances, counts) of the rows of two strips over the dates that both of a pair have; nan where these are fewer than two."""
    seen, known = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
    a, b = np.nan_to_num(a), np.nan_to_num(b)
    n = seen @ known.T
    cov = a @ known.T
    cov *= seen @ b.T
    with np.errstate(invalid="ignore", divide="ignore"):
        cov /= n
        np.subtract(a @ b.T, cov, out=cov)
        cov /= n - 1
    if n.min(initial=2) < 2:
        cov[n < 2] = np.nan
    return cov, n


def covariances(returns: DataFrame, places: int | None = None) -> DataFrame:
    """(a, b, cov, n) of the upper triangle, as ``gram.covariance_table`` has it, for a universe of any width. ``places`` rounds
    where the numbers are made, which costs far less than a column expression a row."""
    tickers = universe(returns)
    if tall(returns, tickers):
        found = gram.covariance_table(staged(gram.gram_tiles(returns, tickers), "tiles"), tickers)
        return found if places is None else found.withColumn("cov", F.round("cov", places))
    strips, kind = Strips(returns, tickers), "string" if isinstance(tickers[0], str) else "bigint"
    width, names = strips.width, pa.array(tickers, pa.string() if kind == "string" else pa.int64())

    def tell(i, j, a, b):
        cov, n = joint(a, b)
        if places is not None:
            cov = np.round(cov, places) + 0.0
        if i == j or n.min() < 1:
            row, column = np.nonzero(np.triu(n) if i == j else n)
            cov, n = cov[row, column], n[row, column]
        else:
            row, column, cov, n = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a)), cov.ravel(), n.ravel()
        one, other = names[i * width : i * width + len(a)], names[j * width : j * width + len(b)]
        for at in range(0, len(row), ROWS):
            some = slice(at, at + ROWS)
            yield pa.RecordBatch.from_arrays([one.take(pa.array(row[some])), other.take(pa.array(column[some])), pa.array(cov[some], mask=np.isnan(cov[some])), pa.array(n[some].astype(np.int64))], names=["a", "b", "cov", "n"])

    return strips.pairs(tell, f"a {kind}, b {kind}, cov double, n long")


def tall(returns: DataFrame, tickers: Sequence) -> bool:
    """Whether sums over dates are the better plan: a universe of one block, or one that a task holds and that has more dates."""
    return len(tickers) <= BLOCK or (len(tickers) <= gram.MOST and len(tickers) <= returns.select("date").distinct().count())


def leading_components(returns: DataFrame, k: int = 3, tolerance: float = 1e-10, rounds: int = 200, width: int = 96) -> tuple[list, np.ndarray, np.ndarray]:
    """(tickers, eigenvalues, loadings) as ``gram.leading_components`` has them, for a universe of any width.

    A round multiplies the covariance, which is not made, by the basis: through dates, or over all pairs where nearly every series misses
    dates of its own. The covariance of few dates has little beside as many components, so a basis of somewhat more vectors than
    dates (``width`` at most) settles within some rounds."""
    tickers = universe(returns)
    if tall(returns, tickers):
        return tickers, *gram.leading_components(staged(gram.gram_tiles(returns, tickers), "tiles"), tickers, k, tolerance, rounds, max(8, width - k))
    strips, p = Strips(returns, tickers), len(tickers)
    basis = min(p, max(k + 8, min(strips.days + 8, width)))
    kinds, order = _kinds(strips, MOST // max(1, strips.days * basis))
    if kinds is None:
        values, vectors = gram.subspace(_times_pairs(strips), p, k, basis, tolerance, rounds)
        return tickers, values, vectors
    strips = Strips(returns, [tickers[n] for n in order])
    values, vectors = gram.subspace(_times_kinds(strips, kinds), p, k, basis, tolerance, rounds)
    return strips.tickers, values, vectors


def _kinds(strips: Strips, most: int) -> tuple[np.ndarray | None, list | None]:
    """(the sets of dates on which tickers have returns, a row each; the tickers' places by them), or nothing if the sets
    and blocks are more than ``most``."""
    days, wide = strips.days, strips.width

    def tell(batches):
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen = np.packbits(~np.isnan(np.frombuffer(x.as_buffer()).reshape(-1, days)), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen)) + block * wide), pa.array([m.tobytes() for m in seen], pa.binary())], names=["place", "kind"])

    rows = strips.table.select("block", "x").mapInArrow(tell, "place long, kind binary")
    found = sorted(r["kind"] for r in rows.select("kind").distinct().limit(max(0, most - strips.blocks) + 1).collect())
    if len(found) + strips.blocks > most:
        return None, None
    number = table(strips.spark, [found, range(len(found))], [("kind", "binary"), ("number", "int")])
    placed = rows.join(F.broadcast(number), "kind").select("place", "number").toArrow()  # two numbers for each ticker
    order = placed.column("place").to_numpy()[np.lexsort((placed.column("place").to_numpy(), placed.column("number").to_numpy()))]
    missing = np.setdiff1d(np.arange(len(strips.tickers)), order)  # blocks without any return
    bits = np.unpackbits(np.array([np.frombuffer(m, dtype=np.uint8) for m in found]).reshape(len(found), -(-days // 8)), axis=1, count=days)
    return bits.astype(bool), np.concatenate([order, missing]).tolist()


def _times_kinds(strips: Strips, kinds: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Products with the covariance that go through dates: the tickers of one set of dates are alike in how many dates they share with
    those of another, so a sum over their pairs is made of sums of either side. Work is in proportion to the panel."""
    days, wide, p = strips.days, strips.width, len(strips.tickers)
    number = {m.tobytes(): g for g, m in enumerate(np.packbits(kinds, axis=1))}
    seen = kinds.astype(float)

    def each(batches):
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(x.as_buffer()).reshape(-1, days)
                yield block, np.nan_to_num(x), np.array([number[m.tobytes()] for m in np.packbits(~np.isnan(x), axis=1)])

    def told(at, m):
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())], names=["at", "part"])

    def times(vectors):
        q = vectors.shape[1]

        def sums(batches):
            for block, x, kind in each(batches):
                for g in np.unique(kind):
                    yield told(g, x[kind == g].T @ vectors[block * wide : block * wide + len(x)][kind == g])

        def products(batches):
            for block, x, kind in each(batches):
                out = np.zeros((len(x), q))
                for g in np.unique(kind):
                    n = seen @ seen[g]
                    weight = np.where(n > 1, 1 / np.maximum(n - 1, 1), 0.0)
                    mean = np.tensordot(seen[g], by_kind, (0, 1)) * (weight / np.maximum(n, 1))[:, None]
                    out[kind == g] = x[kind == g] @ (np.tensordot(weight, by_kind, 1) - seen.T @ mean)
                yield told(block, out)

        def gathered(run):
            got = strips.table.select("block", "x").mapInArrow(run, "at int, part binary").toArrow()
            return sorted(zip(got.column("at").to_pylist(), (np.frombuffer(m.as_buffer()).reshape(-1, q) for m in got.column("part"))), key=lambda r: r[0])

        by_kind, out = np.zeros((len(kinds), days, q)), np.zeros((p, q))
        for g, part in gathered(sums):
            by_kind[g] += part
        for block, part in gathered(products):
            out[block * wide : block * wide + len(part)] = part
        return out

    return times


def _times_pairs(strips: Strips) -> Callable[[np.ndarray], np.ndarray]:
    """Products with the covariance, made anew for each pair of blocks."""
    wide, p = strips.width, len(strips.tickers)

    def times(vectors):
        q = vectors.shape[1]

        def tell(i, j, a, b):
            cov = np.nan_to_num(joint(a, b)[0])
            parts = [(i, cov @ vectors[j * wide : (j + 1) * wide])] + ([(j, cov.T @ vectors[i * wide : (i + 1) * wide])] if i != j else [])
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([j if b == i else i for b, _ in parts], pa.int32()), pa.array([m.tobytes() for _, m in parts], pa.binary())], names=["block", "other", "part"])

        def add(rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(part.as_buffer()) for _, part in sorted(zip(rows.column("other").to_pylist(), rows.column("part")), key=lambda r: r[0]))
            return pa.table({"block": rows.column("block").combine_chunks()[:1], "part": pa.array([total.tobytes()], pa.binary())})

        out = np.zeros((p, q))
        for block, part in zip(*(c.to_pylist() for c in strips.pairs(tell, "block int, other int, part binary").groupBy("block").applyInArrow(add, "block int, part binary").toArrow().columns)):  # a row of the basis' width for each ticker
            part = np.frombuffer(part).reshape(-1, q)
            out[block * wide : block * wide + len(part)] = part
        return out

    return times


def _near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distances, correlations, counts) of the rows of two unit strips. A correlation within 1e-6 of 1 has too few digits left for its
    distance, which is then taken from the differences, if both series have the same dates."""
    rho, n = joint(a, b)
    rho = np.clip(np.nan_to_num(rho), -1.0, 1.0)
    distance = np.sqrt(2 * (1 - rho))
    row, column = np.nonzero(rho > 1 - 1e-6)
    step = max(1, CELLS // max(1, 4 * a.shape[1]))
    for at in range(0, len(row), step):
        r, c = row[at : at + step], column[at : at + step]
        x, y = a[r], b[c]
        same = (np.isnan(x) == np.isnan(y)).all(axis=1)
        r, c, gap = r[same], c[same], np.nansum((x[same] - y[same]) ** 2, axis=1)
        gap /= n[r, c] - 1
        distance[r, c], rho[r, c] = np.sqrt(gap), 1 - gap / 2
    return distance, rho, n


def _forest(distance: np.ndarray, one: bool) -> list[tuple[int, int]]:
    """The places (row, column) of the least spanning forest's edges, inf for no edge: between rows and columns as different nodes,
    or of ``one`` set of nodes, by Prim's steps."""
    p, q = distance.shape
    turned = np.ascontiguousarray(distance.T)
    start = 0 if one else p
    nodes = q + start
    best, origin, left = np.full(nodes, np.inf), np.zeros(nodes, dtype=np.int64), np.ones(nodes, dtype=bool)
    best_open, out = best.copy(), []
    for _ in range(nodes):
        node = int(best_open.argmin())
        if best_open[node] == np.inf:
            node = int(left.argmax())  # the next tree
        else:
            out.append((int(origin[node]), node))
        left[node], best_open[node] = False, np.inf
        of, base = (distance[node], start) if node < p else (turned[node - p], 0)
        view = slice(base, base + len(of))
        closer = np.flatnonzero((of < best_open[view]) & left[view])
        best_open[base + closer] = of[closer]
        origin[base + closer] = node
    if one:
        return out
    return [(min(e), max(e) - p) for e in out]


def leaf_order(tree: Sequence[tuple[int, int, float]], p: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, gaps) of single linkage's leaves: the longest edge on the tree's path between two leaves is the largest gap between them
    in this order; inf where no path is."""
    up, last, after, gap = list(range(p)), list(range(p)), [-1] * p, [np.inf] * p

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b, height in sorted(tree, key=lambda e: (e[2], e[0], e[1])):
        a, b = root(a), root(b)
        after[last[a]], gap[last[a]] = b, height  # a root is its chain's first leaf
        up[b], last[a] = a, last[b]
    order = []
    for k in range(p):
        if up[k] == k:
            while k >= 0:
                order.append(k)
                k = after[k]
    return np.array(order, dtype=np.int64), np.array([gap[k] for k in order])


def spanning_trees(returns: DataFrame) -> DataFrame:
    """(a, b, distance, rho) of all pairs a < b that are in some minimum spanning tree of sqrt(2 (1 - rho)), so that equal edges, as of
    copies of a series, don't depend on their order; one tree where no two paths are equal.

    Each two blocks give the forest of their own pairs, which keeps what is connected at every distance; the tree of
    these forests is one of all pairs. A second pass tells which pairs are no longer than the longest edge of the tree's path."""
    tickers = universe(returns)
    p, spark = len(tickers), returns.sparkSession
    strips = Strips(returns, tickers, unit=True)
    width = strips.width

    def forests(i, j, a, b):
        distance, _, n = _near(a, b)
        distance[n < 1] = np.inf
        if i == j:
            np.fill_diagonal(distance, np.inf)
        edges = np.array(_forest(distance, i == j), dtype=np.int64).reshape(-1, 2)
        ends = edges + [i * width, j * width]
        yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1)), pa.array(distance[edges[:, 0], edges[:, 1]])], names=["a", "b", "distance"])

    tree = gram.spanning_tree_edges(strips.pairs(forests, "a long, b long, distance double")).toArrow()  # a row for each ticker
    order, gaps = leaf_order(list(zip(*(tree.column(c).to_pylist() for c in ("a", "b", "distance")))), p)
    kind = "string" if p and isinstance(tickers[0], str) else "bigint"
    names = pa.array(tickers, pa.string() if kind == "string" else pa.int64())
    strips = Strips(returns, [tickers[k] for k in order], unit=True)

    def ties(i, j, a, b):
        distance, rho, n = _near(a, b)
        start, to = i * width, j * width
        if i == j:
            limit = np.full((len(a), len(a)), -np.inf)
            for k in range(len(a) - 1):
                limit[k, k + 1 :] = np.maximum.accumulate(gaps[start + k : start + len(a) - 1])
        else:
            before = np.maximum.accumulate(gaps[start:to][::-1])[::-1][: len(a)]
            within = np.concatenate([[-np.inf], np.maximum.accumulate(gaps[to : to + len(b) - 1])])
            limit = np.maximum.outer(before, within)
        row, column = np.nonzero((distance <= limit + EQUAL) & (n > 0))
        for at in range(0, len(row), ROWS):
            r, c = row[at : at + ROWS], column[at : at + ROWS]
            one, other = order[r + start], order[c + to]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.minimum(one, other))), names.take(pa.array(np.maximum(one, other))), pa.array(distance[r, c]), pa.array(rho[r, c])], names=["a", "b", "distance", "rho"])

    return strips.pairs(ties, f"a {kind}, b {kind}, distance double, rho double")
