"""Approximate nearest neighbours: inverted lists whose rotated vectors are scanned in column blocks, where a hypothesis test
abandons candidates early.

A sample of bounded size gives the lists' centres. Every row goes to its nearest list. How many lists a query probes is
measured: for a bounded number of queries the true neighbours among all rows are found, and the fewest lists are taken that
hold ``RECALL`` of them. A list's rows and the queries that probe it meet in tiles of bounded size, so a list with a third of
all rows, or one that all queries probe, is many tasks. In a tile, vectors turned by one random rotation are read
``WIDTH`` columns at a time. After d of D columns a squared distance is estimated as D/d times its partial sum; a candidate is
abandoned when its estimated distance is above (1 + SURE / sqrt(d)) times the query's bound, the distance of its k-th nearest
so far. What is left is scored exactly on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import shuffle_partitions, staged
from marlstone.llm.vectors import cosines, lengths, matrix, scaled, small, usable, widest

#: Rows that fit the centres, those of them that give queries their first bound, and queries whose recall is measured.
SAMPLE, BOUND_SAMPLE, MEASURED = 16_384, 4096, 256
#: Most lists. Their centres, a row of a vector's length each, are sent to all tasks.
LISTS = 1024
#: Share of the true neighbours that the probed lists must hold.
RECALL = 0.97
#: Columns that are read at a time, and the test's confidence in units of the estimate's spread.
WIDTH, SURE = 16, 2.1
#: Rows and queries of a tile.
TILE_ROWS, TILE_QUERIES = 4096, 16_384
#: Squared distances of unit vectors this near to the bound are kept: rounding of the rotation is far below it.
SLACK = 1e-9
ROWS = "query long, query_id long, vec_id long, row long, score double"


def centres_of(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of ``k`` lists by spherical k-means, starting from the sample's first distinct rows."""
    start = np.sort(np.unique(sample, axis=0, return_index=True)[1])[:k]
    centres = sample[start].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = lengths(sums)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def rotation_of(dims: int, seed: int) -> np.ndarray:
    """A random rotation, uniform over all."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def unit(a: np.ndarray) -> np.ndarray:
    a = scaled(a)
    return a / lengths(a)[:, None]


def _top(rows: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best rows, ranked: highest score, then smallest id, null last, then smallest row."""
    best = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*best))).where(F.col("rank") <= k)


def _best(own: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each query: highest score, then smallest id, then smallest row."""
    order = np.lexsort((row, ids, -score, own))
    sorted_own = own[order]
    first = np.concatenate([[True], sorted_own[1:] != sorted_own[:-1]]) if len(order) else np.empty(0, dtype=bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    return order[np.arange(len(order)) - begin < k]


def _ids(column) -> np.ndarray:
    """Ids as numbers; null is the largest."""
    return column.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)


def _found(query, query_id, ids, row, score) -> pa.RecordBatch:
    null = ids == np.iinfo(np.int64).max
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(query_id, pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(row, pa.int64()), pa.array(score, pa.float64())], names=["query", "query_id", "vec_id", "row", "score"])


class Scan:
    """One tile's rows: rotated unit vectors by blocks of columns, and the original vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, row: np.ndarray, rotation: np.ndarray):
        self.vectors, self.ids, self.row = scaled(vectors), ids, row
        self.length = lengths(self.vectors)
        turned = (self.vectors / self.length[:, None]) @ rotation
        self.dims = len(rotation)
        self.cuts = [(a, min(a + WIDTH, self.dims)) for a in range(0, self.dims, WIDTH)]
        self.blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in self.cuts]
        self.rotation = rotation

    def search(self, vectors: np.ndarray, row: np.ndarray, bound: np.ndarray, k: int, test: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, place of the row, cosine) of each query's ``k`` best rows here that lie within its bound, a
        squared distance of unit vectors."""
        vectors = scaled(vectors)
        length = lengths(vectors)
        turned = (vectors / length[:, None]) @ self.rotation
        query = here = part = None
        for (a, b), block in zip(self.cuts, self.blocks):
            mine = turned[:, a:b]
            if query is None:
                part = (mine * mine).sum(axis=1)[:, None] + (block * block).sum(axis=1)[None, :] - 2 * (mine @ block.T)
                keep = row[:, None] != self.row[None, :]
                if test:
                    keep &= part * (self.dims / b) <= (bound * (1 + SURE / np.sqrt(b)) ** 2)[:, None] + SLACK
                query, here = np.nonzero(keep)
                part = part[query, here]
            else:
                gap = mine[query] - block[here]
                part = part + (gap * gap).sum(axis=1)
                # when all columns are read the partial sum is the distance
                limit = (1 + SURE / np.sqrt(b)) ** 2 * b / self.dims if test and b < self.dims else 1.0
                keep = part <= bound[query] * limit + SLACK if test or b == self.dims else np.ones(len(part), dtype=bool)
                query, here, part = query[keep], here[keep], part[keep]
        # the k-th nearest here is a bound as well: of the rest only what may tie with it is scored
        order = np.lexsort((part, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        kth = np.full(len(row), np.inf)
        kth[query[order[rank == k - 1]]] = part[order[rank == k - 1]]
        keep = part <= kth[query] + SLACK
        query, here = query[keep], here[keep]
        score = cosines(vectors[query], self.vectors[here], length[query], self.length[here])
        best = _best(query, score, self.ids[here], self.row[here], k)
        return query[best], here[best], score[best]


def nearest(vectors: DataFrame, queries, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which the condition ``queries`` holds, its ``k`` nearest found.

    Nearness is the cosine, in double precision on the original vectors; equal ones go to the smaller id. Vectors that are
    null, empty, zero or hold nulls or non-finite entries take no part; where lengths differ, shorter vectors end in zeros.
    Ids must be integers or null: rows without one are candidates, after all others among equals. Repeated rows are
    candidates each on their own; only the query's own row is none, so a repeated id may be its own neighbour. A query has
    all candidates where there are fewer than ``k``. An empty table gives no rows; other columns are ignored, whatever
    their names. What goes to all tasks is bounded: centres, one rotation, ``BOUND_SAMPLE`` vectors.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")), "vector")
    rows = staged(rows.where(F.exists("vector", lambda c: c != 0)).withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    n, dims = widest(rows, "vector")
    if n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def sample(of: DataFrame, count: int, total: int):
        """``count`` rows by a hash of id and vector, whatever the layout. Twice as many are let through before they are sorted."""
        mark = F.xxhash64("vec_id", "vector")
        share = of.where(F.pmod(mark, F.lit(1 << 30)) < min(1 << 30, int(2 * count / max(1, total) * (1 << 30)) + (64 << 30) // max(1, total)))
        found = share.orderBy(mark, "row").limit(count).select("row", "vec_id", "vector").toArrow()
        return matrix(found.column("vector").combine_chunks(), dims) if len(found) else np.zeros((0, dims)), found.column("row").to_numpy(), found.column("vec_id").to_pylist()

    drawn, drawn_rows, _ = sample(rows, SAMPLE, n)
    drawn = unit(drawn)
    centres = centres_of(drawn, max(1, min(LISTS, int(n**0.5))))
    lists = len(centres)
    asking = rows.where("asks")
    asks = asking.count()
    tried, tried_rows, tried_ids = sample(asking, MEASURED, asks)
    if not asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def true_neighbours(batches):
        """Each measured query's best rows of a task, by reading all of its rows, with the rows' lists."""
        held = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64)]
        asked = unit(tried)
        for batch in small(batches, TILE_ROWS):
            if batch.num_rows:
                a, row = unit(matrix(batch.column(1), dims)), batch.column(2).to_numpy()
                score = asked @ a.T
                score[tried_rows[:, None] == row[None, :]] = -np.inf
                at = np.argpartition(-score, min(k, len(row)) - 1, axis=1)[:, :k]
                own = np.repeat(np.arange(len(asked)), at.shape[1])
                near = np.argmax(a @ centres.T, axis=1)
                at = at.ravel()
                new = [own, _ids(batch.column(0))[at], row[at], score[own, at], near[at]]
                held = [np.concatenate(x) for x in zip(held, new)]
                best = _best(held[0], held[3], held[1], held[2], k)
                held = [x[best] for x in held]
        ok = np.isfinite(held[3])
        yield pa.RecordBatch.from_arrays([pa.array(held[0][ok]), pa.array(held[1][ok]), pa.array(held[2][ok]), pa.array(held[3][ok]), pa.array(held[4][ok])], names=["query", "vec_id", "row", "score", "list"])

    truth = _top(rows.select("vec_id", "vector", "row").mapInArrow(true_neighbours, "query long, vec_id long, row long, score double, list long"), k).select("query", "list").toArrow()  # k rows for each measured query
    place = np.argsort(np.argsort(-(unit(tried) @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(place[truth.column("query").to_numpy(), truth.column("list").to_numpy()])
    probes = int(ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else lists

    def assign(batches):
        for batch in small(batches, TILE_ROWS):
            near = np.argmax(unit(matrix(batch.column(1), dims)) @ centres.T, axis=1) if batch.num_rows else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["vec_id", "vector", "row", "list"])

    vector_type = rows.schema["vector"].dataType.simpleString()
    listed = staged(rows.select("vec_id", "vector", "row").mapInArrow(assign, f"vec_id long, vector {vector_type}, row long, list int"), "ann-lists")
    sizes = np.zeros(lists, dtype=np.int64)
    for r in listed.groupBy("list").count().collect():  # one row for each list
        sizes[r["list"]] = r["count"]
    near_sample, near_rows = drawn[:BOUND_SAMPLE], drawn_rows[:BOUND_SAMPLE]
    sample_list = np.argmax(near_sample @ centres.T, axis=1)

    def probe(batches):
        """A row for each list that a query probes, with the query's bound: the k-th nearest of those sampled rows that its
        lists hold."""
        for batch in small(batches, 256):
            if not batch.num_rows:
                continue
            a = unit(matrix(batch.column(1), dims))
            order = np.argsort(-(a @ centres.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            count = np.maximum(probes, np.minimum(lists, (held < k + 1).sum(axis=1) + 1))  # more where they hold too few rows
            chosen = np.arange(lists)[None, :] < count[:, None]
            probed = np.zeros((len(a), lists), dtype=bool)
            np.put_along_axis(probed, order, chosen, axis=1)
            gap = np.where(probed[:, sample_list] & (batch.column(2).to_numpy()[:, None] != near_rows[None, :]), np.maximum(2 - 2 * (a @ near_sample.T), 0), np.inf)
            bound = np.partition(gap, k - 1, axis=1)[:, k - 1] if gap.shape[1] >= k else np.full(len(a), np.inf)
            bound = np.where(np.isfinite(bound), bound + 1e-12, 8.0)  # above any distance
            own, at = np.nonzero(probed)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), batch.column(2).take(pa.array(own)), pa.array(at.astype(np.int32)), pa.array(bound[own])], names=["vec_id", "vector", "row", "list", "bound"])

    asked = staged(asking.select("vec_id", "vector", "row").repartition(shuffle_partitions(spark), "row").mapInArrow(probe, f"vec_id long, vector {vector_type}, row long, list int, bound double"), "ann-probes")
    probing = np.zeros(lists, dtype=np.int64)
    for r in asked.groupBy("list").count().collect():  # one row for each list
        probing[r["list"]] = r["count"]
    parts = np.stack([np.maximum(1, -(-sizes // TILE_ROWS)), np.maximum(1, -(-probing // TILE_QUERIES))], axis=1)
    split = F.broadcast(spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(parts)], "list int, row_parts int, query_parts int"))  # one row for each list

    def tiles(of: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        """Rows dealt over their side's parts of a list, one copy for each part of the other side."""
        mine = F.pmod(F.xxhash64("row"), F.col(own)).cast("int")
        out = of.join(split, "list").withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        first, second = ("mine", "theirs") if kind == 0 else ("theirs", "mine")
        return out.select(F.xxhash64("list", first, second).alias("tile"), F.lit(kind).alias("kind"), "vec_id", "vector", "row", "bound")

    def scan_tiles(test: bool):
        rotation = rotation_of(dims, seed)

        def scan(batches):
            """Rows come sorted by tile, candidates before queries; one tile's candidates are held, queries stream by."""
            tile, held, ready = None, [], None
            for batch in small(batches, 512):
                key, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                change = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1 if len(key) else []
                cuts = [0, *change, len(key)] if len(key) else []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    part = batch.slice(a, b - a)
                    if key[a] != tile:
                        tile, held, ready = key[a], [], None
                    if kind[a] == 0:
                        held.append(part)
                        continue
                    if ready is None and held:
                        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        ready, held = Scan(matrix(whole.column(3), dims), _ids(whole.column(2)), whole.column(4).to_numpy(), rotation), []
                    if ready is None:
                        continue  # a part of a list without rows
                    step = max(1, 2_000_000 // len(ready.row))
                    for at in range(0, part.num_rows, step):
                        some = part.slice(at, step)
                        own = some.column(4).to_numpy()
                        query, here, score = ready.search(matrix(some.column(3), dims), own, some.column(5).to_numpy(), k, test)
                        yield _found(own[query], some.column(2).to_numpy()[query], ready.ids[here], ready.row[here], score)

        return scan

    def found_by(queries: DataFrame, test: bool) -> DataFrame:
        both = tiles(listed.withColumn("bound", F.lit(None).cast("double")), "row_parts", "query_parts", 0).unionByName(tiles(queries, "query_parts", "row_parts", 1))
        both = both.repartition(shuffle_partitions(spark), "tile").sortWithinPartitions("tile", "kind")
        return _top(both.mapInArrow(scan_tiles(test), ROWS), k)

    best = staged(found_by(asked, True), "ann-found")
    # The test abandons a true neighbour now and then; a query that is left with too few is scanned without it.
    counts = asked.select(F.col("row").alias("query")).distinct().join(best.groupBy("query").count(), "query", "left")
    few = staged(counts.where(F.coalesce("count", F.lit(0)) < min(k, n - 1)).select(F.col("query").alias("row")), "ann-few")
    if not few.isEmpty():
        again = found_by(asked.join(few, "row").withColumn("bound", F.lit(8.0)).select(*asked.columns), False)
        best = best.join(few.select(F.col("row").alias("query")), "query", "left_anti").unionByName(again)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
