"""N-gram Jaccard self-join by chosen paths.

Each document is the set of its five-word shingles. In each run a set walks down a path of sampled tokens: at every step
the token of the set that a random order puts first. Sets with the same path share those tokens; a bucket that is still
large is split by one more token, up to DEPTH; the rest is compared in full, within buckets, by sketches. As two sets at
the threshold share a token of a path with that probability, RUNS runs meet the target recall even at full depth.

What the buckets link are candidates. Their connected components are small or truly alike; in each of them all pairs are
compared exactly on the whole sets, in tiles, and counted, not listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import free_name, key_tasks, staged
from marlstone.llm.components import components
from marlstone.llm.words import mix, shingles, small_batches, split_words, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
DEPTH = 3
TARGET_RECALL = 0.999
#: Runs after which a pair at the threshold has met in a bucket of full depth with the target recall.
RUNS = math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - THRESHOLD**DEPTH))
#: Buckets up to this size are compared, larger ones are split further.
BUCKET = 256
SKETCH = 64
#: Of SKETCH places, pairs at the threshold agree in 51 on average; fewer than this is over four standard deviations off.
AGREE = 36
#: Sets, and shingles, of a block of a component; a tile compares two blocks.
BLOCK_SETS = 1024
BLOCK_SHINGLES = 1_500_000
#: Bytes of text whose sets, larger than the text, are held at once.
SET_BATCH = 1_000_000
#: Rows of a tile's matrix that are worked on at once.
STRIP = 256

_seeds = np.random.default_rng(20240229)
_XOR = _seeds.integers(0, 2**63, SKETCH, dtype=np.uint64)
_ODD = _seeds.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(own: np.ndarray) -> np.ndarray:
    """The first token of a set in each of SKETCH random orders."""
    best = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 4096):
        part = own[at : at + 4096, None] ^ _XOR
        part *= _ODD
        np.minimum(best, part.min(axis=0), out=best)
    return mix(best)


def set_key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    vocabulary, codes, offsets = split_words(texts)
    return shingles(word_hashes(vocabulary)[codes] if len(codes) else np.empty(0, dtype=np.uint64), offsets, k)


def sketches(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """doc_id, mark (a hash of the text, which tells rows with equal ids apart), key (of the shingle set), size, path (RUNS *
    DEPTH tokens) and sketch (a byte for each of SKETCH orders)."""

    def make(batches):
        for batch in small_batches(batches, 1):
            keys, sizes, paths, marks = [], [], [], []
            for own in _sets(batch.column(1), k):
                first = minima(own)
                keys.append(set_key(own))
                sizes.append(len(own))
                paths.append((first[: RUNS * DEPTH] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                marks.append((first & np.uint64(0xFF)).astype(np.uint8).tobytes())
            flat = pa.array(np.concatenate(paths) if paths else np.empty(0, dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, RUNS * DEPTH), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), lists, pa.array(marks, pa.binary())], names=["doc_id", "mark", "key", "size", "path", "sketch"])

    return _marked(docs, doc_id, text).mapInArrow(make, "doc_id long, mark long, key binary, size int, path array<int>, sketch binary")


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))


def leaves(sets: DataFrame, n_sets: int | None = None) -> DataFrame:
    """(bucket, n, key): the buckets of two sets or more that the paths end in, over all runs. n_sets: about how many sets there
    are at most, as ``staged`` takes it."""
    places = None if n_sets is None else RUNS * n_sets
    runs = F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1)))
    steps = F.slice("path", F.col("run") * DEPTH + 1, DEPTH)
    active = sets.select("key", "path", runs.alias("run")).select("key", steps.alias("steps"), F.xxhash64("run", F.get("path", F.col("run") * DEPTH)).alias("bucket"))
    found = []
    for level in range(1, DEPTH + 1):
        counts = staged(active.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes", places)
        rows = staged(active.join(counts, "bucket"), "buckets", places)
        if level == DEPTH:
            found.append(rows.select("bucket", "n", "key"))
            break
        found.append(rows.where(F.col("n") <= BUCKET).select("bucket", "n", "key"))
        large = rows.where(F.col("n") > BUCKET)
        if large.isEmpty():
            break
        active = large.select("key", "steps", F.xxhash64("bucket", F.get("steps", F.lit(level))).alias("bucket"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def tiled(rows: DataFrame, group: str, blocks, key: str) -> DataFrame:
    """Rows with their tile: a group of b blocks has a tile for each pair of blocks, and a row is in b of them.

    block and other: the two blocks of the tile, the lower first; own: the block of the row.
    """
    rows = rows.withColumn("__blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64(key, F.lit(7)), F.col("__blocks")).cast("int"))
    rows = rows.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    rows = rows.withColumns({"block": F.least("own", "__j"), "other": F.greatest("own", "__j")}).drop("__j", "__blocks")
    return rows.withColumn("tile", F.xxhash64(group, "block", "other"))


def _groups(batches, column: int):
    """Batches of rows sorted by an integer column as record batches of one value each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        ids = batch.column(column).to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and ids[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = ids[a]
    if held:
        yield pa.Table.from_batches(held)


def _alike(marks: np.ndarray) -> np.ndarray:
    """For each row of sketches the first row of the part it is linked to, directly or through others."""
    label = np.full(len(marks), -1)
    rest = np.arange(len(marks))
    while len(rest):
        first, rest = rest[0], rest[1:]
        label[first] = first
        todo = [first]
        while todo and len(rest):
            near = (marks[rest] == marks[todo.pop()]).sum(axis=1) >= AGREE
            if near.any():
                label[rest[near]] = first
                todo.extend(rest[near].tolist())
                rest = rest[~near]
    return label


def candidate_links(sets: DataFrame, n_sets: int | None = None) -> DataFrame:
    """(u, v): within each bucket, each set and the smallest set of the part that sketches link it to."""
    rows = leaves(sets, n_sets).join(sets.select("key", "sketch"), "key")
    rows = tiled(rows, "bucket", F.ceil(F.col("n") / BLOCK_SETS), "key").select("tile", "key", "sketch")

    def link(batches):
        for table in _groups(batches, 0):
            keys = table.column(1).to_pylist()
            marks = np.frombuffer(b"".join(table.column(2).to_pylist()), dtype=np.uint8).reshape(len(keys), SKETCH)
            order = sorted(range(len(keys)), key=keys.__getitem__)
            label = _alike(marks[order])
            pairs = [(keys[order[k]], keys[order[f]]) for k, f in enumerate(label) if f != k]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs)], names=["u", "v"])

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_rebatched(link), "u binary, v binary").distinct()


def _rebatched(work, rows: int = 4096):
    """Yield what ``work`` yields in larger batches."""

    def run(batches):
        held, n = [], 0
        for batch in work(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections: a product of the 0-1 matrix of sets and those tokens that two sets share."""
    m = len(sets)
    out = np.zeros((m, m), dtype=np.float32)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, dtype=bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else new
    column, owner = column[shared], owner[shared]
    column = np.unique(column, return_inverse=True)[1]
    width = int(column.max()) + 1 if len(column) else 0
    step = max(64, min(4096, 4_000_000 // max(1, m)))
    for a in range(0, width, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        rows = np.unique(owner[lo:hi])
        part = np.zeros((len(rows), min(step, width - a)), dtype=np.float32)
        part[np.searchsorted(rows, owner[lo:hi]), column[lo:hi] - a] = 1
        for at in range(0, len(rows), STRIP):
            out[np.ix_(rows[at : at + STRIP], rows)] += part[at : at + STRIP] @ part.T
    return out


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(key, links, root, blocks) for each set and tile: the copies of the sets that are linked to it in the tile, and the
    smallest set it is linked to there, directly or through others."""

    def check(batches):
        for table in _groups(batches, 0):
            keys, copies, raw, own = (table.column(i).to_pylist() for i in (1, 2, 3, 4))
            cross = table.column(5)[0].as_py() != table.column(6)[0].as_py()
            order = sorted(range(len(keys)), key=keys.__getitem__)
            sets = [np.frombuffer(raw[k], dtype=np.uint64) for k in order]
            size = np.array([len(s) for s in sets], dtype=np.float64)
            both = intersections(sets)
            m, block = len(order), np.array([own[k] for k in order])
            weight = np.array([copies[k] for k in order], dtype=np.float64)
            linked, links = np.zeros((m, m), dtype=bool), np.zeros(m)
            strips = [slice(at, at + STRIP) for at in range(0, m, STRIP)]  # wide numbers are made for a strip of the matrix at a time
            for rows in strips:
                found = both[rows] >= threshold * (size[rows, None] + size[None, :] - both[rows]) - 1e-9
                found[np.arange(len(found)), np.arange(m)[rows]] = False
                if cross:
                    found &= block[rows, None] != block[None, :]
                linked[rows], links[rows] = found, found @ weight
            root = np.arange(m)
            while True:  # the smallest number spreads along the links
                near = np.concatenate([np.where(linked[rows], root[None, :], m).min(axis=1) for rows in strips])
                new = np.minimum(root, near)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[k] for k in order], pa.binary()), pa.array(links.astype(np.int64)), pa.array([keys[order[r]] for r in root], pa.binary()), pa.array([bool(cross or table.column(7)[0].as_py() > 1)] * len(order))],
                names=["key", "links", "root", "split"],
            )

    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1))
    rows = tiled(members.withColumn("blocks", blocks.cast("int")), "component", F.col("blocks"), "key")
    rows = rows.select("tile", "key", "copies", "set", "own", "block", "other", "blocks").repartition("tile").sortWithinPartitions("tile")
    return rows.mapInArrow(_rebatched(check), "key binary, links long, root binary, split boolean")


def _classes(docs: DataFrame, doc_id: str, text: str, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, mark and set key of each row; and for each set key class_id, n_links, n_copies and head, the
    row that stands for its class: the one with the smallest id, of equals the smallest hash of the text; null ids last."""
    rows = staged(sketches(docs, doc_id, text, k), "sketches")
    n = rows.count()  # bounds the number of files of what follows
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    sets = rows.groupBy("key").agg(F.min(row).alias("row"), F.count(F.lit(1)).alias("copies"), F.any_value("size").alias("size"), F.any_value("path").alias("path"), F.any_value("sketch").alias("sketch"))
    sets = staged(sets, "sets", n)
    links = staged(candidate_links(sets.where("size > 0"), n), "candidates", RUNS * n)
    of = staged(components(links, RUNS * n).select(F.col("node").alias("key"), F.col("root").alias("component")), "candidate-components", n)
    heads = staged(of.join(sets.select("key", "row", "copies", "size"), "key"), "members", n)
    totals = staged(heads.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingles")), "component-sizes", n)
    heads = heads.join(totals, "component")

    def make(batches):
        for batch in small_batches(batches, 1, SET_BATCH):
            found = _sets(batch.column(1), k)
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "set"])

    wanted = heads.select(_row_id(F.col("row.doc_id")).alias("id"), F.col("row.mark").alias("mark")).distinct()
    texts = _marked(docs, doc_id, text).withColumn("id", _row_id(F.col("doc_id"))).join(wanted, ["id", "mark"], "left_semi")
    whole = texts.select("id", "text").mapInArrow(make, "key binary, set binary").dropDuplicates(["key"]).join(heads, "key")
    checked = staged(verified(whole, threshold).repartition(key_tasks(docs.sparkSession, n)), "verified")  # tiles keep their tasks
    counted = checked.groupBy("key").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("split").alias("split"))
    split = checked.where("split")
    if not split.isEmpty():
        roots = components(split.select(F.col("key").alias("u"), F.col("root").alias("v")), n).select(F.col("node").alias("key"), F.col("root").alias("whole"))
        counted = counted.join(roots, "key", "left").withColumn("root", F.when(F.col("split"), F.coalesce("whole", "key")).otherwise(F.col("root"))).drop("whole")
    counted = staged(counted, "links", n)
    ids = staged(counted.join(sets.select("key", "row"), "key").groupBy("root").agg(F.min("row").alias("head")), "class-heads", n)
    linked = counted.join(ids, "root").select("key", "links", "head")
    classes = sets.select("key", "row", "copies").join(linked, "key", "left")
    classes = classes.select("key", F.coalesce("head", "row").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return rows.select("doc_id", "mark", "key"), staged(classes.withColumn("class_id", F.col("head.doc_id")), "classes", n)


def _row_id(doc_id):
    """A join key of an id that null ids have as well."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def similarity_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links, n_copies, and the key of its set.

    Documents are linked if their sets of k-word shingles have a Jaccard index of ``threshold`` or more (the default runs
    and sketches are planned for 0.8). class_id is the smallest id among the documents that are linked, directly or through
    others, null if none of them has one; n_links counts the other documents linked directly, those with an equal set
    included; n_copies the rows with an equal set, this one included. A text of 1 to k-1 words is one shingle; null and
    wordless texts are equal to each other and to nothing else. Repeated rows and repeated ids are documents each on their
    own. A text of any length is one set, which one task holds. Ids must be integers or null. An empty table gives no rows.
    """
    rows, classes = _classes(docs, doc_id, text, threshold, k)
    return rows.select("doc_id", "key").join(classes, "key").select("doc_id", "class_id", "n_links", "n_copies", F.hex("key").alias("set_key"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns: that with the smallest id, of equal ids that with the
    smallest hash of its text. Rows without an id stay where no row of their class has one; of rows equal in id and text
    one stays. Columns of ``docs`` may have any names."""
    _, classes = _classes(docs, doc_id, text, threshold, k)
    own, mark = free_name(docs.columns, "__id"), free_name(docs.columns, "__mark")
    heads = classes.select(_row_id(F.col("head.doc_id")).alias(own), F.col("head.mark").alias(mark)).distinct()
    rows = docs.withColumns({own: _row_id(docs[doc_id].cast("long")), mark: F.xxhash64(docs[text])})
    return rows.join(heads, [own, mark], "left_semi").dropDuplicates([own, mark]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_copies")
