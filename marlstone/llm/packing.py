"""Packing tokenised documents into sequences by linear grouping.

Documents are tokenised and cut into pieces of at most CAPACITY tokens. Only the histogram of the piece lengths, at most
CAPACITY numbers whatever the corpus, goes to the driver. There the large lengths are split into groups of equal
cardinality and rounded up to their group's largest; a linear program over configurations (column generation with a
knapsack) says how often each configuration of few sizes is used; the configurations' slots are filled with the actual
lengths, and all that is left is placed by best fit into the free space. The plan maps (length, rank among the pieces of
that length) to a sequence and an offset; ranks come from counts by length and salt, so a common length is no hot key.
"""

from __future__ import annotations

import itertools
import operator
import os
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from marlstone.llm.common import shuffle_partitions, staged
from marlstone.llm.words import small_batches

CAPACITY = 2048
END_ID = 0
#: Lengths above this are grouped and put in configurations; at most 5 of them fit in a sequence.
LARGE = CAPACITY // 6
GROUPS = 64
#: Relative distance from the linear program's optimum at which column generation stops.
GAP = 1e-3
#: Distinct words whose ids a task keeps between batches.
WORD_CACHE = 500_000
WORDS_AT_ONCE = 4096
#: Bytes of text that are tokenised at once: the more, the fewer words are looked up again.
BATCH = 16_000_000


# ---------------------------------------------------------------- tokens


def default_tokenizer() -> str:
    """The vocabulary file of the contract, by its public path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of texts by way of their distinct words.

    The vocabulary's pre-tokenizer removes white space and never joins what it separates, so a text's ids are those of its
    space- or newline-separated words in turn; each distinct word is tokenised once and its ids are kept in a pool, which is
    emptied when it holds WORD_CACHE words.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        """Keep the empty word, which has no ids, and the marks that words are parted from."""
        self.known: dict[str, int] = {"": 0}
        self.pool, self.first = np.empty(0, dtype="<u4"), np.zeros(2, dtype=np.int64)  # where each word's ids start, and the end
        self._learn([".", ","])

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the places where each text's ids start (one more than texts). Nulls are empty."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words_of = np.asarray(lists.offsets)
        flat = lists.flatten().dictionary_encode()
        which = flat.indices.to_numpy(zero_copy_only=False)
        stem, mark = self._numbers(flat.dictionary)
        # the ids of each distinct word, its mark's behind its stem's, and then those of all words in turn
        size = np.stack([self._sizes()[stem], self._sizes()[mark]], axis=1)
        pool, start = self._gathered(self.pool, np.stack([self.first[stem], self.first[mark]], axis=1).reshape(-1), size.reshape(-1))
        ids, starts = self._gathered(pool, start[:-1:2][which], size.sum(axis=1)[which])
        return ids, starts[words_of - words_of[0]]

    def _sizes(self) -> np.ndarray:
        return self.first[1:] - self.first[:-1]

    @staticmethod
    def _gathered(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of ``pool`` that start at ``first``, one behind another, and where each starts (one more than runs)."""
        start = np.concatenate([[0], np.cumsum(size)])
        return pool[np.arange(start[-1], dtype=np.int64) + np.repeat(first - start[:-1], size)], start

    def _numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The known words that each word consists of. The pre-tokenizer parts a full stop or comma from the letter before it, and
        the vocabulary knows lower case only, so "Word," is "word" and ","; what may hold a special token stays as it is."""
        marked = pc.match_substring_regex(words, "[A-Za-z][.,]$")
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words)
        stems = pc.if_else(pc.match_substring(stems, "<|"), stems, pc.ascii_lower(stems)).dictionary_encode()
        marks = pc.if_else(marked, pc.utf8_slice_codeunits(words, -1), "")
        if len(self.known) > WORD_CACHE:
            self._forget()
        vocabulary = stems.dictionary.to_pylist()
        behind = len(self.known)
        number = np.fromiter(map(self.known.get, vocabulary, itertools.repeat(-1)), dtype=np.int64, count=len(vocabulary))
        fresh = np.flatnonzero(number < 0)
        self._learn([vocabulary[k] for k in fresh.tolist()])
        number[fresh] = np.arange(behind, behind + len(fresh))
        stem = number[stems.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, dtype=np.int64)
        mark = np.zeros(len(words), dtype=np.int64)
        for text in (".", ","):
            mark[pc.equal(marks, text).to_numpy(zero_copy_only=False)] = self.known[text]
        return stem, mark

    def _learn(self, words: list[str]) -> None:
        pools, firsts, behind = [self.pool], [self.first], int(self.first[-1])
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            encoded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1)
            ids = np.array(encoded.ids, dtype="<u4")
            places = np.fromiter(map(_FIRST, encoded.offsets), dtype=np.int64, count=len(ids))
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
            pools.append(ids)
            firsts.append(behind + np.searchsorted(places, ends))
            behind += len(ids)
        if words:
            self.pool, self.first = np.concatenate(pools), np.concatenate(firsts)


_FIRST = operator.itemgetter(0)


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def pieces(docs: DataFrame, doc_id: str, text: str, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32, and its number in the task that cut it,
    which tells equal pieces apart (number). A null text is the end id alone."""
    path = tokenizer_path or default_tokenizer()

    def cut(batches):
        tok = WordTokenizer(path)
        behind = 0
        for batch in small_batches(batches, 1, BATCH):
            ids, starts = tok.encode_batch(batch.column(1))
            ids = np.insert(ids, starts[1:], END_ID)
            sizes = np.diff(starts) + 1
            starts = starts[:-1] + np.arange(len(sizes))
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = number * capacity
            length = np.minimum(capacity, sizes[row] - at)
            raw = memoryview(np.ascontiguousarray(ids).view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip((starts[row] + at).tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(at), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.arange(behind, behind + len(row)))]
            behind += len(row)
            yield pa.RecordBatch.from_arrays(columns, names=[*PIECES.fieldNames(), "number"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, T.StructType([*PIECES.fields, T.StructField("number", T.LongType())]))


# ---------------------------------------------------------------- plan


@dataclass
class Plan:
    """Runs of equal pieces: ranks [first, first + count) of ``length`` go to sequences from ``sequence`` on, at ``offset``."""

    capacity: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first, count, sequence, offset
    sequences: int = 0
    used: dict[int, int] = field(default_factory=dict)

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        if count:
            first = self.used.get(length, 0)
            self.runs.append((length, first, count, sequence, offset))
            self.used[length] = first + count

    def new(self, count: int) -> int:
        first = self.sequences
        self.sequences += count
        return first


def equal_groups(histogram: dict[int, int], large: int, groups: int) -> list[list[tuple[int, int]]]:
    """The lengths above ``large`` in descending order, as runs (length, count), cut into groups of equal cardinality."""
    runs = [(n, c) for n, c in sorted(histogram.items(), reverse=True) if n > large and c]
    total = sum(c for _, c in runs)
    if not total:
        return []
    size = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = [[]]
    room = size
    for n, c in runs:
        while c:
            if not room:
                out.append([])
                room = size
            take = min(c, room)
            out[-1].append((n, take))
            room -= take
            c -= take
    return out


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """The configuration of at most ``most`` items with the largest value that fits (a knapsack by number of items)."""
    use = np.flatnonzero(values > 1e-12)
    out = np.zeros(len(sizes), dtype=np.int64)
    if not len(use):
        return out
    before = np.arange(capacity + 1)[None, :] - sizes[use, None]  # room left below an item that ends at each place
    fits = before >= 0
    best, choices = np.zeros(capacity + 1), []
    for _ in range(most):
        with_item = np.where(fits, best[before], -np.inf) + values[use, None]
        pick = with_item.argmax(axis=0)
        gain = with_item[pick, np.arange(capacity + 1)]
        better = gain > best + 1e-12
        choices.append(np.where(better, pick, -1))
        best = np.where(better, gain, best)
    room = capacity
    for choice in reversed(choices):
        if (i := choice[room]) >= 0:
            out[use[i]] += 1
            room -= sizes[use[i]]
    return out


def solve_configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """min sum(x) with sum(x * configuration) >= demand, by column generation: configurations and their (fractional) use."""
    s, d = np.asarray(sizes), np.asarray(demand, dtype=float)
    k = len(s)
    most = max(1, capacity // int(s.min()))
    columns = [np.eye(k, dtype=np.int64)[i] * (capacity // s[i]) for i in range(k)]
    inverse = np.diag(1.0 / np.array([c.max() for c in columns]))
    for step in range(rounds):
        prices = inverse.sum(axis=0)
        new = _best_configuration(s, prices, capacity, most)
        if prices @ new <= 1 + GAP:
            break
        direction, level = inverse @ new, inverse @ d
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-10, level / direction, np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        pivot = inverse[leave] / direction[leave]
        inverse = inverse - np.outer(direction, pivot)
        inverse[leave] = pivot
        columns[leave] = new
        if step % 100 == 99:
            inverse = np.linalg.inv(np.array(columns, dtype=float).T)
    return [(c, x) for c, x in zip(columns, inverse @ d) if x > 1e-9]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> Plan:
    """Place every piece of a length histogram; the plan's size is bounded by the capacity and the number of groups."""
    plan = Plan(capacity)
    rest = {n: c for n, c in histogram.items() if c}
    if full := rest.pop(capacity, 0):
        plan.place(capacity, full, plan.new(full), 0)
    grouped = equal_groups(rest, large, groups)
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> [(first sequence, count)]
    if grouped:
        by_size: dict[int, list[tuple[int, int]]] = {}  # groups with the same rounded length are one size
        for g in grouped:
            by_size.setdefault(g[0][0], []).extend(g)
        sizes = sorted(by_size, reverse=True)
        queues = [list(reversed(by_size[n])) for n in sizes]
        for configuration, x in solve_configurations(sizes, [sum(c for _, c in by_size[n]) for n in sizes], capacity):
            times = int(x + 1e-6)
            if not times:
                continue
            spans = [(plan.new(times), times, 0)]  # first, count, used
            for i in np.flatnonzero(configuration):
                for _ in range(int(configuration[i])):
                    cut = []
                    for first, count, used in spans:
                        while count and queues[i]:
                            n, c = queues[i].pop()
                            take = min(c, count)
                            if c > take:
                                queues[i].append((n, c - take))
                            plan.place(n, take, first, used)
                            cut.append((first, take, used + n))
                            first += take
                            count -= take
                        if count:
                            cut.append((first, count, used))
                    spans = cut
            for first, count, used in spans:
                free.setdefault(capacity - used, []).append((first, count))
        for n in [n for n in rest if n > large]:
            del rest[n]
        for queue in queues:
            for n, c in queue:
                rest[n] = rest.get(n, 0) + c
    for n in sorted(rest, reverse=True):
        _best_fit(plan, free, n, rest[n])
    return plan


def _best_fit(plan: Plan, free: dict[int, list[tuple[int, int]]], length: int, count: int) -> None:
    """Place ``count`` pieces of one length, each in the fullest sequence that takes it, in bulk."""
    for space in sorted(s for s in free if s >= length):
        each = space // length
        while count and free.get(space):
            first, bins = free[space].pop()
            whole = min(bins, count // each)
            for k in range(each):
                plan.place(length, whole, first, plan.capacity - space + k * length)
            if whole:
                free.setdefault(space - each * length, []).append((first, whole))
            count -= whole * each
            first, bins = first + whole, bins - whole
            if bins and count:  # fewer than a bin takes
                for k in range(count):
                    plan.place(length, 1, first, plan.capacity - space + k * length)
                free.setdefault(space - count * length, []).append((first, 1))
                count, first, bins = 0, first + 1, bins - 1
            if bins:
                free.setdefault(space, []).append((first, bins))
        if not free.get(space):
            free.pop(space, None)
        if not count:
            return
    each = plan.capacity // length
    if whole := count // each:
        first = plan.new(whole)
        for k in range(each):
            plan.place(length, whole, first, k * length)
        free.setdefault(plan.capacity - each * length, []).append((first, whole))
        count -= whole * each
    if count:
        first = plan.new(1)
        for k in range(count):
            plan.place(length, 1, first, k * length)
        free.setdefault(plan.capacity - count * length, []).append((first, 1))


# ---------------------------------------------------------------- distributed placement


def ranked(rows: DataFrame, length: str, *order: Column) -> DataFrame:
    """Add __rank: a number from 0 among the rows of equal ``length``, from counts by (length, salt) and ranks within them."""
    salts = max(16, shuffle_partitions(rows.sparkSession))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = salted.groupBy(length, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(W.partitionBy(length).orderBy("__salt")) - F.col("__n")).drop("__n")
    within = salted.withColumn("__in", F.row_number().over(W.partitionBy(length, "__salt").orderBy(*order)) - 1)
    return within.join(before, [length, "__salt"]).withColumn("__rank", (F.col("__before") + F.col("__in")).cast("long")).drop("__salt", "__before", "__in")


PLACED = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, large: int | None = None, groups: int = GROUPS) -> DataFrame:
    """Pieces with their sequence and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of length 1. Repeated rows and equal ids are packed each on their own; pieces of equal
    length are ranked by salt and then by id, piece and content, and equal ones in any order. A text of any length is cut
    into pieces; its ids are held by one task. An empty table gives no rows. Ids must be integers or null; other columns of
    ``docs`` are not read. Sequences are filled without gaps from offset 0.
    """
    cut = staged(pieces(docs, doc_id, text, tokenizer_path, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = make_plan(histogram, capacity, capacity // 6 if large is None else large, groups)
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 5)
    span = int(max(histogram.values(), default=0)) + 1  # key = length * span + rank, in exact integers
    keys = runs[:, 0] * span + runs[:, 1]
    ordered = ranked(cut, "length", F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32"), F.col("number"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(runs[at, 3] + rank - runs[at, 1], pa.int64()), pa.array(runs[at, 4], pa.int64())], names=PLACED.fieldNames())

    return ordered.select(*PIECES.fieldNames(), "__rank").mapInArrow(place, PLACED)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
