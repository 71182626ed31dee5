"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the n-grams (4 and 5 code points, lower case) that occur in a text, hashed into BUCKETS. For each bucket the
log-ratio of its smoothed shares in toxic and other labelled texts is its scale; all buckets whose ratio is SURE standard
errors or more from none are features, and a logistic regression is fitted to the scaled features. It learns from at most
MAX_LABELLED labelled texts of each class, taken in the order of a hash, and the intercept is set back to the classes'
shares among all labels. Whole texts are scored; labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import staged
from marlstone.llm.words import small_batches

SIZES = (4, 5)
BUCKETS = 1 << 18
#: Standard errors from which a bucket's log-ratio is taken for more than chance; how many buckets that are grows with the labels.
SURE = 3.5
#: Bound on the labelled texts of each class that the classifier is fitted to.
MAX_LABELLED = 8192
PENALTY = 3.0
SMOOTHING = 1.0
THRESHOLD = 0.3
FOLDS, HELD_OUT_FOLD = 4, 2
#: Bytes of a batch's texts, and code points of a text, that are worked on at once, so that memory grows with neither.
BATCH, CHUNK = 500_000, 500_000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lowered = [t.lower() for t in texts]
    joined = "".join(lowered)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)


def _ngrams(codes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each place."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.int64)
    h = np.full(m, n, dtype=np.uint64)
    for j in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[j : m + j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - 18)).astype(np.int64)


def _short_features(texts: list[str], wanted: np.ndarray | None) -> np.ndarray:
    """Keys text number * BUCKETS + bucket of texts that are worked on at once."""
    codes, starts = _codes(texts)
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(codes))  # code points to the text's end
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, np.diff(starts))
    keys = []
    for n in SIZES:
        buckets = _ngrams(codes, n)
        whole = left[: len(buckets)] >= n  # not across two texts
        if wanted is not None:
            whole &= wanted[buckets]
        places = np.flatnonzero(whole)
        keys.append(owner[places] + buckets[places])
    return np.unique(np.concatenate(keys))


def text_features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each text's distinct n-grams, of all buckets or of those where ``wanted`` is true.

    A text of more than CHUNK code points is read in pieces that overlap by less than an n-gram."""
    keys, short = [], []
    for k, t in enumerate(texts):
        t = t or ""
        if len(t) <= CHUNK:
            short.append(t)
            continue
        short.append("")
        seen = np.zeros(BUCKETS, dtype=bool)
        for at in range(0, len(t), CHUNK):
            seen[_short_features([t[at : at + CHUNK + max(SIZES) - 1]], wanted)] = True
        keys.append(k * BUCKETS + np.flatnonzero(seen))
    keys.append(_short_features(short, wanted))
    found = np.sort(np.concatenate(keys)) if len(keys) > 1 else keys[0]
    return found // BUCKETS, found % BUCKETS


@dataclass
class Model:
    """Weights by bucket (of the scaled features, the scale multiplied in) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        owner, bucket = text_features(texts, self.weights != 0)
        z = self.intercept + np.bincount(owner, weights=self.weights[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(indptr: np.ndarray, indices: np.ndarray, scale: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with a ridge on the weights, by L-BFGS on sparse rows of ones times ``scale``."""
    rows = np.repeat(np.arange(len(y)), np.diff(indptr))
    k = len(scale)

    def value(theta):
        z = theta[k] + np.bincount(rows, weights=(theta[:k] * scale)[indices], minlength=len(y))
        loss = np.sum(weight * (np.logaddexp(0, z) - y * z)) + 0.5 * penalty * theta[:k] @ theta[:k]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        gradient = np.append(np.bincount(indices, weights=error[rows], minlength=k) * scale + penalty * theta[:k], error.sum())
        return loss, gradient

    theta = np.zeros(k + 1)
    loss, gradient = value(theta)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, alphas = gradient.copy(), []
        for s, g in reversed(memory):
            alphas.append((s @ direction) / (s @ g))
            direction -= alphas[-1] * g
        if memory:
            s, g = memory[-1]
            direction *= (s @ g) / (g @ g)
        else:
            direction /= max(1.0, np.abs(gradient).sum())
        for (s, g), a in zip(memory, reversed(alphas)):
            direction += s * (a - (g @ direction) / (s @ g))
        slope, step = -(gradient @ direction), 1.0
        while step > 1e-10:
            new = theta - step * direction
            new_loss, new_gradient = value(new)
            if new_loss <= loss + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, g = new - theta, new_gradient - gradient
        if s @ g > 1e-12:
            memory = [*memory[-9:], (s, g)]
        done = loss - new_loss < 1e-7 * max(1.0, abs(loss))
        theta, loss, gradient = new, new_loss, new_gradient
        if done:
            break
    return theta[:k], float(theta[k])


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, bound: int) -> tuple[DataFrame, dict[int, int]]:
    """Labelled texts outside the held-out fold, at most ``bound`` of each class, as a staged table (text, toxic); and the
    number of labels of each class, of documents in ``docs``. Labels that contradict each other count as toxic; null ids
    and labels don't count."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD_OUT_FOLD))
    known = known.groupBy(F.col("doc_id").alias("__doc")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    ids = docs.select(F.col(doc_id).alias("__id"))
    known = known.join(ids, known["__doc"] == ids["__id"], "left_semi")  # labels of other documents take up no places
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("__doc"), "__doc").limit(bound) for c in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * bound pairs of numbers
    return staged(docs.join(sample, docs[doc_id] == sample["__doc"]).select(F.coalesce(F.col(text), F.lit("")).alias("text"), "toxic"), "toxic-sample"), shares


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = MAX_LABELLED) -> Model:
    """Fit the classifier. Without labels of both classes every score is the share of toxic labels, or 0."""
    sample, shares = training_sample(docs, labels, doc_id, text, label, bound)
    total = sum(shares.values())
    share = min(max(shares.get(1, 0) / total, 1e-6), 1 - 1e-6) if total else 1e-6
    nothing = Model(np.zeros(BUCKETS), math.log(share / (1 - share)))

    def count(batches):
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in small_batches(batches, 0, BATCH):
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            owner, bucket = text_features(batch.column(0).to_pylist())
            for c in (0, 1):
                counts[c] += np.bincount(bucket[kind[owner] == c], minlength=BUCKETS)
        seen = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0, seen]), pa.array(counts[1, seen])], names=["bucket", "n0", "n1"])

    counts = sample.select("text", "toxic").mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = staged(counts, "toxic-counts")
    n0, n1 = counts.agg(F.sum("n0"), F.sum("n1")).head()
    if not n0 or not n1:
        return nothing
    ratio = F.log((F.col("n1") + SMOOTHING) / (n1 + SMOOTHING * BUCKETS)) - F.log((F.col("n0") + SMOOTHING) / (n0 + SMOOTHING * BUCKETS))
    level = math.log((n1 + SMOOTHING * BUCKETS) / n1) - math.log((n0 + SMOOTHING * BUCKETS) / n0)
    sure = F.abs(ratio + F.lit(level)) / F.sqrt(1 / (F.col("n1") + SMOOTHING) + 1 / (F.col("n0") + SMOOTHING))
    best = counts.where(sure >= SURE).select("bucket", (ratio + F.lit(level)).alias("ratio")).orderBy("bucket").toArrow()  # at most BUCKETS rows
    if not best.num_rows:
        return nothing
    buckets, scale = best.column(0).to_numpy().astype(np.int64), best.column(1).to_numpy()
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[buckets] = np.arange(len(buckets), dtype=np.int32)

    def rows(batches):
        for batch in small_batches(batches, 0, BATCH):
            owner, bucket = text_features(batch.column(0).to_pylist(), place >= 0)
            ends = np.cumsum(np.bincount(owner, minlength=batch.num_rows))[:-1]
            lists = [x.tobytes() for x in np.split(place[bucket], ends)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.binary())], names=["toxic", "features"])

    found = sample.select("text", "toxic").mapInArrow(rows, "toxic int, features binary").toArrow()  # at most 2 * bound rows, each of a text's features
    y = found.column(0).to_numpy().astype(float)
    lists = [np.frombuffer(x, dtype=np.int32) for x in found.column(1).to_pylist()]
    indptr = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, b = fit_logistic(indptr, np.concatenate(lists), scale, y, weight)
    weights = np.zeros(BUCKETS)
    weights[buckets] = w * scale
    return Model(weights, b + math.log(share / (1 - share)))


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``. A null text is scored as an empty one, by the intercept."""
    names = docs.columns
    at = names.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def score(batches):
        for batch in small_batches(batches, at, BATCH):
            values = model.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted. Repeated rows are scored alike, each on its own.

    A null id is in no fold, so not held out; an empty table gives no rows. Texts with equal features have equal scores,
    and a score equal to the threshold counts as toxic. A text of any length is scored whole. Other columns of ``docs`` are
    not read.
    """
    model = fit(docs, labels, doc_id, text, label)
    rows = scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT_FOLD, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns. Null and empty texts have the score of the
    intercept; repeated rows are judged alike; an empty table gives no rows; a column named like the score is kept."""
    out = "__score"
    while out in docs.columns:
        out += "_"
    return scored(docs, fit(docs, labels, doc_id, text, label), text, out).where(F.col(out) < threshold).drop(out)


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
