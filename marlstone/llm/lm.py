"""Language-model scores: a gated recurrent network in numpy with a class-factored softmax, beside a unigram base.

One pass over the corpus counts the words of all training documents and cuts each of them into runs of words; the network
is fitted to every run, once, by truncated backpropagation in rounds. A round takes an equal share of the runs; in it the
tasks start from the same parameters and their results are averaged. A second pass carries the network's state through each
whole document. The network predicts the VOCABULARY most frequent words, the end of text, and "another word"; another
word's share is its smoothed unigram share among the other words, so a document's score is the log-probability of all its
tokens. Counts of rare words are joined to the documents in a shuffle by word; only the HEAD most frequent are sent out.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext, cloudpickle

from marlstone.llm.common import staged
from marlstone.llm.words import mix, small_batches, split_words, word_hashes

FOLDS, HELD_OUT_FOLD = 5, 1
VOCABULARY = 1022
#: Words whose counts every task knows (a bound on what is sent out); the rest are joined.
HEAD = 200_000
HIDDEN = 16
CLASSES = 32
LANES, STEPS = 512, 32
TRAIN_LANES, TRAIN_STEPS = 256, 16
#: Tokens whose documents are scored together (long ones fill no lanes by themselves).
SCORE_TOKENS = 4_000_000
#: Tokens that a task is fitted to, about: networks that saw less are not worth averaging, and more would fill its memory.
FIT_LEAST, FIT_MOST, FIT_PARTS = 250_000, 8_000_000, 32
#: Training documents are cut into runs of RUN tokens, which are dealt over the rounds: each run is fitted to in one of them.
RUN = 128
ROUNDS = 4
RATE = 0.01


def _end_hash() -> int:
    """The code of the end of text: the hash of a string that holds a blank, as no word does."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(b"end of text"))))


# ---------------------------------------------------------------- network


class Layout:
    """Token ids 0 to V+1 by descending training frequency (words, end, other), cut into classes of about equal shares."""

    def __init__(self, weights: np.ndarray, classes: int = CLASSES):
        share = np.sqrt(weights)
        cuts = np.minimum((np.cumsum(share) - share / 2) / share.sum() * classes, classes - 1).astype(np.int64)
        self.cls = np.unique(cuts, return_inverse=True)[1]
        self.first = np.concatenate([[0], np.flatnonzero(np.diff(self.cls)) + 1, [len(weights)]])
        self.classes = len(self.first) - 1
        self.shared = np.flatnonzero(np.diff(self.first) > 1).tolist()  # a class of one token says which token it is


def shapes(n: int, classes: int, hidden: int = HIDDEN) -> list[tuple[str, tuple[int, ...]]]:
    """The parameters: what an input adds to both gates and to the candidate state, what the state adds, and the outputs."""
    return [("xg", (n + 1, 2 * hidden)), ("xn", (n + 1, hidden)), ("ug", (hidden, 2 * hidden)), ("un", (hidden, hidden)), ("cw", (hidden, classes)), ("cb", (classes,)), ("ww", (hidden, n)), ("wb", (n,))]


def unpack(flat: np.ndarray, n: int, classes: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(n, classes):
        size = math.prod(shape)
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial(weights: np.ndarray, layout: Layout, seed: int = 1) -> np.ndarray:
    """Small random weights, and biases that make the untrained network the unigram model."""
    n = len(weights)
    flat = np.random.default_rng(seed).normal(0, 0.08, sum(math.prod(s) for _, s in shapes(n, layout.classes))).astype(np.float32)
    p = unpack(flat, n, layout.classes)
    total = np.add.reduceat(weights, layout.first[:-1])
    p["cb"][:] = np.log(total / weights.sum())
    p["wb"][:] = np.log(weights / total[layout.cls])
    p["cw"][:] *= 0.1
    p["ww"][:] *= 0.1
    return flat


def _sigmoid(v: np.ndarray) -> np.ndarray:
    np.negative(v, out=v)
    np.exp(np.minimum(v, 60, out=v), out=v)
    v += 1
    return np.reciprocal(v, out=v)


def forward(p: dict, inputs: np.ndarray, starts: np.ndarray, state: np.ndarray, keep: bool = False):
    """States after each step of (steps, lanes) inputs; a lane whose ``starts`` is true forgets its state first.

    With ``keep`` also what the way back needs: the states before each step, both gates, the candidates, and what the
    states added to them.
    """
    steps, lanes = inputs.shape
    hidden = state.shape[1]
    read = inputs.reshape(-1)
    gates = p["xg"].take(read, axis=0).reshape(steps, lanes, 2 * hidden)  # the inputs' shares, turned into gates in place
    candidate = p["xn"].take(read, axis=0).reshape(steps, lanes, hidden)
    fresh = starts.any(axis=1)
    states = np.empty((steps, lanes, hidden), dtype=gates.dtype)
    befores = np.empty_like(states) if keep else None
    added = np.empty_like(states) if keep else None
    g, a = np.empty((lanes, 2 * hidden), dtype=gates.dtype), np.empty((lanes, hidden), dtype=gates.dtype)
    for t in range(steps):
        if fresh[t]:
            state = state * ~starts[t][:, None]
        zr, n, new = gates[t], candidate[t], states[t]
        zr += np.matmul(state, p["ug"], out=g)
        _sigmoid(zr)
        a = np.matmul(state, p["un"], out=added[t] if keep else a)
        np.multiply(zr[:, hidden:], a, out=new)
        n += new
        np.tanh(n, out=n)
        if keep:
            befores[t] = state
        np.subtract(state, n, out=new)
        new *= zr[:, :hidden]
        new += n
        state = new
    return states, state, (befores, gates, candidate, added)


def _by_class(layout: Layout, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the targets in the order of their classes, and where each class starts in it."""
    cls = layout.cls[targets]
    return np.argsort(cls.astype(np.uint16), kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=layout.classes))])


def token_scores(p: dict, layout: Layout, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target (rows of states)."""
    order, ends = _by_class(layout, targets)
    states, targets = states[order], targets[order]
    logits = states @ p["cw"]
    logits += p["cb"]
    found = logits[np.arange(len(targets)), layout.cls[targets]]
    found -= np.log(np.exp(logits, out=logits).sum(axis=1))
    for c in layout.shared:
        lo, hi = ends[c], ends[c + 1]
        if hi > lo:
            a, b = layout.first[c], layout.first[c + 1]
            within = states[lo:hi] @ p["ww"][:, a:b]
            within += p["wb"][a:b]
            found[lo:hi] += within[np.arange(hi - lo), targets[lo:hi] - a]
            found[lo:hi] -= np.log(np.exp(within, out=within).sum(axis=1))
    out = np.empty_like(found)
    out[order] = found
    return out


def gradients(p: dict, layout: Layout, inputs: np.ndarray, targets: np.ndarray, starts: np.ndarray, real: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the mean loss over one window (truncated there) and the state after it."""
    steps, lanes = inputs.shape
    hidden = state.shape[1]
    n = len(layout.cls)
    states, last, (befores, gates, candidate, added) = forward(p, inputs, starts, state, keep=True)
    flat = np.zeros(sum(math.prod(s) for _, s in shapes(n, layout.classes)), dtype=np.float32)
    d = unpack(flat, n, layout.classes)

    # the output: all real places, in the order of their targets' classes
    places = np.flatnonzero(real.reshape(-1))
    order, ends = _by_class(layout, targets.reshape(-1)[places])
    places = places[order]
    s, t = states.reshape(-1, hidden)[places], targets.reshape(-1)[places]
    weight = np.float32(1 / max(1, len(places)))
    e = s @ p["cw"]
    e += p["cb"]
    np.exp(e, out=e)
    e *= weight / e.sum(axis=1, keepdims=True)
    e[np.arange(len(t)), layout.cls[t]] -= weight
    d["cw"][:], d["cb"][:] = s.T @ e, e.sum(axis=0)
    ds = e @ p["cw"].T
    for c in layout.shared:
        lo, hi = ends[c], ends[c + 1]
        if hi > lo:
            a, b = layout.first[c], layout.first[c + 1]
            e = s[lo:hi] @ p["ww"][:, a:b]
            e += p["wb"][a:b]
            np.exp(e, out=e)
            e *= weight / e.sum(axis=1, keepdims=True)
            e[np.arange(hi - lo), t[lo:hi] - a] -= weight
            d["ww"][:, a:b], d["wb"][a:b] = s[lo:hi].T @ e, e.sum(axis=0)
            ds[lo:hi] += e @ p["ww"][:, a:b].T
    dstates = np.zeros((steps, lanes, hidden), dtype=ds.dtype)
    dstates.reshape(-1, hidden)[places] = ds

    # back through the steps: all that does not depend on what comes back is computed for the whole window at once
    z, r = gates[:, :, :hidden], gates[:, :, hidden:]
    to_candidate = (1 - z) * (1 - candidate * candidate)
    to_gates = np.concatenate([(befores - candidate) * z * (1 - z), added * r * (1 - r)], axis=2)
    dn, dg = np.empty_like(dstates), to_gates
    da = np.empty_like(dstates)
    fresh = starts.any(axis=1)
    back = np.zeros((lanes, hidden), dtype=ds.dtype)
    ug, un = np.ascontiguousarray(p["ug"].T), np.ascontiguousarray(p["un"].T)
    for k in range(steps - 1, -1, -1):
        dh = dstates[k]
        dh += back
        np.multiply(dh, to_candidate[k], out=dn[k])
        dg[k, :, :hidden] *= dh
        dg[k, :, hidden:] *= dn[k]
        np.multiply(dn[k], r[k], out=da[k])
        back = dg[k] @ ug
        back += da[k] @ un
        dh *= z[k]
        back += dh
        if fresh[k]:
            back *= ~starts[k][:, None]
    befores = befores.reshape(-1, hidden)
    dn, dg, da = dn.reshape(-1, hidden), dg.reshape(-1, 2 * hidden), da.reshape(-1, hidden)
    d["ug"][:], d["un"][:] = befores.T @ dg, befores.T @ da
    read = inputs.reshape(-1)
    order = np.argsort(read.astype(np.uint16) if n < 2**16 - 1 else read, kind="stable")
    read = read[order]
    heads = np.flatnonzero(np.concatenate([[True], read[1:] != read[:-1]]))
    d["xg"][read[heads]] = np.add.reduceat(dg[order], heads, axis=0)
    d["xn"][read[heads]] = np.add.reduceat(dn[order], heads, axis=0)
    norm = float(np.sqrt(flat @ flat))
    if norm > 1:
        flat /= norm
    return flat, last


def lanes_of(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The lane and the place in it of each of several token runs, longest first to the emptiest lane; and the longest lane."""
    import heapq

    load = [(0, lane) for lane in range(lanes)]
    lane, place = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        used, own = heapq.heappop(load)
        lane[k], place[k] = own, used
        heapq.heappush(load, (used + int(lengths[k]), own))
    return lane, place, max(used for used, _ in load)


class Streams:
    """Token runs laid one behind another in lanes, the longest lane first, and read in windows of steps x lanes."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, lanes: int):
        lengths = np.diff(offsets)
        lane, place, self.steps = lanes_of(lengths, lanes)
        load = np.bincount(lane, weights=lengths, minlength=lanes).astype(np.int64)
        rank = np.argsort(np.argsort(-load, kind="stable"), kind="stable")
        self.load = np.sort(load)[::-1]
        self.first = np.concatenate([[0], np.cumsum(self.load)[:-1]])
        spot = self.first[rank[lane]] + place  # where each run starts in the order of the lanes
        order = np.argsort(spot, kind="stable")
        order = order[lengths[order] > 0]
        sizes = lengths[order]
        self.tokens = np.empty(len(flat), dtype=flat.dtype)
        self.owner = np.repeat(order.astype(np.int32), sizes)
        self.fresh = np.zeros(len(flat), dtype=bool)
        self.fresh[spot[order]] = True
        for k, at, size in zip(order.tolist(), spot[order].tolist(), sizes.tolist()):
            self.tokens[at : at + size] = flat[offsets[k] : offsets[k] + size]

    def window(self, a: int, steps: int):
        """(places of the tokens, (steps, lanes) mask of what is there) of the lanes that reach beyond ``a``."""
        lanes = int((self.load > a).sum())
        at = np.arange(a, min(a + steps, self.steps))[:, None]
        real = at < self.load[None, :lanes]
        return np.where(real, self.first[None, :lanes] + at, 0), real

    def read(self, places: np.ndarray, real: np.ndarray, first_input: int):
        """Targets, inputs and starts of a window."""
        starts = self.fresh[places] | ~real
        inputs = self.tokens[np.maximum(places - 1, 0)].astype(np.int32)
        inputs[starts] = first_input
        return self.tokens[places], inputs, starts


def score_runs(p: dict, layout: Layout, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The natural log-probability of each whole run of token ids, its state carried from window to window."""
    count = len(offsets) - 1
    out = np.zeros(count)
    if not count or not len(flat):
        return out
    streams = Streams(flat, offsets, min(LANES, count))
    state = np.zeros((min(LANES, count), HIDDEN), dtype=np.float32)
    for a in range(0, streams.steps, STEPS):
        places, real = streams.window(a, STEPS)
        targets, inputs, starts = streams.read(places, real, len(layout.cls))
        states, state, _ = forward(p, inputs, starts, state[: real.shape[1]])
        got = token_scores(p, layout, states[real], targets[real])
        out += np.bincount(streams.owner[places[real]], weights=got, minlength=count)
    return out


def train_runs(flat_params: np.ndarray, layout: Layout, flat: np.ndarray, offsets: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Parameters after one pass of Adam over the runs."""
    n = len(layout.cls)
    params = flat_params.copy()
    if len(offsets) < 2 or not len(flat):
        return params
    p = unpack(params, n, layout.classes)
    streams = Streams(flat, offsets, min(TRAIN_LANES, len(offsets) - 1))
    first, second, step = np.zeros_like(params), np.zeros_like(params), 0
    state = np.zeros((min(TRAIN_LANES, len(offsets) - 1), HIDDEN), dtype=np.float32)
    for a in range(0, streams.steps, TRAIN_STEPS):
        places, real = streams.window(a, TRAIN_STEPS)
        targets, inputs, starts = streams.read(places, real, n)
        gradient, state = gradients(p, layout, inputs, targets, starts, real, state[: real.shape[1]])
        step += 1
        first += 0.1 * (gradient - first)
        gradient *= gradient
        gradient -= second
        second += 0.01 * gradient
        params -= rate / (1 - 0.9**step) * first / (np.sqrt(second * (1 / (1 - 0.99**step))) + 1e-6)
    return params


# ---------------------------------------------------------------- corpus


def counted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One staged table of two kinds of rows from one pass over the training documents: (word, n), the tokens' counts of
    a task; and (deal, run): all runs of tokens of every document, as 64-bit codes, and a number that depends on the document
    and the run's place in it alone, so that how the corpus is laid out changes nothing."""

    def count(batches):
        end = np.array([_end_hash()], dtype=np.int64)
        words, counts, size = [], [], 0
        for batch in small_batches(batches, 1):
            vocabulary, codes, offsets = split_words(batch.column(1), lower_ascii=True)
            hashes = word_hashes(vocabulary).view(np.int64)
            n = np.bincount(codes, minlength=len(vocabulary))
            words += [hashes[n > 0], end]
            counts += [n[n > 0], np.array([batch.num_rows])]
            size += len(vocabulary)
            runs, deals = [], []
            for mark, a, b in zip(batch.column(2).to_numpy(), offsets[:-1], offsets[1:]):
                own = np.append(hashes[codes[a:b]], end)
                runs += [own[c : c + RUN].tobytes() for c in range(0, len(own), RUN)]
                deals.append(np.arange(-(-len(own) // RUN), dtype=np.uint64) + np.int64(mark).view(np.uint64))
            if runs:
                numbers = pa.array((mix(np.concatenate(deals)) >> np.uint64(1)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(runs), pa.int64()), pa.nulls(len(runs), pa.int64()), numbers, pa.array(runs, pa.binary())], names=["word", "n", "deal", "run"])
            if size > 2_000_000:
                yield from flush(words, counts)
                words, counts, size = [], [], 0
        if words:
            yield from flush(words, counts)

    def flush(words, counts):
        word, place = np.unique(np.concatenate(words), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
        for a in range(0, len(word), 100_000):
            part = word[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[a : a + 100_000]), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary())], names=["word", "n", "deal", "run"])

    training = docs.where(F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)) != HELD_OUT_FOLD, F.lit(True)))
    return staged(training.select(F.col(doc_id).cast("long"), F.col(text), F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("__mark")).mapInArrow(count, "word long, n long, deal long, run binary"), "lm-corpus")


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the most frequent words, at most ``most``, ties cut off whole, by descending count."""
    bins = counts.groupBy(F.floor(F.log(1.02, F.col("n"))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("bin")).collect()  # log(largest count) rows
    least, total = None, 0
    for r in bins:
        total += r["words"]
        if total > most:
            break
        least = r["bin"]
    if least is None:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    head = counts.where(F.floor(F.log(1.02, F.col("n"))).cast("int") >= least).select("word", "n").toArrow()  # at most ``most`` rows
    word, n = (head.column(c).to_numpy().astype(np.int64) for c in (0, 1))
    order = np.lexsort((word, -n))
    return word[order], n[order]


class Lexicon:
    """What every task knows: counts of the head and token ids of the vocabulary, as sorted arrays; sums of all counts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, vocabulary: int):
        end = _end_hash()
        ranked = [(int(w), int(n)) for w, n in zip(words, counts) if w != end][:vocabulary]
        ends = int(counts[words == end][0]) if (words == end).any() else 0
        self.floor = math.log10(total + 0.5 * (distinct + 1))
        inside = sum(n + 0.5 for _, n in ranked) + ends + 0.5
        self.others = max(total + 0.5 * (distinct + 1) - inside, 0.5)
        entries = sorted([*ranked, (end, ends + 0.5)], key=lambda x: (-x[1], x[0]))
        weights = [n + 0.5 for _, n in entries]
        at = int(np.searchsorted(-np.array(weights), -self.others)) if weights else 0
        self.other = at
        self.weights = np.insert(np.array(weights, dtype=float), at, self.others)
        ids = [k + (k >= at) for k in range(len(entries))]
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        vocab = sorted((w, k) for (w, _), k in zip(entries, ids))
        self.vocab, self.ids = np.array([w for w, _ in vocab], dtype=np.int64), np.array([k for _, k in vocab], dtype=np.int64)

    def token_ids(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocab, codes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == codes, self.ids[at], self.other)

    def head_counts(self, codes: np.ndarray) -> np.ndarray:
        """Counts of the head's words, -1 for others."""
        if not len(self.words):
            return np.full(len(codes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        return np.where(self.words[at] == codes, self.counts[at], -1)


def fitted(corpus: DataFrame, lexicon: Lexicon, layout: Layout, tokens: int, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters fitted to each of the corpus table's runs in one round; each task's result counts by its number of tokens.
    The number of parts grows with the corpus's ``tokens`` alone, so that what one task holds doesn't grow and neither the session
    nor the files that a table lies in move a score."""
    params = initial(lexicon.weights, layout)
    narrow = np.int16 if len(lexicon.weights) < 2**15 else np.int32

    def encode(batches):
        for batch in batches:
            ids = [lexicon.token_ids(np.frombuffer(r, dtype=np.int64)).astype(narrow).tobytes() for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["deal", "run"])

    parts = max(1, min(FIT_PARTS, tokens // FIT_LEAST), tokens // FIT_MOST)

    def pack(batches):
        """A row for each part and round: the runs behind one another, in the order of their numbers."""
        held: dict[int, list[bytes]] = {}
        part = None
        for batch in batches:
            for own, deal, run in zip(*(c.to_pylist() for c in batch.columns)):
                if own != part:
                    yield from packed(held)
                    held, part = {}, own
                held.setdefault(deal % rounds, []).append(run)
        yield from packed(held)

    def packed(held):
        for number, own in held.items():
            sizes = np.array([len(r) for r in own], dtype=np.int64) // np.dtype(narrow).itemsize
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([b"".join(own)], pa.binary()), pa.array([sizes.tobytes()], pa.binary())], names=["round", "runs", "sizes"])

    encoded = corpus.where("run is not null").select("deal", "run").mapInArrow(encode, "deal long, run binary")
    dealt = encoded.select(F.pmod(F.xxhash64("deal"), F.lit(parts)).alias("part"), "deal", "run")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "deal", "run")
    runs = staged(dealt.mapInArrow(pack, "round long, runs binary, sizes binary"), "lm-runs")
    for number in range(rounds):
        start = params

        def fit(batches):
            for batch in batches:
                for own, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                    flat = np.frombuffer(own, dtype=narrow)
                    out = train_runs(start, layout, flat, np.concatenate([[0], np.cumsum(np.frombuffer(sizes, dtype=np.int64))]), RATE / (1 + number))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array((out * len(flat)).astype(np.float64)), pa.array(np.full(len(out), float(len(flat))))], names=["place", "value", "weight"])

        mean = runs.where(F.col("round") == number).select("runs", "sizes").mapInArrow(fit, "place int, value double, weight double").groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow()  # one row for each parameter
        if mean.num_rows == len(params):
            params = np.empty(len(params), dtype=np.float32)
            params[mean.column(0).to_numpy()] = mean.column(1).to_numpy()
    return params


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY, head: int = HEAD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words, with A to Z in lower case, and one end. Null and empty texts are an end alone. A null id is in no
    fold: such a row is learnt from. Repeated rows are learnt from and scored each on their own. Without training
    documents every count is 0. Words are told apart by 64-bit hashes. A text of any length is scored whole, state carried
    from its first token to its end, and learnt from in runs of ``RUN`` tokens. Ids must be integers or null; other columns are
    not read. How the rows are laid out over files and tasks changes no score. An empty table gives no rows.
    """
    corpus = counted(docs, doc_id, text)
    counts = staged(corpus.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
    lexicon = Lexicon(*frequent(counts, head), total, distinct, vocabulary)
    layout = Layout(lexicon.weights)
    params = fitted(corpus, lexicon, layout, int(total))
    # bounded by head and vocabulary; pickled with its classes, as executors need not have this package
    known = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((lexicon, layout, params)))

    def score(batches):
        lexicon, layout, params = pickle.loads(known.value)
        p = unpack(params, len(lexicon.weights), layout.classes)
        task, row = TaskContext.get().partitionId() << 33, 0
        end = np.array([_end_hash()], dtype=np.int64)
        narrow = np.int16 if len(lexicon.weights) < 2**15 else np.int32
        held, waiting = [], 0

        def network():
            rows, ids, lengths, known_words, base, others, tokens = (pa.concat_arrays(c) if isinstance(c[0], pa.Array) else np.concatenate(c) for c in zip(*held))
            got = score_runs(p, layout, tokens, np.concatenate([[0], np.cumsum(lengths)])) / math.log(10)
            return _rows(rows, ids, lengths, known_words, base, got + others)

        for batch in small_batches(batches, 1):
            vocabulary, codes, offsets = split_words(batch.column(1), lower_ascii=True)
            hashes = np.append(word_hashes(vocabulary).view(np.int64), end)
            n = batch.num_rows
            codes = np.insert(codes, offsets[1:], len(vocabulary))  # an end after each text
            offsets = offsets + np.arange(n + 1)
            lengths = np.diff(offsets)
            owner = np.repeat(np.arange(n), lengths)
            token, count = lexicon.token_ids(hashes), lexicon.head_counts(hashes)
            in_head = count >= 0
            base = np.where(in_head, np.log10(np.maximum(count, 0) + 0.5), 0.0)
            other = token == lexicon.other
            head_base = np.bincount(owner, weights=base[codes], minlength=n)
            head_known = np.bincount(owner, weights=(count > 0)[codes], minlength=n)
            other_base = np.bincount(owner, weights=np.where(other, base - math.log10(lexicon.others), 0.0)[codes], minlength=n)
            rows = task + row + np.arange(n)
            row += n
            held.append((rows, batch.column(0), lengths, head_known.astype(np.int64), head_base - lengths * lexicon.floor, other_base, token.astype(narrow)[codes]))
            waiting += len(codes)
            rare = np.flatnonzero(~in_head[codes])
            if len(rare):
                pair = np.unique(owner[rare] * len(hashes) + codes[rare], return_counts=True)
                who, which = pair[0] // len(hashes), pair[0] % len(hashes)
                for a in range(0, len(who), 200_000):
                    yield _rare(rows[who[a : a + 200_000]], hashes[which[a : a + 200_000]], pair[1][a : a + 200_000])
            if waiting >= SCORE_TOKENS:
                yield network()
                held, waiting = [], 0
        if held:
            yield network()

    fields = "row long, word long, n int, doc_id long, n_tokens long, n_known long, base double, score double"
    both = staged(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(score, fields), "lm-scored")
    rare = both.where("word is not null").select("row", "word", "n")
    tail = counts if not len(lexicon.words) else counts.where(F.col("n") <= int(lexicon.counts.min()))
    logs = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5))
    found = rare.join(tail.select("word", F.col("n").alias("c")), "word", "left").groupBy("row").agg(F.sum(F.col("n") * logs).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    rows = both.where("word is null").drop("word", "n").join(found, "row", "left")
    return rows.select(
        "doc_id",
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_base", F.lit(0.0))).alias("score"),
    )


NAMES = ["row", "word", "n", "doc_id", "n_tokens", "n_known", "base", "score"]


def _rows(rows, ids, lengths, known, base, score):
    m = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), ids, pa.array(lengths.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score)], names=NAMES)


def _rare(rows, words, counts):
    m = len(rows)
    empty = [pa.nulls(m, pa.int64()) for _ in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(words), pa.array(counts.astype(np.int32)), *empty, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names=NAMES)


def query(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
