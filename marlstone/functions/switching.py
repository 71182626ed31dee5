"""Gaussian regimes with switching mean and variance over a series that is cut into spans.

A span's rows are matrices, transition times density, and all that expectation-maximisation needs of them is bilinear in what
comes before the span and what comes after it: the product of the matrices, and for each statistic the sum of the products in
which one row's matrix is weighted by it. So each span is reduced once a step, wherever it lies, to a few numbers, and a scan
over the spans' products gives the vectors between which those are taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

#: Rows of a block; blocks of a span are worked on side by side.
BLOCK = 24
#: Densities are kept at this share of a row's largest at least.
TINY = 1e-100


@dataclass(frozen=True)
class Parameters:
    means: np.ndarray
    sds: np.ndarray
    transition: np.ndarray


@dataclass(frozen=True)
class SpanSums:
    """A span's product, scaled by exp(-log), and its weighted products on the same scale: entry and exit state first, then
    the state (weights, x, x^2) or the two states of a step (steps)."""

    log: float
    product: np.ndarray
    weights: np.ndarray
    steps: np.ndarray


def stationary(transition: np.ndarray) -> np.ndarray:
    k = len(transition)
    a = np.vstack([transition.T - np.eye(k), np.ones(k)])
    p = np.clip(np.linalg.lstsq(a, np.append(np.zeros(k), 1.0), rcond=None)[0], 1e-12, None)
    return p / p.sum()


def _row_matrices(x: np.ndarray, p: Parameters, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each row's matrix, rows last, and the logarithm it is to be scaled by; a series' first row has no step before it."""
    dens = -0.5 * ((x - p.means[:, None]) / p.sds[:, None]) ** 2 - np.log(p.sds)[:, None] - 0.5 * math.log(2 * math.pi)
    top = dens.max(axis=0)
    out = p.transition[:, :, None] * np.maximum(np.exp(dens - top), TINY)[None]
    if first and len(x):
        out[:, :, 0] = np.diag(np.exp(dens[:, 0] - top[0]))
    return out, top


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of two rows of matrices, entries first and places last."""
    k = len(a)
    out = np.empty(np.broadcast_shapes(a.shape, b.shape))
    for i in range(k):
        for j in range(k):
            np.multiply(a[i, 0], b[0, j], out=out[i, j])
            for inner in range(1, k):
                out[i, j] += a[i, inner] * b[inner, j]
    return out


def _running(m: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of the first 1, 2, … of matrices (entries first, places last), each scaled to a largest entry of 1, with the
    logarithms of the scales. Blocks run side by side; the blocks' own products are run through in the same way."""
    k, n = len(m), m.shape[2]
    length = min(BLOCK, n)
    blocks = -(-n // length) if n else 0
    if not n:
        return m, logs
    pad = blocks * length - n
    rows = np.concatenate([m, np.broadcast_to(np.eye(k)[:, :, None], (k, k, pad))], axis=2).reshape(k, k, blocks, length)
    out = np.ascontiguousarray(rows.transpose(0, 1, 3, 2))  # places within blocks, then blocks side by side
    for t in range(1, length):  # a block is too short for its entries to leave the range of doubles
        out[:, :, t] = _product(out[:, :, t - 1], out[:, :, t])
    log = np.concatenate([logs, np.zeros(pad)]).reshape(blocks, length).T.cumsum(axis=0)
    out, log = _scaled(out, log)
    if blocks > 1:
        before, before_log = _running(out[:, :, -1], log[-1])
        whole, whole_log = _scaled(_product(before[:, :, None, :-1], out[:, :, :, 1:]), log[:, 1:] + before_log[None, :-1])
        out, log = np.concatenate([out[:, :, :, :1], whole], axis=3), np.concatenate([log[:, :1], whole_log], axis=1)
    return out.transpose(0, 1, 3, 2).reshape(k, k, -1)[:, :, :n], log.T.ravel()[:n]


def _scaled(m: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = m.reshape(-1, *m.shape[2:]).max(axis=0)
    return np.maximum(m / top, TINY), logs + np.log(top)


def _both_ways(x: np.ndarray, p: Parameters, first: bool):
    """(row matrices, their logs, products up to each row, logs, products after each row, logs), rows last."""
    m, logs = _row_matrices(x, p, first)
    ahead, ahead_log = _running(m, logs)
    back, back_log = _running(m[:, :, ::-1].transpose(1, 0, 2), logs[::-1])
    last = np.eye(len(p.means))[:, :, None]
    after = np.concatenate([back.transpose(1, 0, 2)[:, :, ::-1][:, :, 1:], last], axis=2)
    return m, logs, ahead, ahead_log, after, np.append(back_log[::-1][1:], 0.0)


def span_sums(x: np.ndarray, p: Parameters, first: bool) -> SpanSums:
    """All that a step needs of a span's rows."""
    k = len(p.means)
    weights, steps = np.zeros((k, k, 3, k)), np.zeros((k, k, k, k))
    if not len(x):
        return SpanSums(0.0, np.eye(k), weights, steps)
    m, logs, ahead, ahead_log, after, after_log = _both_ways(x, p, first)
    total = float(ahead_log[-1])
    share = np.exp(ahead_log + after_log - total)
    for power in range(3):
        for j in range(k):
            weights[:, :, power, j] = (ahead[:, j] * share) @ after[j].T
        share = share * x
    begin = 1 if first else 0
    before = np.concatenate([np.eye(k)[:, :, None], ahead[:, :, :-1]], axis=2)[:, :, begin:]
    step = np.exp(np.append(0.0, ahead_log[:-1]) + logs + after_log - total)[begin:]
    for i in range(k):
        for j in range(k):
            steps[:, :, i, j] = (before[:, i] * (step * m[i, j, begin:])) @ after[j, :, begin:].T
    return SpanSums(total, ahead[:, :, -1], weights, steps)


def scan(sums: Sequence[SpanSums], transition: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
    """The log-likelihood, and for each span the vectors before and after it, each scaled to a sum of 1."""
    k = len(transition)
    left, loglik, lefts = stationary(transition), 0.0, []
    for s in sums:
        lefts.append(left)
        left = left @ s.product
        loglik += s.log + math.log(left.sum())
        left = left / left.sum()
    right, rights = np.full(k, 1 / k), []
    for s in reversed(sums):
        rights.append(right)
        right = s.product @ right
        right = right / right.sum()
    return loglik, list(zip(lefts, reversed(rights)))


def expectation(sums: Sequence[SpanSums], transition: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, expected sums of 1, x and x^2 by state, expected steps between states)."""
    k = len(transition)
    loglik, ends = scan(sums, transition)
    weights, steps = np.zeros((3, k)), np.zeros((k, k))
    for s, (left, right) in zip(sums, ends):
        total = left @ s.product @ right
        weights += np.einsum("k,klpj,l->pj", left, s.weights, right) / total
        steps += np.einsum("k,klij,l->ij", left, s.steps, right) / total
    return loglik, weights, steps


def probabilities(x: np.ndarray, p: Parameters, first: bool, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered and smoothed state probabilities of a span's rows."""
    _, _, ahead, _, after, _ = _both_ways(x, p, first)
    joint = np.einsum("k,kjt->tj", left, ahead)
    filtered = joint / joint.sum(axis=1, keepdims=True)
    smoothed = filtered * np.einsum("jlt,l->tj", after, right)
    return filtered, smoothed / smoothed.sum(axis=1, keepdims=True)


def start_draws(n: int, states: int, start: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose values are the first means, factors of the first deviations) of a start after the first."""
    rng = np.random.default_rng(seed + start)
    rows = rng.choice(n, states)
    return rows, rng.uniform(0.3, 2.5, states)


def start_parameters(start: int, states: int, mean: float, spread: float, values: np.ndarray | None, factors: np.ndarray | None) -> Parameters:
    """The first start has equal means and deviations around the series' own; others draw."""
    tr = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(tr, 0.95)
    if start == 0:
        return Parameters(np.full(states, mean), spread * np.geomspace(0.5, 2.0, states), tr)
    return Parameters(np.asarray(values, dtype=float), spread * factors, tr)


def maximised(weights: np.ndarray, steps: np.ndarray, spread: float) -> Parameters:
    """The parameters that expected sums make likeliest; no deviation falls under a thousandth of the series'."""
    steps = np.maximum(steps, 1e-12)
    w = np.maximum(weights[0], 1e-12)
    means = weights[1] / w
    variance = (weights[2] - 2 * means * weights[1] + means * means * weights[0]) / w
    return Parameters(means, np.sqrt(np.maximum(variance, (1e-3 * spread) ** 2)), steps / steps.sum(axis=1, keepdims=True))


def maximise(starts: dict[int, Parameters], reduce: Callable[[dict[int, Parameters]], dict[int, list[SpanSums]]], spread: float, iterations: int = 200) -> dict[int, tuple[float, Parameters]]:
    """Expectation-maximisation of several starts side by side; ``reduce`` gives every span's sums under each start's parameters.
    A start ends when a step gains less than 1e-8 of its log-likelihood."""
    now, last, ended = dict(starts), {s: -math.inf for s in starts}, {}
    for _ in range(iterations):
        if not now:
            break
        for start, sums in reduce(now).items():
            loglik, weights, steps = expectation(sums, now[start].transition)
            now[start] = maximised(weights, steps, spread)
            if loglik - last[start] < 1e-8 * max(1.0, abs(loglik)):
                ended[start] = now.pop(start)
            last[start] = loglik
    ended |= now
    return {s: (scan(sums, ended[s].transition)[0], ended[s]) for s, sums in reduce(ended).items()}


def by_volatility(p: Parameters) -> Parameters:
    o = np.argsort(p.sds, kind="stable")
    return Parameters(p.means[o], p.sds[o], p.transition[np.ix_(o, o)])


def fit(x: np.ndarray, states: int, starts: Sequence[int], seed: int, iterations: int = 200) -> tuple[int, float, Parameters]:
    """(start, log-likelihood, parameters) of the best of some starts over a series that is one span; the first of equals."""
    spread = max(float(x.std()), 1e-12)
    first = {}
    for s in starts:
        rows, factors = start_draws(len(x), states, s, seed)
        first[s] = start_parameters(s, states, float(x.mean()), spread, x[rows], factors)
    found = maximise(first, lambda now: {s: [span_sums(x, p, True)] for s, p in now.items()}, spread, iterations)
    best = max(found, key=lambda s: (found[s][0], -s))
    return best, found[best][0], by_volatility(found[best][1])
