"""Small numeric kernels in numpy: what remains to be solved after the distributed sums."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

# ---------------------------------------------------------------- distributions


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else float("nan")


def pot_tail(excess: np.ndarray, threshold: float, n: int, confidence: float) -> dict:
    """A generalised Pareto law fitted to excesses over a threshold by profile likelihood, and the VaR and CVaR it implies."""
    k = len(excess)
    out = {"threshold": threshold, "n": n, "exceedances": k, "shape": None, "scale": None, "var_evt": None, "cvar_evt": None, "reason": None}
    if k < 10:
        return out | {"reason": f"only {k} exceedances"}
    shape, scale = fit_pareto(np.asarray(excess, dtype=float))
    ratio = n / k * (1 - confidence)
    var = threshold + (scale * -math.log(ratio) if abs(shape) < 1e-8 else scale / shape * (ratio**-shape - 1))
    cvar = math.inf if shape >= 1 else (var + scale - shape * threshold) / (1 - shape)
    return out | {"shape": shape, "scale": scale, "var_evt": var, "cvar_evt": cvar}


def fit_pareto(y: np.ndarray) -> tuple[float, float]:
    """(shape, scale) that maximise the likelihood: for each theta = shape / scale the shape is a mean of logarithms."""
    mean, top = y.mean(), y.max()

    def likelihood(theta):
        if abs(theta) < 1e-12:
            return -len(y) * (math.log(mean) + 1)
        shape = np.log1p(theta * y).mean()
        return -math.inf if shape / theta <= 0 else -len(y) * (math.log(shape / theta) + shape + 1)

    grid = np.concatenate([-np.geomspace(1e-9, 1 - 1e-9, 200)[::-1] / top, [0.0], np.geomspace(1e-6, 200, 400) / mean])
    values = [likelihood(t) for t in grid]
    at = int(np.argmax(values))
    low, high = grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)]
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(100):
        a, b = high - golden * (high - low), low + golden * (high - low)
        if likelihood(a) > likelihood(b):
            high = b
        else:
            low = a
    theta = (low + high) / 2
    if abs(theta * mean) < 1e-9:
        return 0.0, float(mean)
    shape = float(np.log1p(theta * y).mean())
    return shape, shape / theta


# ---------------------------------------------------------------- matrices


def correlation_of(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.outer(sd, sd)
    rho = np.divide(cov, scale, out=np.zeros_like(cov, dtype=float), where=scale > 0)
    rho = np.clip(rho, -1, 1)
    np.fill_diagonal(rho, 1.0)
    return rho


def _moment_matrices(rows, tickers):
    at = {t: i for i, t in enumerate(tickers)}
    n = len(tickers)
    xy, xxyy, xxxy = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n))
    count = 0
    for r in rows:
        i, j = at[r["a"]], at[r["b"]]
        count = r["n"]
        xy[i, j] = xy[j, i] = r["xy"]
        xxyy[i, j] = xxyy[j, i] = r["xxyy"]
        xxxy[i, j], xxxy[j, i] = r["xxxy"], r["xyyy"]
    return count, xy, xxyy, xxxy


def window_moments(window: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The same moments (n, xy, xxyy, xxxy) of a small matrix of observations by assets."""
    x = window - window.mean(axis=0)
    n = len(x)
    return n, x.T @ x / n, (x * x).T @ (x * x) / n, (x**3).T @ x / n


def ledoit_wolf(rows, tickers) -> tuple[np.ndarray, float]:
    """Shrinkage to a scaled identity, from centred pair moments; covariance with denominator n."""
    return shrunk_to_identity(*_moment_matrices(rows, tickers)[:3])


def shrunk_to_identity(n: int, s: np.ndarray, xxyy: np.ndarray) -> tuple[np.ndarray, float]:
    p = len(s)
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum()
    b2 = min((xxyy - s**2).sum() / n, d2) if n else 0.0
    shrink = b2 / d2 if d2 > 0 else 0.0
    return (1 - shrink) * s + shrink * mu * np.eye(p), float(shrink)


def constant_correlation(rows, tickers) -> tuple[np.ndarray, float]:
    """Shrinkage to the matrix of equal correlations, from centred pair moments. Fewer than 2 rows or assets: none."""
    return shrunk_to_constant_correlation(*_moment_matrices(rows, tickers))


def shrunk_to_constant_correlation(n: int, s: np.ndarray, xxyy: np.ndarray, xxxy: np.ndarray) -> tuple[np.ndarray, float]:
    """The target has the variances of ``s`` (denominator n) and the mean correlation of all pairs, where a pair with an asset
    that doesn't move, and such an asset's own place, count as if they were 0. The part that is not shrunk is rescaled to the
    denominator n - 1, so that without shrinkage the result is the sample covariance."""
    p = len(s)
    unbiased = s * (n / (n - 1)) if n > 1 else s
    if n < 2 or p < 2:
        return unbiased, 0.0
    sd = np.sqrt(np.maximum(np.diag(s), 0))
    live = sd > 0
    divisor = np.where(live, sd, 1.0)
    mean = ((s / np.outer(divisor, divisor)).sum() - p) / (p * (p - 1))
    target = mean * np.outer(sd, sd)
    np.fill_diagonal(target, np.diag(s))
    pi = xxyy - s**2
    theta = xxxy - np.diag(s)[:, None] * s
    covered = theta * np.outer(1 / divisor, divisor)
    np.fill_diagonal(covered, 0.0)
    rho = np.trace(pi) + mean * covered.sum()
    gamma = ((target - s) ** 2).sum()
    shrink = float(np.clip((pi.sum() - rho) / gamma / n, 0, 1)) if gamma > 0 else 0.0
    return shrink * target + (1 - shrink) * unbiased, shrink


def ols(xtx: np.ndarray, xty: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(xtx, xty, rcond=None)[0]


def sign_fixed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest entry by size is positive."""
    at = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


# ---------------------------------------------------------------- trees


def linkage(distance: np.ndarray, method: str = "ward") -> np.ndarray:
    """Merges (left, right, height, size) by the Lance-Williams rule; new clusters are numbered from the number of leaves.

    A chain of nearest neighbours grows until two are each other's nearest and merge: each step reads one row, so all take
    time with the square of the leaves. The merges are then put in the order of their heights, which for these rules is that of
    the closest pair at each step."""
    if method not in ("single", "complete", "average", "ward"):
        raise ValueError(f"unknown linkage {method!r}")
    n = len(distance)
    d = np.array(distance, dtype=float)
    np.fill_diagonal(d, np.inf)
    size, name = np.ones(n), list(range(n))  # a merged cluster takes the place of its second part
    live = np.ones(n, dtype=bool)
    merges, chain = [], []
    for step in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(live)[0]))
        while True:
            row = np.where(live, d[chain[-1]], np.inf)
            near = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                break
            chain.append(near)
        a, b = chain.pop(), chain.pop()
        h, na, nb = d[a, b], size[a], size[b]
        ac, bc = d[a], d[b]
        if method == "single":
            new = np.minimum(ac, bc)
        elif method == "complete":
            new = np.maximum(ac, bc)
        elif method == "average":
            new = (na * ac + nb * bc) / (na + nb)
        else:
            with np.errstate(invalid="ignore"):
                new = np.sqrt(np.maximum(0.0, ((na + size) * ac**2 + (nb + size) * bc**2 - size * h**2) / (na + nb + size)))
        merges.append((name[a], name[b], h))
        name[b], size[b], live[a] = n + step, na + nb, False
        new[~live] = np.inf
        new[b] = np.inf
        d[b], d[:, b] = new, new
    order = sorted(range(len(merges)), key=lambda k: (merges[k][2], k))
    number = {n + k: n + place for place, k in enumerate(order)}
    out, held = [], [1] * n
    for k in order:
        a, b = sorted(number.get(x, x) for x in merges[k][:2])
        held.append(held[a] + held[b])
        out.append((a, b, merges[k][2], held[-1]))
    return np.array(out, dtype=float).reshape(-1, 4)


def leaf_order(merges: np.ndarray) -> list[int]:
    n = len(merges) + 1
    order, stack = [], [2 * n - 2]
    while stack:
        node = stack.pop()
        if node < n:
            order.append(node)
        else:
            stack += [int(merges[node - n, 1]), int(merges[node - n, 0])]
    return order


def cut_clusters(merges: np.ndarray, k: int) -> list[int]:
    """Labels from 1 by first appearance, after undoing the highest merges down to at most ``k`` clusters."""
    n = len(merges) + 1
    parent = list(range(2 * n - 1))
    for step in np.argsort(merges[:, 2], kind="stable")[: max(0, n - k)] if n > 1 else []:
        for child in merges[step, :2].astype(int):
            parent[child] = n + int(step)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    seen: dict[int, int] = {}
    return [seen.setdefault(root(i), len(seen) + 1) for i in range(n)]


def spanning_tree(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """The edges of the minimum spanning tree (Prim); a distance of zero is an edge like any other."""
    n = len(distance)
    if n < 2:
        return []
    near, source = distance[0].astype(float).copy(), np.zeros(n, dtype=int)
    done = np.zeros(n, dtype=bool)
    done[0] = True
    out = []
    for _ in range(n - 1):
        j = int(np.argmin(np.where(done, np.inf, near)))
        out.append((min(int(source[j]), j), max(int(source[j]), j), float(near[j])))
        done[j] = True
        closer = distance[j] < near
        near[closer], source[closer] = distance[j][closer], j
    return out


# ---------------------------------------------------------------- regimes


def _log_normal(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return -0.5 * ((x[:, None] - mean) / sd) ** 2 - np.log(sd) - 0.5 * math.log(2 * math.pi)


def stationary(transition: np.ndarray) -> np.ndarray:
    k = len(transition)
    a = np.vstack([transition.T - np.eye(k), np.ones(k)])
    p = np.clip(np.linalg.lstsq(a, np.append(np.zeros(k), 1.0), rcond=None)[0], 1e-12, None)
    return p / p.sum()


#: Entries of products are kept at this share of the largest one at least: products of two are then no denormal numbers, which
#: processors are slow with.
TINY = 1e-100


def _running_products(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The products of the first t matrices for each t, each divided by its largest entry, and the logarithms of what was
    divided by. Doubling the reach of the products takes log2(n) steps instead of n; each works on whole series of entries."""
    k = m.shape[1]
    out = np.ascontiguousarray(m.transpose(1, 2, 0))  # entry by entry, along the series
    logs, reach = np.zeros(len(m)), 0
    while True:
        if reach:
            left, right = out[:, :, :-reach], out[:, :, reach:]
            joined = np.zeros(right.shape)
            for i in range(k):
                for j in range(k):
                    for inner in range(k):
                        joined[i, j] += left[i, inner] * right[inner, j]
            logs[reach:] += logs[:-reach].copy()
        else:
            joined = out
        top = joined.reshape(k * k, -1).max(axis=0)
        out[:, :, reach:] = np.maximum(joined / top, TINY)
        logs[reach:] += np.log(top)
        reach = 2 * reach or 1
        if reach >= len(m):
            return out.transpose(2, 0, 1), logs


def hamilton_filter(x, mean, sd, transition):
    """Filtered and predicted state probabilities and the log-likelihood."""
    dens = _log_normal(x, mean, sd)
    top = dens.max(axis=1, keepdims=True)
    steps = transition[None] * np.maximum(np.exp(dens - top), TINY)[:, None, :]
    start = stationary(transition)
    steps[0] = np.diag(np.exp(dens[0] - top[0]))
    products, logs = _running_products(steps)
    joint = start @ products
    total = joint.sum(axis=1)
    filtered = joint / total[:, None]
    predicted = np.vstack([start, filtered[:-1] @ transition])
    return filtered, predicted, float(logs[-1] + np.log(total[-1]) + top.sum())


def kim_smoother(filtered, predicted, transition):
    """State probabilities given the whole series: the filtered ones times what the later observations say about each state."""
    odds = filtered / np.maximum(predicted, 1e-300)  # in proportion to the densities
    steps = transition[None] * odds[:, None, :]
    later = np.ones((len(filtered), filtered.shape[1]))
    if len(filtered) > 1:
        products, _ = _running_products(steps[:0:-1].transpose(0, 2, 1))  # from the last one backwards
        later[:-1] = products.sum(axis=1)[::-1]
    smoothed = filtered * later
    return smoothed / smoothed.sum(axis=1, keepdims=True)


def fit_switching(x: np.ndarray, states: int = 2, restarts: int = 5, seed: int = 42, iterations: int = 200, only: int | None = None) -> dict:
    """Gaussian regimes with switching mean and variance, by expectation-maximisation from several starts, or from the one
    whose number is ``only``; states are ordered by volatility. Returns means, sds, transition, filtered, smoothed, loglik,
    durations."""
    x = np.asarray(x, dtype=float)
    spread = max(float(x.std()), 1e-12)
    best = None
    for start in range(restarts) if only is None else [only]:
        rng = np.random.default_rng(seed + start)
        if start == 0:
            mean, sd = np.full(states, x.mean()), spread * np.geomspace(0.5, 2.0, states)
        else:
            mean, sd = rng.choice(x, states), spread * rng.uniform(0.3, 2.5, states)
        tr = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(tr, 0.95)
        last = -math.inf
        for _ in range(iterations):
            filtered, predicted, ll = hamilton_filter(x, mean, sd, tr)
            smoothed = kim_smoother(filtered, predicted, tr)
            joint = np.einsum("ti,ij,tj->ij", filtered[:-1], tr, smoothed[1:] / np.maximum(predicted[1:], 1e-300))
            tr = np.maximum(joint, 1e-12) / np.maximum(joint, 1e-12).sum(axis=1, keepdims=True)
            w = np.maximum(smoothed.sum(axis=0), 1e-12)
            mean = smoothed.T @ x / w
            sd = np.sqrt(np.maximum((smoothed * (x[:, None] - mean) ** 2).sum(axis=0) / w, (1e-3 * spread) ** 2))
            if ll - last < 1e-8 * max(1.0, abs(ll)):
                break
            last = ll
        filtered, predicted, ll = hamilton_filter(x, mean, sd, tr)
        if best is None or ll > best[0]:
            best = (ll, mean, sd, tr, filtered, kim_smoother(filtered, predicted, tr))
    ll, mean, sd, tr, filtered, smoothed = best
    o = np.argsort(sd, kind="stable")
    tr = tr[np.ix_(o, o)]
    return {"means": mean[o], "sds": sd[o], "transition": tr, "filtered": filtered[:, o], "smoothed": smoothed[:, o], "loglik": ll, "durations": 1 / np.maximum(1 - np.diag(tr), 1e-12)}
