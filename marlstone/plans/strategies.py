"""Strategies: functions of what is known at a date to target weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np

from marlstone.functions.optimizers import LONG_ONLY, Constraints, hrp, min_variance, risk_parity
from marlstone.operators.regimes import RegimeState


class LookAheadError(AssertionError):
    """A context holds, or is asked for, something that isn't known yet. It is never caught."""


@dataclass(frozen=True)
class Context:
    """What a strategy may know at ``as_of``: returns up to it, a covariance of them, the book, and a derived regime."""

    as_of: object
    universe: tuple[str, ...]
    returns: np.ndarray
    dates: tuple
    covariance: np.ndarray
    weights: Mapping[str, float]
    periods_per_year: int = 252
    regime: RegimeState | None = None
    publication_lag_days: int = 0

    def __post_init__(self):
        if not len(self.dates) or self.returns.shape != (len(self.dates), len(self.universe)):
            raise ValueError("a context needs returns of its universe")
        if self.publication_lag_days < 0:
            raise ValueError("a publication lag can't be negative")
        if self.dates[-1] > self.as_of:
            raise LookAheadError(f"returns up to {self.dates[-1]} in a context of {self.as_of}")
        if self.regime is not None and self.regime.fitted_through > self.available_through:
            raise LookAheadError(f"a regime fitted through {self.regime.fitted_through}, known through {self.available_through}")
        if foreign := set(self.weights) - set(self.universe):
            raise ValueError(f"weights outside the universe: {sorted(foreign)}")

    @property
    def available_through(self):
        import datetime as dt

        return self.as_of - dt.timedelta(days=self.publication_lag_days)

    @property
    def staleness_days(self) -> int | None:
        return None if self.regime is None else (self.as_of - self.regime.fitted_through).days

    @property
    def n_obs(self) -> int:
        return len(self.dates)

    def weight(self, ticker: str) -> float:
        return self.weights.get(ticker, 0.0)


class Strategy(Protocol):
    name: str

    def target_weights(self, context: Context) -> Mapping[str, float]: ...


def normalised(raw: Mapping[str, float], universe: Sequence[str], gross: float = 1.0, allow_short: bool = False) -> dict[str, float]:
    """Weights scaled to a gross exposure, without zeros; unknown assets, bad numbers, forbidden shorts and empty books are errors."""
    if unknown := set(raw) - set(universe):
        raise ValueError(f"weights of unknown assets {sorted(unknown)}")
    if bad := [t for t, w in raw.items() if not np.isfinite(w)]:
        raise ValueError(f"weights of {bad} are not finite")
    if not allow_short and (short := [t for t, w in raw.items() if w < 0]):
        raise ValueError(f"short weights of {short} are not allowed")
    total = sum(abs(w) for w in raw.values())
    if total <= 0:
        raise ValueError("an empty book")
    return {t: w * gross / total for t, w in raw.items() if w != 0}


@dataclass(frozen=True)
class EqualWeight:
    name: str = "equal_weight"

    def target_weights(self, context):
        return _equal(context)


@dataclass(frozen=True)
class BuyAndHold:
    weights: Mapping[str, float]
    name: str = "buy_and_hold"

    def target_weights(self, context):
        return dict(context.weights) or dict(self.weights)


@dataclass(frozen=True)
class FixedWeights:
    weights: Mapping[str, float]
    name: str = "fixed_weights"

    def target_weights(self, context):
        return dict(self.weights)


def _solved(result) -> dict[str, float]:
    if not result.success:
        raise RuntimeError(f"{result.method} found no solution: {result.message}")
    return dict(zip(result.tickers, map(float, result.weights)))


@dataclass(frozen=True)
class MinimumVariance:
    constraints: Constraints = LONG_ONLY
    name: str = "min_variance"

    def target_weights(self, context):
        return _solved(min_variance(context.covariance, context.universe, self.constraints))


@dataclass(frozen=True)
class RiskParity:
    constraints: Constraints = LONG_ONLY
    name: str = "risk_parity"

    def target_weights(self, context):
        return _solved(risk_parity(context.covariance, context.universe, self.constraints))


@dataclass(frozen=True)
class HierarchicalRiskParity:
    constraints: Constraints = LONG_ONLY
    method: str = "single"
    name: str = "hrp"

    def target_weights(self, context):
        return _solved(hrp(context.covariance, context.universe, self.constraints, self.method))


@dataclass(frozen=True)
class InverseVolatility:
    name: str = "inverse_vol"

    def target_weights(self, context):
        vol = np.sqrt(np.maximum(np.diag(context.covariance), 1e-18))
        return dict(zip(context.universe, 1 / vol))


def _equal(context) -> dict[str, float]:
    return dict.fromkeys(context.universe, 1 / len(context.universe))


@dataclass(frozen=True)
class Momentum:
    """The ``top`` assets by return over the window without its last ``skip`` rows, in equal parts; all assets as long as
    there are no more rows than that."""

    top: int = 2
    skip: int = 21
    name: str = "momentum"

    def target_weights(self, context):
        if context.n_obs <= self.skip:
            return _equal(context)
        growth = np.prod(1 + context.returns[: context.n_obs - self.skip], axis=0)
        order = np.argsort(-growth, kind="stable")[: self.top]
        return {context.universe[i]: 1 / len(order) for i in order}


@dataclass(frozen=True)
class DeriskOnDrawdown:
    """Equal weights, but all in the ``defensive`` asset while the equal-weight book is more than ``limit`` below its peak in
    the window."""

    defensive: str = "TLT"
    limit: float = 0.10
    name: str = "derisk_dd"

    def target_weights(self, context):
        growth = np.cumprod(1 + context.returns.mean(axis=1))
        deep = growth[-1] / growth.max() - 1 < -self.limit
        return {self.defensive: 1.0} if deep and self.defensive in context.universe else _equal(context)


@dataclass(frozen=True)
class RegimeAware:
    """Equal weights, but all in the ``defensive`` asset while the market is in its stress regime."""

    defensive: str = "TLT"
    name: str = "regime_aware"

    def target_weights(self, context):
        stress = context.regime is not None and context.regime.is_stress
        return {self.defensive: 1.0} if stress and self.defensive in context.universe else _equal(context)
