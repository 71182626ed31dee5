"""Portfolio specifications, analytic settings and the environment's settings."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

# The asset classes and currencies that a book may hold.
ASSET_CLASSES = ("equity", "fixed_income", "commodity", "cash", "alternative", "crypto")
CURRENCIES = ("USD", "EUR", "GBP", "JPY")


class SpecError(ValueError):
    """A specification that can't be used, and why."""


def _strict(kind, given: Mapping, what: str):
    """``kind`` from a mapping, in which an unknown key is an error."""
    if not isinstance(given, Mapping):
        raise SpecError(f"{what} must be an object")
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(given) - known):
        raise SpecError(f"unknown keys {unknown} in {what}; known are {sorted(known)}")
    try:
        return kind(**given)
    except TypeError as e:
        raise SpecError(f"{what}: {e}") from e


@dataclass(frozen=True)
class Asset:
    ticker: str
    name: str = ""
    asset_class: str = "equity"
    currency: str = "USD"

    def __post_init__(self):
        if not self.ticker:
            raise SpecError("an asset needs a ticker")
        if self.asset_class not in ASSET_CLASSES:
            raise SpecError(f"unknown asset class {self.asset_class!r}; one of {ASSET_CLASSES}")
        if self.currency not in CURRENCIES:
            raise SpecError(f"unknown currency {self.currency!r}; one of {CURRENCIES}")


@dataclass(frozen=True)
class Position:
    """An asset's weight in a book that holds it, between 0 and 1."""

    ticker: str
    weight: float
    name: str = ""
    asset_class: str = "equity"
    currency: str = "USD"

    def __post_init__(self):
        if not 0 <= self.weight <= 1:
            raise SpecError(f"the weight of {self.ticker} is outside [0, 1]")
        self.asset()

    def asset(self) -> Asset:
        return Asset(self.ticker, self.name, str(self.asset_class).strip().lower().replace(" ", "_"), self.currency)


@dataclass(frozen=True)
class Portfolio:
    positions: tuple[Position, ...]
    name: str = ""

    def __post_init__(self):
        if not self.positions:
            raise SpecError("a portfolio needs positions")
        tickers = [p.ticker for p in self.positions]
        if len(set(tickers)) < len(tickers):
            raise SpecError("a ticker stands in two positions")
        if abs(sum(p.weight for p in self.positions) - 1) > 1e-6:
            raise SpecError(f"weights sum to {sum(p.weight for p in self.positions):g}, not 1")

    @property
    def weights(self) -> dict[str, float]:
        return {p.ticker: p.weight for p in self.positions}

    def frame(self, spark: SparkSession):
        return spark.createDataFrame([(p.ticker, float(p.weight), p.asset_class) for p in self.positions], "ticker string, weight double, asset_class string")


@dataclass(frozen=True)
class BuildSettings:
    rolling_window: int = 63
    beta_window: int = 252
    corr_window: int = 63
    n_clusters: int = 3
    pca_method: str = "covariance"
    regime_states: int = 2
    regime_search_reps: int = 20
    var_confidence: float = 0.99
    evt_threshold_quantile: float = 0.95
    frontier_points: int = 50
    cloud_points: int = 1500
    hac_lags: int | None = 5


#: Names of covariance methods in specifications, and ours.
COVARIANCES = {"sample": "sample", "ewma": "ewma", "ledoit_wolf": "ledoit_wolf", "ledoit_wolf_cc": "constant_correlation"}


@dataclass(frozen=True)
class PortfolioSpec:
    positions: tuple
    name: str = "portfolio"
    description: str = ""
    start: str | None = None
    end: str | None = None
    cov_method: str = "sample"
    rates: tuple = ()
    factor_datasets: tuple = ()
    factor_start: str | None = None
    settings: BuildSettings = field(default_factory=BuildSettings)

    @staticmethod
    def from_dict(given: Mapping) -> "PortfolioSpec":
        raw = dict(given) if isinstance(given, Mapping) else given
        if isinstance(raw, dict):
            positions = raw.get("positions") or []
            raw["positions"] = tuple(_strict(Position, p, "a position") for p in positions)
            raw["settings"] = _strict(BuildSettings, raw.get("settings") or {}, "settings")
            for k in ("rates", "factor_datasets"):
                raw[k] = tuple(raw.get(k) or ())
        out = _strict(PortfolioSpec, raw, "the specification")
        out.portfolio()
        if out.cov_method not in COVARIANCES:
            raise SpecError(f"unknown covariance {out.cov_method!r}; one of {sorted(COVARIANCES)}")
        return out

    @staticmethod
    def load(path: str) -> "PortfolioSpec":
        try:
            with open(path, encoding="utf-8") as f:
                return PortfolioSpec.from_dict(json.load(f))
        except FileNotFoundError as e:
            raise SpecError(f"no specification at {path}") from e
        except json.JSONDecodeError as e:
            raise SpecError(f"{path} is not JSON: {e}") from e

    def portfolio(self) -> Portfolio:
        return Portfolio(tuple(self.positions), self.name)

    @property
    def asset_classes(self) -> dict[str, str]:
        return {p.ticker: p.asset().asset_class for p in self.positions}

    def describe(self) -> str:
        book = ", ".join(f"{p.ticker} {p.weight:.0%}" for p in self.positions)
        return f"{self.name}: {book} ({self.start or 'start'} to {self.end or 'today'})"


@dataclass(frozen=True)
class Settings:
    """Defaults that environment variables with the prefix PI_ override."""

    data_dir: str = "data"
    trading_days: int = 252
    risk_free_rate: float = 0.04
    ewma_lambda: float = 0.94
    var_confidence: float = 0.95
    default_start: str = "2015-01-01"

    @staticmethod
    def from_env(env: Mapping[str, str] | None = None) -> "Settings":
        env = os.environ if env is None else env
        lowered = {k.lower(): v for k, v in env.items()}
        return Settings(**{f.name: type(f.default)(lowered[f"pi_{f.name}"]) for f in fields(Settings) if f"pi_{f.name}" in lowered})
