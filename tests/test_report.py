"""Specifications, settings and payloads."""

import datetime as dt
import json

import numpy as np
import pytest

from marlstone.operators import panel
from marlstone.plans import backtest, report, strategies
from marlstone.sources.spec import PortfolioSpec, Settings, SpecError

SPEC = {"name": "book", "positions": [{"ticker": "A", "weight": 0.5}, {"ticker": "B", "weight": 0.3, "asset_class": "Fixed Income"}, {"ticker": "C", "weight": 0.2}], "cov_method": "ledoit_wolf_cc", "settings": {"regime_search_reps": 1, "cloud_points": 50, "frontier_points": 8, "n_clusters": 2}}


def test_specifications_are_strict(tmp_path):
    spec = PortfolioSpec.from_dict(SPEC)
    assert spec.asset_classes["B"] == "fixed_income" and "A 50%" in spec.describe()
    for change in ({"odd": 1}, {"positions": []}, {"positions": [{"ticker": "A", "weight": 0.4}]}, {"positions": [{"ticker": "A", "weight": 0.5}] * 2}, {"settings": {"odd": 1}}, {"cov_method": "odd"}, {"positions": [{"ticker": "A", "weight": 1, "asset_class": "odd"}]}):
        with pytest.raises(SpecError):
            PortfolioSpec.from_dict({**SPEC, **change})
    path = tmp_path / "p.json"
    with pytest.raises(SpecError):
        PortfolioSpec.load(str(path))
    path.write_text("{")
    with pytest.raises(SpecError):
        PortfolioSpec.load(str(path))
    path.write_text(json.dumps(SPEC))
    assert PortfolioSpec.load(str(path)) == spec
    assert Settings.from_env({"PI_TRADING_DAYS": "365"}).trading_days == 365


def test_encoding():
    assert report.safe({"a": np.float64("nan"), "b": [np.int64(3), float("inf")], "d": dt.date(2024, 1, 2)}) == {"a": None, "b": [3, None], "d": "2024-01-02"}
    assert "<\\/script" in report.standalone({"x": "</script>"})


def test_payload_sections(spark):
    r = np.random.default_rng(1)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(300)]
    rows = [(d, t, float(x)) for d in days for t, x in zip("ABC", r.normal(0, 0.01, 3))]
    series = panel.ReturnSeries(spark.createDataFrame(rows, "date date, ticker string, ret double"), ("A", "B", "C"))
    factors = spark.createDataFrame([(d, float(r.normal(0, 0.01)), float(r.normal(0, 0.01))) for d in days], "date date, `Mkt-RF` double, HML double")
    payload = report.analysis_payload(PortfolioSpec.from_dict(SPEC), series, factors)
    assert {s["id"]: s.get("error") for s in payload["sections"]} == dict.fromkeys([s[0] for s in report.SECTIONS])
    without = report.analysis_payload(PortfolioSpec.from_dict(SPEC), series, only=["factors"])
    assert "no factors" in without["sections"][0]["error"]
    json.loads(report.dumps(payload))
    config = backtest.BacktestConfig(lookback=60)
    out = backtest.run_all(series.data, [strategies.EqualWeight()], config)
    result = backtest.BacktestResult.of(out, "equal_weight", backtest.RunMeta.create(strategies.EqualWeight(), config, "ABC"))
    sheet = report.tearsheet(result)
    assert [bool(s.get("error")) for s in sheet["sections"]] == [False, False, False, True]
