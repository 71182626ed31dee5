"""Command line: ``python -m marlstone.plans ingest|compare|report|tearsheet --store PATH …``."""

from __future__ import annotations

import argparse

from marlstone.operators import panel
from marlstone.plans import backtest, report, strategies
from marlstone.session import local_session
from marlstone.sources.connectors import Connectors
from marlstone.sources.ingest import ingest_specification
from marlstone.sources.spec import PortfolioSpec
from marlstone.sources.store import Store

KNOWN = {s.name: s for s in (strategies.EqualWeight(), strategies.MinimumVariance(), strategies.RiskParity(), strategies.HierarchicalRiskParity(), strategies.InverseVolatility(), strategies.Momentum(), strategies.DeriskOnDrawdown(), strategies.RegimeAware())}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["ingest", "compare", "report", "tearsheet"])
    parser.add_argument("--store")
    parser.add_argument("--spec", help="a portfolio specification (JSON)")
    parser.add_argument("--tickers", nargs="*")
    parser.add_argument("--strategies", nargs="*", default=["equal_weight", "inverse_vol"], choices=sorted(KNOWN))
    parser.add_argument("--rebalance", default="monthly")
    parser.add_argument("--lookback", type=int, default=252)
    parser.add_argument("--bps", type=float, default=10.0, help="basis points of traded notional, half commission and half slippage")
    parser.add_argument("--only", nargs="*", help="sections of the report")
    parser.add_argument("--save", help="compare: a folder that each run is saved in, under its strategy's name")
    parser.add_argument("--run", help="tearsheet: the folder of a saved run")
    parser.add_argument("--out", help="where the report goes; .html for a page")
    args = parser.parse_args(argv)
    spark = local_session("marlstone")
    if args.command == "tearsheet":
        if not args.run:
            parser.error("a tearsheet needs --run")
        return _write(report.tearsheet(backtest.BacktestResult.load(spark, args.run)), args.out)
    if not args.store or not (args.spec or args.tickers):
        parser.error("give --store, and --spec or --tickers")
    store = Store(spark, args.store)
    spec = PortfolioSpec.load(args.spec) if args.spec else None
    if args.command == "ingest":
        if spec is None:
            parser.error("an ingestion needs --spec")
        results = ingest_specification(spec, store, Connectors(spark, end=spec.end))
        print("\n".join(f"{r.name}: {f'{r.rows} rows' if r.ok else r.error}" for r in results))
        return 0
    tickers = args.tickers or [p.ticker for p in spec.positions]
    returns = store.read_returns(tickers, spec.start if spec else None, spec.end if spec else None)
    if args.command == "compare":
        config = backtest.BacktestConfig(rebalance=args.rebalance, lookback=args.lookback, costs=backtest.CostModel(args.bps / 2, args.bps / 2), periods_per_year=returns.periods_per_year, regime="regime_aware" in args.strategies)
        market = panel.equal_weight_returns(returns.data) if config.regime else None
        rows = backtest.run_all(returns.data, [KNOWN[s] for s in args.strategies], config, market).persist()
        metrics = backtest.run_metrics(rows).orderBy("run_id")
        metrics.show(truncate=False)
        if args.save:
            measured = {r["run_id"]: r.asDict() for r in metrics.collect()}
            for s in args.strategies:
                meta = backtest.RunMeta.create(KNOWN[s], config, tickers)
                own = {k: v for k, v in measured[s].items() if k != "run_id"}
                backtest.BacktestResult.of(rows, s, meta, own).save(f"{args.save}/{s}")
        return 0
    if spec is None:
        parser.error("a report needs --spec")
    factors = store.read_factors() if store.exists("factors") else None
    payload = report.analysis_payload(spec, returns, factors, args.only)
    return _write(payload, args.out)


def _write(payload, out: str | None) -> int:
    text = report.standalone(payload) if (out or "").endswith(".html") else report.dumps(payload, 2)
    if out:
        with open(out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
