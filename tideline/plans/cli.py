"""Command line: train, predict, backtest, info."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from ..sources import market
from ..sources.settings import Config
from ..sources.store import Store, plain
from . import ensemble


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tideline", description=__doc__)
    top.add_argument("--bars", help="path of the bars (symbol, ts, open, high, low, close, volume)")
    top.add_argument("--format", default="parquet")
    top.add_argument("--home", help="where models are kept")
    top.add_argument("--config", help="YAML file")
    of = top.add_subparsers(dest="command", required=True)
    train = of.add_parser("train", help="train the ensemble of a symbol")
    train.add_argument("symbol", nargs="?", help="by default the configuration's, one after the other")
    train.add_argument("start", nargs="?")
    train.add_argument("end", nargs="?")
    train.add_argument("--trees", type=int)
    predict = of.add_parser("predict", help="predict as of a date")
    predict.add_argument("symbol")
    predict.add_argument("--date")
    test = of.add_parser("backtest", help="backtest a trained symbol")
    test.add_argument("symbol")
    test.add_argument("--start")
    test.add_argument("--mode", default="standard", choices=["standard", "walk_forward", "crisis", "monte_carlo", "all"])
    of.add_parser("info", help="list trained symbols and models")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tideline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, args.home)
    if args.command == "info":
        print(json.dumps({"symbols": store.trained_symbols(), "models": store.names()}, indent=1))
        return 0
    if not args.bars:
        print("--bars is needed", file=sys.stderr)
        return 2
    config = Config.load(args.config) if args.config else Config()
    named = [args.symbol] if args.symbol else config["data.symbols"]
    symbols = [s.upper() if s.isalpha() else s for s in named]
    symbol = symbols[0]
    try:
        if args.command == "train":
            start, end = args.start or config["data.start_date"], args.end or config["data.end_date"]
            for symbol in symbols:
                bars = market.read_bars(spark, args.bars, format=args.format, symbols=symbol, start=start, end=end)
                out = ensemble.train(bars, symbol, store, config=config, trees=args.trees)
                print(json.dumps(plain({"symbol": symbol, "total_models": out["total_models"], "metrics": {"/".join(k): v for k, v in out["regime_metrics"].items()}}), indent=1))
        elif args.command == "predict":
            bars = market.read_bars(spark, args.bars, format=args.format, symbols=symbol)
            print(json.dumps(plain(ensemble.predict(bars, symbol, store, args.date, config=config)), indent=1))
        else:
            bars = market.read_bars(spark, args.bars, format=args.format, symbols=symbol, start=args.start)
            trained = store.load_ensemble(symbol)
            if not trained:
                print(f"{symbol} isn't trained", file=sys.stderr)
                return 1
            signals = ensemble.sized(ensemble.predictions(bars, trained, config), config=config).select("symbol", "ts", "signal")
            print(ensemble.report(ensemble.backtest(bars, signals, args.mode)))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
