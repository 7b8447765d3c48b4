"""Analyse a file or table and write every result table; fit for ``spark-submit``.

    python -m tallyveer sales.csv out/brief --series-keys region --horizon 14
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from tallyveer.config import AnalysisConfig
from tallyveer.plans.brief import analyze, forecast_only, scorecard_only, write_brief
from tallyveer.session import SETTINGS
from tallyveer.sources.raw import load_processed


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    defaults = AnalysisConfig()
    parser = argparse.ArgumentParser(prog="tallyveer", description=__doc__.splitlines()[0])
    parser.add_argument("source", help="delimited text, Parquet, ORC or JSON; a file or a folder")
    parser.add_argument("target", help="folder for the result tables and the processed fact")
    parser.add_argument("--only", choices=("scorecard", "forecast"))
    parser.add_argument("--anchor", type=dt.date.fromisoformat, help="date of the last row of a file without dates")
    parser.add_argument("--order-by", nargs="*", default=[], help="columns that order the rows of a file without dates")
    parser.add_argument("--series-keys", nargs="*", default=[])
    parser.add_argument("--metrics", nargs="*", default=list(defaults.metrics))
    parser.add_argument("--dimensions", nargs="*", default=list(defaults.dimensions))
    parser.add_argument("--as-of", type=dt.date.fromisoformat)
    parser.add_argument("--aov", choices=("ratio", "sum_of_groups"), default=defaults.aov)
    parser.add_argument("--model", choices=("linear_trend", "trend_weekday"), default=defaults.model)
    parser.add_argument("--document-drivers", type=int, help="drivers a document lists; all if not given")
    for name in NUMBERS:
        value = getattr(defaults, name)
        parser.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=value)
    return parser.parse_args(argv)


#: Numeric settings of the analysis that the command line offers.
NUMBERS = (
    "lookback", "min_dates", "contamination", "score_critical", "score_warning", "change_critical", "change_warning",
    "min_share_pct", "min_incident_loss", "min_holiday_delta", "horizon", "trend_rows", "stable_pct", "band_sigma",
    "band_relative",
)


def settings(args: argparse.Namespace) -> AnalysisConfig:
    return AnalysisConfig(
        series_keys=tuple(args.series_keys),
        metrics=tuple(args.metrics),
        dimensions=tuple(args.dimensions),
        as_of=args.as_of,
        aov=args.aov,
        model=args.model,
        document_drivers=args.document_drivers,
        **{name: getattr(args, name) for name in NUMBERS},
    )


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    cfg = settings(args)
    builder = SparkSession.builder.appName("tallyveer")
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    target = args.target.rstrip("/")
    # stored once, analysed from there
    fact = load_processed(spark, args.source, f"{target}/processed", args.anchor, args.order_by)
    if args.only == "scorecard":
        scorecard_only(fact, cfg).write.mode("overwrite").parquet(f"{target}/scorecard")
    elif args.only == "forecast":
        forecast_only(fact, cfg).write.mode("overwrite").parquet(f"{target}/forecast")
    else:
        brief = analyze(fact, cfg)
        write_brief(brief, target)
        brief.discard()


if __name__ == "__main__":
    main()
