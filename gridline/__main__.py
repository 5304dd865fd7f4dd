"""Run one job: ``python -m gridline features --raw DIR --out DIR`` and so on, in the order listed."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .fixed import CHAMP_FEATURE_SET, RACE_FEATURE_SET, RACE_MODEL_FEATURES, RACE_TARGET, SEASON_TARGET
from .plans import features, race_model, reports, season_model
from .sources.landing import QUALIFYING, RACE, refresh, taken_records
from .sources.schemas import OPTIONAL, TABLES
from .sources.sinks import published
from .sources.tables import load_raw, read_features, require_inputs, unreadable_values

JOBS = ["inputs", "landing", "features", "season-model", "race-model", "charts", "tables"]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridline")
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("--raw", help="folder of the raw CSV tables (inputs, features) or of the landed JSON files (landing)")
    parser.add_argument("--schema", help="fields of the landed records, as DDL (landing)")
    parser.add_argument("--endpoint", help="endpoint to take in (landing)")
    parser.add_argument("--kind", choices=[RACE, QUALIFYING], default=RACE, help="kind of sessions (landing)")
    parser.add_argument("--out", required=True, help="folder of feature sets, models and results")
    parser.add_argument("--reports", help="folder of charts and CSV tables (default: OUT/reports)")
    parser.add_argument("--files", type=int, help="number of files per feature set (one more shuffle)")
    args = parser.parse_args(argv)
    if args.job in ("inputs", "features", "landing") and not args.raw:
        parser.error(f"{args.job} needs --raw")
    if args.job == "landing" and not (args.schema and args.endpoint):
        parser.error("landing needs --schema and --endpoint")

    spark = SparkSession.builder.appName(f"gridline-{args.job}").getOrCreate()
    reports_dir = args.reports or f"{args.out}/reports"

    def champ():
        return read_features(spark, f"{args.out}/champ_features.parquet", CHAMP_FEATURE_SET, [SEASON_TARGET])

    if args.job == "inputs":
        require_inputs(spark, args.raw)
        result = {"complete": args.raw, "unreadable": unreadable_values(spark, args.raw)}
    elif args.job == "landing":
        store = f"{args.out}/landing"
        taken = refresh(spark, args.raw, store, args.endpoint, args.schema, args.kind)
        result = {"files": taken, "records": taken_records(spark, store, args.endpoint, args.kind).count()}
    elif args.job == "features":
        require_inputs(spark, args.raw, [f"{t}.csv" for t in TABLES if t not in OPTIONAL])
        result = features.run(load_raw(spark, args.raw), args.out, args.files).first().asDict()
    elif args.job == "season-model":
        result = season_model.run(champ(), args.out)
    elif args.job == "race-model":
        needed = [*RACE_MODEL_FEATURES, RACE_TARGET]
        race = read_features(spark, f"{args.out}/race_features.parquet", RACE_FEATURE_SET, needed)
        result = race_model.run(race, args.out)
    elif args.job == "charts":
        circuits = published(spark, f"{args.out}/circuit_statistics.parquet")
        picks = published(spark, f"{args.out}/championship_predictions.csv", reports.PICKS)
        reports.write_charts(champ(), circuits, reports_dir, picks)
        result = {"written": reports_dir}
    else:
        reports.export_all(spark, args.out, reports_dir)
        result = {"written": reports_dir}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
