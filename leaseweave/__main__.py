"""python -m leaseweave prepare|train|predict: the plans from a shell; spark-submit runs it on a cluster."""

from __future__ import annotations

import argparse
import calendar
import dataclasses
import datetime
import json

from pyspark.sql import SparkSession

from .config import JEONSE, MONTHLY, OFFICETEL, ROOM_TYPES, ROW_HOUSE, EngineConfig
from .operators import serving
from .plans import preprocess, train


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="leaseweave", description=__doc__)
    todo = parser.add_subparsers(dest="todo", required=True)
    one = todo.add_parser("prepare", help="exports to contracts with features, audits and model tables")
    one.add_argument("folder")
    one.add_argument("out")
    one.add_argument("--include-unknown", action="store_true", help="contracts of unknown kind count as new")
    one.add_argument("--all-contracts", action="store_true", help="renewals too")
    one.add_argument("--model-start", help="first day of the model tables")
    one.add_argument("--exclude-gu", nargs="*", default=[])
    one.add_argument("--recheck", type=int, default=400, help="contracts whose windows are counted again")
    two = todo.add_parser("train", help="horizon tables, evaluation and the models that serve")
    two.add_argument("transactions", help="Parquet table of `prepare`")
    two.add_argument("out")
    two.add_argument("--mode", choices=("anchor", "absolute"), default="anchor")
    two.add_argument("--rounds", type=int, default=300, help="trees of a quantile at most; as many are kept as are best on the validation period")
    three = todo.add_parser("predict", help="a fair price near a school")
    for name in ("transactions", "schools", "models", "school"):
        three.add_argument(name)
    three.add_argument("--rent-type", choices=(JEONSE, MONTHLY), default=JEONSE)
    three.add_argument("--room", choices=tuple(ROOM_TYPES), default="전체")
    three.add_argument("--asof", type=datetime.date.fromisoformat, default=None, help="default: the last day with a contract")
    when = three.add_mutually_exclusive_group()
    when.add_argument("--date", type=datetime.date.fromisoformat, help="day of the contract; default: the day of asking")
    when.add_argument("--months", type=int, choices=range(7), help="months from the day of asking to the contract")
    three.add_argument("--housing", choices=("전체", ROW_HOUSE, OFFICETEL), default="전체")
    three.add_argument("--json", action="store_true", help="the answer as JSON")
    three.add_argument("--deposit", type=float)
    three.add_argument("--listing-price", type=float)
    return parser.parse_args(given)


def contract_day(asof: datetime.date, date: datetime.date | None, months: int | None) -> datetime.date:
    """The day given, or so many months after `asof`, on the last day of a month that is too short."""
    if date is not None:
        return date
    year, month = divmod(asof.month - 1 + (months or 0), 12)
    year, month = asof.year + year, month + 1
    return datetime.date(year, month, min(asof.day, calendar.monthrange(year, month)[1]))


def main(given: list[str] | None = None) -> None:
    a = arguments(given)
    spark = SparkSession.builder.appName(f"leaseweave {a.todo}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.todo == "prepare":
        cfg = EngineConfig(include_unknown=a.include_unknown, new_only=not a.all_contracts, model_start=a.model_start, exclude_gu=tuple(a.exclude_gu))
        print(preprocess.run(spark, a.folder, a.out, cfg, recheck=a.recheck)["text"])
    elif a.todo == "train":
        for kind, r in train.run(spark, spark.read.parquet(a.transactions), a.out, mode=a.mode, rounds=a.rounds).items():
            print(kind)
            r["model"]["by_horizon"].show(truncate=False)
    else:
        history = spark.read.parquet(a.transactions)
        asof = a.asof or history.agg({"contract_date": "max"}).first()[0]
        school = serving.find_school(spark.read.parquet(a.schools), a.school)
        loaded = train.load(spark, f"{a.models}/{'jeonse' if a.rent_type == JEONSE else 'monthly'}_model")
        cfg = EngineConfig() if a.housing == "전체" else EngineConfig(housing_categories=(a.housing,))
        found = serving.predict(history, school, a.rent_type, asof, contract_day(asof, a.date, a.months), train.price_rows(loaded), a.room, a.deposit, a.listing_price, cfg)
        print(json.dumps(dataclasses.asdict(found), ensure_ascii=False, indent=2, default=str) if a.json else serving.formatted(found))


if __name__ == "__main__":
    main()
