"""Horizon tables, training and evaluation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.scalars import ratio
from ..operators import datasets, model
from ..operators.boosting import QuantileBoosting
from ..sources import sinks


def horizon_tables(spark: SparkSession, transactions: DataFrame, out: str, cfg: EngineConfig = DEFAULT) -> dict[str, DataFrame]:
    """The horizon dataset of each kind, written and read back."""
    for kind in datasets.KINDS:
        sinks.write_parquet(datasets.horizon_dataset(transactions, kind, cfg), f"{out}/horizon_{kind}")
    return {kind: spark.read.parquet(f"{out}/horizon_{kind}") for kind in datasets.KINDS}


def run(spark: SparkSession, transactions: DataFrame, out: str, cfg: EngineConfig = DEFAULT, mode: str = "anchor", **settings) -> dict:
    """Train and evaluate both kinds, then fit the serving model on all rows. `out` gets metrics, importances, test
    predictions, and per kind a model that `load` reads: trees, category levels, fallback and calibration."""
    results = {}
    for kind, df in horizon_tables(spark, transactions, out, cfg).items():
        features = datasets.horizon_features(kind)
        r = results[kind] = model.train_and_evaluate(df, features, cfg, mode, **settings)
        for prefix in ("base", "model"):
            sinks.write_csv(r[prefix]["by_horizon"], f"{out}/{kind}_{prefix}_metrics_by_horizon")
            sinks.write_csv(r[prefix]["by_gu"], f"{out}/{kind}_{prefix}_metrics_by_gu")
        sinks.write_parquet(r["model"]["test"], f"{out}/{kind}_test_predictions")
        sinks.write_csv(r["boosting"].importances(spark), f"{out}/{kind}_feature_importance")
        final, place = model.refit_all(df, features, r["boosting"].best, cfg, mode, **settings), f"{out}/{kind}_model"
        final["boosting"].save(spark, place)
        sinks.write_parquet(final["fallback"], f"{place}/fallback")
        sinks.write_parquet(r["model"]["adjustment"], f"{place}/calibration")
        sinks.write_parquet(model.category_levels(df.where("split IS NOT NULL"), [f for f in model.CATEGORICAL if f in df.columns]), f"{place}/levels")
        facts = {"kind": kind, "features": features, "used": final["features"], "mode": mode, "horizons": cfg.horizons, "reporting_lag": cfg.reporting_lag, "coverage": cfg.target_coverage, "best_rounds": r["boosting"].best}
        sinks.write_json(spark, facts, f"{place}/metadata")
        sinks.write_json(spark, {"kind": kind, "report": sinks.text_report(r["model"]["by_horizon"])}, f"{out}/{kind}_training_report")
        r["cached"].unpersist()
    return results


def load(spark: SparkSession, place: str) -> dict:
    """A model that `run` wrote."""
    facts = json.loads("\n".join(r["value"] for r in spark.read.text(f"{place}/metadata", wholetext=True).collect()))
    return facts | {"boosting": QuantileBoosting.load(spark, place), "fallback": spark.read.parquet(f"{place}/fallback"), "calibration": spark.read.parquet(f"{place}/calibration")}


def priced_rows(loaded: dict):
    """Scenario rows with features, horizon_days and nearest_horizon to the same rows with lo, mid, hi."""
    def priced(rows: DataFrame) -> DataFrame:
        if loaded["kind"] == "monthly" and "deposit_vs_dong_median" not in rows.columns:
            rows = rows.withColumn("deposit_vs_dong_median", ratio(F.col("deposit_10k"), F.col("dong_deposit_median_90d")))
        rows, _ = model.apply_anchor(rows, loaded["features"], loaded["fallback"], loaded["mode"])
        calibration = loaded["calibration"].withColumnRenamed("horizon_days", "nearest_horizon")
        done = model.apply_conformal(model.priced(loaded["boosting"], rows), calibration, "model", "nearest_horizon")
        return done.withColumnsRenamed({"model_lo": "lo", "model_mid": "mid", "model_hi": "hi"})

    return priced


def price_rows(loaded: dict):
    """What `serving.predict` asks for: rows of a scenario with features to rows with lo, mid, hi and weight."""
    return lambda rows, horizon: priced_rows(loaded)(rows).select("lo", "mid", "hi", "weight")
