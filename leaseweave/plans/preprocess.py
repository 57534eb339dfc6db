"""From exports to contracts with features: load, clean, features, history, audits, model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..operators import cleaning, datasets, features, history, quality
from ..sources import raw, sinks


def enrich(contracts: DataFrame, cfg: EngineConfig = DEFAULT, places: dict[str, DataFrame] | None = None) -> DataFrame:
    """Features of clean contracts; `places` (coords, stations, schools) adds locations."""
    df = features.add_basic_features(contracts, cfg)
    if places:
        df = features.add_location_features(df, places["coords"], places["stations"], places["schools"])
    df = quality.add_coverage_gap_flag(history.add_history(df, cfg), max(cfg.rolling_windows), cfg)
    return quality.add_outlier_flags(df, cfg)


def run(spark: SparkSession, folder: str, out: str, cfg: EngineConfig = DEFAULT, places: dict[str, DataFrame] | None = None, recheck: int = 400) -> dict:
    """The whole preparation; tables go to `out`. Fails if a recount of sampled windows disagrees with the features."""
    rows, tables = raw.load_all(spark, folder)
    sinks.write_csv(tables, f"{out}/input_files")
    rows = cleaning.normalize_strings(cleaning.rename_columns(rows))
    sinks.write_parquet(rows, f"{out}/merged_raw")
    rows = spark.read.parquet(f"{out}/merged_raw")
    report = quality.Report(spark)
    report.count(rows, "parse", cleaning.parsing_checks(rows, cfg))
    sinks.write_parquet(cleaning.clean_normalized(rows, cfg), f"{out}/contracts")
    contracts = spark.read.parquet(f"{out}/contracts")
    sinks.write_csv(contracts, f"{out}/cleaned_all", bom=True)
    looked = quality.validate_clean(contracts, cfg)
    sinks.write_parquet(enrich(contracts, cfg, places), f"{out}/all_transactions")
    df = spark.read.parquet(f"{out}/all_transactions")
    report.set("floors", features.floor_report(df).first().asDict())
    report.count(df, "validate", {
        "deposit-only lease with rent": (F.col("anomaly_jeonse_with_rent") == 1, "flagged"), "monthly lease without rent": (F.col("anomaly_monthly_zero_rent") == 1, "flagged"),
        "built after contract": (F.col("built_after_contract") == 1, "flagged"), "duplicate candidates": (F.col("is_duplicate_candidate") == 1, "flagged")})
    wrong = 0
    for keys, days, count, median, least in (
            (cfg.dong_keys, 90, "dong_tx_count_90d", "dong_price_median_90d", cfg.min_count), (cfg.dong_keys, 30, "dong_tx_count_30d", "dong_price_median_30d", cfg.min_count),
            (cfg.comp_keys, 90, "comp_tx_count_90d", "comp_price_median_90d", cfg.min_count), (cfg.property_keys, 365, "property_tx_count_365d", "property_price_median_365d", 1)):
        wrong += quality.recheck_windows(df, keys, days, count, median, least, recheck).first()["n_mismatches"]
    wrong += quality.recheck_previous(df, cfg.property_keys, "property_last_price", "property_days_since_last_transaction", recheck).first()["n_mismatches"]
    if wrong:
        raise AssertionError(f"{wrong} sampled windows disagree with a recount")
    for kind in datasets.KINDS:
        sinks.write_parquet(datasets.model_dataset(df, kind, cfg), f"{out}/model_{kind}")
        sinks.write_csv(spark.read.parquet(f"{out}/model_{kind}"), f"{out}/model_{kind}_csv", bom=True)
    sinks.export_app_data(df, f"{out}/app_data") if places else None
    sinks.write_csv(quality.monthly_summary(df, cfg), f"{out}/monthly_summary", bom=True)
    sinks.write_csv(report.table(), f"{out}/quality_report")
    sinks.write_json(spark, {"validated": looked, "window_mismatches": wrong} | report.summary, f"{out}/summary")
    text = summary_text(spark, tables, rows, df, report, wrong, out)
    sinks.write_text(spark, text, f"{out}/summary_text")
    return {"rows": looked["n"], "mismatches": wrong, "text": text}


def summary_text(spark: SparkSession, tables: DataFrame, raw_rows: DataFrame, df: DataFrame, report: quality.Report, wrong: int, out: str) -> str:
    """The preparation told in text: what was read, removed and flagged, and what came out."""
    read = tables.agg(F.count_distinct("source_file"), F.count("*"), F.count_if(~F.col("ok"))).first()
    span = df.agg(F.count("*"), F.min("contract_date"), F.max("contract_date")).first()
    part = lambda title, found: f"\n{title}\n{sinks.text_report(found)}"
    lines = [
        f"Files {read[0]:,}, tables {read[1]:,} (not readable: {read[2]:,}), rows read {raw_rows.count():,}", f"Contracts {span[0]:,}, {span[1]} to {span[2]}",
        part("Checks", report.table()), part("Contracts by district and category", df.groupBy("gu").pivot("housing_category").count().orderBy("gu")),
        part("By rent type", df.groupBy("rent_type").count().orderBy("rent_type")), part("By kind of contract", df.groupBy("contract_type_clean").count().orderBy("contract_type_clean")),
        part("Sources that may be biased", quality.source_distribution(df).where("suspect_low_jeonse OR suspect_truncated_deposit")),
        part("Share of missing values, percent", quality.missing_rate(raw_rows).orderBy(F.desc("missing_pct"), "column").limit(10)),
    ]
    for kind in datasets.KINDS:
        model = spark.read.parquet(f"{out}/model_{kind}")
        lines.append(part(f"Model table {kind}", model.groupBy("split").agg(F.count("*").alias("rows"), F.min("contract_date").alias("first"), F.max("contract_date").alias("last")).orderBy("split")))
    return "\n".join([*lines, f"\nSampled windows that disagree with a recount: {wrong}", f"Tables are in {out}"])
