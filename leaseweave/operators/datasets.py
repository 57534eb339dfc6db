"""Model-ready tables: filters, splits, and the dataset of several horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, JEONSE, MONTHLY, EngineConfig
from ..functions.scalars import labelled_period, ratio
from .history import history_at_offsets

# The features of each kind and what may never be one.
UNIT_FEATURES = (
    "gu", "dong", "housing_category", "housing_type", "area_bin", "area_m2", "floor", "is_basement", "is_ground_floor", "built_year",
    "building_age", "building_name_is_address", "contract_month", "month_sin", "month_cos", "lat", "lon", "station_dist_m", "n_stations_1km", "univ_dist_m",
)
HISTORY_FEATURES = (
    "dong_tx_count_30d", "dong_tx_count_90d", "dong_tx_count_180d", "dong_price_median_30d", "dong_price_median_90d", "dong_price_median_180d",
    "dong_price_mean_90d", "dong_price_std_90d", "gu_tx_count_90d", "gu_price_median_90d", "comp_price_median_30d", "comp_price_median_90d",
    "comp_price_median_180d", "comp_tx_count_90d", "property_last_price", "property_days_since_last_transaction", "property_tx_count_365d",
    "property_price_median_365d", "dong_price_trend_3m", "comp_price_trend_3m", "gu_price_trend_3m", "gu_price_trend_12m",
    "has_property_history", "has_comp_90d_history", "has_dong_90d_history",
)
MONTHLY_UNIT, MONTHLY_HISTORY = ("deposit_10k", "deposit_per_m2"), ("dong_deposit_median_90d", "comp_deposit_median_90d", "deposit_vs_dong_median")
COMMON_FEATURES = (
    "contract_year", "contract_month", "contract_quarter", "month_sin", "month_cos", "gu", "dong", "property_id", "housing_category", "housing_type",
    "area_m2", "area_pyeong", "area_bin", "floor", "is_basement", "is_ground_floor", "built_year", "building_age", "building_name_is_address",
    "dong_tx_count_30d", "dong_tx_count_90d", "dong_tx_count_180d", "gu_tx_count_90d", "dong_price_median_30d", "dong_price_median_90d", "dong_price_median_180d",
    "dong_price_mean_90d", "dong_price_std_90d", "comp_price_median_30d", "comp_price_median_90d", "comp_price_median_180d", "comp_tx_count_90d",
    "property_last_price", "property_days_since_last_transaction", "property_tx_count_365d", "property_price_median_365d", "dong_price_trend_3m",
    "comp_price_trend_3m", "has_property_history", "has_comp_90d_history", "has_dong_90d_history", "history_window_has_data_gap",
)
ID_COLUMNS = ("tx_id", "contract_date", "contract_year_month", "sido", "full_jibun_address", "full_road_address", "contract_type_clean", "is_partial_year", "split")
FORBIDDEN = {
    "price_10k", "monthly_rent_per_m2_eda_only", "renewal_request_used", "renewal_right_used", "previous_deposit_10k", "previous_monthly_rent_10k",
    "deposit_change_from_previous", "monthly_rent_change_from_previous", "deposit_change_rate_from_previous", "monthly_rent_change_rate_from_previous",
    "deposit_outlier_candidate", "monthly_rent_outlier_candidate", "is_price_outlier_candidate",
}
KINDS = {"jeonse": (JEONSE, "deposit_10k"), "monthly": (MONTHLY, "monthly_rent_10k")}
FORBIDDEN_BY_KIND = {
    "jeonse": FORBIDDEN | {"deposit_10k", "deposit_per_m2", "monthly_rent_10k", "dong_deposit_median_90d", "comp_deposit_median_90d"},
    "monthly": FORBIDDEN | {"monthly_rent_10k"},
}


def model_features(kind: str) -> list[str]:
    more = ("deposit_10k", "deposit_per_m2", "dong_deposit_median_90d", "comp_deposit_median_90d") if kind == "monthly" else ()
    return [*COMMON_FEATURES, *more]


def horizon_features(kind: str) -> list[str]:
    return ["horizon_days", *UNIT_FEATURES, *HISTORY_FEATURES, *((*MONTHLY_UNIT, *MONTHLY_HISTORY) if kind == "monthly" else ())]


def target_filter(kind: str, cfg: EngineConfig = DEFAULT, new_only: bool = True) -> Column:
    """Which contracts are a target of `kind`; NULL anywhere in the rule means no."""
    rent_type, target = KINDS[kind]
    rule = (F.col("rent_type") == rent_type) & F.col("housing_category").isin(*cfg.housing_categories) & (F.col(target) > 0)
    if kind == "monthly":
        rule = rule & (F.col("deposit_10k") >= 0)
    if new_only:
        kinds = ["new", "unknown"] if cfg.include_unknown else ["new"]
        rule = rule & F.col("contract_type_clean").isin(*kinds)
    if cfg.exclude_gu:
        rule = rule & ~F.coalesce(F.col("gu").isin(*cfg.exclude_gu), F.lit(False))
    return F.coalesce(rule, F.lit(False))


def model_dataset(df: DataFrame, kind: str, cfg: EngineConfig = DEFAULT, features: Sequence[str] | None = None, ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Ids, features and target of one kind; raises if a feature would leak the target."""
    features = list(features or model_features(kind))
    target = KINDS[kind][1]
    leaked = set(features) & FORBIDDEN_BY_KIND[kind] | {target} & set(features)
    if leaked:
        raise ValueError(f"{kind}: features that leak the target: {sorted(leaked)}")
    rows = df.where(target_filter(kind, cfg, cfg.new_only))
    if cfg.model_start:
        rows = rows.where(F.col("contract_date") >= F.lit(cfg.model_start).cast("date"))
    rows = rows.withColumn("split", labelled_period(F.col("contract_date"), cfg.splits))
    return rows.select(*ids, *[c for c in features if c not in ids], F.col(target).alias(f"target_{target}"))


def horizon_dataset(df: DataFrame, kind: str, cfg: EngineConfig = DEFAULT, unit: Sequence[str] | None = None, keep: Column | None = None, features: Sequence[str] = HISTORY_FEATURES) -> DataFrame:
    """Target contracts by horizon: features known `horizon` days ahead, with the reporting lag on top.

    Windows run over all contracts, once for all horizons; the targets (`keep`, else the kind's rule) are taken
    afterwards.
    """
    target = KINDS[kind][1]
    unit = list(unit if unit is not None else [*UNIT_FEATURES, *(MONTHLY_UNIT if kind == "monthly" else ())])
    deposits = [c for c in ("dong_deposit_median_90d", "comp_deposit_median_90d") if kind == "monthly"]
    rows = df.withColumn("_keep", target_filter(kind, cfg) if keep is None else keep)
    rows = history_at_offsets(rows, {h: h + cfg.reporting_lag for h in cfg.horizons}, cfg, [*features, *deposits]).where("_keep")
    more = [ratio(F.col("deposit_10k"), F.col("dong_deposit_median_90d")).alias("deposit_vs_dong_median")] if kind == "monthly" else []
    return rows.select(
        "tx_id", "contract_date", "horizon_days", F.date_sub(F.col("contract_date"), F.col("horizon_days")).alias("asof_date"), "property_id", *unit,
        *features, *deposits, *more, F.col(target).alias("target"), labelled_period(F.col("contract_date"), cfg.model_splits).alias("split"))
