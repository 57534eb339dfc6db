"""Row features of clean contracts, and places near them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.scalars import area_bin, building_age, flag, is_address_name, keyed, months_between_firsts, period_month, price, pyeong, ratio
from .nearest import nearest_places


def add_date_features(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    d, m = F.col("contract_date"), F.month("contract_date")
    return df.withColumns({
        "contract_year": F.year(d), "contract_month": m, "contract_quarter": F.quarter(d), "contract_day_of_month": F.dayofmonth(d),
        "month_sin": F.sin(2 * math.pi * m / 12), "month_cos": F.cos(2 * math.pi * m / 12),
        "contract_year_month": F.date_format(d, "yyyy-MM"), "is_partial_year": flag(F.year(d) == cfg.partial_year),
    })


def add_building_age(df: DataFrame) -> DataFrame:
    built, year = F.col("built_year"), F.col("contract_year")
    return df.withColumns({"built_year_suspicious": flag(built < 1900), "built_after_contract": flag(built > year), "building_age": building_age(year, built)})


def add_floor_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"is_basement": flag(F.col("floor") < 0), "is_ground_floor": flag(F.col("floor") == 1)})


def floor_report(df: DataFrame) -> DataFrame:
    """One row: basement and missing floors, and the highest 0.1 % of floors, which are looked at by hand."""
    return df.agg(F.count_if(F.col("floor") < 0).alias("n_basement"), F.count_if(F.col("floor").isNull()).alias("n_missing"), F.percentile("floor", F.lit(0.999)).alias("p999"), F.max("floor").alias("highest"))


def add_area_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"area_pyeong": pyeong(F.col("area_m2")), "area_bin": area_bin(F.col("area_m2"))})


def add_address_keys(df: DataFrame) -> DataFrame:
    gu, dong, jibun = F.col("gu"), F.col("dong"), F.col("jibun")
    base = F.concat(F.coalesce("sido", F.lit("")), F.lit(" "), F.coalesce(gu, F.lit("")))
    return df.withColumns({
        "location_id": keyed(gu, dong), "parcel_id": keyed(gu, dong, jibun), "property_id": keyed(gu, dong, jibun, F.col("building_name")),
        "full_jibun_address": F.when(jibun.isNotNull(), F.trim(F.concat(base, F.lit(" "), F.coalesce(dong, F.lit("")), F.lit(" "), jibun))),
        "full_road_address": F.when(F.col("road_name").isNotNull(), F.concat(base, F.lit(" "), F.col("road_name"))),
        "building_name_is_address": is_address_name(F.col("building_name")),
    })


def add_contract_period(df: DataFrame) -> DataFrame:
    start, end = period_month(F.col("contract_period"), 1), period_month(F.col("contract_period"), 2)
    return df.withColumns({"lease_start_ym": F.date_format(start, "yyyy-MM"), "lease_end_ym": F.date_format(end, "yyyy-MM"), "lease_duration_months": months_between_firsts(start, end)})


def add_price_columns(df: DataFrame) -> DataFrame:
    """The price by rent type, per-area values, and changes against the previous contract of renewals."""
    renewal = F.col("contract_type_clean") == "renewal"
    out = {"price_10k": price(F.col("rent_type"), F.col("deposit_10k"), F.col("monthly_rent_10k")),
           "deposit_per_m2": F.try_divide("deposit_10k", "area_m2"), "monthly_rent_per_m2_eda_only": F.try_divide("monthly_rent_10k", "area_m2")}
    for name in ("deposit", "monthly_rent"):
        now, before = F.col(f"{name}_10k"), F.col(f"previous_{name}_10k")
        out[f"{name}_change_from_previous"] = F.when(renewal, now - before)
        out[f"{name}_change_rate_from_previous"] = F.when(renewal, ratio(now, before))
    return df.withColumns(out)


def add_basic_features(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    df = add_building_age(add_date_features(df, cfg))
    return add_price_columns(add_contract_period(add_address_keys(add_area_features(add_floor_features(df)))))


#: Metres of a degree, rounded down.
DEGREE_M = 111_000.0


def _cell(lat, lon, row, size: float):
    """Number of the column of `lon` in a row of cells, each of which is at least as wide as high anywhere in the row."""
    edge = F.least(F.lit(89.0), F.greatest(F.abs(row), F.abs(row + 1)) * size)
    return F.floor(lon * F.cos(F.radians(edge)) / (size * 1.01))


def nearest_place(points: DataFrame, places: DataFrame, key: str, name: str, within_m: float | None = None, prefix: str = "") -> DataFrame:
    """Per point `key`: distance to the nearest place (whole metres, half even), its name (the smallest `idx` wins a
    tie), and with `within_m` how many lie within. A point without coordinates has no nearest place.

    `points` has `key`, lat, lon; `places` has idx, `name`, lat, lon, of any number; see `nearest`.
    """
    found = nearest_places(points, places, name, within_m)
    outputs = [F.bround("d", 0).alias(f"{prefix}dist_m"), F.col("name").alias(f"nearest_{prefix.rstrip('_') or 'place'}")]
    found = found.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), *outputs, F.col("n").alias("_n"))
    joined = points.join(found, (points["lat"].cast("double") == F.col("_lat")) & (points["lon"].cast("double") == F.col("_lon")), "left")
    counts = [F.coalesce("_n", F.lit(0).cast("long")).alias(f"n_{prefix}within")] if within_m is not None else []
    return joined.select(points[key], *[found[c] for c in found.columns if c not in ("_lat", "_lon", "_n")], *counts)


def add_location_features(df: DataFrame, coords: DataFrame, stations: DataFrame, schools: DataFrame) -> DataFrame:
    """Coordinates by address, nearest station, stations within 1 km, and nearest school."""
    df = df.join(coords.select(F.col("address").alias("full_jibun_address"), "lat", "lon", "precision"), "full_jibun_address", "left")
    points = df.where(F.col("lat").isNotNull()).select("full_jibun_address", "lat", "lon").dropDuplicates(["full_jibun_address"])
    s = nearest_place(points, stations, "full_jibun_address", "name", 1000, "station_").withColumnRenamed("n_station_within", "n_stations_1km")
    u = nearest_place(points, schools, "full_jibun_address", "name", None, "univ_")
    return df.join(s, "full_jibun_address", "left").join(u, "full_jibun_address", "left")
