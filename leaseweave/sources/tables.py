"""Tables around the contracts: Parquet and CSV reads, geocoding lookups, places."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def dimension_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and, it may be, a byte order mark; the schema gives the names. `idx` rises in the order of the
    file, however many tasks read it: a row is at least a byte, so a part's rows never reach the next part's start."""
    df = spark.read.csv(path, header=True, schema=schema, encoding="UTF-8")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.select("*", (F.col("_metadata.file_block_start") + place).alias("idx"))


def json_meta(spark: SparkSession, path: str) -> dict:
    """A small JSON document from any store that Spark reads."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def unique_addresses(df: DataFrame) -> DataFrame:
    """Per parcel address: its most frequent road address (ties: the smallest) and the location of its first contract."""
    place = F.concat(F.lit("서울특별시 "), F.replace(F.min_by("location_id", "tx_id"), F.lit("|"), F.lit(" ")))
    return df.where(F.col("full_jibun_address").isNotNull()).groupBy(F.col("full_jibun_address").alias("address")).agg(F.mode("full_road_address", True).alias("road_address"), place.alias("location"))


def geocode(addresses: DataFrame, lookup: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """New addresses (not in `cache`) with the coordinates of the most exact key that `lookup` (key, lat, lon) knows."""
    new = addresses if cache is None else addresses.join(cache.select("address"), "address", "left_anti")
    for name, column in (("jibun", "address"), ("road", "road_address"), ("dong", "location")):
        new = new.join(lookup.select(F.col("key").alias(column), F.struct("lat", "lon").alias(f"_{name}")), column, "left")
    best = F.coalesce("_jibun", "_road", "_dong")
    precision = F.when(F.col("_jibun").isNotNull(), "jibun").when(F.col("_road").isNotNull(), "road").when(F.col("_dong").isNotNull(), "dong").otherwise("failed")
    found = new.select("address", best["lat"].alias("lat"), best["lon"].alias("lon"), precision.alias("precision"))
    return found if cache is None else cache.select(*found.columns).unionByName(found)


def best_hit(candidates: DataFrame, key: str, *order) -> DataFrame:
    """The first candidate of each key."""
    return candidates.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")


def grid_centres(spark: SparkSession, south: float, north: float, west: float, east: float, step_m: float = 1500) -> DataFrame:
    """Centres (lat, lon) of a grid over a box, `step_m` apart."""
    up = step_m / 111_320
    along = step_m / (111_320 * math.cos(math.radians((south + north) / 2)))
    rows, columns = math.floor((north - south) / up) + 1, math.floor((east - west) / along) + 1
    return spark.range(rows * columns).select((F.lit(south) + F.floor(F.col("id") / columns) * up).alias("lat"), (F.lit(west) + F.col("id") % columns * along).alias("lon"))


def distinct_places(found: DataFrame, key: str = "place_id", order: str = "seq") -> DataFrame:
    """One row per place, the last one found."""
    return best_hit(found, key, F.desc(order))
