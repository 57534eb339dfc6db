"""The driver's star schema seen as contracts, in DataFrame and SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import area_bin


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def close(x: Column, digits: int = 4) -> Column:
    """Rounded away from ties, so that two engines agree on sums of cents."""
    return F.round(x + 1e-7, digits)


def sql_close(x: str, digits: int = 4) -> str:
    return f"round(({x}) + 1e-7, {digits})"


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contracts: region is the district, nation the neighbourhood, order status the rent type, market segment
    the category, the customer the building, the total price the price. Nation and region are fixed at 25 and 5 rows."""
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    people = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", "r_name")
    area = (F.col("o_orderkey") % 97).cast("double") + 3
    return table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("tx_id"), F.to_date("o_orderdate").alias("contract_date"), F.col("r_name").alias("gu"), F.col("n_name").alias("dong"),
        F.col("o_orderstatus").alias("rent_type"), F.col("c_mktsegment").alias("housing_category"), F.col("o_custkey").cast("string").alias("property_id"),
        F.col("o_totalprice").alias("price_10k"), ((F.col("o_custkey") % 500) * 10).cast("double").alias("deposit_10k"), area.alias("area_m2"), area_bin(area).alias("area_bin"))


AREA_SQL = "CASE WHEN {a} < 0 THEN NULL WHEN {a} < 15 THEN '0-15' WHEN {a} < 20 THEN '15-20' WHEN {a} < 25 THEN '20-25' WHEN {a} < 30 THEN '25-30' WHEN {a} < 40 THEN '30-40' WHEN {a} < 60 THEN '40-60' WHEN {a} < 85 THEN '60-85' WHEN {a} >= 85 THEN '85+' END"
CONTRACTS_SQL = f"""tx AS (SELECT *, {AREA_SQL.format(a='area_m2')} AS area_bin, datediff('day', DATE '1970-01-01', contract_date) AS d FROM (
 SELECT o_orderkey AS tx_id, CAST(o_orderdate AS DATE) AS contract_date, r_name AS gu, n_name AS dong, o_orderstatus AS rent_type, c_mktsegment AS housing_category,
 CAST(o_custkey AS VARCHAR) AS property_id, o_totalprice AS price_10k, CAST((o_custkey % 500) * 10 AS DOUBLE) AS deposit_10k, CAST(o_orderkey % 97 AS DOUBLE) + 3 AS area_m2
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))"""

DONG = ("gu", "dong", "rent_type", "housing_category")
GU = ("gu", "rent_type", "housing_category")
COMP = (*DONG, "area_bin")
PROPERTY = ("property_id", "rent_type")


def sql_over(expr: str, keys, days: int, offset: int = 0) -> str:
    return f"{expr} OVER (PARTITION BY {', '.join(keys)} ORDER BY d RANGE BETWEEN {days + offset} PRECEDING AND {offset + 1} PRECEDING)"


def sql_stat(stat: str, value: str, keys, days: int, offset: int = 0, least: int = 3) -> str:
    """A past-window statistic, NULL below `least` values."""
    n = sql_over(f"count({value})", keys, days, offset)
    if stat == "count":
        return n
    f = {"median": f"quantile_cont({value}, 0.5)", "mean": f"avg({value})", "std": f"stddev_samp({value})"}[stat]
    return f"CASE WHEN {n} >= {least} THEN {sql_over(f, keys, days, offset)} END"


def sql_ratio(a: str, b: str) -> str:
    return f"{a} / CASE WHEN {b} > 0 THEN {b} END - 1"


def history_sql(offset: int, source: str = "tx") -> str:
    """SELECT of every column of `source` with the history features at an offset."""
    c = []
    for w in (30, 90, 180):
        c += [f"{sql_stat('count', 'price_10k', DONG, w, offset)} AS dong_tx_count_{w}d", f"{sql_stat('median', 'price_10k', DONG, w, offset)} AS dong_price_median_{w}d",
              f"{sql_stat('median', 'price_10k', COMP, w, offset)} AS comp_price_median_{w}d"]
    c += [f"{sql_stat('mean', 'price_10k', DONG, 90, offset)} AS dong_price_mean_90d", f"{sql_stat('std', 'price_10k', DONG, 90, offset)} AS dong_price_std_90d",
          f"{sql_stat('count', 'price_10k', COMP, 90, offset)} AS comp_tx_count_90d", f"{sql_stat('count', 'price_10k', GU, 90, offset)} AS gu_tx_count_90d",
          f"{sql_stat('median', 'price_10k', GU, 90, offset)} AS gu_price_median_90d", f"{sql_stat('median', 'price_10k', GU, 90, offset + 90)} AS gu_before", f"{sql_stat('median', 'price_10k', GU, 90, offset + 365)} AS gu_year",
          f"{sql_stat('median', 'deposit_10k', DONG, 90, offset)} AS dong_deposit_median_90d", f"{sql_stat('median', 'deposit_10k', COMP, 90, offset)} AS comp_deposit_median_90d",
          f"{sql_stat('count', 'price_10k', PROPERTY, 365, offset)} AS property_tx_count_365d", f"{sql_stat('median', 'price_10k', PROPERTY, 365, offset, 1)} AS property_price_median_365d",
          f"{sql_stat('median', 'price_10k', DONG, 90, offset + 90)} AS dong_before", f"{sql_stat('median', 'price_10k', COMP, 90, offset + 90)} AS comp_before"]
    last = f"max(CASE WHEN price_10k IS NOT NULL THEN {{'d': d, 't': tx_id, 'v': price_10k}} END) OVER (PARTITION BY {', '.join(PROPERTY)} ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND {offset + 1} PRECEDING)"
    return f"""SELECT *, {sql_ratio('dong_price_median_90d', 'dong_before')} AS dong_price_trend_3m, {sql_ratio('comp_price_median_90d', 'comp_before')} AS comp_price_trend_3m,
 {sql_ratio('gu_price_median_90d', 'gu_before')} AS gu_price_trend_3m, {sql_ratio('gu_price_median_90d', 'gu_year')} AS gu_price_trend_12m,
 last_one.v AS property_last_price, CAST(d - {offset} - last_one.d AS DOUBLE) AS property_days_since_last_transaction,
 CAST(last_one IS NOT NULL AND last_one.v IS NOT NULL AS INT) AS has_property_history, CAST(comp_price_median_90d IS NOT NULL AS INT) AS has_comp_90d_history, CAST(dong_price_median_90d IS NOT NULL AS INT) AS has_dong_90d_history
 FROM (SELECT *, {', '.join(c)}, {last} AS last_one FROM {source})"""


#: History features shown by the composite queries, with prices rounded.
SHOWN = (
    "dong_tx_count_30d", "dong_tx_count_90d", "dong_tx_count_180d", "dong_price_median_30d", "dong_price_median_90d", "dong_price_median_180d", "dong_price_mean_90d",
    "dong_price_std_90d", "gu_tx_count_90d", "gu_price_median_90d", "comp_price_median_30d", "comp_price_median_90d", "comp_price_median_180d", "comp_tx_count_90d",
    "property_last_price", "property_days_since_last_transaction", "property_tx_count_365d", "property_price_median_365d", "dong_price_trend_3m", "comp_price_trend_3m",
    "gu_price_trend_3m", "gu_price_trend_12m", "has_property_history", "has_comp_90d_history", "has_dong_90d_history", "dong_deposit_median_90d", "comp_deposit_median_90d",
)


def shown(columns=SHOWN) -> list[Column]:
    exact = ("count", "has_", "days_since")
    return [F.col(c) if any(x in c for x in exact) else close(F.col(c)).alias(c) for c in columns]


def sql_shown(columns=SHOWN) -> str:
    exact = ("count", "has_", "days_since")
    return ", ".join(c if any(x in c for x in exact) else f"{sql_close(c)} AS {c}" for c in columns)
