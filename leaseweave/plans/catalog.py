"""Queries and their SQL, by name: every operator on the driver's tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import JEONSE, MONTHLY, EngineConfig
from ..functions import scalars as S
from ..functions.geo import haversine
from ..operators import cleaning, datasets, features, history, model, quality, requests, serving
from ..operators.boosting import QuantileBoosting
from ..operators.history import PastWindow, past_windows, previous_event
from ..sources import raw, tables as places
from ..sources.scratch import keep
from .tables import AREA_SQL, COMP, CONTRACTS_SQL, DONG, GU, PROPERTY, SHOWN, close, contracts, history_sql, shown, sql_close, sql_over, sql_ratio, sql_shown, sql_stat, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The period that the driver's orders cover, with splits of it.
CFG = EngineConfig(start_date="1995-01-01", end_date="2001-12-31", partial_year=2001,
                   splits={"train": ("1995-01-01", "1998-12-31"), "validation": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")},
                   model_splits={"train": ("1995-01-01", "1998-12-31"), "valid": ("1999-01-01", "1999-06-30"), "calib": ("1999-07-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- windows

FLAG_KEYS = ("gu", "dong", "rent_type")


def _stats_sql(names: dict[str, str], columns: str = "tx_id, ") -> str:
    return f"WITH {CONTRACTS_SQL} SELECT {columns}" + ", ".join(f"{e} AS {n}" for n, e in names.items()) + " FROM tx"


@query(_stats_sql({"n": sql_stat("count", "price_10k", FLAG_KEYS, 90), **{s: sql_close(sql_stat(s, "price_10k", FLAG_KEYS, 90)) for s in ("median", "mean", "std")}}, "tx_id, contract_date, gu, dong, rent_type, "))
def past_window_count_median_90d(spark, d):
    spec = PastWindow(FLAG_KEYS, "price_10k", 90, {"count": "n", "median": "median", "mean": "mean", "std": "std"})
    df = past_windows(contracts(spark, d), [spec])
    return df.select("tx_id", "contract_date", "gu", "dong", "rent_type", "n", *[close(F.col(c)).alias(c) for c in ("median", "mean", "std")])


@query(_stats_sql({**{f"n{w}": sql_stat("count", "price_10k", FLAG_KEYS, w) for w in (30, 90, 180)}, **{f"m{w}": sql_close(sql_stat("median", "price_10k", FLAG_KEYS, w)) for w in (30, 90, 180)}}))
def past_window_30_90_180(spark, d):
    df = past_windows(contracts(spark, d), [PastWindow(FLAG_KEYS, "price_10k", w, {"count": f"n{w}", "median": f"m{w}"}) for w in (30, 90, 180)])
    return df.select("tx_id", *[f"n{w}" for w in (30, 90, 180)], *[close(F.col(f"m{w}")).alias(f"m{w}") for w in (30, 90, 180)])


@query(_stats_sql({"n": sql_stat("count", "price_10k", GU, 90, 90), "median": sql_close(sql_stat("median", "price_10k", GU, 90, 90))}))
def past_window_offset(spark, d):
    df = history.past_window(contracts(spark, d), GU, "price_10k", 90, offset_days=90)
    return df.select("tx_id", F.col("count").alias("n"), close(F.col("median")).alias("median"))


@query(_stats_sql({"n": sql_stat("count", "price_10k", GU, 90), "median": sql_close(sql_stat("median", "price_10k", GU, 90)), "mean": sql_close(sql_stat("mean", "price_10k", GU, 90))}))
def past_window_sliced(spark, d):
    """The same windows with every group cut into slices of time, for groups that one task can't hold."""
    df = past_windows(contracts(spark, d), [PastWindow(GU, "price_10k", 90, {"count": "n", "median": "median", "mean": "mean"})], slice_days=180)
    return df.select("tx_id", "n", close(F.col("median")).alias("median"), close(F.col("mean")).alias("mean"))


_NULLED = f"WITH {CONTRACTS_SQL.replace('tx AS', 'tx0 AS')}, tx AS (SELECT * REPLACE (CASE WHEN tx_id % 5 = 0 THEN NULL ELSE price_10k END AS price_10k) FROM tx0)"


def _nulled(spark, d):
    return contracts(spark, d).withColumn("price_10k", F.when(F.col("tx_id") % 5 != 0, F.col("price_10k")))


@query(f"{_NULLED} SELECT tx_id, {sql_stat('count', 'price_10k', GU, 90)} AS n_priced, {sql_over('count(*)', GU, 90)} AS n_all, {sql_close(sql_stat('median', 'price_10k', GU, 90))} AS median FROM tx")
def past_window_null_values(spark, d):
    df = past_windows(_nulled(spark, d), [PastWindow(GU, "price_10k", 90, {"count": "n_priced", "median": "median"}), PastWindow(GU, None, 90, {"count": "n_all"})])
    return df.select("tx_id", "n_priced", "n_all", close(F.col("median")).alias("median"))


_LINES_SQL = "li AS (SELECT *, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def _lines(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("contract_date", F.to_date("l_shipdate"))


_LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query(f"WITH {_LINES_SQL} SELECT {', '.join(_LINE_COLUMNS)}, {sql_stat('count', 'l_extendedprice', ('l_suppkey', 'l_returnflag'), 30)} AS n, {sql_close(sql_stat('median', 'l_extendedprice', ('l_suppkey', 'l_returnflag'), 30, 0, 5))} AS median FROM li")
def past_window_min_count(spark, d):
    df = history.past_window(_lines(spark, d), ("l_suppkey", "l_returnflag"), "l_extendedprice", 30, min_count=5)
    return df.select(*_LINE_COLUMNS, F.col("count").alias("n"), close(F.col("median")).alias("median"))


@query(f"WITH {_LINES_SQL}, b AS (SELECT *, {AREA_SQL.format(a='l_quantity')} AS area_bin FROM li) SELECT {', '.join(_LINE_COLUMNS)}, area_bin, {sql_stat('count', 'l_extendedprice', ('s_nationkey', 'area_bin'), 30)} AS n, {sql_close(sql_stat('median', 'l_extendedprice', ('s_nationkey', 'area_bin'), 30))} AS median FROM b")
def comp_window_area_bin(spark, d):
    df = _lines(spark, d).withColumn("area_bin", S.area_bin(F.col("l_quantity")))
    df = history.past_window(df, ("s_nationkey", "area_bin"), "l_extendedprice", 30)
    return df.select(*_LINE_COLUMNS, "area_bin", F.col("count").alias("n"), close(F.col("median")).alias("median"))


@query(f"WITH {CONTRACTS_SQL} SELECT tx_id, {sql_close(sql_ratio('a', 'b'))} AS trend FROM (SELECT tx_id, {sql_stat('median', 'price_10k', GU, 90)} AS a, {sql_stat('median', 'price_10k', GU, 90, 90)} AS b FROM tx)")
def price_trend_3m(spark, d):
    df = past_windows(contracts(spark, d), [PastWindow(GU, "price_10k", 90, {"median": "a"}), PastWindow(GU, "price_10k", 90, {"median": "b"}, offset=90)])
    return df.select("tx_id", close(S.ratio(F.col("a"), F.col("b"))).alias("trend"))


def _asof_sql(offset: int, source: str = f"WITH {CONTRACTS_SQL}") -> str:
    return f"""{source}, days AS (SELECT property_id, d, arg_max(price_10k, tx_id) AS v, max(contract_date) AS at FROM tx WHERE price_10k IS NOT NULL GROUP BY property_id, d),
 q AS (SELECT tx_id, property_id, d - {offset} AS t FROM tx)
 SELECT q.tx_id, days.v AS prev_value, days.at AS prev_date FROM q ASOF LEFT JOIN days ON q.property_id = days.property_id AND q.t > days.d"""


@query(_asof_sql(0))
def previous_event_strict(spark, d):
    return previous_event(contracts(spark, d), ["property_id"], "price_10k").select("tx_id", "prev_value", "prev_date")


@query(_asof_sql(30))
def previous_event_offset(spark, d):
    return previous_event(contracts(spark, d), ["property_id"], "price_10k", 30).select("tx_id", "prev_value", "prev_date")


@query(_asof_sql(0, _NULLED))
def previous_event_skip_null(spark, d):
    return previous_event(_nulled(spark, d), ["property_id"], "price_10k").select("tx_id", "prev_value", "prev_date")


@query(f"WITH {CONTRACTS_SQL}, h AS ({history_sql(0)}) SELECT tx_id, {sql_over('count(*)', GU, 90)} AS gu_all, {sql_shown(('dong_tx_count_90d', 'dong_price_median_90d', 'dong_price_trend_3m', 'comp_price_trend_3m', 'property_last_price', 'property_days_since_last_transaction', 'has_property_history'))} FROM h")
def history_features(spark, d):
    df = history.add_history(contracts(spark, d), CFG)
    return df.select("tx_id", F.col("gu_tx_count_90d").alias("gu_all"), *shown(("dong_tx_count_90d", "dong_price_median_90d", "dong_price_trend_3m", "comp_price_trend_3m", "property_last_price", "property_days_since_last_transaction", "has_property_history")))


@query(f"WITH {CONTRACTS_SQL}, h AS ({history_sql(90)}) SELECT tx_id, {sql_shown()} FROM h")
def history_features_at_offset(spark, d):
    return history.history_at_offset(contracts(spark, d), 90, CFG).select("tx_id", *shown())


_HORIZON_SHOWN = ("dong_tx_count_90d", "dong_price_median_90d", "gu_price_median_90d", "comp_price_median_90d", "property_last_price", "property_days_since_last_transaction", "gu_price_trend_12m")
_SPLIT_SQL = "CASE WHEN {c} BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train' WHEN {c} BETWEEN DATE '1999-01-01' AND DATE '1999-06-30' THEN 'valid' WHEN {c} BETWEEN DATE '1999-07-01' AND DATE '1999-12-31' THEN 'calib' WHEN {c} BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' THEN 'test' END"


def _horizon(spark, d, cfg=CFG, features=_HORIZON_SHOWN):
    df = contracts(spark, d)
    return datasets.horizon_dataset(df, "jeonse", cfg, ("gu", "dong", "housing_category", "area_m2"), (F.col("rent_type") == "F") & (F.col("price_10k") > 0), features)


_HORIZON_SQL = " UNION ALL ".join(
    f"SELECT tx_id, contract_date, {h} AS horizon_days, contract_date - {h} AS asof_date, gu, dong, housing_category, {', '.join(SHOWN)}, deposit_10k AS target, {_SPLIT_SQL.format(c='contract_date')} AS split FROM ({history_sql(h + 30)}) WHERE rent_type = 'F' AND price_10k > 0"
    for h in (0, 30, 60, 90, 120, 150, 180))


@query(f"WITH {CONTRACTS_SQL} SELECT tx_id, horizon_days, CAST(asof_date AS DATE) AS asof_date, target, split, {sql_shown(_HORIZON_SHOWN)} FROM ({_HORIZON_SQL})")
def horizon_dataset(spark, d):
    return _horizon(spark, d).select("tx_id", "horizon_days", "asof_date", "target", "split", *shown(_HORIZON_SHOWN))


_MONTHLY_SQL = " UNION ALL ".join(f"SELECT tx_id, {h} AS horizon_days, price_10k AS target, dong_deposit_median_90d, comp_deposit_median_90d, {sql_ratio('deposit_10k', 'dong_deposit_median_90d')} AS deposit_vs_dong_median, dong_price_median_90d FROM ({history_sql(h + 30)}) WHERE rent_type = 'O' AND price_10k > 0" for h in (0, 90))


@query(f"WITH {CONTRACTS_SQL} SELECT tx_id, horizon_days, target, {', '.join(f'{sql_close(c)} AS {c}' for c in ('dong_deposit_median_90d', 'comp_deposit_median_90d', 'deposit_vs_dong_median', 'dong_price_median_90d'))} FROM ({_MONTHLY_SQL})")
def horizon_dataset_monthly(spark, d):
    cfg = EngineConfig(**{**{f: getattr(CFG, f) for f in CFG.__dataclass_fields__}, "horizons": (0, 90)})
    df = contracts(spark, d).withColumn("monthly_rent_10k", F.col("price_10k"))
    out = datasets.horizon_dataset(df, "monthly", cfg, (), (F.col("rent_type") == "O") & (F.col("price_10k") > 0), ("dong_price_median_90d",))
    return out.select("tx_id", "horizon_days", "target", *[close(F.col(c)).alias(c) for c in ("dong_deposit_median_90d", "comp_deposit_median_90d", "deposit_vs_dong_median", "dong_price_median_90d")])


@query(f"WITH {CONTRACTS_SQL}, h AS ({history_sql(30)}) SELECT -1 - tx_id AS tx_id, {sql_shown(('dong_tx_count_90d', 'dong_price_median_90d', 'gu_price_median_90d', 'property_last_price', 'property_price_median_365d'))} FROM h WHERE tx_id % 10 = 3")
def synthetic_rows_match(spark, d):
    """Copies without a price get the features of their originals."""
    df = contracts(spark, d)
    copies = df.where("tx_id % 10 = 3").withColumns({"tx_id": -1 - F.col("tx_id"), "price_10k": F.lit(None).cast("double"), "deposit_10k": F.lit(None).cast("double")})
    out = history.history_at_offset(df.unionByName(copies), 30, CFG).where("tx_id < 0")
    return out.select("tx_id", *shown(("dong_tx_count_90d", "dong_price_median_90d", "gu_price_median_90d", "property_last_price", "property_price_median_365d")))


def _gappy(spark, d):
    return contracts(spark, d).where(~((F.col("gu") == "ASIA") & (F.year("contract_date") == 1997) & (F.month("contract_date").isin(3, 4))))


@query(f"""WITH {CONTRACTS_SQL}, t AS (SELECT *, year(contract_date) * 12 + month(contract_date) - 1 AS m, year(contract_date - 180) * 12 + month(contract_date - 180) - 1 AS m1, year(contract_date - 1) * 12 + month(contract_date - 1) - 1 AS m2
 FROM tx WHERE NOT (gu = 'ASIA' AND year(contract_date) = 1997 AND month(contract_date) IN (3, 4))),
 g AS (SELECT DISTINCT gu, housing_category FROM t), cal AS (SELECT gu, housing_category, unnest(range(1995 * 12, 2002 * 12)) AS m FROM g),
 gone AS (SELECT c.gu, c.housing_category, c.m FROM cal c ANTI JOIN (SELECT DISTINCT gu, housing_category, m FROM t) p ON c.gu = p.gu AND c.housing_category = p.housing_category AND c.m = p.m)
 SELECT tx_id, CAST(EXISTS (SELECT 1 FROM gone WHERE gone.gu = t.gu AND gone.housing_category = t.housing_category AND gone.m BETWEEN t.m1 AND t.m2) AS INT) AS has_gap FROM t""")
def coverage_gap(spark, d):
    return quality.add_coverage_gap_flag(_gappy(spark, d), 180, CFG).select("tx_id", F.col("history_window_has_data_gap").alias("has_gap"))


@query("""WITH t AS (SELECT p_partkey, p_brand, p_type, ln(1 + p_retailprice * (1 + (p_partkey % 7 = 0)::INT * 50)) AS lv FROM part),
 q AS (SELECT *, quantile_cont(lv, 0.25) OVER (PARTITION BY p_brand) AS c1, quantile_cont(lv, 0.75) OVER (PARTITION BY p_brand) AS c3, quantile_cont(lv, 0.25) OVER (PARTITION BY p_brand, p_type) AS f1,
 quantile_cont(lv, 0.75) OVER (PARTITION BY p_brand, p_type) AS f3, count(lv) OVER (PARTITION BY p_brand, p_type) AS n FROM t)
 SELECT p_partkey, CAST(lv < (CASE WHEN n >= 30 THEN f1 - 3 * (f3 - f1) ELSE c1 - 3 * (c3 - c1) END) OR lv > (CASE WHEN n >= 30 THEN f3 + 3 * (f3 - f1) ELSE c3 + 3 * (c3 - c1) END) AS INT) AS is_outlier FROM q""")
def iqr_outlier_flags(spark, d):
    value = F.col("p_retailprice") * (1 + (F.col("p_partkey") % 7 == 0).cast("int") * 50)
    return quality.with_outlier_flag(table(spark, d, "part"), value, ("p_brand", "p_type"), ("p_brand",), "is_outlier", 3.0, 30).select("p_partkey", "is_outlier")


def _leases(spark, d):
    """Contracts of both rent types: every third one monthly, with a rent; some rents are far out."""
    k = F.col("tx_id")
    rent = F.when(k % 3 == 0, F.col("price_10k") / 100 * (1 + (k % 200 == 0).cast("int") * 400)).otherwise(0.0)
    return contracts(spark, d).withColumns({"rent_type": F.when(k % 3 == 0, "월세").otherwise("전세"), "monthly_rent_10k": rent, "deposit_10k": F.col("price_10k") * (1 + (k % 300 == 1).cast("int") * 900)})


_LEASES_SQL = f"{CONTRACTS_SQL}, ls AS (SELECT * REPLACE (CASE WHEN tx_id % 3 = 0 THEN '월세' ELSE '전세' END AS rent_type, price_10k * (1 + CAST(tx_id % 300 = 1 AS INT) * 900) AS deposit_10k), CASE WHEN tx_id % 3 = 0 THEN price_10k / 100 * (1 + CAST(tx_id % 200 = 0 AS INT) * 400) ELSE 0 END AS monthly_rent_10k FROM tx)"


def _fence_sql(value: str, name: str, keys=("gu", "rent_type", "housing_category")) -> str:
    fine, coarse = ", ".join((*keys, "area_bin")), ", ".join(keys)
    q = ", ".join(f"quantile_cont({value}, {p}) OVER (PARTITION BY {by}) AS {name}_{tag}{n}" for by, tag in ((fine, "f"), (coarse, "c")) for p, n in ((0.25, 1), (0.75, 3)))
    return f"{value} AS {name}, {q}, count({value}) OVER (PARTITION BY {fine}) AS {name}_n"


def _flag_sql(name: str) -> str:
    low, high = (f"CASE WHEN {name}_n >= 30 THEN {name}_f{n} {op} 3 * ({name}_f3 - {name}_f1) ELSE {name}_c{n} {op} 3 * ({name}_c3 - {name}_c1) END" for n, op in ((1, "-"), (3, "+")))
    return f"CAST(coalesce({name} < {low} OR {name} > {high}, false) AS INT)"


@query(f"""WITH {_LEASES_SQL}, v AS (SELECT *, ln(1 + deposit_10k) AS vd, CASE WHEN rent_type = '월세' AND monthly_rent_10k > 0 THEN ln(1 + monthly_rent_10k) END AS vr FROM ls), q AS (SELECT tx_id, rent_type, {_fence_sql('vd', 'dep')}, {_fence_sql('vr', 'rent')} FROM v)
 SELECT tx_id, {_flag_sql('dep')} AS deposit_outlier_candidate, {_flag_sql('rent')} AS monthly_rent_outlier_candidate, CASE WHEN rent_type = '전세' THEN {_flag_sql('dep')} ELSE {_flag_sql('rent')} END AS is_price_outlier_candidate FROM q""")
def outlier_flags_of_leases(spark, d):
    names = ("deposit_outlier_candidate", "monthly_rent_outlier_candidate", "is_price_outlier_candidate")
    return quality.add_outlier_flags(_leases(spark, d), CFG).select("tx_id", *names)


# ---- duplicates, counts, summaries

@query("""WITH u AS (SELECT 0 AS t, event_type, user_id % 20 AS u, event_id FROM events UNION ALL SELECT 1, event_type, user_id % 20, event_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 2, event_type, user_id % 20, event_id FROM events WHERE event_id % 2 = 0),
 c AS (SELECT event_type, u, t, count(*) AS n FROM u GROUP BY ALL) SELECT event_type, u, max(n) AS n_kept FROM c GROUP BY event_type, u""")
def dedup_bag_union_max(spark, d):
    """Rows kept of three overlapping tables: as many as the table with most copies has."""
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 20).alias("u"), "event_id")
    u = e.withColumn("t", F.lit(0)).unionByName(e.where("event_id % 3 = 0").withColumn("t", F.lit(1))).unionByName(e.where("event_id % 2 = 0").withColumn("t", F.lit(2)))
    kept = cleaning.remove_duplicates(u, ["event_type", "u"], "t", ["event_id"], candidates=None)
    return kept.groupBy("event_type", "u").agg(F.count("*").alias("n_kept"))


@query("SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) > 1 AS INT) AS is_candidate FROM events")
def duplicate_candidates(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return cleaning.flag_candidates(e, ["user_id", "event_type", "day"]).select("event_id", F.col("is_duplicate_candidate").alias("is_candidate"))


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS n_copies FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag)")
def within_table_copies(spark, d):
    return cleaning.within_table_copies(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")


@query(f"""WITH {CONTRACTS_SQL}, g AS (SELECT gu, housing_category, count(*) AS n, round_even(avg(CASE WHEN rent_type = 'F' THEN 1.0 ELSE 0.0 END), 4) AS jeonse_share, max(deposit_10k) AS deposit_max, quantile_cont(deposit_10k, 0.99) AS deposit_p99 FROM tx GROUP BY ALL),
 c AS (SELECT housing_category, quantile_cont(deposit_10k, 0.99) AS category_deposit_p99 FROM tx GROUP BY ALL)
 SELECT g.gu, g.housing_category, n, jeonse_share, deposit_max, {sql_close('deposit_p99')} AS deposit_p99, {sql_close('category_deposit_p99')} AS category_deposit_p99, jeonse_share < 0.05 AS suspect_low_jeonse, deposit_max < category_deposit_p99 * 0.25 AS suspect_truncated_deposit FROM g JOIN c USING (housing_category)""")
def source_distribution(spark, d):
    df = quality.source_distribution(contracts(spark, d), CFG, jeonse="F")
    return df.withColumns({c: close(F.col(c)) for c in ("deposit_p99", "category_deposit_p99")})


@query(f"""WITH {CONTRACTS_SQL}, t AS (SELECT *, CASE WHEN tx_id % 3 = 0 THEN NULL ELSE price_10k END AS rent, CASE WHEN tx_id % 4 = 1 THEN 'new' ELSE 'renewal' END AS kind FROM tx)
 SELECT gu, dong, CAST(year(contract_date) AS INT) AS year, CAST(month(contract_date) AS INT) AS month, rent_type, housing_category, count(*) AS transaction_count, quantile_cont(deposit_10k, 0.5) AS median_deposit, quantile_cont(deposit_10k, 0.25) AS q25_deposit, quantile_cont(deposit_10k, 0.75) AS q75_deposit,
 CASE WHEN rent_type <> 'F' THEN {sql_close('quantile_cont(rent, 0.5)')} END AS median_monthly_rent, count(*) FILTER (WHERE kind = 'new') AS new_contract_count, max(CAST(year(contract_date) = 2001 AS INT)) AS is_partial_year FROM t GROUP BY gu, dong, year(contract_date), month(contract_date), rent_type, housing_category""")
def monthly_summary(spark, d):
    df = contracts(spark, d).withColumns({"monthly_rent_10k": F.when(F.col("tx_id") % 3 != 0, F.col("price_10k")), "contract_type_clean": F.when(F.col("tx_id") % 4 == 1, "new").otherwise("renewal")})
    out = quality.monthly_summary(df, CFG, jeonse="F")
    return out.select("gu", "dong", "year", "month", "rent_type", "housing_category", "transaction_count", "median_deposit", "q25_deposit", "q75_deposit", close(F.col("median_monthly_rent")).alias("median_monthly_rent"), "new_contract_count", "is_partial_year")


@query("""WITH t AS (SELECT nullif(o_orderstatus, 'F') AS a, nullif(o_orderpriority, '1-URGENT') AS b, CASE WHEN o_totalprice > 200 THEN o_totalprice END AS c FROM orders)
 SELECT 'a' AS "column", round_even(100.0 * avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0.0 END), 2) AS missing_pct FROM t UNION ALL SELECT 'b', round_even(100.0 * avg(CASE WHEN b IS NULL THEN 1.0 ELSE 0.0 END), 2) FROM t UNION ALL SELECT 'c', round_even(100.0 * avg(CASE WHEN c IS NULL THEN 1.0 ELSE 0.0 END), 2) FROM t""")
def missing_rate(spark, d):
    o = table(spark, d, "orders")
    return quality.missing_rate(o.select(F.nullif("o_orderstatus", F.lit("F")).alias("a"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("b"), F.when(F.col("o_totalprice") > 200, F.col("o_totalprice")).alias("c")))


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, round_even(avg(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1.0 ELSE 0.0 END), 4) AS unknown_rate FROM orders GROUP BY ALL")
def unknown_rate_by_year(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "new").when(F.col("o_orderstatus") == "O", "renewal").otherwise("unknown")
    return quality.unknown_rate_by_year(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("contract_date"), kind.alias("contract_type_clean")))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def value_counts(spark, d):
    return quality.value_counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(f"""WITH {CONTRACTS_SQL}, t AS (SELECT *, CASE WHEN tx_id % 50 = 0 THEN -1 ELSE area_m2 END AS area, CASE WHEN tx_id % 70 = 0 THEN -deposit_10k ELSE deposit_10k END AS dep, row_number() OVER (ORDER BY contract_date, tx_id) - 1 + CASE WHEN tx_id % 90 = 0 THEN 1 ELSE 0 END AS id FROM tx)
 SELECT count(*) AS n, count(DISTINCT id) AS ids, count(*) FILTER (WHERE NOT contract_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') AS dates, count(*) FILTER (WHERE area <= 0) AS areas, count(*) FILTER (WHERE dep < 0) AS money, count(*) FILTER (WHERE gu NOT IN ('ASIA', 'EUROPE')) AS outside, (SELECT count(*) FROM (SELECT contract_date, max(contract_date) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t) WHERE contract_date < before) AS "order" FROM t""")
def validate_counts(spark, d):
    """The counts behind `validate_clean`, of contracts of which some break its rules."""
    k = F.col("tx_id")
    df = cleaning.with_dense_id(contracts(spark, d), ["contract_date", "tx_id"], "id")
    df = df.withColumns({"area_m2": F.when(k % 50 == 0, -1.0).otherwise(F.col("area_m2")), "deposit_10k": F.when(k % 70 == 0, -F.col("deposit_10k")).otherwise(F.col("deposit_10k")), "monthly_rent_10k": F.lit(0.0), "_new": F.col("id") + F.when(k % 90 == 0, 1).otherwise(0)})
    return quality.clean_counts(df.drop("tx_id", "id").withColumnRenamed("_new", "tx_id"), EngineConfig(start_date="1996-01-01", end_date="2000-12-31", valid_gu=("ASIA", "EUROPE")))


@query(f"WITH {CONTRACTS_SQL}, t AS (SELECT tx_id, contract_date, max(contract_date) OVER (ORDER BY tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tx) SELECT count(*) > 0 AS found FROM t WHERE contract_date < before")
def ids_out_of_order(spark, d):
    """Orders are numbered in no order of days, which the audit must see."""
    return quality.clean_counts(contracts(spark, d).withColumn("monthly_rent_10k", F.lit(0.0)), CFG).select((F.col("order") > 0).alias("found"))


@query(f"WITH {CONTRACTS_SQL}, w AS (SELECT tx_id, {sql_stat('count', 'price_10k', DONG, 90)} AS n FROM tx) SELECT CAST(count(*) AS INT) AS n_checked, CAST(count(*) FILTER (WHERE tx_id % 97 = 5 OR tx_id % 89 = 7 AND n >= 3) AS INT) AS n_mismatches FROM w")
def recheck_windows(spark, d):
    """All windows counted again, where some counts and some medians were made wrong."""
    df = past_windows(contracts(spark, d), [PastWindow(DONG, "price_10k", 90, {"count": "n90", "median": "m90"})])
    k = F.col("tx_id")
    df = df.withColumns({"n90": F.col("n90") + F.when(k % 97 == 5, 1).otherwise(0), "m90": F.col("m90") * F.when(k % 89 == 7, 1.01).otherwise(1.0)})
    out = quality.recheck_windows(keep(df)[0], DONG, 90, "n90", "m90", 3, sample=2_000_000_000)
    return out.select(F.col("n_checked").cast("int").alias("n_checked"), F.col("n_mismatches").cast("int").alias("n_mismatches"))


@query(f"WITH {CONTRACTS_SQL}, w AS (SELECT tx_id, count(*) OVER (PARTITION BY {', '.join(PROPERTY)} ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM tx) SELECT CAST(count(*) AS INT) AS n_checked, CAST(count(*) FILTER (WHERE tx_id % 83 = 4 AND n > 0 OR tx_id % 79 = 6) AS INT) AS n_mismatches FROM w")
def recheck_previous(spark, d):
    """All latest earlier contracts sought again, where some prices and some days since were made wrong."""
    df = previous_event(contracts(spark, d), PROPERTY, "price_10k", names=("last", "last_date")).withColumn("days", F.datediff("contract_date", "last_date"))
    k = F.col("tx_id")
    df = df.withColumns({"last": F.col("last") + F.when(k % 83 == 4, 1.0).otherwise(0.0), "days": F.when(k % 79 == 6, F.coalesce("days", F.lit(0)) + 1).otherwise(F.col("days"))})
    out = quality.recheck_previous(df, PROPERTY, "last", "days", sample=2_000_000_000)
    return out.select(F.col("n_checked").cast("int").alias("n_checked"), F.col("n_mismatches").cast("int").alias("n_mismatches"))


@query(f"""WITH {CONTRACTS_SQL}, r AS (SELECT * FROM tx WHERE tx_id = (SELECT max(tx_id) FROM tx)), g AS (SELECT tx.*, r.contract_date AS t FROM tx JOIN r ON tx.gu = r.gu AND tx.rent_type = r.rent_type)
 SELECT t AS contract_date, count(*) FILTER (WHERE contract_date < t AND contract_date >= t - 90) AS n_in_window, {sql_close('quantile_cont(price_10k, 0.5) FILTER (WHERE contract_date < t AND contract_date >= t - 90)')} AS median,
 count(*) FILTER (WHERE contract_date = t) AS same_day_left_out, count(*) FILTER (WHERE contract_date > t) AS future_left_out FROM g GROUP BY t""")
def explain_window(spark, d):
    df = contracts(spark, d)
    last = df.agg(F.max("tx_id")).first()[0]
    out = quality.explain_window(df, last, ("gu", "rent_type"))
    return out.select("contract_date", "n_in_window", close(F.col("median")).alias("median"), "same_day_left_out", "future_left_out")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_custkey, o_orderkey) - 1 AS dense_id FROM orders")
def dense_id(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return cleaning.with_dense_id(o, ["day", "o_custkey", "o_orderkey"], "dense_id").select("o_orderkey", "dense_id")


# ---- parsing and row features

@query("SELECT c_custkey, nullif(nullif(trim(c_t), ''), '-') AS value FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  ' || c_name || ' ' WHEN 1 THEN ' - ' WHEN 2 THEN '   ' ELSE c_mktsegment END AS c_t FROM customer)")
def string_normalize(spark, d):
    k = F.col("c_custkey") % 4
    t = F.when(k == 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).when(k == 1, " - ").when(k == 2, "   ").otherwise(F.col("c_mktsegment"))
    return cleaning.normalize_strings(table(spark, d, "customer").select("c_custkey", t.alias("value")), ["value"])


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN CAST(o_orderkey * 1000 AS DOUBLE) END AS value FROM orders")
def numeric_parse(spark, d):
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, F.col("o_totalprice").cast("string")).when(k == 1, F.regexp_replace(F.format_number(F.col("o_orderkey") * 1000, 0), r"\s", "")).when(k == 2, "1d").otherwise("x-1")
    return cleaning.parse_numeric(table(spark, d, "orders").select("o_orderkey", t.alias("value")), ["value"])


@query("""WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS ym, CASE WHEN o_orderkey % 9 = 0 THEN '31' WHEN o_orderkey % 9 = 1 THEN '7' ELSE strftime(o_orderdate, '%d') END AS dd FROM orders)
 SELECT o_orderkey, CAST(try_strptime(ym || lpad(dd, 2, '0'), '%Y%m%d') AS DATE) AS contract_date FROM t WHERE try_strptime(ym || lpad(dd, 2, '0'), '%Y%m%d') BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def date_parse(spark, d):
    k = F.col("o_orderkey") % 9
    day = F.when(k == 0, "31").when(k == 1, "7").otherwise(F.date_format("o_orderdate", "dd"))
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("contract_ym"), day.alias("contract_day"))
    return cleaning.parse_dates(o, EngineConfig(start_date="1996-01-01", end_date="2000-12-31")).select("o_orderkey", "contract_date")


@query("SELECT n_nationkey, r_name AS sido, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS gu, CASE WHEN n_nationkey % 3 = 2 THEN 'a b' END AS dong FROM (SELECT n_nationkey, replace(n_name, ' ', '_') AS n_name, replace(r_name, ' ', '_') AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey)")
def location_split(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    name, region, k = F.replace("n_name", F.lit(" "), F.lit("_")), F.replace("r_name", F.lit(" "), F.lit("_")), F.col("n_nationkey") % 3
    text = F.when(k == 0, region).when(k == 1, F.concat(region, F.lit("  "), name)).otherwise(F.concat(region, F.lit(" "), name, F.lit(" a b")))
    return cleaning.parse_location(n.select("n_nationkey", text.alias("sigungu"))).select("n_nationkey", "sido", "gu", "dong")


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN 'abc' ELSE strftime(o_orderdate, '%Y%m') || ' ~ ' || strftime(o_orderdate + to_months(CAST(o_orderkey % 30 AS INT)), '%Y%m') END AS p, o_orderdate FROM orders)
 SELECT o_orderkey, CASE WHEN p <> 'abc' THEN substr(p, 1, 4) || '-' || substr(p, 5, 2) END AS lease_start_ym, CASE WHEN p <> 'abc' THEN CAST(o_orderkey % 30 AS DOUBLE) END AS lease_duration_months FROM t""")
def period_parse(spark, d):
    text = F.when(F.col("o_orderkey") % 5 == 4, "abc").otherwise(F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lit(" ~ "), F.date_format(F.add_months("o_orderdate", (F.col("o_orderkey") % 30).cast("int")), "yyyyMM")))
    o = table(spark, d, "orders").select("o_orderkey", text.alias("contract_period"))
    return features.add_contract_period(o).select("o_orderkey", "lease_start_ym", "lease_duration_months")


@query("""SELECT p_partkey, coalesce(p_brand, '') || '|' || coalesce(t, '') AS location_id, coalesce(p_brand, '') || '|' || coalesce(t, '') || '|' || p_size || '|' || coalesce(n, '') AS property_id, CAST(coalesce(regexp_full_match(n, '\\([0-9]+(-[0-9]+)?\\)'), false) AS INT) AS is_address
 FROM (SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS t, CASE p_partkey % 3 WHEN 0 THEN '(' || p_size || '-0)' WHEN 1 THEN p_name END AS n FROM part)""")
def address_keys(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit("-0)"))).when(k % 3 == 1, F.col("p_name"))
    p = table(spark, d, "part").select("p_partkey", F.lit("s").alias("sido"), F.col("p_brand").alias("gu"), F.when(k % 4 > 0, F.col("p_type")).alias("dong"), F.col("p_size").cast("string").alias("jibun"), name.alias("building_name"), F.lit("r").alias("road_name"))
    return features.add_address_keys(p).select("p_partkey", "location_id", "property_id", F.col("building_name_is_address").alias("is_address"))


@query(f"SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS contract_year, CAST(quarter(o_orderdate) AS INT) AS contract_quarter, CAST(day(o_orderdate) AS INT) AS contract_day_of_month, {sql_close('sin(2 * pi() * month(o_orderdate) / 12)')} AS month_sin, strftime(o_orderdate, '%Y-%m') AS contract_year_month, CAST(year(o_orderdate) = 2001 AS INT) AS is_partial_year FROM orders")
def date_features(spark, d):
    o = features.add_date_features(table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("contract_date")), CFG)
    return o.select("o_orderkey", "contract_year", "contract_quarter", "contract_day_of_month", close(F.col("month_sin")).alias("month_sin"), "contract_year_month", "is_partial_year")


@query(f"""WITH t AS (SELECT o_orderkey, o_totalprice AS dep, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice / 10 ELSE 0 END AS rent, CASE o_orderkey % 3 WHEN 0 THEN '전세' WHEN 1 THEN '월세' ELSE 'x' END AS kind, CAST((o_orderkey % 11) * 100 AS DOUBLE) AS before, o_orderkey % 2 = 0 AS renewal, CAST(o_orderkey % 50 AS DOUBLE) AS area FROM orders)
 SELECT o_orderkey, {sql_close("CASE kind WHEN '전세' THEN dep WHEN '월세' THEN rent END")} AS price_10k, {sql_close('CASE WHEN area <> 0 THEN dep / area END')} AS deposit_per_m2, {sql_close('CASE WHEN renewal THEN dep - before END')} AS change, {sql_close('CASE WHEN renewal AND before > 0 THEN dep / before - 1 END')} AS change_rate FROM t""")
def price_columns(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("deposit_10k"), F.when(k % 3 == 1, F.col("o_totalprice") / 10).otherwise(0.0).alias("monthly_rent_10k"), F.when(k % 3 == 0, "전세").when(k % 3 == 1, "월세").otherwise("x").alias("rent_type"),
                                         ((k % 11) * 100).cast("double").alias("previous_deposit_10k"), F.lit(None).cast("double").alias("previous_monthly_rent_10k"), F.when(k % 2 == 0, "renewal").otherwise("new").alias("contract_type_clean"), (k % 50).cast("double").alias("area_m2"))
    return features.add_price_columns(o).select("o_orderkey", close(F.col("price_10k")).alias("price_10k"), close(F.col("deposit_per_m2")).alias("deposit_per_m2"), close(F.col("deposit_change_from_previous")).alias("change"), close(F.col("deposit_change_rate_from_previous")).alias("change_rate"))


@query("SELECT p_partkey, CAST(b < 1900 AS INT) AS suspicious, CAST(b > 2000 AS INT) AS after_contract, CASE WHEN b <= 2000 AND b >= 1900 THEN 2000 - b END AS building_age FROM (SELECT p_partkey, CAST(1890 + p_partkey % 130 AS DOUBLE) AS b FROM part)")
def building_age(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 130 + 1890).cast("double").alias("built_year"), F.lit(2000).alias("contract_year"))
    return features.add_building_age(p).select("p_partkey", F.col("built_year_suspicious").alias("suspicious"), F.col("built_after_contract").alias("after_contract"), "building_age")


@query("SELECT p_partkey, CAST(f < 0 AS INT) AS is_basement, CAST(f = 1 AS INT) AS is_ground_floor FROM (SELECT p_partkey, CAST(p_size - 3 AS DOUBLE) AS f FROM part)")
def floor_flags(spark, d):
    return features.add_floor_features(table(spark, d, "part").select("p_partkey", (F.col("p_size") - 3).cast("double").alias("floor"))).select("p_partkey", "is_basement", "is_ground_floor")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'new' WHEN 'O' THEN 'renewal' ELSE 'unknown' END AS contract_type_clean, CAST(o_orderkey % 2 = 0 AS INT) AS renewal_right_used FROM orders")
def contract_fields(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "신규").when(F.col("o_orderstatus") == "O", "갱신").alias("contract_type"), F.when(F.col("o_orderkey") % 2 == 0, "사용").alias("renewal_request_used"))
    return cleaning.clean_contract_fields(o).select("o_orderkey", "contract_type_clean", "renewal_right_used")


@query("""WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity - 5 AS area, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_extendedprice - 1000 END AS dep, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_tax END AS rent, CASE WHEN l_returnflag = 'R' THEN '월세' ELSE '전세' END AS kind FROM lineitem)
 SELECT kind AS rent_type, count(*) AS n, CAST(sum(CASE WHEN kind = '전세' AND rent > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_rent, CAST(sum(CASE WHEN kind = '전세' AND NOT coalesce(dep > 0, false) THEN 1 ELSE 0 END) AS BIGINT) AS zero_deposit, CAST(sum(CASE WHEN kind = '월세' AND NOT coalesce(rent > 0, false) THEN 1 ELSE 0 END) AS BIGINT) AS zero_rent
 FROM t WHERE area > 0 AND coalesce(dep >= 0, true) GROUP BY kind""")
def validity_rules(spark, d):
    k = F.col("l_partkey")
    li = table(spark, d, "lineitem").select((F.col("l_quantity") - 5).cast("double").alias("area_m2"), F.when(k % 13 != 0, F.col("l_extendedprice") - 1000).alias("deposit_10k"), F.when(k % 3 == 0, 0.0).otherwise(F.col("l_tax")).alias("monthly_rent_10k"), F.when(F.col("l_returnflag") == "R", "월세").otherwise("전세").alias("rent_type"))
    return cleaning.apply_validity(li).groupBy("rent_type").agg(F.count("*").alias("n"), F.sum("anomaly_jeonse_with_rent").alias("with_rent"), F.sum("anomaly_jeonse_zero_deposit").alias("zero_deposit"), F.sum("anomaly_monthly_zero_rent").alias("zero_rent"))


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train' WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'validation' WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' THEN 'test' END AS split FROM orders")
def assign_split(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.labelled_period(F.to_date("o_orderdate"), CFG.splits).alias("split"))


@query(f"""WITH {CONTRACTS_SQL} SELECT tx_id, contract_date, area_m2, deposit_10k AS target_deposit_10k FROM tx WHERE rent_type = 'F' AND housing_category IN ('BUILDING', 'MACHINERY') AND deposit_10k > 0 AND tx_id % 3 = 0 AND gu <> 'ASIA'""")
def model_dataset(spark, d):
    df = contracts(spark, d).withColumns({"rent_type": F.when(F.col("rent_type") == "F", "전세").otherwise("월세"), "contract_type_clean": F.when(F.col("tx_id") % 3 == 0, "new").otherwise("renewal")})
    out = datasets.model_dataset(df, "jeonse", EngineConfig(housing_categories=("BUILDING", "MACHINERY"), exclude_gu=("ASIA",)), ["area_m2"], ["tx_id", "contract_date"])
    return out.select("tx_id", "contract_date", "area_m2", "target_deposit_10k")


@query(f"""WITH {CONTRACTS_SQL} SELECT tx_id, contract_date, area_m2, deposit_10k, price_10k AS target_monthly_rent_10k FROM tx WHERE rent_type = 'O' AND housing_category IN ('BUILDING', 'MACHINERY') AND price_10k > 0 AND deposit_10k >= 0 AND tx_id % 3 <> 1 AND gu <> 'ASIA' AND contract_date >= DATE '1997-01-01'""")
def model_dataset_monthly(spark, d):
    kind = F.when(F.col("tx_id") % 3 == 0, "new").when(F.col("tx_id") % 3 == 1, "renewal").otherwise("unknown")
    df = contracts(spark, d).withColumns({"rent_type": F.when(F.col("rent_type") == "O", "월세").otherwise("전세"), "contract_type_clean": kind, "monthly_rent_10k": F.col("price_10k")})
    cfg = EngineConfig(housing_categories=("BUILDING", "MACHINERY"), exclude_gu=("ASIA",), include_unknown=True, model_start="1997-01-01")
    return datasets.model_dataset(df, "monthly", cfg, ["area_m2", "deposit_10k"], ["tx_id", "contract_date"]).select("tx_id", "contract_date", "area_m2", "deposit_10k", "target_monthly_rent_10k")


@query(f"WITH {CONTRACTS_SQL}, v AS (SELECT 'gu' AS feature, gu AS value FROM tx UNION SELECT 'housing_category', housing_category FROM tx UNION SELECT 'area_bin', coalesce(area_bin, '(none)') FROM tx) SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS level FROM v")
def category_levels(spark, d):
    out = model.category_levels(contracts(spark, d), ("gu", "housing_category", "area_bin"))
    return out.select("feature", "value", F.col("level").cast("long").alias("level"))


@query("SELECT o_orderkey, CASE WHEN n >= 10000 THEN CAST(n // 10000 AS VARCHAR) || '억' || CASE WHEN n % 10000 <> 0 THEN ' ' || format('{:,}', n % 10000) || '만원' ELSE '원' END ELSE format('{:,}', n) || '만원' END AS text FROM (SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS n FROM orders)")
def won_format(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.won(F.col("o_totalprice")).alias("text"))


# ---- joins, places, serving

_POINTS_SQL = "pts AS (SELECT c_custkey AS id, 37.4 + (c_custkey % 317) * 0.0005 AS lat, 126.8 + (c_custkey % 211) * 0.0007 AS lon FROM customer), dim AS (SELECT n_nationkey AS idx, n_name AS name, 37.4 + n_nationkey * 0.006 AS plat, 126.8 + (n_nationkey * 7 % 25) * 0.006 AS plon FROM nation)"
_HAVERSINE_SQL = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin((radians({b}lon) - radians({a}lon)) / 2), 2))))"


def _points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (F.lit(37.4) + (k % 317) * 0.0005).alias("lat"), (F.lit(126.8) + (k % 211) * 0.0007).alias("lon"))


def _dimension(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(n.alias("idx"), F.col("n_name").alias("name"), (F.lit(37.4) + n * 0.006).alias("lat"), (F.lit(126.8) + (n * 7 % 25) * 0.006).alias("lon"))


@query(f"WITH {_POINTS_SQL} SELECT id, round_even(min(dist), 0) AS dist_m, arg_min(name, dist) AS nearest, count(*) FILTER (WHERE dist <= 1000) AS n_within FROM (SELECT id, idx, name, {_HAVERSINE_SQL.format(a='', b='p')} AS dist FROM pts, dim) GROUP BY id")
def nearest_station(spark, d):
    out = features.nearest_place(_points(spark, d), _dimension(spark, d), "id", "name", 1000)
    return out.select("id", "dist_m", F.col("nearest_place").alias("nearest"), "n_within")


@query(f"WITH {_POINTS_SQL} SELECT id, {sql_close(_HAVERSINE_SQL.format(a='', b='q'), 2)} AS dist_m FROM (SELECT *, 37.45 AS qlat, 126.85 AS qlon FROM pts) WHERE {_HAVERSINE_SQL.format(a='', b='q')} <= 5000")
def radius_search(spark, d):
    near = serving.within(_points(spark, d), 37.45, 126.85).where(F.col("dist_m") <= 5000)
    return near.select("id", close(F.col("dist_m"), 2).alias("dist_m"))


_NEAR_SQL = f"{CONTRACTS_SQL}, {_POINTS_SQL}, near AS (SELECT tx.*, CAST(property_id AS BIGINT) % 20 AS floor, {_HAVERSINE_SQL.format(a='', b='q')} AS dist_m FROM (SELECT tx.*, pts.lat, pts.lon, 37.45 AS qlat, 126.85 AS qlon FROM tx JOIN pts ON CAST(tx.property_id AS BIGINT) = pts.id) tx)"


def _near(spark, d):
    p = _points(spark, d).select(F.col("id").cast("string").alias("property_id"), "lat", "lon")
    return serving.within(contracts(spark, d).join(p, "property_id"), 37.45, 126.85).withColumn("floor", F.col("property_id").cast("long") % 20)


@query(f"""WITH {_NEAR_SQL}, c AS (SELECT count(DISTINCT CASE WHEN dist_m <= 1000 THEN property_id END) AS a, count(DISTINCT CASE WHEN dist_m <= 1500 THEN property_id END) AS b, count(DISTINCT CASE WHEN dist_m <= 2000 THEN property_id END) AS c FROM near WHERE contract_date >= DATE '2001-08-01' - 365)
 SELECT CASE WHEN a >= 30 THEN 1000 WHEN b >= 30 THEN 1500 ELSE 2000 END AS radius_m, CASE WHEN a >= 30 THEN a WHEN b >= 30 THEN b ELSE c END AS n_buildings FROM c""")
def adaptive_radius(spark, d):
    return serving.adaptive_radius(_near(spark, d), F.lit("2001-08-01").cast("date"), CFG)


@query(f"""WITH {_NEAR_SQL} SELECT property_id, quantile_cont(area_m2, 0.5) AS area_m2, round_even(quantile_cont(floor, 0.5), 0) AS floor, greatest(1, count(*) FILTER (WHERE contract_date >= DATE '2001-08-01' - 730)) AS weight, arg_max(area_bin, {{'d': d, 't': tx_id}}) AS area_bin
 FROM near WHERE dist_m <= 4000 GROUP BY property_id HAVING max(contract_date) >= DATE '2001-08-01' - 365""")
def candidate_buildings(spark, d):
    out = serving.candidate_buildings(_near(spark, d).where(F.col("dist_m") <= 4000), F.lit("2001-08-01").cast("date"), CFG, latest=("area_bin",))
    return out.select("property_id", "area_m2", "floor", "weight", "area_bin")


@query(f"""WITH {_NEAR_SQL}, c AS (SELECT property_id, quantile_cont(area_m2, 0.5) AS area_m2, round_even(quantile_cont(floor, 0.5), 0) AS floor, arg_max(gu, {{'d': d, 't': tx_id}}) AS gu FROM near WHERE dist_m <= 4000 GROUP BY property_id HAVING max(contract_date) >= DATE '2001-08-01' - 365)
 SELECT property_id, gu, '월세' AS rent_type, DATE '2001-11-15' AS contract_date, CAST(1000 AS DOUBLE) AS deposit_10k, {AREA_SQL.format(a='area_m2')} AS area_bin, CAST(floor < 0 AS INT) AS is_basement, CAST(floor = 1 AS INT) AS is_ground_floor, CAST(2001 - 1990 AS INT) AS building_age, {sql_close('sin(2 * pi() * 11 / 12)')} AS month_sin, {sql_close('1000 / area_m2')} AS deposit_per_m2, true AS negative_id FROM c""")
def scenario_rows(spark, d):
    found = serving.candidate_buildings(_near(spark, d).where(F.col("dist_m") <= 4000), F.lit("2001-08-01").cast("date"), CFG, latest=("gu",))
    out = serving.scenario_rows(found.withColumn("built_year", F.lit(1990)), "월세", datetime.date(2001, 11, 15), 1000.0)
    return out.select("property_id", "gu", "rent_type", "contract_date", "deposit_10k", "area_bin", "is_basement", "is_ground_floor", F.col("building_age").cast("int").alias("building_age"), close(F.col("month_sin")).alias("month_sin"), close(F.col("deposit_per_m2")).alias("deposit_per_m2"), (F.col("tx_id") < 0).alias("negative_id"))


_SCENARIO_SHOWN = ("dong_tx_count_90d", "dong_price_median_90d", "gu_price_median_90d", "comp_price_median_90d", "property_last_price", "property_days_since_last_transaction")


@query(f"""WITH {_NEAR_SQL}, c AS (SELECT property_id, arg_max(gu, {{'d': d, 't': tx_id}}) AS gu, arg_max(dong, {{'d': d, 't': tx_id}}) AS dong, arg_max(housing_category, {{'d': d, 't': tx_id}}) AS housing_category, quantile_cont(area_m2, 0.5) AS area_m2 FROM near WHERE dist_m <= 4000 GROUP BY property_id HAVING max(contract_date) >= DATE '2001-07-01' - 365),
 sc AS (SELECT -1 - row_number() OVER () AS tx_id, DATE '2001-08-01' AS contract_date, gu, dong, 'F' AS rent_type, housing_category, property_id, CAST(NULL AS DOUBLE) AS price_10k, CAST(NULL AS DOUBLE) AS deposit_10k, area_m2, {AREA_SQL.format(a='area_m2')} AS area_bin, datediff('day', DATE '1970-01-01', DATE '2001-08-01') AS d FROM c),
 al AS (SELECT tx_id, contract_date, gu, dong, rent_type, housing_category, property_id, price_10k, deposit_10k, area_m2, area_bin, d FROM tx UNION ALL SELECT * FROM sc), h AS ({history_sql(60, 'al')})
 SELECT property_id, {sql_shown(_SCENARIO_SHOWN)} FROM h WHERE tx_id < 0""")
def scenario_history(spark, d):
    """What a contract of each candidate would be known by, 60 days ahead."""
    past = contracts(spark, d)
    found = serving.candidate_buildings(_near(spark, d).where(F.col("dist_m") <= 4000), F.lit("2001-07-01").cast("date"), CFG, latest=("gu", "dong", "housing_category"))
    rows = serving.scenario_rows(found.withColumn("built_year", F.lit(1990)), "F", datetime.date(2001, 8, 1), None)
    return serving.with_history(past, rows, 60, CFG).select("property_id", *shown(_SCENARIO_SHOWN))


@query(f"""WITH {_NEAR_SQL}, c AS (SELECT property_id FROM near WHERE dist_m <= 4000 GROUP BY property_id HAVING max(contract_date) >= DATE '2001-08-01' - 365)
 SELECT quantile_cont(deposit_10k, 0.5) AS deposit_10k FROM tx WHERE tx_id % 2 = 0 AND contract_date >= DATE '2001-08-01' - 365 AND property_id IN (SELECT property_id FROM c)""")
def usual_deposit(spark, d):
    near = _near(spark, d)
    found = serving.candidate_buildings(near.where(F.col("dist_m") <= 4000), F.lit("2001-08-01").cast("date"), CFG, latest=("gu",))
    monthly = contracts(spark, d).withColumn("rent_type", F.when(F.col("tx_id") % 2 == 0, "월세").otherwise("전세"))
    return serving.usual_deposit(monthly, found, F.lit("2001-08-01").cast("date"))


@query(f"""WITH {_NEAR_SQL}, c AS (SELECT property_id FROM near WHERE dist_m <= 4000 GROUP BY property_id HAVING max(contract_date) >= DATE '2001-08-01' - 365)
 SELECT tx_id, contract_date FROM tx WHERE rent_type = 'F' AND area_m2 >= 25 AND area_m2 < 45 AND property_id IN (SELECT property_id FROM c) ORDER BY contract_date DESC, tx_id DESC LIMIT 5""")
def recent_examples(spark, d):
    found = serving.candidate_buildings(_near(spark, d).where(F.col("dist_m") <= 4000), F.lit("2001-08-01").cast("date"), CFG, latest=("gu",))
    return serving.recent_examples(contracts(spark, d), found, "F", (25, 45)).select("tx_id", "contract_date")


_SCHOOL_SQL = "(SELECT idx, school_name FROM (SELECT n_nationkey AS idx, replace(n_name, '_', ' ') AS school_name FROM nation) WHERE contains(replace(school_name, ' ', ''), '{key}') ORDER BY CASE WHEN starts_with(replace(school_name, ' ', ''), '{key}') THEN 0 ELSE 1 END, idx LIMIT 1)"


@query(" UNION ALL ".join(f"SELECT * FROM {_SCHOOL_SQL.format(key=key)}" for key in ("NATION12", "NATION1", "ON2", "8")))
def find_school(spark, d):
    schools = table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), F.lit("").alias("query"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("school_name"))
    hits = [serving.find_school(schools, name, {"twelve": "NATION12"}) for name in ("twel ve", "NATION 1", "ON2", "8")]
    return spark.createDataFrame([(h["idx"], h["school_name"]) for h in hits], schools.select("idx", "school_name").schema)


_LOCATED_SQL = f"{_POINTS_SQL}, st AS (SELECT id, idx, name, {_HAVERSINE_SQL.format(a='', b='p')} AS dist FROM pts, dim WHERE idx % 2 = 0), un AS (SELECT id, idx, name, {_HAVERSINE_SQL.format(a='', b='p')} AS dist FROM pts, dim WHERE idx % 2 = 1)"


@query(f"""WITH {_LOCATED_SQL}, s AS (SELECT id, round_even(min(dist), 0) AS station_dist_m, arg_min(name, dist) AS nearest_station, count(*) FILTER (WHERE dist <= 1000) AS n_stations_1km FROM st GROUP BY id), u AS (SELECT id, round_even(min(dist), 0) AS univ_dist_m, arg_min(name, dist) AS nearest_univ FROM un GROUP BY id)
 SELECT o_orderkey, CASE WHEN o_custkey % 5 > 0 THEN {sql_close('lat')} END AS lat, CASE WHEN o_custkey % 5 > 0 THEN station_dist_m END AS station_dist_m, CASE WHEN o_custkey % 5 > 0 THEN nearest_station END AS nearest_station, CASE WHEN o_custkey % 5 > 0 THEN n_stations_1km END AS n_stations_1km, CASE WHEN o_custkey % 5 > 0 THEN univ_dist_m END AS univ_dist_m, CASE WHEN o_custkey % 5 > 0 THEN nearest_univ END AS nearest_univ
 FROM orders JOIN pts ON o_custkey = pts.id JOIN s ON o_custkey = s.id JOIN u ON o_custkey = u.id""")
def location_features(spark, d):
    """Coordinates by address, with the nearest station and school; one address in five has no coordinates."""
    coords = _points(spark, d).where("id % 5 > 0").select(F.col("id").cast("string").alias("address"), "lat", "lon", F.lit("jibun").alias("precision"))
    dim = _dimension(spark, d)
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("full_jibun_address"))
    out = features.add_location_features(df, coords, dim.where("idx % 2 = 0"), dim.where("idx % 2 = 1"))
    return out.select("o_orderkey", close(F.col("lat")).alias("lat"), "station_dist_m", "nearest_station", "n_stations_1km", "univ_dist_m", "nearest_univ")


@query("SELECT l_orderkey, l_linenumber, list_sort([l_quantity, l_extendedprice / 1000, l_tax * 500])[1] AS lo, list_sort([l_quantity, l_extendedprice / 1000, l_tax * 500])[2] AS mid, list_sort([l_quantity, l_extendedprice / 1000, l_tax * 500])[3] AS hi FROM lineitem")
def ordered_ranges(spark, d):
    parts = model.ordered_range(F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1000, F.col("l_tax") * 500)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for c, n in zip(parts, ("lo", "mid", "hi"))])


@query("SELECT o_orderkey, CAST(o_orderkey % 211 AS INT) AS days, CAST((SELECT h FROM (SELECT unnest([0, 30, 60, 90, 120, 150, 180]) AS h) ORDER BY abs(h - o_orderkey % 211), h LIMIT 1) AS INT) AS horizon FROM orders")
def nearest_horizon(spark, d):
    days = (F.col("o_orderkey") % 211).cast("int")
    return table(spark, d, "orders").select("o_orderkey", days.alias("days"), serving.nearest_horizon(days).alias("horizon"))


@query("""WITH t AS (SELECT o_orderkey, CAST(o_orderkey % 101 AS DOUBLE) AS p, CAST(o_orderkey % 41 AS DOUBLE) - 20 AS c, CAST(o_orderkey % 60 AS DOUBLE) AS b FROM orders)
 SELECT o_orderkey, CASE WHEN p < 25 THEN '저렴' WHEN p <= 75 THEN '적정' WHEN p <= 90 THEN '다소 비쌈' ELSE '비쌈' END AS verdict, CASE WHEN abs(c) < 2 OR abs(c) < b / 4 THEN 'same' WHEN c > 0 THEN 'later_is_dearer' ELSE 'later_is_cheaper' END AS timing FROM t""")
def price_verdicts(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", serving.verdict_of((k % 101).cast("double")).alias("verdict"), serving.timing_of((k % 41).cast("double") - 20, (k % 60).cast("double")).alias("timing"))


def _cdf_sql() -> str:
    """The same rational fit of the normal distribution function, of z with x = abs(z) / sqrt(2), t = 1 / (1 + x / 2)."""
    poly = "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({poly} * t + {c})"
    tail = f"(t * exp(-x * x + {poly}) / 2)"
    return f"CASE WHEN z >= 0 THEN 1 - {tail} ELSE {tail} END"


@query(f"""WITH r AS (SELECT p_brand, p_retailprice AS mid, p_retailprice * (0.5 + p_size / 200) AS lo, p_retailprice * (1 + p_size / 50) AS hi, CAST(p_partkey % 7 + 1 AS DOUBLE) AS weight FROM part), w AS (SELECT *, CASE WHEN 950 < mid THEN ln(mid / lo) ELSE ln(hi / mid) END / 1.2815515655446004 AS width FROM r),
 zs AS (SELECT *, ln(950 / mid) / nullif(width, 0) AS z FROM w), s AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS t FROM zs)
 SELECT p_brand, {sql_close(f"sum(weight * CASE WHEN width > 0 THEN {_cdf_sql()} ELSE CAST(950 >= mid AS DOUBLE) END) / sum(weight)")} AS share FROM s GROUP BY p_brand""")
def mixture_share(spark, d):
    """Share of a weighted mixture of price ranges below 950, per brand."""
    price, size = F.col("p_retailprice"), F.col("p_size")
    r = table(spark, d, "part").select("p_brand", price.alias("mid"), (price * (0.5 + size / 200)).alias("lo"), (price * (1 + size / 50)).alias("hi"), (F.col("p_partkey") % 7 + 1).cast("double").alias("weight"))
    return r.groupBy("p_brand").agg(close(serving.mixture_share(F.lit(950.0))).alias("share"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400)")
def semi_candidates(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 400"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey AS address, CAST(c_custkey % 3 AS DOUBLE) AS lat, CASE c_custkey % 3 WHEN 0 THEN 'jibun' WHEN 1 THEN 'road' ELSE 'dong' END AS precision FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 10 <> 9 UNION ALL SELECT c_custkey, NULL, 'failed' FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 10 = 9")
def anti_cache(spark, d):
    """Addresses not in the cache, with coordinates of the most exact key that is known."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    addresses = c.select(F.col("k").alias("address"), (F.col("k") + 10_000_000).alias("road_address"), (F.col("k") + 20_000_000).alias("location"))
    known = c.where("k % 10 <> 9")
    part = lambda r, add: known.where(f"k % 3 = {r}").select((F.col("k") + add).alias("key"), F.lit(float(r)).alias("lat"), F.lit(0.0).alias("lon"))
    lookup = part(0, 0).union(part(1, 10_000_000)).union(part(2, 20_000_000))
    cache = c.where("k % 7 = 0").select(F.col("k").alias("address"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit("old").alias("precision"))
    return places.geocode(addresses, lookup, cache).where("precision <> 'old'").select("address", "lat", "precision")


@query("""WITH c AS (SELECT p_brand AS address, p_type AS v, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY n DESC, v) AS rk FROM c)
 SELECT r.address, r.v AS road_address, '서울특별시 ' || replace(f.loc, '|', ' ') AS location FROM r JOIN (SELECT p_brand AS address, arg_min(p_type || '|' || p_size, p_partkey) AS loc FROM part GROUP BY ALL) f USING (address) WHERE rk = 1""")
def address_mode(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("full_jibun_address"), F.col("p_type").alias("full_road_address"), F.concat("p_type", F.lit("|"), F.col("p_size").cast("string")).alias("location_id"), F.col("p_partkey").alias("tx_id"))
    return places.unique_addresses(p)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk = 1")
def best_hit(spark, d):
    return places.best_hit(table(spark, d, "orders"), "o_custkey", F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id AS place_id, max(event_id) AS seq FROM events GROUP BY ALL")
def distinct_places(spark, d):
    return places.distinct_places(table(spark, d, "events").select(F.col("user_id").alias("place_id"), F.col("event_id").alias("seq"))).select("place_id", "seq")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders ORDER BY day DESC, o_orderkey DESC LIMIT 5")
def topk_recent(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice").orderBy(F.desc("day"), F.desc("o_orderkey")).limit(5)


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders) SELECT CAST(least(39, floor((o_totalprice - lo) / ((hi - lo) / 40))) AS INT) AS bin, count(*) AS n FROM orders, e WHERE o_totalprice BETWEEN lo AND hi GROUP BY ALL""")
def histogram_samples(spark, d):
    return serving.histogram(table(spark, d, "orders"), "o_totalprice")


@query("SELECT 'orders' AS source, o_orderkey AS id, o_totalprice AS amount FROM orders UNION ALL SELECT 'lineitem', l_orderkey, l_extendedprice FROM lineitem")
def union_all_tables(spark, d):
    o = table(spark, d, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    return o.unionByName(table(spark, d, "lineitem").select(F.lit("lineitem").alias("source"), F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount")))


_EXPORT_SQL = "repeat('시군구 : 서울' || chr(10), CAST(doc_id % 4 AS INT)) || CASE WHEN doc_id % 5 > 0 THEN '\"NO\",\"시군구\",x' || chr(10) ELSE '' END || replace(text, 'NO', 'no')"


def _exports(spark, d):
    k = F.col("doc_id")
    text = F.concat(F.repeat(F.lit("시군구 : 서울\n"), (k % 4).cast("int")), F.when(k % 5 > 0, '"NO","시군구",x\n').otherwise(""), F.replace("text", F.lit("NO"), F.lit("no")))
    return table(spark, d, "documents").select("doc_id", F.split(text, "\n").alias("lines"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id % 4 AS INT) END AS header_at FROM documents")
def header_discovery(spark, d):
    lines = _exports(spark, d).select("doc_id", F.posexplode("lines").alias("line_no", "line"))
    return raw.header_line(lines, "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN '서울' END AS district FROM documents")
def preamble_conditions(spark, d):
    """Conditions above the header, as a map."""
    k = F.col("doc_id")
    lines = F.slice("lines", F.lit(1), (k % 4).cast("int"))
    return _exports(spark, d).select("doc_id", raw.condition_map(lines)[F.lit("시군구")].alias("district"))


# ---- ranges and metrics

_BASE_SQL = f"WITH {CONTRACTS_SQL}, hz AS ({_HORIZON_SQL}), fb AS (SELECT gu, housing_category, quantile_cont(target, 0.5) AS fallback FROM hz WHERE split = 'train' AND target > 0 GROUP BY ALL), bp AS (SELECT hz.*, greatest(1.0, coalesce(comp_price_median_90d, dong_price_median_90d, gu_price_median_90d, fallback)) AS base_point, fallback FROM hz LEFT JOIN fb USING (gu, housing_category) WHERE target > 0)"
_RANGE_SQL = f"{_BASE_SQL}, q AS (SELECT horizon_days, quantile_cont(ln(target) - ln(base_point), 0.1) AS ql, quantile_cont(ln(target) - ln(base_point), 0.5) AS qm, quantile_cont(ln(target) - ln(base_point), 0.9) AS qh FROM bp WHERE split = 'train' GROUP BY ALL), rg AS (SELECT bp.*, base_point * exp(ql) AS base_lo, base_point * exp(qm) AS base_mid, base_point * exp(qh) AS base_hi FROM bp JOIN q USING (horizon_days))"
_CONF_SQL = f"{_RANGE_SQL}, e AS (SELECT horizon_days, greatest(ln(base_lo) - ln(target), ln(target) - ln(base_hi)) AS e FROM rg WHERE split = 'calib'), cf AS (SELECT horizon_days, count(*) AS n, list_sort(list(e)) AS s FROM e GROUP BY ALL), cp AS (SELECT horizon_days, n, s, least(1.0, 0.8 * (n + 1) / n) * (n - 1) AS place FROM cf), adj AS (SELECT horizon_days, n, s[CAST(floor(place) AS INT) + 1] + (s[CAST(least(floor(place) + 1, n - 1) AS INT) + 1] - s[CAST(floor(place) AS INT) + 1]) * (place - floor(place)) AS adjustment FROM cp)"


def _base(spark, d, features=("comp_price_median_90d", "dong_price_median_90d", "gu_price_median_90d", "property_last_price")):
    """The horizon table that several passes read; written, as the training plan writes it."""
    return keep(_horizon(spark, d, CFG, features).where("target > 0"))[0]


@query(f"{_BASE_SQL} SELECT tx_id, horizon_days, {sql_close('base_point')} AS base_point FROM bp")
def baseline_point(spark, d):
    df = _base(spark, d)
    return model.baseline_point(df, model.fallback_table(df, F.col("split") == "train")).select("tx_id", "horizon_days", close(F.col("base_point")).alias("base_point"))


@query(f"{_RANGE_SQL} SELECT horizon_days, {sql_close('min(ql)')} AS q_lo, {sql_close('min(qm)')} AS q_mid, {sql_close('min(qh)')} AS q_hi FROM q GROUP BY horizon_days")
def baseline_quantiles(spark, d):
    df = _base(spark, d)
    train = F.col("split") == "train"
    q = model.baseline_quantiles(model.baseline_point(df, model.fallback_table(df, train)), train, CFG)
    return q.select("horizon_days", *[close(F.col(c)).alias(c) for c in ("q_lo", "q_mid", "q_hi")])


@query(f"{_BASE_SQL}, an AS (SELECT *, greatest(1.0, coalesce(gu_price_median_90d, dong_price_median_90d, fallback)) AS anchor FROM bp) SELECT tx_id, horizon_days, {sql_close('ln(anchor)')} AS log_anchor, {sql_close('dong_price_median_90d / anchor')} AS rel_dong_price_median_90d, {sql_close('property_last_price / anchor')} AS rel_property_last_price FROM an")
def anchor_relative(spark, d):
    df = _base(spark, d)
    out, _ = model.apply_anchor(df, ("dong_price_median_90d", "property_last_price", "gu_price_median_90d"), model.fallback_table(df, F.col("split") == "train"))
    return out.select("tx_id", "horizon_days", *[close(F.col(c)).alias(c) for c in ("log_anchor", "rel_dong_price_median_90d", "rel_property_last_price")])


@query(f"{_CONF_SQL} SELECT horizon_days, n, {sql_close('adjustment')} AS adjustment FROM adj")
def conformal_adjustment(spark, d):
    r = model.run_baseline(_base(spark, d), cfg=CFG)
    out = model.conformal_adjustment(r.where("split = 'calib'"), "base", CFG)
    return out.select("horizon_days", F.col("n").cast("long").alias("n"), close(F.col("adjustment")).alias("adjustment"))


@query(f"{_CONF_SQL} SELECT rg.tx_id, rg.horizon_days, {sql_close('base_lo * exp(-adjustment)', 3)} AS base_lo, {sql_close('base_mid', 3)} AS base_mid, {sql_close('base_hi * exp(adjustment)', 3)} AS base_hi FROM rg JOIN adj USING (horizon_days) WHERE split = 'test'")
def calibrated_ranges(spark, d):
    r = model.run_baseline(_base(spark, d), cfg=CFG)
    out = model.apply_conformal(r.where("split = 'test'"), model.conformal_adjustment(r.where("split = 'calib'"), "base", CFG), "base")
    return out.select("tx_id", "horizon_days", *[close(F.col(c), 3).alias(c) for c in ("base_lo", "base_mid", "base_hi")])


_METRIC_SQL = {
    "n": "count(*)", "mape_pct": "100 * avg(abs(base_mid - target) / target)", "mdape_pct": "100 * quantile_cont(abs(base_mid - target) / target, 0.5)", "mae": "avg(abs(base_mid - target))",
    "coverage_80": "avg(CASE WHEN target >= base_lo AND target <= base_hi THEN 1.0 ELSE 0.0 END)", "rel_width_median": "quantile_cont((base_hi - base_lo) / base_mid, 0.5)",
    "pinball_avg": "(avg(greatest(0.1 * (target - base_lo), (0.1 - 1) * (target - base_lo))) + avg(greatest(0.5 * (target - base_mid), (0.5 - 1) * (target - base_mid))) + avg(greatest(0.9 * (target - base_hi), (0.9 - 1) * (target - base_hi)))) / 3",
}
_METRICS = ", ".join(f"{e if n == 'n' else sql_close(e, 3)} AS {n}" for n, e in _METRIC_SQL.items())


def _rounded(df, by):
    return df.select(*by, "n", *[close(F.col(c), 3).alias(c) for c in _METRIC_SQL if c != "n"])


@query(f"{_RANGE_SQL} SELECT gu, housing_category, {_METRICS} FROM rg WHERE split = 'test' GROUP BY gu, housing_category")
def interval_metrics(spark, d):
    r = model.run_baseline(_base(spark, d), cfg=CFG)
    return _rounded(model.metrics(r.where("split = 'test'"), "base", model.FALLBACK_KEYS), model.FALLBACK_KEYS)


@query(f"{_RANGE_SQL} SELECT horizon_days, {_METRICS} FROM rg WHERE split = 'test' GROUP BY GROUPING SETS ((), (horizon_days))")
def metrics_rollup(spark, d):
    r = model.run_baseline(_base(spark, d), cfg=CFG)
    return _rounded(model.metrics_rollup(r.where("split = 'test'"), "base"), ["horizon_days"])


@query(f"{_RANGE_SQL} SELECT gu, count(*) FILTER (WHERE horizon_days = 0) AS h0, count(*) FILTER (WHERE horizon_days = 90) AS h90, count(*) FILTER (WHERE horizon_days = 180) AS h180 FROM rg WHERE split = 'test' AND target BETWEEN base_lo AND base_hi GROUP BY gu")
def metrics_pivot(spark, d):
    r = model.run_baseline(_base(spark, d), cfg=CFG).where("split = 'test' AND target BETWEEN base_lo AND base_hi AND horizon_days IN (0, 90, 180)")
    return r.groupBy("gu").pivot("horizon_days", [0, 90, 180]).count().select("gu", *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h}") for h in (0, 90, 180)])


@query()
def quantile_forest(spark, d):
    """Ranges of a quantile forest on the nearest horizon: trained on the first years, shown for the last."""
    cfg = EngineConfig(**{**{f: getattr(CFG, f) for f in CFG.__dataclass_fields__}, "horizons": (0,)})
    df = _horizon(spark, d, cfg).where("target > 0 AND split IN ('train', 'test')").withColumn("_y", F.log("target"))
    fitted = model.QuantileForest(["gu", "housing_category", "area_m2", "dong_price_median_90d", "property_last_price"], trees=8, depth=5).fit(df.where("split = 'train'"))
    return fitted.predict(df.where("split = 'test'")).select("tx_id", "target", *[F.exp(f"q_{n}").alias(n) for n in ("lo", "mid", "hi")])


@query()
def quantile_boosting(spark, d):
    """Ranges of boosted quantiles at all horizons: grown on the first years as long as the next half year gains by it, shown
    for the last."""
    df = keep(_horizon(spark, d).where("target > 0 AND split IN ('train', 'valid', 'test')").withColumn("_y", F.log("target")))[0]
    used = ["horizon_days", "gu", "housing_category", "area_m2", "dong_price_median_90d", "property_last_price"]
    fitted = QuantileBoosting(used).fit(df.where("split = 'train'"), df.where("split = 'valid'"))
    return fitted.predict(df.where("split = 'test'")).select("tx_id", "horizon_days", "target", *[F.exp(f"q_{n}").alias(n) for n in ("lo", "mid", "hi")])


# ---- requests: a school for each supplier, asked for on its own day, up to seven months ahead

_ROOMS = ((0, 25), (25, 200), (0, 1000))
_HOMES_SQL = f"""{CONTRACTS_SQL}, {_POINTS_SQL},
 leases AS (SELECT tx.* REPLACE (CASE WHEN rent_type = 'F' THEN '전세' ELSE '월세' END AS rent_type), lat, lon, CAST(id % 20 AS DOUBLE) AS floor, 1950 + id % 50 AS built_year FROM tx JOIN pts ON property_id = CAST(id AS VARCHAR)),
 req AS (SELECT s_suppkey AS request_id, 37.4 + (s_suppkey * 37 % 317) * 0.0005 AS rlat, 126.8 + (s_suppkey * 53 % 211) * 0.0007 AS rlon, CASE WHEN s_suppkey % 2 = 0 THEN '전세' ELSE '월세' END AS kind,
  CASE s_suppkey % 3 WHEN 1 THEN 25 ELSE 0 END AS low, CASE s_suppkey % 3 WHEN 0 THEN 25 WHEN 1 THEN 200 ELSE 1000 END AS high, DATE '2000-01-01' + CAST(s_suppkey % 300 AS INT) AS asked_on,
  CAST(DATE '2000-01-01' + CAST(s_suppkey % 300 AS INT) + to_months(CAST(s_suppkey % 8 AS INT)) AS DATE) AS date, CASE WHEN s_suppkey % 4 = 1 THEN 1500.0 END AS asked, CASE WHEN s_suppkey % 5 > 0 THEN 400.0 * (s_suppkey % 9 + 1) END AS listing FROM supplier),
 near AS (SELECT * FROM (SELECT *, {_HAVERSINE_SQL.format(a='', b='r')} AS dist_m FROM leases JOIN req ON rent_type = kind AND area_m2 >= low AND area_m2 < high AND housing_category IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) WHERE dist_m <= 2000),
 rad AS (SELECT request_id, CASE WHEN count(*) FILTER (WHERE nr <= 1000) >= 30 THEN 1000 WHEN count(*) FILTER (WHERE nr <= 1500) >= 30 THEN 1500 ELSE 2000 END AS radius_m FROM (SELECT request_id, property_id, min(dist_m) FILTER (WHERE contract_date >= asked_on - 365) AS nr FROM near GROUP BY ALL) GROUP BY ALL),
 cand AS (SELECT request_id, property_id, radius_m, kind, asked_on, date, asked, listing, quantile_cont(area_m2, 0.5) AS area_m2, round_even(quantile_cont(floor, 0.5), 0) AS floor, greatest(1, count(*) FILTER (WHERE contract_date >= asked_on - 730)) AS weight,
  arg_min(dist_m, {{'d': d, 't': tx_id}}) AS dist_m, arg_max({{'gu': gu, 'dong': dong, 'cat': housing_category, 'built': built_year}}, {{'d': d, 't': tx_id}}) AS f FROM near JOIN rad USING (request_id) WHERE dist_m <= radius_m GROUP BY ALL HAVING max(contract_date) >= asked_on - 365),
 dep AS (SELECT request_id, quantile_cont(l.deposit_10k, 0.5) AS usual FROM leases l JOIN cand USING (property_id) WHERE l.rent_type = '월세' AND kind = '월세' AND asked IS NULL AND l.contract_date >= asked_on - 365 GROUP BY ALL),
 scn AS (SELECT c.*, CASE WHEN kind = '월세' THEN coalesce(asked, usual) END AS deposit FROM cand c LEFT JOIN dep USING (request_id))"""


def _homes(spark, d):
    p = _points(spark, d).select(F.col("id").cast("string").alias("property_id"), "lat", "lon")
    k = F.col("property_id").cast("long")
    kind = F.when(F.col("rent_type") == "F", JEONSE).otherwise(MONTHLY)
    return contracts(spark, d).join(p, "property_id").withColumns({"rent_type": kind, "floor": (k % 20).cast("double"), "built_year": 1950 + k % 50})


def _requests(spark, d):
    k = F.col("s_suppkey")
    room = F.get(F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in _ROOMS]), (k % 3).cast("int"))
    asof = F.date_add(F.lit("2000-01-01").cast("date"), (k % 300).cast("int"))
    return table(spark, d, "supplier").select(
        k.alias("request_id"), (37.4 + (k * 37 % 317) * 0.0005).alias("lat"), (126.8 + (k * 53 % 211) * 0.0007).alias("lon"), F.when(k % 2 == 0, JEONSE).otherwise(MONTHLY).alias("rent_type"),
        room["low"].alias("low"), room["high"].alias("high"), F.lit(["BUILDING", "MACHINERY", "HOUSEHOLD"]).alias("categories"), asof.alias("asof"), F.add_months(asof, (k % 8).cast("int")).alias("contract_date"),
        F.when(k % 4 == 1, 1500.0).alias("deposit_10k"), F.when(k % 5 > 0, 400.0 * (k % 9 + 1)).alias("listing_price"))


_FACTS = ("gu", "dong", "housing_category", "built_year")


@query(f"WITH {_HOMES_SQL} SELECT request_id, property_id, radius_m, area_m2, floor, weight, {sql_close('dist_m', 2)} AS dist_m, f.gu AS gu, f.built AS built_year, deposit AS deposit_10k FROM scn")
def request_candidates(spark, d):
    """Buildings of all requests, each within its own radius, with the deposit to reckon with."""
    found = requests.Buildings(_homes(spark, d), _requests(spark, d), CFG, _FACTS).candidates()
    return found.select("request_id", "property_id", "radius_m", "area_m2", "floor", "weight", close(F.col("dist_m"), 2).alias("dist_m"), "gu", "built_year", "deposit_10k")


def _request_prices(rows):
    """A plain pricing rule, by market, horizon and age."""
    mid = F.coalesce("dong_price_median_90d", "gu_price_median_90d", F.lit(100.0)) * (1 + F.col("horizon_days") / 2000)
    return rows.withColumns({"lo": mid * (0.8 + F.coalesce("building_age", F.lit(0)) / 1000), "mid": mid, "hi": mid * (1.2 + F.col("nearest_horizon") / 1000)})


_POOLS_SQL = f"""{_HOMES_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY request_id, property_id) AS k FROM scn),
 both_ AS (SELECT tx_id, d, gu, dong, rent_type, housing_category, area_bin, property_id, price_10k, deposit_10k, CAST(NULL AS BIGINT) AS k FROM leases
  UNION ALL SELECT -1 - k, datediff('day', DATE '1970-01-01', asked_on), f.gu, f.dong, kind, f.cat, {AREA_SQL.format(a='area_m2')}, property_id, NULL, NULL, k FROM numbered),
 known AS (SELECT k, coalesce(dong_price_median_90d, gu_price_median_90d, 100.0) AS level FROM ({history_sql(30, 'both_')}) WHERE k IS NOT NULL),
 two AS (SELECT numbered.*, later, level, CASE WHEN later THEN date - asked_on ELSE 0 END AS ahead, CASE WHEN later THEN date ELSE asked_on END AS on_day FROM known JOIN numbered USING (k), (VALUES (true), (false)) v(later)),
 mids AS (SELECT *, level * (1 + least(ahead, 180) / 2000) AS mid, (SELECT h FROM (SELECT unnest([0, 30, 60, 90, 120, 150, 180]) AS h) ORDER BY abs(h - ahead), h LIMIT 1) AS nearest FROM two),
 pool AS (SELECT request_id, later, mid, mid * (0.8 + CASE WHEN year(on_day) >= f.built THEN year(on_day) - f.built ELSE 0 END / 1000) AS lo, mid * (1.2 + nearest / 1000) AS hi, CAST(weight AS DOUBLE) AS weight, radius_m, deposit, listing, ahead FROM mids)"""
_BELOW_SQL = """SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS t FROM (SELECT *, ln(price / mid) / nullif(width, 0) AS z FROM (SELECT *, CASE WHEN price < mid THEN ln(mid / lo) ELSE ln(hi / mid) END / 1.2815515655446004 AS width FROM ({rows})))"""
_SHARE_SQL = f"sum(weight * CASE WHEN width > 0 THEN {_cdf_sql()} ELSE CAST(price >= mid AS DOUBLE) END) / sum(weight)"
_ANSWERS_SQL = f"""WITH RECURSIVE {_POOLS_SQL},
 bis AS (SELECT request_id, later, q, ln(min(lo)) - 3 * greatest(1.0, ln(max(hi)) - ln(min(lo))) AS a, ln(max(hi)) + 3 * greatest(1.0, ln(max(hi)) - ln(min(lo))) AS b, 0 AS i FROM pool, (VALUES (CAST(0.1 AS DOUBLE)), (0.5), (0.9)) v(q) WHERE later OR q = 0.5 GROUP BY request_id, later, q
  UNION ALL SELECT request_id, later, q, CASE WHEN share <= q THEN m ELSE a END, CASE WHEN share <= q THEN b ELSE m END, i + 1 FROM (SELECT request_id, later, q, a, b, i, m, {_SHARE_SQL} AS share
   FROM ({_BELOW_SQL.format(rows='SELECT bis.*, (a + b) / 2 AS m, exp((a + b) / 2) AS price, lo, mid, hi, weight FROM bis JOIN pool USING (request_id, later) WHERE i < 50')}) GROUP BY request_id, later, q, a, b, i, m)),
 wide AS (SELECT request_id, max(CASE WHEN later AND q = 0.1 THEN exp((a + b) / 2) END) AS range_low, max(CASE WHEN later AND q = 0.5 THEN exp((a + b) / 2) END) AS expected, max(CASE WHEN later AND q = 0.9 THEN exp((a + b) / 2) END) AS range_high, max(CASE WHEN NOT later THEN exp((a + b) / 2) END) AS now_expected FROM bis WHERE i = 50 GROUP BY request_id),
 pct AS (SELECT request_id, 100 * {_SHARE_SQL} AS percentile FROM ({_BELOW_SQL.format(rows='SELECT pool.*, listing AS price FROM pool WHERE later AND listing IS NOT NULL')}) GROUP BY request_id),
 ex AS (SELECT n.request_id, tx_id, d, count(*) FILTER (WHERE likely) OVER (PARTITION BY n.request_id) AS n_like, likely FROM (SELECT near.*, coalesce(kind = '월세' AND scn.deposit > 0 AND near.deposit_10k BETWEEN scn.deposit * 0.5 AND scn.deposit * 2, false) AS likely FROM near JOIN (SELECT request_id, property_id, deposit FROM scn) scn USING (request_id, property_id)) n),
 top AS (SELECT request_id, string_agg(tx_id, ',' ORDER BY d DESC, tx_id DESC) AS examples FROM (SELECT * FROM ex WHERE likely OR n_like < 3 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY d DESC, tx_id DESC) <= 5) GROUP BY request_id)
 SELECT request_id, any_value(radius_m) AS radius_m, count(*) FILTER (WHERE later) AS n_buildings, any_value(deposit) AS deposit_10k, CAST(max(ahead) AS INT) AS horizon_days, {', '.join(f"{sql_close(f'any_value({c})', 2)} AS {c}" for c in ('range_low', 'expected', 'range_high', 'now_expected', 'percentile'))}, any_value(examples) AS examples
 FROM pool JOIN wide USING (request_id) LEFT JOIN pct USING (request_id) LEFT JOIN top USING (request_id) GROUP BY request_id"""


@query(_ANSWERS_SQL)
def serve_requests(spark, d):
    """A fair price for every request of a table, in one plan."""
    out = requests.answer(_homes(spark, d), _requests(spark, d), _request_prices, CFG, _FACTS, ("dong_price_median_90d", "gu_price_median_90d"))
    rounded = [close(F.col(c), 2).alias(c) for c in ("range_low", "expected", "range_high", "now_expected", "percentile")]
    return out.select("request_id", "radius_m", "n_buildings", "deposit_10k", "horizon_days", *rounded, F.array_join(F.transform("examples", lambda e: e["tx_id"]), ",").alias("examples"))
