"""Audits: counts, distributions, gaps, outliers, and a re-check of the history features by plain filtering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, JEONSE, MONTHLY, EngineConfig
from ..functions.scalars import flag
from .cleaning import with_dense_id
from .ranks import SMALL, small


class Report:
    """Checks gathered by stage and counted in one pass per table; `rows` is a table of them."""

    def __init__(self, spark):
        self.spark, self.rows, self.summary = spark, [], {}

    def set(self, key: str, value) -> None:
        self.summary[key] = value

    def count(self, df: DataFrame, stage: str, checks: dict[str, tuple[Column, str]]) -> dict[str, int]:
        """Count the rows for which each condition holds; `checks` maps a name to (condition, action taken)."""
        found = df.agg(*[F.count_if(c).alias(f"c{i}") for i, (c, _) in enumerate(checks.values())]).first()
        out = {name: int(found[i]) for i, name in enumerate(checks)}
        self.rows += [(stage, name, out[name], action, "") for name, (_, action) in checks.items()]
        return out

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "stage string, `check` string, n_rows long, action string, detail string")


def validate_clean(df: DataFrame, cfg: EngineConfig = DEFAULT) -> dict[str, int]:
    """Raise if a required rule is broken. Returns the numbers looked at."""
    r = clean_counts(df, cfg).first().asDict()
    broken = {k: v for k, v in r.items() if k in ("dates", "areas", "money", "order") and v}
    if r["ids"] != r["n"]:
        broken["ids"] = r["n"] - r["ids"]
    if cfg.drop_invalid_gu and r["outside"]:
        broken["outside"] = r["outside"]
    if broken:
        raise AssertionError(f"clean contracts break rules: {broken}")
    return r


def clean_counts(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row: contracts, distinct ids, and those against a rule. `order`: ids whose day is before that of a smaller
    one, compared between ranges of ids and within them."""
    low, high = F.lit(cfg.start_date).cast("date"), F.lit(cfg.end_date).cast("date")
    piece = F.expr("tx_id div 100000")
    within = Window.partitionBy("_p").orderBy("tx_id")
    rows = df.withColumn("_p", piece)
    late = rows.select("_p", "contract_date", F.max("contract_date").over(within.rowsBetween(Window.unboundedPreceding, -1)).alias("_before")).groupBy("_p").agg(F.count_if(F.col("contract_date") < F.col("_before")).alias("_late"), F.min("contract_date").alias("_min"), F.max("contract_date").alias("_max"))
    turned = F.col("_min") < F.max("_max").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row per 100,000 contracts
    order = late.select("_late", turned.alias("_t")).agg((F.coalesce(F.sum("_late"), F.lit(0)) + F.count_if("_t")).alias("order"))
    return df.agg(
        F.count("*").alias("n"), F.count_distinct("tx_id").alias("ids"),
        F.count_if(~F.col("contract_date").between(low, high)).alias("dates"), F.count_if(F.col("area_m2") <= 0).alias("areas"),
        F.count_if((F.col("deposit_10k") < 0) | (F.col("monthly_rent_10k") < 0)).alias("money"),
        F.count_if(~F.col("gu").isin(*cfg.valid_gu)).alias("outside")).crossJoin(order)


def source_distribution(df: DataFrame, cfg: EngineConfig = DEFAULT, jeonse: str = JEONSE) -> DataFrame:
    """Per district and category: size, share of `jeonse`, deposit maximum and 99th percentile, two suspicions."""
    known = df.where(F.col("gu").isNotNull() & F.col("housing_category").isNotNull())
    p99 = F.percentile("deposit_10k", F.lit(0.99))
    share = F.avg(F.coalesce(F.col("rent_type") == jeonse, F.lit(False)).cast("double"))
    t = known.groupBy("gu", "housing_category").agg(F.count("*").alias("n"), F.bround(share, 4).alias("jeonse_share"), F.max("deposit_10k").alias("deposit_max"), p99.alias("deposit_p99"))
    whole = known.groupBy("housing_category").agg(p99.alias("category_deposit_p99"))
    return t.join(whole, "housing_category").withColumns({
        "suspect_low_jeonse": F.col("jeonse_share") < cfg.min_jeonse_share,
        "suspect_truncated_deposit": F.col("deposit_max") < F.col("category_deposit_p99") * cfg.max_deposit_ratio,
    })


def monthly_summary(df: DataFrame, cfg: EngineConfig = DEFAULT, jeonse: str = JEONSE) -> DataFrame:
    """Counts and price statistics per place, month, rent type and category; NULL keys are groups."""
    d, r = F.col("deposit_10k"), F.col("monthly_rent_10k")
    rent_row = ~F.coalesce(F.col("rent_type") == jeonse, F.lit(False))
    out = df.groupBy("gu", "dong", F.year("contract_date").alias("year"), F.month("contract_date").alias("month"), "rent_type", "housing_category").agg(
        F.count("*").alias("transaction_count"), F.percentile(d, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"),
        F.bround(F.avg(d), 1).alias("mean_deposit"), F.bround(F.stddev_samp(d), 1).alias("std_deposit"),
        F.percentile(r, F.lit(0.5)).alias("median_monthly_rent"), F.bround(F.avg(r), 2).alias("mean_monthly_rent"), F.bround(F.stddev_samp(r), 2).alias("std_monthly_rent"),
        F.count_if(F.col("contract_type_clean") == "new").alias("new_contract_count"))
    for name in ("median_monthly_rent", "mean_monthly_rent", "std_monthly_rent"):
        out = out.withColumn(name, F.when(rent_row, F.col(name)))
    for i, name in enumerate(("q25_deposit", "median_deposit", "q75_deposit")):
        out = out.withColumn(name, F.get("q", F.lit(i)))
    return out.drop("q").withColumn("is_partial_year", flag(F.col("year") == cfg.partial_year))


def missing_rate(df: DataFrame) -> DataFrame:
    """(column, missing_pct): percent of NULLs, two digits."""
    rates = df.agg(*[F.bround(100 * F.avg(F.col(c).isNull().cast("double")), 2).alias(c) for c in df.columns])
    return rates.unpivot([], df.columns, "column", "missing_pct")


def unknown_rate_by_year(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("contract_date").alias("year")).agg(F.bround(F.avg((F.col("contract_type_clean") == "unknown").cast("double")), 4).alias("unknown_rate"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def add_coverage_gap_flag(df: DataFrame, lookback_days: int = 180, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """history_window_has_data_gap: 1 if a month from that of t - lookback to that of t - 1 has no contract in the
    row's district and category. Months before the start don't count; NULL keys give 0."""
    start, end = F.lit(cfg.start_date).cast("date"), F.lit(cfg.end_date).cast("date")
    keys = list(cfg.coverage_keys)
    present = df.dropna(subset=keys).select(*keys, month_index(F.col("contract_date")).alias("m")).distinct().withColumn("there", F.lit(1))
    months = present.select(*keys).distinct().select(*keys, F.explode(F.sequence(month_index(start), month_index(end))).alias("m"))
    missing = months.join(present, [*keys, "m"], "left").select(*keys, "m", (1 - F.coalesce("there", F.lit(0))).alias("gone"))
    total = missing.withColumn("gone_to", F.sum("gone").over(Window.partitionBy(*keys).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)))
    # One row of all cumulative counts per district and category: a short array, joined once.
    lists = total.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("m", "gone_to"))).alias("_gone"))
    first, last = month_index(F.date_sub("contract_date", lookback_days)), month_index(F.date_sub("contract_date", 1))
    at = (F.greatest(first, month_index(start)) - month_index(start)).cast("int")
    to = (last - month_index(start)).cast("int")
    upto = lambda i: F.coalesce(F.get(F.col("_gone"), i)["gone_to"], F.lit(0))
    gap = F.when((to >= at) & (to >= 0) & (last <= month_index(end)), upto(to) - F.when(at > 0, upto(at - 1)).otherwise(0) > 0)
    return df.join(small(lists), keys, "left").withColumn("history_window_has_data_gap", flag(gap)).drop("_gone")


def coverage_gaps(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(keys, month) of the months without a contract."""
    start, end = F.lit(cfg.start_date).cast("date"), F.lit(cfg.end_date).cast("date")
    keys = list(cfg.coverage_keys)
    rows = df.dropna(subset=keys)
    months = rows.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))).alias("month"))
    return months.join(rows.select(*keys, F.trunc("contract_date", "month").alias("month")).distinct(), [*keys, "month"], "left_anti")


def with_outlier_flag(df: DataFrame, value: Column, keys: Sequence[str], fallback: Sequence[str], name: str, k: float, min_group: int) -> DataFrame:
    """`df` with `name`: 1 if log(1 + value) is beyond k interquartile ranges of its group, or of the fallback where
    that is small. Fences are aggregated per group, with partial sums in each task, and joined back."""
    lv = F.when(value >= 0, F.log1p(value))
    out = df.withColumn("_lv", lv)

    def fenced(rows, by, tag):
        names = {c: f"_{tag}{i}" for i, c in enumerate(by)}
        q = F.percentile("_lv", F.array(F.lit(0.25), F.lit(0.75)))
        fences = out.groupBy(*by).agg(q.alias("_q"), F.count("_lv").alias(f"_n{tag}"))
        low, high = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
        fences = fences.select(*[F.col(c).alias(n) for c, n in names.items()], (low - k * (high - low)).alias(f"_low{tag}"), (high + k * (high - low)).alias(f"_high{tag}"), f"_n{tag}")
        return rows.join(small(fences), [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left").drop(*names.values())

    rows = fenced(fenced(out, keys, "f"), fallback, "c")
    large = F.col("_nf") >= min_group
    beyond = (F.col("_lv") < F.when(large, F.col("_lowf")).otherwise(F.col("_lowc"))) | (F.col("_lv") > F.when(large, F.col("_highf")).otherwise(F.col("_highc")))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], flag(beyond).alias(name))


def add_outlier_flags(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Deposit, rent and price outliers of the whole period; for review only, never features."""
    kind = F.col("rent_type")
    fallback = [c for c in cfg.outlier_keys if c != "area_bin"]
    rent = F.when((kind == MONTHLY) & (F.col("monthly_rent_10k") > 0), F.col("monthly_rent_10k"))
    for name, value in (("deposit_outlier_candidate", F.when(kind.isin(JEONSE, MONTHLY), F.col("deposit_10k"))), ("monthly_rent_outlier_candidate", rent)):
        df = with_outlier_flag(df, value, cfg.outlier_keys, fallback, name, cfg.outlier_k, cfg.outlier_min_group)
    return df.withColumn("is_price_outlier_candidate", F.when(kind == JEONSE, F.col("deposit_outlier_candidate")).otherwise(F.col("monthly_rent_outlier_candidate")))


def _sample(df: DataFrame, sample: int, seed: int, columns: Sequence[Column]) -> DataFrame:
    """`sample` rows by the hash of their id: a few are the first of each task, all need no order, others are numbered."""
    shown = [F.col("tx_id").alias("_id"), F.unix_date("contract_date").alias("_t"), *columns]
    if sample <= SMALL:
        return df.orderBy(F.xxhash64("tx_id", F.lit(seed)), "tx_id").limit(sample).select(*shown)
    if df.count() <= sample:
        return df.select(*shown)
    drawn = with_dense_id(df.withColumn("_hash", F.xxhash64("tx_id", F.lit(seed))), ["_hash", "tx_id"], "_place")
    return drawn.where(F.col("_place") < sample).select(*shown)


def recheck_windows(df: DataFrame, keys: Sequence[str], days: int, count_col: str, median_col: str, min_count: int, sample: int = 400, value: str = "price_10k", seed: int = 42) -> DataFrame:
    """One row: how many of `sample` rows, taken by the hash of their id, disagree with a recount by plain filtering.

    Contracts and sample meet by group and bucket of `days` days: a window reaches into two, so contracts are listed in
    theirs and the next one, and a window finds all of its contracts in one list. Rows of a group and day have the same
    window, which is filtered once, so no pairs of contracts are written. A small sample is sent to all tasks.
    """
    some = _sample(df, sample, seed, [F.struct(*keys).alias("_g"), F.col(count_col).alias("_n"), F.col(median_col).alias("_m")])  # equal structs may hold NULLs
    bucket = lambda day: F.floor(day / days)
    asked = some.where("_t IS NOT NULL").groupBy("_g", bucket(F.col("_t") - 1).alias("_b")).agg(F.collect_set("_t").alias("_asked"))  # `days` at most
    past = df.select(F.struct(*keys).alias("_g"), F.unix_date("contract_date").alias("_day"), F.col(value).cast("double").alias("_v")).where("_day IS NOT NULL AND _v IS NOT NULL")
    own = bucket(F.col("_day"))
    past = past.withColumn("_b", F.explode(F.array(own, own + 1)))
    if sample <= SMALL:
        past = past.join(F.broadcast(asked.select("_g", "_b")), ["_g", "_b"], "left_semi")
    lists = past.groupBy("_g", "_b").agg(F.collect_list(F.struct("_day", "_v")).alias("_past")).join(asked, ["_g", "_b"])

    def counted(t):
        inside = F.filter("_past", lambda x: (x["_day"] < t) & (x["_day"] >= t - days))
        return F.struct(t.alias("_t"), F.array_sort(F.transform(inside, lambda x: x["_v"])).alias("_in"))

    again = lists.select("_g", F.explode(F.transform("_asked", counted)).alias("_w")).select("_g", "_w.*")
    n = F.size("_in")
    middle = (F.get("_in", F.floor((n - 1) / 2).cast("int")) + F.get("_in", F.floor(n / 2).cast("int"))) / 2
    again = again.select("_g", "_t", n.cast("long").alias("n"), middle.alias("m"))
    both = some.join(again, ["_g", "_t"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    expected = F.when(F.col("n") >= min_count, F.col("m"))
    wrong = ~F.col("n").eqNullSafe(F.col("_n")) | ~F.coalesce(F.abs(expected - F.col("_m")) <= 1e-6 * F.abs(expected), expected.isNull() & F.col("_m").isNull())
    return both.agg(F.count("*").alias("n_checked"), F.count_if(wrong).alias("n_mismatches"))


def recheck_previous(df: DataFrame, keys: Sequence[str], last_col: str, days_col: str, sample: int = 400, value: str = "price_10k", seed: int = 42) -> DataFrame:
    """One row: how many of `sample` rows disagree with the latest earlier contract found by plain filtering, in its
    price or in the days since. They meet by group, as in `recheck_windows`."""
    some = _sample(df, sample, seed, [*[F.col(k).alias(f"_{k}") for k in keys], F.col(last_col).alias("_last"), F.col(days_col).cast("double").alias("_days")])
    past = df.where(F.col(value).isNotNull()).select(*keys, F.unix_date("contract_date").alias("_day"), "tx_id", value)
    on = F.col("_day") < F.col("_t")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    again = past.join(small(some.select("_id", "_t", *[f"_{k}" for k in keys])), on).groupBy("_id").agg(F.max(F.struct("_day", "tx_id", value)).alias("m"))
    both = some.join(again, "_id", "left")
    days = (F.col("_t") - F.col("m._day")).cast("double")
    wrong = ~(F.col(f"m.{value}").eqNullSafe(F.col("_last")) & days.eqNullSafe(F.col("_days")))
    return both.agg(F.count("*").alias("n_checked"), F.count_if(wrong).alias("n_mismatches"))


def explain_window(df: DataFrame, tx_id: int, keys: Sequence[str], days: int = 90, value: str = "price_10k") -> DataFrame:
    """One row on how the window of a contract came about: bounds, what is in it and what is left out."""
    row = df.where(F.col("tx_id") == tx_id).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("contract_date").alias("_t"), F.col(value).alias("_v"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    group = df.join(F.broadcast(row), on)
    inside = (F.col("contract_date") < F.col("_t")) & (F.col("contract_date") >= F.date_sub("_t", days))
    day = F.col("contract_date") == F.col("_t")
    return group.groupBy("_t", "_v").agg(
        F.min(F.when(inside, F.col("contract_date"))).alias("earliest"), F.max(F.when(inside, F.col("contract_date"))).alias("latest"),
        F.count_if(inside).alias("n_in_window"), F.percentile(F.when(inside, F.col(value)), F.lit(0.5)).alias("median"),
        F.count_if(day).alias("same_day_left_out"), F.count_if(F.col("contract_date") > F.col("_t")).alias("future_left_out"),
        F.percentile(F.when(inside | day, F.col(value)), F.lit(0.5)).alias("median_with_same_day"),
    ).withColumnsRenamed({"_t": "contract_date", "_v": value}).withColumn("window_start", F.date_sub("contract_date", days))
