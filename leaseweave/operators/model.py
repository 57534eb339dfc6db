"""Price ranges: baseline, anchored targets, boosted quantiles or a quantile forest, conformal calibration, metrics."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, EngineConfig
from .boosting import QuantileBoosting
from .ranks import exact_quantiles, order_statistics, selected, small

# Price features that are taken relative to the anchor, and categorical features.
RELATIVE = (
    "dong_price_median_30d", "dong_price_median_90d", "dong_price_median_180d", "dong_price_mean_90d", "dong_price_std_90d",
    "comp_price_median_30d", "comp_price_median_90d", "comp_price_median_180d", "property_last_price", "property_price_median_365d",
)
ANCHOR = "gu_price_median_90d"
CATEGORICAL = ("gu", "dong", "housing_category", "housing_type", "area_bin")
FALLBACK_KEYS = ["gu", "housing_category"]


def fallback_table(df: DataFrame, mask: Column, target: str = "target") -> DataFrame:
    """Median target per district and category of the rows in `mask`."""
    return df.where(mask).groupBy(*FALLBACK_KEYS).agg(F.percentile(target, F.lit(0.5)).alias("fallback"))


def with_fallback(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """One row per district and category: a table that doesn't grow with the contracts, sent to all tasks if small."""
    names = {k: f"_{k}" for k in FALLBACK_KEYS}
    return df.join(small(fallback.withColumnsRenamed(names)), [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()], "left").drop(*names.values())


def baseline_point(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """base_point: the most local median known, at least 1."""
    value = F.coalesce("comp_price_median_90d", "dong_price_median_90d", "gu_price_median_90d", "fallback")
    return with_fallback(df, fallback).withColumn("base_point", F.when(value.isNotNull(), F.greatest(value, F.lit(1.0)))).drop("fallback")


def baseline_quantiles(df: DataFrame, mask: Column, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Quantiles of log(target / base_point) per horizon over the rows in `mask`."""
    q = exact_quantiles(df.where(mask), F.log("target") - F.log("base_point"), cfg.quantiles, ["horizon_days"])
    return q.select("horizon_days", *[F.get("q", F.lit(i)).alias(f"q_{n}") for i, n in enumerate(("lo", "mid", "hi"))])


def run_baseline(df: DataFrame, mask: Column | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    mask = F.col("split") == "train" if mask is None else mask
    df = baseline_point(df, fallback_table(df, mask))
    df = df.join(small(baseline_quantiles(df, mask, cfg)), "horizon_days", "left")  # one row per horizon
    for n in ("lo", "mid", "hi"):
        df = df.withColumn(f"base_{n}", F.col("base_point") * F.exp(f"q_{n}"))
    return df.drop("q_lo", "q_mid", "q_hi")


def apply_anchor(df: DataFrame, features: Sequence[str], fallback: DataFrame, mode: str = "anchor") -> tuple[DataFrame, list[str]]:
    """log_anchor and the features to train on: price levels become ratios to the market's level."""
    if mode == "absolute":
        return df.withColumn("log_anchor", F.lit(0.0)), list(features)
    level = F.coalesce(ANCHOR, "dong_price_median_90d", "fallback")
    df = with_fallback(df, fallback).withColumn("_anchor", F.when(level.isNotNull(), F.greatest(level, F.lit(1.0))))
    df = df.withColumns({"log_anchor": F.log("_anchor"), **{f"rel_{f}": F.col(f) / F.col("_anchor") for f in features if f in RELATIVE}})
    return df.drop("_anchor", "fallback"), [f"rel_{f}" if f in RELATIVE else f for f in features if f != ANCHOR]


def ordered_range(lo: Column, mid: Column, hi: Column) -> list[Column]:
    """The three values in ascending order."""
    s = F.array_sort(F.array(lo, mid, hi))
    return [F.get(s, F.lit(i)) for i in range(3)]


def category_levels(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """(feature, value, level): the values of each categorical feature, numbered by name; missing is a value."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")) for c in columns])).alias("e")).select("e.*").distinct()
    return values.withColumn("level", F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1)


MISSING = "(none)"


class QuantileForest:
    """Quantile regression forest on Spark ML: a forest gives leaves, training targets in a row's leaves give quantiles.

    Features are imputed by -1 with categories indexed by name; an unseen category is a level of its own. Each leaf
    keeps `points` evenly spaced quantiles of its training targets, so the leaf table is bounded by trees, depth and
    points, whatever the number of rows. It is sent to all tasks as one row, and a row's leaves are merged in the row.
    """

    def __init__(self, features: Sequence[str], target: str = "_y", trees: int = 20, depth: int = 8, seed: int = 42, points: int = 32, quantiles=DEFAULT.quantiles):
        self.features, self.target, self.quantiles, self.points = list(features), target, quantiles, points
        self.trees, self.depth, self.seed = trees, depth, seed

    def _ready(self, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.withColumns({f: F.coalesce(F.col(f).cast("string"), F.lit(MISSING)) if kinds[f] == "string" else F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in self.features})

    def fit(self, df: DataFrame) -> QuantileForest:
        kinds = dict(df.dtypes)
        names = [f for f in self.features if kinds[f] == "string"]
        index = StringIndexer(inputCols=names, outputCols=[f"_i_{f}" for f in names], stringOrderType="alphabetAsc", handleInvalid="keep") if names else None
        columns = [f"_i_{f}" if f in names else f for f in self.features]
        levels = max([df.select(F.count_distinct(f)).first()[0] for f in names], default=0)
        stages = [*([index] if index else []), VectorAssembler(inputCols=columns, outputCol="_x"), RandomForestRegressor(
            featuresCol="_x", labelCol=self.target, predictionCol="_mean", leafCol="_leaf", numTrees=self.trees, maxDepth=self.depth,
            minInstancesPerNode=20, maxBins=max(32, levels + 2), seed=self.seed)]
        ready = self._ready(df)
        self.model = Pipeline(stages=stages).fit(ready)
        at = F.array(*[F.lit((i + 0.5) / self.points) for i in range(self.points)])
        leaves = self._leaves(self.model.transform(ready)).groupBy("_tree", "_node").agg(F.percentile(self.target, at).alias("_q"))
        leaves = leaves.select("_tree", F.struct("_node", "_q").alias("_leaf")).groupBy("_tree").agg(F.map_from_entries(F.collect_list("_leaf")).alias("_of"))
        rows = {r["_tree"]: r["_of"] for r in leaves.collect()}  # trees x leaves x points numbers
        wide = max(int(k) for of in rows.values() for k in of) + 1
        self.table = df.sparkSession.createDataFrame([([[rows[t].get(float(k)) for k in range(wide)] for t in range(self.trees)],)], "_table array<array<array<double>>>")
        return self

    @staticmethod
    def _leaves(df: DataFrame) -> DataFrame:
        return df.select("*", F.posexplode(vector_to_array("_leaf")).alias("_tree", "_node"))

    def predict(self, df: DataFrame) -> DataFrame:
        """`df` with q_lo, q_mid, q_hi of the target; nothing is shuffled."""
        rows = self.model.transform(self._ready(df.withColumn("_row", F.struct(*self.features))))
        rows = rows.withColumns({f: F.col(f"_row.`{f}`") for f in self.features}).withColumn("_leaf", vector_to_array("_leaf"))
        merged = F.array_sort(F.flatten(F.transform("_leaf", lambda node, tree: F.get(F.get(F.col("_table"), tree), node.cast("int")))))
        rows = rows.crossJoin(F.broadcast(self.table)).withColumn("_all", merged)  # one row
        place = lambda q: F.get("_all", F.greatest(F.ceil(F.lit(q) * F.size("_all")), F.lit(1)).cast("int") - 1)
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], *[place(q).alias(f"q_{n}") for q, n in zip(self.quantiles, ("lo", "mid", "hi"))])

    def save(self, path: str) -> None:
        """The fitted pipeline, with the levels of its categories, the leaf table and the parameters."""
        self.model.write().overwrite().save(f"{path}/pipeline")
        facts = {"features": self.features, "quantiles": list(self.quantiles), "points": self.points, "trees": self.trees, "depth": self.depth, "seed": self.seed}
        self.table.withColumn("facts", F.lit(json.dumps(facts))).coalesce(1).write.mode("overwrite").parquet(f"{path}/leaves")

    @classmethod
    def load(cls, spark, path: str) -> QuantileForest:
        row = spark.read.parquet(f"{path}/leaves")
        facts = json.loads(row.select("facts").first()[0])
        out = cls(facts["features"], trees=facts["trees"], depth=facts["depth"], seed=facts["seed"], points=facts["points"], quantiles=tuple(facts["quantiles"]))
        out.model, out.table = PipelineModel.load(f"{path}/pipeline"), row.select("_table")
        return out

    def importances(self, spark) -> DataFrame:
        """(feature, gain_share), the largest first."""
        shares = self.model.stages[-1].featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(self.features, shares)), "feature string, gain double").withColumn("gain_share", F.bround(F.col("gain"), 4)).orderBy(F.desc("gain"), "feature")


def conformal_adjustment(df: DataFrame, prefix: str = "model", cfg: EngineConfig = DEFAULT, by: str = "horizon_days") -> DataFrame:
    """Per horizon, by how much (in logs) a range must widen on both sides to hold the target's coverage: an order
    statistic of the errors, found without gathering them."""
    y = F.log("target")
    e = F.greatest(F.log(f"{prefix}_lo") - y, y - F.log(f"{prefix}_hi"))
    found = order_statistics(df, e, lambda n: [F.least(F.lit(1.0), F.lit(cfg.target_coverage) * (n + 1) / n) * (n - 1)], [by])
    return found.select(by, "n", F.get("q", F.lit(0)).alias("adjustment"))


def apply_conformal(df: DataFrame, adjustment: DataFrame, prefix: str = "model", by: str = "horizon_days") -> DataFrame:
    out = df.join(small(adjustment.select(by, "adjustment")), by, "left")  # one row per horizon
    return out.withColumns({f"{prefix}_lo": F.col(f"{prefix}_lo") * F.exp(-F.col("adjustment")), f"{prefix}_hi": F.col(f"{prefix}_hi") * F.exp("adjustment")}).drop("adjustment")


def metrics(df: DataFrame, prefix: str = "model", by: Sequence[str] = (), quantiles=DEFAULT.quantiles) -> DataFrame:
    """Interval quality per group: errors in percent, coverage, median relative width, mean pinball loss. Medians of errors
    are selected exactly without gathering a group."""
    by = list(by)
    y, lo, mid, hi = (F.col(c) for c in ("target", f"{prefix}_lo", f"{prefix}_mid", f"{prefix}_hi"))
    ape = F.abs(mid - y) / y
    pin = sum(F.avg(F.greatest(q * (y - p), (q - 1) * (y - p))) for q, p in zip(quantiles, (lo, mid, hi))) / 3
    means = df.groupBy(*by).agg(
        F.count("*").alias("n"), (100 * F.avg(ape)).alias("mape_pct"), F.avg(F.abs(mid - y)).alias("mae"),
        F.avg(((y >= lo) & (y <= hi)).cast("double")).alias("coverage_80"), pin.alias("pinball_avg"))
    medians = selected(df, {"mdape_pct": (100 * ape, 0.5), "rel_width_median": ((hi - lo) / mid, 0.5)}, by).withColumnsRenamed({c: f"_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = means.join(medians, on) if by else means.crossJoin(medians)  # one row each
    return both.select(*by, "n", "mape_pct", "mdape_pct", "mae", "coverage_80", "rel_width_median", "pinball_avg")


def metrics_rollup(df: DataFrame, prefix: str = "model", by: str = "horizon_days") -> DataFrame:
    """Overall and per horizon; the overall row has `by` NULL."""
    overall = metrics(df, prefix).withColumn(by, F.lit(None).cast(dict(df.dtypes)[by]))
    return metrics(df, prefix, [by]).unionByName(overall)


def train_and_evaluate(df: DataFrame, features: Sequence[str], cfg: EngineConfig = DEFAULT, mode: str = "anchor", **settings) -> dict:
    """Grow trees on `train`, as many as are best on `valid`, calibrate on `calib`, measure on `test`: baseline and model."""
    df = df.where(F.col("split").isNotNull())
    train = F.col("split") == "train"
    fallback = fallback_table(df, train)
    df, used = apply_anchor(df, features, fallback, mode)
    df = run_baseline(df, train, cfg).withColumn("_y", F.log("target") - F.col("log_anchor")).cache()
    model = QuantileBoosting(used, quantiles=cfg.quantiles, **settings).fit(df.where(train), df.where("split = 'valid'"))
    done = priced(model, df.where(F.col("split").isin("calib", "test")))
    out = {"features": used, "boosting": model, "fallback": fallback, "mode": mode, "cached": df}
    for prefix in ("base", "model"):
        adjustment = conformal_adjustment(done.where("split = 'calib'"), prefix, cfg)
        test = apply_conformal(done.where("split = 'test'"), adjustment, prefix)
        out[prefix] = {"adjustment": adjustment, "test": test, "by_horizon": metrics_rollup(test, prefix), "by_gu": metrics(test, prefix, FALLBACK_KEYS)}
    return out


def priced(model: QuantileBoosting | QuantileForest, df: DataFrame) -> DataFrame:
    """`df` (with log_anchor) with model_lo, model_mid, model_hi in ascending order."""
    lo, mid, hi = ordered_range(*[F.exp(F.col(f"q_{n}") + F.col("log_anchor")) for n in ("lo", "mid", "hi")])
    return model.predict(df).withColumns({"model_lo": lo, "model_mid": mid, "model_hi": hi}).drop("q_lo", "q_mid", "q_hi")


def refit_all(df: DataFrame, features: Sequence[str], best: Sequence[int], cfg: EngineConfig = DEFAULT, mode: str = "anchor", **settings) -> dict:
    """The model that serves: grown again on the rows of all splits, with a tenth more rounds than were best in the
    evaluation, to be used with its calibration. Where a market has no level of its own that of the last year counts."""
    df = df.where(F.col("split").isNotNull())
    last = df.agg(F.max("contract_date")).first()[0]
    fallback = fallback_table(df, F.col("contract_date") >= F.date_sub(F.lit(last), cfg.lookback_days))
    ready, used = apply_anchor(df, features, fallback, mode)
    ready = ready.withColumn("_y", F.log("target") - F.col("log_anchor"))
    model = QuantileBoosting(used, quantiles=cfg.quantiles, **settings | {"rounds": tuple(n * 11 // 10 for n in best)}).fit(ready)
    return {"features": used, "fallback": fallback, "boosting": model}
