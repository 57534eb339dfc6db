"""Exact order statistics of large groups, and small tables that may be sent to all tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a table counts as small.
SMALL = 10_000


def small(df: DataFrame, at_most: int = SMALL) -> DataFrame:
    """`df` marked to be broadcast if it has no more than `at_most` rows, else as it is. It is computed once."""
    rows = df.limit(at_most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= at_most else df


def order_statistics(df: DataFrame, value: Column, places: Callable[[Column], Sequence[Column]], by: Sequence[str] = ()) -> DataFrame:
    """(`by`, n, q): n values of each group, and the values at `places`, given as functions of n counted from 0, with
    straight lines between ranks. NULL values don't count.

    Values are cut into ranges at approximate quantiles. A range's ranks start at the number of values before it, so
    only ranges that hold a wanted rank are sorted, and one of a single value not even that.
    """
    by = list(by)
    rows = df.select(*by, value.cast("double").alias("_v")).where("_v IS NOT NULL")
    ranges = max(8, min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted(set(rows.agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []))
    edges = F.array(*map(F.lit, cuts)) if cuts else F.array(F.lit(float("inf")))
    rows = rows.withColumn("_range", F.size(F.filter(edges, lambda x: x < F.col("_v"))))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # At most `ranges` rows a group.
    pieces = rows.groupBy(*by, "_range").agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    pieces = pieces.select("*", F.sum("_c").over(group).alias("n"), (F.sum("_c").over(group.orderBy("_range")) - F.col("_c")).alias("_start"))
    at = places(F.col("n"))
    ranks = F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)])
    here = F.array_distinct(F.filter(ranks, lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_c"))))
    pieces = pieces.withColumn("_ranks", here).where(F.size("_ranks") > 0)
    single = pieces.where("_low = _high").select(*by, "n", F.explode("_ranks").alias("_rank"), F.col("_low").alias("_v"))
    names = {c: f"_by{i}" for i, c in enumerate([*by, "_range"])}
    wanted = pieces.where("_low <> _high").select(*[F.col(c).alias(n) for c, n in names.items()], "n", "_start", "_ranks")
    inside = rows.join(wanted, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    order = Window.partitionBy(*by, "_range").orderBy("_v")
    inside = inside.withColumn("_rank", F.col("_start") + F.row_number().over(order) - 1).where(F.array_contains("_ranks", F.col("_rank")))
    found = inside.select(*by, "n", "_rank", "_v").union(single).groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_of"))

    def between(x):
        low, high = (F.col("_of")[f(x).cast("long")] for f in (F.floor, F.ceil))
        return low + (high - low) * (x - F.floor(x))

    return found.select(*by, "n", F.array(*map(between, at)).alias("q"))


def exact_quantiles(df: DataFrame, value: Column, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(`by`, n, q): quantiles with straight lines between ranks, for groups of any size."""
    return order_statistics(df, value, lambda n: [F.lit(float(f)) * (n - 1) for f in fractions], by)


def selected(df: DataFrame, wanted: dict[str, tuple[Column, float]], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """(`by`, names of `wanted`): exact quantiles of many columns and groups at once, with straight lines between ranks.

    A first pass brackets every quantile by approximate ones, whose memory goes by `accuracy`. A second counts what lies
    below and on the brackets and gathers only what lies strictly between, some 6 / `accuracy` of a group's values, or up to `accuracy`. NULL
    values don't count; a group without values has NULL.
    """
    by, names = list(by), list(wanted)
    rows = df.select(*by, *[wanted[n][0].cast("double").alias(f"_v{i}") for i, n in enumerate(names)])
    margin = 2 / accuracy
    around = []
    for i, n in enumerate(names):
        near = F.percentile_approx(f"_v{i}", [max(0.0, wanted[n][1] - margin), min(1.0, wanted[n][1] + margin)], accuracy)
        whole = F.array(F.min(f"_v{i}"), F.max(f"_v{i}"))  # of few values, all of which may be gathered
        around.append(F.when(F.count(f"_v{i}") > accuracy, near).otherwise(whole).alias(f"_b{i}"))
    brackets = rows.groupBy(*by).agg(*around, *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(names))]).withColumnsRenamed({k: f"_k{j}" for j, k in enumerate(by)})
    on = F.lit(True)
    for j, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    met = rows.join(small(brackets), on) if by else rows.crossJoin(F.broadcast(brackets))  # one row
    counted = []
    for i in range(len(names)):
        v, low, high = F.col(f"_v{i}"), F.get(f"_b{i}", F.lit(0)), F.get(f"_b{i}", F.lit(1))
        counted += [F.first(f"_b{i}").alias(f"_b{i}"), F.first(f"_n{i}").alias(f"_n{i}"), F.count_if(v < low).alias(f"_under{i}"), F.count_if(v == low).alias(f"_low{i}"),
                    F.sort_array(F.collect_list(F.when((v > low) & (v < high), v))).alias(f"_in{i}")]
    sums = met.groupBy(*by).agg(*counted)

    def quantile(i, fraction):
        rank = F.lit(float(fraction)) * (F.col(f"_n{i}") - 1)
        below, within = F.col(f"_under{i}"), F.col(f"_under{i}") + F.col(f"_low{i}")

        def at(r):
            inside = F.get(f"_in{i}", (r - within).cast("int"))
            missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
            return F.when(r < below, missed).when(r < within, F.get(f"_b{i}", F.lit(0))).when(r < within + F.size(f"_in{i}"), inside).otherwise(F.get(f"_b{i}", F.lit(1)))

        low, high = at(F.floor(rank)), at(F.ceil(rank))
        return F.when(F.col(f"_n{i}") > 0, low + (high - low) * (rank - F.floor(rank)))

    return sums.select(*by, *[quantile(i, wanted[n][1]).alias(n) for i, n in enumerate(names)])
