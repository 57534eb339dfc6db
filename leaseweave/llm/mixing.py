"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling, DataFrame functions only.

Tokens are added up per cell of (source, language, topic). Raking multiplies cell weights until each margin has its
target share; the ratio of fitted to present tokens becomes an inclusion probability per cell, scaled so that the
expected tokens meet the budget; a document is kept if a hash of its id, as a uniform number, lies below it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, stored

MARGINS = ("source", "lang", "topic")
#: Up to so many cells are raked in one task, without shuffles, and broadcast to the documents; more are dealt and joined by key.
FEW_CELLS = 10_000
#: Share of all tokens to keep, power by which margins are tempered, raking rounds at most, the error they stop at, and
#: rounds of one job.
KEEP, TEMPER, ROUNDS, CLOSE, STEP = 0.6, 0.7, 200, 1e-6, 10
SEED = 20_240_229


def topic(text: Column) -> Column:
    """What kind of text it is: table, code, numeric, list or prose; empty for none."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(t) == 0, "empty").when(F.instr(t, " | ") > 0, "table").when(t.rlike(r"[{};]\n|def \w+\(|#include"), "code")
        .when(t.rlike(r"[$%&*#]{3}"), "symbols").when(t.rlike(r"[0-9]{4}"), "numeric").otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Words of a text: runs of characters that are not white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def margin_targets(cells: DataFrame, name: str, given: dict | None = None, temper: float = TEMPER) -> DataFrame:
    """(`name`, target): the `given` shares, or present shares to the power `temper`, over the values present; sums to 1."""
    share = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("t"))
    if given is not None:
        share = share.select(name, F.coalesce(F.create_map([F.lit(x) for kv in given.items() for x in kv])[F.col(name)], F.lit(0.0)).alias("w"))
    else:
        share = share.select(name, F.pow("t", F.lit(temper)).alias("w"))
    total = share.agg(F.sum("w")).first()[0] or 1.0
    return share.select(name, (F.col("w") / F.lit(float(total))).alias("target"))


def margin_error(state: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest difference between a margin's share and its target."""
    gaps = [state.groupBy(name).agg(F.sum("weight").alias("_now")).join(target, name).agg(F.max(F.abs(F.col("_now") - F.col("target"))).alias("gap")) for name, target in targets.items()]
    return reduce(DataFrame.union, gaps).agg(F.max("gap")).first()[0] or 0.0


def scaled(state: DataFrame, targets: dict[str, DataFrame], few: bool) -> DataFrame:
    """`state` with its weights scaled to every margin in turn: a window per margin over a few cells, which are in one
    task; else sums per value, joined back, which don't gather the cells of a value."""
    for name, target in targets.items():
        if few:
            factor = F.sum("weight").over(Window.partitionBy(name))
            state = state.withColumn("weight", F.when(factor > 0, F.col("weight") * F.col(f"_{name}_target") / factor).otherwise(0.0))
        else:
            now = state.groupBy(name).agg(F.sum("weight").alias("_now"))
            state = state.join(now, name).withColumn("weight", F.when(F.col("_now") > 0, F.col("weight") * F.col(f"_{name}_target") / F.col("_now")).otherwise(0.0)).drop("_now")
    return state


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, close: float = CLOSE) -> tuple[DataFrame, float]:
    """`cells` with `weight`, the fitted share of each cell, as a stored table, and the margin error that is left.

    It ends when all margins are met to within `close`, when the error stands still (targets that no weights of the
    cells present can meet together), or after `rounds`. Cells without tokens keep weight 0. The driver sees one
    number a job of STEP rounds (one round where there are many cells); the weights are then written to the shared
    folder, so plans don't grow.
    """
    total, n = cells.agg(F.sum("tokens").cast("double"), F.count("*")).first()
    few = n <= FEW_CELLS
    state = cells.withColumn("weight", F.col("tokens") / F.lit(total or 1.0))
    for name, target in targets.items():
        state = state.join(target.withColumnRenamed("target", f"_{name}_target"), name)
    def kept(state):
        """The stored state and its margin error."""
        if not few:
            state = stored(state)
            return state, margin_error(state, targets)
        gaps = [F.abs(F.sum("weight").over(Window.partitionBy(name)) - F.col(f"_{name}_target")) for name in targets]
        state = stored(state.withColumn("_gap", F.greatest(*gaps) if len(gaps) > 1 else gaps[0]))
        return state, state.agg(F.max("_gap")).first()[0] or 0.0

    (state, error), step = kept(state.coalesce(1) if few else state), STEP if few else 1
    for turn in range(0, rounds, step):
        if error <= close:
            break
        fitted, before, old = state.drop("_gap").coalesce(1) if few else state, error, state
        for _ in range(min(step, rounds - turn)):
            fitted = scaled(fitted, targets, few)
        state, error = kept(fitted)
        forget(old)
        if abs(error - before) <= close / 100:
            break
    return state, error


def calibrated(state: DataFrame, keep: float = KEEP) -> DataFrame:
    """`state` with `ratio`, the inclusion probability of each cell: min(1, c * fitted / present) with c so that the
    expected tokens are `keep` of all, or as many as cells with a weight have. c is found by passes over the cells that
    each try 64 values, evenly in its logarithm, then between the two nearest, where the tokens go in a straight line."""
    rel = state.withColumn("_r", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    some = F.col("_r") > 0
    bounds = rel.agg(F.sum("tokens").cast("double").alias("n"), F.sum(F.when(some, F.col("tokens"))).cast("double").alias("most"), F.min(F.when(some, F.col("_r"))).alias("lo"), F.sum("weight").alias("w")).first()
    if not bounds["lo"]:
        return rel.withColumn("ratio", F.lit(0.0)).drop("_r")
    goal = min(keep * bounds["n"], bounds["most"])
    low, high = goal / bounds["w"] / 2, 2 / bounds["lo"]
    for _ in range(4):
        tries = [low * (high / low) ** (i / 64) for i in range(65)]
        got = rel.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(c) * F.col("_r"))).alias(f"c{i}") for i, c in enumerate(tries)]).first()
        at = min(63, max((i for i in range(65) if got[i] <= goal), default=0))
        low, high, below, above = tries[at], tries[at + 1], got[at], got[at + 1]
    c = low + (high - low) * min(1.0, max(0.0, (goal - below) / (above - below))) if above > below else high
    return rel.withColumn("ratio", F.least(F.lit(1.0), F.lit(c) * F.col("_r"))).drop("_r")


def uniform(*columns) -> Column:
    """A number in [0, 1) from the hash of the columns: the same at every run and on every machine."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(SEED)), 11).cast("double") / F.lit(float(1 << 53))


def mixed(df: DataFrame, given: dict[str, dict] | None = None, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text", topic_of: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Every row of `df`, its `columns` (all if not given) in the struct `_row`, with the cell, `_tokens`, `_topic`, `_weight` (fitted over present share), `_probability`, `_selected`
    and `_margin_error`, by how much the worst margin misses its target.

    `given` has target shares by margin and value; a margin not given is tempered. `topic_of` is any expression over
    the columns of `df`; without it, the kind of text. Null sources and languages are a value of their own. Rows with
    equal id are kept or dropped together within a cell. An empty table gives an empty result; texts without tokens
    are kept with their cell's probability.
    """
    given = given or {}
    kind = topic(F.col(text_col)) if topic_of is None else F.coalesce(topic_of.cast("string"), F.lit("(none)"))
    keys = [F.coalesce(F.col(name).cast("string"), F.lit("(none)")).alias(f"_{name}") for name in ("source", "lang")]
    own = [*keys, kind.alias("_topic"), tokens(F.col(text_col)).alias("_tokens")]
    cells = df.select(*own).groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"))
    cells = stored(cells.select(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.greatest("tokens", F.lit(1).cast("long")).alias("tokens")))
    few = cells.count() <= FEW_CELLS
    targets = {name: stored(margin_targets(cells, name, given.get(name))) for name in MARGINS}
    state, error = rake(cells, targets)
    total = F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 1))
    fitted = stored(calibrated(state, keep).select(*[F.col(x).alias(f"_{x}") for x in MARGINS], (F.col("weight") * total / F.col("tokens")).alias("_weight"), F.col("ratio").alias("_probability")))
    forget(cells, state, *targets.values())
    row = F.struct(*[F.col(f"`{c}`") for c in columns or df.columns]).alias("_row")
    chance = uniform(F.coalesce(F.col(id_col).cast("string"), F.lit("(none)")))
    joined = df.select(row, chance.alias("_chance"), *own).join(F.broadcast(fitted) if few else fitted, ["_source", "_lang", "_topic"])
    return joined.select("*", F.lit(error).alias("_margin_error"), (F.col("_chance") < F.col("_probability")).alias("_selected"))


def mix_documents(df: DataFrame, **options) -> DataFrame:
    """One row per document: cell, tokens, weight, probability, whether it is in the sample, and the margin error."""
    rows = mixed(df.select("doc_id", "text", "source", "lang"), columns=["doc_id"], **options)
    return rows.select("_row.doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_selected").alias("selected"), F.col("_margin_error").alias("margin_error"))


def sample_mixture(df: DataFrame, **options) -> DataFrame:
    """The sampled rows of `df` with the columns of `df`."""
    return mixed(df, **options).where("_selected").select("_row.*")
