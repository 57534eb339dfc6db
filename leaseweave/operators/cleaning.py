"""Raw text rows to typed, de-duplicated contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import COLUMN_MAP, DEFAULT, JEONSE, MONTHLY, NUMERIC_COLUMNS, EngineConfig
from ..functions.scalars import contract_kind, flag, location_part, missing_to_null, nfkc, parse_day, parse_number
from ..sources.scratch import keep

EXACT_KEYS = (*[c for c in COLUMN_MAP.values() if c != "row_no"], "housing_category")
CANDIDATE_KEYS = ("contract_date", "gu", "dong", "jibun", "building_name", "area_m2", "floor", "rent_type", "deposit_10k", "monthly_rent_10k")


def rename_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(COLUMN_MAP)


def normalize_strings(df: DataFrame, columns: Sequence[str] | None = None, fold: bool = True) -> DataFrame:
    """NFKC (with `fold`), white space off, missing tokens to NULL."""
    columns = columns or [c for c in COLUMN_MAP.values() if c in df.columns]
    return df.withColumns({c: missing_to_null(nfkc(F.col(c)) if fold else F.col(c)) for c in columns})


def parse_numeric(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    return df.withColumns({c: parse_number(F.col(c)) for c in columns})


def parse_dates(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Adds contract_date; rows without one, or outside the configured period, go."""
    df = df.withColumn("contract_date", parse_day(F.col("contract_ym"), F.col("contract_day")))
    return df.where(F.col("contract_date").between(F.lit(cfg.start_date).cast("date"), F.lit(cfg.end_date).cast("date")))


def parse_location(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    df = df.withColumns({name: location_part(F.col("sigungu"), i) for i, name in enumerate(("sido", "gu", "dong"))})
    return df.where(F.col("gu").isin(*cfg.valid_gu)) if cfg.drop_invalid_gu else df


def parsing_checks(df: DataFrame, cfg: EngineConfig = DEFAULT) -> dict[str, tuple]:
    """Conditions to count over rows that are renamed and normalised but not yet parsed: missing cells, numbers and
    days that don't parse, days outside the period, and districts that are unknown or differ from the export's."""
    low, high = F.lit(cfg.start_date).cast("date"), F.lit(cfg.end_date).cast("date")
    day, gu = parse_day(F.col("contract_ym"), F.col("contract_day")), location_part(F.col("sigungu"), 1)
    out = {f"{c} missing": (F.col(c).isNull(), "left empty") for c in COLUMN_MAP.values() if c in df.columns}
    out |= {f"{c} not a number": (F.col(c).isNotNull() & parse_number(F.col(c)).isNull(), "left empty") for c in NUMERIC_COLUMNS if c in df.columns}
    out |= {"no contract day": (day.isNull(), "removed"), "before the period": (day < low, "removed"), "after the period": (day > high, "removed"),
            "district outside the list": (~F.coalesce(gu.isin(*cfg.valid_gu), F.lit(False)), "removed" if cfg.drop_invalid_gu else "kept")}
    if "source_cond_gu" in df.columns:
        out["district differs from the export's"] = (F.col("source_cond_gu").isNotNull() & ~F.coalesce(F.col("source_cond_gu").contains(gu), F.lit(False)), "kept")
    return out


def remove_duplicates(df: DataFrame, keys: Sequence[str] = EXACT_KEYS, table: str = "source_table_id", order: Sequence[str] = ("_seq",), candidates: Sequence[str] | None = CANDIDATE_KEYS) -> DataFrame:
    """Each row is kept as often as the table that holds it most often does; NULL keys are equal.

    The k-th copy of a row within a table is a copy of the k-th one of any other table. `order` names columns that
    order a table's rows. With `candidates`, rows that agree in those are flagged, all of them.
    """
    within = Window.partitionBy(*keys, table).orderBy(*order)
    across = Window.partitionBy(*keys, "_k").orderBy(table, *order)
    kept = df.withColumn("_k", F.row_number().over(within)).withColumn("_first", F.row_number().over(across)).where("_first = 1").drop("_k", "_first")
    return flag_candidates(kept, candidates) if candidates else kept


def flag_candidates(df: DataFrame, keys: Sequence[str] = CANDIDATE_KEYS) -> DataFrame:
    return df.withColumn("is_duplicate_candidate", (F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1).cast("int"))


def within_table_copies(df: DataFrame, keys: Sequence[str] = EXACT_KEYS, table: str = "source_table_id") -> DataFrame:
    """One row: how many rows repeat another of their own table."""
    return df.groupBy(*keys, table).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_copies"))


def apply_validity(df: DataFrame) -> DataFrame:
    """Rows with impossible area or money go; rows against the rules of their rent type are flagged."""
    area, deposit, rent, kind = (F.col(c) for c in ("area_m2", "deposit_10k", "monthly_rent_10k", "rent_type"))
    kept = df.where((area > 0) & F.coalesce(deposit >= 0, F.lit(True)) & F.coalesce(rent >= 0, F.lit(True)))
    positive = {c: F.coalesce(F.col(c) > 0, F.lit(False)) for c in ("deposit_10k", "monthly_rent_10k")}
    return kept.withColumns({
        "anomaly_jeonse_with_rent": flag((kind == JEONSE) & positive["monthly_rent_10k"]),
        "anomaly_jeonse_zero_deposit": flag((kind == JEONSE) & ~positive["deposit_10k"]),
        "anomaly_monthly_zero_rent": flag((kind == MONTHLY) & ~positive["monthly_rent_10k"]),
    })


def clean_contract_fields(df: DataFrame) -> DataFrame:
    return df.withColumns({"contract_type_clean": contract_kind(F.col("contract_type")), "renewal_right_used": flag(F.col("renewal_request_used") == "사용")})


#: Rows of a range of ids.
RANGE_ROWS = 1_000_000


def with_dense_id(df: DataFrame, order: Sequence, name: str = "tx_id", ranges: int | None = None) -> DataFrame:
    """`df` with ids 0..n-1 in the order of `order`, by ranges whose number goes by that of the rows.

    Rows are dealt by all ordering columns, so equal first ones don't meet in one task; each range is sorted and written
    with the places inside it, and starts at the number of rows of the ranges before. `order` must order rows totally for
    the ids to be the same at every run.
    """
    keys = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    spark = df.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // RANGE_ROWS + 1)
    # The id that Spark gives has the range in its upper bits and the place in the range in the lower 33.
    dealt, _ = keep(df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = dealt.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))  # a row for each range
    out = dealt.withColumn("_range", part).join(F.broadcast(starts), "_range")
    return out.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_range", "_at", "_start")


def clean(raw: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Source columns (their names, text) with metadata and `_seq` to contracts with tx_id."""
    return clean_normalized(normalize_strings(rename_columns(raw)), cfg)


def clean_normalized(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """`clean` from rows that are renamed and normalised."""
    df = parse_location(parse_dates(parse_numeric(df), cfg), cfg)
    df = clean_contract_fields(apply_validity(remove_duplicates(df)))
    df = df.withColumn("row_no", F.col("row_no").try_cast("double").try_cast("long"))
    return with_dense_id(df, ["contract_date", "source_table_id", "row_no", "_seq"]).drop("_seq")
