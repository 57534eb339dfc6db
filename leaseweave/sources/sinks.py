"""Writers: Parquet, CSV with one header, JSON and text reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..operators.serving import LATEST

APP_COLUMNS = ("tx_id", "contract_date", "rent_type", "area_bin", "property_id", "price_10k", "deposit_10k", "monthly_rent_10k", "contract_type_clean", "area_m2", "floor", *LATEST)


def write_parquet(df: DataFrame, path: str, *partition_by: str, compression: str = "zstd") -> None:
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header; with `bom` its first column's name carries a byte order mark, by which spreadsheet programs
    tell UTF-8."""
    first = df.columns[0]
    (df.withColumnRenamed(first, f"\ufeff{first}") if bom else df).write.mode("overwrite").csv(path, header=True)


def write_json(spark, value: dict, path: str) -> None:
    """A small document, as one text file that Spark writes."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_text(spark, text: str, path: str) -> None:
    """A small text, as one file that Spark writes."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export_app_data(df: DataFrame, path: str) -> None:
    """The columns that serving needs."""
    write_parquet(df.select(*APP_COLUMNS), path)


def text_report(df: DataFrame, rows: int = 50) -> str:
    """A small table as aligned text."""
    found = df.limit(rows).collect()
    table = [df.columns, *[["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in found]]
    widths = [max(len(r[i]) for r in table) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in table)
