"""Features kept fresh as contracts arrive: each micro-batch recomputes only the districts that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, EngineConfig
from ..operators.history import add_history

PARTITION = ("gu", "rent_type")


def refresh(arrivals: DataFrame, history_path: str, features_path: str, checkpoint: str, cfg: EngineConfig = DEFAULT, **trigger) -> StreamingQuery:
    """Append arriving contracts (typed, with area_bin and price_10k) and rewrite the features of their districts.

    Both tables are partitioned by district and rent type; a batch that is run again overwrites the same partitions.
    Of a contract that arrives several times (equal tx_id) the version of the latest batch counts, and within a batch
    the one that sorts last.
    """
    spark = arrivals.sparkSession

    def latest(df: DataFrame, *order: str) -> DataFrame:
        whole = F.struct(*[F.col(c) for c in df.columns])
        return df.groupBy("tx_id").agg(F.max_by(whole, F.struct(*order, F.to_json(whole))).alias("_row")).select("_row.*")

    def batch(new: DataFrame, number: int) -> None:
        new = latest(new).withColumn("_batch", F.lit(number))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch", *PARTITION).parquet(history_path)
        touched = new.select(*PARTITION).distinct()
        past = latest(spark.read.parquet(history_path).join(touched, list(PARTITION), "left_semi"), "_batch").drop("_batch")
        add_history(past, cfg).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(features_path)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
