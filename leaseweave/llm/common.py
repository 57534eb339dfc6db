"""What the document operators share: column pruning, Arrow maps over whole texts, and the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "binary": pa.binary(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()),
    "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()),
}
#: Rows and bytes of an Arrow batch: long texts stay small in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of the plans that follow, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """The Parquet table `table` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_schema(schema: list[tuple[str, str]]) -> pa.Schema:
    return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in schema])


def ddl(schema: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in schema)


def map_columns(df: DataFrame, columns: list, fn: Callable, schema: list[tuple[str, str]]) -> DataFrame:
    """Apply `fn` to Arrow batches of `columns` only: dict of lists in, dict of lists out.

    Nothing but the named columns reaches Python, so clashing or extra columns don't matter.
    """
    bounded_batches(df.sparkSession)
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch.to_pydict()), schema=out)

    return df.select(*columns).mapInArrow(run, ddl(schema))


def held_out(doc_id: str = "doc_id"):
    """True for the rows that no classifier learns from: crc32(doc_id as text) mod 4 is 2 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir or the context's checkpoint folder.

    Only a local session may do without, as in tests; on a cluster a machine's own folder would lose what is written.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="leaseweave-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: what follows depends neither on shuffle files of lost executors nor on the
    plan so far, and Spark knows its true size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of `stored` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
