"""Incremental ingest: manifests that arrive as files are upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.snapshot import latest, snapshot_upsert

PART = "part"


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The ingested table; empty before the first batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema.fields, StructField(PART, IntegerType())])).parquet(path)


def upsert_batches(path: str, schema: StructType, key: list[str], order: str, parts: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts into a Parquet table partitioned by a hash of the key.

    A batch reads and overwrites (dynamically) only the partitions of its own keys. The new partitions are first written beside the table, so that it is not read while it is
    overwritten, and a batch that fails half-way is repeated with the same result: an upsert of the same rows under the same number changes nothing.
    A new checkpoint on an old table goes on with the table as it is.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key]), F.lit(parts)).cast("int")
        rows = latest(batch, key, [F.desc(order), *[F.col(c) for c in batch.columns if c not in (*key, order)]])
        touched = [r[PART] for r in rows.select(part.alias(PART)).distinct().collect()]  # at most ``parts`` numbers
        table = read_table(spark, path, schema)
        before = table.where(F.col(PART).isin(touched)).drop(PART) if PART in table.columns else table
        known = before.select(*key, F.col(order).alias("_before"))
        rows = rows.join(known, key, "left").where(F.col("_before").isNull() | (F.col(order) >= F.col("_before"))).drop("_before")  # a late manifest takes nothing back
        after = snapshot_upsert(before, rows, F.lit(number).cast("long"), key).select(*[f.name for f in schema.fields], part.alias(PART))
        after.write.mode("overwrite").parquet(f"{path}-batch")
        ready = spark.read.schema(after.schema).parquet(f"{path}-batch")
        ready.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)

    return run


def stream_ingest(spark: SparkSession, source: str, schema: StructType, path: str, table_schema: StructType, checkpoint: str, key: list[str], order: str, files_per_batch: int = 1) -> StreamingQuery:
    """Ingest whatever files are there and stop; started again with the same checkpoint it continues after them."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(upsert_batches(path, table_schema, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
