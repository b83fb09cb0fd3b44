"""The newest row of every key as streaming state: manifests may arrive late, again or in any order.

The state of a key is its newest row (by ``order``, of equal ones the greatest row) and the least and greatest order seen; it lives in a state store on disk, so a batch costs what
arrives in it. A batch adds the rows of its keys to the table as a folder of its own, and no older file is read or written again. Rows of one key merge in any order and any number of
times with the same result, so a batch that is repeated, a stream started anew or a compaction that broke off change nothing.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _merged(rows: DataFrame, key: list[str], order: str, values: list[str], first: Column, last: Column) -> DataFrame:
    """One row per key; sums of this kind are partial, so copies and versions of a hot key are reduced before they meet."""
    newest = F.max(F.struct(F.col(order).alias(order), *values)).alias("_newest")
    out = rows.groupBy(*key).agg(newest, F.min(first).alias("first_seen"), F.max(last).alias("last_seen"))
    return out.select(*key, *[F.col(f"_newest.{c}").alias(c) for c in (*values, order)], "first_seen", "last_seen")


def table_schema(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("first_seen", LongType()), StructField("last_seen", LongType())])


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def changes(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows that batches added, with the folder (``part``) they are in; empty before the first batch."""
    hadoop, files = _folder(spark, path)
    whole = StructType([*table_schema(schema).fields, StructField("part", StringType())])
    return spark.read.schema(whole).parquet(path) if files.exists(hadoop) else spark.createDataFrame([], whole)


def read_newest(spark: SparkSession, path: str, schema: StructType, key: list[str], order: str) -> DataFrame:
    """The newest row of each key, with first_seen and last_seen: the least and greatest order it came with."""
    values = [f.name for f in schema.fields if f.name not in (*key, order)]
    return _merged(changes(spark, path, schema), key, order, values, F.col("first_seen"), F.col("last_seen"))


def stream_newest(spark: SparkSession, source: str, schema: StructType, path: str, checkpoint: str, key: list[str], order: str, files_per_batch: int = 1) -> StreamingQuery:
    """Takes in whatever files are there and stops; started again with the same checkpoint it continues after them. ``order`` is a whole number."""
    session = spark.newSession()  # the store is set for this stream alone
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    values = [f.name for f in schema.fields if f.name not in (*key, order)]
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    newest = _merged(stream, key, order, values, F.col(order).cast("long"), F.col(order).cast("long"))
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/part={own}-{number:09d}")

    return newest.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, path: str, schema: StructType, key: list[str], order: str) -> int:
    """Merges all folders of the table into one and deletes them; how many there were. To be run now and then, between batches of the stream or beside them."""
    parts = [r["part"] for r in changes(spark, path, schema).select("part").distinct().collect()]  # one name a batch since the last compaction
    before = changes(spark, path, schema).where(F.col("part").isin(parts))
    values = [f.name for f in schema.fields if f.name not in (*key, order)]
    _merged(before, key, order, values, F.col("first_seen"), F.col("last_seen")).write.parquet(f"{path}/part=base-{uuid.uuid4().hex}")
    for part in parts:
        hadoop, files = _folder(spark, f"{path}/part={part}")
        files.delete(hadoop, True)
    return len(parts)
