"""One scan from inventory to counters, as a chain of the snapshot operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..sources import readers
from . import snapshot


@dataclass(frozen=True)
class Scan:
    """Tables after a scan; ``counters`` is the run's one row."""

    files: DataFrame
    directories: DataFrame
    counters: DataFrame


def scan(manifest: DataFrame, known: DataFrame, seen_at: Column, digests: DataFrame | None = None, failed: DataFrame | None = None) -> Scan:
    """``manifest``: volume_id, rel_path, size_bytes, mtime of files; ``known``: the files table before (all columns of the result's ``files``).

    ``digests`` (volume_id, rel_path, content_hash) are of the files that the delta asked for; ``failed`` (volume_id, rel_path) couldn't be read and get
    the status ERROR. Files that aren't seen keep their rows.
    """
    key = snapshot.KEY
    seen = readers.file_inventory(manifest).select(*key, "size_bytes", "mtime")
    delta = snapshot.scan_delta(seen, known.select(*key, "size_bytes", "mtime", "content_hash", "status"))
    new = delta.join(digests if digests is not None else known.select(*key, "content_hash").limit(0), key, "left")
    new = new.join(known.select(*key, F.col("content_hash").alias("old_hash")), key, "left")
    bad = (failed if failed is not None else known.select(*key).limit(0)).select(*key).distinct().withColumn("bad", F.lit(True))
    new = new.join(bad, key, "left").withColumn("content_hash", F.when(F.col("need_hash"), F.col("content_hash")).otherwise(F.col("old_hash")))
    name = tx.base_name(F.col("rel_path"))
    rows = new.select(
        *key, "size_bytes", "mtime", "content_hash", F.when(F.col("bad"), "ERROR").otherwise(F.col("status")).alias("status"),
        name.alias("filename"), tx.extension(name).alias("extension"), tx.normalise(name).alias("filename_norm"), tx.file_type(name).alias("file_type"), tx.is_hidden(name).alias("is_hidden"),
    )
    tree = snapshot.with_parent(snapshot.directory_tree(rows.select(*key)))
    placed = snapshot.file_directory(rows, tree).drop("dir_path").withColumn("file_id", schemas.surrogate_key(F.col("volume_id"), F.col("rel_path")))
    files = snapshot.snapshot_upsert(known, placed, seen_at)
    return Scan(files, snapshot.directory_counts(tree, placed), snapshot.run_counters(placed))
