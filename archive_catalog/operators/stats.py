"""Catalogue statistics and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_type(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_type")


def duplicates_by_kind(groups: DataFrame) -> DataFrame:
    return groups.groupBy("kind").agg(F.countDistinct("group_id").alias("n_groups"))


def overview(volumes: DataFrame, directories: DataFrame, files: DataFrame, audio: DataFrame, works: DataFrame) -> DataFrame:
    """One row of totals; each table is read once."""
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    parts = (
        volumes.agg(F.count("*").alias("volumes")), directories.agg(F.count("*").alias("directories")),
        files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")),
        audio.agg(F.count("*").alias("audio_files"), flag(F.col("lossless")).alias("lossless"), flag(F.col("needs_split")).alias("needs_split"), F.count("fingerprint").alias("fingerprinted"), F.count("acoust_id").alias("matched")),
        works.agg(F.count("*").alias("works"), flag(F.col("authoritative")).alias("authoritative")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row by one row
    return out


def responses_by_source(cache: DataFrame) -> DataFrame:
    return cache.groupBy("source").agg(F.count("*").alias("n"))


def top_genres(file_tags: DataFrame, source: str = "discogs", limit: int = 10) -> DataFrame:
    return file_tags.where(F.col("source") == source).groupBy("tag").agg(F.countDistinct("file_id").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def volume_summary(volumes: DataFrame, files: DataFrame, directories: DataFrame, runs: DataFrame) -> DataFrame:
    """Every volume with its counts and first root directory."""
    f = files.groupBy("volume_id").agg(F.count("*").alias("files"), F.count_if(F.col("file_type") == "AUDIO").alias("audio"))
    d = directories.groupBy("volume_id").agg(F.count("*").alias("directories"), F.min(F.when(F.col("depth") == 0, F.col("directory_id"))).alias("root_id"))
    r = runs.groupBy("volume_id").agg(F.count("*").alias("runs"))
    return volumes.select("volume_id", "label").join(f, "volume_id", "left").join(d, "volume_id", "left").join(r, "volume_id", "left").fillna(0, ["files", "audio", "directories", "runs"])


def recent_runs(runs: DataFrame, volumes: DataFrame, limit: int = 10) -> DataFrame:
    """The newest runs with their volume's label."""
    newest = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)
    return newest.join(volumes.select("volume_id", "label"), "volume_id", "left").select("run_id", "volume_id", "label", "kind", "status", "started_at")


def interrupted_runs(runs: DataFrame, volumes: DataFrame, limit: int = 10) -> DataFrame:
    """Of the newest runs, those that were interrupted: what a new run may take up again."""
    return recent_runs(runs, volumes, limit).where("status = 'INTERRUPTED'")


def interrupt_runs(runs: DataFrame, starting: DataFrame) -> DataFrame:
    """Runs still marked as running for a (kind, volume_id) that starts anew become interrupted."""
    new = starting.select("kind", "volume_id").distinct().withColumn("_again", F.lit(True))
    stale = (F.col("status") == "RUNNING") & F.col("_again").isNotNull()
    return runs.join(new, ["kind", "volume_id"], "left").withColumn("status", F.when(stale, "INTERRUPTED").otherwise(F.col("status"))).drop("_again")
