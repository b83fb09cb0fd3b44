"""Duplicate groups by content, by name and by sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .scratch import Scratch


#: A key with more than this share of all rows is heavy, so there are at most as many heavy keys.
HEAVY_KEYS = 4096


def with_group(scratch: Scratch, rows: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """``rows`` (a written table) with aggregates of the rows of their key; null keys stay away.

    Keys are aggregated with partial sums first. Rows of heavy keys, at most ``HEAVY_KEYS`` in number whatever the data, stay where they are and take their groups from a broadcast; the others
    are joined by shuffle, where no key has more than one in ``HEAVY_KEYS`` of the rows.
    """
    groups = scratch.written(rows.where(F.col(key).isNotNull()).groupBy(key).agg(*aggregates, F.count("*").alias("_rows")), f"by-{key}")
    total = groups.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first()["n"]
    heavy = groups.where(F.col("_rows") * HEAVY_KEYS > total) if total > HEAVY_KEYS else groups.where(F.lit(False))
    light = groups.join(F.broadcast(heavy.select(key)), key, "left_anti")
    hot = rows.join(F.broadcast(heavy), key)
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return hot.unionByName(cold).drop("_rows")


def group_by_key(files: DataFrame, key: Column, kind: str, file_id: str = "file_id", least: int = 2) -> DataFrame:
    """(kind, group_id, file_id, n_members) of files whose key, neither null nor empty, ``least`` files share; the least file id names the group.

    Keys travel as digests, written once: names may be long texts.
    """
    scratch = Scratch(files.sparkSession, "keys")
    keyed = files.select(F.col(file_id).alias("file_id"), key.alias("_key")).select("file_id", F.sha2(F.when(F.col("_key") != "", F.col("_key").cast("string")).cast("binary"), 256).alias("_key"))
    grouped = with_group(scratch, scratch.written(keyed, "files"), "_key", F.min("file_id").alias("group_id"), F.count("*").alias("n_members"))
    return grouped.where(F.col("n_members") >= least).select(F.lit(kind).alias("kind"), "group_id", "file_id", "n_members")


def exact(files: DataFrame, digest: str = "content_hash", file_id: str = "file_id") -> DataFrame:
    return group_by_key(files, F.col(digest), "EXACT_HASH", file_id)


def fuzzy(files: DataFrame, name: str = "filename", file_id: str = "file_id", title_artist: tuple[str, str] | None = None) -> DataFrame:
    """By the normalised name, or by title and artist keys."""
    if title_artist:
        t, a = (tx.title_key_ascii(F.col(c)) for c in title_artist)
        key = F.when((t != "") & (a != ""), F.concat_ws("\u0001", t, a))
    else:
        key = tx.normalise_ascii(F.col(name))
    return group_by_key(files, key, "FUZZY_NAME", file_id)


def _newest(groups: DataFrame, limit: int, kind: str | None) -> DataFrame:
    """(kind, group_id, file_id) of the members of the ``limit`` newest groups (by ``created_at``; ties by kind and id), of one kind or of all."""
    rows = groups if kind is None else groups.where(F.col("kind") == kind)
    heads = rows.groupBy("kind", "group_id").agg(F.max("created_at").alias("created_at")).orderBy(F.desc("created_at"), "kind", "group_id").limit(limit)
    return rows.join(heads.select("kind", "group_id"), ["kind", "group_id"], "left_semi").select("kind", "group_id", "file_id")


def _totals(members: DataFrame) -> DataFrame:
    return members.groupBy("kind", "group_id").agg(F.count("*").alias("n_members"), F.countDistinct("volume_id").alias("n_volumes"), F.sum("size_bytes").alias("total_bytes"))


def report(groups: DataFrame, files: DataFrame, limit: int = 200, kind: str | None = None) -> DataFrame:
    """The ``limit`` newest groups with the totals of their members and volumes."""
    return _totals(_newest(groups, limit, kind).join(files, "file_id"))


def report_members(groups: DataFrame, files: DataFrame, volumes: DataFrame, limit: int = 200, kind: str | None = None) -> DataFrame:
    """The ``limit`` newest groups with all their members: a row a member, with its file's name, path and size, the label of its volume (null if there is none), and the group's totals.

    Members are rows, not a list in the group's row, so a group may have any number of them. Files: file_id, volume_id, filename, rel_path, size_bytes; volumes: volume_id, label.
    """
    own = Scratch(groups.sparkSession, "report").written(_newest(groups, limit, kind), "members")
    totals = _totals(own.join(files.select("file_id", "volume_id", "size_bytes"), "file_id"))  # ``limit`` rows
    labels = volumes.select("volume_id", F.col("label").alias("volume_label"))
    return (
        own.join(files, "file_id").join(F.broadcast(totals), ["kind", "group_id"]).join(labels, "volume_id", "left")
        .select("kind", "group_id", "n_members", "n_volumes", "total_bytes", "file_id", "filename", "rel_path", "size_bytes", "volume_label")
    )
