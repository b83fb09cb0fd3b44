"""Cue sheets in bulk: lines are exploded, windows give each line its track, aggregation makes rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def _lines(sheets: DataFrame) -> DataFrame:
    """sheet_id, line number, keyword and rest of every line that isn't blank."""
    line = tx.trim(F.col("line"))
    return (
        sheets.select("sheet_id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).withColumn("line", line).where("line <> ''")
        .select("sheet_id", "n", F.upper(F.regexp_extract("line", r"^(\S+)", 1)).alias("word"), F.regexp_extract("line", r"(?s)^\S+\s?(.*)$", 1).alias("rest"))
    )


def _numbered(sheets: DataFrame) -> DataFrame:
    """Lines with the ordinal of the track that they belong to; 0 is the album."""
    w = Window.partitionBy("sheet_id").orderBy("n")
    return _lines(sheets).withColumn("ord", F.sum(F.when(F.col("word") == "TRACK", 1).otherwise(0)).over(w))


def _last(word: str) -> Column:
    """The value of the last such line."""
    return F.max_by(F.when(F.col("word") == word, tx.cue_unquote(F.col("rest"))), F.when(F.col("word") == word, F.col("n")))


def cue_tracks(sheets: DataFrame) -> DataFrame:
    """sheet_id, ord, track_no, title, performer, start_ms, end_ms of every track of (sheet_id, text)."""
    number = F.regexp_extract(tx.trim(F.col("rest")), r"^(\d+)", 1).try_cast("int")
    point = F.regexp_extract(tx.trim(F.col("rest")), r"^(\d+)\s+\d+:\d{1,2}:\d{1,2}", 1).try_cast("int")
    at = tx.cue_ms(F.regexp_extract(tx.trim(F.col("rest")), r"^\d+\s+(\d+:\d{1,2}:\d{1,2})", 1))
    lines = _numbered(sheets).where("ord > 0").withColumn("point", F.when(F.col("word") == "INDEX", point)).withColumn("at", F.when(F.col("word") == "INDEX", at))
    # the last INDEX 01 counts; without one the first other
    start = F.coalesce(F.max_by("at", F.when(F.col("point") == 1, F.col("n"))), F.min_by("at", F.when(F.col("at").isNotNull(), F.col("n"))))
    tracks = lines.groupBy("sheet_id", "ord").agg(
        F.coalesce(F.min(F.when(F.col("word") == "TRACK", number)), F.first("ord")).cast("int").alias("track_no"), _last("TITLE").alias("title"), _last("PERFORMER").alias("performer"), start.alias("start_ms")
    )
    w = Window.partitionBy("sheet_id").orderBy("ord")
    return tracks.withColumn("end_ms", F.lead("start_ms").over(w))


def cue_sheets(sheets: DataFrame) -> DataFrame:
    """sheet_id, file_ref, album_title, album_performer, n_tracks, status of every sheet, also of blank ones."""
    lines = _numbered(sheets)
    album = F.when(F.col("ord") == 0, F.col("word"))
    pick = lambda word: F.max_by(F.when(album == word, tx.cue_unquote(F.col("rest"))), F.when(album == word, F.col("n")))
    files = F.min_by(F.when(F.col("word") == "FILE", tx.cue_unquote(F.col("rest"))), F.when((F.col("word") == "FILE") & (tx.cue_unquote(F.col("rest")) != ""), F.col("n")))
    found = lines.groupBy("sheet_id").agg(files.alias("file_ref"), pick("TITLE").alias("album_title"), pick("PERFORMER").alias("album_performer"), F.max("ord").alias("n_tracks"), F.bool_or(F.col("word") == "FILE").alias("saw_file"))
    return sheets.select("sheet_id").join(found, "sheet_id", "left").select(
        "sheet_id", "file_ref", "album_title", "album_performer", F.coalesce("n_tracks", F.lit(0)).cast("long").alias("n_tracks"),
        F.when(F.coalesce("saw_file", F.lit(False)) & (F.coalesce("n_tracks", F.lit(0)) > 0), "OK").otherwise("PARTIAL").alias("status"),
    )


def cue_resolve(sheets: DataFrame, audio: DataFrame) -> DataFrame:
    """Sheets (volume_id, dir_path, file_ref) with the audio file they point at (volume_id, rel_path, file_id); null if there is none."""
    target = F.when(F.col("dir_path") == "", F.col("file_ref")).otherwise(F.concat_ws("/", "dir_path", "file_ref"))
    found = audio.select("volume_id", F.col("rel_path").alias("target"), F.col("file_id").alias("audio_id"))
    return sheets.withColumn("target", target).join(found, ["volume_id", "target"], "left")


def fill_last_end(tracks: DataFrame, durations: DataFrame) -> DataFrame:
    """The last track's end from the audio's length (sheet_id, duration_sec)."""
    w = Window.partitionBy("sheet_id").orderBy(F.desc("ord"))
    last = F.row_number().over(w) == 1
    end = F.when(last, F.coalesce("end_ms", F.round(F.col("duration_sec") * 1000).cast("int"))).otherwise(F.col("end_ms"))
    return tracks.join(durations, "sheet_id", "left").withColumn("end_ms", end).drop("duration_sec")
