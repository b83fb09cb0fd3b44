"""Search with context, directory views and current mounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .snapshot import latest
from .trigram import TextIndex, joined

#: What the title shows: reconciled, else the tag, else the file's name.
TITLE = ("resolved_title", "tag_title", "filename")
COVERS = ("front", "cover", "folder", "booklet")


def _contains(c: str, q: str) -> Column:
    return F.coalesce(F.lower(F.col(c)).contains(q.lower()), F.lit(False))


def search_audio(audio: DataFrame, q: str, fields: tuple[str, ...] = ("resolved_title", "resolved_artist", "tag_title", "tag_artist")) -> DataFrame:
    """Audio rows in which any of the fields, or their flattened form, holds the text, whatever its case."""
    flat = tx.flatten_diacritics(F.lit(q.lower()))
    hit = F.lit(False)
    for f in fields:
        hit = hit | _contains(f, q) | F.coalesce(tx.flatten_diacritics(F.lower(F.col(f))).contains(flat), F.lit(False))
    return audio.where(hit)


def search_files(files: DataFrame, q: str) -> DataFrame:
    """Files whose lower-cased or flattened name key holds the text."""
    return files.where(_contains("filename_lower", q) | F.coalesce(F.col("filename_norm_ascii").contains(tx.flatten_diacritics(F.lit(q.lower()))), F.lit(False)))


#: Forms under which files are indexed, and those of them that hold tags.
LOWER, KEYED, TAGGED = "lower", "key", "tags"


def index_files(index: TextIndex, files: DataFrame) -> TextIndex:
    """Indexes names (filename_lower, filename_norm_ascii) and, of rows that have them, titles and artists without accents."""
    tags = [c for c in ("resolved_title", "resolved_artist", "tag_title", "tag_artist") if c in files.columns]
    forms = {LOWER: F.col("filename_lower"), KEYED: F.col("filename_norm_ascii")}
    if tags:
        has = F.coalesce(*tags).isNotNull()
        forms[TAGGED] = F.when(has, tx.flatten_diacritics(F.lower(joined(*tags))))
    return index.build(files, "file_id", forms)


def _flat(index: TextIndex, q: str) -> str:
    return index.spark.range(1).select(tx.flatten_diacritics(F.lit(q.lower())).alias("q")).first()["q"]


def find_audio(index: TextIndex, q: str) -> DataFrame:
    """(file_id,) as ``search_audio`` finds them: what holds a text also holds it without accents, so one form does."""
    return index.matches(TAGGED, _flat(index, q)).withColumnRenamed("id", "file_id")


def find_files(index: TextIndex, q: str) -> DataFrame:
    """(file_id,) as ``search_files`` finds them."""
    return index.matches(LOWER, q.lower()).union(index.matches(KEYED, _flat(index, q))).distinct().withColumnRenamed("id", "file_id")


def search_union(audio_hits: DataFrame, file_hits: DataFrame, cap: int) -> DataFrame:
    """(source, file_id, directory_id, title, total): hits by audio first, then by name those not hit already; ``total`` counts before the cap."""
    one = audio_hits.select(F.lit("audio").alias("source"), "file_id", "directory_id", F.coalesce(*TITLE).alias("title"))
    two = file_hits.join(audio_hits.select("file_id"), "file_id", "left_anti").select(F.lit("file").alias("source"), "file_id", "directory_id", F.col("filename").alias("title"))
    both = one.unionByName(two)
    return both.orderBy("source", "title", "file_id").limit(cap).crossJoin(both.agg(F.count("*").alias("total")))  # by one row


def search_context(hits: DataFrame, files: DataFrame, most: int = 12) -> DataFrame:
    """Each hit with other files of its directory: audio and other, ``most`` each, by name."""
    near = files.join(hits.select("directory_id").distinct(), "directory_id", "left_semi").select("directory_id", F.col("file_id").alias("other"), F.col("filename").alias("name"), F.col("file_type") == "AUDIO")
    near = near.toDF("directory_id", "other", "name", "is_audio")
    # a hit may be among the first itself; more than one beyond ``most`` is never needed, so a large directory is cut before it meets its hits
    first = Window.partitionBy("directory_id", "is_audio").orderBy("name", "other")
    near = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most + 1).drop("k")
    pairs = hits.select("file_id", "directory_id").join(near, "directory_id").where("other <> file_id")
    w = Window.partitionBy("file_id", "is_audio").orderBy("name", "other")
    few = pairs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    names = lambda audio: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_audio") == audio, F.struct("k", "name")))), lambda x: x["name"])
    per = few.groupBy("file_id").agg(F.array_join(names(True), "|").alias("audio_siblings"), F.array_join(names(False), "|").alias("other_siblings"))
    return hits.join(per, "file_id", "left").fillna({"audio_siblings": "", "other_siblings": ""})


def search_cue(tracks: DataFrame, sheets: DataFrame, q: str, cap: int) -> DataFrame:
    """Titled cue tracks whose title or performer holds the text, with their sheet's file and directory."""
    hit = tracks.where("title IS NOT NULL AND title <> ''").where(_contains("title", q) | _contains("performer", q))
    return hit.join(sheets, "sheet_id").orderBy("title", "sheet_id", "ord").limit(cap)


def album_tracks(audio: DataFrame) -> DataFrame:
    """Every directory's tracks with title, artist and their place by tag number, parsed number, name."""
    number = F.coalesce("tag_track_no", "parsed_track_no", F.lit(9999))
    w = Window.partitionBy("directory_id").orderBy(number, "filename", "file_id")
    return audio.select("directory_id", "file_id", F.coalesce(*TITLE).alias("title"), F.coalesce("resolved_artist", "tag_artist").alias("artist"), F.row_number().over(w).alias("place"))


def cover_pick(files: DataFrame) -> DataFrame:
    """The image that shows a directory: the first by preference, then name."""
    low = F.lower(F.col("filename"))
    rank = F.lit(len(COVERS))
    for i in reversed(range(len(COVERS))):
        rank = F.when(low.contains(COVERS[i]), i).otherwise(rank)
    best = F.min_by(F.struct("file_id", "filename"), F.struct(rank, F.col("filename"), F.col("file_id")))
    return files.where("file_type = 'IMAGE'").groupBy("directory_id").agg(best.alias("c")).select("directory_id", F.col("c.file_id").alias("cover_id"), F.col("c.filename").alias("cover"))


def directory_children(directories: DataFrame) -> DataFrame:
    """Directories with their children's names in order."""
    names = F.array_join(F.array_sort(F.collect_list("name")), "|")
    return directories.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count("*").alias("n_children"), names.alias("children"))


def directory_detail(directories: DataFrame, files: DataFrame, audio: DataFrame, tags: DataFrame, sheets: DataFrame) -> DataFrame:
    """One row per directory: counts, its tracks in order, tag names, cover and first cue sheet."""
    tracks = album_tracks(audio).groupBy("directory_id").agg(F.count("*").alias("n_tracks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]), "|").alias("track_list"))
    named = files.select("directory_id", "file_id").join(tags, "file_id").groupBy("directory_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))
    sheet = sheets.groupBy("directory_id").agg(F.min("sheet_id").alias("sheet_id"))
    return directories.select("directory_id").join(tracks, "directory_id", "left").join(named, "directory_id", "left").join(cover_pick(files).select("directory_id", "cover"), "directory_id", "left").join(sheet, "directory_id", "left").fillna({"n_tracks": 0, "track_list": "", "tags": ""})


def current_mount(volumes: DataFrame, mapping: DataFrame, runs: DataFrame) -> DataFrame:
    """Where each volume is: mapped by id, else by label, else its latest run's path."""
    ids = mapping.select(F.col("name").alias("volume_id"), F.col("path").alias("by_id"))
    labels = mapping.select(F.col("name").alias("label"), F.col("path").alias("by_label"))
    last = latest(runs.where("mount_path IS NOT NULL"), ["volume_id"], [F.desc("started_at"), F.desc("run_id")]).select("volume_id", "mount_path")
    return volumes.join(ids, "volume_id", "left").join(labels, "label", "left").join(last, "volume_id", "left").select("volume_id", F.coalesce("by_id", "by_label", "mount_path").alias("path"))
