"""Analysis of a catalogue: sequences, reconciled names, versions, works, rips, discs and directory types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

RIP_SECONDS = 1200
RIP_FILES = 2
CONFIDENCE_WITH_ARTIST, CONFIDENCE_WITHOUT, CONFIDENCE_AUTHORITATIVE = 0.6, 0.3, 0.95


def sequence_flags(files: DataFrame) -> DataFrame:
    """Per directory: how many of its files begin with a number and whether these are a sequence."""
    n = files.select("directory_id", tx.leading_number(F.col("filename"))["number"].alias("number"))
    per = n.groupBy("directory_id").agg(F.count("*").alias("total"), F.count("number").alias("numbered"), F.countDistinct("number").alias("distinct_numbers"), F.max("number").alias("highest"))
    enough = (F.col("numbered") >= 2) & (F.col("numbered") >= F.ceil(F.col("total") * F.lit(0.6)))
    unique = F.col("distinct_numbers") >= F.ceil(F.col("numbered") * F.lit(0.8))
    plausible = F.coalesce("highest", F.lit(0)) <= F.greatest(F.col("total") + 5, F.col("total") * 2)
    return per.withColumn("has_sequence", enough & unique & plausible)


def reconcile(audio: DataFrame, sequences: DataFrame) -> DataFrame:
    """Adds resolved_title, resolved_artist, resolved_track_no, resolved_source from tags, then the file name.

    ``audio``: directory_id, filename, tag_title, tag_artist, tag_track_no.
    """
    rows = audio.join(sequences.select("directory_id", "has_sequence"), "directory_id", "left")
    rows = tx.with_filename_title(rows, "filename", F.coalesce("has_sequence", F.lit(False)))
    rows = tx.with_parsed_filename(rows, "filename", "_artist", "_title", "_track_no", "_ambiguous")
    given = lambda c: tx.none_if_empty(tx.trim(c))
    rows = rows.withColumn("_tag", given(F.col("tag_title")))
    return rows.select(
        *audio.columns,
        F.when(F.col("_tag").isNotNull(), tx.strip_junk(F.col("_tag"))).otherwise(tx.none_if_empty(F.col("name_title"))).alias("resolved_title"),
        F.coalesce(given(F.col("tag_artist")), given(F.col("_artist")), F.col("name_artist")).alias("resolved_artist"),
        F.coalesce(F.when(F.col("tag_track_no") > 0, F.col("tag_track_no")), "name_track_no", "_track_no").alias("resolved_track_no"),
        F.when(F.col("_tag").isNotNull(), "TAG").otherwise("FILENAME").alias("resolved_source"),
    )


def version_types(titles: DataFrame, title: str = "title") -> DataFrame:
    """Adds version_type, version_label, base_title and its two keys."""
    v = tx.with_version(titles, title).withColumn("base_title_norm", tx.title_key(F.col("base_title")))
    return v.withColumn("base_title_norm_ascii", tx.flatten_diacritics(F.col("base_title_norm")))


def works(versions: DataFrame, artist: str = "artist") -> DataFrame:
    """One row per composition (base title key, artist key): a title to show, members, versions and confidence."""
    keyed = versions.withColumn("title_norm", F.col("base_title_norm")).withColumn("artist_norm", F.coalesce(tx.title_key(F.col(artist)), F.lit("")))
    # a filter on the key itself would be pushed through, and repeat, every step that makes the key
    named = F.bool_or(F.col("title_norm") != "").alias("_named")
    return (
        keyed.groupBy("title_norm", "artist_norm")
        .agg(F.min("base_title").alias("title"), F.count("*").alias("n_members"), F.size(F.collect_set("version_type")).cast("long").alias("n_versions"), named).where("_named").drop("_named")
        .withColumn("confidence", F.when(F.col("artist_norm") != "", CONFIDENCE_WITH_ARTIST).otherwise(CONFIDENCE_WITHOUT))
    )


def work_versions(versions: DataFrame, artist: str = "artist", file_id: str = "file_id") -> DataFrame:
    """Members of every (work, version type, label)."""
    keyed = versions.withColumn("artist_norm", F.coalesce(tx.title_key(F.col(artist)), F.lit("")))
    named = F.bool_or(F.col("base_title_norm") != "").alias("_named")
    return keyed.groupBy(F.col("base_title_norm").alias("title_norm"), "artist_norm", "version_type", F.coalesce("version_label", F.lit("")).alias("version_label")).agg(F.count("*").alias("n_members"), F.min(file_id).alias("first_file"), named).where("_named").drop("_named")


def top_works(per_work: DataFrame, limit: int = 200, least: int = 2) -> DataFrame:
    """The ``limit`` works with most members; then those with ``least`` at least."""
    return per_work.orderBy(F.desc("n_members"), "title_norm", "artist_norm").limit(limit).where(F.col("n_members") >= least)


def rip_flag(duration: Column, dir_audio_count: Column, cue_points_here: Column) -> Column:
    """One long file that a cue sheet divides."""
    return F.coalesce(cue_points_here & (duration > RIP_SECONDS) & (dir_audio_count <= RIP_FILES), F.lit(False))


def rip_flags(audio: DataFrame, counts: DataFrame, cued: DataFrame) -> DataFrame:
    """Audio rows with is_album_rip and needs_split. ``cued``: file_id of files that a sheet points at."""
    here = cued.select("file_id").distinct().withColumn("_cued", F.lit(True))
    rows = audio.join(counts.select("directory_id", "audio_count"), "directory_id", "left").join(here, "file_id", "left")
    flag = rip_flag(F.col("duration_sec"), F.coalesce("audio_count", F.lit(0)), F.coalesce("_cued", F.lit(False)))
    return rows.withColumn("is_album_rip", flag).withColumn("needs_split", flag).drop("_cued", "audio_count")


def multidisc(children: DataFrame) -> DataFrame:
    """(parent_id, directory_id, disc_no, parent_is_multidisc) of directories (parent_id, directory_id, name)."""
    numbered = children.withColumn("disc_no", tx.disc_number(F.col("name")))
    parents = numbered.groupBy("parent_id").agg(((F.count("disc_no") >= 2) & (F.countDistinct("disc_no") >= 2)).alias("parent_is_multidisc"))
    return numbered.join(parents, "parent_id").select("parent_id", "directory_id", "disc_no", "parent_is_multidisc")


def directory_type(audio: Column, files: Column, children: Column, is_rip: Column, disc_no: Column, is_parent: Column) -> Column:
    return (
        F.when(is_parent, "MULTIDISC_PARENT").when(disc_no.isNotNull(), "MULTIDISC_CHILD").when(is_rip, "ALBUM_RIP")
        .when(audio > 0, F.when(children > 0, "MIXED").otherwise("ALBUM")).when((children == 0) & (files > 0), "NON_AUDIO").otherwise("UNKNOWN")
    )


def directory_types(directories: DataFrame, discs: DataFrame, rips: DataFrame) -> DataFrame:
    """Directories (directory_id, parent_id, file_count, audio_count) with their type. A disc number counts only below a multi-disc parent."""
    child_counts = directories.groupBy(F.col("parent_id").alias("directory_id")).agg(F.count("*").alias("child_count"))
    parents = discs.where("parent_is_multidisc").select(F.col("parent_id").alias("directory_id")).distinct().withColumn("is_parent", F.lit(True))
    own_disc = discs.where("parent_is_multidisc").select("directory_id", "disc_no")
    rip_dirs = rips.where("is_album_rip").select("directory_id").distinct().withColumn("is_rip", F.lit(True))
    no = F.lit(False)
    rows = directories.join(child_counts, "directory_id", "left").join(parents, "directory_id", "left").join(own_disc, "directory_id", "left").join(rip_dirs, "directory_id", "left")
    kind = directory_type(F.col("audio_count"), F.col("file_count"), F.coalesce("child_count", F.lit(0)), F.coalesce("is_rip", no), F.col("disc_no"), F.coalesce("is_parent", no))
    return rows.withColumn("type", kind).select(*directories.columns, "disc_no", "type")
