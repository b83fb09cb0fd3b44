"""Enrichment from cached responses of external services; only the network client is left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .snapshot import latest

GENRE_CONFIDENCE, WORK_CONFIDENCE = 0.8, 0.95
ACOUSTIC = "status string, results array<struct<id:string,score:double,recordings:array<struct<id:string,title:string,artists:array<struct<name:string>>>>>>"
RECORDING = "id string, title string, `artist-credit` array<struct<name:string,artist:struct<name:string>>>, relations array<struct<type:string,work:struct<id:string,title:string>>>"
RELEASES = "results array<struct<id:bigint,title:string,year:string,genre:array<string>,style:array<string>>>"


def acoustid_candidates(responses: DataFrame) -> DataFrame:
    """(query_used, recording_mbid, title, artist, score, result_pos, rec_pos) of lookup responses (query_used, raw)."""
    d = responses.select("query_used", F.from_json("raw", ACOUSTIC).alias("d")).where("d.status IS NULL OR d.status IN ('ok', '')")
    per = d.select("query_used", F.posexplode("d.results").alias("result_pos", "r"))
    rec = per.select("query_used", "result_pos", F.coalesce("r.score", F.lit(0.0)).alias("score"), F.posexplode("r.recordings").alias("rec_pos", "rec")).where("rec.id <> ''")
    artist = tx.none_if_empty(F.array_join(F.filter(F.transform("rec.artists", lambda a: a["name"]), lambda n: n != ""), ", "))
    return rec.select("query_used", F.col("rec.id").alias("recording_mbid"), F.col("rec.title").alias("title"), artist.alias("artist"), "score", "result_pos", "rec_pos")


def acoustid_best(responses: DataFrame) -> DataFrame:
    """The best candidate of each query; the first of equals."""
    best = latest(acoustid_candidates(responses), ["query_used"], [F.desc("score"), F.col("result_pos"), F.col("rec_pos")])
    return best.drop("result_pos", "rec_pos")


def mb_works(responses: DataFrame) -> DataFrame:
    """Artist credit and the first performed work of recording responses."""
    d = responses.select("query_used", F.from_json("raw", RECORDING).alias("d"))
    names = F.filter(F.transform(F.col("d.artist-credit"), lambda c: F.coalesce(c["name"], c["artist"]["name"])), lambda n: n != "")
    work = F.get(F.filter("d.relations", lambda r: (r["type"] == "performance") & (r["work"]["id"] != "")), F.lit(0))["work"]
    return d.select("query_used", F.coalesce("d.id", F.lit("")).alias("recording_mbid"), F.col("d.title").alias("recording_title"), tx.none_if_empty(F.array_join(names, ", ")).alias("artist"), work["id"].alias("work_mbid"), work["title"].alias("work_title"))


def discogs_albums(responses: DataFrame) -> DataFrame:
    """The first result of release searches: id, title, year, genres, styles; queries without a result have none."""
    d = responses.select("query_used", F.get(F.from_json("raw", RELEASES)["results"], F.lit(0)).alias("r")).where("r IS NOT NULL")
    none = F.array().cast("array<string>")
    return d.select("query_used", F.col("r.id").alias("discogs_id"), F.col("r.title").alias("title"), F.regexp_extract("r.year", r"^\s*([+-]?\d+)", 1).try_cast("int").alias("year"), F.coalesce("r.genre", none).alias("genres"), F.coalesce("r.style", none).alias("styles"))


def latest_response(cache: DataFrame) -> DataFrame:
    """The newest response of each (source, query_used)."""
    return latest(cache, ["source", "query_used"], [F.desc("fetched_at"), F.desc("response_id")])


def enrich_albums(directories: DataFrame, audio: DataFrame) -> DataFrame:
    """Albums with their representative track: the first by path that has a fingerprint and a duration, else none."""
    albums = directories.where(F.col("type").isin("ALBUM", "ALBUM_RIP", "MULTIDISC_CHILD")).select("directory_id")
    ready = F.col("fingerprint").isNotNull() & F.col("duration_sec").isNotNull()
    first = audio.where(ready).groupBy("directory_id").agg(F.min_by(F.struct("file_id", "fingerprint", "duration_sec"), F.struct("rel_path", "file_id")).alias("t"))
    return albums.join(first, "directory_id", "left").select("directory_id", F.col("t.file_id").alias("file_id"), F.col("t.fingerprint").alias("fingerprint"), F.col("t.duration_sec").alias("duration_sec"))


def whole_print(fingerprint: Column) -> Column:
    """The key of a lookup: a digest of the whole fingerprint, as prints may begin alike."""
    return F.sha2(fingerprint, 256)


def print_start(fingerprint: Column) -> Column:
    """The key under which earlier caches hold a lookup: the fingerprint's first 64 characters."""
    return F.substring(fingerprint, 1, 64)


def enrich_requests(albums: DataFrame, best: DataFrame, lookup_key: Callable[[Column], Column] = whole_print) -> DataFrame:
    """What three services are to be asked for each album, each request once: (scope, source, ref_file_id, ref_dir_id, query_used).

    ``albums``: directory_id, name and the representative track's file_id, fingerprint, duration_sec, work_id, resolved_artist, tag_album (null if there is none);
    ``best``: query_used (a lookup's key), recording_mbid. A lookup is keyed by ``lookup_key`` (``print_start`` finds what an earlier cache holds); a recording, asked for
    tracks of a known work only, by its id; a release by artist and album.
    """
    ready = albums.where(F.col("fingerprint").isNotNull() & (F.col("duration_sec") > 0)).withColumn("lookup", lookup_key(F.col("fingerprint")))

    def asked(rows: DataFrame, scope: str, source: str, query: Column, file_id: Column, directory_id: Column) -> DataFrame:
        return rows.select(F.lit(scope).alias("scope"), F.lit(source).alias("source"), file_id.alias("ref_file_id"), directory_id.alias("ref_dir_id"), query.alias("query_used"))

    none = F.lit(None)
    own, no_file, no_dir = F.col("file_id"), none.cast(albums.schema["file_id"].dataType), none.cast(albums.schema["directory_id"].dataType)
    known = ready.where("work_id IS NOT NULL").join(best.select(F.col("query_used").alias("lookup"), "recording_mbid"), "lookup")
    release = tx.trim(F.concat_ws(" ", F.coalesce("resolved_artist", F.lit("")), F.coalesce("tag_album", "name")))
    return (
        asked(ready, "FINGERPRINT", "ACOUSTID", F.col("lookup"), own, no_dir)
        .unionByName(asked(known, "FINGERPRINT", "MUSICBRAINZ", F.col("recording_mbid"), own, no_dir))
        .unionByName(asked(albums.where(F.length(release) > 1), "ALBUM", "DISCOGS", release, no_file, F.col("directory_id")))
        .distinct()
    )


def open_requests(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests that no cached response with the same (scope, source, query_used) answers."""
    key = ["scope", "source", "query_used"]
    return requests.join(cache.select(*key).distinct(), key, "left_anti")


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (source, query_used) that no cached response answers, each once: what a fetcher outside Spark is to get."""
    return requests.where("query_used <> ''").select("source", "query_used").distinct().join(cache.select("source", "query_used"), ["source", "query_used"], "left_anti")


def genre_tags(albums: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, tag, source, confidence): genres and styles of an album (directory_id, genres, styles) on all its files."""
    names = F.array_distinct(F.filter(F.transform(F.concat("genres", "styles"), tx.trim), lambda n: n != ""))
    each = albums.select("directory_id", F.explode(names).alias("tag"))
    return each.join(files.select("directory_id", "file_id"), "directory_id").select("file_id", "tag", F.lit("discogs").alias("source"), F.lit(GENRE_CONFIDENCE).alias("confidence")).distinct()


def apply_recordings(audio: DataFrame, best: DataFrame, recordings: DataFrame) -> DataFrame:
    """Audio rows with the recording id of their best candidate and, where a work is known, its id, title, artist and confidence."""
    new = best.select(F.col("query_used").alias("lookup_key"), F.col("recording_mbid").alias("new_mbid"))
    work = recordings.select(F.col("recording_mbid").alias("new_mbid"), "work_mbid", "work_title", F.col("artist").alias("work_artist"))
    return audio.join(new, "lookup_key", "left").join(work, "new_mbid", "left").select(
        *[c for c in audio.columns if c != "acoust_id"], F.coalesce("new_mbid", "acoust_id").alias("acoust_id"), "work_mbid", "work_title", "work_artist", F.when(F.col("work_mbid").isNotNull(), WORK_CONFIDENCE).alias("work_confidence")
    )


def apply_to_works(works: DataFrame, audio: DataFrame, best: DataFrame, recordings: DataFrame) -> DataFrame:
    """Works (work_id, title, artist, confidence) with title, artist, outside id and confidence of what the recordings of their tracks say.

    ``audio``: lookup_key and work_id of the tracks that were looked up. Of several recordings of a work that with the least track wins; a work that none speaks of stays as it is.
    """
    found = apply_recordings(audio.withColumn("acoust_id", F.lit(None).cast("string")), best, recordings).where("work_mbid IS NOT NULL AND work_id IS NOT NULL")
    said = F.min_by(F.struct("work_mbid", "work_title", "work_artist", "work_confidence"), F.struct("file_id", "work_mbid"))
    new = found.groupBy("work_id").agg(said.alias("new"))
    return works.join(new, "work_id", "left").select(
        *[c for c in works.columns if c not in ("title", "artist", "confidence", "work_mbid")], F.coalesce("new.work_title", "title").alias("title"), F.coalesce("new.work_artist", "artist").alias("artist"),
        F.col("new.work_mbid").alias("work_mbid"), F.coalesce("new.work_confidence", "confidence").alias("confidence"),
    )


def enrich_totals(albums: DataFrame, hits: dict[str, DataFrame]) -> DataFrame:
    """Albums processed and queries that each source answered."""
    out = albums.agg(F.count("*").alias("albums"))
    for source, rows in hits.items():
        out = out.crossJoin(rows.agg(F.countDistinct("query_used").alias(f"{source}_hits")))  # one row by one row
    return out
