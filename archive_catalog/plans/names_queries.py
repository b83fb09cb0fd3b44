"""Queries over names, titles, cue sheets, sound and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..functions.compose import composed
from ..operators import acoustic, analyze, cue, dedup, enrich, verify
from ..sources import readers
from .catalogue import query
from .views import Tables

# --- names -----------------------------------------------------------------------------------------------------------
_STEM = r"regexp_replace(filename, '\.[^.]*$', '')"
_BARE = rf"CASE WHEN regexp_matches(lower({_STEM}), '^\s*\d{{1,3}}\s*[-._)]+\s*') THEN regexp_replace(lower({_STEM}), '^\s*\d{{1,3}}\s*[-._)]+\s*', '') ELSE regexp_replace(lower({_STEM}), '^\s*[a-h]\s*[1-9]\d?\s*[-._)]+\s*', '') END"
_NORM = rf"trim(regexp_replace({_BARE}, '[-_.\s]+', ' ', 'g'))"


@query("normalize_names", f"SELECT file_id, {_NORM} AS norm, {_NORM} AS norm_ascii, lower(filename) AS lower_name FROM {{tracks}}")
def normalize_names(t: Tables):
    name = F.col("filename")
    return composed(t.tracks, "filename").select("file_id", tx.normalise(name).alias("norm"), tx.normalise_ascii(name).alias("norm_ascii"), F.lower(name).alias("lower_name"))


@query("normalize_titles", r"SELECT file_id, trim(regexp_replace(lower(title), '[-_.\s]+', ' ', 'g')) AS title_norm, trim(regexp_replace(lower(title), '[-_.\s]+', ' ', 'g')) AS title_norm_ascii FROM {titles}")
def normalize_titles(t: Tables):
    return composed(t.titles, "title").select("file_id", tx.title_key(F.col("title")).alias("title_norm"), tx.title_key_ascii(F.col("title")).alias("title_norm_ascii"))


_CLEAN = "p_name || CASE WHEN l_partkey % 3 = 0 THEN ' (Official Video)' ELSE '' END"


@query(
    "parse_filenames",
    r"""SELECT file_id, artist, CASE WHEN filename LIKE '%(Official Video).mp3' THEN title || ' (Official Video)' ELSE title END AS title,
    CASE WHEN regexp_matches(filename, '^\d') THEN CAST(file_id % 100 AS INTEGER) END AS track_no, false AS ambiguous FROM {tracks}""",
)
def parse_filenames(t: Tables):
    return tx.with_parsed_filename(t.tracks.select("file_id", "filename"), "filename").drop("filename")


@query("strip_junk", "SELECT file_id, title AS clean_title FROM {tracks}")
def strip_junk(t: Tables):
    """Titles with one to thirteen pieces of junk."""
    noisy = F.concat("title", F.repeat(F.lit(" [HD]"), (F.col("file_id") % 13).cast("int")), F.when(F.col("file_id") % 3 == 0, " (Official Music Video) [HD]").when(F.col("file_id") % 3 == 1, " - Lyric Video by someone").otherwise(" (Remastered 2009) www.example.com"))
    return t.tracks.select("file_id", noisy.alias("noisy")).select("file_id", tx.strip_junk(F.col("noisy")).alias("clean_title"))


_LEADING = r"""n AS (SELECT directory_id, count(*) AS total, count(k) AS numbered, count(DISTINCT k) AS distinct_numbers, max(k) AS highest FROM (
  SELECT directory_id, CASE WHEN regexp_matches(filename, '^\d') THEN CAST(file_id % 100 AS INTEGER) END AS k FROM {tracks}) GROUP BY directory_id),
s AS (SELECT *, numbered >= 2 AND numbered >= ceil(total * CAST(0.6 AS DOUBLE)) AND distinct_numbers >= ceil(numbered * CAST(0.8 AS DOUBLE)) AND coalesce(highest, 0) <= greatest(total + 5, total * 2) AS has_sequence FROM n)"""


@query("sequence_flags", f"WITH {_LEADING} SELECT directory_id, total, numbered, distinct_numbers, highest, has_sequence FROM s")
def sequence_flags(t: Tables):
    return analyze.sequence_flags(t.tracks)


@query(
    "reconcile",
    r"""SELECT file_id, title AS resolved_title, coalesce(tag_artist, artist) AS resolved_artist,
    coalesce(CAST(CASE WHEN tag_track_no > 0 THEN tag_track_no END AS INTEGER), CASE WHEN regexp_matches(filename, '^\d') THEN CAST(file_id % 100 AS INTEGER) END) AS resolved_track_no,
    CASE WHEN trim(tag_title) <> '' THEN 'TAG' ELSE 'FILENAME' END AS resolved_source FROM {tracks}""",
)
def reconcile(t: Tables):
    out = analyze.reconcile(t.tracks, analyze.sequence_flags(t.tracks))
    return out.select("file_id", "resolved_title", "resolved_artist", "resolved_track_no", "resolved_source")


_VERSION = r"""v AS (SELECT t.file_id, t.artist, p.p_name || CASE WHEN t.p_size % 8 = 3 THEN ' (feat. X)' ELSE '' END AS base_title,
  CASE t.p_size % 8 WHEN 0 THEN 'EXTENDED' WHEN 1 THEN 'RADIO_EDIT' WHEN 2 THEN 'LIVE' WHEN 3 THEN 'REMIX' WHEN 4 THEN 'REMASTER' WHEN 5 THEN 'CLUB_MIX' ELSE 'UNKNOWN' END AS version_type,
  CASE t.p_size % 8 WHEN 0 THEN 'Extended Mix' WHEN 1 THEN 'Radio Edit' WHEN 2 THEN 'Live' WHEN 3 THEN 'DJ Remix' WHEN 4 THEN 'Remastered' WHEN 5 THEN 'Club Mix' END AS version_label FROM {titles} t JOIN {part} p ON t.file_id = p.p_partkey),
w AS (SELECT *, trim(regexp_replace(lower(base_title), '[-_.\s]+', ' ', 'g')) AS title_norm, trim(regexp_replace(lower(artist), '[-_.#\s]+', ' ', 'g')) AS a0, trim(regexp_replace(lower(artist), '[-_.\s]+', ' ', 'g')) AS artist_norm FROM v)"""


@query("version_types", f"WITH {_VERSION} SELECT file_id, version_type, version_label, base_title, title_norm AS base_title_norm, title_norm AS base_title_norm_ascii FROM w")
def version_types(t: Tables):
    return analyze.version_types(t.titles).drop("artist", "title", "p_size", "p_retailprice")


@query("works", f"WITH {_VERSION} SELECT title_norm, artist_norm, min(base_title) AS title, count(*) AS n_members, count(DISTINCT version_type) AS n_versions, CAST(0.6 AS DOUBLE) AS confidence FROM w GROUP BY title_norm, artist_norm")
def works(t: Tables):
    return analyze.works(analyze.version_types(t.titles))


@query("work_versions", f"WITH {_VERSION} SELECT title_norm, artist_norm, version_type, coalesce(version_label, '') AS version_label, count(*) AS n_members, min(file_id) AS first_file FROM w GROUP BY ALL")
def work_versions(t: Tables):
    return analyze.work_versions(analyze.version_types(t.titles))


@query("top_works", f"WITH {_VERSION}, g AS (SELECT title_norm, artist_norm, min(base_title) AS title, count(*) AS n_members, count(DISTINCT version_type) AS n_versions FROM w GROUP BY title_norm, artist_norm ORDER BY n_members DESC, title_norm, artist_norm LIMIT 200) SELECT *, CAST(0.6 AS DOUBLE) AS confidence FROM g WHERE n_members >= 2")
def top_works(t: Tables):
    return analyze.top_works(analyze.works(analyze.version_types(t.titles)))


@query("dup_fuzzy", r"""WITH k AS (SELECT file_id, trim(regexp_replace(lower(regexp_replace(p_name || '.mp3', '\.[^.]*$', '')), '[-_.\s]+', ' ', 'g')) AS key FROM {titles} JOIN {part} ON file_id = p_partkey),
g AS (SELECT key, min(file_id) AS group_id, count(*) AS n_members FROM k WHERE key <> '' GROUP BY key HAVING count(*) >= 2) SELECT 'FUZZY_NAME' AS kind, group_id, file_id, n_members FROM k JOIN g USING (key)""")
def dup_fuzzy(t: Tables):
    return dedup.fuzzy(t.part.select(F.col("p_partkey").alias("file_id"), F.concat("p_name", F.lit(".mp3")).alias("filename")))


# --- cue sheets ------------------------------------------------------------------------------------------------------
def _sheets(t: Tables):
    """A sheet per conversation: user turns are tracks that begin a minute and some frames apart."""
    at = F.format_string("%02d:%02d:%02d", F.col("turn") * 4, F.col("turn") % 60, (F.col("turn") * 7) % 75)
    title = F.regexp_replace("text", r'["\r\n]', "")
    lines = F.concat(F.lit("  TRACK "), F.format_string("%02d", F.col("turn") + 1), F.lit(' AUDIO\n    TITLE "'), title, F.lit('"\n    PERFORMER "'), "role", F.lit('"\n    INDEX 00 '), at, F.lit("\n    INDEX 01 "), at, F.lit("\n"))
    rows = t.conversations.withColumn("line", lines)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "")
    head = F.concat(F.lit('REM made\nPERFORMER "Someone"\nTITLE "Set '), F.col("conv_id").cast("string"), F.lit('"\r\nFILE "rip '), F.col("conv_id").cast("string"), F.lit('.flac" WAVE\n'))
    return rows.groupBy("conv_id").agg(body.alias("body")).select(F.col("conv_id").alias("sheet_id"), F.concat(head, "body").alias("text"))


_CUE = r"""c AS (SELECT conv_id AS sheet_id, CAST(row_number() OVER w AS BIGINT) AS ord, CAST(turn + 1 AS INTEGER) AS track_no, regexp_replace(text, '["\r\n]', '', 'g') AS title, role AS performer,
  CAST(turn * 4 * 60000 + (turn % 60) * 1000 + round(((turn * 7) % 75) * 1000 / 75) AS INTEGER) AS start_ms FROM {conversations} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT *, lead(start_ms) OVER (PARTITION BY sheet_id ORDER BY ord) AS end_ms FROM c)"""


@query("cue_tracks", f"WITH {_CUE} SELECT * FROM d")
def cue_tracks(t: Tables):
    return cue.cue_tracks(_sheets(t))


@query("cue_tracks_filled", f"WITH {_CUE} SELECT sheet_id, ord, track_no, title, performer, start_ms, coalesce(end_ms, CAST((3000 + sheet_id) * 1000 AS INTEGER)) AS end_ms FROM d")
def cue_tracks_filled(t: Tables):
    durations = t.conversations.select(F.col("conv_id").alias("sheet_id"), (F.col("conv_id") + 3000.0).alias("duration_sec")).distinct()
    return cue.fill_last_end(cue.cue_tracks(_sheets(t)), durations)


@query("cue_resolve", "SELECT conv_id AS sheet_id, count(*) AS n_tracks, 'rip ' || CAST(conv_id AS STRING) || '.flac' AS file_ref, 'OK' AS status, CASE WHEN conv_id % 4 > 0 THEN conv_id END AS audio_id FROM {conversations} GROUP BY conv_id")
def cue_resolve(t: Tables):
    audio = t.conversations.where("conv_id % 4 > 0").select(F.lit("v").alias("volume_id"), F.concat(F.lit("dir/rip "), F.col("conv_id").cast("string"), F.lit(".flac")).alias("rel_path"), F.col("conv_id").alias("file_id")).distinct()
    sheets = cue.cue_sheets(_sheets(t)).withColumn("volume_id", F.lit("v")).withColumn("dir_path", F.lit("dir"))
    return cue.cue_resolve(sheets, audio).select("sheet_id", "n_tracks", "file_ref", "status", "audio_id")


# --- sound -----------------------------------------------------------------------------------------------------------
BER = 0.30


def _prints(t: Tables):
    """Two words of sign bits per vector, and a length."""
    bit = lambda i: F.when(F.get("embedding", F.lit(i)) > 0, F.lit(1 << (i % 32))).otherwise(F.lit(0)).cast("long")
    word = lambda k: sum((bit(i) for i in range(32 * k + 1, 32 * k + 32)), bit(32 * k))
    return t.embeddings.select(F.col("vec_id").alias("file_id"), F.array(word(0), word(1)).alias("fp"), (F.lit(180.0) + F.col("vec_id") % 60).alias("duration_sec"))


_PAIRS = """p AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(len([i FOR i IN range(1, 65) IF (a.embedding[i] > 0) <> (b.embedding[i] > 0)]) AS DOUBLE) / 64 AS ber FROM {embeddings} a JOIN {embeddings} b ON a.vec_id < b.vec_id AND abs(a.vec_id % 60 - b.vec_id % 60) <= 7),
q AS (SELECT a, b, ber FROM p WHERE ber <= 0.30)"""


@query("fingerprint_pairs", f"WITH {_PAIRS} SELECT a, b, ber FROM q")
def fingerprint_pairs(t: Tables):
    return acoustic.fingerprint_pairs(_prints(t), BER)


_CLUSTERS = f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a AS x, b AS y FROM q UNION SELECT b, a FROM q),
    reach AS (SELECT x AS node, x AS hit FROM e UNION SELECT r.node, e.y FROM reach r JOIN e ON r.hit = e.x), l AS (SELECT node, min(hit) AS label FROM reach GROUP BY node),
    SELECT 'AUDIO_FINGERPRINT' AS kind, label AS group_id, node AS file_id, count(*) OVER (PARTITION BY label) AS n_members FROM l"""


@query("dup_fingerprint", _CLUSTERS.replace("GROUP BY node),", "GROUP BY node)"))
def dup_fingerprint(t: Tables):
    return acoustic.fingerprint_clusters(_prints(t), BER)


@query("fingerprint_ingest", """SELECT event_id, event_id % 5 = 4 AS rejected, CASE WHEN event_id % 5 <> 4 THEN 'AQ' || CAST(event_id AS STRING) END AS fingerprint, CASE WHEN event_id % 5 <> 4 THEN CAST(100 + event_id % 300 AS DOUBLE) END AS duration FROM {events}""")
def fingerprint_ingest(t: Tables):
    e, d = F.col("event_id").cast("string"), (F.col("event_id") % 300 + 100).cast("string")
    out = (
        F.when(F.col("event_id") % 5 == 4, F.concat(F.lit("ERROR: "), e)).when(F.col("event_id") % 5 == 3, F.concat(F.lit("DURATION="), d, F.lit("\nFINGERPRINT=AQ"), e, F.lit("\n")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"duration": "'), d, F.lit('", "fingerprint": "AQ'), e, F.lit('"}'))).otherwise(F.concat(F.lit(' {"duration": '), d, F.lit(', "fingerprint": "AQ'), e, F.lit('"}')))
    )
    return readers.fingerprint_ingest(t.events.select("event_id", out.alias("stdout")))


@query("keybpm_ingest", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Am' WHEN 1 THEN 'F#' ELSE '8B' END AS musical_key, CASE event_id % 3 WHEN 0 THEN '8A' WHEN 1 THEN '2B' ELSE '8B' END AS camelot, CAST(60 + event_id % 120 AS DOUBLE) + 0.5 AS bpm FROM {events}""")
def keybpm_ingest(t: Tables):
    key = F.when(F.col("event_id") % 3 == 0, "Am").when(F.col("event_id") % 3 == 1, "F#").otherwise("8B")
    out = F.concat(F.lit("tool 1.2\r\n"), key, F.lit("\n\n"))
    tempo = F.concat(F.lit("frames 9000 "), (F.col("event_id") % 120 + 60).cast("string"), F.lit(".5 bpm, took 900 ms"))
    return t.events.select("event_id", readers.key_of_output(out).alias("musical_key"), tx.camelot(readers.key_of_output(out)).alias("camelot"), readers.bpm_of_output(tempo).alias("bpm"))


@query("fingerprint_decode")
def fingerprint_decode(t: Tables):
    """Compressed prints of three words, made of digests of the vectors' ids; most are well-formed."""
    raw = F.concat(F.unhex(F.lit("01000003")), F.unhex(F.sha2(F.col("vec_id").cast("string"), 256)))
    return t.embeddings.select("vec_id", acoustic.decode_fingerprint(F.base64(raw)).alias("words"))


@query("merge_acoustic", """SELECT file_id, coalesce(fingerprint, CASE WHEN file_id % 3 = 0 THEN 'new' END) AS fingerprint, CAST(coalesce(bpm, CASE WHEN file_id % 3 = 0 THEN 99.5 END) AS DOUBLE) AS bpm, coalesce(musical_key, CASE WHEN file_id % 3 = 0 THEN 'Dm' END) AS musical_key,
    CASE WHEN file_id % 3 = 0 THEN '7A' END AS camelot, CASE WHEN fingerprint IS NULL AND file_id % 3 = 0 THEN 'FINGERPRINTED' ELSE 'HASHED' END AS status, CASE WHEN file_id % 3 = 0 AND (bpm IS NULL OR musical_key IS NULL) THEN 'COMPUTED' END AS key_bpm_source FROM {tracks}""")
def merge_acoustic(t: Tables):
    audio = t.tracks.select("file_id", "fingerprint", F.lit(None).cast("double").alias("fingerprint_dur"), F.col("bpm").cast("double").alias("bpm"), "musical_key", F.lit(None).cast("string").alias("camelot"), F.lit("HASHED").alias("status"), F.lit(None).cast("string").alias("key_bpm_source"))
    computed = t.tracks.where("file_id % 3 = 0").select("file_id", F.lit("new").alias("fingerprint"), F.lit(1.0).alias("fingerprint_dur"), F.lit(99.5).alias("bpm"), F.lit("Dm").alias("musical_key"), tx.camelot(F.lit("Dm")).alias("camelot")).distinct()
    return acoustic.merge_acoustic(audio, computed).drop("fingerprint_dur")


@query("pending_analysis", "SELECT file_id FROM {tracks} WHERE fingerprint IS NULL OR bpm IS NULL OR musical_key IS NULL")
def pending_analysis(t: Tables):
    return acoustic.pending(t.tracks).select("file_id")


@query("phase_totals", "SELECT count(fingerprint) AS fingerprints, count(bpm) AS bpms, count(musical_key) AS keys, count(*) FILTER (fingerprint IS NULL AND bpm IS NULL AND musical_key IS NULL AND file_id % 2 = 0) AS errors FROM {tracks}")
def phase_totals(t: Tables):
    return acoustic.phase_totals(t.tracks.withColumn("error", F.when(F.col("file_id") % 2 == 0, "failed")))


# --- keys and the reference set --------------------------------------------------------------------------------------
# Wheel codes by pitch class from C.
_WHEEL = "['8B','3B','10B','5B','12B','7B','2B','9B','4B','11B','6B','1B']"
_WHEEL_MINOR = "['5A','12A','7A','2A','9A','4A','11A','6A','1A','8A','3A','10A']"
_NOTES = "['C','C#','D','Eb','E','F','F#','G','Ab','A','Bb','B']"


@query("camelot", f"SELECT p_partkey, {_NOTES}[p_size % 12 + 1] || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' minor' WHEN 2 THEN 'm' ELSE ' Maj.' END AS note, CASE WHEN p_partkey % 4 IN (1, 2) THEN {_WHEEL_MINOR}[p_size % 12 + 1] ELSE {_WHEEL}[p_size % 12 + 1] END AS camelot, {_WHEEL_MINOR}[p_size % 12 + 1] AS reference_camelot FROM {{part}}")
def camelot(t: Tables):
    notes = F.array(*[F.lit(n) for n in ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")])
    base = F.get(notes, F.col("p_size") % 12)
    note = F.concat(base, F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, " minor").when(F.col("p_partkey") % 4 == 2, "m").otherwise(" Maj."))
    return t.part.select("p_partkey", note.alias("note"), tx.camelot(note).alias("camelot"), tx.reference_camelot(base, F.lit("minor")).alias("reference_camelot"))


_VERIFIED = """v AS (SELECT m.file_id, m.mbid, CAST(m.bpm AS DOUBLE) AS bpm, m.camelot, CAST(r.bpm AS DOUBLE) AS ref_bpm, r.camelot AS ref_camelot,
  abs(m.bpm - r.bpm) <= 1.5 OR abs(2 * m.bpm - r.bpm) <= 1.5 OR abs(m.bpm - 2 * r.bpm) <= 1.5 AS bpm_ok, upper(m.camelot) = upper(r.camelot) AS key_ok FROM {measured} m JOIN {reference_set} r ON m.mbid = r.mbid)"""


def _verified(t: Tables):
    double = lambda df: df.withColumn("bpm", F.col("bpm").cast("double"))
    return verify.reference_verify(double(t.measured), double(t.reference_set))


@query("reference_verify", f"WITH {_VERIFIED} SELECT * FROM v")
def reference_verify(t: Tables):
    return _verified(t).select("file_id", "mbid", "bpm", "camelot", "ref_bpm", "ref_camelot", "bpm_ok", "key_ok")


@query("verify_totals", f"WITH {_VERIFIED} SELECT count(*) AS matched, count(*) FILTER (bpm_ok) AS bpm_ok, count(*) FILTER (key_ok) AS key_ok FROM v")
def verify_totals(t: Tables):
    return verify.verify_totals(_verified(t))


@query("reference_import", f"SELECT 'm' || CAST(p_partkey % 1500 AS STRING) AS mbid, min(p_retailprice) AS bpm, 'A' AS key_key, 'minor' AS key_scale, '8A' AS camelot FROM {{part}} WHERE p_partkey % 5 > 0 GROUP BY ALL")
def reference_import(t: Tables):
    ids = F.array(F.concat(F.lit("m"), (F.col("p_partkey") % 1500).cast("string")))
    none = F.lit(None).cast("array<string>")
    tags = F.struct(F.when(F.col("p_partkey") % 5 > 1, ids).otherwise(none).alias("musicbrainz_recordingid"), F.when(F.col("p_partkey") % 5 == 1, ids).otherwise(none).alias("musicbrainz_trackid"))
    raw = F.to_json(F.struct(F.struct(tags.alias("tags")).alias("metadata"), F.struct(F.col("p_retailprice").alias("bpm")).alias("rhythm"), F.struct(F.lit("A").alias("key_key"), F.lit("minor").alias("key_scale")).alias("tonal")))
    return readers.reference_features(t.part.select(F.from_json(raw, schemas.REFERENCE_DOCUMENT).alias("document")))


# --- tag documents and enrichment ------------------------------------------------------------------------------------
@query(
    "map_metadata",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'MPEG 1 Layer 3' ELSE 'MPEG' END AS codec, p_retailprice AS duration_sec, CAST(round(p_retailprice * 100) AS INTEGER) AS bitrate, CASE p_partkey % 3 WHEN 0 THEN 'CBR' WHEN 1 THEN 'VBR' ELSE 'UNKNOWN' END AS bitrate_mode,
    44100 AS sample_rate, 2 AS channels, p_partkey % 4 = 0 AS lossless, p_name AS tag_title, p_brand AS tag_artist, CAST(NULL AS STRING) AS tag_album, CAST(NULL AS STRING) AS tag_album_artist, p_size AS tag_track_no, CAST(NULL AS INTEGER) AS tag_disc_no, 1984 AS tag_year,
    p_type AS tag_genre, CASE WHEN p_partkey % 2 = 0 THEN 'one / two' END AS tag_comment, p_partkey % 2 = 0 AS has_id3v1, true AS has_id3v2, '2.3.0' AS id3v2_version, CAST(NULL AS STRING) AS encoding_guess, p_name AS parsed_title, p_brand AS parsed_artist, CAST(NULL AS INTEGER) AS parsed_track_no FROM {part}""",
)
def map_metadata(t: Tables):
    even = F.col("p_partkey") % 2 == 0
    form = F.struct(
        F.lit("MPEG").alias("container"), F.when(even, "MPEG 1 Layer 3").alias("codec"), F.col("p_retailprice").alias("duration"), (F.col("p_retailprice") * 100).alias("bitrate"), F.lit(44100).alias("sampleRate"), F.lit(2).alias("numberOfChannels"),
        (F.col("p_partkey") % 4 == 0).alias("lossless"), F.when(even, F.array(F.lit("ID3v2.3"), F.lit("ID3v1"))).otherwise(F.array(F.lit("ID3v2.3"))).alias("tagTypes"), F.when(F.col("p_partkey") % 3 == 0, "cbr").when(F.col("p_partkey") % 3 == 1, "V0").alias("codecProfile"),
    )
    common = F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.struct(F.col("p_size").alias("no")).alias("track"), F.lit(1984).alias("year"), F.array("p_type").alias("genre"), F.when(even, F.array(F.lit("one"), F.lit(""), F.lit("two"))).alias("comment"))
    raw = F.to_json(F.struct(form.alias("format"), common.alias("common")))
    return readers.map_metadata(t.part.select("p_partkey", F.concat("p_brand", F.lit(" - "), "p_name", F.lit(".mp3")).alias("filename"), raw.alias("raw"))).drop("filename")


def _lookups(t: Tables):
    rec = lambda i: F.struct(F.concat(F.lit(f"r{i}-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit("Guest").alias("name"))).alias("artists"))
    results = F.array(F.struct((F.col("p_size") / 100.0).alias("score"), F.array(rec(0)).alias("recordings")), F.struct(F.lit(0.25).alias("score"), F.array(rec(1), rec(2)).alias("recordings")))
    status = F.when(F.col("p_partkey") % 10 == 0, "error").otherwise("ok")
    return t.part.select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("query_used"), F.to_json(F.struct(status.alias("status"), results.alias("results"))).alias("raw"))


_BEST = """b AS (SELECT 'q' || CAST(p_partkey AS STRING) AS query_used, CASE WHEN p_size / 100 >= 0.25 THEN 'r0-' ELSE 'r1-' END || CAST(p_partkey AS STRING) AS recording_mbid, p_name AS title, p_brand || ', Guest' AS artist, CAST(greatest(p_size / 100, 0.25) AS DOUBLE) AS score, p_partkey FROM {part} WHERE p_partkey % 10 <> 0)"""


@query("acoustid_best", f"WITH {_BEST} SELECT query_used, recording_mbid, title, artist, score FROM b")
def acoustid_best(t: Tables):
    return enrich.acoustid_best(_lookups(t))


def _recordings(t: Tables):
    key = F.col("p_partkey").cast("string")
    credit = F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.struct(F.lit("Second").alias("name")).alias("artist")).cast("struct<name:string>"))
    rel = lambda kind, w: F.struct(F.lit(kind).alias("type"), F.struct(F.concat(F.lit(w), key).alias("id"), F.col("p_type").alias("title")).alias("work"))
    rels = F.when(F.col("p_partkey") % 3 > 0, F.array(rel("cover", "x"), rel("performance", "w"))).otherwise(F.array(rel("cover", "x")))
    return t.part.select(F.concat(F.lit("r0-"), key).alias("query_used"), F.to_json(F.struct(F.concat(F.lit("r0-"), key).alias("id"), F.col("p_name").alias("title"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("artist-credit"), rels.alias("relations"))).alias("raw"))


@query("mb_works", "SELECT 'r0-' || CAST(p_partkey AS STRING) AS query_used, 'r0-' || CAST(p_partkey AS STRING) AS recording_mbid, p_name AS recording_title, p_brand AS artist, CASE WHEN p_partkey % 3 > 0 THEN 'w' || CAST(p_partkey AS STRING) END AS work_mbid, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS work_title FROM {part}")
def mb_works(t: Tables):
    return enrich.mb_works(_recordings(t))


def _releases(t: Tables):
    one = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("19"), F.lpad((F.col("p_size") % 100).cast("string"), 2, "0"), F.lit(" reissue")).alias("year"), F.array("p_type", "p_brand").alias("genre"), F.array("p_brand", F.lit(" ")).alias("style"))
    return t.part.select(F.col("p_partkey").cast("string").alias("query_used"), F.to_json(F.struct(F.when(F.col("p_partkey") % 4 > 0, F.array(one)).otherwise(F.array().cast("array<struct<id:bigint,title:string,year:string,genre:array<string>,style:array<string>>>")).alias("results"))).alias("raw"))


@query("discogs_albums", "SELECT CAST(p_partkey AS STRING) AS query_used, p_partkey AS discogs_id, p_name AS title, CAST(1900 + p_size % 100 AS INTEGER) AS year, p_type || '|' || p_brand AS genres, p_brand || '| ' AS styles FROM {part} WHERE p_partkey % 4 > 0")
def discogs_albums(t: Tables):
    return enrich.discogs_albums(_releases(t)).withColumns({c: F.array_join(c, "|") for c in ("genres", "styles")})


@query("genre_tags", "SELECT DISTINCT l_orderkey * 100 + l_linenumber AS file_id, unnest([p_type, p_brand]) AS tag, 'discogs' AS source, CAST(0.8 AS DOUBLE) AS confidence FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE p_partkey % 4 > 0")
def genre_tags(t: Tables):
    albums = enrich.discogs_albums(_releases(t)).select(F.col("discogs_id").alias("directory_id"), "genres", "styles")
    return enrich.genre_tags(albums, t.lineitem.select(F.col("l_partkey").alias("directory_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("file_id")))


@query("apply_mb", f"WITH {_BEST} SELECT p.p_partkey AS file_id, coalesce(b.recording_mbid, 'old') AS acoust_id, CASE WHEN b.recording_mbid LIKE 'r0-%' AND p.p_partkey % 3 > 0 THEN 'w' || CAST(p.p_partkey AS STRING) END AS work_mbid, CASE WHEN b.recording_mbid LIKE 'r0-%' AND p.p_partkey % 3 > 0 THEN CAST(0.95 AS DOUBLE) END AS work_confidence FROM {{part}} p LEFT JOIN b ON p.p_partkey = b.p_partkey")
def apply_mb(t: Tables):
    audio = t.part.select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("lookup_key"), F.lit("old").alias("acoust_id"))
    return enrich.apply_recordings(audio, enrich.acoustid_best(_lookups(t)), enrich.mb_works(_recordings(t))).select("file_id", "acoust_id", "work_mbid", "work_confidence")


@query("enrich_totals", "SELECT count(*) AS albums, count(*) FILTER (p_partkey % 10 <> 0) AS acoustid_hits, count(*) FILTER (p_partkey % 3 > 0) AS musicbrainz_hits, count(*) FILTER (p_partkey % 4 > 0) AS discogs_hits FROM {part}")
def enrich_totals(t: Tables):
    return enrich.enrich_totals(t.part, {"acoustid": enrich.acoustid_best(_lookups(t)), "musicbrainz": enrich.mb_works(_recordings(t)).where("work_mbid IS NOT NULL"), "discogs": enrich.discogs_albums(_releases(t))})


@query("latest_response", "SELECT source, query_used, response_id, raw FROM {responses} QUALIFY row_number() OVER (PARTITION BY source, query_used ORDER BY fetched_at DESC, response_id DESC) = 1")
def latest_response(t: Tables):
    return enrich.latest_response(t.responses).select("source", "query_used", "response_id", "raw")


@query("enrich_cache_misses", "SELECT DISTINCT 'click' AS source, CAST(o_custkey AS STRING) AS query_used FROM {orders} WHERE CAST(o_custkey AS STRING) NOT IN (SELECT query_used FROM {responses} WHERE source = 'click')")
def enrich_cache_misses(t: Tables):
    requests = t.orders.select(F.lit("click").alias("source"), F.col("o_custkey").cast("string").alias("query_used"))
    return enrich.cache_misses(requests, t.responses)


@query("enrich_albums", """WITH f AS (SELECT directory_id, file_id, fingerprint FROM {tracks} WHERE fingerprint IS NOT NULL QUALIFY row_number() OVER (PARTITION BY directory_id ORDER BY filename, file_id) = 1)
SELECT o_orderkey AS directory_id, file_id, fingerprint FROM {orders} LEFT JOIN f ON o_orderkey = directory_id WHERE o_orderkey % 3 > 0""")
def enrich_albums(t: Tables):
    dirs = t.orders.select(F.col("o_orderkey").alias("directory_id"), F.when(F.col("o_orderkey") % 3 == 0, "MIXED").when(F.col("o_orderkey") % 3 == 1, "ALBUM").otherwise("ALBUM_RIP").alias("type"))
    return enrich.enrich_albums(dirs, t.tracks.withColumn("rel_path", F.col("filename"))).drop("duration_sec")


_REQUESTS = """al AS (SELECT o_orderkey AS directory_id, 'Album ' || CAST(o_orderkey AS STRING) AS name FROM {orders} WHERE o_orderkey % 3 > 0),
f AS (SELECT directory_id, file_id, fingerprint, artist FROM {tracks} WHERE fingerprint IS NOT NULL QUALIFY row_number() OVER (PARTITION BY directory_id ORDER BY filename, file_id) = 1),
a AS (SELECT al.directory_id, name, file_id, sha256(fingerprint) AS lookup, CASE WHEN file_id % 2 = 0 THEN artist END AS resolved_artist FROM al LEFT JOIN f ON al.directory_id = f.directory_id),
r AS (SELECT 'FINGERPRINT' AS scope, 'ACOUSTID' AS source, file_id AS ref_file_id, NULL AS ref_dir_id, lookup AS query_used FROM a WHERE lookup IS NOT NULL
  UNION ALL SELECT 'FINGERPRINT', 'MUSICBRAINZ', file_id, NULL, 'r' || substr(lookup, 1, 8) FROM a WHERE lookup IS NOT NULL AND file_id % 3 = 0 AND lookup < '8'
  UNION ALL SELECT 'ALBUM', 'DISCOGS', NULL, directory_id, trim(coalesce(resolved_artist, '') || ' ' || name) FROM a)"""


def _requests(t: Tables):
    dirs = t.orders.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("directory_id"), F.concat(F.lit("Album "), F.col("o_orderkey").cast("string")).alias("name"))
    tracks = t.tracks.withColumn("rel_path", F.col("filename"))
    first = enrich.enrich_albums(dirs.withColumn("type", F.lit("ALBUM")), tracks)
    known = tracks.select("directory_id", "file_id", F.when(F.col("file_id") % 3 == 0, F.lit("w")).alias("work_id"), F.when(F.col("file_id") % 2 == 0, F.col("artist")).alias("resolved_artist")).distinct()
    albums = dirs.join(first, "directory_id").join(known, ["directory_id", "file_id"], "left").withColumn("tag_album", F.lit(None).cast("string"))
    digest = F.sha2("fingerprint", 256)
    best = t.tracks.where(F.col("fingerprint").isNotNull() & (digest < "8")).select(digest.alias("query_used"), F.concat(F.lit("r"), F.substring(digest, 1, 8)).alias("recording_mbid")).distinct()
    return enrich.enrich_requests(albums, best)


@query("enrich_requests", f"WITH {_REQUESTS} SELECT DISTINCT * FROM r")
def enrich_requests(t: Tables):
    return _requests(t)


@query("open_requests", f"WITH {_REQUESTS}, c AS (SELECT DISTINCT sha256('fp' || CAST(p_partkey AS STRING)) AS query_used FROM {{part}} WHERE p_partkey % 2 = 0) SELECT DISTINCT r.* FROM r WHERE NOT (source = 'ACOUSTID' AND query_used IN (SELECT query_used FROM c))")
def open_requests(t: Tables):
    cached = t.part.where("p_partkey % 2 = 0").select(F.lit("FINGERPRINT").alias("scope"), F.lit("ACOUSTID").alias("source"), F.sha2(F.concat(F.lit("fp"), F.col("p_partkey").cast("string")), 256).alias("query_used"))
    return enrich.open_requests(_requests(t), cached)
