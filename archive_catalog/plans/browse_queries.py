"""Queries of search, directory views, statistics and the run log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analyze, browse, cue, snapshot, stats
from ..operators.graph import shared_folder
from ..operators.scratch import Scratch
from ..operators.trigram import TextIndex
from .catalogue import query
from .ingest_queries import _COUNTS, _FILES, _TREE, _counts, _directories, _files
from .names_queries import _CUE, _VERSION, _sheets
from .views import Tables

CAP = 100


def _audio(t: Tables):
    none = F.lit(None).cast("string")
    return t.tracks.withColumn("resolved_title", F.when(F.col("file_id") % 2 == 0, F.col("title"))).withColumn("resolved_artist", none)


_SEARCHABLE = "a AS (SELECT *, CASE WHEN file_id % 2 = 0 THEN title END AS resolved_title FROM {tracks})"


@query("search_audio", f"WITH {_SEARCHABLE} SELECT file_id FROM a WHERE lower(resolved_title) LIKE '%ed%' OR lower(tag_title) LIKE '%ed%' OR lower(tag_artist) LIKE '%ed%'")
def search_audio(t: Tables):
    return browse.search_audio(_audio(t), "Ed").select("file_id")


def _named(t: Tables):
    return t.doc_files.withColumn("filename_lower", F.lower("filename")).withColumn("filename_norm_ascii", tx.title_key_ascii(F.col("filename")))


_FLAT = "strip_accents(trim(regexp_replace(lower(filename), '[-_.\\s]+', ' ', 'g')))"


def _index(t: Tables):
    """The index of the documents' names, built once and used as long as the table's files stay the same."""
    table = t.documents.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    version = table.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("*")))), ","), 256).alias("v")).first()["v"]
    index = TextIndex(t.spark, f"{shared_folder(t.spark)}/names-{version[:32]}")
    if not index.exists():
        files = _named(t)
        audio = F.when(F.col("file_type") == "AUDIO", F.col("filename"))
        browse.index_files(index, files.withColumn("resolved_title", audio))
    return index


@query("search_files", f"SELECT file_id FROM {{doc_files}} WHERE lower(filename) LIKE '%re the%' OR {_FLAT} LIKE '%re the%'")
def search_files(t: Tables):
    return browse.find_files(_index(t), "re the")


_WORDS = ("é", "ou", "ÉA", "|", "ing", "nd the", "à le", "zzqzz")


@query("search_words", " UNION ALL ".join(f"SELECT '{w}' AS q, count(*) FILTER (lower(filename) LIKE '%{w.lower()}%' OR {_FLAT} LIKE '%' || strip_accents('{w.lower()}') || '%') AS names, count(*) FILTER (file_type = 'AUDIO' AND strip_accents(lower(filename)) LIKE '%' || strip_accents('{w.lower()}') || '%') AS audio FROM {{doc_files}}" for w in _WORDS))
def search_words(t: Tables):
    """How many files several searches find, with accents and of one and two letters."""
    index = _index(t)
    one = lambda w: browse.find_files(index, w).agg(F.count("*").alias("names")).crossJoin(browse.find_audio(index, w).agg(F.count("*").alias("audio"))).select(F.lit(w).alias("q"), "names", "audio")  # noqa: E731  one row by one row
    return reduce(lambda x, y: x.unionByName(y), [one(w) for w in _WORDS])


_HITS = f"""audio AS (SELECT file_id, directory_id, filename FROM {{doc_files}} WHERE file_type = 'AUDIO' AND (lower(filename) LIKE '%and%' OR strip_accents(lower(filename)) LIKE '%and%')),
names AS (SELECT file_id, directory_id, filename FROM {{doc_files}} WHERE lower(filename) LIKE '%an%' OR {_FLAT} LIKE '%an%'),
both_hits AS (SELECT 'audio' AS source, file_id, directory_id, filename AS title FROM audio UNION ALL SELECT 'file', file_id, directory_id, filename FROM names WHERE file_id NOT IN (SELECT file_id FROM audio)),
hits AS (SELECT *, (SELECT count(*) FROM both_hits) AS total FROM both_hits ORDER BY source, title, file_id LIMIT {CAP})"""


def _hits(t: Tables):
    """The hits, written once: they are counted, cut and joined."""
    scratch, index, none = Scratch(t.spark, "hits"), _index(t), F.lit(None).cast("string")
    rows = t.doc_files.select("file_id", "directory_id", "filename").withColumns({"resolved_title": F.col("filename"), "tag_title": none})
    audio, files = (scratch.written(found, name) for found, name in ((browse.find_audio(index, "and"), "audio"), (browse.find_files(index, "an"), "files")))
    hits = browse.search_union(rows.join(audio, "file_id", "left_semi"), rows.join(files, "file_id", "left_semi"), CAP)
    return scratch.written(hits, "hits")


@query("search_union", f"WITH {_HITS} SELECT * FROM hits")
def search_union(t: Tables):
    return _hits(t)


@query("search_context", f"""WITH {_HITS}, near AS (SELECT h.file_id, f.filename, f.file_type = 'AUDIO' AS is_audio, row_number() OVER (PARTITION BY h.file_id, f.file_type = 'AUDIO' ORDER BY f.filename, f.file_id) AS k FROM hits h JOIN {{doc_files}} f ON h.directory_id = f.directory_id AND h.file_id <> f.file_id)
SELECT file_id, source, title, coalesce(string_agg(filename, '|' ORDER BY k) FILTER (is_audio), '') AS audio_siblings, coalesce(string_agg(filename, '|' ORDER BY k) FILTER (NOT is_audio), '') AS other_siblings FROM hits LEFT JOIN (SELECT * FROM near WHERE k <= 12) USING (file_id) GROUP BY file_id, source, title""")
def search_context(t: Tables):
    return browse.search_context(_hits(t), t.doc_files).select("file_id", "source", "title", "audio_siblings", "other_siblings")


@query("search_cue", f"WITH {_CUE} SELECT sheet_id, ord, title FROM d WHERE title <> '' AND (lower(title) LIKE '%er%' OR lower(performer) LIKE '%er%') ORDER BY title, sheet_id, ord LIMIT 40")
def search_cue(t: Tables):
    sheets = _sheets(t)
    return browse.search_cue(cue.cue_tracks(sheets), cue.cue_sheets(sheets).select("sheet_id", "file_ref"), "er", 40).select("sheet_id", "ord", "title")


_PLACES = r"""t0 AS (SELECT directory_id, file_id, title AS t_title, coalesce(tag_title, filename) AS title, tag_artist AS artist, row_number() OVER (PARTITION BY directory_id ORDER BY coalesce(tag_track_no, CASE WHEN file_id % 3 = 0 THEN CAST(file_id % 50 AS INTEGER) END, 9999), filename, file_id) AS place FROM {tracks})"""


def _listed(t: Tables):
    none = F.lit(None).cast("string")
    return t.tracks.withColumns({"resolved_title": none, "resolved_artist": none, "parsed_track_no": F.when(F.col("file_id") % 3 == 0, (F.col("file_id") % 50).cast("int"))})


@query("album_tracks", f"WITH {_PLACES} SELECT directory_id, file_id, title, artist, CAST(place AS INTEGER) AS place FROM t0")
def album_tracks(t: Tables):
    return browse.album_tracks(_listed(t))


_COVER = "cov AS (SELECT directory_id, file_id AS cover_id, filename AS cover FROM files WHERE file_type = 'IMAGE' QUALIFY row_number() OVER (PARTITION BY directory_id ORDER BY CASE WHEN lower(filename) LIKE '%front%' THEN 0 WHEN lower(filename) LIKE '%cover%' THEN 1 WHEN lower(filename) LIKE '%folder%' THEN 2 ELSE 4 END, filename, file_id) = 1)"


@query("cover_pick", f"WITH {_TREE}, {_FILES}, {_COVER} SELECT * FROM cov")
def cover_pick(t: Tables):
    return browse.cover_pick(_files(t))


@query("directory_children", f"WITH {_TREE} SELECT parent_id, count(*) AS n_children, string_agg(regexp_extract(rel_path, '([^/]*)$', 1), '|' ORDER BY regexp_extract(rel_path, '([^/]*)$', 1)) AS children FROM dirs WHERE parent_id IS NOT NULL GROUP BY parent_id")
def directory_children(t: Tables):
    return browse.directory_children(_directories(t).withColumn("name", tx.base_name(F.col("rel_path"))))


@query("directory_detail", f"""WITH {_TREE}, {_FILES}, {_COVER}, au AS (SELECT directory_id, count(*) AS n_tracks, string_agg(filename, '|' ORDER BY filename, file_id) AS track_list FROM files WHERE file_type = 'AUDIO' GROUP BY 1),
tg AS (SELECT directory_id, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags FROM files JOIN {{file_tags}} USING (file_id) GROUP BY 1), sh AS (SELECT directory_id, min(file_id) AS sheet_id FROM files WHERE file_type = 'CUE' GROUP BY 1)
SELECT d.directory_id, coalesce(n_tracks, 0) AS n_tracks, coalesce(track_list, '') AS track_list, coalesce(tags, '') AS tags, cover, sheet_id FROM dirs d LEFT JOIN au ON d.directory_id = au.directory_id LEFT JOIN tg ON d.directory_id = tg.directory_id LEFT JOIN cov ON d.directory_id = cov.directory_id LEFT JOIN sh ON d.directory_id = sh.directory_id""")
def directory_detail(t: Tables):
    files = _files(t)
    none = F.lit(None).cast("string")
    audio = files.where("file_type = 'AUDIO'").withColumns({"resolved_title": none, "resolved_artist": none, "tag_title": none, "tag_artist": none, "tag_track_no": none.cast("int"), "parsed_track_no": none.cast("int")})
    sheets = files.where("file_type = 'CUE'").select("directory_id", F.col("file_id").alias("sheet_id"))
    return browse.directory_detail(_directories(t), files, audio, t.file_tags, sheets)


@query("current_mount", """WITH m AS (SELECT CAST(n_nationkey AS STRING) AS name, '/v/' || CAST(n_nationkey AS STRING) AS path FROM {nation} WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_name, '/l/' || n_name FROM {nation} WHERE n_nationkey % 7 = 0),
l AS (SELECT volume_id, mount_path FROM {runs} WHERE mount_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY started_at DESC, run_id DESC) = 1)
SELECT v.volume_id, coalesce(a.path, b.path, mount_path) AS path FROM {volumes} v LEFT JOIN m a ON a.name = v.volume_id LEFT JOIN m b ON b.name = v.label LEFT JOIN l ON l.volume_id = v.volume_id""")
def current_mount(t: Tables):
    ids = t.nation.where("n_nationkey % 5 = 0").select(F.col("n_nationkey").cast("string").alias("name"), F.concat(F.lit("/v/"), F.col("n_nationkey").cast("string")).alias("path"))
    labels = t.nation.where("n_nationkey % 7 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit("/l/"), "n_name").alias("path"))
    return browse.current_mount(t.volumes, ids.unionByName(labels), t.runs)


# --- statistics ------------------------------------------------------------------------------------------------------
@query("stats_by_type", "SELECT file_type, count(*) AS n FROM {doc_files} GROUP BY file_type")
def stats_by_type(t: Tables):
    return stats.by_type(t.doc_files)


@query("stats_overview", f"""WITH {_TREE}, {_FILES}, {_VERSION}, wk AS (SELECT DISTINCT title_norm, artist_norm FROM w)
SELECT (SELECT count(*) FROM {{volumes}}) AS volumes, (SELECT count(*) FROM dirs) AS directories, (SELECT count(*) FROM files) AS files, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM files) AS bytes, count(*) AS audio_files, count(*) FILTER (tracks.file_id % 3 = 0) AS lossless,
count(*) FILTER (duration_sec > 1200) AS needs_split, count(fingerprint) AS fingerprinted, count(musical_key) AS matched, (SELECT count(*) FROM wk) AS works, (SELECT count(*) FROM wk WHERE title_norm LIKE 'a%') AS authoritative FROM {{tracks}} tracks""")
def stats_overview(t: Tables):
    audio = t.tracks.select((F.col("file_id") % 3 == 0).alias("lossless"), (F.col("duration_sec") > 1200).alias("needs_split"), "fingerprint", F.col("musical_key").alias("acoust_id"))
    works = analyze.works(analyze.version_types(t.titles)).withColumn("authoritative", F.col("title_norm").startswith("a"))
    return stats.overview(t.volumes, _directories(t), t.page_files, audio, works)


@query("stats_sources", "SELECT source, count(*) AS n FROM {responses} GROUP BY source")
def stats_sources(t: Tables):
    return stats.responses_by_source(t.responses)


@query("top_genres", "SELECT tag, count(DISTINCT file_id) AS n FROM {file_tags} WHERE source = 'discogs' GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def top_genres(t: Tables):
    return stats.top_genres(t.file_tags)


@query("volume_summary", f"""WITH {_TREE}, {_FILES}, f AS (SELECT volume_id, count(*) AS files, count(*) FILTER (file_type = 'AUDIO') AS audio FROM files GROUP BY 1), d AS (SELECT volume_id, count(*) AS directories, min(directory_id) FILTER (depth = 0) AS root_id FROM dirs GROUP BY 1), r AS (SELECT volume_id, count(*) AS runs FROM {{runs}} GROUP BY 1)
SELECT v.volume_id, v.label, coalesce(files, 0) AS files, coalesce(audio, 0) AS audio, coalesce(directories, 0) AS directories, root_id, coalesce(runs, 0) AS runs FROM {{volumes}} v LEFT JOIN f ON f.volume_id = v.volume_id LEFT JOIN d ON d.volume_id = v.volume_id LEFT JOIN r ON r.volume_id = v.volume_id""")
def volume_summary(t: Tables):
    return stats.volume_summary(t.volumes, _files(t), _directories(t), t.runs)


@query("recent_runs", "SELECT run_id, r.volume_id, label, kind, status, started_at FROM (SELECT * FROM {runs} ORDER BY started_at DESC, run_id DESC LIMIT 10) r LEFT JOIN {volumes} v ON r.volume_id = v.volume_id")
def recent_runs(t: Tables):
    return stats.recent_runs(t.runs, t.volumes)


@query("interrupt_runs", "SELECT run_id, kind, volume_id, CASE WHEN status = 'RUNNING' AND kind = 'SCAN' AND CAST(volume_id AS INTEGER) % 2 = 0 THEN 'INTERRUPTED' ELSE status END AS status FROM {runs}")
def interrupt_runs(t: Tables):
    starting = t.volumes.where("CAST(volume_id AS INT) % 2 = 0").select(F.lit("SCAN").alias("kind"), "volume_id")
    return stats.interrupt_runs(t.runs, starting).select("run_id", "kind", "volume_id", "status")


_SIZE = "CASE file_id % 4 WHEN 0 THEN file_id % 3000 WHEN 1 THEN file_id % 9000000 WHEN 2 THEN file_id % 3000000000 ELSE file_id * 7 END"
_UNIT = "CAST(({0} + {1} // 2) // {1} AS STRING)"
_TENTHS = lambda n, unit: f"CAST(({n} * 10 + {unit} // 2) // {unit} // 10 AS STRING) || '.' || CAST(({n} * 10 + {unit} // 2) // {unit} % 10 AS STRING)"
_HUNDREDTHS = f"CAST((n * 100 + {1 << 29}) // {1 << 30} // 100 AS STRING) || '.' || lpad(CAST((n * 100 + {1 << 29}) // {1 << 30} % 100 AS STRING), 2, '0')"


@query("format_values", f"""WITH s AS (SELECT file_id, duration_sec + file_id % 60 AS d, {_SIZE} AS n FROM {{tracks}})
SELECT file_id, CASE WHEN d > 0 THEN CAST(CAST(floor(d / 60) AS BIGINT) AS STRING) || ':' || lpad(CAST(CAST(d AS BIGINT) % 60 AS STRING), 2, '0') ELSE '' END AS duration,
  CASE WHEN n < 1024 THEN CAST(n AS STRING) || ' B' WHEN n < 1048576 THEN {_UNIT.format('n', 1024)} || ' KB' WHEN n < 1073741824 THEN {_TENTHS('n', 1 << 20)} || ' MB' ELSE {_HUNDREDTHS} || ' GB' END AS size, {_TENTHS('n', 10**9)} || ' GB' AS gigabytes FROM s""")
def format_values(t: Tables):
    rows = t.tracks.select("file_id", (F.col("duration_sec") + F.col("file_id") % 60).alias("d"), F.expr(_SIZE).alias("n"))
    return rows.select("file_id", tx.duration_text(F.col("d")).alias("duration"), tx.bytes_text(F.col("n")).alias("size"), tx.gigabytes(F.col("n")).alias("gigabytes"))


@query("trailing_disc", r"SELECT volume_id, dir_path, CAST(nullif(regexp_extract(dir_path, '[\s._/-](\d{1,2})\s*$', 1), '') AS INTEGER) AS disc_no FROM {page_dirs}")
def trailing_disc(t: Tables):
    """The last number of a directory's name, for sets whose parts are only numbered."""
    return t.page_dirs.select("volume_id", "dir_path", tx.trailing_number(tx.base_name(F.col("dir_path"))).alias("disc_no"))


@query("interrupted_runs", """WITH n AS (SELECT * FROM {runs} ORDER BY started_at DESC, run_id DESC LIMIT 10) SELECT run_id, n.volume_id, label, kind, 'INTERRUPTED' AS status, started_at FROM n LEFT JOIN {volumes} v ON n.volume_id = v.volume_id WHERE status = 'RUNNING' AND kind IN ('SCAN', 'ENRICH')""")
def interrupted_runs(t: Tables):
    """Scans and enrichments start anew on all volumes; what was running of the newest runs."""
    starting = t.volumes.select(F.explode(F.array(F.lit("SCAN"), F.lit("ENRICH"))).alias("kind"), "volume_id")
    return stats.interrupted_runs(stats.interrupt_runs(t.runs, starting), t.volumes)


@query("analyze_summary", f"""WITH n AS (SELECT directory_id, count(*) AS total, count(k) AS numbered, count(DISTINCT k) AS dn, max(k) AS hi FROM (SELECT directory_id, CASE WHEN regexp_matches(filename, '^\\d') THEN file_id % 100 END AS k FROM {{tracks}}) GROUP BY 1)
SELECT (SELECT count(*) FROM {{tracks}}) AS tracks, (SELECT count(*) FROM {{tracks}} WHERE trim(tag_title) <> '') AS from_tags, (SELECT count(*) FROM n WHERE numbered >= 2 AND numbered >= ceil(total * CAST(0.6 AS DOUBLE)) AND dn >= ceil(numbered * CAST(0.8 AS DOUBLE)) AND coalesce(hi, 0) <= greatest(total + 5, total * 2)) AS sequences,
(SELECT count(*) FROM (SELECT DISTINCT title, artist FROM {{tracks}})) AS works""")
def analyze_summary(t: Tables):
    """The whole analysis of a catalogue, in totals: names, sequences and works."""
    sequences = analyze.sequence_flags(t.tracks)
    named = analyze.reconcile(t.tracks, sequences)
    works = analyze.works(analyze.version_types(named.select("file_id", "artist", F.col("resolved_title").alias("title"))))
    totals = named.agg(F.count("*").alias("tracks"), F.count_if(F.col("resolved_source") == "TAG").alias("from_tags"))
    return totals.crossJoin(sequences.agg(F.count_if("has_sequence").alias("sequences"))).crossJoin(works.agg(F.count("*").alias("works")))  # one row by one row
