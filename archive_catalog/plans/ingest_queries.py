"""Queries over sources, snapshots, directories and duplicates by content."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..operators import analyze, dedup, scan_job, snapshot, stats
from ..operators.graph import shared_folder
from ..sources import readers
from ..streaming.ingest import read_table, stream_ingest
from ..streaming.newest import compact, read_newest, stream_newest
from .catalogue import query
from .names_queries import _CLUSTERS, dup_fingerprint
from .views import TABLES, Tables

# --- sources ---------------------------------------------------------------------------------------------------------
_NAME = r"regexp_extract(rel_path, '([^/]*)$', 1)"
_SYSTEM = f"(lower({_NAME}) IN ('thumbs.db', '$recycle.bin') OR {_NAME} LIKE '._%' AND {_NAME} LIKE '.\\_%' ESCAPE '\\')"


@query("file_inventory", f"SELECT volume_id, rel_path, {_NAME} AS name, CAST(len(string_split(rel_path, '/')) - 1 AS INTEGER) AS depth, CASE WHEN rel_path LIKE '%/%' THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '' END AS parent_path FROM {{page_files}} WHERE rel_path NOT LIKE '%$RECYCLE.BIN/%'")
def file_inventory(t: Tables):
    return readers.file_inventory(t.page_files).select("volume_id", "rel_path", "name", "depth", "parent_path")


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, 'sha256' AS hash_algo FROM {documents}")
def content_hash(t: Tables):
    return readers.content_hash(t.documents.select("doc_id", "text"), "text").drop("text")


_OUTSIDE = "[^\\x00-\\x7F" + "".join(sorted(x for x in readers.upper_half("windows-1250") if x > "\x9f")) + "]"


@query("decode_text", f"SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 OR regexp_matches(text, '{_OUTSIDE}') OR NOT regexp_matches(text, '[^\\x00-\\x7F]') THEN 'UTF-8' ELSE 'windows-1250' END AS encoding FROM {{documents}}")
def decode_text(t: Tables):
    """Every second document that the older character set can write comes in it."""
    raw = F.when((F.col("doc_id") % 2 == 0) | F.col("text").rlike(_OUTSIDE), F.encode("text", "UTF-8")).otherwise(readers.encode_text(F.col("text")))
    return readers.decode_text(t.documents.select("doc_id", raw.alias("content"))).select("doc_id", "text", "encoding")


@query("table_sizes")
def table_sizes(t: Tables):
    return readers.table_sizes(t.spark, t.folder, TABLES)


@query("sanitize_text", "SELECT doc_id, text, lang, source, n_chars FROM {documents}")
def sanitize_text(t: Tables):
    """NUL characters are put in and taken out again."""
    dirty = t.documents.withColumn("text", F.concat(F.lit("\x00"), "text", F.lit("\x00"))).withColumn("source", F.concat("source", F.lit("\x00")))
    return snapshot.sanitize(dirty)


@query("mojibake", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR regexp_matches(text, '[Â-Å][\u0080-ɏ]') THEN 'suspected-mojibake' END AS flag FROM {documents}")
def mojibake(t: Tables):
    tag = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("Ä\u0099")))
    return t.documents.select("doc_id", tx.mojibake(tag, F.col("text")).alias("flag"))


@query("walk_order", f"SELECT volume_id, rel_path FROM {{page_files}} WHERE rel_path NOT LIKE '%$RECYCLE.BIN/%' ORDER BY volume_id, string_split(rel_path, '/')")
def walk_order(t: Tables):
    return readers.file_inventory(t.page_files).orderBy("volume_id", readers.walk_order()).select("volume_id", "rel_path")


# --- names of files --------------------------------------------------------------------------------------------------
_EXT = f"lower(regexp_extract({_NAME}, '^.+\\.([^.]*)$', 1))"
_TYPE = f"CASE WHEN lower({_NAME}) = 'thumbs.db' THEN 'SYSTEM' WHEN {_EXT} IN ('mp3', 'flac', 'ogg', 'wav') THEN 'AUDIO' WHEN {_EXT} = 'cue' THEN 'CUE' WHEN {_EXT} = 'm3u' THEN 'PLAYLIST' WHEN {_EXT} IN ('jpg', 'jpeg', 'png') THEN 'IMAGE' WHEN {_EXT} = 'txt' THEN 'TEXT' ELSE 'OTHER' END"
_ROLE = f"CASE WHEN {_EXT} NOT IN ('jpg', 'jpeg', 'png') THEN NULL WHEN lower({_NAME}) LIKE '%front%' THEN 'front' WHEN lower({_NAME}) LIKE '%back%' THEN 'back' WHEN lower({_NAME}) LIKE '%folder%' THEN 'folder' END"
_STEM = f"lower(regexp_replace({_NAME}, '(.)\\.[^.]*$', '\\1'))"
_LEAD = r"'^\s*\d{1,3}\s*[-._)]+\s*'"
_KEY = rf"trim(regexp_replace(CASE WHEN regexp_matches({_STEM}, {_LEAD}) THEN regexp_replace({_STEM}, {_LEAD}, '') ELSE regexp_replace({_STEM}, '^\s*[a-h]\s*[1-9]\d?\s*[-._)]+\s*', '') END, '[-_.\s]+', ' ', 'g'))"


@query("file_record", f"SELECT rel_path, {_NAME} AS filename, {_EXT} AS extension, lower({_NAME}) AS filename_lower, {_KEY} AS filename_norm, {_KEY} AS filename_norm_ascii, {_TYPE} AS file_type, {_NAME} LIKE '.%' OR lower({_NAME}) = 'thumbs.db' AS is_hidden, lower({_NAME}) = 'thumbs.db' AS is_system, {_ROLE} AS cover_role FROM {{page_files}}")
def file_record(t: Tables):
    return snapshot.file_record(t.page_files)


@query("classify_files", f"SELECT {_TYPE} AS file_type, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM {{page_files}} GROUP BY 1")
def classify_files(t: Tables):
    return t.page_files.groupBy(tx.file_type(F.col("rel_path")).alias("file_type")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query("cover_role", f"SELECT file_id, {_ROLE} AS cover_role FROM {{page_files}} WHERE {_TYPE} = 'IMAGE'")
def cover_role(t: Tables):
    return t.page_files.where(tx.file_type(F.col("rel_path")) == "IMAGE").select("file_id", tx.cover_role(F.col("rel_path")).alias("cover_role"))


# --- snapshots -------------------------------------------------------------------------------------------------------
@query(
    "scan_delta",
    """WITH j AS (SELECT n.*, o.volume_id IS NULL AS is_new, o.volume_id IS NOT NULL AND (n.size_bytes <> o.size_bytes OR n.mtime <> o.mtime) AS changed, o.content_hash, n.rel_path LIKE '%.mp3' AS is_audio,
      CASE o.status WHEN 'HASHED' THEN 1 WHEN 'METADATA_READ' THEN 2 WHEN 'FINGERPRINTED' THEN 3 ELSE 0 END AS old_rank FROM {snapshot_new} n LEFT JOIN {snapshot_old} o ON n.volume_id = o.volume_id AND n.rel_path = o.rel_path),
    k AS (SELECT *, is_new OR changed OR content_hash IS NULL AS need_hash, is_audio AND (is_new OR changed OR old_rank < 2) AS need_meta FROM j),
    r AS (SELECT *, CASE WHEN need_meta THEN 2 WHEN need_hash THEN 1 ELSE 0 END AS reached FROM k)
    SELECT volume_id, rel_path, size_bytes, mtime, is_new, changed, need_hash, need_meta, ['DISCOVERED', 'HASHED', 'METADATA_READ', 'FINGERPRINTED'][1 + CASE WHEN is_new OR changed THEN reached ELSE greatest(reached, old_rank) END] AS status FROM r""",
)
def scan_delta(t: Tables):
    return snapshot.scan_delta(t.snapshot_new, t.snapshot_old)


_UPSERT = """SELECT coalesce(n.volume_id, o.volume_id) AS volume_id, coalesce(n.rel_path, o.rel_path) AS rel_path, coalesce(n.size_bytes, o.size_bytes) AS size_bytes, coalesce(n.mtime, o.mtime) AS mtime, coalesce(o.first_seen, 2) AS first_seen,
    CASE WHEN n.rel_path IS NOT NULL THEN 2 ELSE o.last_seen END AS last_seen FROM {snapshot_new} n FULL JOIN {snapshot_old} o ON n.volume_id = o.volume_id AND n.rel_path = o.rel_path"""


@query("snapshot_upsert", _UPSERT.replace("coalesce(o.first_seen, 2)", "CAST(coalesce(o.first_seen, 2) AS BIGINT)").replace("CASE WHEN n.rel_path IS NOT NULL THEN 2 ELSE o.last_seen END", "CAST(CASE WHEN n.rel_path IS NOT NULL THEN 2 ELSE o.last_seen END AS BIGINT)"))
def snapshot_upsert(t: Tables):
    return snapshot.snapshot_upsert(t.snapshot_old.drop("content_hash", "status"), t.snapshot_new, F.lit(2).cast("long"))


@query("insert_ignore", "SELECT volume_id, rel_path, size_bytes FROM {snapshot_old} UNION ALL SELECT volume_id, rel_path, size_bytes FROM {snapshot_new} n WHERE NOT EXISTS (SELECT 1 FROM {snapshot_old} o WHERE o.volume_id = n.volume_id AND o.rel_path = n.rel_path)")
def insert_ignore(t: Tables):
    cols = ["volume_id", "rel_path", "size_bytes"]
    new = t.snapshot_new.select(*cols)
    return snapshot.insert_ignore(t.snapshot_old.select(*cols), new.unionByName(new), ["volume_id", "rel_path"])


@query("cue_tracks_replace", "SELECT conv_id AS sheet_id, turn AS ord, role AS title FROM {conversations} WHERE conv_id % 3 <> 0 UNION ALL SELECT conv_id, turn + 100, 'new' FROM {conversations} WHERE conv_id % 3 = 0")
def cue_tracks_replace(t: Tables):
    old = t.conversations.select(F.col("conv_id").alias("sheet_id"), F.col("turn").alias("ord"), F.col("role").alias("title"))
    new = old.where("sheet_id % 3 = 0").select("sheet_id", (F.col("ord") + 100).alias("ord"), F.lit("new").alias("title"))
    return snapshot.replace_children(old, new, "sheet_id")


_LISTED = lambda names: ", ".join(f"'{n}'" for n in names)


@query(
    "integrity_report",
    f"""SELECT * FROM (SELECT 'unique' AS rule, 'lines(l_orderkey,l_linenumber)' AS subject, CAST(sum(n - 1) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) WHERE n > 1
    UNION ALL SELECT 'foreign', 'lines.l_orderkey', count(*) FROM {{lineitem}} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {{orders}})
    UNION ALL SELECT 'foreign', 'snapshot.rel_path', count(*) FROM {{snapshot_new}} WHERE rel_path NOT IN (SELECT rel_path FROM {{snapshot_old}})
    UNION ALL SELECT 'enum', 'files.file_type', count(*) FROM (SELECT CASE WHEN file_id % 40 = 0 THEN 'VIDEO' ELSE file_type END AS file_type FROM {{doc_files}}) WHERE file_type NOT IN ({_LISTED(schemas.FILE_TYPES)})
    UNION ALL SELECT 'enum', 'snapshot.status', count(*) FROM {{snapshot_old}} WHERE status NOT IN ({_LISTED(schemas.STATUSES)})
    UNION ALL SELECT 'enum', 'runs.status', count(*) FROM (SELECT CASE WHEN run_id % 50 = 0 THEN 'PAUSED' ELSE status END AS status FROM {{runs}}) WHERE status NOT IN ({_LISTED(schemas.RUN_STATUSES)})
    UNION ALL SELECT 'range', 'customers.c_acctbal', count(*) FROM {{customer}} WHERE c_acctbal < 0) WHERE violations > 0""",
)
def integrity_report(t: Tables):
    files = t.doc_files.withColumn("file_type", F.when(F.col("file_id") % 40 == 0, "VIDEO").otherwise(F.col("file_type")))
    runs = t.runs.withColumn("status", F.when(F.col("run_id") % 50 == 0, "PAUSED").otherwise(F.col("status")))
    return snapshot.integrity_report(
        {"lines": t.lineitem, "orders": t.orders, "snapshot": t.snapshot_new, "old": t.snapshot_old, "files": files, "runs": runs, "customers": t.customer, "groups": dup_exact(t), "directories": directory_types(t)},
        {"lines": ["l_orderkey", "l_linenumber"]}, [("lines", "l_orderkey", "orders", "o_orderkey"), ("snapshot", "rel_path", "old", "rel_path")],
        [("files", "file_type", schemas.FILE_TYPES), ("old", "status", schemas.STATUSES), ("runs", "status", schemas.RUN_STATUSES), ("groups", "kind", schemas.DUPLICATE_KINDS), ("directories", "type", schemas.DIRECTORY_TYPES)],
        [("customers", "c_acctbal")],
    )


_ARRIVED = "SELECT volume_id, rel_path, size_bytes, mtime, CAST(2 AS BIGINT) AS seq FROM {snapshot_new} UNION ALL SELECT volume_id, rel_path, size_bytes, mtime, CAST(1 AS BIGINT) FROM {snapshot_old}"


@query("stream_ingest", f"SELECT * FROM ({_ARRIVED}) QUALIFY row_number() OVER (PARTITION BY volume_id, rel_path ORDER BY seq DESC) = 1")
def stream_ingest_query(t: Tables):
    """The snapshots arrive as files and are upserted by a stream; the table after the last batch."""
    base = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    t.snapshot_new.withColumn("seq", F.lit(2).cast("long")).unionByName(t.snapshot_old.select("volume_id", "rel_path", "size_bytes", "mtime").withColumn("seq", F.lit(1).cast("long"))).repartitionByRange(4, "seq", "rel_path").write.parquet(f"{base}/in")
    arriving = t.spark.read.parquet(f"{base}/in").schema
    schema = t.spark.read.parquet(f"{base}/in").withColumn("first_seen", F.lit(0).cast("long")).withColumn("last_seen", F.lit(0).cast("long")).schema
    q = stream_ingest(t.spark, f"{base}/in", arriving, f"{base}/table", schema, f"{base}/state", ["volume_id", "rel_path"], "seq")
    q.awaitTermination()
    return read_table(t.spark, f"{base}/table", schema).select("volume_id", "rel_path", "size_bytes", "mtime", "seq")


@query(
    "stream_newest",
    f"SELECT volume_id, rel_path, CAST(max(CASE WHEN seq = top THEN size_bytes END) AS BIGINT) AS size_bytes, CAST(max(CASE WHEN seq = top THEN mtime END) AS BIGINT) AS mtime, max(seq) AS seq, min(seq) AS first_seen, max(seq) AS last_seen FROM (SELECT *, max(seq) OVER (PARTITION BY volume_id, rel_path) AS top FROM ({_ARRIVED})) GROUP BY volume_id, rel_path",
)
def stream_newest_query(t: Tables):
    """The newer manifest comes first, the older one late, and the newer one again; a second query on the same checkpoint takes the rest, then the table is compacted."""
    base = f"{shared_folder(t.spark)}/newest-{uuid.uuid4().hex}"
    key, columns = ["volume_id", "rel_path"], ["volume_id", "rel_path", "size_bytes", "mtime"]
    new = t.snapshot_new.select(*columns, F.lit(2).cast("long").alias("seq"))
    old = t.snapshot_old.select(*columns, F.lit(1).cast("long").alias("seq"))
    for i, rows in enumerate((new, old, new)):
        rows.write.mode("append").parquet(f"{base}/in")
        if i:
            stream_newest(t.spark, f"{base}/in", rows.schema, f"{base}/table", f"{base}/state", key, "seq", 64).awaitTermination()
    compact(t.spark, f"{base}/table", new.schema, key, "seq")
    return read_newest(t.spark, f"{base}/table", new.schema, key, "seq")


# --- directories -----------------------------------------------------------------------------------------------------
_TREE = """p AS (SELECT DISTINCT volume_id, string_split(rel_path, '/') AS parts FROM {page_files}),
e AS (SELECT DISTINCT volume_id, unnest([list_slice(parts, 1, k) FOR k IN range(0, len(parts))]) AS d FROM p),
tree AS (SELECT volume_id, array_to_string(d, '/') AS rel_path, CAST(len(d) AS INTEGER) AS depth, CASE WHEN len(d) > 0 THEN array_to_string(list_slice(d, 1, len(d) - 1), '/') END AS parent_path FROM e),
dirs AS (SELECT *, sha256(volume_id || chr(1) || rel_path) AS directory_id, CASE WHEN parent_path IS NOT NULL THEN sha256(volume_id || chr(1) || parent_path) END AS parent_id FROM tree)"""
_FILES = f"""files AS (SELECT *, sha256(volume_id || chr(1) || CASE WHEN rel_path LIKE '%/%' THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '' END) AS directory_id, {_TYPE} AS file_type, {_NAME} AS filename FROM {{page_files}})"""


def _directories(t: Tables):
    return snapshot.with_parent(snapshot.directory_tree(t.page_files))


def _files(t: Tables):
    name = tx.base_name(F.col("rel_path"))
    return snapshot.file_directory(t.page_files, _directories(t)).withColumn("file_type", tx.file_type(name)).withColumn("filename", name)


def _counts(t: Tables):
    return snapshot.directory_counts(_directories(t), _files(t))


_COUNTS = "counts AS (SELECT d.*, count(f.directory_id) AS file_count, count(*) FILTER (f.file_type = 'AUDIO') AS audio_count, coalesce(bool_or(f.file_type = 'CUE'), false) AS has_cue FROM dirs d LEFT JOIN files f ON d.directory_id = f.directory_id GROUP BY ALL)"


@query("directory_tree", f"WITH {_TREE} SELECT * FROM dirs")
def directory_tree(t: Tables):
    return _directories(t)


@query("file_directory", f"WITH {_TREE}, {_FILES} SELECT file_id, directory_id FROM files")
def file_directory(t: Tables):
    return _files(t).select("file_id", "directory_id")


@query("directory_counts", f"WITH {_TREE}, {_FILES}, {_COUNTS} SELECT directory_id, file_count, audio_count, has_cue FROM counts")
def directory_counts(t: Tables):
    return _counts(t).select("directory_id", "file_count", "audio_count", "has_cue")


@query(
    "subtree_totals",
    f"""WITH {_TREE}, {_FILES}, below AS (SELECT a.directory_id AS top, a.depth AS top_depth, b.directory_id, b.depth FROM dirs a JOIN dirs b ON a.volume_id = b.volume_id AND (a.rel_path = '' OR b.rel_path = a.rel_path OR starts_with(b.rel_path, a.rel_path || '/'))),
    d AS (SELECT top AS directory_id, count(*) AS tree_directories, CAST(max(depth) - max(top_depth) AS INTEGER) AS height FROM below GROUP BY top),
    n AS (SELECT top AS directory_id, count(*) AS tree_files, count(*) FILTER (file_type = 'AUDIO') AS tree_audio, CAST(sum(size_bytes) AS BIGINT) AS tree_bytes FROM below JOIN files USING (directory_id) GROUP BY top)
    SELECT d.directory_id, coalesce(tree_files, 0) AS tree_files, coalesce(tree_audio, 0) AS tree_audio, coalesce(tree_bytes, 0) AS tree_bytes, tree_directories, height FROM d LEFT JOIN n ON d.directory_id = n.directory_id""",
)
def subtree_totals(t: Tables):
    return snapshot.subtree_totals(_directories(t), _files(t))


_DISCS = r"""discs AS (SELECT parent_id, directory_id, CASE WHEN regexp_extract(rel_path, '([^/]*)$', 1) = 'CD1' THEN 1 WHEN regexp_extract(rel_path, '([^/]*)$', 1) = 'cd 2' THEN 2 END AS disc_no FROM dirs),
md AS (SELECT parent_id, count(disc_no) >= 2 AND count(DISTINCT disc_no) >= 2 AS parent_is_multidisc FROM discs WHERE parent_id IS NOT NULL GROUP BY parent_id)"""


def _discs(t: Tables):
    return analyze.multidisc(_directories(t).where("parent_id IS NOT NULL").select("parent_id", "directory_id", tx.base_name(F.col("rel_path")).alias("name")))


@query("multidisc", f"WITH {_TREE}, {_DISCS} SELECT d.parent_id, d.directory_id, CAST(d.disc_no AS INTEGER) AS disc_no, parent_is_multidisc FROM discs d JOIN md ON d.parent_id = md.parent_id")
def multidisc(t: Tables):
    return _discs(t)


_RIP = "rips AS (SELECT DISTINCT directory_id FROM files WHERE file_type = 'AUDIO' AND file_id % 5 = 0 AND directory_id IN (SELECT directory_id FROM counts WHERE audio_count <= 2))"


def _rips(t: Tables):
    audio = _files(t).where("file_type = 'AUDIO'").withColumn("duration_sec", F.lit(2000.0))
    return analyze.rip_flags(audio, _counts(t), audio.where("file_id % 5 = 0"))


@query("directory_types", f"""WITH {_TREE}, {_FILES}, {_COUNTS}, {_DISCS}, {_RIP}, kids AS (SELECT parent_id, count(*) AS child_count FROM dirs WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT c.directory_id, CASE WHEN m.parent_is_multidisc THEN 'MULTIDISC_PARENT' WHEN x.disc_no IS NOT NULL AND up.parent_is_multidisc THEN 'MULTIDISC_CHILD' WHEN r.directory_id IS NOT NULL THEN 'ALBUM_RIP'
  WHEN audio_count = 0 THEN CASE WHEN coalesce(child_count, 0) > 0 THEN 'UNKNOWN' WHEN file_count > 0 THEN 'NON_AUDIO' ELSE 'UNKNOWN' END WHEN coalesce(child_count, 0) > 0 THEN 'MIXED' ELSE 'ALBUM' END AS type
FROM counts c LEFT JOIN kids k ON c.directory_id = k.parent_id LEFT JOIN md m ON c.directory_id = m.parent_id LEFT JOIN discs x ON c.directory_id = x.directory_id LEFT JOIN md up ON c.parent_id = up.parent_id LEFT JOIN rips r ON c.directory_id = r.directory_id""")
def directory_types(t: Tables):
    return analyze.directory_types(_counts(t), _discs(t), _rips(t)).select("directory_id", "type")


@query("rip_flags", f"WITH {_TREE}, {_FILES}, {_COUNTS} SELECT f.file_id, f.file_id % 5 = 0 AND audio_count <= 2 AS is_album_rip, f.file_id % 5 = 0 AND audio_count <= 2 AS needs_split FROM files f JOIN counts c ON f.directory_id = c.directory_id WHERE f.file_type = 'AUDIO'")
def rip_flags(t: Tables):
    return _rips(t).select("file_id", "is_album_rip", "needs_split")


@query("run_counters", "SELECT count(DISTINCT directory_id) AS dirs_seen, count(*) AS files_seen, count(*) FILTER (file_type = 'AUDIO') AS audio_seen, count(*) FILTER (status = 'ERROR') AS errors, CAST(sum(size_bytes) AS BIGINT) AS bytes_seen FROM {doc_files}")
def run_counters(t: Tables):
    return snapshot.run_counters(t.doc_files)


# --- volumes ---------------------------------------------------------------------------------------------------------
_MATCH = """m AS (SELECT p.*, CASE WHEN p.serial IS NOT NULL THEN a.volume_id ELSE b.volume_id END AS matched_id FROM {probes} p LEFT JOIN {volumes} a ON p.serial = a.serial
  LEFT JOIN {volumes} b ON p.serial IS NULL AND b.serial IS NULL AND p.label = b.label AND p.total_bytes = b.total_bytes AND p.fs_type IS NOT DISTINCT FROM b.fs_type)"""


@query("volume_match", f"WITH {_MATCH} SELECT probe_id, matched_id FROM m")
def volume_match(t: Tables):
    return snapshot.volume_match(t.probes, t.volumes).select("probe_id", "matched_id")


_LAST = "(SELECT {0} FROM m n WHERE {1} AND {0} IS NOT NULL ORDER BY n.probe_id DESC LIMIT 1)"
_NEW = "(n.serial = f.serial OR f.serial IS NULL AND n.serial IS NULL AND n.matched_id IS NULL AND (n.probe_id = f.probe_id OR n.label = f.label AND n.total_bytes = f.total_bytes AND n.fs_type IS NOT DISTINCT FROM f.fs_type))"
_NAMED = "coalesce(n.given_label, n.label, 'UNNAMED')"


@query("register_volumes", f"""WITH {_MATCH}, f AS (SELECT * FROM m WHERE matched_id IS NULL QUALIFY row_number() OVER (PARTITION BY serial, CASE WHEN serial IS NULL THEN coalesce(label || '|' || total_bytes || '|' || coalesce(fs_type, '-'), probe_id) END ORDER BY probe_id) = 1)
SELECT volume_id, coalesce({_LAST.format(_NAMED, 'n.matched_id = v.volume_id')}, label) AS label, serial, coalesce({_LAST.format('n.fs_type', 'n.matched_id = v.volume_id')}, fs_type) AS fs_type, coalesce({_LAST.format('n.total_bytes', 'n.matched_id = v.volume_id')}, total_bytes) AS total_bytes FROM {{volumes}} v
UNION ALL SELECT probe_id, {_LAST.format(_NAMED, _NEW)}, serial, {_LAST.format('n.fs_type', _NEW)}, {_LAST.format('n.total_bytes', _NEW)} FROM f""")
def register_volumes(t: Tables):
    return snapshot.register_volumes(t.probes, t.volumes)


# --- one scan as a whole ---------------------------------------------------------------------------------------------
@query("scan_job", """WITH n AS (SELECT * FROM {snapshot_new}), o AS (SELECT * FROM {snapshot_old})
SELECT (SELECT count(DISTINCT volume_id) FROM n) AS dirs_seen, count(*) AS files_seen, count(*) FILTER (n.rel_path LIKE '%.mp3') AS audio_seen, count(*) FILTER (n.size_bytes % 19 = 0) AS errors, CAST(sum(n.size_bytes) AS BIGINT) AS bytes_seen,
  (SELECT count(*) FROM n FULL JOIN o ON n.volume_id = o.volume_id AND n.rel_path = o.rel_path) AS files, count(*) FILTER (o.rel_path IS NULL OR n.size_bytes <> o.size_bytes OR n.mtime <> o.mtime OR o.content_hash IS NULL) AS hashed,
  (SELECT count(DISTINCT volume_id) * 2 FROM n) AS directories FROM n LEFT JOIN o ON n.volume_id = o.volume_id AND n.rel_path = o.rel_path""")
def scan_job_query(t: Tables):
    """Two scans of the snapshots, the second on the tables of the first: its counters and what the tables hold."""
    key = ["volume_id", "rel_path"]
    old = t.snapshot_old.withColumns({"filename": F.lit(None).cast("string"), "extension": F.lit(None).cast("string"), "filename_norm": F.lit(None).cast("string"), "file_type": F.lit(None).cast("string"), "is_hidden": F.lit(False), "directory_id": F.lit(None).cast("string"), "file_id": F.lit(None).cast("string")})
    digests = snapshot.scan_delta(t.snapshot_new, t.snapshot_old).where("need_hash").select(*key, F.lit("fresh").alias("content_hash"))
    out = scan_job.scan(t.snapshot_new, old, F.lit(2).cast("long"), digests, t.snapshot_new.where("size_bytes % 19 = 0"))
    totals = out.files.agg(F.count("*").alias("files"), F.count_if(F.col("content_hash") == "fresh").alias("hashed"))
    return out.counters.crossJoin(totals).crossJoin(out.directories.agg(F.count("*").alias("directories")))  # one row by one row


# --- duplicates by content -------------------------------------------------------------------------------------------
_EXACT = "g AS (SELECT sha256(text) AS h, min(doc_id) AS group_id, count(*) AS n_members FROM {documents} GROUP BY 1 HAVING count(*) >= 2), x AS (SELECT 'EXACT_HASH' AS kind, group_id, doc_id AS file_id, n_members FROM {documents} JOIN g ON sha256(text) = h)"


@query("dup_exact", f"WITH {_EXACT} SELECT kind, group_id, file_id, n_members FROM x")
def dup_exact(t: Tables):
    return dedup.exact(readers.content_hash(t.documents.select(F.col("doc_id").alias("file_id"), "text"), "text"))


_FUZZY = r"k AS (SELECT doc_id AS file_id, trim(regexp_replace(lower(text), '[-_.\s]+', ' ', 'g')) AS key FROM {documents}), h AS (SELECT key, min(file_id) AS group_id, count(*) AS n_members FROM k WHERE key <> '' GROUP BY key HAVING count(*) >= 2), y AS (SELECT 'FUZZY_NAME' AS kind, group_id, file_id, n_members FROM k JOIN h USING (key))"


_SOUND = _CLUSTERS.replace("SELECT 'AUDIO_FINGERPRINT'", "z AS (SELECT 'AUDIO_FINGERPRINT'") + ")"
_ALL = f"WITH RECURSIVE {_SOUND.removeprefix('WITH RECURSIVE ')}, {_EXACT}, {_FUZZY}, u AS (SELECT *, group_id % 1000 AS created_at FROM (SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT kind, group_id, file_id, n_members FROM z))"


def _groups(t: Tables, kinds: tuple[str, ...] = schemas.DUPLICATE_KINDS):
    """Duplicates of the kinds asked for; no other is made."""
    makers = {
        "EXACT_HASH": lambda: dup_exact(t), "FUZZY_NAME": lambda: dedup.group_by_key(t.documents, tx.title_key(F.col("text")), "FUZZY_NAME", "doc_id"),
        "AUDIO_FINGERPRINT": lambda: dup_fingerprint(t),
    }
    rows = [make() for kind, make in makers.items() if kind in kinds]
    return reduce(lambda x, y: x.unionByName(y), rows).withColumn("created_at", F.col("group_id") % 1000)


_REPORT = "SELECT kind, group_id, count(*) AS n_members, count(DISTINCT lang) AS n_volumes, CAST(sum(n_chars) AS BIGINT) AS total_bytes FROM u JOIN top USING (kind, group_id) JOIN {documents} ON file_id = doc_id GROUP BY kind, group_id"
_TOP = "top AS (SELECT DISTINCT kind, group_id, created_at FROM u {0} ORDER BY created_at DESC, kind, group_id LIMIT {1})"


_DISKS = "SELECT DISTINCT lang AS volume_id, 'Disk ' || upper(lang) AS label FROM {documents} WHERE lang IS NOT NULL"
_MEMBERS = f"""m AS (SELECT kind, group_id, file_id, lang, text, n_chars, source || '/' || CAST(doc_id AS STRING) AS rel_path FROM u JOIN top USING (kind, group_id) JOIN {{documents}} ON file_id = doc_id),
s AS (SELECT kind, group_id, count(*) AS n_members, count(DISTINCT lang) AS n_volumes, CAST(sum(n_chars) AS BIGINT) AS total_bytes FROM m GROUP BY kind, group_id)
SELECT kind, group_id, n_members, n_volumes, total_bytes, file_id, text AS filename, rel_path, n_chars AS size_bytes, label AS volume_label FROM m JOIN s USING (kind, group_id) LEFT JOIN ({_DISKS}) v ON lang = v.volume_id"""


@query("duplicate_report", f"{_ALL}, {_TOP.format('', 200)}, {_MEMBERS}")
def duplicate_report(t: Tables):
    files = t.sql("SELECT file_id, volume_id, filename, size_bytes, directory_id || '/' || CAST(file_id AS STRING) AS rel_path FROM {doc_files}")
    return dedup.report_members(_groups(t), files, t.sql(_DISKS))


_ONE_KIND = "WHERE kind = 'FUZZY_NAME'"


@query("duplicate_report_by_kind", f"{_ALL}, {_TOP.format(_ONE_KIND, 20)} {_REPORT}")
def duplicate_report_by_kind(t: Tables):
    return dedup.report(_groups(t, ("FUZZY_NAME",)), t.doc_files.select("file_id", "volume_id", "size_bytes"), 20, "FUZZY_NAME")


@query("stats_dups", f"{_ALL} SELECT kind, count(DISTINCT group_id) AS n_groups FROM u GROUP BY kind")
def stats_dups(t: Tables):
    return stats.duplicates_by_kind(_groups(t))


@query("scoped_pass", "SELECT doc_id AS file_id, sha256(text) AS content_hash FROM {documents} WHERE lang = 'en'")
def scoped_pass(t: Tables):
    """A per-file pass on one volume."""
    return readers.content_hash(t.doc_files.where("volume_id = 'en'"), "text").select("file_id", "content_hash")
