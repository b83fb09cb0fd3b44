"""Catalogue-shaped views over the star-schema tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Tables whose rows are dealt by a key as they are read, into so many parts: rows without copies, of which a whole split of the file would be held at once otherwise.
#: Up to 200 parts are written without sorting, and all groups by that key, or by more columns, are in one part.
DEALT, PARTS = {"lineitem": "l_orderkey"}, 200

VIEWS = {
    "volumes": """SELECT CAST(n_nationkey AS STRING) AS volume_id, n_name AS label, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'S' || CAST(n_nationkey AS STRING) END AS serial,
        CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE r_name END AS fs_type, CAST(n_nationkey AS BIGINT) * 1000000 AS total_bytes FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    # one probe per customer, of their nation's disk; every seventh is of one of ten unknown disks
    "probes": """SELECT 'p' || CAST(c_custkey AS STRING) AS probe_id, CASE WHEN c_custkey % 7 = 0 THEN 'X' || CAST(c_custkey % 70 AS STRING) ELSE serial END AS serial,
        CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE label END AS label, CASE WHEN c_custkey % 5 = 0 THEN 'named ' || CAST(c_custkey % 10 AS STRING) END AS given_label, fs_type, total_bytes FROM {customer} JOIN {volumes} ON volume_id = CAST(c_nationkey AS STRING)""",
    "page_files": """SELECT page_id AS file_id, CAST(page_id % 2 AS STRING) AS volume_id, CAST(length(html) AS BIGINT) AS size_bytes,
        regexp_extract(url, '://([^/]+/[a-z]+)/', 1) || CASE page_id % 12 WHEN 0 THEN '/Front Cover.JPG' WHEN 1 THEN '/CD1/01 - intro ' || CAST(page_id AS STRING) || '.mp3'
        WHEN 2 THEN '/cd 2/02_Outro_' || CAST(page_id AS STRING) || '.flac' WHEN 3 THEN '/Thumbs.db' WHEN 4 THEN '/.hidden.txt' WHEN 5 THEN '/sheet.cue' WHEN 6 THEN '/03. Song_Name.' || CAST(page_id AS STRING) || '.ogg'
        WHEN 7 THEN '/folder.png' WHEN 8 THEN '/$RECYCLE.BIN/x' || CAST(page_id AS STRING) || '.mp3' WHEN 9 THEN '/A1 - Side ' || CAST(page_id AS STRING) || '.WAV' WHEN 10 THEN '/list.m3u' ELSE '/back-cd.jpeg' END AS rel_path FROM {pages}""",
    "page_dirs": """SELECT DISTINCT volume_id, regexp_replace(rel_path, '/[^/]*$', '') AS dir_path FROM {page_files}""",
    "doc_files": """SELECT doc_id AS file_id, lang AS volume_id, source AS directory_id, text, n_chars AS size_bytes, text AS filename,
        CASE doc_id % 9 WHEN 0 THEN 'IMAGE' WHEN 1 THEN 'CUE' WHEN 2 THEN 'TEXT' ELSE 'AUDIO' END AS file_type, CASE WHEN doc_id % 13 = 0 THEN 'ERROR' ELSE 'HASHED' END AS status FROM {documents}""",
    "tracks": """SELECT l_orderkey AS directory_id, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber AS file_id, p_name AS title, p_brand AS artist, CAST(l_quantity * 60 AS DOUBLE) AS duration_sec,
        CASE WHEN l_partkey % 5 = 0 THEN '' ELSE '0' || CAST(l_linenumber AS STRING) || ' - ' END || p_brand || ' - ' || p_name || CASE WHEN l_partkey % 3 = 0 THEN ' (Official Video)' ELSE '' END || '.mp3' AS filename,
        CASE WHEN l_partkey % 4 = 0 THEN p_name || ' [HD]' WHEN l_partkey % 4 = 1 THEN '  ' END AS tag_title, CASE WHEN l_partkey % 7 = 0 THEN p_type END AS tag_artist, CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber END AS tag_track_no,
        CASE WHEN l_suppkey % 2 = 0 THEN 'fp' || CAST(l_partkey AS STRING) END AS fingerprint, CASE WHEN l_suppkey % 5 = 0 THEN 120.0 + l_linenumber END AS bpm, CASE WHEN l_suppkey % 7 = 0 THEN 'Am' END AS musical_key
        FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM {lineitem}) JOIN {part} ON l_partkey = p_partkey""",
    "titles": """SELECT p_partkey AS file_id, p_brand AS artist, p_name || CASE p_size % 8 WHEN 0 THEN ' (Extended Mix)' WHEN 1 THEN ' - Radio Edit' WHEN 2 THEN ' [Live]' WHEN 3 THEN ' (feat. X) (DJ Remix)'
        WHEN 4 THEN ' - Remastered' WHEN 5 THEN ' {Club Mix}' ELSE '' END AS title, p_size, p_retailprice FROM {part}""",
    "runs": """SELECT event_id AS run_id, CAST(user_id % 25 AS STRING) AS volume_id, CASE event_id % 4 WHEN 0 THEN 'SCAN' WHEN 1 THEN 'FINGERPRINT' WHEN 2 THEN 'ANALYZE' ELSE 'ENRICH' END AS kind,
        CASE WHEN event_type = 'error' OR event_id % 5 = 0 THEN 'RUNNING' ELSE 'COMPLETED' END AS status, ts AS started_at, CASE WHEN event_id % 3 > 0 THEN '/mnt/' || CAST(event_id % 100 AS STRING) END AS mount_path FROM {events}""",
    "responses": """SELECT event_id AS response_id, event_type AS source, CAST(user_id AS STRING) AS query_used, props AS raw, ts AS fetched_at FROM {events}""",
    "measured": """SELECT p_partkey AS file_id, 'm' || CAST(p_partkey AS STRING) AS mbid, 60.0 + p_size * 3 AS bpm, CAST(p_size % 12 + 1 AS STRING) || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS camelot FROM {part}""",
    "reference_set": """SELECT mbid, CASE WHEN file_id % 10 = 0 THEN bpm / 2 WHEN file_id % 10 = 1 THEN bpm + 7 ELSE bpm + 1 END AS bpm, CASE WHEN file_id % 6 = 0 THEN '1A' ELSE lower(camelot) END AS camelot FROM {measured} WHERE file_id % 3 <> 1""",
    "file_tags": """SELECT l.doc_id AS file_id, CASE WHEN quality = 1 THEN 'rock ' || lang ELSE 'noise' END AS tag, CASE WHEN toxic = 1 THEN 'user' ELSE 'discogs' END AS source FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "snapshot_old": """SELECT lang AS volume_id, 'd/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 2 = 0 THEN '.mp3' ELSE '.txt' END AS rel_path, n_chars AS size_bytes, doc_id % 100 AS mtime, CASE WHEN doc_id % 8 > 0 THEN 'h' || CAST(doc_id AS STRING) END AS content_hash,
        CASE doc_id % 4 WHEN 0 THEN 'DISCOVERED' WHEN 1 THEN 'HASHED' WHEN 2 THEN 'METADATA_READ' ELSE 'FINGERPRINTED' END AS status, CAST(1 AS BIGINT) AS first_seen, CAST(1 AS BIGINT) AS last_seen FROM {documents} WHERE doc_id % 10 <> 0""",
    "snapshot_new": """SELECT lang AS volume_id, 'd/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 2 = 0 THEN '.mp3' ELSE '.txt' END AS rel_path, n_chars + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size_bytes, doc_id % 100 + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS mtime FROM {documents} WHERE doc_id % 7 <> 0""",
}


def _expand(sql: str, base) -> str:
    """``sql`` with {names} resolved; views it needs come as common table expressions in order."""
    needed: dict[str, str] = {}

    def resolve(text: str) -> str:
        def one(m: re.Match) -> str:
            name = m[1]
            if name in TABLES:
                return base(name)
            if VIEWS.get(name):
                if name not in needed:
                    body = resolve(VIEWS[name])
                    needed[name] = body
                return name
            return m[0]

        return re.sub(r"\{([a-z_]+)\}", one, text)

    body = resolve(sql)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in needed.items())
    head = re.match(r"\s*WITH\s", body)
    return f"WITH {ctes},\n{body[head.end():]}" if head else f"WITH {ctes}\n{body}"


def for_duckdb(sql: str) -> str:
    return _expand(sql, lambda name: name)


class Tables:
    """Tables and views of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if VIEWS.get(name):
            return self.sql("SELECT * FROM {%s}" % name)
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(_expand(text, self._source))

    def _source(self, name: str) -> str:
        path = f"parquet.`{self.folder}/{name}.parquet`"
        return f"(SELECT /*+ REPARTITION({PARTS}, {DEALT[name]}) */ * FROM {path})" if name in DEALT else path
