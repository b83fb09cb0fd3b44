"""Sources: inventories, raw bytes, tag documents, tool output and reference dumps as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx

MAX_DEPTH = 64
#: What a tool prints when it fails leaves one of the two fields empty.
_DURATION, _FINGERPRINT = r"(?m)^DURATION=(.+?)\s*$", r"(?m)^FINGERPRINT=(.+?)\s*$"


def read_manifest(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A listing (volume_id, rel_path, is_dir, size_bytes, mtime, ctime) taken on the machine that holds the disk."""
    reader = spark.read.schema(schemas.MANIFEST)
    return reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)


def file_inventory(manifest: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Entries down to ``max_depth``, without what lies below a system directory; name, depth and parent added."""
    parts = F.split("rel_path", "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    # the whole path is searched before its parts are looked at one by one
    suspect = F.lower(F.col("rel_path")).rlike(r"(^|/)(thumbs\.db|desktop\.ini|\.ds_store|\$recycle\.bin|system volume information|\.trashes|\.localized|\._|\.spotlight-|\.fseventsd|\.temporaryitems|\.apdisk)")
    return (
        manifest.withColumn("depth", F.size(parts) - 1)
        .where(F.col("depth") <= max_depth)
        .where(~suspect | ~F.exists(above, lambda p: tx.is_system(p)))
        .withColumn("name", F.element_at(parts, -1))
        .withColumn("parent_path", F.array_join(above, "/"))
    )


def walk_order() -> Column:
    """Sort key: a directory before what it holds, siblings by name."""
    return F.split("rel_path", "/")


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds the hex digest of the bytes and the algorithm's name; null bytes have none."""
    return files.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256)).withColumn("hash_algo", F.when(F.col(content).isNotNull(), "sha256"))


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def upper_half(charset: str) -> str:
    """What the bytes from 0x80 on stand for in a single-byte character set; bytes without a meaning stay as they are."""
    return "".join(bytes([b]).decode(charset, "ignore") or chr(b) for b in range(0x80, 0x100))


_LATIN = "".join(map(chr, range(0x80, 0x100)))


def decode_text(raw: DataFrame, content: str = "content", fallback: str = "windows-1250") -> DataFrame:
    """Bytes to text: UTF-8 where they are valid, else the fallback, a single-byte character set. ``encoding`` says which.

    Spark decodes few character sets, so the fallback goes by way of Latin-1, whose bytes are the first 256 code points.
    """
    valid = F.is_valid_utf8(F.col(content).cast("string"))
    other = F.translate(F.decode(F.col(content), "ISO-8859-1"), _LATIN, upper_half(fallback))
    return raw.withColumn("encoding", F.when(valid, "UTF-8").otherwise(fallback)).withColumn(
        "text", F.when(valid, F.regexp_replace(F.col(content).cast("string"), r"^\x{FEFF}", "")).otherwise(other)
    )


def encode_text(text: Column, charset: str = "windows-1250") -> Column:
    """The inverse, for texts of that character set only."""
    return F.encode(F.translate(text, upper_half(charset), _LATIN), "ISO-8859-1")


def map_metadata(documents: DataFrame, raw: str = "raw", filename: str = "filename") -> DataFrame:
    """Typed technical and tag columns of raw tag documents (JSON)."""
    d = F.from_json(raw, schemas.TAG_DOCUMENT)
    form, common = d["format"], d["common"]
    types = F.coalesce(form["tagTypes"], F.array().cast("array<string>"))
    v2 = F.get(F.filter(types, lambda t: t.startswith("ID3v2")), F.lit(0))
    # a comment is a text, or an object with one
    comments = F.transform(common["comment"], lambda c: F.coalesce(F.get_json_object(F.when(c.startswith("{"), c), "$.text"), F.when(~c.startswith("{"), c)))
    comment = tx.none_if_empty(F.array_join(F.filter(comments, lambda c: c != ""), " / "))
    parsed = tx.parse_filename(F.col(filename))
    return documents.withColumn("_d", d).select(
        *[c for c in documents.columns if c != raw],
        F.coalesce(form["codec"], form["container"]).alias("codec"),
        form["duration"].alias("duration_sec"),
        F.round(form["bitrate"]).cast("int").alias("bitrate"),
        tx.bitrate_mode(form["codecProfile"]).alias("bitrate_mode"),
        form["sampleRate"].alias("sample_rate"),
        form["numberOfChannels"].alias("channels"),
        F.coalesce(form["lossless"], F.lit(False)).alias("lossless"),
        common["title"].alias("tag_title"), common["artist"].alias("tag_artist"), common["album"].alias("tag_album"), common["albumartist"].alias("tag_album_artist"),
        common["track"]["no"].alias("tag_track_no"), common["disk"]["no"].alias("tag_disc_no"), common["year"].alias("tag_year"),
        F.get(common["genre"], F.lit(0)).alias("tag_genre"), comment.alias("tag_comment"),
        F.array_contains(types, "ID3v1").alias("has_id3v1"), v2.isNotNull().alias("has_id3v2"),
        F.concat(F.regexp_replace(v2, "ID3v", ""), F.when(v2.rlike(r"\.\d+$"), ".0").otherwise("")).alias("id3v2_version"),
        tx.mojibake(common["title"], common["artist"], common["album"], common["albumartist"], comment).alias("encoding_guess"),
        parsed["title"].alias("parsed_title"), parsed["artist"].alias("parsed_artist"), parsed["track_no"].alias("parsed_track_no"),
    )


def fingerprint_ingest(output: DataFrame, stdout: str = "stdout") -> DataFrame:
    """Adds fingerprint, duration and ``rejected`` of a fingerprint tool's output, in its JSON or its KEY=VALUE form."""
    t = tx.trim(F.col(stdout))
    js = F.from_json(F.when(t.startswith("{"), t), "duration string, fingerprint string")
    duration = F.when(t.startswith("{"), js["duration"]).otherwise(tx.none_if_empty(F.regexp_extract(t, _DURATION, 1))).try_cast("double")
    print_ = tx.none_if_empty(F.when(t.startswith("{"), js["fingerprint"]).otherwise(F.regexp_extract(t, _FINGERPRINT, 1)))
    bad = duration.isNull() | print_.isNull()
    return output.withColumn("rejected", bad).withColumn("fingerprint", F.when(~bad, print_)).withColumn("duration", F.when(~bad, duration)).drop(stdout)


def key_of_output(stdout: Column) -> Column:
    """The last line that isn't blank."""
    lines = F.filter(F.transform(F.split(stdout, r"\r?\n"), tx.trim), lambda x: x != "")
    return F.get(lines, F.size(lines) - 1)


def bpm_of_output(stdout: Column) -> Column:
    """The last number from 20 to 400, else the last number, to one decimal."""
    numbers = F.transform(F.regexp_extract_all(stdout, F.lit(r"\d+(?:\.\d+)?"), 0), lambda x: x.try_cast("double"))
    likely = F.filter(numbers, lambda x: (x >= 20) & (x <= 400))
    use = F.when(F.size(likely) > 0, likely).otherwise(numbers)
    return F.floor(F.get(use, F.size(use) - 1) * 10 + F.lit(0.5)) / F.lit(10.0)


def reference_features(documents: DataFrame, document: str = "document") -> DataFrame:
    """mbid, bpm, key, scale and wheel code of reference documents (parsed structs); those without an id are dropped, ids kept once."""
    d = F.col(document)
    tags = d["metadata"]["tags"]
    mbid = F.coalesce(F.get(tags["musicbrainz_recordingid"], F.lit(0)), F.get(tags["musicbrainz_trackid"], F.lit(0)))
    key, scale = d["tonal"]["key_key"], d["tonal"]["key_scale"]
    rows = documents.select(mbid.alias("mbid"), d["rhythm"]["bpm"].alias("bpm"), key.alias("key_key"), scale.alias("key_scale"), tx.reference_camelot(key, scale).alias("camelot"))
    kept = F.min(F.struct(*[F.col(c) for c in ("bpm", "key_key", "key_scale", "camelot")]))
    return rows.where(F.col("mbid") != "").groupBy("mbid").agg(kept.alias("r")).select("mbid", "r.*")


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """A dump's tree of JSON files; files that don't parse stay with a null document and are dropped by ``reference_features``."""
    files = spark.read.schema(schemas.REFERENCE_DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return files.select(F.struct("metadata", "rhythm", "tonal").alias("document"))


def table_sizes(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """Bytes of each table's data files and of all together, largest first. Only file listings are read, no rows."""
    out = None
    for name in names:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{folder}/{name}.parquet")
        one = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes")).select(F.lit(name).alias("table_name"), "size_bytes")
        out = one if out is None else out.unionByName(one)
    return out.unionByName(out.agg(F.sum("size_bytes").alias("size_bytes")).select(F.lit("total").alias("table_name"), "size_bytes")).orderBy(F.desc("size_bytes"), "table_name")
