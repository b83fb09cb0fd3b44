"""Corpus pipeline over ``documents``: language ID, near-dedup, decontamination, redaction of personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; what it decides takes effect. All stages
but the last return the columns of ``documents``; other columns are left out.

Defined results, for every stage: an empty table gives no rows; rows are judged by their own text, so null and repeated ids and rows that repeat are each treated as any other;
nulls in other columns stay; texts of any length are taken whole. Language ID drops null texts and texts without a letter; near-dedup keeps one of equal rows,
also of those without words; the others keep null and empty texts (packing gives them their end token).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archive_catalog.llm import decontaminate, langid, neardup, packing, pii
from archive_catalog.llm.shared import Scratch, short_batches, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "row_key"
#: Near-duplicates: shingles of five words, similarity of 0.8 or more.
BAND = neardup.Banding(words=5, percent=80)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language can be told (null, without letters) go; ``lang`` becomes the predicted one."""
    short_batches(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.predict(docs.select(*COLUMNS), model, COLUMNS)
    return found.where(F.col("lang_pred") != langid.UND).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a key of their own, written, so that it is the same whenever they are read: ids may be null or repeated."""
    return written(docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id()), "stage-rows")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` whose key isn't in ``gone``: keys only, broadcast up to a number, beyond that joined by shuffle."""
    near = F.broadcast(gone) if gone.count() <= neardup.BROADCAST_IDS else gone
    return rows.join(near, ROW, "left_anti").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-copies stays: that with the least id, a null id last. Without words, only rows that are equal in all are copies."""
    short_batches(spark)
    worded = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    rows = _numbered(docs.where(worded).select(*COLUMNS).unionByName(docs.where(~worded).select(*COLUMNS).distinct()))
    ids = rows.select(ROW, "doc_id")
    groups = neardup.near_duplicates(rows, BAND, key=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))
    stay = groups.join(ids, ROW).groupBy("component_id").agg(first.alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    gone = written(ids.select(ROW).join(stay, ROW, "left_anti"), "stage-copies")
    return _without(rows, gone)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, whatever their id. Their texts alone decide, so 64-bit hashes of texts name them."""
    short_batches(spark)
    rows = docs.select(*COLUMNS).withColumn(ROW, F.xxhash64("text"))
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), key=ROW)
    return _without(rows, written(found.select(F.col("doc_id").alias(ROW)).distinct(), "stage-found"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows the text."""
    short_batches(spark)
    out = pii.redact(docs.select(*COLUMNS), pii.fit(docs))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places in windows."""
    short_batches(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("decontaminate", clean), ("redact_pii", redact), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        scratch = Scratch(spark, f"stage-{name}")
        docs = scratch.written(stage(spark, docs, sf_dir), "rows")
        if last:
            last.drop()  # what the stage before wrote is read no more
        last = scratch
    return docs
