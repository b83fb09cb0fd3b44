"""Verification of measured tempo and key against a reference set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def reference_verify(measured: DataFrame, reference: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Measured rows (file_id, mbid, bpm, camelot) that the reference (mbid, bpm, camelot) knows, with bpm_ok and key_ok."""
    ref = reference.select("mbid", F.col("bpm").alias("ref_bpm"), F.col("camelot").alias("ref_camelot"))
    return measured.where("mbid IS NOT NULL").join(ref, "mbid").withColumn("bpm_ok", tx.bpm_agrees(F.col("bpm"), F.col("ref_bpm"), tolerance)).withColumn("key_ok", tx.camelot_agrees(F.col("camelot"), F.col("ref_camelot")))


def verify_totals(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count("*").alias("matched"), F.count_if("bpm_ok").alias("bpm_ok"), F.count_if("key_ok").alias("key_ok"))
