"""Searches by the index of three-character sequences against looking at every text."""

import random

from pyspark.sql import functions as F

from archive_catalog.operators import browse
from archive_catalog.operators.trigram import TextIndex, sequences

LETTERS = ["a", "B", "é", "É", "ł", "Ł", " ", "ab", "the ", "…", "😀", "İ", "ı", "1", "'", "\n", "é"]


def test_searches_find_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randrange(12))) if rng.random() > 0.1 else None
    rows = [(i, word(), word(), word(), None, word()) for i in range(300)]
    files = spark.createDataFrame(rows, "file_id long, resolved_title string, resolved_artist string, tag_title string, tag_artist string, filename string")
    files = files.withColumns({"filename_lower": F.lower("filename"), "filename_norm_ascii": F.lower(F.col("filename")), "form": F.lit("x"), "gram": F.lit(1), "id": F.lit(2), "text": F.lit("y")})
    index = browse.index_files(TextIndex(spark, str(tmp_path / "index")), files)
    assert index.exists() and not TextIndex(spark, str(tmp_path / "none")).exists()
    ids = lambda df: sorted(r["file_id"] for r in df.select("file_id").collect())
    for q in ["a", "É", "ab", "lab", "THE A", "ł", "Łé", "😀", "a😀b", "zzz", "the the", "e", "…ab", "i", "1'", "\n", "abababab", "bé"]:
        assert ids(browse.find_audio(index, q)) == ids(browse.search_audio(files, q)), q
        assert ids(browse.find_files(index, q)) == ids(browse.search_files(files, q)), q


def test_fields_do_not_run_into_each_other(spark, tmp_path):
    files = spark.createDataFrame([(1, "abc", "def", "n"), (2, "abcdef", None, "n"), (3, None, None, None), (4, None, "abc", "n")], "file_id long, tag_title string, tag_artist string, filename_lower string").withColumn("filename_norm_ascii", F.lit(None).cast("string"))
    index = browse.index_files(TextIndex(spark, str(tmp_path / "index")), files)
    found = lambda q: sorted(r["file_id"] for r in browse.find_audio(index, q).collect())
    assert (found("cde"), found("abc"), found("def"), found("bcd")) == ([2], [1, 2, 4], [1, 2], [2])
    assert browse.index_files(TextIndex(spark, str(tmp_path / "empty")), files.limit(0)).matches(browse.LOWER, "abc").collect() == []


def test_a_search_reads_its_own_postings(spark, tmp_path):
    texts = spark.range(2000).select(F.col("id").alias("file_id"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("filename_lower"), F.lit("x").alias("filename_norm_ascii"))
    index = browse.index_files(TextIndex(spark, str(tmp_path / "index")), texts)
    plan = index.postings(browse.LOWER, sequences("1234").tolist())._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(gram" in plan
    assert [r["file_id"] for r in browse.find_files(index, "e 1234").collect()] == [1234]
