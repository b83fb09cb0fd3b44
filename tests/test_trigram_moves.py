"""Texts stay where they are in a search."""

from pyspark.sql import functions as F

from archive_catalog.operators import trigram


def test_texts_are_not_shuffled(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"name {i} of {i % 7} and") for i in range(300)], "id long, text string")
    index = trigram.TextIndex(spark, str(tmp_path / "index")).build(rows, "id", {"own": F.col("text")})
    want = [[r["id"] for r in rows.where(F.col("text").contains(w)).orderBy("id").collect()] for w in ("of 3", "and", "e 12", "zzz")]
    for few in (1 << 20, 50):  # the second: frequent sequences are looked for in the texts
        monkeypatch.setattr(trigram, "FEW", few)
        monkeypatch.setattr(trigram, "RAREST", 3)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            found = [index.matches("own", w) for w in ("of 3", "and", "e 12", "zzz")]
            assert [sorted(r["id"] for r in f.collect()) for f in found] == want
            assert not any("SortMergeJoin" in f._jdf.queryExecution().executedPlan().toString() for f in found)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
