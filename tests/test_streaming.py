"""The newest row per key as streaming state."""

import random

from archive_catalog.streaming.newest import changes, compact, read_newest, stream_newest

SCHEMA = "k string, n int, x int, seq long"


def arrive(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def expected(rows):
    """(k, n, x, seq, first_seen, last_seen): the greatest (seq, x) of each key, nulls least."""
    out = {}
    for k, n, x, seq in rows:
        out.setdefault((k, n), []).append((seq, x is not None, x))
    show = lambda v: "" if v is None else str(v)
    return sorted((show(k), show(n), show(max(v)[2]), max(v)[0], min(v)[0], max(v)[0]) for (k, n), v in out.items())


def state(spark, table):
    show = lambda v: "" if v is None else str(v)
    schema = spark.createDataFrame([], SCHEMA).schema
    return sorted((show(r["k"]), show(r["n"]), show(r["x"]), r["seq"], r["first_seen"], r["last_seen"]) for r in read_newest(spark, table, schema, ["k", "n"], "seq").collect())


def test_late_repeated_and_restarted(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = spark.createDataFrame([], SCHEMA).schema
    run = lambda checkpoint="state": stream_newest(spark, source, schema, table, str(tmp_path / checkpoint), ["k", "n"], "seq").awaitTermination()
    assert read_newest(spark, table, schema, ["k", "n"], "seq").collect() == []
    rng = random.Random(3)
    batches = [[(rng.choice("abcdef"), rng.randrange(3), rng.choice([None, 1, 2, 3]), rng.randrange(6)) for _ in range(12)] for _ in range(4)]
    batches[1] += [(None, 1, 7, 3), ("hot", 0, 1, 1), *[("hot", 0, 1, 1)] * 20]
    seen = []
    for i, rows in enumerate(batches):
        arrive(spark, rows, source)
        seen += rows
        if i % 2:
            run()  # each time a new query on the same checkpoint
            assert state(spark, table) == expected(seen)
    arrive(spark, batches[0], source)  # an old manifest once more
    run()
    assert state(spark, table) == expected(seen)
    # a stream that begins anew reads all files again and adds the same rows
    run("other")
    assert state(spark, table) == expected(seen)


def test_no_older_file_is_touched(spark, tmp_path):
    source, table = str(tmp_path / "in"), tmp_path / "table"
    schema = spark.createDataFrame([], SCHEMA).schema
    files = lambda: {p: p.stat().st_mtime_ns for p in table.rglob("*.parquet")}
    arrive(spark, [(f"k{i}", 0, i, 1) for i in range(500)], source)
    stream_newest(spark, source, schema, str(table), str(tmp_path / "s"), ["k", "n"], "seq").awaitTermination()
    before = files()
    arrive(spark, [("k3", 0, 9, 2), ("new", 0, 1, 2)], source)
    stream_newest(spark, source, schema, str(table), str(tmp_path / "s"), ["k", "n"], "seq").awaitTermination()
    after = files()
    assert before.items() <= after.items()
    added = changes(spark, str(table), schema).where("part LIKE '%-000000001'").collect()
    assert sorted((r["k"], r["x"], r["first_seen"], r["last_seen"]) for r in added) == [("k3", 9, 1, 2), ("new", 1, 2, 2)]
    # compaction keeps the table, and the stream goes on after it
    want = state(spark, str(table))
    assert compact(spark, str(table), schema, ["k", "n"], "seq") == 2
    assert changes(spark, str(table), schema).select("part").distinct().count() == 1 and state(spark, str(table)) == want
    arrive(spark, [("k3", 0, 1, 1), ("k4", 0, 5, 3)], source)
    stream_newest(spark, source, schema, str(table), str(tmp_path / "s"), ["k", "n"], "seq").awaitTermination()
    got = {r[0]: r for r in state(spark, str(table))}
    assert len(got) == 501 and got["k3"][2:] == ("9", 2, 1, 2) and got["k4"][2:] == ("5", 3, 1, 3)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
