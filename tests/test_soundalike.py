"""Fingerprints that sound alike: exact pairs and groups, and how much was compared for them. Duplicates by key with one hot key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from archive_catalog.operators import acoustic, dedup, soundalike
from archive_catalog.operators.scratch import Scratch

SCHEMA = "file_id long, fp array<long>, duration_sec double, bucket int, cell int, far int"


def noisy(rng, words, share):
    """``words`` with about that share of their bits turned over."""
    return [int(w) ^ int(sum(1 << k for k in range(32) if rng.random() < share)) for w in words]


def prints(seed, groups, members, singles, size=(20, 40)):
    """Groups of noisy copies (some cut short) and unlike prints, of a few lengths."""
    rng = random.Random(seed)
    fresh = lambda: [rng.getrandbits(32) for _ in range(rng.randrange(*size))]
    rows = []
    for g in range(groups):
        words, dur = fresh(), 100.0 + 6 * g
        for _ in range(members):
            own = noisy(rng, words, rng.choice([0.01, 0.05, 0.1]))
            rows.append((own[: len(own) - rng.randrange(4)], dur + rng.random() * 9))
    rows += [(fresh(), 90.0 + rng.random() * 60) for _ in range(singles)]
    rng.shuffle(rows)
    return [(i, w, d, 1, 2, 3) for i, (w, d) in enumerate(rows)]


def brute(rows, max_ber, band=7.0):
    out = {}
    for i, (a, x, dx, *_) in enumerate(rows):
        for b, y, dy, *_ in rows[i + 1 :]:
            n = min(len(x), len(y))
            ber = sum((p ^ q).bit_count() for p, q in zip(x, y, strict=False)) / (32.0 * n) if n else 1.0
            if abs(dx - dy) <= band and ber <= max_ber:
                out[min(a, b), max(a, b)] = ber
    return out


def closure(pairs):
    label = {}
    for a, b in pairs:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize(("seed", "max_ber", "share"), [(1, 0.15, 2048), (2, 0.15, 5), (3, 0.3, 7), (4, 0.02, 2048)])
def test_pairs_and_links_against_brute_force(spark, monkeypatch, seed, max_ber, share):
    rows = prints(seed, 6, 12, 60)
    rows += [(1000, [], 100.0, 1, 2, 3), (1001, [], 100.0, 1, 2, 3), (1002, rows[0][1], rows[0][2], 1, 2, 3)]
    items = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(soundalike, "NEAR", 3)
    want = brute(rows, max_ber)
    got = {(r["a"], r["b"]): r["ber"] for r in acoustic.fingerprint_pairs(items, max_ber, share=share).collect()}
    assert got == want
    links = {(r["a"], r["b"]) for r in soundalike.links(items, max_ber, 7.0, share).collect()}
    assert links <= set(want) and closure(links) == closure(want)
    clusters = {r["file_id"]: r["group_id"] for r in acoustic.fingerprint_clusters(items, max_ber, share=share).collect()}
    assert clusters == closure(want)


def test_no_pivot_and_odd_tables(spark):
    rows = prints(5, 0, 0, 30)
    items = spark.createDataFrame(rows, SCHEMA)
    assert soundalike.pivots_of(items, 0.15) == []
    assert {(r["a"], r["b"]) for r in soundalike.links(items, 0.45, 7.0, 100).collect()} == set(brute(rows, 0.45))
    empty = spark.createDataFrame([], SCHEMA)
    assert acoustic.fingerprint_pairs(empty).collect() == acoustic.fingerprint_clusters(empty).collect() == []
    missing = spark.createDataFrame([(1, None, 1.0, 1, 1, 1), (2, [1], None, 1, 1, 1), (3, [1], 1.0, 1, 1, 1), (4, [1], 1.0, 1, 1, 1), (None, [9], 1.0, 1, 1, 1)], SCHEMA)
    assert {(r["file_id"], r["group_id"]) for r in acoustic.fingerprint_clusters(missing.where("file_id IS NOT NULL")).collect()} == {(3, 3), (4, 3)}


def test_few_comparisons_in_a_large_group(spark):
    """Near copies of one print cost as many comparisons as there are; five times as many, about five times."""
    sc = spark.sparkContext
    spent = []
    for members in (100, 500):
        rows = prints(6, 1, members, 0, (60, 64))
        rows += [(10_000 + i, w, d, 1, 2, 3) for i, w, d, *_ in prints(7, 0, 0, 40, (60, 64))]
        counts = sc.accumulator(0), sc.accumulator(0)
        links = soundalike.links(spark.createDataFrame(rows, SCHEMA), 0.15, 7.0, 2048, counts).collect()
        assert closure([(r["a"], r["b"]) for r in links]) == closure(brute(rows, 0.15))
        spent.append(counts[0].value)
        assert counts[1].value <= counts[0].value < len(rows) ** 2 / 2 / (members / 20)
    assert spent[1] < 6 * spent[0]


def test_pivots_spare_pairs(spark):
    """With two groups far apart and all pairs wanted, pairs across are told apart by the pivots alone; noise is given up after its first words."""
    sc = spark.sparkContext
    rows = prints(8, 2, 40, 0, (60, 64))
    rows = [(i, w, 100.0 + d % 7, *x) for i, w, d, *x in rows]
    counts = sc.accumulator(0), sc.accumulator(0)
    got = acoustic.fingerprint_pairs(spark.createDataFrame(rows, SCHEMA), counts=counts).collect()
    assert len(got) == len(brute(rows, 0.15)) and counts[0].value == 2 * 40 * 39 / 2
    noise = prints(9, 0, 0, 80, (60, 64))
    counts = sc.accumulator(0), sc.accumulator(0)
    acoustic.fingerprint_pairs(spark.createDataFrame([(i, w, 100.0, *x) for i, w, _, *x in noise], SCHEMA), counts=counts).collect()
    assert counts[0].value == 80 * 79 / 2 and counts[1].value < counts[0].value / 20


def test_bits_over_common_words():
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 1 << 32, n).tolist() for n in (0, 3, 8, 5)]
    words, sizes = soundalike._matrix(rows)
    for i, x in enumerate(rows):
        got = soundalike._bits(words[i], len(x), words, sizes, 0, 100)
        assert got.tolist() == [sum((p ^ q).bit_count() for p, q in zip(x, y, strict=False)) for y in rows]


@pytest.fixture
def strict(spark):
    """No broadcast by size, no merging of partitions, skew handling off: what the operator does by itself."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_hot_key_is_spread(spark, strict):
    """Nine tenths of the rows share a key, and some keys are null or empty."""
    n = 200_000
    files = spark.range(n, numPartitions=16).select(F.col("id").alias("file_id"), F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 100 == 0, None).when(F.col("id") % 100 == 10, "").otherwise((F.col("id") % 1000).cast("string")).alias("content_hash"))
    got = dedup.exact(files)
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2], sizes
    want = {("hot", n * 9 // 10): n * 9 // 10}
    assert got.where("n_members = %d" % (n * 9 // 10)).count() == want["hot", n * 9 // 10]
    assert got.groupBy("group_id").agg(F.count("*").alias("n"), F.max("n_members").alias("m")).where("n <> m").count() == 0
    assert got.select("group_id").distinct().count() == 1 + len({i % 1000 for i in range(0, n, 10) if i % 100 not in (0, 10)})


def test_many_keys_over_the_bound(spark, strict, monkeypatch):
    monkeypatch.setattr(dedup, "HEAVY_KEYS", 5)
    rows = [(i, f"k{i % 3}" if i < 90 else f"x{i}") for i in range(120)] + [(500, None)]
    scratch = Scratch(spark, "test")
    table = scratch.written(spark.createDataFrame(rows, "file_id long, k string"), "rows")
    got = sorted((r["file_id"], r["n"], r["first"]) for r in dedup.with_group(scratch, table, "k", F.count("*").alias("n"), F.min("file_id").alias("first")).collect())
    assert got == sorted((i, 30, i % 3) if i < 90 else (i, 1, i) for i in range(120))
    scratch.drop()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_short_prints_are_compared_at_once(spark, monkeypatch, kind):
    """Prints of 0 to 4 words against brute force, by the rows' own comparison never."""
    rng = random.Random(11)
    rows = [(i, [rng.getrandbits(32) & 0xFFFF for _ in range(rng.choice([0, 1, 2, 2, 2, 3, 4]))], 100.0 + rng.random() * 30, 1, 2, 3) for i in range(300)]
    rows += [(300 + i, noisy(rng, rows[i][1], 0.05), rows[i][2] + rng.random(), 1, 2, 3) for i in range(60)]
    if kind == "string":
        rows = [(f"f{i:04}", *r) for i, *r in rows]
    items = spark.createDataFrame(rows, SCHEMA.replace("file_id long", f"file_id {kind}"))

    def never(*_):
        raise AssertionError("compared row by row")

    monkeypatch.setattr(soundalike, "_block", never)
    for max_ber, share in ((0.2, 2048), (0.3, 10)):
        want = brute(rows, max_ber)
        assert {(r["a"], r["b"]): r["ber"] for r in acoustic.fingerprint_pairs(items, max_ber, share=share).collect()} == want
        links = {(r["a"], r["b"]) for r in soundalike.links(items, max_ber, 7.0, share).collect()}
        assert links <= set(want) and closure(links) == closure(want)
