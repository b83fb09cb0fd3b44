"""Near-duplicate detection by MinHash with tensored banding.

Two collections of ``m`` half keys, ``r`` minhashes each, give ``m * m`` tables keyed by a pair (half key i of the first, half key j of the
second): 2 * m * r minhashes do the work that would take m * m * 2 * r. A pair of similarity s meets in some table with
probability (1 - (1 - s^r)^m)^2; with r = 2 and m = 10 that misses 7 of 100,000 pairs at s = 0.8 and fewer above. Everything
after the tables is exact.

Documents with equal shingle sets are one class, named by a digest of the set; all work from the tables on is on classes. Of each that shares a
table cell with another, the shingles that no other such class holds are counted: a class with s of its n shingles shared overlaps any
other in s at most, so one with s < 0.8 n links with nothing (documents that share one common passage go here). Classes that meet in cells, directly or by
others, form a candidate group. In a group every set S is kept as its difference D to the group's majority set (the shingles that more than half of
its classes hold): |S1 xor S2| = |D1 xor D2|, so with c common elements of D1 and D2 a pair links if and only if

    2 (100 + p) c >= w1 + w2,   w = (100 + p) |D| - (100 - p) |S|,   p: the percentage.

The class with the least w (the leader) links with every class that has w <= -w(leader), and all pairs that link without any common element are
connected by these; so a group of copies costs its size. All other pairs need common elements: they are found by an exact prefix filter, joining the rarest elements
of the differences by levels of w, and confirmed on the whole differences. No pair is left out.

Defined results: no words or no text means no shingle, linked with nothing; fewer words than a shingle make one shingle; A-Z are
lower-cased, words end at ASCII white space; rows that repeat id and text are linked; a null id is never the smallest unless all are null,
and ``kept`` is false there; an empty table gives no rows; other columns are ignored; very long texts are shingled in slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .shared import Scratch, U64, chunks, mix64, random64, word_hashes, written

#: Ids are broadcast up to this number (a few dozen MB), else joined by shuffle.
BROADCAST_IDS = 1 << 20
#: Ranges of w that the prefix filter tells apart.
LEVELS = 8


@dataclass(frozen=True)
class Banding:
    halves: int = 10
    rows: int = 2
    words: int = 4
    percent: int = 80

    @property
    def hashes(self) -> int:
        return 2 * self.halves * self.rows


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    h, bounds = word_hashes(texts)
    place = random64(words, 11) | U64(1)
    n = len(h) - words + 1
    if n > 0:
        rolled = h[:n] * place[0]
        for i in range(1, words):
            rolled += h[i : i + n] * place[i]
        rolled = mix64(rolled)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= words:
            yield np.unique(rolled[lo : hi - words + 1])
        elif hi > lo:
            yield mix64(np.array([(h[lo:hi] * place[: hi - lo]).sum() + U64(hi - lo)], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def digest64(shingles: np.ndarray) -> int:
    """Name of a set; 64 bits, so of n different sets two share a name with probability n * n / 2^65."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def minhashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048]
        np.minimum(out, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return out


def _arrays(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(np.ascontiguousarray(rows).ravel()))


def signatures(docs: DataFrame, band: Banding) -> DataFrame:
    """doc_id, n_shingles, node, half keys (the left ones, then the right ones)."""
    a, b = random64(band.hashes, 21) | U64(1), random64(band.hashes, 22)
    join = random64(band.rows, 23) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column("text"), 2000, 1 << 22):
                n, node, halves = [], [], []
                for s in shingle_sets(batch.column("text")[lo:hi].to_pylist(), band.words):
                    n.append(len(s))
                    if not len(s):
                        node.append(None), halves.append(np.zeros(2 * band.halves, np.int64))
                        continue
                    node.append(digest64(s))
                    m = mix64(minhashes(s, a, b))
                    halves.append(mix64((m.reshape(-1, band.rows) * join).sum(axis=1)).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(n, pa.int64()), pa.array(node, pa.int64()), _arrays(np.array(halves))], names=["doc_id", "n_shingles", "node", "halves"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, halves array<long>")


def full_sets(docs: DataFrame, band: Banding) -> DataFrame:
    """node, shingles: the whole set of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column("text"), 1000, 1 << 22):
                sets = list(shingle_sets(batch.column("text")[lo:hi].to_pylist(), band.words))
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if ends[-1] else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([digest64(s) if len(s) else None for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def _cells(classes: DataFrame, band: Banding) -> DataFrame:
    """(cell, node): a class's place in every table."""
    left, right = F.slice("halves", 1, band.halves), F.slice("halves", band.halves + 1, band.halves)
    pairs = F.flatten(F.transform(left, lambda x, i: F.transform(right, lambda y, j: F.xxhash64(x, y, i, j))))
    return classes.select("node", F.explode(pairs).alias("cell"))


def _candidate_sets(docs: DataFrame, nodes: DataFrame, band: Banding, scratch: Scratch) -> DataFrame:
    """(node, shingles): the whole sets of ``nodes`` (node, doc_id of one of its rows), one row each."""
    ids = nodes.select("doc_id").distinct()
    ids = F.broadcast(ids) if nodes.count() <= BROADCAST_IDS else ids
    sets = full_sets(docs.join(ids, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select("text"), band).where("node IS NOT NULL")
    return scratch.written(sets.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")


def candidate_groups(classes: DataFrame, docs: DataFrame, band: Banding, scratch: Scratch) -> DataFrame | None:
    """(label, node, shingles) of the classes that may link with another of their group; null if there are none."""
    # each class makes many cells: dealt evenly over as many tasks as a shuffle has, so that none aggregates more than its share
    cells = _cells(classes.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), band)
    hot = cells.groupBy("cell").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("cell")
    members = scratch.written(cells.join(hot, "cell"), "cells")
    nodes = scratch.written(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "n_shingles"), "nodes")
    sets = _candidate_sets(docs, nodes, band, scratch)
    held = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    own = held.where("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    viable = nodes.join(own, "node", "left").where((F.col("n_shingles") - F.coalesce("own", F.lit(0))) * 100 >= F.col("n_shingles") * band.percent)
    members = scratch.written(members.join(viable.select("node"), "node", "left_semi"), "members")
    first = members.groupBy("cell").agg(F.min("node").alias("u"), F.max("node").alias("hi")).where("u <> hi").select("cell", "u")
    met = scratch.written(members.join(first, "cell").where("node <> u").select("u", F.col("node").alias("v")).distinct(), "met")
    if met.isEmpty():
        return None
    return scratch.written(sets.join(components(met, "u", "v"), "node").select("label", "node", "shingles"), "groups")


def differences(groups: DataFrame, band: Banding, scratch: Scratch) -> DataFrame:
    """label, node, n (shingles), d (elements of the difference), w, elements: (k: how many differences hold it, x), rarest first, without those of one class only."""
    held = groups.select("label", F.explode("shingles").alias("x")).groupBy("label", "x").agg(F.count("*").alias("k")).where("k > 1")
    # what is small is written before it is joined, so that a join's large partitions (a large group) can be split
    sizes = scratch.written(groups.groupBy("label").agg(F.count("*").alias("m")), "sizes")
    held = scratch.written(held.join(sizes, "label"), "held")
    # a set of shingles that half of the classes hold is at most twice as large as their average
    major = held.where("2 * k > m").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("x", (F.col("m") - F.col("k")).alias("k")))).alias("major"))
    split = groups.join(scratch.written(major, "major"), "label", "left").select("label", "node", "shingles", F.coalesce("major.x", F.array().cast("array<long>")).alias("x"), F.coalesce("major.k", F.array().cast("array<long>")).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, x, k = (batch.column(c) for c in ("shingles", "x", "k"))
            values = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (s, x, k)]
            n, more, less, rare = [], [], [], []
            for i in range(batch.num_rows):
                own, most, count = (v[o[i] : o[i + 1]] for v, o in values)
                n.append(len(own))
                more.append(np.setdiff1d(own, most, assume_unique=True))
                gone = ~np.isin(most, own, assume_unique=True)
                less.append(most[gone]), rare.append(count[gone])
            listed = lambda parts: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("node"), pa.array(n, pa.int64()), listed(more), listed(less), listed(rare)], names=["label", "node", "n", "more", "less", "rare"])

    apart = scratch.written(split.mapInArrow(run, "label long, node long, n long, more array<long>, less array<long>, rare array<long>"), "apart")
    extra = (
        apart.select("label", "node", F.explode("more").alias("x")).join(held.select("label", "x", "k"), ["label", "x"])
        .groupBy("node").agg(F.collect_list(F.struct("k", "x")).alias("extra"))
    )
    lost = F.arrays_zip(F.col("rare").alias("k"), F.col("less").alias("x"))
    none = F.array().cast("array<struct<k:bigint,x:bigint>>")
    d, p = F.size("more") + F.size("less"), band.percent
    return scratch.written(
        apart.join(extra, "node", "left").select(
            "label", "node", "n", d.cast("long").alias("d"), ((100 + p) * d - (100 - p) * F.col("n")).alias("w"),
            F.array_sort(F.concat(F.coalesce("extra", none), F.filter(lost, lambda e: e["k"] > 1))).alias("elements"),
        ),
        "differences",
    )


def links(apart: DataFrame, band: Banding, scratch: Scratch) -> DataFrame:
    """(u, v): pairs that connect exactly those classes of ``differences`` that links connect."""
    per = 2 * (100 + band.percent)
    lead = apart.groupBy("label").agg(F.min_by("node", F.struct("w", "node")).alias("leader"), F.min("w").alias("low"), F.max("w").alias("high"))
    lead = scratch.written(lead, "lead")
    rows = scratch.written(apart.join(lead, "label").withColumn("near", F.col("w") + F.col("low") <= 0), "led")
    star = rows.where("near AND node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v"))
    span = F.col("high") - F.col("low") + 1
    need = lambda w: F.greatest(F.lit(1), F.ceil(w / F.lit(per)))
    # the position of an element counts those that no other difference holds too: they are rarest
    alone = F.col("d") - F.size("elements")
    placed = lambda least: F.filter(F.transform("elements", lambda e, i: F.struct((alone + i).alias("at"), e["x"].alias("x"))), lambda e: e["at"] <= F.col("d") - least)
    # of a pair the one with the less w is on the left; a class on the right looks for each level of w up to its own
    left = rows.select("label", "node", "w", "n", "d", F.floor((F.col("w") - F.col("low")) * LEVELS / span).alias("level"), F.explode(placed(need(F.col("w") * 2))).alias("e"))
    far = rows.where("NOT near").withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("w") - F.col("low")) * LEVELS / span))))
    far = far.withColumn("from", F.col("low") + F.floor(F.col("level") * span / LEVELS))
    right = far.select("label", F.col("node").alias("v"), F.col("w").alias("w_v"), F.col("n").alias("n_v"), F.col("d").alias("d_v"), "level", F.explode(placed(need(F.col("w") + F.col("from")))).alias("f"))
    left = left.select("label", "level", F.col("e.x").alias("x"), F.col("e.at").alias("at"), F.col("node").alias("u"), "w", "n", "d")
    right = right.select("label", "level", F.col("f.x").alias("x"), F.col("f.at").alias("at_v"), "v", "w_v", "n_v", "d_v")
    before = (F.col("w") < F.col("w_v")) | ((F.col("w") == F.col("w_v")) & (F.col("u") < F.col("v")))
    # common elements from here on: where this is the first, all of them
    rest = F.least(F.col("d") - F.col("at"), F.col("d_v") - F.col("at_v"))
    sizes = F.least("n", "n_v") * 100 >= F.greatest("n", "n_v") * band.percent
    pairs = left.join(right, ["label", "level", "x"]).where(before & sizes & (rest * per >= F.col("w") + F.col("w_v"))).select("u", "v").distinct()
    bare = rows.select("node", "w", F.col("elements.x").alias("x"))
    a, b = bare.toDF("u", "w_u", "x_u"), bare.toDF("v", "w_v", "x_v")
    common = F.size(F.array_intersect("x_u", "x_v"))
    found = scratch.written(pairs, "pairs").join(a, "u").join(b, "v").where(common * per >= F.col("w_u") + F.col("w_v")).select("u", "v")
    return scratch.written(star.unionByName(found), "links")


def class_components(docs: DataFrame, sigs: DataFrame, band: Banding) -> DataFrame | None:
    """(node, label) of classes that are linked with another; null if none is."""
    scratch = Scratch(docs.sparkSession, "minhash")
    classes = sigs.where("node IS NOT NULL").groupBy("node").agg(F.min("n_shingles").alias("n_shingles"), F.min("doc_id").alias("doc_id"), F.min("halves").alias("halves"))
    groups = candidate_groups(scratch.written(classes, "classes"), docs, band, scratch)
    labels = None
    if groups is not None:
        found = links(differences(groups, band, scratch), band, scratch)
        labels = None if found.isEmpty() else components(found, "u", "v")
    scratch.drop()
    return labels


def near_duplicates(docs: DataFrame, band: Banding = Banding(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sigs = written(signatures(rows, band), "minhash-signatures")
    labels = class_components(rows.withColumnRenamed("doc_id", "id"), sigs, band)
    # by class first: what the rows are joined with is a written table of one row a class, so that a hot class can be split
    named = sigs.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    if labels is not None:
        scratch = Scratch(docs.sparkSession, "minhash-labels")
        known = scratch.written(named.join(labels, "node"), "known")
        first = scratch.written(known.groupBy("label").agg(F.min("least").alias("first")), "first")
        linked = known.join(first, "label").select("node", "first")
        named = named.join(linked, "node", "left").select("node", F.coalesce("first", "least").alias("least"))
        named = written(named, "minhash-components")
        scratch.drop()
    else:
        named = written(named, "minhash-components")
    kept = F.coalesce(F.coalesce("least", "doc_id") == F.col("doc_id"), F.lit(False))
    return sigs.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), kept.alias("kept"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)])
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, hash(unnest(shingles)) AS shingle FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS n, count(*) AS k FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (SELECT x, y FROM p WHERE 100 * k >= 80 * (n - k)),
t AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS hit FROM t UNION SELECT r.doc_id, t.y FROM r JOIN t ON r.hit = t.x),
c AS (SELECT doc_id, min(hit) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c ON s.doc_id = c.doc_id
"""
