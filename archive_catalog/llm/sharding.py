"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns several virtual nodes on a ring of 64-bit positions; a row belongs to the first node at or after the hash
of its key. Rows arrive arc by arc around the ring; a shard that has reached its bound refuses the rest of an arc, and those
rows continue clockwise to the next node of a shard with room. The bounds sum to the number of rows, so counts are at
most one apart (law ``rows``), and only overflow moves away from the shard the ring alone would give.

The walk needs only the row count of every arc, so it runs on a table of ``shards * vnodes`` counts, however many rows there are;
its result, a list of (arc, first rank, last rank, shard, first slot), places all rows by their rank in their arc. Rows without their texts are sorted by
the hash of their key (then key, size and checksum), so which rows of an arc overflow depends on the rows alone, not on how they are split into files; ranks are
per-task counters plus offsets per (task, arc). Ranges of the sort are cut within equal rows too, so a hot key is no hot task.

Defined results: a null key hashes to a fixed position; repeated rows and equal keys are separate rows that may overflow
like any other; a null text has size 1 and the checksum of no bytes; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import U64, mix64, written


@dataclass(frozen=True)
class Ring:
    """Virtual nodes in ring order: unsigned positions and the shard of each."""

    positions: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, shards: int, vnodes: int) -> Ring:
        owner = np.repeat(np.arange(shards), vnodes)
        place = mix64(mix64(np.arange(shards * vnodes, dtype=np.uint64) + U64(1)) ^ U64(0x51A2D))
        # a node's position depends on its shard and number only, so further shards leave the others in place
        order = np.argsort(place, kind="stable")
        return cls(place[order], owner[order])

    def arcs(self, hashes: np.ndarray) -> np.ndarray:
        """The node at or after each hash, clockwise."""
        return np.searchsorted(self.positions, hashes) % len(self.positions)


def bounded_walk(ring: Ring, counts: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) that seat ``counts[arc]`` rows under ``bounds[shard]``."""
    free, seated, plan = bounds.astype(np.int64).copy(), np.zeros(len(bounds), np.int64), []
    n = len(ring.owners)
    for arc in np.flatnonzero(counts):
        rank, left, step = 0, int(counts[arc]), 0
        while left:
            shard = int(ring.owners[(arc + step) % n])
            if take := min(left, int(free[shard])):
                plan.append((int(arc), rank, rank + take, shard, int(seated[shard])))
                free[shard] -= take
                seated[shard] += take
                rank += take
                left -= take
            step += 1
    return plan


def shard(docs: DataFrame, shards: int = 16, vnodes: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), home_shard."""
    spark = docs.sparkSession
    ring = Ring.of(shards, vnodes)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(key)).alias("hash"),
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(shards * vnodes, np.int64)
        for b in batches:
            arc = ring.arcs(b.column("hash").to_numpy(zero_copy_only=False).view(np.uint64))
            order = np.argsort(arc, kind="stable")
            sorted_arc = arc[order]
            first = np.searchsorted(sorted_arc, sorted_arc)
            place = np.empty(len(arc), np.int64)
            place[order] = np.arange(len(arc)) - first
            place += seen[arc]
            seen += np.bincount(arc, minlength=len(seen))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(ring.owners[arc].astype(np.int32)), pa.array(np.full(len(arc), task, np.int32)), pa.array(arc.astype(np.int32)), pa.array(place)],
                names=["doc_id", "size", "text_crc32", "home_shard", "task", "arc", "place"],
            )

    # equal rows may stand in any order; the last column only lets the sort cut between them
    order = ["hash", "doc_id", "size", "text_crc32"]
    placed = rows.withColumn("cut", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*order, "cut").sortWithinPartitions(*order, "cut").drop("cut")
    ranked = written(placed.mapInArrow(rank, "doc_id long, size long, text_crc32 long, home_shard int, task int, arc int, place long"), "ring-ranks")
    held = ranked.groupBy("arc", "task").agg(F.count("*").alias("n"))
    per_arc = {r["arc"]: r["n"] for r in held.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # shards * vnodes rows at most
    counts = np.array([per_arc.get(a, 0) for a in range(shards * vnodes)], np.int64)
    total = int(counts.sum())
    bounds = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    # at most one row for each arc and one for each time that a shard fills up
    plan = spark.createDataFrame(bounded_walk(ring, counts, bounds), "arc int, rank_from long, rank_to long, shard int, slot_from long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("arc").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # each task's rows of an arc hold consecutive ranks: cut the plan's ranges to them, a few per (arc, task)
    seats = (
        held.withColumn("before", before)
        .join(F.broadcast(plan), "arc")
        .where((F.col("rank_from") < F.col("before") + F.col("n")) & (F.col("rank_to") > F.col("before")))
        .select("arc", "task", "before", "rank_from", "rank_to", F.col("shard").alias("seat"), "slot_from")
        .groupBy("arc", "task")
        .agg(F.first("before").alias("before"), F.array_sort(F.collect_list(F.struct("rank_from", "rank_to", "seat", "slot_from"))).alias("ranges"))
    )
    return (
        ranked.join(seats, ["arc", "task"])
        .withColumn("rank", F.col("before") + F.col("place"))
        .withColumn("range", F.filter("ranges", lambda r: (r["rank_from"] <= F.col("rank")) & (F.col("rank") < r["rank_to"]))[0])
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("range.seat").alias("shard"),
            (F.col("range.slot_from") + F.col("rank") - F.col("range.rank_from")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "home_shard",
        )
    )


def op10_ring_shards(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return shard(table(spark, sf_dir, "documents"))
