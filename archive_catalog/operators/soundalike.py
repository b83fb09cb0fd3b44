"""Which fingerprints sound alike: an exact join under the bit-error rate, with pivots and the triangle inequality.

The number of differing bits is a metric on words up to a common length, so what two prints differ from a third bounds what they differ from each other. Pivots are prints that have
many near ones in a bounded sample. Every print's distances to them are taken once:

- In ``pairs`` a pair is compared only where no pivot tells it apart.
- In ``links`` the prints near a pivot are linked with it and so belong together without being compared: a group of near copies costs as many comparisons as it
  has members. Prints near a pivot are compared only with those outside that are at most twice the bound away from it, and prints near no pivot with each other.

Prints of about the same length meet in blocks of ``share`` by ``share``, each compared in one go; words are looked at in two steps, the second for pairs
that the first leaves possible. Prints of at most ``SHORT`` words are compared outright, many with many at once: that takes less than to ask the pivots first. What is compared is counted. For prints that are near no pivot (noise is about half its bits from everything) no exact
bound holds two apart without looking at them; for these all pairs of a length class are compared as far as needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Prints sampled for pivots, pivots at most, and how many near ones in the sample make a pivot.
SAMPLE, PIVOTS, NEAR = 256, 16, 3
#: The share of words after which unlike prints are given up.
FIRST_LOOK = 0.35
#: Blocks of prints of so many words at most are compared outright, so many rows against all others at once; their sides have so many times the rows.
SHORT, AT_ONCE, LARGER = 4, 32, 4


def _matrix(prints: list) -> tuple[np.ndarray, np.ndarray]:
    """Prints as rows of 32-bit words, filled up with zeros, and their lengths."""
    size = np.array([len(p) for p in prints], np.int64)
    out = np.zeros((len(prints), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.concatenate([np.asarray(p, np.int64) for p in prints] or [np.empty(0, np.int64)]).astype(np.uint32)
    return out, size


def _bits(one: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Differing bits of a print of ``n`` words and others, of words from ``start`` to ``stop`` that both have."""
    stop = min(stop, n, others.shape[1])
    if stop <= start:
        return np.zeros(len(others), np.int64)
    x = others[:, start:stop] ^ one[None, start:stop]
    if (sizes < stop).any():
        x[np.arange(start, stop)[None, :] >= sizes[:, None]] = 0
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def pivots_of(items: DataFrame, max_ber: float, sample: int = SAMPLE, most: int = PIVOTS, near: int = NEAR) -> list[tuple]:
    """(file_id, print, duration) of at most ``most`` prints that have ``near`` near ones, themselves included, among ``sample`` chosen by a hash."""
    few = items.where(F.size("fp") > 0).select("file_id").orderBy(F.xxhash64("file_id"), "file_id").limit(sample)  # ids alone are sorted
    rows = sorted(items.join(F.broadcast(few), "file_id", "left_semi").select("file_id", "fp", "duration_sec").limit(2 * sample).collect(), key=lambda r: str(r["file_id"]))
    words, size = _matrix([r["fp"] for r in rows])
    close = np.zeros((len(rows), len(rows)), bool)
    for i in range(len(rows)):
        n = np.minimum(size[i], size)
        close[i] = _bits(words[i], int(size[i]), words, size, 0, 1 << 30) <= max_ber * 32 * n
    chosen, left = [], np.ones(len(rows), bool)
    while len(chosen) < most and left.any():
        counts = (close & left[None, :]).sum(axis=1)
        best = int(counts.argmax())
        if counts[best] < near:
            break
        chosen.append((rows[best]["file_id"], list(rows[best]["fp"]), float(rows[best]["duration_sec"])))
        left &= ~close[best]
    return chosen


def with_distances(items: DataFrame, pivots: list[tuple]) -> DataFrame:
    """``items`` (file_id, fp, duration_sec) with ``far``: differing bits to each pivot over the words that both have."""
    words, sizes = _matrix([p[1] for p in pivots])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, size = _matrix(b.column("fp").to_pylist())
            far = [_bits(w, int(n), prints, size, 0, 1 << 30) for w, n in zip(words, sizes, strict=True)]
            rows = np.stack(far, axis=1).tolist() if far else [[] for _ in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.int64()))], names=[*b.schema.names, "far"])

    columns = items.select("file_id", "fp", "duration_sec")
    return columns.mapInArrow(run, f"file_id {columns.schema['file_id'].dataType.simpleString()}, fp array<long>, duration_sec double, far array<long>")


def _block(left: dict, right: dict, once: np.ndarray, sizes: np.ndarray, max_ber: float, band: float) -> tuple[list, list, list, int, int]:
    """Pairs of a block with their rates; how many were looked at, and how many in full."""
    words_l, n_l = _matrix(left["fp"])
    words_r, n_r = _matrix(right["fp"])
    if words_l.shape[1] < words_r.shape[1]:
        words_l = np.pad(words_l, ((0, 0), (0, words_r.shape[1] - words_l.shape[1])))
    far_r, dur_r, ids_r = np.array(right["far"], np.int64).reshape(len(n_r), len(sizes)), np.array(right["duration_sec"]), np.array(right["file_id"], object)
    m_r = np.minimum(n_r[:, None], sizes[None, :])
    a, b, ber, looked, full = [], [], [], 0, 0
    for i, (x, dur) in enumerate(zip(left["file_id"], left["duration_sec"], strict=True)):
        n = np.minimum(n_l[i], n_r)
        limit = max_ber * 32 * n
        ok = np.abs(dur_r - dur) <= band
        if once[i]:
            ok &= ids_r > x
        if len(sizes):  # over words that both and the pivot have, the longer one's distance may be less by the bits of its further words
            far = np.array(left["far"][i], np.int64)
            more = 32 * (m_r - np.minimum(n_l[i], sizes)[None, :])
            apart = np.maximum(far - far_r - np.maximum(-more, 0), far_r - far - np.maximum(more, 0)).max(axis=1)
            ok &= apart <= limit
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        first = int(np.ceil(FIRST_LOOK * n_l[i]))
        bits = _bits(words_l[i], int(n_l[i]), words_r[at], n_r[at], 0, first)
        looked += len(at)
        stay = bits <= limit[at] + 1e-6
        at, bits = at[stay], bits[stay]
        bits = bits + _bits(words_l[i], int(n_l[i]), words_r[at], n_r[at], first, 1 << 30)
        full += len(at)
        rate = np.where(n[at] > 0, bits / np.maximum(32.0 * n[at], 1), 1.0)
        for j in np.flatnonzero(rate <= max_ber).tolist():
            y = ids_r[at[j]]
            a.append(min(x, y))
            b.append(max(x, y))
            ber.append(float(rate[j]))
    return a, b, ber, looked, full


def _short_block(table: pa.Table, max_ber: float, band: float, counting: bool) -> tuple[list, list, list, int]:
    """Pairs of a block of short prints with their rates, and how many were looked at (counted if asked for), all of them in full."""
    side, ids = table.column("side").to_numpy(), table.column("file_id").to_pylist()
    once, length = table.column("once").to_numpy(), table.column("duration_sec").to_numpy()
    place = np.unique(np.array(ids, object), return_inverse=True)[1]  # ids by their order
    lists = table.column("fp").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    words = np.zeros((len(size), SHORT), np.uint32)
    words[np.arange(SHORT)[None, :] < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
    a, b, ber, looked = [], [], [], 0
    for n_l in np.unique(size[side == 0]):
        for n_r in np.unique(size[side == 1]):
            n = int(min(n_l, n_r))
            common = np.where(np.arange(SHORT)[None, :] < n, words, 0).astype(np.uint32).view(np.uint64)[:, : -(-n // 2)]
            left, right = np.flatnonzero((side == 0) & (size == n_l)), np.flatnonzero((side == 1) & (size == n_r))
            columns = np.ascontiguousarray(common[right].T)
            for i in range(0, len(left), AT_ONCE):
                some = left[i : i + AT_ONCE]
                bits = np.zeros((len(some), len(right)), np.uint8)
                for k, column in enumerate(columns):
                    bits += np.bitwise_count(common[some, k][:, None] ^ column[None, :])
                if counting:
                    looked += int(((np.abs(length[right][None, :] - length[some][:, None]) <= band) & ~(once[some][:, None] & (place[right][None, :] <= place[some][:, None]))).sum())
                most = 32 * n if max_ber >= 1 else int(np.floor(max_ber * 32 * n + 1e-6))
                x, y = np.nonzero(bits <= most)
                rate = bits[x, y] / (32.0 * n) if n else np.ones(len(x))
                x, y = some[x], right[y]
                ok = (rate <= max_ber) & (np.abs(length[y] - length[x]) <= band) & ~(once[x] & (place[y] <= place[x]))
                for u, v, r in zip(x[ok].tolist(), y[ok].tolist(), rate[ok].tolist(), strict=True):
                    a.append(min(ids[u], ids[v]))
                    b.append(max(ids[u], ids[v]))
                    ber.append(r)
    return a, b, ber, looked


def _blocks(scratch: Scratch, own: DataFrame, others: DataFrame | None, sizes: list[int], max_ber: float, band: float, share: int, counts: tuple[Accumulator, Accumulator] | None, name: str) -> DataFrame:
    """(a, b, ber) of rows (cell, file_id, fp, duration_sec, far) of one cell: pairs within ``own``, or of ``own`` and ``others``.

    A row of ``own`` looks into its bucket of durations and the next (with ``others`` also the one before), so each pair meets in one bucket. A bucket's sides are dealt into parts of about ``share`` rows.
    """
    spark = scratch.spark
    bucket = F.floor(F.col("duration_sec") / band)
    steps = [F.lit(0), F.lit(1)] if others is None else [F.lit(-1), F.lit(0), F.lit(1)]
    left = own.withColumn("home", bucket).withColumn("bucket", F.explode(F.array(*[F.col("home") + s for s in steps]))).withColumn("once", (F.col("home") == F.col("bucket")) if others is None else F.lit(False)).drop("home")
    right = (own if others is None else others).withColumn("bucket", bucket).withColumn("once", F.lit(False))
    count = lambda df, c: df.groupBy("cell", "bucket").agg(F.ceil(F.count("*") / F.when(F.max(F.size("fp")) <= SHORT, LARGER * share).otherwise(share)).cast("int").alias(c))
    parts = scratch.written(count(left, "parts_l").join(count(right, "parts_r"), ["cell", "bucket"]), f"{name}-parts")

    def dealt(df: DataFrame, mine: str, theirs: str, side: int) -> DataFrame:
        part = F.pmod(F.xxhash64("file_id"), F.col(f"parts_{mine}")).cast("int").alias(f"part_{mine}")
        every = F.explode(F.sequence(F.lit(0), F.col(f"parts_{theirs}") - 1)).alias(f"part_{theirs}")
        return df.join(parts, ["cell", "bucket"]).select("cell", "bucket", part, every, F.lit(side).alias("side"), "once", "file_id", "fp", "duration_sec", "far")

    both = dealt(left, "l", "r", 0).unionByName(dealt(right, "r", "l", 1))
    size = np.array(sizes, np.int64)
    looked, full = counts or (None, None)
    kind = own.schema["file_id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()

    def run(table: pa.Table) -> pa.Table:
        if pc.max(pc.list_value_length(table.column("fp"))).as_py() <= SHORT:
            a, b, ber, n = _short_block(table, max_ber, band, looked is not None)
            if looked is not None:
                looked.add(n)
                full.add(n)
            return pa.table({"a": pa.array(a, id_type), "b": pa.array(b, id_type), "ber": pa.array(ber, pa.float64())})
        rows = {c: table.column(c).to_pylist() for c in ("side", "once", "file_id", "fp", "duration_sec", "far")}
        sides = [{c: [v for v, s in zip(rows[c], rows["side"], strict=True) if s == k] for c in rows} for k in (0, 1)]
        a, b, ber, n, whole = _block(*sides, np.array(sides[0]["once"], bool), size, max_ber, band) if sides[0]["side"] and sides[1]["side"] else ([], [], [], 0, 0)
        if looked is not None:
            looked.add(n)
            full.add(whole)
        return pa.table({"a": pa.array(a, id_type), "b": pa.array(b, id_type), "ber": pa.array(ber, pa.float64())})

    return both.groupBy("cell", "bucket", "part_l", "part_r").applyInArrow(run, f"a {kind}, b {kind}, ber double")


def pairs(items: DataFrame, max_ber: float, band: float, share: int, counts: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """(a, b, ber) of all pairs of items (file_id, fp, duration_sec, none of them null) within the bounds. ``counts``: of pairs looked at, and looked at in full."""
    scratch = Scratch(items.sparkSession, "soundalike")
    items = items.select("file_id", F.col("fp").cast("array<long>").alias("fp"), F.col("duration_sec").cast("double").alias("duration_sec"))
    chosen = pivots_of(items, max_ber)
    rows = scratch.written(with_distances(items, chosen).withColumn("cell", F.lit(-1)), "rows")
    return _blocks(scratch, rows, None, [len(p[1]) for p in chosen], max_ber, band, share, counts, "pairs")


def links(items: DataFrame, max_ber: float, band: float, share: int, counts: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """(a, b): pairs within the bounds, enough of them to connect all items that any chain of such pairs connects."""
    spark = items.sparkSession
    scratch = Scratch(spark, "soundalike")
    items = items.select("file_id", F.col("fp").cast("array<long>").alias("fp"), F.col("duration_sec").cast("double").alias("duration_sec"))
    chosen = pivots_of(items, max_ber)
    sizes = [len(p[1]) for p in chosen]
    rows = with_distances(items, chosen)
    if chosen:
        common = F.array(*[F.least(F.size("fp"), F.lit(n)) for n in sizes])
        near = lambda i: (F.get(common, F.lit(i)) > 0) & (F.get("far", F.lit(i)) / (32.0 * F.get(common, F.lit(i))) <= max_ber) & (F.abs(F.col("duration_sec") - chosen[i][2]) <= band)
        rows = rows.withColumn("with", F.filter(F.array(*[F.when(near(i), F.lit(i)) for i in range(len(chosen))]), lambda i: i.isNotNull()))
    else:
        rows = rows.withColumn("with", F.array().cast("array<int>"))
    rows = scratch.written(rows.withColumn("cell", F.coalesce(F.get("with", F.lit(0)), F.lit(-1))), "rows")
    unclaimed = _blocks(scratch, rows.where("cell = -1").drop("with"), None, sizes, max_ber, band, share, counts, "unclaimed").select("a", "b")
    if not chosen:
        return scratch.written(unclaimed, "links")
    names = spark.createDataFrame([(i, p[0]) for i, p in enumerate(chosen)], f"pivot int, centre {items.schema['file_id'].dataType.simpleString()}")
    joined = rows.select("file_id", F.explode("with").alias("pivot")).join(F.broadcast(names), "pivot").where("centre <> file_id").select(F.least("centre", "file_id").alias("a"), F.greatest("centre", "file_id").alias("b"))
    shortest = {r["cell"]: r["n"] for r in rows.where("cell >= 0").groupBy("cell").agg(F.min(F.size("fp")).alias("n")).collect()}  # one row a pivot
    visits = F.array(*[
        F.when(
            ~F.array_contains("with", i)
            & (F.get("far", F.lit(i)) <= max_ber * 32 * (F.size("fp") + n) + 32 * F.greatest(F.lit(0), F.least(F.size("fp"), F.lit(n)) - shortest[i])),
            F.lit(i),
        )
        for i, n in enumerate(sizes) if i in shortest
    ])
    visitors = rows.withColumn("cell", F.explode(F.filter(visits, lambda i: i.isNotNull()))).drop("with")
    across = _blocks(scratch, rows.where("cell >= 0").drop("with"), visitors, sizes, max_ber, band, share, counts, "across").select("a", "b")
    return scratch.written(unclaimed.unionByName(across).unionByName(joined).distinct(), "links")
