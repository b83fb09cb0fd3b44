"""Helpers that several training-data operators use."""

from __future__ import annotations

import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder

U64 = np.uint64


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts go to Python in batches of so many rows at most: a batch of the default 10,000 is held on both sides at once, in buffers twice its size."""
    if int(spark.conf.get(ARROW_ROWS)) > rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one operator under one name in the folder that all executors share; ``drop`` deletes them once nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: a lineage cut that survives lost executors."""
    return Scratch(df.sparkSession, name).written(df, "rows")


def heaviest(counts: DataFrame, weight: str, most: int) -> DataFrame:
    """At most ``most`` rows of the greatest weights (1 or more): all above a bound taken from a histogram of weights, whose steps are sixteenths of a power of two."""
    step = F.floor(F.log2(weight) * 16)
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):  # 1,024 rows at most
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return counts.where(F.lit(False) if least is None else step >= least)


def released() -> None:
    """Memory that earlier tasks of this Python worker no longer use goes back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random64(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Everything in ASCII that is neither letter nor digit, for words without punctuation.
_APART = _SPACE.copy()
_APART[[i for i in range(128) if not chr(i).isalnum()]] = True
_BY_PLACE = random64(256, 7) | U64(1)
_BY_BLOCK = random64(1, 8)[0]
_CUT = re.compile(rb"[ \t-\r]")
SLICE_BYTES = 1 << 18


def _hash_slice(raw: bytes, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words of ``raw`` between bytes that are ``apart``, with A-Z lower-cased."""
    low = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = ~apart[low]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    first = starts[0]
    place = np.arange(first, len(low)) - np.repeat(starts, np.diff(np.append(starts, len(low))))
    value = low[first:].astype(np.uint64) + U64(1)
    value *= _BY_PLACE[place & 255] + (place >> 8).astype(np.uint64) * _BY_BLOCK
    value *= inside[first:]
    return mix64(np.add.reduceat(value, starts - first)), starts


def word_hashes(texts: list[str | None], punctuation: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and the bounds of each text's words (length n + 1).

    Words end at ASCII white space; without ``punctuation`` at all other ASCII signs too.
    Works on slices that end at white space and fit the cache, so memory does not follow the longest text beyond its hashes.
    """
    hashes, bounds, total = [], np.zeros(len(texts) + 1, np.int64), 0
    group, size, first = [], 0, 0
    apart = _SPACE if punctuation else _APART

    def flush(upto: int) -> None:
        nonlocal total, group, size, first
        if group:
            h, at = _hash_slice(b" ".join(group), apart)
            ends = np.cumsum([len(g) + 1 for g in group])
            bounds[first + 1 : upto + 1] = total + np.searchsorted(at, ends)
            hashes.append(h)
            total += len(h)
        group, size, first = [], 0, upto

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > SLICE_BYTES:
            flush(i)
            at = 0
            while at < len(raw):
                cut = _CUT.search(raw, min(at + SLICE_BYTES, len(raw)))
                end = cut.end() if cut else len(raw)
                h, _ = _hash_slice(raw[at:end], apart)
                hashes.append(h)
                total += len(h)
                at = end
            bounds[i + 1] = total
            first = i + 1
            continue
        group.append(raw)
        size += len(raw)
        if size > SLICE_BYTES:
            flush(i + 1)
    flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), bounds


def chunks(column, rows: int, most_bytes: int = 1 << 24):
    """Index ranges of an Arrow string column with few enough rows and characters to work on at once."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= rows or held + n > most_bytes):
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)
