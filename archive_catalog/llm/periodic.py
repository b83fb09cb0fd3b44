"""Periodic runs of words by recompression.

A run is a maximal stretch of words with smallest period q whose length is at least ``least`` words and ``power`` times q.

Each batch of documents becomes a run-length grammar by recompression: levels alternate between block compression (equal neighbours
become one symbol) and pair compression (symbols are dealt into left and right ones by a hash, and a left one followed by a right one
becomes one symbol). Whether two neighbours are joined depends on these two alone, so equal stretches are cut alike but at their ends,
and the longest common extension of two positions takes a step or two a level: up the grammar while both stand at the start of a symbol,
down again to where they part. Symbols belong to one document; levels end once no symbol occurs twice, as then nothing is left to compare.

Candidates lie on a harmonic grid: a run of period q has at least max(least - q, (power - 1) q) neighbouring positions that equal those q further on, so one of
them is a multiple of that number, which leaves about n log n candidates for n words. One whose word differs from that q further on, or where this holds half a grid step away on
both sides, is no run's. The grammar's extensions to both sides answer for the others exactly. A stretch found with several periods has the least.

Memory follows a batch of about ``BATCH_WORDS`` words, or one document if that is longer; candidates are made in blocks of ``BLOCK``.

Defined results: a null text is an empty one, which has no runs; null ids stay null, repeated rows are each searched; an empty table gives no rows; other columns are ignored.
Words are what lies between ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import chunks

LEAST = 24
POWER = 3
BATCH_WORDS = 1 << 18
BLOCK = 1 << 20
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@dataclass
class Level:
    """Symbols (with a sentinel at the end) and how they are joined: ``cuts`` has the gaps between joined groups, ``rank`` for each gap how many cuts lie up to it."""

    symbols: np.ndarray
    blocks: bool
    cuts: np.ndarray | None = None
    rank: np.ndarray | None = None


def _sides(symbols: np.ndarray, seed: int) -> np.ndarray:
    x = (symbols.astype(np.uint64) + np.uint64(seed << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63) == 1


def recompress(symbols: np.ndarray) -> list[Level]:
    """Levels of the grammar of ``symbols`` (numbers from 0), the last without cuts."""
    levels, free, n = [], int(symbols.max(initial=-1)) + 1, len(symbols)
    symbols = np.append(symbols.astype(np.int64), -1)
    counts = np.bincount(symbols[:-1])
    while (counts > 1).any():
        level = Level(symbols, len(levels) % 2 == 0)
        here, after = symbols[:-2], symbols[1:-1]
        if level.blocks:
            joined = here == after
        else:
            right = _sides(symbols[:-1], len(levels))
            joined = ~right[:-1] & right[1:]
        first = np.concatenate(([True], ~joined, [True]))
        level.cuts, level.rank = np.flatnonzero(first), np.cumsum(first)
        starts, size = level.cuts[:-1], np.diff(level.cuts)
        upper = symbols[starts].copy()
        many = np.flatnonzero(size > 1)
        if len(many):
            codes = upper[many] * (n + 1) + size[many] if level.blocks else upper[many] * free + symbols[starts[many] + 1]
            names, which = np.unique(codes, return_inverse=True)
            upper[many] = free + which
            free += len(names)
        levels.append(level)
        symbols = np.append(upper, -1)
        counts = np.bincount(upper)
    levels.append(Level(symbols, True))
    return levels


def extensions(levels: list[Level], one: np.ndarray, two: np.ndarray, forward: bool = True) -> np.ndarray:
    """How many symbols from gap ``one`` on equal those from gap ``two`` on (``one`` < ``two``), or before them if not ``forward``."""
    step, look = (1, 0) if forward else (-1, -1)

    def run(level: Level, gap: np.ndarray) -> np.ndarray:
        return level.cuts[level.rank[gap]] - gap if forward else gap - level.cuts[level.rank[gap - 1] - 1]

    def advance(level: Level, who: np.ndarray) -> np.ndarray:
        """Moves ``who`` over equal symbols as far as they tell at this level; who may go on."""
        same = level.symbols[a[who] + look] == level.symbols[b[who] + look]
        at, more = who[same], same.copy()
        if level.blocks and len(at):
            p, q = run(level, a[at]), run(level, b[at])
            far = step * np.minimum(p, q)
            more[same] = p == q
        else:
            far = step
        a[at] += far
        b[at] += far
        return more

    a, b = one.astype(np.int64), two.astype(np.int64)
    top, live = np.zeros(len(a), np.int32), np.arange(len(a))
    for k, level in enumerate(levels[:-1]):
        apart = (level.cuts[level.rank[a[live]] - 1] != a[live]) | (level.cuts[level.rank[b[live]] - 1] != b[live])
        held = np.flatnonzero(apart)
        stay = np.ones(len(live), bool)
        stay[held] = advance(level, live[held])
        live = live[stay]
        a[live], b[live] = level.rank[a[live]] - 1, level.rank[b[live]] - 1
        top[live] = k + 1
        if not len(live):
            break
    for k in range(len(levels) - 2, -1, -1):
        who = np.flatnonzero(top > k)
        if len(who):
            level = levels[k]
            a[who], b[who] = level.cuts[a[who]], level.cuts[b[who]]
            advance(level, who)
    return step * (a - one)


def _grid(sizes: np.ndarray, starts: np.ndarray, least: int, power: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, position, period, grid step) of candidates, in blocks."""
    periods = np.where(sizes >= least, sizes // power, 0)
    before = np.concatenate(([0], np.cumsum(periods)))
    for lo in range(0, int(before[-1]), BLOCK // 4):
        kinds = np.arange(lo, min(lo + BLOCK // 4, int(before[-1])))
        doc = np.searchsorted(before, kinds, "right") - 1
        period = kinds - before[doc] + 1
        step = np.maximum(least - period, (power - 1) * period)
        count = (sizes[doc] - period + step - 1) // step
        total = np.cumsum(count)
        first = 0
        while first < len(kinds):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + BLOCK, "right")))
            n = count[first:last]
            each = np.repeat(np.arange(first, last), n)
            place = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            yield doc[each], starts[doc[each]] + place * step[each], period[each], step[each]
            first = last


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """(start, end, period) of all runs, in order, of documents of ``sizes`` words laid end to end; no number stands in two documents."""
    starts = np.cumsum(sizes) - sizes
    levels, found = None, []
    for doc, at, period, step in _grid(sizes, starts, least, power):
        hit = np.flatnonzero(words[at] == words[at + period])
        doc, at, period, half = doc[hit], at[hit], period[hit], step[hit] // 2
        lo, hi = starts[doc], starts[doc] + sizes[doc] - period
        left, right = at - half, at + half
        ok = (left >= lo) & (words[np.maximum(left, 0)] == words[np.maximum(left, 0) + period])
        right = np.minimum(right, hi - 1)
        ok |= (at + half < hi) & (words[right] == words[right + period])
        at, period = at[ok], period[ok]
        if len(at):
            levels = levels or recompress(words)
            end = at + period + extensions(levels, at, at + period)
            begin = at - extensions(levels, at, at + period, forward=False)
            keep = end - begin >= np.maximum(least, power * period)
            found.append(np.unique(np.stack([begin[keep], end[keep], period[keep]], axis=1), axis=0))
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.unique(np.concatenate(found), axis=0)  # by start, end, period
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def _searched(texts: list[list[bytes]], least: int, power: int) -> tuple[list[list[dict]], list[str]]:
    """Runs, and the text without the words after each run's first period, of each document."""
    numbers, free = [], 0
    for words in texts:
        own: dict[bytes, int] = {}
        numbers.append(np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words)) + free)
        free += len(own)
    sizes = np.array([len(w) for w in texts], np.int64)
    runs = find_runs(np.concatenate([*numbers, np.empty(0, np.int64)]), sizes, least, power)
    starts = np.cumsum(sizes) - sizes
    owner = np.searchsorted(starts + sizes, runs[:, 0], "right")
    listed: list[list[dict]] = [[] for _ in texts]
    kept = [None] * len(texts)
    for k, (begin, end, period) in zip(owner.tolist(), runs.tolist(), strict=True):
        begin, end = begin - int(starts[k]), end - int(starts[k])
        listed[k].append({"start": begin, "length": end - begin, "period": period})
        kept[k] = np.zeros(sizes[k] + 1, np.int64) if kept[k] is None else kept[k]
        kept[k][begin + period] += 1
        kept[k][end] -= 1
    out = []
    for k, words in enumerate(texts):
        listed[k].sort(key=lambda r: (r["start"], r["period"]))
        if kept[k] is not None:
            inside = np.cumsum(kept[k])[:-1].tolist()
            words = [w for w, n in zip(words, inside, strict=True) if not n]
        out.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    return listed, out


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (array of start, length, period, by start, then period) and ``collapsed``, the text with each run's first period only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column("text"), 1000, 1 << 22):
                words = [(t or "").encode("utf-8", "surrogatepass").split() for t in b.column("text")[lo:hi].to_pylist()]
                first = 0
                while first < len(words):
                    last, n = first + 1, len(words[first])
                    while last < len(words) and n + len(words[last]) <= BATCH_WORDS:
                        n += len(words[last])
                        last += 1
                    listed, collapsed = _searched(words[first:last], least, power)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id")[lo + first : lo + last], pa.array([len(w) for w in words[first:last]], pa.int64()), pa.array(listed, _RUNS), pa.array(collapsed, pa.string())],
                        names=["doc_id", "n_words", "runs", "collapsed"],
                    )
                    first = last

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, of equal ones that with the smallest start, then period; null without runs."""
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | (
        (x["length"] * y["period"] == y["length"] * x["period"]) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"])))
    )
    return F.reduce(runs, F.try_element_at(runs, F.lit(1)), lambda best, x: F.when(better(x, best), x).otherwise(best))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where about every tenth text's words from some place on repeat with a period of at most a third of them: which, where and how follows from the id."""
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p = F.col("a"), F.col("p")
    repeated = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.element_at("words", (a + F.pmod(i - a, p) + 1).cast("int"))))
    return rows.select("doc_id", F.when(a.isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    found = periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    best = {c: F.col(f"best.{c}") for c in ("start", "length", "period")}
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(c.alias(k) for k, c in best.items()), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
