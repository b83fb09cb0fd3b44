"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over hashed words, with document frequencies counted over all documents. A distributed randomised SVD
(range finder with power iterations: every task multiplies its passages, the sums meet per block of words) gives a basis of ``RANK``
latent directions, fitted once on all passages of all documents and items.
Texts are folded in by the inverse singular values, so that no direction (such as that of the commonest words) outweighs the others.

A candidate is a window of a document, as wide as the item and moved by a quarter of that at a time, whose latent vector has a cosine of ``NEARNESS`` or more with
the item's. Around candidates the rule is checked, a word-level longest common subsequence: an item is found if any stretch of ``STRETCH`` times its length keeps
``SURE`` of its words in order, or ``LIKELY`` of them and its answer too (column ``answer`` where given, else its rarest words), which finds paraphrases.

Cosines are only taken where the rule can hold at all: a stretch that lacks so many of the item's rarest words that it can't meet the rule is ruled out first,
by an inverted index of these words. That bound is exact and loses nothing, so the result is the same as with cosines of all windows, for a fraction of the work. What the
cosine loses against the rule alone is measured in the tests and the README (recall of 0.92 or more for rewordings of items of 8 to 200 words).

Items are compared in blocks of ``ITEM_BLOCK`` and their words (a bounded number of words each block), so what is broadcast stays bounded however large the benchmark
is; each block reads the documents once.

Defined results: words are lower-cased and end at anything in ASCII that is no letter or digit; null or empty texts match
nothing; items without words are left out; equal items are each reported; repeated documents are each reported, a null id as
null; an empty table on either side gives no rows; other columns are ignored; very long texts are searched in slices of windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, U64, chunks, mix64, random64, released, word_hashes

BUCKETS = 1 << 15
RANK = 64
#: Tasks of a fit, at least, and passages a task beyond that: each sends its part of the product, BUCKETS x (RANK + 8) numbers, however few its passages are.
FIT_TASKS, TASK_PASSAGES = 4, 1 << 17
PASSAGE_WORDS = 40
#: Words that a batch of passages holds more often than this are multiplied as a matrix, others one occurrence of each at a time.
OFTEN = 16
#: Items and words of items in a block: a few hundred MB in a task at most.
ITEM_BLOCK, BLOCK_WORDS = 1 << 14, 1 << 20
SURE, LIKELY = 0.7, 0.5
NEARNESS = 0.25
#: An item is looked for in stretches of so many times its words.
STRETCH = 2
#: Bounds what a chunk of texts takes in memory.
MARKS_AT_ONCE = 1 << 22
WINDOW_SLICE = 1 << 16
ANSWER_WORDS = 3


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(49)).astype(np.int64)


@dataclass(frozen=True)
class Item:
    item_id: int
    words: list[int]
    answer: frozenset[int]
    masks: dict[int, int]

    @classmethod
    def of(cls, item_id: int, hashes: np.ndarray, answer: frozenset[int]) -> Item:
        masks: dict[int, int] = {}
        for i, h in enumerate(hashes.tolist()):
            masks[h] = masks.get(h, 0) | 1 << i
        return cls(item_id, hashes.tolist(), answer, masks)

    def common(self, words: list[int]) -> int:
        """Length of the longest common subsequence, 64 and more words a step in one integer."""
        full = (1 << len(self.words)) - 1
        row = full
        for w in words:
            hit = row & self.masks.get(w, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(self.words) - row.bit_count()


def _cut(places: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """All passages of texts, given the places of their words and the texts' bounds."""
    sizes = np.diff(bounds)
    count = -(-sizes // PASSAGE_WORDS)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(bounds[:-1], count) + PASSAGE_WORDS * nth
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(places)).astype(np.int32)), pa.array(places.astype(np.int16)))


def gathered(docs: DataFrame, fit_passages: int | None = None) -> DataFrame:
    """Of each task, how many documents hold each bucket's words (bucket, n; at BUCKETS: all documents), and all passages (words).

    With ``fit_passages`` only so many passages, the first by hash (key, words): each text offers the passage that a hash of it points to, equal ones one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, held = np.zeros(BUCKETS + 1, np.int64), 0, {}
        for b in batches:
            for lo, hi in chunks(b.column("text"), 2000, 1 << 22):
                h, bounds = word_hashes(b.column("text")[lo:hi].to_pylist(), punctuation=False)
                places = buckets(h)
                seen = (np.repeat(np.arange(hi - lo), np.diff(bounds)) * BUCKETS + places).astype(np.uint32)
                seen.sort()
                total[:BUCKETS] += np.bincount(seen[np.concatenate(([True], seen[1:] != seen[:-1]))[: len(seen)]] % BUCKETS, minlength=BUCKETS)
                n += hi - lo
                if fit_passages is None:
                    cut = _cut(places, bounds)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(cut), kind) for kind in (pa.int64(), pa.int64(), pa.int64())] + [cut], names=["bucket", "n", "key", "words"])
                    continue
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if e > s:
                        key = int(mix64(np.array([h[s:e].sum()]))[0])
                        at = s + key % max(1, e - s - PASSAGE_WORDS + 1)
                        held[key >> 1] = places[at : min(e, at + PASSAGE_WORDS)].astype(np.int16)
                if len(held) > 2 * fit_passages:
                    held = {k: held[k] for k in sorted(held)[:fit_passages]}
        total[BUCKETS] = n
        at = np.flatnonzero(total)
        keys = sorted(held)[:fit_passages]  # none if all are out already
        none = lambda k, kind: pa.nulls(k, kind)
        short = pa.list_(pa.int16())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), none(len(at), pa.int64()), none(len(at), short)], names=["bucket", "n", "key", "words"])
        yield pa.RecordBatch.from_arrays([none(len(keys), pa.int64()), none(len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array([held[k] for k in keys], short)], names=["bucket", "n", "key", "words"])

    return docs.mapInArrow(run, "bucket long, n long, key long, words array<short>")


def document_frequencies(gathered: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket's words, over all documents, and the number of documents."""
    got = gathered.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS + 1 rows at most
    out = np.zeros(BUCKETS + 1, np.int64)
    out[got["bucket"]] = got["n"]
    return out[:BUCKETS], int(out[BUCKETS])


def _passages(texts: DataFrame) -> DataFrame:
    """All passages of ``texts``, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column("text"), 2000, 1 << 22):
                h, bounds = word_hashes(b.column("text")[lo:hi].to_pylist(), punctuation=False)
                yield pa.RecordBatch.from_arrays([_cut(buckets(h), bounds)], names=["words"])

    return texts.mapInArrow(run, "words array<short>")


def fitted_passages(gathered: DataFrame, items: DataFrame, fit_passages: int | None = None) -> DataFrame:
    """What the basis is fitted on: all passages of documents and items. With ``fit_passages`` the first so many of documents by hash, and all of the items, dealt over ``FIT_TASKS`` tasks."""
    if fit_passages is None:
        own = gathered.where("words IS NOT NULL").select("words")
        return own.unionByName(_passages(items.select("text"))).coalesce(max(FIT_TASKS, -(-own.count() // TASK_PASSAGES)))
    sample = gathered.where("key IS NOT NULL").select("key", "words").dropDuplicates(["key"]).orderBy("key").limit(fit_passages).select("words")
    return sample.unionByName(_passages(items.select("text"))).repartition(FIT_TASKS)


def _add_products(total: np.ndarray, words: pa.ListArray, scaled: np.ndarray, weight: np.ndarray) -> bool:
    """Adds every passage's product with the ``scaled`` basis, over its squared length, to the rows of ``total`` that its words have; whether there was any word."""
    ends = words.offsets.to_numpy()
    sizes = np.diff(ends)
    places = words.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    if not len(places):
        return False
    n = len(sizes)
    grid = np.full((int(sizes.max()), n), BUCKETS, np.int64)
    grid.T[np.arange(len(grid))[None, :] < sizes[:, None]] = places
    product, square = np.zeros((n, scaled.shape[1]), np.float32), np.zeros(n, np.float32)
    for row in grid:  # the passages' first words, then their second ones, ...
        product += scaled.take(row, axis=0)
        square += weight.take(row) ** 2
    product /= np.where(square > 0, square, 1)[:, None]
    order = np.argsort(places, kind="stable")
    owner, sorted_ = np.repeat(np.arange(n), sizes)[order], places[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    count = np.diff(np.append(first, len(places)))
    by_count = np.argsort(-count, kind="stable")
    first, count = first[by_count], count[by_count]
    often = int((count > OFTEN).sum())
    sums = np.zeros((len(first), scaled.shape[1]), np.float32)
    if often:
        many = count[:often]
        at = np.arange(many.sum()) + np.repeat(first[:often] - np.cumsum(many) + many, many)
        sums[:often] = np.bincount(np.repeat(np.arange(often), many) * n + owner[at], minlength=often * n).reshape(often, n).astype(np.float32) @ product
    for r in range(OFTEN):
        end = int((count > r).sum())
        sums[often:end] += product.take(owner[first[often:end] + r], axis=0)
    total[sorted_[first]] += sums
    return True


def latent_basis(passages: DataFrame, idf: np.ndarray, rounds: int = 2, extra: int = 8) -> np.ndarray:
    """Right singular vectors of the TF-IDF rows of ``passages`` (words: buckets) over their singular values: BUCKETS x RANK, zero for directions that aren't there."""
    width, block = RANK + extra, 256

    def times(basis: np.ndarray) -> np.ndarray:
        """A^T A times ``basis``: each task's part as blocks of rows, summed per block."""
        scaled = np.vstack([basis * idf[:, None], np.zeros((1, width))]).astype(np.float32)  # the last row fills short passages up
        weight = np.append(idf, 0).astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            released()
            total, some = np.zeros((BUCKETS, width), np.float32), False
            for b in batches:
                some = _add_products(total, b.column("words"), scaled, weight) or some
            if some:
                total *= weight[:-1, None]
                at = np.arange(0, BUCKETS, block)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([total[i : i + block].tobytes() for i in at.tolist()], pa.binary())], names=["block", "part"])

        def add(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in frame["part"])
            return pd.DataFrame({"block": [frame["block"].iloc[0]], "part": [np.asarray(total, np.float32).tobytes()]})

        got = passages.mapInArrow(run, "block long, part binary").groupBy("block").applyInPandas(add, "block long, part binary").toPandas()
        out = np.zeros((BUCKETS, width))
        for at, part in zip(got["block"], got["part"], strict=True):
            out[at : at + block] = np.frombuffer(part, np.float32).reshape(-1, width)
        return out

    start = (random64(BUCKETS * width, 41).astype(np.float64) / 2**64 - 0.5).reshape(BUCKETS, width)
    basis = np.linalg.qr(start)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(times(basis))[0]
    core = basis.T @ times(basis)
    values, turn = np.linalg.eigh((core + core.T) / 2)
    order = np.argsort(-values)[:RANK]
    size = np.sqrt(np.maximum(values[order], 0))
    return basis @ (turn[:, order] * np.where(size > 1e-3 * max(size[0], 1e-9), 1 / np.maximum(size, 1e-9), 0))


class Searcher:
    """Finds the items of one block in texts: stretches that can meet the rule, candidate windows in them by latent cosine, then the rule.

    A stretch that meets m of an item's n places meets k of any n - m + k of them. So k of the rarest words (the marks) must stand in it, with m for ``SURE``
    and once more for ``LIKELY``, where those of the answer may serve instead.
    """

    def __init__(self, vectors: np.ndarray, idf: np.ndarray, items: list[Item]):
        self.vectors, self.items = vectors, items
        latent = [vectors[buckets(np.array(x.words, np.uint64))].sum(axis=0, dtype=np.float64) for x in items]
        self.latent = [x / max(np.linalg.norm(x), 1e-12) for x in latent]
        marks: list[np.ndarray] = []
        owner: list[int] = []
        least: list[int] = []
        for i, item in enumerate(items):
            h = np.array(item.words, np.uint64)
            order = h[np.lexsort((h, -idf[buckets(h)]))]
            either = []
            for share in (SURE, LIKELY):
                need = math.ceil(share * len(h) - 1e-9)
                k = max(1, need // 4)
                either.append((np.unique(order[: len(h) - need + k]), k))
            sure, likely = either
            if item.answer:
                answer = np.array(sorted(item.answer), np.uint64)
                answer = answer[np.argsort(-idf[buckets(answer)], kind="stable")][: len(answer) - -(-2 * len(answer) // 3) + 1]
                likely = min(likely, (answer, 1), key=lambda x: np.exp(-idf[buckets(x[0])]).sum() / x[1])
            for words, k in (sure, likely) if item.answer else (sure,):
                marks.append(words), owner.append(i), least.append(k)
        self.owner, self.least = np.array(owner, np.int64), np.array(least, np.int64)
        self.reach = np.array([STRETCH * len(items[i].words) for i in owner], np.int64)
        self.words, place = np.unique(np.concatenate([np.empty(0, np.uint64), *marks]), return_inverse=True)
        #: Places in ``words`` and what they mark, as one sorted number.
        self.listed = np.sort(place * len(owner) + np.repeat(np.arange(len(owner)), [len(m) for m in marks]))
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.words >> U64(44)).astype(np.int64)] = True

    def stretches(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item's place, document, first and end word) of what has the marks of an item; stretches of a document that overlap are joined."""
        at = np.flatnonzero(self.some[(h >> U64(44)).astype(np.int64)])
        if not len(at):
            return
        place = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        same = self.words[place] == h[at]
        at, place = at[same], place[same]
        total = len(self.owner)
        count = np.searchsorted(self.listed, (place + 1) * total) - np.searchsorted(self.listed, place * total)
        group = max(1, total * MARKS_AT_ONCE // max(MARKS_AT_ONCE, int(count.sum())))
        parts = [np.empty((0, 4), np.int64)]
        for lo in range(0, total, group):
            first = np.searchsorted(self.listed, place * total + lo)
            count = np.searchsorted(self.listed, place * total + min(lo + group, total)) - first
            which = self.listed[np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)] % total
            key = np.sort(which << 40 | np.repeat(at, count))
            which, where = key >> 40, key & ((1 << 40) - 1)
            last = np.arange(len(key)) + self.least[which] - 1
            i = np.flatnonzero(last < len(key))
            i = i[(which[last[i]] == which[i]) & (where[last[i]] - where[i] < self.reach[which[i]])]
            begin, end = where[i], where[last[i]]
            doc = np.searchsorted(bounds, begin, side="right") - 1
            inside = end < bounds[doc + 1]
            i, begin, end, doc = i[inside], begin[inside], end[inside], doc[inside]
            reach = self.reach[which[i]]
            parts.append(np.column_stack((self.owner[which[i]], doc, np.maximum(bounds[doc], end - reach + 1), np.minimum(bounds[doc + 1], begin + reach))))
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        held: list[int] | None = None
        for item, doc, lo, hi in rows.tolist():
            if held and held[:2] == [item, doc] and lo <= held[3]:
                held[3] = max(held[3], hi)
                continue
            if held:
                yield tuple(held)
            held = [item, doc, lo, hi]
        if held:
            yield tuple(held)

    def best(self, item: Item, h: np.ndarray) -> tuple[float, bool, int] | None:
        """(share of words kept, answered, first word) of the best stretch of ``h`` that meets the rule."""
        span = len(item.words)
        words = h.tolist()
        at = [i for i, w in enumerate(words) if w in item.masks or w in item.answer]  # no other word counts, and a stretch may begin with one of them
        words = [words[i] for i in at]
        found, end = None, 0
        for i, start in enumerate(at):
            while end < len(at) and at[end] < start + STRETCH * span:
                end += 1
            if end - i < LIKELY * span:
                continue
            some = words[i:end]
            answered = bool(item.answer) and len(item.answer.intersection(some)) * 3 >= 2 * len(item.answer)
            need = (LIKELY if answered else SURE) * span
            most = min(end - i, sum(item.masks[w].bit_count() for w in item.masks.keys() & set(some)))  # the places of the item that could be met
            if most < need or found and (most / span, answered) <= found[:2]:
                continue
            common = item.common(some)
            if common >= need and (not found or (common / span, answered) > found[:2]):
                found = (common / span, answered, start)
        return found

    def windows(self, which: int, h: np.ndarray) -> Iterator[tuple[float, int]]:
        """(cosine, first word) of the candidate windows of ``h``."""
        n = len(self.items[which].words)
        step = max(1, n // 4)
        for at in range(0, max(1, len(h) - n + step), WINDOW_SLICE):
            part = h[at : at + WINDOW_SLICE + n]
            total = np.zeros((len(part) + 1, self.vectors.shape[1]))
            np.cumsum(self.vectors[buckets(part)], axis=0, dtype=np.float64, out=total[1:])
            first = np.arange(0, max(1, min(WINDOW_SLICE, len(part) - n + step)), step)
            sums = total[np.minimum(first + n, len(part))] - total[first]
            near = sums @ self.latent[which] / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)
            for i in np.flatnonzero(near >= NEARNESS):
                yield float(near[i]), at + int(first[i])

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, Item, float, float, bool]]:
        h, bounds = word_hashes(texts, punctuation=False)
        best: dict[tuple[int, int], tuple] = {}
        for which, doc, lo, hi in self.stretches(h, bounds):
            item = self.items[which]
            span, around = len(item.words), []
            for near, at in self.windows(which, h[lo:hi]):  # any stretch that holds a candidate window lies in its surroundings
                start, end = max(0, at - span), min(hi - lo, at + STRETCH * span)
                if around and start <= around[-1][1]:
                    around[-1] = (around[-1][0], end, max(around[-1][2], near))
                else:
                    around.append((start, end, near))
            for start, end, near in around:
                found = self.best(item, h[lo + start : lo + end])
                if found and ((doc, which) not in best or found[:2] > best[doc, which][:2]):
                    place = self.vectors[buckets(h[lo + start + found[2] :][:span])].sum(axis=0, dtype=np.float64)
                    best[doc, which] = (*found[:2], max(near, float(place @ self.latent[which] / max(np.linalg.norm(place), 1e-12))))
        for (doc, which), (share, answered, near) in sorted(best.items(), key=lambda x: (x[0][0], self.items[x[0][1]].item_id)):
            yield doc, self.items[which], near, share, answered


def find_items(docs: DataFrame, vectors: np.ndarray, idf: np.ndarray, items: list[Item]) -> DataFrame:
    """Rows doc_id, item_id, cosine, kept_words (share in order), answered for every item found in a document."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, idf, items))  # BUCKETS x RANK numbers and a block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        search = Searcher(*shared.value)
        for b in batches:
            for lo, hi in chunks(b.column("text"), 500, 1 << 21):
                ids = b.column("doc_id")[lo:hi].to_pylist()
                hits = list(search(b.column("text")[lo:hi].to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[x[0]] for x in hits], pa.int64()), pa.array([x[1].item_id for x in hits], pa.int64()), pa.array([x[2] for x in hits], pa.float64()), pa.array([x[3] for x in hits], pa.float64()), pa.array([x[4] for x in hits], pa.bool_())],
                    names=["doc_id", "item_id", "cosine", "kept_words", "answered"],
                )

    return docs.mapInArrow(run, "doc_id long, item_id long, cosine double, kept_words double, answered boolean")


def _items(rows: list, idf: np.ndarray) -> list[Item]:
    h, bounds = word_hashes([r["text"] for r in rows], punctuation=False)
    out = []
    for r, s, e in zip(rows, bounds[:-1], bounds[1:], strict=True):
        if e > s:
            if r["answer"]:
                answer = frozenset(word_hashes([r["answer"]], punctuation=False)[0].tolist())
            else:
                own = np.unique(h[s:e])
                answer = frozenset(own[np.argsort(-idf[buckets(own)], kind="stable")][:ANSWER_WORDS].tolist())
            out.append(Item.of(r["item_id"], h[s:e], answer))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, fit_passages: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text"), answer.alias("answer"))
    scratch = Scratch(docs.sparkSession, "lsi")
    seen = scratch.written(gathered(rows.select("text"), fit_passages), "documents")
    frequency, n = document_frequencies(seen)
    idf = np.log((1 + n) / (1 + frequency)) + 1  # positive, so that words all documents hold count too
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // ITEM_BLOCK), -(-size["bytes"] // (2 * BLOCK_WORDS)))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    passages = fitted_passages(seen, items, fit_passages)
    if fit_passages is not None:
        passages = scratch.written(passages, "passages")
    vectors = (idf[:, None] * latent_basis(passages, idf)).astype(np.float32)
    scratch.drop()
    found = None
    for block in range(blocks):
        part = dealt.where(F.col("block") == block)
        hits = find_items(rows, vectors, idf, _items(part.orderBy("item_id", "text").collect(), idf))
        found = hits if found is None else found.unionByName(hits)
    return found


def op7_lsi_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
