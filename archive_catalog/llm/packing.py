"""Packing token sequences into windows by best-fit decreasing.

Texts are tokenised whole; a text longer than a window is first cut into full windows and a rest. Best fit decreasing looks
only at lengths, and pieces of one length are interchangeable, so the placing runs on the histogram of piece lengths
(at most ``window`` counts, however large the input): lengths fall from the longest, a segment tree over remaining capacity
finds the tightest open window that still fits, and runs of equal windows are handled as one. The result is exactly what the
piece-by-piece algorithm gives for the whole input at once; it is a list of ranges (length, first rank, end rank,
first window, offset) that grows with the window size, not with the input. Pieces take their place by their rank within their length,
counted per task plus offsets per (task, length): no piece is shuffled to be ranked. So pieces of one length change places with the way that the input is split into files; the
windows stay as well filled.

Defined results: a null text is an empty one and packs as its end token alone; equal rows are packed separately; a null id stays
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, released, written

WINDOW = 2048
END_ID = 1
CACHE_WORDS = 400_000
#: Control characters that Python takes for white space and the tokenizer does not.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Words of these characters alone are in composed form; İ lower-cases to two characters.
_PLAIN = re.compile(r"[!-\u012f\u0131-\u024f]+")
_NUMERIC = "\\d\u00b2\u00b3\u00b9\u00bc\u00bd\u00be"
#: The tokenizer's own parts of a lower-cased plain word: some endings, letters, single digits, runs of other signs.
_PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W_{_NUMERIC}]+|[{_NUMERIC}]|(?:[^\w\s]|_)+")
_SIGNS = frozenset(".,;:!?)\"'-")


def _marked(word: str) -> str:
    """A lower-cased plain word with a zero byte after each of its parts. Most consist of letters and one sign."""
    if word[:-1].isalpha() and word[-1:] in _SIGNS:
        return f"{word[:-1]}\0{word[-1]}\0"
    return _PART.sub("\\g<0>\0", word)


class WordTokens:
    """Token ids of texts, as little-endian 32-bit bytes, with a bounded cache of white-space separated words.

    The tokenizer never joins characters across white space, so a text's ids are its words' ids in order. Words that the cache lacks
    are encoded together: those of plain Latin characters by a byte-pair encoder with the same vocabulary, in which a zero byte
    stands for the end of a part, others by the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        special = {t["content"] for t in content["added_tokens"]}
        byte_of = {}
        for code in range(256):  # the letter by which the vocabulary writes a byte
            if code < 128:
                byte_of[letters.pre_tokenize_str(chr(code))[0][0]] = code
            else:
                pair = chr(code).encode()
                byte_of.update(zip(letters.pre_tokenize_str(chr(code))[0][0], pair, strict=True))
        for text in ("\u0800", "\U00010000", "\U00040000", "\U00100000", *(chr(c) for c in range(0x100, 0x800, 0x40)), *(chr(c) for c in range(0x1000, 0xD000, 0x1000)), "\ue000", "\uf000"):
            byte_of.update(zip(letters.pre_tokenize_str(text)[0][0], text.encode(), strict=True))
        ranks = {}
        for token, number in content["model"]["vocab"].items():
            if token in special:
                continue
            body, end = (token[:-4], b"\0") if token.endswith("</w>") else (token, b"")
            if all(c in byte_of for c in body):
                ranks[bytes(byte_of[c] for c in body) + end] = number
        free = max(content["model"]["vocab"].values()) + 1
        for code in range(256):  # bytes that no UTF-8 text holds
            if bytes([code]) not in ranks:
                ranks[bytes([code])] = free
                free += 1
        self.space = ranks[b" "]
        self.bpe = tiktoken.Encoding("words", pat_str="[^\\x00 ]+\\x00| ", mergeable_ranks=ranks, special_tokens={})

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> list[bytes]:
        marked = " ".join([w + "\0" if w.isalpha() else _marked(w) for w in " ".join(words).lower().split(" ")])
        ids = np.asarray(self.bpe.encode_ordinary(marked), "<u4")
        cuts = np.flatnonzero(ids == self.space)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        plain = [w for w in words if _PLAIN.fullmatch(w) and "<|" not in w]
        for i in range(0, len(plain), 50_000):
            part = plain[i : i + 50_000]
            self.cache.update(zip(part, self._plain(part), strict=True))
        rest = list(words.difference(plain))
        self.cache.update(zip(rest, self._encode(rest), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, get = [], self.cache.get
        for text in texts:
            if any(o in text for o in _ODD):
                out.append(self._encode([text])[0])
                continue
            words = text.split()
            got = list(map(get, words))
            if None in got:
                new = {w for w, g in zip(words, got, strict=True) if g is None}
                self._learn(new if len(self.cache) + len(new) <= CACHE_WORDS else set(words))
                got = list(map(self.cache.__getitem__, words))
            out.append(b"".join(got))
        return out


class TightestFit:
    """Segment tree over capacities 0..size: which capacities have open windows; finds the least one that is large enough."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.open = [False] * (2 * self.base)

    def mark(self, capacity: int, has: bool) -> None:
        i = self.base + capacity
        while i and self.open[i] != has:
            self.open[i] = has
            i //= 2
            if i and has is False:
                has = self.open[2 * i] or self.open[2 * i + 1]

    def least(self, need: int) -> int | None:
        i = self.base + need
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.base
            i //= 2
        return None


def best_fit_decreasing(counts: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """``counts[length]`` pieces -> (length, first rank, end rank, first window, offset): rank r goes to first window + r - first rank."""
    tree, runs, opened, plan = TightestFit(window), [deque() for _ in range(window + 1)], 0, []
    for length in range(window, 0, -1):
        rank, left = 0, int(counts[length])
        while left:
            room = tree.least(length)
            if room is None:  # a piece opens a window, and the next equal pieces fit the same one tightest
                per = window // length
                whole = left // per
                n, fill = (whole, per) if whole else (1, left)
                for j in range(fill):
                    plan.append((length, rank, rank + n, opened, j * length))
                    rank += n
                room, first = window - fill * length, opened
                opened += n
                left -= n * fill
            else:
                first, n = runs[room].popleft()
                per = room // length
                take, fill = (min(n, left // per), per) if left >= per else (1, left)
                if take < n:
                    runs[room].appendleft((first + take, n - take))
                if not runs[room]:
                    tree.mark(room, False)
                for j in range(fill):
                    plan.append((length, rank, rank + take, first, window - room + j * length))
                    rank += take
                left -= take * fill
                n, room = take, room - fill * length
            if room:
                runs[room].append((first, n))
                tree.mark(room, True)
    return plan


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    end = np.asarray([end_id], "<u4").tobytes()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        released()
        task, seen, encode = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), WordTokens(tokenizer_path)
        for b in batches:
            for lo, hi in chunks(b.column("text"), 2000, 1 << 23):
                ids, texts = b.column("doc_id")[lo:hi].to_pylist(), b.column("text")[lo:hi].to_pylist()
                out = [[] for _ in range(6)]
                for doc_id, raw in zip(ids, encode([t or "" for t in texts]), strict=True):
                    raw += end
                    total = len(raw) // 4
                    for start in range(0, total, window):
                        n = min(window, total - start)
                        for column, value in zip(out, (doc_id, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), total, int(seen[n])), strict=True):
                            column.append(value)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(np.full(len(out[0]), task, np.int32)), pa.array(out[5], pa.int64())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = written(rows.mapInArrow(tokenise, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, place long"), "pieces")
    held = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = np.zeros(window + 1, np.int64)
    for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length at most
        counts[r["length"]] = r["n"]
    plan = spark.createDataFrame(best_fit_decreasing(counts, window), "length long, rank_from long, rank_to long, first long, offset long")
    ranges = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank_from", "rank_to", "first", "offset"))).alias("ranges"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the ranges that a task's pieces of one length fall into
    seats = (
        held.withColumn("before", before)
        .join(ranges, "length")
        .select("length", "task", "before", F.filter("ranges", lambda r: (r["rank_from"] < F.col("before") + F.col("n")) & (r["rank_to"] > F.col("before"))).alias("ranges"))
    )
    return (
        pieces.join(seats, ["length", "task"])
        .withColumn("rank", F.col("before") + F.col("place"))
        .withColumn("range", F.filter("ranges", lambda r: (r["rank_from"] <= F.col("rank")) & (F.col("rank") < r["rank_to"]))[0])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("range.first") + F.col("rank") - F.col("range.rank_from")).alias("sequence_id"), F.col("range.offset").alias("offset"))
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
