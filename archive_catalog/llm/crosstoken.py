"""Alignment of two tokenizers' ids by whitespace-token anchors.

Both tokenizers encode each text whole. Where both have a token that ends at the same byte and the next tokens of both begin with a space
mark, an anchor splits the document into windows: a tuple of ids of the one, a tuple of ids of the other, over the same bytes. Windows recur, as words do, so the
alignment of a window (its groups between shared ends, its links between overlapping tokens) is made once and kept by its id tuples
in a memo of bounded size. Neither vocabulary has a token with a space after another character, so what stands between single spaces is encoded on its own, and recent encodings are kept as well. Before any of that the joined bytes of either side are compared with the text.

How often a pair of ids is linked in the whole corpus is summed from each task's counts of windows. Of these sums the most frequent pairs (``HEAD`` at most) travel to
the tasks that look them up; links with rarer pairs are joined with the table of sums, so every link gets its exact count and no key of that join is hot.
Ids are kept between the two passes, so that texts are encoded once.

Defined results: texts that are null or empty, or whose bytes on one side differ from a space and the text, have no tokens; null ids
stay null, repeated rows are each aligned and counted; an empty table gives no rows; other columns are ignored. Strings of special tokens are plain text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, chunks, heaviest

#: Pairs of ids that travel to the tasks: 17 bytes each.
HEAD = 1 << 18
#: Windows, and bytes of their ids, that a memo holds at most; likewise pieces of text whose ids are kept.
MEMO, MEMO_BYTES = 1 << 18, 1 << 24
PIECES, PIECES_BYTES = 1 << 18, 1 << 23
#: Characters that both encoders of the first vocabulary class alike, as tests confirm.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ–-…]*")
_LONG = 400
#: Single spaces, at which no token of either side goes on.
_GAP = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile(r"\s\s")


def pieces_of(text: str) -> list[str]:
    """``text`` without the single spaces between other characters, in pieces."""
    if not text or text[0].isspace() or text[-1].isspace() or _WIDE.search(text):
        return _GAP.split(text) if text else []
    return text.split(" ")
#: How the byte-level vocabulary splits texts (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, others for the next free code from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Bytes of each id, laid end to end, and whether they begin with a space mark."""

    pool: np.ndarray
    start: np.ndarray
    size: np.ndarray
    marked: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        size = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size, np.array([t[:1] == b" " for t in tokens]))

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.pool[np.arange(size.sum()) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)]


class Encoders:
    """The two tokenizers: ``first`` a byte-level vocabulary (space and text), ``second`` a sentence-piece model that adds the space itself."""

    def __init__(self, byte_level_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(byte_level_path)
        self.tokenizer.encode_special_tokens = True
        with open(byte_level_path, encoding="utf-8") as f:
            content = json.load(f)
        letters, special = byte_letters(), {t["id"] for t in content["added_tokens"]}
        names = sorted(content["model"]["vocab"].items(), key=lambda x: x[1])
        tokens = [b""] * (1 + max([names[-1][1], *special]))
        for name, number in names:
            tokens[number] = bytes(letters[c] for c in name) if number not in special else name.encode()
        self.first = Vocabulary.of(tokens)
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t and i not in special}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        written = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        self.second = Vocabulary.of([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(written)])

        self.newer, self.older = Store(), Store()
        self.aligner = Aligner(self.first, self.second)
        self.small = max(len(self.first.size), len(self.second.size)) <= 1 << 16

    def packed(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Ids of texts as a binary column."""
        at = (2 if self.small else 4) * np.concatenate(([0], np.cumsum(counts)))
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids.astype("<u2" if self.small else "<u4"))])

    def unpacked(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = column.to_pylist()
        ids = np.frombuffer(b"".join(raw), "<u2" if self.small else "<u4")
        return ids.astype(np.uint32), np.array([len(x) for x in raw], np.int64) // (2 if self.small else 4)

    def encode_first(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, each as if a space stood before it, end to end, and how many of each: plain ones are encoded as one text and cut where their bytes end."""
        plain = np.array([len(p) < _LONG and not (p[0].isspace() or p[-1].isspace()) and _PLAIN.fullmatch(p) is not None for p in pieces], bool)
        if plain.all() and pieces:
            ids = self.fast.encode_to_numpy(" " + " ".join(pieces), disallowed_special=())
            ends = np.cumsum([1 + len(p.encode()) for p in pieces])
            return ids, np.diff(np.searchsorted(np.cumsum(self.first.size[ids]), ends, "left") + 1, prepend=0)
        if not plain.any():
            each = [np.asarray(self.tokenizer.encode(" " + p, add_special_tokens=False).ids, np.uint32) for p in pieces]
            return np.concatenate([np.empty(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)
        parts = [self.encode_first([p for p, yes in zip(pieces, plain, strict=True) if yes == kind]) for kind in (True, False)]
        order = np.argsort(np.argsort(~plain, kind="stable"))
        return _gathered(*(np.concatenate([x[i] for x in parts]) for i in (0, 1)), order)

    def encode_second(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.pieces.encode(pieces, num_threads=1)
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids by either of all texts, end to end, and how many each text has; texts whose bytes the two don't both give back have none."""
        cut = [pieces_of(t or "") for t in texts]
        if self.newer.full():
            self.newer, self.older = Store(), self.newer
        missing = set(chain.from_iterable(cut)).difference(self.newer.numbers)
        known = [p for p in missing if p in self.older.numbers]
        self.newer.add(known, *self.older.ids(known))
        new = list(missing.difference(known))
        self.newer.add(new, self.encode_first(new), self.encode_second(new))
        (one, n_one), (two, n_two) = self.newer.ids(list(chain.from_iterable(cut)))
        upto = np.cumsum([len(c) for c in cut])
        bounds = [np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], upto))].astype(np.int64) for n in (n_one, n_two)]
        raw = np.frombuffer("".join([f" {t}" for t in texts if t]).encode("utf-8", "surrogatepass"), np.uint8)
        if not (np.array_equal(self.first.spelled(one), raw) and np.array_equal(self.second.spelled(two), raw)):
            keep = []
            for i, text in enumerate(texts):
                own = np.frombuffer(f" {text}".encode("utf-8", "surrogatepass"), np.uint8)
                same = [np.array_equal(v.spelled(x[at[i] : at[i + 1]]), own) for v, x, at in ((self.first, one, bounds[0]), (self.second, two, bounds[1]))]
                keep.append(not text or all(same))
            counts = [np.diff(at) for at in bounds]
            one, two = (x[np.repeat(keep, n)] for x, n in zip((one, two), counts, strict=True))
            return one, two, np.stack([n * np.array(keep) for n in counts], axis=1)
        return one, two, np.stack([np.diff(at) for at in bounds], axis=1)


def _gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches laid end to end those chosen, in that order, and their sizes."""
    n = sizes[which]
    return flat[np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes)[which] - (np.cumsum(n) - n), n)], n


class Store:
    """Pieces of text and their ids by both tokenizers."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.held = 0
        self.sides = [(np.empty(0, np.uint32), np.empty(0, np.int64)) for _ in range(2)]

    def full(self) -> bool:
        return len(self.numbers) > PIECES // 2 or self.held > PIECES_BYTES // 2

    def add(self, pieces: list[str], *sides: tuple[np.ndarray, np.ndarray]) -> None:
        self.numbers.update(zip(pieces, range(len(self.numbers), len(self.numbers) + len(pieces)), strict=True))
        self.held += sum(map(len, pieces))
        self.sides = [(np.append(a, x), np.append(b, y)) for (a, b), (x, y) in zip(self.sides, sides, strict=True)]

    def ids(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        which = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        return [_gathered(*side, which) for side in self.sides]


@lru_cache(1)
def encoders(byte_level_path: str, piece_path: str) -> Encoders:
    """One for all tasks of a Python worker."""
    return Encoders(byte_level_path, piece_path)


@dataclass
class Windows:
    """Windows of documents laid end to end: ids of both sides and the bounds of windows in them; ``per_doc`` counts them."""

    one: np.ndarray
    two: np.ndarray
    one_at: np.ndarray
    two_at: np.ndarray
    per_doc: np.ndarray

    def keys(self) -> list[bytes]:
        """The id tuples of all windows, as bytes: those of the one side, a mark, those of the other."""
        n_one, n_two, n = np.diff(self.one_at), np.diff(self.two_at), np.arange(len(self.one_at) - 1)
        at = 4 * (self.one_at + self.two_at + np.arange(len(self.one_at)))
        flat = np.full(len(self.one) + len(self.two) + len(n), 0xFFFFFFFF, np.uint32)
        flat[np.arange(len(self.one)) + np.repeat(self.two_at[:-1] + n, n_one)] = self.one
        flat[np.arange(len(self.two)) + np.repeat(self.one_at[1:] + n + 1, n_two)] = self.two
        raw, at = flat.tobytes(), at.tolist()
        return [raw[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]

    def chosen(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some windows laid end to end, by the one side and the other, and how many of each."""
        (one, n_one), (two, n_two) = (_gathered(ids, np.diff(at), which) for ids, at in ((self.one, self.one_at), (self.two, self.two_at)))
        return one, two, n_one, n_two


def windows(first: Vocabulary, second: Vocabulary, one: np.ndarray, two: np.ndarray, counts: np.ndarray) -> Windows:
    """Cuts documents, laid end to end, at the shared ends before space-marked tokens, and between documents. ``counts``: ids of each, by either side."""
    zero = np.zeros(1, np.int64)
    if not len(one):
        return Windows(one, two, zero, zero, np.zeros(len(counts), np.int64))
    ends_one, ends_two = np.cumsum(first.size[one]), np.cumsum(second.size[two])
    before_one, before_two = np.append(first.marked[one[1:]], True), np.append(second.marked[two[1:]], True)
    last = np.unique(np.cumsum(counts[:, 0])[counts[:, 0] > 0]) - 1  # each document's last token
    before_one[last] = True
    before_two[np.unique(np.cumsum(counts[:, 1])[counts[:, 1] > 0]) - 1] = True
    here = np.zeros(ends_one[-1] + 1, np.uint8)
    here[ends_one[before_one]] = 1
    here[ends_two[before_two]] += 2
    cut_one, cut_two = np.flatnonzero(here[ends_one] == 3), np.flatnonzero(here[ends_two] == 3)
    done = np.searchsorted(cut_one, np.cumsum(counts[:, 0]))  # windows that end within the documents so far
    return Windows(one, two, np.concatenate((zero, cut_one + 1)), np.concatenate((zero, cut_two + 1)), np.diff(done, prepend=0))


@dataclass
class Aligned:
    """Links of windows as pairs of ids, with the bounds of each window's links, and the groups of each."""

    pairs: np.ndarray
    links_at: np.ndarray
    n_groups: np.ndarray
    groups: list[str] | None


class Aligner:
    def __init__(self, first: Vocabulary, second: Vocabulary):
        self.first, self.second = first, second
        names = lambda v, end: np.array([f"{i}{end}" for i in range(len(v.size))], object)
        self.names = [names(first, ","), names(first, "|"), names(second, ","), names(second, ";")]

    def __call__(self, one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray, spelled: bool = True) -> Aligned:
        """Aligns windows, all in one go: their bytes are laid end to end."""
        size_one, size_two = self.first.size[one], self.second.size[two]
        ends_one, ends_two = np.cumsum(size_one), np.cumsum(size_two)
        lo, hi = np.searchsorted(ends_two, ends_one - size_one, "right"), np.searchsorted(ends_two - size_two, ends_one, "left")
        n = hi - lo
        which = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        pairs = np.repeat(one.astype(np.int64), n) << 32 | two[which].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(n_one)))
        links_at = np.concatenate(([0], np.cumsum(n)))[upto]
        at_end = np.zeros(int(size_one.sum()) + 1, bool)
        at_end[ends_two] = True
        closes_one = at_end[ends_one]
        n_groups = np.diff(np.concatenate(([0], np.cumsum(closes_one)))[upto])
        if not spelled:
            return Aligned(pairs, links_at, n_groups, None)
        at_end[:] = False
        at_end[ends_one] = True
        closes_two = at_end[ends_two]
        # a group is spelled as its tokens of the one side, then of the other
        group_one, group_two = np.cumsum(closes_one) - closes_one, np.cumsum(closes_two) - closes_two
        before_two, upto_one = np.concatenate(([0], np.flatnonzero(closes_two) + 1)), np.concatenate(([0], np.flatnonzero(closes_one) + 1))
        flat = np.empty(len(one) + len(two), object)
        comma, bar, comma_two, semicolon = self.names
        flat[np.arange(len(one)) + before_two[group_one]] = np.where(closes_one, bar[one], comma[one])
        flat[np.arange(len(two)) + upto_one[group_two + 1]] = np.where(closes_two, semicolon[two], comma_two[two])
        cut, flat = [0, *np.cumsum(n_one + n_two).tolist()], flat.tolist()
        return Aligned(pairs, links_at, n_groups, ["".join(flat[s:e])[:-1] for s, e in zip(cut[:-1], cut[1:], strict=True)])


class Memo:
    """Numbers of windows by their ids, and how often each came; ``learn`` is called with the ids of new windows."""

    def __init__(self, learn):
        self.learn, self.numbers, self.held, self.times = learn, {}, 0, np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.numbers) >= MEMO or self.held >= MEMO_BYTES

    def forget(self) -> np.ndarray:
        """Forgets all windows but the quarter that came most often, if more than once; which those were, for their numbers begin anew."""
        most = max(2, int(np.sort(self.times)[-(len(self.times) // 4 + 1)])) if len(self.times) else 0
        stay, keys = np.flatnonzero(self.times > most), list(self.numbers)
        keys = [keys[i] for i in stay.tolist()]
        self.numbers, self.held, self.times = dict(zip(keys, range(len(keys)), strict=True)), sum(map(len, keys)), np.zeros(len(keys), np.int64)
        if self.full():  # by very long windows
            self.numbers, self.held, self.times, stay = {}, 0, self.times[:0], stay[:0]
        return stay

    def __call__(self, cut: Windows) -> np.ndarray:
        keys = cut.keys()
        got = list(map(self.numbers.get, keys))
        if None in got:
            new = {k: i for i, (k, g) in enumerate(zip(keys, got, strict=True)) if g is None}
            self.learn(*cut.chosen(np.fromiter(new.values(), np.int64, len(new))))
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
            self.held += sum(map(len, new))
            got = [self.numbers[k] if g is None else g for k, g in zip(keys, got, strict=True)]
        out = np.array(got, np.int64)
        self.times = np.bincount(out, minlength=len(self.numbers)) + np.append(self.times, np.zeros(len(self.numbers) - len(self.times), np.int64))
        return out


@dataclass
class Kept:
    """What is known of the windows in a memo, by their numbers: spelled groups, counts, links."""

    spelled: list[str]
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray

    @classmethod
    def none(cls) -> Kept:
        zero = np.zeros(0, np.int64)
        return cls([], zero, zero, zero)

    def add(self, got: Aligned) -> None:
        self.spelled += got.groups
        self.n_groups, self.n_links = np.append(self.n_groups, got.n_groups), np.append(self.n_links, np.diff(got.links_at))
        self.pairs = np.append(self.pairs, got.pairs)

    def only(self, stay: np.ndarray) -> Kept:
        n = self.n_links[stay]
        at = (np.cumsum(self.n_links) - self.n_links)[stay]
        return Kept([self.spelled[i] for i in stay.tolist()], self.n_groups[stay], n, self.pairs[np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)])


def _sums(values: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    upto = np.cumsum(per_doc)
    return total[upto] - total[upto - per_doc]


_DOC = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long"


def tokenised(docs: DataFrame, byte_level_path: str, piece_path: str, digest: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents (with a row number, ids of both sides and ``groups`` or its digest), and, where ``pair`` isn't null, of pairs of ids with a count of links ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, row = encoders(byte_level_path, piece_path), TaskContext.get().partitionId() << 36
        aligner, kept = both.aligner, Kept.none()
        memo = Memo(lambda *ids: kept.add(aligner(*ids)))

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal kept
            if memo.times.any():
                pairs, which = np.unique(kept.pairs, return_inverse=True)
                n = np.bincount(which, weights=np.repeat(memo.times, kept.n_links), minlength=len(pairs)).astype(np.int64)
                pairs, n = pairs[n > 0], n[n > 0]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(pairs), t) for t in [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]), pa.array(pairs), pa.array(n)], names=names)
            kept = kept.only(memo.forget())

        names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "pair", "n"]
        for batch in batches:
            for lo, hi in chunks(batch.column("text"), 500, 1 << 21):
                texts = batch.column("text")[lo:hi].to_pylist()
                one, two, per = both.encode(texts)
                cut = windows(both.first, both.second, one, two, per)
                got = memo(cut)
                words, bounds = list(map(kept.spelled.__getitem__, got.tolist())), np.concatenate(([0], np.cumsum(cut.per_doc))).tolist()
                groups = (";".join(words[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True))
                groups = [g and (hashlib.sha256(g.encode()).hexdigest() if digest else g) for g in groups]
                each = [np.ascontiguousarray(per[:, i], np.int64) for i in (0, 1)]
                sums = [_sums(x[got], cut.per_doc) for x in (kept.n_groups, kept.n_links)]
                raw = [both.packed(x, n) for x, n in zip((one, two), each, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(texts))), batch.column("doc_id")[lo:hi], *map(pa.array, each + sums), pa.array(groups, pa.string()), *raw, pa.nulls(len(texts), pa.int64()), pa.nulls(len(texts), pa.int64())],
                    names=names,
                )
                row += len(texts)
                if memo.full():
                    yield from counted()
        yield from counted()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{_DOC}, groups string, a binary, b binary, pair long, n long")


def looked_up(found: DataFrame, head, byte_level_path: str, piece_path: str) -> DataFrame:
    """Rows of documents with ``n_best`` and ``count_sum`` over links with pairs of the head (sorted pairs, counts, whether best), and ``rest``, the other links' pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoders(byte_level_path, piece_path)
        aligner, (pairs, counts, best) = both.aligner, head.value
        for batch in batches:
            for lo, hi in chunks(batch.column("a"), 500, 1 << 19):
                part = batch.slice(lo, hi - lo)
                (one, n_one), (two, n_two) = (both.unpacked(part.column(c)) for c in ("a", "b"))
                got = aligner(one, two, n_one, n_two, spelled=False)
                kinds, which = np.unique(got.pairs, return_inverse=True)
                value, is_best, hit = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64), np.zeros(len(kinds), bool)
                if len(pairs):
                    at = np.minimum(np.searchsorted(pairs, kinds), len(pairs) - 1)
                    hit = pairs[at] == kinds
                    value[hit], is_best[hit] = counts[at[hit]], best[at[hit]]
                per = np.diff(got.links_at)
                lost = ~hit[which]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lost)))[got.links_at].astype(np.int32)), pa.array(got.pairs[lost]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(_sums(is_best[which], per)), pa.array(_sums(value[which], per)), lists], names=[*keep, "n_best", "count_sum", "rest"])

    keep = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    return found.select(*keep, "a", "b").mapInArrow(run, f"{_DOC}, groups string, n_best long, count_sum long, rest array<long>")


def align(docs: DataFrame, byte_level_path: str, piece_path: str, digest: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, ``groups`` (as ``a1,a2|b1;a3|b2,b3``, or its SHA-256), n_best, count_sum."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "crosstoken")
    both = scratch.written(tokenised(docs, byte_level_path, piece_path, digest, key, text), "ids")
    sums = scratch.written(both.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")), "sums")
    side = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = sums.groupBy(side.alias("two")).agg(F.max("n").alias("most"))  # one row for each id of the second vocabulary at most
    pairs = scratch.written(sums.withColumn("two", side).join(F.broadcast(most), "two").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    got = heaviest(pairs, "n", HEAD).toArrow().sort_by("pair")  # HEAD rows of 17 bytes at most
    head = spark.sparkContext.broadcast(tuple(got.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))
    found = scratch.written(looked_up(both.where("pair IS NULL"), head, byte_level_path, piece_path), "found")
    tail = found.where("size(rest) > 0").select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times")).join(pairs, "pair")
    more = tail.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("sum_more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_more"))
    plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return found.drop("rest").join(more, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", plus("n_best", "best_more"), plus("count_sum", "sum_more"))


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return align(table(spark, sf_dir, "documents"), *default_tokenizers(), digest=True).withColumnRenamed("groups", "groups_sha256")
