"""Language-model scores of whole texts: word counts with add-one smoothing, and a causal self-attention model on subword ids.

*Counts.* Every task counts the words of its rows; the sums over all documents are a table. A text's words among the ``HEAD`` most frequent ones (whether counted
in training rows or not) are looked up in the tasks; the others are joined with the table, in which no word is frequent enough to be a hot key.

*Model.* Ids are those of a public subword vocabulary, a start id before each text and its end id after it. The chance of the next id is that of its class
given what stands before, times that of the id within its class. Within a class ids follow their counts in all training rows (plus one): the counts of words, spelled in ids. The most
frequent ids are classes of their own, the others are dealt, by whether they end a word, into classes of equal weight. The class follows from one layer of causal self-attention
and a bias for each distance, then a hidden layer. It is trained in numpy by Adam on every position of every training row: rows go, in the order of a hash, into stretches of about
``WINDOWS`` windows. One stretch is learnt first; the others each go on from its weights, in the tasks that hold them, and the weights that they reach are averaged by their windows.

*Windows.* A text's positions are scored in stretches of ``STRIDE``; each stretch attends to itself, causally, and to the ``CONTEXT`` positions before it, so windows overlap, and each id is
scored once, with ``CONTEXT`` ids before it at least (or all there are). Windows of many texts are scored together.

Defined results: a null text is an empty one and consists of its end alone; null ids stay null, are not held out and not learned from; repeated rows are counted and scored each; without
training rows all counts are 0 and the model is uniform over classes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import WordTokens
from .shared import Scratch, chunks, heaviest, written

#: Words that travel to the tasks at most; of each the bytes and a count.
HEAD = 1 << 18
#: Windows that are learnt in a row: what a task holds of them at once.
WINDOWS = 1 << 15
CONTEXT, STRIDE = 16, 32
WIDTH, HEADS, HIDDEN = 16, 1, 24
#: Ids with an embedding of their own; the others share SHARED more by their rank.
OWN, SHARED = 1024, 256
ALONE, DEALT = 16, 16
#: Products of queries and keys, and what classes score, are held within this bound, so that their exponentials can't overflow.
SCORE_BOUND = 60
START, END, IDS = 49406, 49407, 49408
#: A task's counts are sent on at so many words, or bytes of text.
FLUSH_WORDS, FLUSH_BYTES = 300_000, 1 << 25
CACHE_WORDS, CACHE_BYTES = 200_000, 1 << 23
#: Characters of texts that are split into words at once, but for longer texts.
PART_BYTES = 1 << 21
NAMES = ["word", "seen", "learnt"]
BATCH = 48


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordIds:
    """Ids of words, as little-endian 32-bit bytes. The cache is bounded in words and bytes; its older half goes once the newer one is full, but for words that came again."""

    def __init__(self, path: str):
        self.tokens, self.cache, self.older, self.held = WordTokens(path), {}, {}, 0

    def __call__(self, words: list[bytes]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS // 2 or self.held > CACHE_BYTES // 2:
            self.older, self.cache, self.held = self.cache, {}, 0
        missing = set(words).difference(self.cache)
        if missing:
            known = [w for w in missing if w in self.older]
            self.cache.update((w, self.older[w]) for w in known)
            new = list(missing.difference(known))
            texts = [w.decode("utf-8", "surrogatepass") for w in new]
            self.tokens.cache.clear()
            self.tokens._learn(set(texts))
            self.cache.update(zip(new, map(self.tokens.cache.__getitem__, texts), strict=True))
            self.tokens.cache.clear()
            self.held += sum(map(len, missing))
        return list(map(self.cache.__getitem__, words))


# --- the model -------------------------------------------------------------------------------------------------------
@dataclass
class Classes:
    """Class and embedding row of each id, and the logarithm (base 10) of its chance within its class."""

    of: np.ndarray
    within: np.ndarray
    row: np.ndarray

    @classmethod
    def of_counts(cls, counts: np.ndarray, ends_word: np.ndarray) -> Classes:
        """From how often each id occurs in training rows; the start id is never predicted."""
        weight = counts + 1.0
        weight[START] = 0
        order = np.lexsort((np.arange(IDS), -weight))
        rank = np.empty(IDS, np.int64)
        rank[order] = np.arange(IDS)
        of = np.zeros(IDS, np.int64)
        of[order[:ALONE]] = np.arange(ALONE)
        for k, kind in enumerate((False, True)):
            rest = order[ALONE:][ends_word[order[ALONE:]] == kind]
            share = np.cumsum(weight[rest])
            of[rest] = ALONE + k * DEALT + np.minimum((share - weight[rest]) / max(share[-1], 1) * DEALT, DEALT - 1).astype(np.int64)
        total = np.bincount(of, weights=weight, minlength=ALONE + 2 * DEALT)
        with np.errstate(divide="ignore"):
            within = np.log10(weight / total[of])
        row = np.where(rank < OWN, rank, OWN + rank % SHARED)
        row[START], row[END] = OWN + SHARED, OWN + SHARED + 1
        return cls(of, within, row)


ROWS = OWN + SHARED + 2


def distances(keys: int) -> np.ndarray:
    """How far before the query each key stands (negative: after it); the queries are the last STRIDE of the keys."""
    return np.arange(keys - STRIDE, keys)[:, None] - np.arange(keys)[None, :]


def fresh(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "embed": normal(ROWS, WIDTH, scale=0.3), "query": normal(WIDTH, WIDTH, scale=WIDTH**-0.5), "key": normal(WIDTH, WIDTH, scale=WIDTH**-0.5), "value": normal(WIDTH, WIDTH, scale=WIDTH**-0.5),
        "near": np.zeros((HEADS, CONTEXT + STRIDE), np.float32), "hidden": normal(2 * WIDTH, HIDDEN, scale=(2 * WIDTH) ** -0.5), "lift": np.zeros(HIDDEN, np.float32),
        "out": np.zeros((HIDDEN, ALONE + 2 * DEALT), np.float32), "bias": np.zeros(ALONE + 2 * DEALT, np.float32),
    }


def _split(x: np.ndarray) -> np.ndarray:
    return x.reshape(*x.shape[:2], HEADS, -1).transpose(0, 2, 1, 3)


def _joined(x: np.ndarray) -> np.ndarray:
    return x.transpose(0, 2, 1, 3).reshape(x.shape[0], x.shape[2], -1)


def _longest(x: np.ndarray) -> float:
    """The greatest length of a head's part of a row."""
    return float(np.sqrt((x.reshape(len(x), HEADS, -1) ** 2).sum(axis=-1).max()))


@cache
def _reach(keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the keys that each query sees (0 for others), and which these are."""
    dist = distances(keys)
    return np.maximum(dist, 0), dist >= 0


#: Where each number of each embedding row stands, with a further row for keys that do not exist.
_PLACES = np.arange((ROWS + 1) * WIDTH).reshape(-1, WIDTH)


def gradients(p: dict[str, np.ndarray], rows: np.ndarray, there: np.ndarray, classes: np.ndarray, counted: np.ndarray, measured: bool = True) -> tuple[float | None, dict[str, np.ndarray]]:
    """Mean loss over ``counted`` targets (if ``measured``) and its gradients. ``rows``: keys of each window, ``there`` which of them exist; ``classes``: targets of the last STRIDE."""
    n, keys = rows.shape
    own, kind, half = rows[:, -STRIDE:], p["embed"].dtype, WIDTH // HEADS
    dist, seen = _reach(keys)
    flat = lambda y: y.reshape(-1, y.shape[-1])
    sums = lambda y: np.ones(len(y), kind) @ y
    scale = np.float32(half**-0.5)
    # queries, keys and values of each embedding row are tables, as the rows are fewer than the places. A further column of ones adds up the weights;
    # keys that do not exist take the last row, which is zero in all columns, so that they count for nothing
    queries, known = p["embed"] @ (p["query"] * scale), np.zeros((ROWS + 1, WIDTH), kind)
    np.matmul(p["embed"], p["key"], out=known[:-1])
    valued = np.zeros((ROWS + 1, HEADS, half + 1), kind)
    valued[:-1, :, :-1] = (p["embed"] @ p["value"]).reshape(ROWS, HEADS, half)
    valued[:-1, :, -1] = 1
    place = np.where(there, rows, ROWS)
    q, k, v = _split(queries.take(own, axis=0)), _split(known.take(place, axis=0)), _split(valued.reshape(ROWS + 1, -1).take(place, axis=0))
    w = q @ k.transpose(0, 1, 3, 2)
    if not (w.max() <= SCORE_BOUND and w.min() >= -SCORE_BOUND):
        np.clip(w, -SCORE_BOUND, SCORE_BOUND, out=w)
    np.exp(w, out=w)
    w *= np.exp(p["near"]).take(dist, axis=1) * seen
    o = w @ v
    total = o[..., -1:].copy()
    total[total == 0] = 1  # padding that sees nothing
    x = np.concatenate([p["embed"], np.zeros((1, WIDTH), kind)]).take(place, axis=0)
    z = np.empty((n, STRIDE, 2 * WIDTH), kind)
    z[..., :WIDTH] = x[:, -STRIDE:]
    o = np.divide(o[..., :-1], total, out=z[..., WIDTH:].reshape(n, STRIDE, HEADS, half).transpose(0, 2, 1, 3))
    z = flat(z)
    h = z @ p["hidden"]
    h += p["lift"]
    np.maximum(h, 0, out=h)
    d = h @ p["out"]
    d += p["bias"]
    if not (d.max() <= SCORE_BOUND and d.min() >= -SCORE_BOUND):
        np.clip(d, -SCORE_BOUND, SCORE_BOUND, out=d)
    np.exp(d, out=d)
    every = d @ np.ones(d.shape[1], kind)
    aims, use = np.arange(len(d)) * d.shape[1] + classes.ravel(), counted.ravel()
    share = 1 / max(1, int(use.sum()))
    loss = -float(np.log(np.maximum((d.take(aims) / every)[use], 1e-30)).sum()) * share if measured else None

    part = use * kind.type(share)
    d *= (part / every)[:, None]
    d.ravel()[aims] -= part
    g = {"out": h.T @ d, "bias": sums(d)}
    dh = d @ p["out"].T
    dh *= h > 0
    back = np.empty((n, HEADS, STRIDE, half + 1), kind)
    do = np.divide(_split((dh @ p["hidden"][WIDTH:].T).reshape(n, STRIDE, WIDTH)), total, out=back[..., :-1])
    np.negative(np.einsum("nhsi,nhsi->nhs", do, o), out=back[..., -1])
    da = back @ v.transpose(0, 1, 3, 2)
    da *= w
    near = np.zeros_like(p["near"])
    for i, side in enumerate(sums(da.reshape(n, -1)).reshape(HEADS, STRIDE, keys)):
        near[i] += np.bincount(dist.ravel(), weights=side.ravel(), minlength=near.shape[1]).astype(near.dtype)  # what is not seen adds 0
    dq = flat(_joined(da @ k))
    g |= {"near": near, "hidden": z.T @ dh, "lift": sums(dh), "query": z[:, :WIDTH].T @ dq * scale}
    both = np.empty((n, keys, 2 * WIDTH), kind)
    np.matmul(da.transpose(0, 1, 3, 2), q, out=_split(both[..., :WIDTH]))
    np.matmul(w.transpose(0, 1, 3, 2), do, out=_split(both[..., WIDTH:]))
    both = flat(both)
    sides = flat(x).T @ both
    g |= {"key": sides[:, :WIDTH], "value": sides[:, WIDTH:]}
    dx = (both @ np.concatenate([p["key"].T, p["value"].T])).reshape(x.shape)
    dx[:, -STRIDE:] += (dh @ p["hidden"][:WIDTH].T + dq @ (p["query"].T * scale)).reshape(n, STRIDE, WIDTH)
    embed = np.zeros((ROWS + 1) * WIDTH, kind)
    np.add.at(embed, _PLACES.take(place.ravel(), axis=0).ravel(), dx.ravel())
    g["embed"] = embed[:-WIDTH].reshape(ROWS, WIDTH)
    return loss, g


def laid_out(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Streams end to end, each filled up to a multiple of STRIDE: (where in the input each place comes from or -1, first place and number of windows of each)."""
    sizes = np.array([len(s) for s in streams], np.int64)
    n = -(-sizes // STRIDE)
    first = np.cumsum(n * STRIDE) - n * STRIDE
    place = np.full(int((n * STRIDE).sum()), -1, np.int64)
    total = int(sizes.sum())
    place[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)] = np.arange(total)
    return place, first, n


#: Steps at most in several passes, and passes over the pieces at most: fewer pieces are learnt by heart otherwise. One pass is always whole.
STEPS, PASSES, STEP_WINDOWS = 500, 12, 64
RATE, LATER_RATE = 0.01, 0.003


def train(pieces: list[np.ndarray], classes: Classes, steps: int | None = None, rate: float = RATE, seed: int = 1, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """``pieces``: ids with the start and end ids where they belong. Adam with a rate that falls to nothing; every window has its turn before any comes again. ``start``: weights to go on from."""
    p = {k: v.copy() for k, v in start.items()} if start else fresh(seed)
    pieces = [x for x in pieces if len(x) > 1]
    if not pieces:
        return p
    place, first, n = laid_out([x[:-1] for x in pieces])
    ids, after = np.concatenate([x[:-1] for x in pieces]), np.concatenate([x[1:] for x in pieces])
    counted = place >= 0
    rows, targets = np.where(counted, classes.row[ids[place]], ROWS - 1), np.where(counted, classes.of[after[place]], 0)
    if not start:
        share = np.bincount(targets[counted], minlength=ALONE + 2 * DEALT) + 1.0
        p["bias"] = np.log(share / share.sum()).astype(np.float32)
    starts = np.arange(len(place) // STRIDE) * STRIDE
    origin = np.repeat(first, n)
    once = -(-len(starts) // STEP_WINDOWS)
    steps = steps or max(once, min(STEPS, -(-PASSES * len(starts) // STEP_WINDOWS)))
    rng = np.random.default_rng(seed)
    names, shapes = list(p), [v.shape for v in p.values()]
    ends = np.cumsum([v.size for v in p.values()])
    weights = np.concatenate([v.ravel() for v in p.values()])
    p = {k: w.reshape(s) for k, w, s in zip(names, np.split(weights, ends[:-1]), shapes, strict=True)}  # views
    mean, spread, step = np.zeros_like(weights), np.zeros_like(weights), np.empty_like(weights)
    for t in range(1, steps + 1):
        if (t - 1) % once == 0:
            turns = rng.permutation(len(starts))
        who = turns[(t - 1) % once * STEP_WINDOWS :][:STEP_WINDOWS]
        keys = starts[who][:, None] + np.arange(-CONTEXT, STRIDE)
        there = keys >= origin[who][:, None]
        keys = np.where(there, keys, 0)
        use = counted.take(keys)
        _, g = gradients(p, rows.take(keys), there & use, targets.take(keys[:, CONTEXT:]), use[:, CONTEXT:], measured=False)
        now = rate * (1 - (t - 1) / steps)
        g = np.concatenate([g[k].ravel() for k in names])
        np.subtract(g, mean, out=step)
        step *= np.float32(0.1)
        mean += step
        g *= g
        g -= spread
        g *= np.float32(0.01)
        spread += g
        np.multiply(spread, np.float32(1 / (1 - 0.99**t)), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-8)
        np.multiply(mean, np.float32(now / (1 - 0.9**t)), out=step)
        step /= g
        weights -= step
    return {k: v.copy() for k, v in p.items()}


@dataclass
class Model:
    """Scores id streams: queries, keys, values and the hidden layer's share of each embedding row are tables."""

    classes: Classes
    weights: dict[str, np.ndarray]

    def __post_init__(self):
        p = self.weights
        self.query = p["embed"] @ p["query"] * np.float32((WIDTH // HEADS) ** -0.5)
        self.key, self.value = p["embed"] @ p["key"], np.ones((len(p["embed"]), HEADS, WIDTH // HEADS + 1), p["embed"].dtype)
        self.value[..., :-1] = (p["embed"] @ p["value"]).reshape(len(self.value), HEADS, -1)
        self.value = self.value.reshape(len(self.value), -1)
        self.plain = p["embed"] @ p["hidden"][:WIDTH] + p["lift"]
        self.mixed, self.out, self.bias = p["hidden"][WIDTH:], p["out"], p["bias"]
        self.masks = {}
        for keys in (STRIDE, STRIDE + CONTEXT):
            d = distances(keys)
            near = np.where(d >= 0, p["near"][:, np.maximum(d, 0)], np.float32(-np.inf)).astype(np.float32)
            self.masks[keys] = np.exp(near)
        #: no score can pass the bound, so none needs to be held back
        self.tame = _longest(self.query) * _longest(self.key) < SCORE_BOUND

    def _windows(self, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 chance of each target class; ``rows``: keys of each window, the last STRIDE of which are queries."""
        own = rows[:, -STRIDE:]
        q, k, v = _split(self.query.take(own, axis=0)), _split(self.key.take(rows, axis=0)), _split(self.value.take(rows, axis=0))
        a = q @ k.transpose(0, 1, 3, 2)
        if not self.tame:
            np.clip(a, -SCORE_BOUND, SCORE_BOUND, out=a)
        np.exp(a, out=a)
        a *= self.masks[rows.shape[1]]
        o = a @ v
        h = _joined(o[..., :-1] / o[..., -1:]) @ self.mixed
        h += self.plain.take(own, axis=0)
        np.maximum(h, 0, out=h)
        logits = h.reshape(-1, HIDDEN) @ self.out
        logits += self.bias
        if not logits.max(initial=0) <= SCORE_BOUND:
            np.minimum(logits, SCORE_BOUND, out=logits)
        at = logits[np.arange(len(logits)), classes.ravel()]
        np.exp(logits, out=logits)
        return ((at - np.log(logits @ np.ones(logits.shape[1], logits.dtype))) * np.float32(1 / np.log(10))).reshape(own.shape)

    def scores(self, streams: list[np.ndarray]) -> np.ndarray:
        """log10 chance of each stream of ids, after the start id, with the end id."""
        place, first, n = laid_out([np.empty(len(s) + 1, np.bool_) for s in streams])
        end, start = np.array([END]), np.array([START])
        inputs = np.concatenate([x for s in streams for x in (start, s)] or [start])
        targets = np.concatenate([x for s in streams for x in (s, end)] or [end])
        filled = place >= 0
        rows, aims = np.where(filled, self.classes.row[inputs[place]], 0), np.where(filled, self.classes.of[targets[place]], 0)
        value = np.where(filled, self.classes.within[targets[place]], 0.0)
        starts = np.flatnonzero(np.ones(len(place) // STRIDE, bool)) * STRIDE
        heads = np.zeros(len(starts), bool)
        heads[first // STRIDE] = True
        for chosen, back in ((starts[heads], 0), (starts[~heads], CONTEXT)):
            for i in range(0, len(chosen), BATCH):
                at = chosen[i : i + BATCH][:, None] + np.arange(-back, STRIDE)
                mine = at[:, back:]
                value[mine] += self._windows(rows[at], aims[mine])
        value[~filled] = 0
        total = np.concatenate(([0.0], np.cumsum(value)))
        return total[first + n * STRIDE] - total[first]


# --- counts ----------------------------------------------------------------------------------------------------------
def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``words_of`` for an array of texts: the number of each word in order, the different words (binary), and the bounds of each text's words (length n + 1)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    number, kinds = coded.indices.to_numpy(), coded.dictionary
    bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
    empty = pc.index(kinds, "").as_py()  # what stands before white space at the beginning, or after it at the end
    if empty >= 0:
        kept = number != empty
        bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
        number = number[kept]
        number = number - (number > empty)
        kinds = pa.concat_arrays([kinds[:empty], kinds[empty + 1 :]])
    return number, kinds.cast(pa.binary()), bounds


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, seen, learnt): how often each word occurs in all rows and in training rows; the null word is the end. ``docs``: text, learnt (boolean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, size = [], 0, 0
        ends = np.zeros(2, np.int64)

        def sums() -> pa.Table:
            return pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("seen", "sum"), ("learnt", "sum")]).select(["word", "seen_sum", "learnt_sum"]).rename_columns(NAMES)

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal held, words, size
            held.append(pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array(ends[:1]), pa.array(ends[1:])], names=NAMES))
            yield from sums().combine_chunks().to_batches()
            held, words, size = [], 0, 0
            ends[:] = 0

        for b in batches:
            for lo, hi in chunks(b.column("text"), 2000, PART_BYTES):
                texts, learnt = b.column("text")[lo:hi], b.column("learnt")[lo:hi].to_numpy(zero_copy_only=False)
                number, kinds, bounds = split_words(texts)
                known = number[np.repeat(learnt, np.diff(bounds))]
                held.append(pa.RecordBatch.from_arrays([kinds, *(pa.array(np.bincount(x, minlength=len(kinds))) for x in (number, known))], names=NAMES))
                ends += hi - lo, int(learnt.sum())
                words += len(kinds)
                size += pc.sum(pc.binary_length(texts)).as_py() or 0
                if words > FLUSH_WORDS:
                    held = sums().combine_chunks().to_batches()
                    words = sum(map(len, held))
                if words > FLUSH_WORDS or size > FLUSH_BYTES:
                    yield from sent()
        yield from sent()

    parts = docs.select("text", "learnt").mapInArrow(run, "word binary, seen long, learnt long")
    return parts.groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("learnt").alias("learnt"))


def id_counts(rows: DataFrame) -> np.ndarray:
    """How often each id occurs in ``rows`` (ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS, np.int64)
        for b in batches:
            raw = b.column("ids")
            for lo, hi in chunks(raw, len(raw), 1 << 20):
                total += np.bincount(np.frombuffer(b"".join(raw[lo:hi].to_numpy(zero_copy_only=False)), "<u2"), minlength=IDS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    found = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # IDS rows at most
    counts = np.zeros(IDS, np.int64)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return counts


def spelled_words(words: DataFrame, path: str) -> DataFrame:
    """Words with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = WordIds(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("learnt"), pa.array(spell(b.column("word").to_numpy(zero_copy_only=False).tolist()), pa.binary())], names=["word", "learnt", "ids"])

    return words.select("word", "learnt").mapInArrow(run, "word binary, learnt long, ids binary")


def _pieces(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Streams of a batch's rows between start and end ids; long ones in parts of at most WINDOWS windows, each of which begins with the last id of the one before."""
    most = WINDOWS * STRIDE
    for raw in b.column("ids"):
        ids = np.concatenate(([START], np.frombuffer(raw.as_py(), "<u2"), [END])).astype(np.int32)
        for at in range(0, len(ids) - 1, most):
            yield ids[at : at + most + 1]


def learnt_from(rows: DataFrame, classes: Classes, tasks: int, start: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], int]:
    """Weights after all of ``rows`` (h, ids), and how many windows these have: the mean of what stretches of rows, in the order of ``h``, come to, by their windows."""
    spark = rows.sparkSession
    shapes = {k: v.shape for k, v in fresh().items()}
    given = spark.sparkContext.broadcast((classes, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, start = given.value
        held, size = [], 0
        total, windows = 0.0, 0

        def learn() -> None:
            nonlocal total, windows, held, size
            p = train(held, classes) if start is None else train(held, classes, -(-size // STEP_WINDOWS), LATER_RATE, start=start)
            total = total + size * np.concatenate([p[k].ravel() for k in shapes]).astype(np.float64)
            windows += size
            held, size = [], 0

        for b in batches:
            for piece in _pieces(b):
                n = -(-(len(piece) - 1) // STRIDE)
                if size + n > WINDOWS and size:
                    learn()
                held.append(piece)
                size += n
        if size:
            learn()
        if windows:
            yield pa.RecordBatch.from_arrays([pa.array([windows]), pa.array([total])], names=["windows", "total"])

    rows = rows.select("h", "ids")
    dealt = (rows.repartition(tasks, "h") if tasks > 1 else rows.repartition(1)).sortWithinPartitions("h", "ids")
    sums = written(dealt.mapInArrow(run, "windows long, total array<double>"), "weights")
    windows = sums.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("n")).first()["n"]
    if not windows:
        return start or fresh(), 0
    mean = sums.select(F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("w")).toArrow()  # one row a weight of the model
    flat = np.empty(mean.num_rows, np.float64)
    flat[mean.column("pos").to_numpy()] = mean.column("w").to_numpy() / windows
    parts = np.split(flat.astype(np.float32), np.cumsum([int(np.prod(s)) for s in shapes.values()])[:-1])
    return {k: x.reshape(s) for (k, s), x in zip(shapes.items(), parts, strict=True)}, windows


def ends_of_words(path: str) -> np.ndarray:
    import json

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    out = np.zeros(IDS, bool)
    out[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return out


def fit(rows: DataFrame, classes: Classes) -> Model:
    """From all training rows. ``rows``: h, ids, windows."""
    total = rows.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("n")).first()["n"]
    stretches = max(1, -(-total // WINDOWS))
    turn = F.pmod("h", F.lit(stretches))
    weights, first = learnt_from(rows.where(turn == 0), classes, 1)
    if stretches > 1:
        # each task has several stretches, as long as there are enough
        later, others = learnt_from(rows.where(turn != 0), classes, max(1, min(stretches - 1, max(64, stretches // 16))), weights if first else None)
        weights = {k: ((first * v + others * later[k]) / max(1, first + others)).astype(np.float32) for k, v in weights.items()}
    return Model(classes, weights)


def with_scores(found: DataFrame, model: Model) -> DataFrame:
    """``found`` with the score of each row's ``ids`` in their place."""
    given = found.sparkSession.sparkContext.broadcast((model.classes, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*given.value)
        for b in batches:
            for lo, hi in chunks(b.column("ids"), 500, 1 << 20):
                streams = [np.frombuffer(raw.as_py(), "<u2").astype(np.int32) for raw in b.column("ids")[lo:hi]]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[:-1]), pa.array(own.scores(streams), pa.float64())], names=[*b.schema.names[:-1], "score"])

    return found.select("row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")


def score(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", test: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``test``: which rows are held out."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-scores")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), (held_out(F.col(key)) if test is None else test).alias("held_out"))
    rows = rows.withColumn("learnt", F.coalesce(~F.col("held_out") & F.col("doc_id").isNotNull(), F.lit(False)))
    words = scratch.written(counted_words(rows), "words")
    n = words.agg(F.coalesce(F.sum("learnt"), F.lit(0)).alias("tokens"), F.count_if(F.col("learnt") > 0).alias("kinds"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("learnt"))), F.lit(0)).alias("rows")).first()
    top = spelled_words(heaviest(words.where("word IS NOT NULL"), "seen", HEAD), path).toArrow()  # HEAD rows at most
    ids = top.column("ids").to_pylist()
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    head = spark.sparkContext.broadcast((top.column("word").combine_chunks(), top.column("learnt").to_numpy(), sizes, b"".join(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names, learnt, sizes, raw = head.value
        flat = np.frombuffer(raw, "<u4")
        spell, row = WordIds(path), TaskContext.get().partitionId() << 36
        for b in batches:
            for lo, hi in chunks(b.column("text"), 2000, PART_BYTES):
                word, kinds, bounds = split_words(b.column("text")[lo:hi])
                kind = pc.fill_null(pc.index_in(kinds, value_set=names), -1).to_numpy().astype(np.int64)
                apart_of = np.flatnonzero(kind < 0)
                apart = spell(kinds.take(pa.array(apart_of)).to_numpy(zero_copy_only=False).tolist())
                number = kind[word]
                others = np.flatnonzero(number < 0)
                # ids of the words at hand, then of the others, brought into the order of the text
                counts = np.concatenate([sizes, np.fromiter(map(len, apart), np.int64, len(apart)) // 4])
                pool = np.concatenate([flat, np.frombuffer(b"".join(apart), "<u4")])
                place = kind.copy()
                place[apart_of] = len(sizes) + np.arange(len(apart_of))
                which = place[word]
                n = counts[which]
                ids = pool[np.arange(n.sum()) + np.repeat((np.cumsum(counts) - counts)[which] - (np.cumsum(n) - n), n)].astype("<u2")
                ends = np.concatenate(([0], np.cumsum(n)))[bounds]
                spelt = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(ids)])
                times = np.where(kind >= 0, learnt[kind], 0) if len(learnt) else np.zeros(len(kind), np.int64)
                upto = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[bounds])
                lists = np.searchsorted(others, bounds).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(lists), kinds.take(pa.array(word[others])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + hi - lo)), b.column("doc_id")[lo:hi], b.column("held_out")[lo:hi], b.column("learnt")[lo:hi], b.column("h")[lo:hi], pa.array(np.diff(bounds) + 1), pa.array(upto((times > 0)[word]).astype(np.int64)), pa.array(upto(np.log10(times + 1.0)[word])),
                     pa.array(np.diff(ends) // STRIDE + 1), spelt, rest],
                    names=["row", "doc_id", "held_out", "learnt", "h", "n_tokens", "n_known", "logs", "windows", "ids", "rest"],
                )
                row += hi - lo

    schema = "row long, doc_id long, held_out boolean, learnt boolean, h long, n_tokens long, n_known long, logs double, windows long, ids binary, rest array<binary>"
    found = scratch.written(rows.select("doc_id", "text", "held_out", "learnt", F.xxhash64("text", "doc_id").alias("h")).mapInArrow(run, schema), "found")
    # every word of the training rows is spelled there already, so ids are counted and words not spelled once more
    counts = id_counts(found.where("learnt"))
    counts[END] += n["rows"]
    classes = Classes.of_counts(counts, ends_of_words(path))
    scored = scratch.written(with_scores(found, fit(found.where("learnt"), classes)), "scored")
    tail = found.where("size(rest) > 0").select("row", F.explode("rest").alias("word")).join(words.where("learnt > 0").select("word", "learnt"), "word")
    more = tail.groupBy("row").agg(F.count("*").alias("known_more"), F.sum(F.log10(F.col("learnt") + 1)).alias("logs_more"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    end = F.log10(F.lit(n["rows"] + 1.0))
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero(F.col("known_more")) + int(n["rows"] > 0)).alias("n_known"), F.lit(n["tokens"]).cast("long").alias("train_tokens"),
        (F.col("logs") + zero(F.col("logs_more")) + end - F.col("n_tokens") * F.log10(F.lit(float(n["tokens"] + n["kinds"] + 1)))).alias("base_score"), "score",
    )


def op11_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import default_tokenizer
    from .shared import table

    return score(table(spark, sf_dir, "documents"), default_tokenizer())
