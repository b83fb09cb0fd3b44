"""Personal data by a semi-Markov conditional random field over candidate segments.

Fixed patterns give the base spans. Around every digit, ``@`` and ``+`` a region of tokens is cut out, and the field scores whole segments of it:
features see a candidate span at once (its shape, digits, checksum, parts, length, neighbours), and bounded-entity dynamic programming
(at most ``LONGEST`` tokens an entity) chooses boundaries and types together. Segments that it finds beyond the base spans are added.

Every candidate holds a digit or an at sign, so cutting regions out loses none. The field is trained by stochastic gradient ascent on the likelihood
(forward-backward over segments) on windows of at most ``SAMPLE`` texts (some without any entity), chosen by a hash of the text's id, each as it is and once more with its
entities written in other ways that the patterns miss (a host without a dot, spaced or dotted numbers, phones without a plus sign) or spoilt
(a number part above 255, a wrong check digit), the latter being no entities, and a third time between single words and signs, with dates, book and order numbers that are none. So it learns from planted forms of all kinds, not from the patterns alone.

For training, windows longer than ``WINDOW_TOKENS`` tokens and all but the first ``WINDOW_REGIONS`` regions of a window are left out; texts are scanned whole.

Defined results: a null text is an empty one; a null id stays null; repeated rows are scanned each; without training regions the field
adds nothing; an empty table gives no rows; other columns are ignored. Positions are code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import chunks, written

KINDS = ("email", "ip", "card", "phone")
LONGEST = 32
SAMPLE = 600
HASHED = 1 << 13
WINDOW_REGIONS, WINDOW_TOKENS = 20, 400
NEAR = 24
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a start within a run of digits fails or fits as the run's first does
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_SPOT = re.compile(r"[0-9@+]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_GOES_ON = re.compile(r"[.-]?[A-Za-z0-9]")  # what follows belongs to the same address
_DIGITS = re.compile(r"[0-9]")
_LONG = re.compile(r"[0-9](?:[ .-]?[0-9]){6,}")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind, then start."""
    out: list[Span] = []
    if not _ANY.search(text):
        return out
    last = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            last = m.end()
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


@dataclass
class Region:
    text: str
    tokens: list[tuple[int, int]]


def regions(text: str) -> Iterator[Region]:
    """Stretches around digits, at and plus signs, with NEAR characters of context, cut into tokens."""
    first = last = None
    for m in _SPOT.finditer(text):
        if last is not None and m.start() - last > 2 * NEAR:
            yield _region(text, first, last)
            first = None
        first = m.start() if first is None else first
        last = m.end()
    if first is not None:
        yield _region(text, first, last)


def _region(text: str, first: int, last: int) -> Region:
    return Region(text, [m.span() for m in _TOKEN.finditer(text, max(0, first - NEAR), min(len(text), last + NEAR))])


def _bucket(*parts) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode()) % HASHED


def span_features(region: Region, i: int, j: int) -> list[int]:
    """Hashed features of tokens i..j as one segment."""
    text, tokens = region.text, region.tokens
    start, end = tokens[i][0], tokens[j][1]
    body = text[start:end]
    shape = re.sub(r"a+", "a", re.sub(r"d+", "d", "".join("d" if c in "0123456789" else "a" if c.isalpha() else "_" if c.isspace() else c for c in body)))
    runs = [len(r) for r in re.findall(r"[0-9]+", body)]
    digits = "".join(re.findall(r"[0-9]", body))
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    word = text[tokens[i - 1][0] : tokens[i - 1][1]].lower() if i else ""
    out = [
        _bucket("shape", shape[:40]), _bucket("digits", len(digits)), _bucket("runs", tuple(runs[:6])), _bucket("tokens", j - i),
        _bucket("at", body.count("@"), body.count(".") > 0), _bucket("plus", body[0] == "+", len(digits) > 8),
        _bucket("edge", before.isspace() or not before, after.isspace() or not after, before.isalnum(), after.isalnum()),
        _bucket("ends", shape[:1], shape[-1:]), _bucket("letters", "a" in shape, "@" in shape), _bucket("any"),
    ]
    if len(digits) >= 13:
        out.append(_bucket("luhn", len(digits) <= 19 and luhn(digits)))
    if shape.replace("_", "") == "d.d.d.d":
        out.append(_bucket("parts", all(len(r) < 4 and int(r) <= 255 for r in re.findall(r"[0-9]+", body))))
    if len(word) > 1:
        out.append(_bucket("word", word))
    return out


def candidates(region: Region) -> list[tuple[int, int]]:
    """Segments (first token, last token) that may be entities: they hold a digit or an at sign, begin and end well and have no wide gap."""
    text, tokens = region.text, region.tokens
    # words belong to an entity only in an address: an at sign stands before or after them, with no space within
    address = [False] * (len(tokens) + 1)
    for j in range(len(tokens) - 1, -1, -1):
        a, b = tokens[j]
        address[j] = text[a] == "@" or (address[j + 1] and tokens[j + 1][0] == b)
    out = []
    for i, (s, _) in enumerate(tokens):
        if not (text[s].isascii() and (text[s].isalnum() or text[s] in "+(_%")):
            continue
        if s and text[s - 1] in _LOCAL and text[s - 1].isalnum() and text[s].isalnum():
            continue
        digit = at = gap = False
        for j in range(i, min(len(tokens), i + LONGEST)):
            a, b = tokens[j]
            if j > i and (a - tokens[j - 1][1] > 1 or text[tokens[j - 1][1] : a] not in ("", " ")):
                break
            gap = gap or j > i and a > tokens[j - 1][1]
            digit = digit or text[a] in "0123456789"
            if text[a].isalpha() and (gap or not at and not address[j]):
                break
            at = at or text[a] == "@"
            if at and (gap or text[a] != "@" and not (text[a].isascii() and (text[a].isalnum() or text[a] in "._%+-"))):
                break  # an address has no space, and after its at sign no other signs
            if (digit or at) and b - s >= 5 and text[b - 1].isascii() and text[b - 1].isalnum() and not (at and _GOES_ON.match(text, b)):
                out.append((i, j))
    return out


@dataclass
class Lattice:
    """Segments by last token: (first token, feature numbers); outside tokens are segments of their own."""

    size: int
    by_end: list[list[tuple[int, np.ndarray]]]

    @classmethod
    def of(cls, region: Region) -> Lattice:
        by_end: list[list[tuple[int, np.ndarray]]] = [[] for _ in region.tokens]
        for i, j in candidates(region):
            by_end[j].append((i, np.array(span_features(region, i, j))))
        return cls(len(region.tokens), by_end)


@dataclass
class Field:
    """Weights of (kind, feature); ``move``: of an entity next to an entity. An outside token scores 0."""

    weights: np.ndarray
    move: np.ndarray

    @classmethod
    def empty(cls) -> Field:
        return cls(np.zeros((len(KINDS), HASHED)), np.zeros(2))

    def scores(self, lattice: Lattice) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        return [[(i, f, self.weights[:, f].sum(axis=1)) for i, f in ends] for ends in lattice.by_end]

    def best(self, region: Region) -> list[Span]:
        """The most likely segmentation's entities."""
        lattice = Lattice.of(region)
        if not any(lattice.by_end):
            return []
        scored = self.scores(lattice)
        # best[t][e]: the best score of the first t tokens, the last of them ending an entity (e = 1) or outside (e = 0)
        best = [[0.0, -np.inf]]
        back: list[list] = [[None, None]]
        for t, ends in enumerate(scored):
            out = max(best[t])
            entity, came = -np.inf, None
            for i, _, s in ends:
                k = int(s.argmax())
                prior = 0 if best[i][0] >= best[i][1] + self.move[1] else 1
                value = best[i][prior] + (self.move[1] if prior else 0) + s[k]
                if value > entity:
                    entity, came = value, (i, prior, k)
            best.append([out, entity])
            back.append([(t, int(best[t][1] > best[t][0]), None), came])
        found, t, e = [], lattice.size, int(best[-1][1] > best[-1][0])
        while t:
            i, prior, k = back[t][e]
            if k is not None:
                found.append((k, region.tokens[i][0], region.tokens[t - 1][1]))
            t, e = i, prior
        return found[::-1]

    def step(self, lattice: Lattice, gold: set[tuple[int, int, int]], rate: float) -> None:
        """One ascent step on the log-likelihood of ``gold`` (first token, last token, kind)."""
        scored = self.scores(lattice)
        n = lattice.size
        front = np.full((n + 1, 2), -np.inf)
        front[0, 0] = 0
        enter = lambda i: np.logaddexp(front[i, 0], front[i, 1] + self.move[1])
        for t, ends in enumerate(scored):
            front[t + 1, 0] = np.logaddexp(front[t, 0], front[t, 1])
            parts = [enter(i) + np.logaddexp.reduce(s) for i, _, s in ends]
            front[t + 1, 1] = np.logaddexp.reduce(parts) if parts else -np.inf
        total = np.logaddexp(*front[n])
        rear = np.full((n + 1, 2), -np.inf)
        rear[n] = 0
        starts: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        for t, ends in enumerate(scored):
            for i, _, s in ends:
                starts[i].append((t + 1, s))
        for t in range(n - 1, -1, -1):
            begun = np.logaddexp.reduce([rear[u, 1] + np.logaddexp.reduce(s) for u, s in starts[t]]) if starts[t] else -np.inf
            rear[t] = np.logaddexp(rear[t + 1, 0], begun), np.logaddexp(rear[t + 1, 0], begun + self.move[1])
        for t, ends in enumerate(scored):
            for i, f, s in ends:
                p = np.exp(enter(i) + s + rear[t + 1, 1] - total)
                pull = -p
                for k in range(len(KINDS)):
                    if (i, t, k) in gold:
                        pull[k] += 1
                if np.abs(pull).max() > 1e-4:
                    for k in range(len(KINDS)):
                        np.add.at(self.weights[k], f, rate * pull[k])


def gold_segments(region: Region, spans: list[Span]) -> set[tuple[int, int, int]] | None:
    """The base spans as tokens of the region; None if one of them can't be a segment. Of overlapping spans the longest counts."""
    starts, ends = {s: i for i, (s, _) in enumerate(region.tokens)}, {e: i for i, (_, e) in enumerate(region.tokens)}
    lo, hi = (region.tokens[0][0], region.tokens[-1][1]) if region.tokens else (0, 0)
    out, taken = set(), []
    for kind, s, e in sorted(spans, key=lambda x: x[1] - x[2]):
        if e <= lo or s >= hi or any(s < b and a < e for a, b in taken):
            continue
        if s not in starts or e not in ends or ends[e] - starts[s] >= LONGEST:
            return None
        out.add((starts[s], ends[e], kind))
        taken.append((s, e))
    return out


def other_form(kind: int, body: str, n: int) -> tuple[str, bool]:
    """An entity as the patterns don't know it, and whether it still is one."""
    if kind == 0:
        name, _, host = body.partition("@")
        return f"{name}@{host.partition('.')[0]}", True
    if kind == 1:
        parts = body.split(".")
        return (" . ".join(parts), True) if n % 2 else (".".join([*parts[:3], str(300 + n % 600)]), False)
    if kind == 2:
        return (re.sub(r"[ -]", ".", body) if re.search(r"[ -]", body) else ".".join(re.findall(r".{1,4}", body)), True) if n % 2 else (body[:-1] + str((int(body[-1]) + 1 + n % 8) % 10), False)
    return (body[1:], True) if n % 3 == 0 else ("00" + body[1:], True) if n % 3 == 1 else (re.sub(r"^\+[0-9]{1,3} ", "", body), True)


def rewritten(text: str, spans: list[Span], n: int) -> tuple[str, list[Span]]:
    """``text`` with its entities in other forms (of overlapping ones the longest counts), and the spans of what still is one."""
    taken: list[Span] = []
    for x in sorted(spans, key=lambda x: x[1] - x[2]):
        if not any(x[1] < e and s < x[2] for _, s, e in taken):
            taken.append(x)
    out, last, size, found = [], 0, 0, []
    for i, (kind, s, e) in enumerate(sorted(taken, key=lambda x: x[1])):
        body, real = other_form(kind, text[s:e], n + i)
        out += [text[last:s], body]
        size += s - last
        if real:
            found.append((kind, size, size + len(body)))
        size, last = size + len(body), e
    return "".join(out) + text[last:], found


#: What may stand right around an entity, and numbers that are none.
_AROUND = ("{} {}, {}", "{} <{}> {}", "{} [{}] {}", "{} {}; {}", "{} {}! {}", "{} '{}' {}", "{}\n{}\n{}", "{}={}&{}")


def _no_entity(n: int) -> str:
    return (
        f"{1990 + n % 40}-{1 + n % 12:02}-{1 + n % 28:02} {n % 24:02}:{n * 7 % 60:02}", f"97{8 + n % 2}-{n % 10}-{10 + n % 90}-{100000 + n * 7919 % 900000}-{n * 3 % 10}", f"{1 + n % 28}/{1 + n % 12}/{1990 + n % 40}", f"#{100000 + n * 104729 % 900000}-{n % 10}",
        f"{n % 7}.{n % 10}.{n * 3 % 100}", f"{1900 + n % 120}-{1900 + n % 130}",
    )[n % 6]


def framed(text: str, spans: list[Span], n: int, other: bool) -> tuple[str, list[Span]]:
    """The entities of a text, as they are or in ``other`` forms, between single words of it and signs; between them numbers that are no entities."""
    words = re.findall(r"[^\W\d_]{2,}", text) or ["and"]
    out, size, found = [], 0, []

    def put(piece: str, kind: int | None = None, at: int = 0, length: int = 0) -> None:
        nonlocal size
        if kind is not None:
            found.append((kind, size + at, size + at + length))
        out.append(piece)
        size += len(piece)

    for i, (kind, s, e) in enumerate(spans):
        left, right = words[(n + 2 * i) % len(words)], words[(n + 3 * i + 1) % len(words)]
        body, real = other_form(kind, text[s:e], n + i) if other else (text[s:e], True)
        if kind == 0 and other:  # names and hosts of other shapes than the corpus has
            a, b = (re.sub("[^a-z]", "", w.lower()) or "x" for w in (words[(n + 5 * i + 2) % len(words)], words[(n + 7 * i + 3) % len(words)]))
            body = (f"{a}@{b}", f"{a}.{b[:1]}@{b}", f"{a}_{b}@{b}", f"{a}{n % 90}@{b}-{n % 9}", f"{a}@{b}-{a}", f"{a}+{b}@{a}", body)[(n // 2 + i) % 7]
        frame = _AROUND[(n + i) % len(_AROUND)]
        put(frame.format(left, body, right), kind if real else None, len(frame.split("{}")[0] + left + frame.split("{}")[1]), len(body))
        put(f" {right} {_no_entity(n + i)} {left} ")
    return "".join(out), found


def train(texts: list[str], epochs: int = 8, rate: float = 0.3) -> Field:
    field, data = Field.empty(), []
    for n, text in enumerate(texts):
        spans = base_spans(text)
        for body, own in ((text, spans), rewritten(text, spans, n), framed(text, spans, n, False), *(framed(text, spans, n // 2 + 3 * k, True) for k in range(4))) if spans else ((text, spans),):
            for region in list(regions(body))[:WINDOW_REGIONS]:
                gold = gold_segments(region, own)
                if gold is not None and len(region.tokens) <= WINDOW_TOKENS:
                    lattice = Lattice.of(region)
                    if any(lattice.by_end):
                        data.append((lattice, gold))
    for epoch in range(epochs):
        for lattice, gold in data:
            field.step(lattice, gold, rate / (1 + epoch / 4))
    return field


def fit(docs: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> Field:
    """From at most ``sample`` texts that hold base spans or long numbers, the first by a hash of their ids."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]\.[0-9]+\.[0-9]|[0-9]{4}[ -]?[0-9]{4}"))

    # windows, not texts, travel: what surrounds the places of interest
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column("text"), 500, 1 << 23):
                out_id, out = [], []
                for doc_id, t in zip(b.column("doc_id")[lo:hi].to_pylist(), b.column("text")[lo:hi].to_pylist(), strict=True):
                    spans = base_spans(t)
                    # texts without a base span teach what is none: their first long number
                    places = [x[1:] for x in spans] or [m.span() for m in [_LONG.search(t)] if m]
                    if places:
                        s, e = min(x[0] for x in places), max(x[1] for x in places)
                        out_id.append(int.from_bytes(hashlib.blake2b(f"{doc_id}".encode(), digest_size=8).digest(), "little", signed=True))
                        out.append(t[max(0, s - 200) : min(e + 200, s + 2000)])
                yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out, pa.string())], names=["h", "window"])

    # written first, so that each task's first rows meet in a task and only ``sample`` rows of 2,400 characters reach the driver
    got = written(rows.mapInArrow(cut, "h long, window string").orderBy("h", "window").limit(sample), "pii-sample").collect()
    return train([r["window"] for r in got])


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the field adds: segments that overlap no base span."""
    base = base_spans(text)
    if not _SPOT.search(text):
        return base, []
    sides = sorted((s, e) for _, s, e in base)
    added = []
    for region in regions(text):
        for kind, s, e in field.best(region):
            if not any(a < e and s < b for a, b in sides):
                added.append((kind, s, e))
    return base, added


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column("text"), 1000, 1 << 23):
                counts, digest, listed, more = [], [], [], []
                for t in b.column("text")[lo:hi].to_pylist():
                    base, added = find(t or "", field)
                    counts.append([sum(k == x[0] for x in base) for k in range(len(KINDS))])
                    digest.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                    listed.append(_listed(sorted(base + added)))
                    more.append(len(added))
                columns = np.array(counts, np.int64).reshape(-1, len(KINDS))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[lo:hi], *(pa.array(columns[:, k]) for k in range(len(KINDS))), pa.array(digest), pa.array(listed), pa.array(more, pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; overlapping spans become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            for lo, hi in chunks(b.column(at), 1000, 1 << 23):
                out = []
                for t in b.column(at)[lo:hi].to_pylist():
                    if t:
                        base, added = find(t, field)
                        pieces, last = [], 0
                        for kind, s, e in sorted(base + added, key=lambda x: (x[1], -x[2])):
                            if s >= last:
                                pieces += [t[last:s], f"[{KINDS[kind].upper()}]"]
                            last = max(last, e)
                        t = "".join(pieces) + t[last:] if pieces else t
                    out.append(t)
                part = b.slice(lo, hi - lo)
                yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op2_semicrf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
