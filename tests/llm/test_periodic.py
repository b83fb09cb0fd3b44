"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from archive_catalog.llm import periodic

DOC = "doc_id long, text string, lang string, runs string, words int, n int, best string"


def docs(spark, texts, ids=None):
    """Rows with columns that clash with names the operator uses inside."""
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC)


def brute(words, least=24, power=3):
    """All (start, length, period), from the stretches of equal words at every distance."""
    n, found = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def repetitive(rng, letters, size):
    out = []
    while len(out) < size:
        piece = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
        out += piece * rng.choice([1, 1, 2, 4, 9])
        if rng.random() < 0.2:
            out += out[-rng.randrange(1, 30) :] * rng.randrange(1, 4)
    return out[:size]


def test_runs_of_number_sequences():
    rng = random.Random(5)
    for _ in range(150):
        letters = rng.choice([2, 3, 8])
        texts = [repetitive(rng, range(letters), rng.randrange(200)) for _ in range(rng.randrange(1, 6))]
        words = np.concatenate([np.array(t, np.int64) + letters * k for k, t in enumerate(texts)])
        for least, power in ((24, 3), (4, 2), (10, 5)):
            got = periodic.find_runs(words, np.array([len(t) for t in texts]), least, power)
            want, at = [], 0
            for t in texts:
                want += [(at + a, at + a + n, q) for a, n, q in brute(t, least, power)]
                at += len(t)
            assert [tuple(r) for r in got.tolist()] == sorted(want)


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_long_runs(block, monkeypatch):
    """One word many times, long periods, Fibonacci words; candidates in small blocks."""
    monkeypatch.setattr(periodic, "BLOCK", block)
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    rng = random.Random(1)
    long = [rng.randrange(1000) for _ in range(190)]
    for words in ([7] * 600, b, long * 3 + long[:50] + [1, 2], [0, 1] * 200 + [1, 0] * 200, [*range(300)]):
        got = periodic.find_runs(np.array(words), np.array([len(words)]))
        assert [tuple(r) for r in got.tolist()] == [(s, s + n, q) for s, n, q in brute(words)]


def test_extensions_both_ways():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 4):
        words = rng.integers(0, letters, 300)
        words[100:150] = words[20:70]
        levels = periodic.recompress(words)
        one, two = np.sort(np.stack([rng.permutation(300), rng.permutation(300)]), axis=0)
        keep = one < two
        one, two = one[keep], two[keep]
        ahead, back = periodic.extensions(levels, one, two), periodic.extensions(levels, one, two, forward=False)
        for i, j, f, r in zip(one.tolist(), two.tolist(), ahead.tolist(), back.tolist(), strict=True):
            k = 0
            while j + k < 300 and words[i + k] == words[j + k]:
                k += 1
            assert f == k
            k = 0
            while k < i and words[i - 1 - k] == words[j - 1 - k]:
                k += 1
            assert r == k
        assert not (np.bincount(levels[-1].symbols[:-1]) > 1).any()


def planted(doc_id, text):
    """The words that the query looks at, by the contract's rule."""
    words = (text or "").encode().split()
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def digest(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(collapsed(words, runs))),
    )


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, "", " \t\n ", "word", "a " * 23, "a " * 24, "é b\x1cc " * 30, "x y " * 5000 + "z"]
    texts += [rng.choice([" ", "\t\n", "  "]).join(rng.choice(["A", "a", "bb", "ß", "…"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += [" ".join(map(str, repetitive(rng, range(4), rng.randrange(300)))) for _ in range(80)]
    texts += ["\x0bq\x0cr\rs " * 20, "😀 " * 40, " ".join(f"w{i}" for i in range(400))]
    texts += [texts[-2]] * 3
    ids = [*range(len(texts) - 4), 5, None, None, -3]
    docs(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op13_periodic_runs(spark, str(tmp_path)).collect()
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    show = lambda r: repr(r)
    assert sorted(show(tuple(r[c] for c in columns)) for r in got) == sorted(show(digest(i, t)) for i, t in zip(ids, texts, strict=True))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and r for i, r in zip(ids, texts, strict=True) if i is not None)


def test_texts_are_what_the_operator_returns(spark):
    words = "to be or not " * 8
    rows = periodic.periodic_runs(docs(spark, [f"so {words}that is", None, "plain words"])).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows[0]["runs"]] == [(1, 32, 4)]
    assert [r["collapsed"] for r in rows] == ["so to be or not that is", "", "plain words"]
    assert [r["n_words"] for r in rows] == [35, 0, 2]


def test_empty_table(spark):
    assert periodic.periodic_runs(docs(spark, [])).collect() == []


def test_whole_query_on_the_small_table(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[:8] for r in periodic.op13_periodic_runs(spark, small).collect()}
    assert got == {r["doc_id"]: digest(r["doc_id"], r["text"]) for r in rows}
