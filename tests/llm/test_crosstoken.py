"""Alignment of two tokenizers against brute force."""

import hashlib
import json
import random
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from archive_catalog.llm import crosstoken

DOC = "doc_id long, text string, lang string, pair string, n int, row int, a string, rest string"
PATHS = crosstoken.default_tokenizers()


def docs(spark, texts, ids=None):
    """Rows with columns that clash with names the operator uses inside."""
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, "y", "z") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC)


class Plain:
    """Tokens and their bytes straight from the two libraries."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}

    def spell(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def __call__(self, text):
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False)
        one = [(i, bytes(self.letters[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
        two = [(i, self.spell(i)) for i in self.b.encode(text)]
        raw = (" " + text).encode()
        return (one, two) if b"".join(t for _, t in one) == raw == b"".join(t for _, t in two) else ([], [])


def ranged(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(texts):
    """Rows without ids, by comparing every token of the one side with every token of the other."""
    plain, rows, total = Plain(), [], Counter()
    for text in texts:
        one, two = map(ranged, plain(text))
        ends = sorted({e for _, _, e in one} & {e for _, _, e in two})
        groups, last = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, x in side if last <= s and x <= e) for side in (one, two)))
            last = e
        links = [(i, j) for i, s, e in one for j, u, v in two if s < v and u < e]
        total.update(links)
        rows.append((len(one), len(two), len(groups), ";".join(groups), links))
    best = {}
    for (_, j), n in total.items():
        best[j] = max(best.get(j, 0), n)
    return [(a, b, g, len(links), text, sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links)) for a, b, g, text, links in rows]


def got(df, name="groups"):
    return [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r[name], r["n_best"], r["count_sum"]) for r in df.orderBy("doc_id").collect()]


WORDS = ["the", "Straße", "naïve", "  ", "\n\n", "\t", "don't", "12345", "<|endoftext|>", "</s>", "<0x41>", "▁", "日本語テキスト", "😀", "é", " ", "　", "x" * 30, "reordering", "unbelievable", "...", "ﬁ", "\x1c", "\x00", "a", "Zażółć"]


def sample(n, seed=4):
    rng = random.Random(seed)
    return [None, "", " ", "\n", "  two  spaces ", "tail ", *("".join(rng.choice(WORDS) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(n))]


@pytest.mark.parametrize(("head", "memo"), [(1 << 18, 1 << 17), (20, 16), (0, 1)])
def test_against_brute_force(spark, monkeypatch, head, memo):
    """With all pairs, few and none at hand in the tasks; with a memo that is full all the time."""
    monkeypatch.setattr(crosstoken, "HEAD", head)
    monkeypatch.setattr(crosstoken, "MEMO", memo)
    texts = sample(60) + ["the the the", "the the the"]
    assert got(crosstoken.align(docs(spark, texts).repartition(3), *PATHS)) == brute(texts)


def test_query_on_the_small_table(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").select("text").collect()
    texts = [r["text"] for r in rows]
    want = [(*r[:4], r[4] and hashlib.sha256(r[4].encode()).hexdigest(), *r[5:]) for r in brute_by_offsets(texts)]
    assert got(crosstoken.op12_cross_tokens(spark, small), "groups_sha256") == want


def brute_by_offsets(texts):
    """As ``brute``, with links found from the bytes that tokens cover: for long texts."""
    plain, rows, total = Plain(), [], Counter()
    for text in texts:
        one, two = map(ranged, plain(text))
        owner = [j for j, (_, s, e) in enumerate(two) for _ in range(s, e)]
        links = [(i, two[j][0]) for i, s, e in one for j in range(owner[s], owner[e - 1] + 1)]
        ends_one, ends_two = {e for _, _, e in one}, {e for _, _, e in two}
        groups, last = [], (0, 0)
        at_one, at_two = {e: k + 1 for k, (_, _, e) in enumerate(one)}, {e: k + 1 for k, (_, _, e) in enumerate(two)}
        for e in sorted(ends_one & ends_two):
            now = (at_one[e], at_two[e])
            groups.append(",".join(str(t[0]) for t in one[last[0] : now[0]]) + "|" + ",".join(str(t[0]) for t in two[last[1] : now[1]]))
            last = now
        total.update(links)
        rows.append((len(one), len(two), len(groups), ";".join(groups), links))
    best = {}
    for (_, j), n in total.items():
        best[j] = max(best.get(j, 0), n)
    return [(a, b, g, len(links), text, sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links)) for a, b, g, text, links in rows]


def test_repeats_nulls_and_empty_tables(spark):
    texts, ids = ["same text", "same text", None, "x" * 5000, "same text"], [3, 3, 9, 7, None]
    rows = crosstoken.align(docs(spark, texts, ids), *PATHS).collect()
    assert sorted((str(r["doc_id"]), r["n_a"], r["groups"] == "") for r in rows) == sorted([("3", 2, False), ("3", 2, False), ("9", 0, True), ("7", rows[[r["doc_id"] for r in rows].index(7)]["n_a"], False), ("None", 2, False)])
    assert crosstoken.align(docs(spark, []), *PATHS).collect() == []
    assert [r["n_links"] for r in crosstoken.align(docs(spark, [None, ""]), *PATHS).collect()] == [0, 0]


def test_byte_letters_and_pattern():
    import public_tokenizers

    assert crosstoken.PATTERN == public_tokenizers.PATTERN
    with open(PATHS[0], encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    assert set(crosstoken.byte_letters()) == {c for t in vocabulary if t != "<|endoftext|>" for c in t}
    assert sorted(crosstoken.byte_letters().values()) == list(range(256))


ENCODERS = crosstoken.Encoders(*PATHS)
PLAIN = "".join(chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2013, 0x2027)])


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(PLAIN + "  '" * 20), max_size=60))
def test_both_encoders_agree_on_plain_texts(text):
    assert crosstoken._PLAIN.fullmatch(text)
    assert ENCODERS.fast.encode_ordinary(" " + text) == ENCODERS.tokenizer.encode(" " + text, add_special_tokens=False).ids


def test_every_plain_character_between_others():
    for c in PLAIN:  # also a gap in the middle
        for text in (f"a{c}b", f" {c}", f"{c} {c}{c}", f"1{c}2 '{c}s"):
            assert ENCODERS.fast.encode_ordinary(" " + text) == ENCODERS.tokenizer.encode(" " + text, add_special_tokens=False).ids, repr(c)
