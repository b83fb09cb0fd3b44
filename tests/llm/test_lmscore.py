"""Language-model scores: counts against brute force, the model against one position at a time, gradients against differences."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from archive_catalog.llm import lmscore, packing

DOC = "doc_id long, text string, lang string, word string, learnt int, seen int, row int, held_out int"
PATH = packing.default_tokenizer()


def docs(spark, texts, ids=None):
    """Rows with columns that clash with names the operator uses inside."""
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, 3, 4) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC)


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base(ids, texts):
    """held_out, n_tokens, n_known, train_tokens, base_score by the contract's formula."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*("".join(c if c not in " \t\n\v\f\r" else " " for c in (t or "").translate(lower)).split(" ")), None] for t in texts]
    tokens = [[w for w in own if w != ""] for own in tokens]
    learnt = Counter(w for i, own in zip(ids, tokens, strict=True) if i is not None and not out(i) for w in own)
    total, kinds = sum(learnt.values()), len(learnt)
    return [
        (out(i), len(own), sum(learnt[w] > 0 for w in own), total, sum(math.log10((learnt[w] + 1) / (total + kinds + 1)) for w in own))
        for i, own in zip(ids, tokens, strict=True)
    ]


def compared(rows, want):
    assert len(rows) == len(want)
    for r, w in zip(rows, want, strict=True):
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9, abs=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


WORDS = ["the", "The", "THE", "é", "É", "a b", "x" * 40, "İstanbul", "don't", "\x1c", "😀", "rare", "of", "1999", "ß"]


@pytest.mark.parametrize(("head", "flush"), [(1 << 18, 300_000), (3, 2), (0, 1)])
def test_base_scores_against_brute_force(spark, monkeypatch, head, flush):
    """With all words, few and none at hand in the tasks; with counts sent on all the time."""
    monkeypatch.setattr(lmscore, "HEAD", head)
    monkeypatch.setattr(lmscore, "FLUSH_WORDS", flush)
    monkeypatch.setattr(lmscore, "STEPS", 10)
    rng = random.Random(2)
    texts = [None, "", " \n", "never seen elsewhere", *(rng.choice([" ", "\t\v", "\r\n"]).join(rng.choice(WORDS) for _ in range(rng.randrange(60))) for _ in range(50)), "hot " * 4000]
    texts += [f"only{i}" for i in range(20)]
    ids = list(range(len(texts)))
    ids[5:8] = [12, 12, -4]
    rows = lmscore.score(docs(spark, texts, ids).repartition(3), PATH).collect()
    show = lambda r: (r[0], r[1], r[2], round(r[4], 6))
    rows.sort(key=lambda r: (r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)))
    compared(rows, sorted(base(ids, texts), key=show))


def test_query_on_the_small_table(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = sorted(lmscore.op11_attention_scores(spark, small).collect(), key=lambda r: r["doc_id"])
    compared(got, base([r["doc_id"] for r in rows], [r["text"] for r in rows]))
    # held-out texts: better than counts of ids alone
    spell = lmscore.WordIds(PATH)
    streams = {r["doc_id"]: np.frombuffer(b"".join(spell(lmscore.words_of(r["text"]))), "<u4").astype(int) for r in rows}
    counts = np.ones(lmscore.IDS)
    for i, s in streams.items():
        if not out(i):
            counts += np.bincount(np.append(s, lmscore.END), minlength=lmscore.IDS)
    unigram = np.log10(counts / counts.sum())
    held = [r for r in got if r["held_out"]]
    ours, plain = sum(r["score"] for r in held), sum(unigram[np.append(streams[r["doc_id"]], lmscore.END)].sum() for r in held)
    assert ours > 0.9 * plain, (ours, plain)


def trained(seed=0, steps=30):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, lmscore.IDS)
    classes = lmscore.Classes.of_counts(counts, lmscore.ends_of_words(PATH))
    common = np.argsort(-counts)[:60]
    pieces = [np.concatenate(([lmscore.START], rng.choice(common, rng.integers(1, 150)), [lmscore.END])) for _ in range(40)]
    return lmscore.Model(classes, lmscore.train(pieces, classes, steps)), rng


def one_by_one(model, stream):
    """Each id's chance from its own context, in double precision, without windows or tables."""
    p = {k: v.astype(float) for k, v in model.weights.items()}
    ids, total = [lmscore.START, *stream], 0.0
    half = lmscore.WIDTH // lmscore.HEADS
    for t, target in enumerate([*stream, lmscore.END]):
        begin = max(0, t // lmscore.STRIDE * lmscore.STRIDE - lmscore.CONTEXT)
        x = p["embed"][model.classes.row[ids[begin : t + 1]]]
        parts = []
        for h in range(lmscore.HEADS):
            cut = slice(h * half, (h + 1) * half)
            a = (x @ p["key"][:, cut]) @ (x[-1] @ p["query"][:, cut]) / math.sqrt(half) + p["near"][h, np.arange(len(x))[::-1]]
            w = np.exp(a - a.max())
            parts.append(w / w.sum() @ (x @ p["value"][:, cut]))
        hidden = np.maximum(np.concatenate([x[-1], *parts]) @ p["hidden"] + p["lift"], 0)
        logits = hidden @ p["out"] + p["bias"]
        chance = np.exp(logits - logits.max())
        total += math.log10(chance[model.classes.of[target]] / chance.sum()) + model.classes.within[target]
    return total


@pytest.mark.parametrize("tame", [True, False])
def test_windows_score_each_id_once(tame):
    model, rng = trained()
    model.tame = tame
    streams = [rng.integers(0, 40_000, n) for n in (0, 1, 31, 32, 33, 63, 64, 65, 200, 7000)]
    for got, s in zip(model.scores(streams), streams, strict=True):
        if len(s) < 1000:
            assert got == pytest.approx(one_by_one(model, s), rel=1e-4)
    assert model.scores(streams) == pytest.approx([model.scores([s])[0] for s in streams], rel=1e-5)
    assert len(model.scores([])) == 0


def test_chances_add_up_to_one():
    model, rng = trained()
    per_class = np.bincount(model.classes.of, weights=10**model.classes.within, minlength=lmscore.ALONE + 2 * lmscore.DEALT)
    assert per_class == pytest.approx(np.ones(len(per_class)))
    assert 10 ** model.classes.within[lmscore.START] == 0
    rows = np.repeat(model.classes.row[rng.integers(0, 1000, (1, lmscore.STRIDE))], len(per_class), axis=0)
    every = np.repeat(np.arange(len(per_class))[:, None], lmscore.STRIDE, axis=1)
    assert (10.0 ** model._windows(rows, every)).sum(axis=0) == pytest.approx(np.ones(lmscore.STRIDE), rel=1e-4)


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in lmscore.fresh().items()}
    keys = lmscore.CONTEXT + lmscore.STRIDE
    rows, there = rng.integers(0, 30, (3, keys)), np.ones((3, keys), bool)
    there[0, : lmscore.CONTEXT] = False
    there[1, -5:] = False
    classes, counted = rng.integers(0, lmscore.ALONE + 2 * lmscore.DEALT, (3, lmscore.STRIDE)), np.ones((3, lmscore.STRIDE), bool)
    counted[1, -5:] = False
    _, g = lmscore.gradients(p, rows, there, classes, counted)
    for name, v in p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if name == "embed":
                at = (int(rows[2, at[0] % keys]), at[1])
            before = v[at]
            v[at] = before + 1e-5
            up = lmscore.gradients(p, rows, there, classes, counted)[0]
            v[at] = before - 1e-5
            down = lmscore.gradients(p, rows, there, classes, counted)[0]
            v[at] = before
            assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8), name


def test_attention_learns_what_counts_cannot():
    """Each id follows from the one before the last: a model without attention has no way to tell."""
    rng = np.random.default_rng(7)
    counts = np.zeros(lmscore.IDS, np.int64)
    counts[:8] = 100
    classes = lmscore.Classes.of_counts(counts, lmscore.ends_of_words(PATH))
    step = {i: (3 * i + 1) % 8 for i in range(8)}

    def stream(n):
        s = [int(rng.integers(8)), int(rng.integers(8))]
        while len(s) < n:
            s.append(step[s[-2]])
        return np.array(s)

    model = lmscore.Model(classes, lmscore.train([np.concatenate(([lmscore.START], stream(120))) for _ in range(300)], classes, 400))
    tests = [stream(150) for _ in range(10)]
    perplexity = 10 ** (-model.scores(tests).sum() / sum(len(t) for t in tests))
    assert perplexity < 3, perplexity


def test_nulls_and_empty_tables(spark):
    assert lmscore.score(docs(spark, []), PATH).collect() == []
    rows = lmscore.score(docs(spark, ["a", None], [None, None]), PATH).orderBy("n_tokens").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["held_out"]) for r in rows] == [(1, 0, 0, 0.0, False), (2, 0, 0, 0.0, False)]
    assert all(math.isfinite(r["score"]) for r in rows)


def test_every_position_of_every_training_row_is_learnt_from(spark, monkeypatch):
    """Of rows, long ones too, only the order of the words differs, so that all counts stay: the scores of other texts change with each of them."""
    monkeypatch.setattr(lmscore, "WINDOWS", 40)
    monkeypatch.setattr(lmscore, "SAMPLE", 4, raising=False)
    rng = random.Random(4)
    learnt = [i for i in range(200) if not out(i)][:12]
    texts = {i: [rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(1500 if i == learnt[0] else 100)] for i in learnt}
    probe = next(i for i in range(200) if out(i))

    def scored(texts):
        ids = [*texts, probe]
        rows = lmscore.score(docs(spark, [*map(" ".join, texts.values()), "the alpha of the beta"], ids).repartition(2), PATH).collect()
        return next(r["score"] for r in rows if r["doc_id"] == probe)

    plain = scored(texts)
    assert scored(dict(reversed(texts.items()))) == plain
    for i in (learnt[0], learnt[5], learnt[8], learnt[11]):
        changed = texts | {i: texts[i][:-4] + texts[i][:-5:-1]}
        assert changed[i] != texts[i] and scored(changed) != plain, i


def test_later_stretches_make_the_model_better(spark, monkeypatch):
    """Each id follows from the one before the last, with many stretches in several tasks; each window is trained on."""
    rng, seen = np.random.default_rng(7), []
    words = ["red", "green", "blue", "black", "white", "brown", "grey", "pink"]

    def text(n):
        s = [int(rng.integers(8)), int(rng.integers(8))]
        while len(s) < n:
            s.append((3 * s[-2] + 1) % 8)
        return " ".join(words[i] for i in s)

    texts = [text(120) for _ in range(600)]
    monkeypatch.setattr(lmscore, "WINDOWS", 500)
    whole = lmscore.learnt_from
    monkeypatch.setattr(lmscore, "learnt_from", lambda *a: seen.append((a[1], *whole(*a))) or seen[-1][1:])
    rows = [r for r in lmscore.score(docs(spark, texts), PATH).collect() if r["held_out"]]
    assert len(seen) == 2 and sum(n for *_, n in seen) == 4 * sum(not out(i) for i in range(600))
    spell = lmscore.WordIds(PATH)
    streams = [np.frombuffer(b"".join(spell(lmscore.words_of(texts[r["doc_id"]]))), "<u4").astype(int) for r in rows]
    first = lmscore.Model(*seen[0][:2]).scores(streams).sum() / sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows) > first


def test_words_of_many_texts_at_once():
    """As ``words_of`` has them, with each different word once."""
    import pyarrow as pa

    texts = pa.array([None, "", " a  B\tc\x0bd\x0ce\rf\n", "x\x1cy \x85z\xa0w \u00c9 a", "  ", "A", *(" ".join(WORDS[i:]) for i in range(len(WORDS)))])
    for some in (texts, texts[2:4], texts[4:5], texts[:0]):
        number, kinds, bounds = lmscore.split_words(some)
        kinds = kinds.to_pylist()
        assert len(set(kinds)) == len(kinds)
        assert [[kinds[i] for i in number[a:b]] for a, b in zip(bounds, bounds[1:])] == [lmscore.words_of(t) for t in some.to_pylist()]


def test_words_are_spelled_once(spark, monkeypatch):
    """Ids are counted from the training rows' own ids, without a second spelling of all words, and the counts are right."""
    seen = []
    whole = lmscore.Classes.of_counts
    monkeypatch.setattr(lmscore.Classes, "of_counts", lambda counts, ends: seen.append(counts.copy()) or whole(counts, ends))
    counted = lmscore.id_counts
    monkeypatch.setattr(lmscore, "id_counts", lambda rows: seen.append(rows.columns) or counted(rows))
    monkeypatch.setattr(lmscore, "HEAD", 4)
    rng = random.Random(5)
    texts = [None, "", *(" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(30))]
    ids = [*range(31), None]
    assert lmscore.score(docs(spark, texts, ids).repartition(3), PATH).count() == 32
    spell = lmscore.WordIds(PATH)
    want = np.zeros(lmscore.IDS, np.int64)
    for i, t in zip(ids, texts, strict=True):
        if i is not None and not out(i):
            want += np.bincount(np.append(np.frombuffer(b"".join(spell(lmscore.words_of(t))), "<u4"), lmscore.END).astype(np.int64), minlength=lmscore.IDS)
    assert "ids" in seen[0] and (seen[1] == want).all()


def test_marks_of_plain_words():
    """The quick way to mark a word's parts gives what the expression gives."""
    rng = random.Random(6)
    letters = [chr(c) for c in (*range(33, 0x130), *range(0x131, 0x250))]
    words = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 6))).lower() for pool in (letters, "abz'stredmlv.,-_1\u00b2\u00aa\u00b5") for _ in range(5000)]
    assert all(packing._marked(w) == packing._PART.sub("\\g<0>\0", w) for w in words)
    assert all(w + "\0" == packing._PART.sub("\\g<0>\0", w) for w in words if w.isalpha())


def test_scores_beyond_the_bound_are_held_back():
    """Weights so great that products pass the bound: finite gradients and scores, as those of the bounded ones."""
    model, rng = trained()
    p = {k: v * (400 if k in ("query", "out") else 1) for k, v in model.weights.items()}
    rows = rng.integers(0, 30, (2, lmscore.CONTEXT + lmscore.STRIDE))
    full = np.ones(rows.shape, bool)
    loss, g = lmscore.gradients(p, rows, full, np.zeros((2, lmscore.STRIDE), int), full[:, lmscore.CONTEXT :])
    assert math.isfinite(loss) and all(np.isfinite(x).all() for x in g.values())
    assert lmscore.gradients(p, rows, full, np.zeros((2, lmscore.STRIDE), int), full[:, lmscore.CONTEXT :], measured=False)[0] is None
    assert np.isfinite(lmscore.Model(model.classes, p).scores([rng.integers(0, 40_000, 100)])).all()
