"""Language identification by error-correcting output codes over character n-grams.

Each language gets a codeword of +1 and -1 (rows of a Hadamard matrix without its constant column, so all are equally far apart and
single wrong bits are corrected). For every bit a binary logistic classifier on hashed byte n-grams (1 to 3, lower-cased) is
trained to tell the languages with +1 from those with -1. A text's bit margins are decoded by loss weighting: the codeword with
the least total logistic loss, each bit weighted by its accuracy on a fifth of the sample that it was not trained on, wins. A small gap to the second is flagged as ambiguous.

The classifiers are fitted on a bounded sample of labelled rows: ``per_language`` of each language at most, fewer where there are so many languages that this would pass
``SAMPLE_ROWS`` in all, chosen by a hash of the text; no language is left out. Every whole text is predicted. Prediction sees the text alone.

Defined results: a null text or one without a letter is ``und`` with score 0; without any labelled row all are ``und``; with
one language all texts with letters are of it; null ids and repeated rows are predicted like any other (a null id is not held out
and not learned from); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import U64, chunks, mix64

DIMENSIONS = 1 << 12
PER_LANGUAGE = 400
#: Bounds what reaches the driver: rows of 8 KB.
SAMPLE_ROWS = 8192
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")
_PIECE = 1 << 18


def ngram_counts(text: str) -> np.ndarray:
    """L2-normalised square roots of hashed counts of the text's byte n-grams of length 1 to 3."""
    counts = np.zeros(DIMENSIONS, np.float64)
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(raw), _PIECE):
        b = raw[max(0, at - 2) : at + _PIECE].astype(np.uint32)
        skip = at - max(0, at - 2)
        two = b[:-1] << 8 | b[1:]
        three = two[:-1] << 8 | b[2:]
        for k, grams in ((1, b[skip:]), (2, two[max(0, skip - 1) :]), (3, three)):
            mixed = (grams + np.uint32(k << 24)) * np.uint32(2654435761)
            counts += np.bincount(mixed >> np.uint32(20), minlength=DIMENSIONS)
    counts = np.sqrt(counts)
    norm = np.linalg.norm(counts)
    return counts / norm if norm else counts


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1, any two of which differ in half of the places."""
    size = 2
    while size < max(n, 8):
        size *= 2
    i = np.arange(size)
    hadamard = 1 - 2 * (np.bitwise_count(i[:, None] & i[None, :]) & 1).astype(np.int64)
    return hadamard[:n, 1:] if n < size else hadamard[:, 1:]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score in 0..1 and whether the second is about as good, for each row."""
        margins = features @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -c[None, :] * margins) * self.trust).sum(axis=1) for c in self.codes], axis=1)
        best = loss.argmin(axis=1)
        odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
        score = np.clip(1 / odds.sum(axis=1), 0, 1)
        return best, score, score < 0.6


def train(languages: list[str], features: np.ndarray, labels: np.ndarray, steps: int = 300, rate: float = 8.0, decay: float = 1e-5) -> Model:
    """Full-batch gradient descent with momentum, for all bits at once."""
    codes = codewords(len(languages))
    target = codes[labels].astype(np.float32)
    weights, bias = np.zeros((features.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(steps):
        pull = -target / (1 + np.exp(target * (features @ weights + bias))) / np.float32(len(labels))
        speed_w = 0.9 * speed_w - rate * (features.T @ pull + decay * weights)
        speed_b = 0.9 * speed_b - rate * pull.sum(axis=0)
        weights += speed_w
        bias += speed_b
    return Model(languages, codes, weights, bias, np.ones(codes.shape[1]))


def weighed(model: Model, features: np.ndarray, labels: np.ndarray) -> Model:
    """``model`` with each bit weighted by how often it is right on these rows, above chance."""
    right = (np.sign(features @ model.weights + model.bias) == model.codes[labels]).mean(axis=0)
    return replace(model, trust=np.maximum(right * 2 - 1, 0.01))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of at most ``per_language`` distinct texts a language, those with the least hashes; ids decide only that no held-out row is among them.

    The hashes alone are ranked, first in 16 parts a language; texts are read again for the few that are chosen.
    """
    usable = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    hashed = usable.select("lang", F.xxhash64("text").alias("h"))
    ranked = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("k") <= per_language).drop("k")
    some = ranked(hashed.withColumn("part", F.pmod("h", F.lit(16))), "lang", "part").drop("part").distinct()
    chosen = ranked(some, "lang")
    rows = usable.select("lang", "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), ["lang", "h"])  # per_language rows a language
    # copies of a chosen text, however many, are one row: each task keeps one, then all tasks together
    return rows.groupBy("lang", "h").agg(F.min("text").alias("text")).drop("h")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """``docs``: doc_id, text, lang. Collects the bounded sample's n-gram counts."""
    n = docs.where("lang IS NOT NULL").agg(F.countDistinct("lang").alias("n")).first()["n"]
    rows = labelled_sample(docs, max(1, min(per_language, sample_rows // max(1, n))))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, grams = [], []
            for name, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if _LETTER.search(text):
                    lang.append(name)
                    grams.append(ngram_counts(text).astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(grams, pa.binary())], names=["lang", "grams"])

    got = sorted((r["lang"], bytes(r["grams"])) for r in rows.mapInArrow(features, "lang string, grams binary").toLocalIterator())  # at most sample_rows, or one a language
    if not got:
        return None
    languages = sorted({x for x, _ in got})
    place = {x: i for i, x in enumerate(languages)}
    labels = np.array([place[x] for x, _ in got])
    matrix = np.frombuffer(b"".join(g for _, g in got), "<f2").reshape(len(got), DIMENSIONS).astype(np.float32)
    del got
    test = np.arange(len(labels)) % 5 == 4
    model = train(languages, matrix[~test], labels[~test])
    return weighed(model, matrix[test], labels[test]) if len(languages) > 1 and test.any() else model


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns of ``docs`` with lang_pred, score and ambiguous."""
    kept = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column("text"), 500, 1 << 23):
                texts = b.column("text")[lo:hi].to_pylist()
                has = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)
                lang, score, unsure = np.full(len(texts), UND, object), np.zeros(len(texts)), np.ones(len(texts), bool)
                if model is not None and has.any():
                    best, s, a = model.decode(np.stack([ngram_counts(t) for t, h in zip(texts, has, strict=True) if h]))
                    lang[has], score[has], unsure[has] = [model.languages[i] for i in best], s, a
                yield pa.RecordBatch.from_arrays([*(b.column(c)[lo:hi] for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=[*keep, "lang_pred", "score", "ambiguous"])

    from pyspark.sql import types as T

    schema = T.StructType([*kept.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op8_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(docs), ("doc_id",))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
