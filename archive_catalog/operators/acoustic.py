"""Acoustic fingerprints: pairs, groups, decoding and merging of results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import soundalike
from .dedup import with_group
from .graph import components
from .scratch import Scratch

BAND_SEC = 7.0
MAX_BER = 0.15
#: Rows of either side that meet in a task.
TASK_ROWS = 2048


def bit_error_rate(a: Column, b: Column) -> Column:
    """Share of differing bits over the common prefix of two arrays of 32-bit words; 1 if there is none."""
    n = F.least(F.size(a), F.size(b))
    bits = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, bits / (F.lit(32.0) * n)).otherwise(1.0)


def fingerprint_pairs(items: DataFrame, max_ber: float = MAX_BER, band: float = BAND_SEC, share: int = TASK_ROWS, counts: tuple | None = None) -> DataFrame:
    """(a, b, ber) of items (file_id, fp, duration_sec) of about the same length and sound."""
    return soundalike.pairs(items.where("fp IS NOT NULL AND duration_sec IS NOT NULL"), max_ber, band, share, counts)


def alike(scratch: Scratch, items: DataFrame) -> DataFrame:
    """(file_id, first): of items with equal fingerprints and durations the least id stands for all."""
    same = scratch.written(items.where("fp IS NOT NULL AND duration_sec IS NOT NULL").select("file_id", F.sha2(F.to_json(F.struct("fp", "duration_sec")), 256).alias("print")), "prints")
    return with_group(scratch, same, "print", F.min("file_id").alias("first")).select("file_id", "first")


def fingerprint_clusters(items: DataFrame, max_ber: float = MAX_BER, band: float = BAND_SEC, share: int = TASK_ROWS, counts: tuple | None = None) -> DataFrame:
    """(kind, group_id, file_id, n_members) of items that sound alike, directly or by others; equal fingerprints are compared as one."""
    scratch = Scratch(items.sparkSession, "clusters")
    named = scratch.written(alike(scratch, items), "named")
    ones = items.join(named.where("file_id = first").select("file_id"), "file_id", "left_semi")
    # an empty fingerprint is like nothing, not even its own kind
    sounding = named.where("first <> file_id").join(items.where(F.size("fp") > 0).select("file_id"), "file_id", "left_semi")
    pairs = soundalike.links(ones, max_ber, band, share, counts)
    return fingerprint_groups(pairs.unionByName(sounding.select(F.col("first").alias("a"), F.col("file_id").alias("b"))))


def fingerprint_groups(pairs: DataFrame) -> DataFrame:
    """(kind, group_id, file_id, n_members): transitive closure of the pairs."""
    scratch = Scratch(pairs.sparkSession, "groups")
    labels = scratch.written(components(pairs, "a", "b"), "labels")
    sized = with_group(scratch, labels, "label", F.count("*").alias("n_members"))
    return sized.select(F.lit("AUDIO_FINGERPRINT").alias("kind"), F.col("label").alias("group_id"), F.col("node").alias("file_id"), "n_members")


def _fields(bits: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits, least bit first: ``count[i]`` of them from bit ``first[i]`` on, for all i one after the other."""
    at = np.repeat(first, count) + width * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return (bits[at[:, None] + np.arange(width)].astype(np.int64) << np.arange(width)).sum(axis=1) if len(at) else np.zeros(0, np.int64)


def _ranks(owner: np.ndarray, n: int) -> np.ndarray:
    """Place of each element among those of its owner; owners don't fall."""
    count = np.bincount(owner, minlength=n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def decode_many(raw: list[bytes | None]) -> list[np.ndarray | None]:
    """Sub-fingerprints of compressed fingerprints, all of a batch at once; null where malformed.

    After a head of four bytes (the last three: the number of words) come 3-bit steps between set bits, ending with 0 for each word; a
    step of 7 takes a 5-bit addition from the part that follows. Words are XORed with their predecessor.
    """
    n = len(raw)
    size = np.array([int.from_bytes(r[1:4], "big") if r is not None and len(r) >= 4 else 0 for r in raw], np.int64)
    length = np.array([max(0, len(r) - 4) if r is not None else 0 for r in raw], np.int64)
    good = (size > 0) & (size <= length * 8 // 3)  # a word takes one step at least
    length[~good] = 0
    bits = np.unpackbits(np.frombuffer(b"".join(r[4:] for r, g in zip(raw, good, strict=True) if g), np.uint8), bitorder="little")
    start = (np.cumsum(length) - length) * 8
    count = length * 8 // 3
    steps, owner = _fields(bits, start, count, 3), np.repeat(np.arange(n), count)
    before = np.cumsum(steps == 0) - (steps == 0)  # words that ended before, in all
    ended = np.bincount(owner[steps == 0], minlength=n)
    good &= ended >= size
    word = before - np.repeat(np.cumsum(ended) - ended, count)
    use = (word < np.repeat(size, count)) & good[owner]
    steps, owner, word = steps[use], owner[use], word[use]
    wide = np.flatnonzero(steps == 7)
    used = np.bincount(owner, minlength=n)
    more = np.bincount(owner[wide], minlength=n)
    at = -(-used * 3 // 8) * 8
    good &= at + 5 * more <= length * 8
    more[~good] = 0
    wide = wide[good[owner[wide]]]
    steps[wide] += _fields(bits, start + at, more, 5)
    total = np.cumsum(steps)
    new = np.ones(len(steps), bool)
    new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
    place = total - np.repeat((total - steps)[new], np.diff(np.append(np.flatnonzero(new), len(steps)))) - 1
    set_ = steps > 0
    good[np.unique(owner[set_ & (place > 31)])] = False
    set_ &= good[owner]
    held = np.where(good, size, 0)
    base = np.cumsum(held) - held
    words = np.zeros(held.sum(), np.int64)
    np.bitwise_xor.at(words, base[owner[set_]] + word[set_], np.int64(1) << place[set_])
    whole = np.bitwise_xor.accumulate(words)
    whole ^= np.repeat(np.concatenate(([0], whole))[base], held)  # each print begins anew
    return [whole[b : b + k] if g else None for b, k, g in zip(base, held, good, strict=True)]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _decoded(raw: pd.Series) -> pd.Series:
    return pd.Series(decode_many(list(raw)), dtype=object)


def decode_fingerprint(text: Column) -> Column:
    """Sub-fingerprints of base64 texts, in either alphabet, padded or not; null if malformed."""
    plain = F.rtrim(F.translate(text, "-_", "+/"), F.lit("="))
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return _decoded(F.try_to_binary(padded, F.lit("base64")))


def merge_acoustic(audio: DataFrame, computed: DataFrame) -> DataFrame:
    """Audio rows with nulls filled from computed (file_id, fingerprint, fingerprint_dur, bpm, musical_key, camelot)."""
    fields = ["fingerprint", "fingerprint_dur", "bpm", "musical_key", "camelot"]
    new = computed.select("file_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    both = audio.join(new, "file_id", "left")
    tempo = F.col("bpm").isNull() & F.col("new_bpm").isNotNull() | F.col("musical_key").isNull() & F.col("new_musical_key").isNotNull()
    return both.select(
        *[c for c in audio.columns if c not in (*fields, "status", "key_bpm_source")], *[F.coalesce(c, f"new_{c}").alias(c) for c in fields],
        F.when(F.col("fingerprint").isNull() & F.col("new_fingerprint").isNotNull(), "FINGERPRINTED").otherwise(F.col("status")).alias("status"),
        F.when(tempo, "COMPUTED").otherwise(F.col("key_bpm_source")).alias("key_bpm_source"),
    )


def pending(audio: DataFrame, fields: tuple[str, ...] = ("fingerprint", "bpm", "musical_key")) -> DataFrame:
    """Rows that still lack an enabled field."""
    out = F.lit(False)
    for f in fields:
        out = out | F.col(f).isNull()
    return audio.where(out)


def phase_totals(results: DataFrame) -> DataFrame:
    """What a phase obtained; an error counts only where nothing was."""
    nothing = F.col("fingerprint").isNull() & F.col("bpm").isNull() & F.col("musical_key").isNull()
    return results.agg(F.count("fingerprint").alias("fingerprints"), F.count("bpm").alias("bpms"), F.count("musical_key").alias("keys"), F.count_if(F.col("error").isNotNull() & nothing).alias("errors"))
