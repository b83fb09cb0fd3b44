"""Secret scanning with multipart credential linking.

Strong spans (assignments, access key ids, long hexadecimal runs) are reported wherever they stand. Weak candidates say little
alone: a login-like ``name: value``, a mixed random-looking token, an endpoint (URL or host with port). They are reported only when
complementary parts co-occur: parts become intervals, an interval join pairs identifiers with secrets whose gap is at
most ``scope`` code points, within one row's text, and endpoints join those pairs in the same way. The join is an equi-join on (row, block of
``scope`` code points), the left side listed under the blocks of both its ends, the right side under the neighbouring blocks too, so it costs the parts near each other only.

Positions are code points: a match starts after the pieces and matches before it. Everything is DataFrame functions.

Defined results: a null text is an empty one; rows that repeat id and text are scanned each; a null id stays null; identifiers and secrets may be of any length; an empty table gives
no rows; other columns are ignored. Strong spans are leftmost and non-overlapping per kind; those too short are dropped without a retry.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, part of a credential). A group 1 holds what must have 6 characters at least.
STRONG = {
    "assign": (_ASSIGN, "secret"),
    "access": (r"AKIA[A-Z0-9]{16,}", "identifier"),  # a shorter run holds no later match either
    "hex": (r"[0-9a-f]{24,}", "secret"),
}
WEAK = {
    "login": (r"""\b(?:(?i:username|user|login|client_?id|account|key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", "identifier"),
    "random": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", "secret"),
    "endpoint": (r"""(?:https?|jdbc|postgres|mysql|redis|amqp|ftp|s3)://[^\s"'<>]+|\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}\b""", "endpoint"),
}
#: What a match of a kind must hold besides.
MIXED = {"random": ("[0-9]", "[A-Z]", "[a-z]")}
SCOPE = 160
_SPAN = "array<struct<start:int,kind:int,end:int,name:string,part:string>>"


def _spans(text: Column, number: int, name: str, pattern: str, part: str, value_least: int = 0) -> Column:
    """Spans of the pattern's matches, in order."""
    p = F.lit(pattern)
    found, gaps = F.regexp_extract_all(text, p, 0), F.split(text, pattern, -1)
    sizes = F.transform(found, lambda x: F.length(x))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        return F.struct((at + x["size"]).alias("at"), F.array_append(acc["out"], F.struct(at.alias("start"), (at + x["size"]).alias("end"))).alias("out"))

    steps = F.zip_with(sizes, F.slice(F.transform(gaps, lambda x: F.length(x)), 1, F.size(found)), lambda s, g: F.struct(s.alias("size"), g.alias("gap")))
    places = F.aggregate(steps, start, step, lambda acc: acc["out"])
    spans = F.transform(places, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), F.lit(name).alias("name"), F.lit(part).alias("part")))
    if name in MIXED:
        mixed = lambda x: reduce(and_, (x["value"].rlike(c) for c in MIXED[name]))
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("span"), found.alias("value")), mixed), lambda x: x["span"])
    if value_least:
        values = F.regexp_extract_all(text, p, 1)
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("span"), values.alias("value")), lambda x: F.length(x["value"]) >= value_least), lambda x: x["span"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, scope: int = SCOPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    body = F.col("text")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    strong = [_spans(body, i, k, p, part, 6 if k == "assign" else 0).alias(k) for i, (k, (p, part)) in enumerate(STRONG.items())]
    weak = [_spans(body, len(STRONG) + i, k, p, part).alias(k) for i, (k, (p, part)) in enumerate(WEAK.items())]
    # links are made row by row, so that copies of one text don't meet in one task
    found = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), *strong, *weak)
    scanned = written(
        found.select(
            "doc_id", "row", *[F.size(k).cast("long").alias(f"n_{k}") for k in STRONG],
            F.array_sort(F.flatten(F.array(*STRONG))).alias("strong"), F.flatten(F.array(*WEAK)).alias("weak"),
        ),
        "secret-spans",
    )
    kinds = F.concat(F.transform("strong", lambda s: s["part"]), F.transform("weak", lambda s: s["part"]))
    both = F.array_contains(kinds, "identifier") & F.array_contains(kinds, "secret") & (F.size("weak") > 0)
    parts = scanned.where(both).select("row", F.explode(F.concat("strong", "weak")).alias("s")).select("row", "s.*")

    def edges(start: str, end: str) -> Column:
        """The blocks of both ends: what is near a long identifier may be near one of them only."""
        return F.explode(F.array_distinct(F.array(F.floor(F.col(start) / scope), F.floor(F.col(end) / scope))))

    identifiers = parts.where("part = 'identifier'").withColumn("block", edges("start", "end")).select("row", "block", *[F.col(c).alias(f"i_{c}") for c in ("start", "end", "kind", "name")])
    # from each interval to the blocks where a part that is near enough can start
    reach = F.explode(F.sequence(F.floor((F.col("start") - 2 * scope) / scope), F.floor((F.col("end") + scope) / scope)))
    secrets = parts.where("part = 'secret'").withColumn("block", reach).select("row", "block", *[F.col(c).alias(f"s_{c}") for c in ("start", "end", "kind", "name")])
    apart = F.greatest(F.col("i_start"), F.col("s_start")) - F.least(F.col("i_end"), F.col("s_end"))
    pairs = identifiers.join(secrets, ["row", "block"]).where((apart >= 0) & (apart <= scope))
    endpoints = parts.where("part = 'endpoint'").withColumn("block", reach).select("row", "block", *[F.col(c).alias(f"e_{c}") for c in ("start", "end", "kind", "name")])
    away = F.greatest(F.col("i_start"), F.col("e_start")) - F.least(F.col("i_end"), F.col("e_end"))
    sites = (
        pairs.select("row", "i_start", "i_end").distinct().withColumn("block", edges("i_start", "i_end")).join(endpoints, ["row", "block"]).where((away >= 0) & (away <= scope))
        .select("row", F.col("e_start").alias("start"), F.col("e_kind").alias("kind"), F.col("e_end").alias("end"), F.col("e_name").alias("name"))
    )

    def side(prefix: str) -> DataFrame:
        return pairs.select("row", *[F.col(f"{prefix}_{c}").alias(c) for c in ("start", "kind", "end", "name")])

    linked = side("i").unionByName(side("s")).unionByName(sites).where(F.col("kind") >= len(STRONG)).distinct()
    per_row = linked.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "name")).alias("linked"))
    base = F.transform("strong", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["name"].alias("name")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,name:string>>")
    # rows whose parts can't be complementary are not shuffled at all
    every = scanned.where(both).join(per_row, "row", "left").unionByName(scanned.where(~both).withColumn("linked", none))
    return every.select(
        "doc_id", *[f"n_{k}" for k in STRONG], F.sha2(_listed(F.col("strong")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat(base, F.coalesce("linked", none)))).alias("spans"), F.size(F.coalesce("linked", none)).cast("long").alias("n_linked"),
    )


def op1_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return find_secrets(table(spark, sf_dir, "documents"))
