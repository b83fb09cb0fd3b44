"""Chat formatting by a finite-state machine over roles and a declarative template.

A template lists, for each role, the pieces of a turn in order and whether each is trained on; the machine lists which role may
follow which. Control strings can't occur in a formatted text: each character that they begin or end with, and the escape sign itself, is
written as the sign and a digit, which ``unescape`` takes back exactly. The result keeps the segments with a loss flag each, so a tokenizer can build the
mask, and ``read_back`` recovers turns and trained text from that output alone.

Defined results: turns are ordered by (turn, role, text), nulls first; a null text or role counts as empty; unknown roles are formatted
with the fallback pieces and make the conversation invalid, as does a wrong order (``first_bad`` is the first such place, from 0);
rows with a null conversation id form one conversation; repeated rows are repeated turns; an empty table gives no rows; other
columns are ignored. A conversation becomes one string, so its turns meet in one row by nature.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Pieces of a turn by role: (literal text or the mark TEXT or ROLE, trained on?). ``follows``: state -> roles allowed next."""

    TEXT = object()
    ROLE = object()
    turns: dict = field(default_factory=dict)
    fallback: tuple = ()
    follows: dict = field(default_factory=dict)
    accepting: tuple = ()
    control: str = "<[|"


_OPEN, _MID, _CLOSE = "<|", "|>\n", "</s>\n"
CHAT = Template(
    turns={
        "assistant": ((_OPEN, False), (Template.ROLE, False), (_MID, False), (Template.TEXT, True), (_CLOSE, False)),
    },
    fallback=((_OPEN, False), (Template.ROLE, False), (_MID, False), (Template.TEXT, False), (_CLOSE, False)),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    accepting=("user", "assistant"),
)


def escape(text: Column, template: Template = CHAT) -> Column:
    for i, c in enumerate(ESCAPE + template.control):
        text = F.replace(text, F.lit(c), F.lit(f"{ESCAPE}{i}"))
    return text


def unescape(text: Column, template: Template = CHAT) -> Column:
    """A sign is always followed by its digit, so the sign itself, as number 0, comes last."""
    for i, c in reversed(list(enumerate(ESCAPE + template.control))):
        text = F.replace(text, F.lit(f"{ESCAPE}{i}"), F.lit(c))
    return text


def _segments(role: Column, text: Column, template: Template) -> Column:
    def build(pieces) -> Column:
        return F.array(*[
            F.struct((escape(text, template) if p is Template.TEXT else escape(role, template) if p is Template.ROLE else F.lit(p)).alias("text"), F.lit(bool(loss)).alias("loss"))
            for p, loss in pieces
        ])

    out = build(template.fallback)
    for name, pieces in template.turns.items():
        out = F.when(role == name, build(pieces)).otherwise(out)
    return out


def _first_bad(roles: Column, template: Template) -> Column:
    """Place of the first role that the machine refuses; null if it accepts all."""
    def step(acc: Column, role: Column) -> Column:
        ok = F.lit(False)
        for state, names in template.follows.items():
            ok = ok | ((acc["state"] == state) & role.isin(*names))
        bad = F.when(acc["bad"].isNull() & ~ok, acc["at"]).otherwise(acc["bad"])
        return F.struct(role.alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(roles, start, step, lambda acc: F.coalesce(acc["bad"], F.when(~acc["state"].isin(*template.accepting), acc["at"])))


def format_chats(turns: DataFrame, template: Template = CHAT, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """One row per conversation: the keys, segments array<struct<text, loss>>, formatted, valid, first_bad."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    ordered = turns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), "turn", role.alias("role"), text.alias("text")))).alias("turns"))
    return (
        ordered.withColumn("segments", F.flatten(F.transform("turns", lambda t: _segments(t["role"], t["text"], template))))
        .withColumn("first_bad", _first_bad(F.transform("turns", lambda t: t["role"]), template))
        .select(*keys, "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("first_bad").isNull().alias("valid"), "first_bad")
    )


def read_back(chats: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Turns (role, text) parsed from ``formatted`` and the trained text from ``segments``."""
    # no "<" and no "|" is in a role or text, so the marks can only be the template's own
    body = F.col("formatted")
    pieces = F.slice(F.split(body, r"</s>\n"), 1, F.size(F.split(body, r"</s>\n")) - 1)
    cut = F.transform(pieces, lambda p: F.struct(
        unescape(F.regexp_extract(p, r"^<\|([^|]*)\|>\n", 1)).alias("role"),
        unescape(F.regexp_replace(p, r"^<\|[^|]*\|>\n", "")).alias("text"),
    ))
    trained = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return chats.select(*keys, cut.alias("turns"), F.array_join(trained, "").alias("trained"), F.length(body).cast("long").alias("formatted_chars"), "valid", "first_bad")


def digest(chats: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(chats, keys).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars", "valid",
    )


PROBE = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(0).alias("added"))
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"), F.lit(1).alias("added"))
    keys = ("conv_id", "added")
    return digest(format_chats(turns.unionByName(probe), keys=keys), keys)


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(replace(text, '\', ''), '<', ''), '[', ''), '|', '')) AS esc,
  lag(role) OVER w AS prev, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(esc + length(role) + 10) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN role = 'user' THEN prev IN ('system', 'assistant') WHEN role = 'assistant' THEN prev = 'user' ELSE false END)
    AND bool_and(k < n OR role IN ('user', 'assistant')) AS valid
FROM f GROUP BY conv_id
"""
