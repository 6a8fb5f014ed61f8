"""Chat formatting with typed content parts."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexward.llm import tokens_sql, vocabulary
from lexward.llm.common import plain
from lexward.llm.token_counts import lengths

#: A message's text is either plain, or a JSON array of parts: objects of these fields.
PART = "type string, text string, url string, width int, height int, seconds double, pages int"

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: What stands in a prompt for an attachment of a kind that has no visitor.
UNKNOWN = "<|attachment|>"


@dataclass(frozen=True)
class Flattener:
    """A visitor of content parts. Each visit_ method says in columns what a part of its kind becomes.

    shown: what takes the part's place in the prompt; tokens: what an attachment expands to when the model sees it (0 for
    text, whose tokens are counted in the prompt); ref: where the attachment is (null for text). part is a struct column of
    the fields of PART, and raw: its whole JSON.
    """

    patch: int = 28
    image_limit: int = 1280
    default_side: int = 448
    tokens_per_second: float = 12.5
    tokens_per_page: int = 258

    def kinds(self) -> dict[str, object]:
        return {name[6:]: getattr(self, name) for name in dir(self) if name.startswith("visit_")}

    def visit_text(self, part: Column) -> tuple[Column, Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0), F.lit(None).cast("string")

    def visit_image(self, part: Column) -> tuple[Column, Column, Column]:
        sides = [F.ceil(F.greatest(F.coalesce(part[side], F.lit(self.default_side)), F.lit(1)) / F.lit(self.patch)) for side in ("width", "height")]
        return F.lit("<|image|>"), F.least(sides[0] * sides[1], F.lit(self.image_limit)), part["url"]

    def visit_audio(self, part: Column) -> tuple[Column, Column, Column]:
        seconds = F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0))
        return F.lit("<|audio|>"), F.greatest(F.ceil(seconds * self.tokens_per_second), F.lit(1)), part["url"]

    def visit_document(self, part: Column) -> tuple[Column, Column, Column]:
        pages = F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1))
        return F.lit("<|document|>"), pages * self.tokens_per_page, part["url"]

    def unknown(self, part: Column) -> tuple[Column, Column, Column]:
        """A part of another kind: its text, and a placeholder of one token for the rest, with its JSON where it has no url."""
        return F.concat(self.visit_text(part)[0], F.lit(UNKNOWN)), F.lit(1), F.coalesce(part["url"], part["raw"])

    def flatten(self, part: Column) -> Column:
        """struct(kind, shown, tokens, ref) of a part; one of an unknown kind that holds nothing but text is text."""
        kind = F.lower(F.trim(part["type"]))
        only_text = part["text"].isNotNull() & (F.size(F.array_except(F.json_object_keys(part["raw"]), F.array(F.lit("type"), F.lit("text")))) == 0)
        other = ~kind.isin(list(self.kinds())) & ~only_text
        out = {"shown": F, "tokens": F, "ref": F}
        for name, visit in self.kinds().items():
            if name != "text":
                for field, column in zip(out, visit(part)):
                    out[field] = out[field].when(kind == name, column)
        for field, unknown, column in zip(out, self.unknown(part), self.visit_text(part)):
            out[field] = out[field].when(other, unknown).otherwise(column)
        others = [name for name in self.kinds() if name != "text"]
        return F.struct(F.when(kind.isin(others) | other, kind).otherwise("text").alias("kind"), out["shown"].alias("shown"), out["tokens"].cast("bigint").alias("tokens"), out["ref"].alias("ref"))


def escape(text: Column) -> Column:
    """text in which no marker can be read: '<|' is parted."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def parts_of(text: Column) -> Column:
    """The typed parts of a message: its JSON array, or its whole text as one part."""
    listed = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in PART.split(','))}>>"))
    typed = F.filter(listed, lambda p: p.isNotNull() & p["type"].isNotNull())
    raw = F.from_json(text, "array<string>")
    whole = F.transform(typed, lambda p, i: p.withField("raw", F.get(raw, i)))
    blank = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in f"{PART}, raw string".split(",")}
    alone = F.array(F.struct(*[(F.lit("text") if n == "type" else F.coalesce(text, F.lit("")) if n == "text" else c).alias(n) for n, c in blank.items()]))
    return F.when((F.size(typed) > 0) & (F.size(typed) == F.size(listed)), whole).otherwise(alone)


_MARKER = re.compile(r"<\|[a-z_]+\|>")


def marked_lengths(prompts: pa.Array, ranks_path: str) -> np.ndarray:
    """Tokens of prompts: those of the texts between markers, and one for each marker that opens or closes a message."""
    split = [_MARKER.split(p) for p in prompts.to_pylist()]
    counts = lengths(pa.array([t for s in split for t in s], pa.large_string()), ranks_path)
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    ends = np.cumsum([0, *map(len, split)])
    own = [p.count(OPEN) + p.count(CLOSE) for p in prompts.to_pylist()]
    return sums[ends[1:]] - sums[ends[:-1]] + np.array(own, np.int64)


def format_chats(turns: DataFrame, flattener: Flattener = Flattener(), ranks_path: str = vocabulary.DEFAULT_RANKS) -> DataFrame:
    """(conv_id, n_turns, prompt, attachments, expanded_tokens) of every conversation; turns has conv_id, turn, role, text.

    Turns go by turn, then role, then text; all rows count, repeated ones too, and a null turn comes last. Parts
    stay in their order: text as it is, with markers parted, attachments as placeholders. attachments lists
    struct(position, turn, kind, ref, tokens), position being the placeholder's number in the prompt from 0;
    turn is the message's place from 0. expanded_tokens is what a model sees: the tokens of texts and roles by the
    vocabulary, each marker of a message as one, and what attachments expand to.

    A null text is an empty message, a null role 'unknown'. Text that looks like JSON but isn't an array of
    objects with a type is plain text. Each row with a null conv_id is a conversation of its own, so that they never come
    together in one task. Messages of any length are kept whole: a conversation is one row, however many turns it has.
    An empty table gives no rows. Other columns are not read. One shuffle, on conv_id.
    """
    flat = turns.select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(
            F.col("turn").isNull().alias("last"),
            F.col("turn").alias("turn"),
            F.coalesce(F.trim("role"), F.lit("unknown")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("message"),
    )
    chats = flat.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("message")).alias("messages"))
    seen = chats.select("conv_id", F.transform("messages", lambda m: F.struct(escape(m["role"]).alias("role"), F.transform(parts_of(m["text"]), flattener.flatten).alias("parts"))).alias("messages"))
    prompt = F.array_join(F.transform("messages", lambda m: F.concat(F.lit(OPEN), m["role"], F.lit("\n"), F.array_join(F.transform(m["parts"], lambda p: p["shown"]), ""), F.lit(CLOSE + "\n"))), "")
    held = F.flatten(
        F.transform("messages", lambda m, i: F.transform(F.filter(m["parts"], lambda p: p["kind"] != "text"), lambda p: F.struct(i.alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))))
    )
    numbered = F.transform(held, lambda a, i: F.struct(i.alias("position"), a["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))

    @F.arrow_udf("bigint")
    def count(prompts: pa.Array) -> pa.Array:
        return pa.array(marked_lengths(plain(prompts), ranks_path), pa.int64())

    out = seen.select("conv_id", F.size("messages").alias("n_turns"), prompt.alias("prompt"), numbered.alias("attachments"))
    return out.withColumn("expanded_tokens", count("prompt") + F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


#: The given conversations hold no typed part. These are planted in them, in turn, the message's own text being one of the
#: parts (None); {c} and {t} stand for the conversation and the turn. Messages beyond the list stay as they are.
PLANTED: tuple[tuple[dict | None, ...], ...] = (
    (None, {"type": "image", "url": "img://{c}/{t}", "width": 640, "height": 481}),
    ({"type": "audio", "url": "snd://{c}", "seconds": 2.5}, None, {"type": "image", "url": "img://{c}", "width": 4000, "height": 3000}),
    (None, {"type": "document", "url": "doc://{c}/{t}", "pages": 3}, {"type": "text", "text": " as <|said|> above"}, {"type": "image"}),
    ({"type": "video", "url": "vid://{t}"}, None),
)

#: Of so many messages in a row each of them is planted in one.
PERIOD = 7


def _planted_case() -> str:
    return f"pmod(conv_id * 3 + turn, {PERIOD})"


def planted(turns: DataFrame) -> DataFrame:
    """turns with typed parts planted in some messages; where conv_id, turn or text is null, none are."""
    text = F.col("text")
    for i, parts in enumerate(PLANTED):
        listed = []
        for part in parts:
            named = {"type": F.lit("text"), "text": F.col("text")} if part is None else {k: F.replace(F.replace(F.lit(v), F.lit("{c}"), F.col("conv_id").cast("string")), F.lit("{t}"), F.col("turn").cast("string")) if isinstance(v, str) else F.lit(v) for k, v in part.items()}
            listed.append(F.to_json(F.struct(*[c.alias(k) for k, c in named.items()])))
        json = F.concat(F.lit("["), F.concat_ws(",", *listed), F.lit("]"))
        text = F.when((F.expr(_planted_case()) == i) & F.col("text").isNotNull(), json).otherwise(text)
    return turns.select("conv_id", "turn", "role", text.alias("text"))


def chat_report(turns: DataFrame) -> DataFrame:
    """format_chats() of the conversations with typed parts planted, the attachments as JSON text; rows as there."""
    return format_chats(planted(turns)).withColumn("attachments", F.to_json("attachments"))


def _sql_text(value: str) -> str:
    quoted = "'" + value.replace("'", "''") + "'"
    return f"replace(replace({quoted}, '{{c}}', conv_id::VARCHAR), '{{t}}', turn::VARCHAR)"


def _sql_part(part: dict | None, own: Flattener) -> str:
    """A part as a struct (kind, shown, tokens, ref), what it becomes being worked out here."""
    kind = "text" if part is None else part["type"]
    if kind == "text":
        text = "text" if part is None else _sql_text(part["text"])
        return f"{{'kind': 'text', 'shown': replace({text}, '<|', '< |'), 'tokens': 0, 'ref': NULL::VARCHAR}}"
    if kind == "image":
        patches = [-(-part.get(side, own.default_side) // own.patch) for side in ("width", "height")]
        shown, tokens = "<|image|>", min(patches[0] * patches[1], own.image_limit)
    elif kind == "audio":
        shown, tokens = "<|audio|>", max(1, math.ceil(part["seconds"] * own.tokens_per_second))
    elif kind == "document":
        shown, tokens = "<|document|>", part["pages"] * own.tokens_per_page
    else:
        shown, tokens = UNKNOWN, 1
    ref = _sql_text(part["url"]) if "url" in part else "NULL::VARCHAR"
    return f"{{'kind': '{kind}', 'shown': '{shown}', 'tokens': {tokens}, 'ref': {ref}}}"


def oracle(ranks_path: str = vocabulary.DEFAULT_RANKS) -> str:
    """chat_report() as DuckDB SQL."""
    own = Flattener()
    cases = " ".join(f"WHEN {i} THEN [{', '.join(_sql_part(p, own) for p in parts)}]" for i, parts in enumerate(PLANTED))
    whole = _sql_part(None, own)
    turn = f"(conv_id * 3 + turn) % {PERIOD}"
    steps = [
        "chat_rows AS MATERIALIZED (SELECT conv_id, turn, coalesce(trim(role), 'unknown') AS role, text AS given, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations)",
        f"chat_parts AS (SELECT *, CASE WHEN given IS NULL THEN [{whole}] ELSE CASE ({turn} + {PERIOD}) % {PERIOD} {cases} ELSE [{whole}] END END AS parts FROM chat_rows)",
        "chat_turns AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY conv_id, alone) AS chat, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS LAST, role, text) - 1 AS place FROM chat_parts)",
        f"chat_prompts AS MATERIALIZED (SELECT chat, any_value(conv_id) AS conv_id, count(*)::INT AS n_turns, string_agg('{OPEN}' || replace(role, '<|', '< |') || chr(10) || array_to_string(list_transform(parts, lambda p: p.shown), '') || '{CLOSE}' || chr(10), '' ORDER BY place) AS prompt FROM chat_turns GROUP BY chat)",
        "chat_held AS (SELECT chat, place, unnest(parts) AS p, generate_subscripts(parts, 1) AS n FROM chat_turns)",
        "chat_listed AS (SELECT chat, place, p, row_number() OVER (PARTITION BY chat ORDER BY place, n) - 1 AS position FROM chat_held WHERE p.kind <> 'text')",
        "chat_attached AS MATERIALIZED (SELECT chat, '[' || string_agg('{\"position\":' || position || ',\"turn\":' || place || ',\"kind\":\"' || p.kind || '\"' || CASE WHEN p.ref IS NULL THEN '' ELSE ',\"ref\":\"' || p.ref || '\"' END || ',\"tokens\":' || p.tokens || '}', ',' ORDER BY position) || ']' AS attachments, sum(p.tokens) AS tokens FROM chat_listed GROUP BY chat)",
        r"chat_between AS MATERIALIZED (SELECT chat, unnest(string_split_regex(prompt, '<\|[a-z_]+\|>')) AS text, generate_subscripts(string_split_regex(prompt, '<\|[a-z_]+\|>'), 1) AS n FROM chat_prompts)",
        *tokens_sql.stages("SELECT (chat, n) AS key, text AS body FROM chat_between", ranks_path),
        "chat_tokens AS (SELECT key[1] AS chat, sum(len(ids)) AS tokens FROM encoded GROUP BY ALL)",
    ]
    return (
        "WITH RECURSIVE " + ",\n".join(steps) + "\nSELECT conv_id, n_turns, prompt, coalesce(attachments, '[]') AS attachments, (t.tokens + 2 * n_turns + coalesce(a.tokens, 0))::BIGINT AS expanded_tokens "
        "FROM chat_prompts JOIN chat_tokens t USING (chat) LEFT JOIN chat_attached a USING (chat)"
    )
