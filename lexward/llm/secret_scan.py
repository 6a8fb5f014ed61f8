"""Secret scan: values in credential contexts, scored by the guesses they take."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexward.llm import guesses
from lexward.llm.common import plain

#: Where a word begins within a camelCase name. Patterns ignore case but here.
_HUMP = "(?-i:(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"

#: Names after which a value is a credential. A key needs a word before it, of any kind: secret_key, encryptionKey.
NAMES = rf"pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|auth|private)key|(?:(?<=[a-z0-9][_-])|{_HUMP})key|credentials?"

#: A value in quotes, its first quote read already: all up to the same quote on the line, which a backslash escapes.
_QUOTED = "|".join(rf"(?<={q})(?:[^{q}\\\r\n]|\\[^\r\n])++(?={q})" for q in "\"'")

#: A line that has a name and value of its own: it is not the value of a name before it.
_NAMED_LINE = r"[\"']?[\w.-]++[\"']?\h*+(?::(?:[=\s\"']|\z)|=>?\h*+[^\s=])"

#: name = value, name: value, also with :=, => and ==, quoted or not, among any white space; the value may stand on a
#: later line. Groups: name, value in quotes, value without. The latter ends at white space or a quote, as does one
#: whose quote isn't closed on the line. The name is the whole run of letters, digits, '_' and '-', read once from its
#: beginning and never given back, so the search is linear; what it ends with makes it a credential's.
CONTEXT = (
    rf"(?i)(?<![a-z0-9_-])[_-]*+([a-z0-9][a-z0-9_-]*+)(?<=(?:(?<![a-z0-9])|{_HUMP})(?:{NAMES}))"
    rf"[\"']?+\s*+(?>:=|=>|={{1,3}}|:)\h*+(?:\v\s*+(?!{_NAMED_LINE}))?+[\"']?+(?:({_QUOTED})|([^\s\"']++))"
)

#: Of each name what all its spellings contain, in lower case: a text without any is not searched.
_MARKS = ("pass", "pwd", "secret", "token", "key", "credential")

#: A value that takes at least 2 to this power guesses is a secret.
MIN_BITS = 40.0

#: Prefixes of issued keys, which need no name before them. Group 2 is empty here.
ISSUED = r"\b(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})\b"


def _score(values: pa.Array) -> pa.Array:
    known: dict[str, tuple[float, str]] = {}
    for value in set(plain(values).to_pylist()):
        bits, parts = guesses.segment(value)
        known[value] = (bits, " ".join(f"{kind}:{len(part)}" for kind, part in parts))
    rows = [known[v] for v in plain(values).to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.string())], ["bits", "parts"])


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bits: float = MIN_BITS) -> DataFrame:
    """(doc_id, n, name, value, log10_guesses, parts, is_secret) of every value in a credential context.

    n numbers a row's values from 0 in their order. Issued keys are found by their prefix too, under the name
    'issued', after the others. The search runs in the JVM over whole texts; only the values, a tiny part,
    reach the Arrow function that scores them. is_secret says whether a value takes 2 to the power min_bits
    guesses. A value in quotes is all that they hold on the line; without quotes, trailing punctuation is not part of a value,
    and what is nothing else is none. Values of any length are listed, short ones too, under their whole names.

    A null or empty text has no values. A value met twice is listed twice; repeated rows and null ids are kept.
    An empty table gives no rows. Values of any length are scored whole. Only the two columns named are read.
    """

    @F.arrow_udf("bits double, parts string")
    def score(values: pa.Array) -> pa.Array:
        return _score(values)

    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    low = F.lower("text")
    marked = F.col("text").rlike("[:=]") & F.greatest(*[F.contains(low, F.lit(m)) for m in _MARKS])
    issued = F.greatest(*[F.contains("text", F.lit(m)) for m in ("AKIA", "gh", "xox")])
    none = F.array().cast("array<string>")
    named = F.when(marked, F.arrays_zip(*[F.regexp_extract_all("text", F.lit(CONTEXT), i).alias(g) for i, g in enumerate(("name", "quoted", "bare"), 1)]))
    bare = F.when(issued, F.regexp_extract_all("text", F.lit(ISSUED), 1)).otherwise(none)
    empty = F.array().cast("array<struct<name:string,quoted:string,bare:string>>")
    every = F.concat(F.coalesce(named, empty), F.transform(bare, lambda v: F.struct(F.lit("issued").alias("name"), F.lit("").alias("quoted"), v.alias("bare"))))
    told = F.transform(every, lambda f: F.struct(F.lower(f["name"]).alias("name"), F.when(f["quoted"] != "", f["quoted"]).otherwise(F.regexp_replace(f["bare"], r"[,;.)\]}>]+$", "")).alias("value")))
    found = rows.where(marked | issued).select("doc_id", F.filter(told, lambda f: f["value"] != "").alias("found"))
    values = found.select("doc_id", F.posexplode("found").alias("n", "f")).select("doc_id", "n", "f.name", "f.value")
    scored = values.withColumn("s", score("value"))
    return scored.select("doc_id", "n", "name", "value", (F.col("s.bits") * math.log10(2)).alias("log10_guesses"), F.col("s.parts").alias("parts"), (F.col("s.bits") >= min_bits).alias("is_secret"))
