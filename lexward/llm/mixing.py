"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexward.llm import tokens_sql, vocabulary
from lexward.llm.common import cut, hinted, plain
from lexward.llm.token_counts import lengths

#: What stands for every value that a mapping of weights doesn't name.
OTHERS = "*"

#: Marginals raked by default. A mapping gives target weights by value; a number is the exponent that tempers the observed
#: token shares into targets, for a marginal whose values aren't known beforehand.
DEFAULT_TARGETS: dict[str, float | Mapping[str, float]] = {
    "source": 0.9,
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.17, "es": 0.13, OTHERS: 0.01},
    "topic": {"prose": 0.93, "legal": 0.035, "tables": 0.02, "contact": 0.015, OTHERS: 0.01},
}

#: Rounds over the marginals at most, and the greatest relative error of a marginal's value at which they end sooner.
ROUNDS = 20
CONVERGED = 1e-12

#: A greater error than this after all rounds, as where the cells that exist can't have all targets, is warned of.
TOLERANCE = 1e-3

#: Contingency cells that are fitted on the driver; a larger table is fitted by the cluster.
DRIVER_CELLS = 200_000

#: Topics where no column tells them, by the first rule that holds: a text that contains the mark.
TOPIC_RULES = (("legal", "icense"), ("tables", " | "), ("contact", "@"))
OTHER_TOPIC = "prose"

NONE = "∅"


def topic_of(text: Column) -> Column:
    out = F
    for topic, mark in TOPIC_RULES:
        out = out.when(F.contains(text, F.lit(mark)), topic)
    return out.otherwise(OTHER_TOPIC)


def tokens_of(text: Column, ranks_path: str = vocabulary.DEFAULT_RANKS) -> Column:
    """Tokens of a text by a vocabulary; 0 where it is null."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(lengths(plain(texts), ranks_path), pa.int64())

    return count(text)


def _uniform(key: Column, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"mix{seed}:"), F.coalesce(key.cast("string"), F.lit(NONE))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)


def _cells_of(docs: DataFrame, topic: str | None) -> list[Column]:
    """source, lang and topic of each row; topic: a column that has it, else the rules."""
    named = [F.coalesce(docs[f"`{c}`"].cast("string"), F.lit(NONE)).alias(n) for n, c in (("source", "source"), ("lang", "lang"), *([("topic", topic)] if topic else []))]
    return named if topic else [*named, topic_of(docs["text"]).alias("topic")]


def _weight(wanted: Mapping[str, float], value: str) -> float:
    return float(wanted.get(value, wanted.get(OTHERS, 0.0)))


def _target(shares: dict[str, float], wanted: float | Mapping[str, float]) -> dict[str, float]:
    """Target shares by value: tempered observed ones, or the given weights where tokens exist."""
    if isinstance(wanted, Mapping):
        raw = {v: _weight(wanted, v) if s > 0 else 0.0 for v, s in shares.items()}
    else:
        raw = {v: s**wanted if s > 0 else 0.0 for v, s in shares.items()}
    total = sum(raw.values())
    if shares and total <= 0:
        raise ValueError("no value that occurs has a positive target weight")
    return {v: w / total for v, w in raw.items()}


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Factor of each cell, so that the tokens times the factors have the target shares in every marginal; and the
    greatest relative error that is left."""
    factor, total, error = np.ones(len(cells)), cells.sum(), 0.0
    for _ in range(rounds):
        for code, target in zip(codes, targets):
            now = np.bincount(code, cells * factor, len(target)).astype(float)
            factor *= np.divide(target * total, now, out=np.ones_like(now), where=now > 0)[code]
        error = max([0.0, *(float(np.abs(np.bincount(c, cells * factor, len(t))[t > 0] / (t[t > 0] * total) - 1).max(initial=0.0)) for c, t in zip(codes, targets))])
        if error < CONVERGED:
            break
    return factor, error


def _rake_here(cells: DataFrame, targets: Mapping, rounds: int) -> tuple[DataFrame, float]:
    table = cells.toPandas().sort_values(list(targets), ignore_index=True)
    tokens = table["tokens"].to_numpy(np.float64)
    codes, wanted = [], []
    for c, want in targets.items() if tokens.any() else ():
        values, code = np.unique(table[c].to_numpy(str), return_inverse=True)
        sums = np.bincount(code, tokens, len(values))
        shares = _target(dict(zip(values, sums / max(tokens.sum(), 1.0))), want)
        codes.append(code)
        wanted.append(np.array([shares[v] for v in values]))
    table["factor"], error = rake(tokens, codes, wanted, rounds)
    keys = ["source", "lang", "topic"]
    schema = pa.schema([*((c, pa.string()) for c in keys), ("tokens", pa.int64()), ("factor", pa.float64())])
    return cells.sparkSession.createDataFrame(pa.Table.from_pandas(table[schema.names], schema, preserve_index=False)), error  # no Python worker


def _rake_there(cells: DataFrame, targets: Mapping, rounds: int) -> tuple[DataFrame, float]:
    """The same by joins of the cells with their marginals, cutting the lineage once a round."""
    total = cells.agg(F.sum("tokens")).first()[0]
    out = cells.withColumn("factor", F.lit(1.0))
    columns = ("source", "lang", "topic", "tokens", "factor")
    if not total:
        return out.select(*columns), 0.0
    for c, want in targets.items():
        sums = cells.groupBy(c).agg(F.sum("tokens").cast("double").alias("s"))
        if isinstance(want, Mapping):
            known = F.create_map(*[x for k, v in want.items() for x in (F.lit(k), F.lit(float(v)))])
            raw = F.when(F.col("s") > 0, F.coalesce(F.try_element_at(known, F.col(c)), F.lit(float(want.get(OTHERS, 0.0))))).otherwise(0.0)
        else:
            raw = F.when(F.col("s") > 0, F.pow(F.col("s") / float(total), F.lit(float(want)))).otherwise(0.0)
        sums = cut(sums.withColumn("raw", raw))
        norm = sums.agg(F.sum("raw")).first()[0]
        if not norm:
            raise ValueError("no value that occurs has a positive target weight")
        out = out.join(sums.select(c, (F.col("raw") / norm).alias(f"want_{c}")), c)
    for _ in range(rounds):
        for c in targets:
            now = out.groupBy(c).agg(F.sum(F.col("tokens") * F.col("factor")).alias("now"))
            scale = F.when(F.col("now") > 0, F.col(f"want_{c}") * float(total) / F.col("now")).otherwise(1.0)
            out = out.join(now, c).withColumn("factor", F.col("factor") * scale).drop("now")
        out, error = cut(out), 0.0
        for c in targets:
            now = out.groupBy(f"want_{c}", c).agg(F.sum(F.col("tokens") * F.col("factor")).alias("now")).where(F.col(f"want_{c}") > 0)
            error = max(error, now.agg(F.max(F.abs(F.col("now") / (F.col(f"want_{c}") * float(total)) - 1))).first()[0] or 0.0)
        if error < CONVERGED:
            break
    return out.select(*columns), error


@dataclass(frozen=True)
class Fit:
    """cells: (source, lang, topic, tokens, probability) of every cell of the contingency table, and their number; error: the
    greatest relative error of a marginal's value."""

    cells: DataFrame
    n: int
    error: float


def _fitted(counted: DataFrame, targets: Mapping, rounds: int, fraction: float) -> Fit:
    cells = cut(counted.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")))
    n = cells.count()
    raked, error = (_rake_here if n <= DRIVER_CELLS else _rake_there)(cells, targets, rounds)
    if error > TOLERANCE:
        warnings.warn(f"the mixture's marginals miss their targets by up to {error:.2%} after {rounds} rounds", stacklevel=3)
    most = raked.where("tokens > 0").agg(F.max("factor")).first()[0] or 1.0
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("factor") / most * float(fraction))).otherwise(0.0)
    return Fit(raked.select("source", "lang", "topic", "tokens", p.alias("probability")), n, error)


def fit(docs: DataFrame, targets: Mapping = DEFAULT_TARGETS, rounds: int = ROUNDS, fraction: float = 1.0, ranks_path: str = vocabulary.DEFAULT_RANKS, topic: str | None = None) -> Fit:
    """The probabilities of documents by source, lang and topic.

    The tokens of all documents are counted by the vocabulary. The probability is the raked factor over the greatest
    one: the largest sample that has the target shares with no document taken twice. fraction scales it down. Rounds
    end when the marginals are met; a greater error than TOLERANCE after the last is warned of and is in the result.
    """
    return _fitted(docs.select(*_cells_of(docs, topic), tokens_of(docs["text"], ranks_path).alias("tokens")), targets, rounds, fraction)


def _drawn(rows: DataFrame, fitted: Fit, seed: int) -> DataFrame:
    sampled = rows.withColumn("u", _uniform(F.col("key"), seed))
    return sampled.join(hinted(fitted.cells.drop("tokens"), fitted.n, 160), ["source", "lang", "topic"]).where(F.col("u") < F.col("probability"))


def mixture(docs: DataFrame, targets: Mapping = DEFAULT_TARGETS, rounds: int = ROUNDS, fraction: float = 1.0, seed: int = 0, doc_id: str = "doc_id", ranks_path: str = vocabulary.DEFAULT_RANKS, topic: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability) of the documents drawn.

    Each document is drawn on its own with its cell's probability, by a hash of its id: repeated rows share one
    fate, as do all rows with a null id. A null source or language is the value '∅'. A null or empty text has
    no tokens; where all texts of a cell are so, the cell's probability is 0. Texts of any length count whole. Only the
    columns named are read. An empty table, or one without any token, gives an empty result. Targets of values that
    don't occur are shared out among the others. Tokens are counted once, into a narrow table.
    """
    counted = cut(docs.select(docs[f"`{doc_id}`"].alias("key"), *_cells_of(docs, topic), tokens_of(docs["text"], ranks_path).alias("tokens")))
    out = _drawn(counted, _fitted(counted, targets, rounds, fraction), seed)
    return out.select(F.col("key").alias("doc_id"), "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"))


def sample_mixture(docs: DataFrame, targets: Mapping = DEFAULT_TARGETS, rounds: int = ROUNDS, fraction: float = 1.0, seed: int = 0, doc_id: str = "doc_id", ranks_path: str = vocabulary.DEFAULT_RANKS, topic: str | None = None) -> DataFrame:
    """The rows of docs that mixture() draws, with all their columns as they were, clashing names included; nulls, ties,
    repeats and empty tables as there."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    rows = docs.select(row, docs[f"`{doc_id}`"].alias("key"), *_cells_of(docs, topic))
    return _drawn(rows, fit(docs, targets, rounds, fraction, ranks_path, topic), seed).select("row.*")


def _raw_sql(column: str, wanted: float | Mapping[str, float]) -> str:
    if not isinstance(wanted, Mapping):
        return f"pow(sum(tokens) / (SELECT sum(tokens) FROM c), {wanted}::DOUBLE)"
    named = " ".join(f"WHEN '{v}' THEN {w}::DOUBLE" for v, w in wanted.items() if v != OTHERS)
    return f"CASE {column} {named} ELSE {wanted.get(OTHERS, 0.0)}::DOUBLE END"


def oracle(targets: Mapping = DEFAULT_TARGETS, rounds: int = ROUNDS, seed: int = 0, ranks_path: str = vocabulary.DEFAULT_RANKS) -> str:
    """The same as DuckDB SQL, tokens counted by the merges themselves: one common table expression a step."""
    rules = " ".join(f"WHEN contains(text, '{mark}') THEN '{topic}'" for topic, mark in TOPIC_RULES)
    steps = [
        "o AS MATERIALIZED (SELECT *, row_number() OVER () AS own FROM documents)",
        *tokens_sql.stages("SELECT own AS key, text AS body FROM o", ranks_path),
        f"d AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, CASE {rules} ELSE '{OTHER_TOPIC}' END AS topic, coalesce(len(ids), 0)::BIGINT AS tokens FROM o LEFT JOIN encoded ON key = own)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    steps += [f"t_{c} AS MATERIALIZED (SELECT {c}, raw / sum(raw) OVER () AS want_{c} FROM (SELECT {c}, CASE WHEN sum(tokens) > 0 THEN {_raw_sql(c, wanted)} ELSE 0 END AS raw FROM c GROUP BY {c}))" for c, wanted in targets.items()]
    steps.append("f0 AS MATERIALIZED (SELECT c.*, (SELECT sum(tokens) FROM c) AS total, 1.0::DOUBLE AS factor, " + ", ".join(f"want_{c}" for c in targets) + " FROM c " + " ".join(f"JOIN t_{c} USING ({c})" for c in targets) + ")")
    n = 0
    for _ in range(rounds):
        for c in targets:
            before = f"f{n}" if n == 0 else f"(SELECT * EXCLUDE (now) FROM f{n})"
            steps.append(f"f{n + 1} AS MATERIALIZED (SELECT * REPLACE (factor * CASE WHEN now > 0 THEN want_{c} * total / now ELSE 1 END AS factor) FROM {before} JOIN (SELECT {c}, sum(tokens * factor) AS now FROM f{n} GROUP BY {c}) USING ({c}))")
            n += 1
    uniform = f"((('0x' || substr(md5('mix{seed}:' || coalesce(doc_id::VARCHAR, '{NONE}')), 1, 12))::BIGINT + 0.5::DOUBLE) / {2**48}::DOUBLE)"
    steps.append(f"p AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0::DOUBLE, factor / (SELECT max(factor) FROM f{n} WHERE tokens > 0)) ELSE 0 END AS probability FROM f{n})")
    return "WITH RECURSIVE " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability FROM d JOIN p USING (source, lang, topic) WHERE {uniform} < probability"
