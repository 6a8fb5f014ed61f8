"""Token counts of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexward.llm import bpe, tokens_sql, vocabulary
from lexward.llm.common import byte_slices, joined, plain

#: Bytes of text that are split and encoded together.
BATCH_BYTES = 4 << 20

#: A text of more characters is cut at safe boundaries first, so that one text never makes a larger batch.
LONG_CHARS = 1 << 18

#: White space as the vocabulary's pattern has it, for Python's engine and for RE2.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RE2_SPACE = r"[\s\x0b\x{85}\p{Z}]"

#: A run of so much white space is more than the encoder's engine can backtrack over: it is encoded apart.
_RUN = re.compile(f"[{_SPACE}]{{4096,}}")


def cut_points(text: str, size: int) -> list[int]:
    """Offsets that cut text into pieces of at least size characters, at safe boundaries only.

    A space after a character that isn't white space always starts a new pre-token, so the tokens of the
    pieces are the tokens of the whole. A stretch without such a space stays whole.
    """
    points, at = [0], size
    while (at := text.find(" ", at)) > 0:
        if not text[at - 1].isspace():
            points.append(at)
            at += size
        else:
            at += 1
    return points


def _without_runs(text: str) -> Iterator[tuple[str, bool]]:
    """The text cut around its endless runs of white space, and whether each piece is one.

    A run is a pre-token of its own up to its last character, which goes with what follows, so the cuts are exact.
    """
    at = 0
    for m in _RUN.finditer(text):
        start, end = m.start(), m.end() - (m.end() < len(text))
        if start > at:
            yield text[at:start], False
        yield text[start:end], True
        at = end
    if at < len(text):
        yield text[at:], False


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    for piece, run in _without_runs(text):
        if run or len(piece) <= LONG_CHARS:
            yield piece, run
        else:
            points = cut_points(piece, LONG_CHARS)
            yield from ((piece[a:b], False) for a, b in zip(points, [*points[1:], len(piece)]))


def _batch_lengths(texts: pa.Array, ranks_path: str) -> np.ndarray:
    """Tokens of the texts of a batch, in none of which a space follows white space.

    A pre-token begins at every space, so the batch's distinct space-led parts are encoded in one call, as one text;
    the bytes of its tokens tell where each part ends. What stands before a text's first space is encoded by itself.
    """
    encoder = vocabulary.encoding(ranks_path)
    split = pc.split_pattern(texts, " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = split.flatten().dictionary_encode()
    heads = np.array([len(x) for x in encoder.encode_ordinary_batch(coded.dictionary.take(coded.indices.take(pa.array(offsets[:-1]))).to_pylist(), num_threads=1)], np.int64)
    ids = encoder.encode_to_numpy(" " + joined(coded.dictionary, " ")) if len(coded.dictionary) else np.zeros(0, np.uint32)
    token_ends = np.cumsum(vocabulary.token_sizes(ranks_path)[ids])
    part_ends = np.cumsum(pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    own = np.diff(np.searchsorted(token_ends, part_ends, side="right"), prepend=0)[coded.indices.to_numpy()]
    own[offsets[:-1]] = heads
    return np.add.reduceat(own, offsets[:-1]) if len(texts) else np.zeros(0, np.int64)


def _lengths(texts: pa.Array, ranks_path: str, batch_bytes: int) -> np.ndarray:
    encode = vocabulary.encoding(ranks_path).encode_to_numpy
    unsafe = pc.match_substring_regex(texts, f"{_RE2_SPACE} ").to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), np.int64)
    for start, stop in byte_slices(texts, batch_bytes):
        part, odd = texts[start:stop], unsafe[start:stop]
        at = start + np.flatnonzero(~odd)
        out[at] = _batch_lengths(part.filter(pa.array(~odd)), ranks_path)
        for i in (start + np.flatnonzero(odd)).tolist():
            out[i] = len(encode(texts[i].as_py()))
    return out


def lengths(texts: pa.Array, ranks_path: str = vocabulary.DEFAULT_RANKS, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """Exact numbers of tokens of texts without nulls."""
    texts = texts.cast(pa.large_string())
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    doubtful = pc.match_substring_regex(texts, _RE2_SPACE * 2).to_numpy(zero_copy_only=False) & (sizes > 4000)
    apart = np.flatnonzero(doubtful | (sizes > LONG_CHARS)).tolist()
    out = np.zeros(len(texts), np.int64)
    usual = np.ones(len(texts), bool)
    usual[apart] = False
    out[usual] = _lengths(texts.filter(pa.array(usual)) if apart else texts, ranks_path, batch_bytes)
    for i in apart:  # one at a time: they may be very long
        pieces = list(_pieces(texts[i].as_py()))
        runs = [p for p, run in pieces if run]
        out[i] = _lengths(pa.array([p for p, run in pieces if not run], pa.large_string()), ranks_path, batch_bytes).sum()
        out[i] += len(bpe.encoder(ranks_path).wholes(runs)[0]) if runs else 0
    return out


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str = vocabulary.DEFAULT_RANKS) -> DataFrame:
    """(doc_id, n_tokens) of every row, in one pass without a shuffle; only lengths leave the Arrow function.

    A null text has null tokens, an empty one 0. Texts of any length count whole. Repeated rows and null ids
    stay as they are; an empty table gives no rows. Only the two columns named are read.
    """

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(lengths(plain(texts), ranks_path), pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))

    column = docs[f"`{text}`"]
    return docs.select(docs[f"`{doc_id}`"].alias("doc_id"), F.when(column.isNotNull(), count(column)).alias("n_tokens"))


def oracle(ranks_path: str = vocabulary.DEFAULT_RANKS) -> str:
    """The same as DuckDB SQL."""
    steps = ["o AS MATERIALIZED (SELECT *, row_number() OVER () AS own FROM documents)", *tokens_sql.stages("SELECT own AS key, text AS body FROM o", ranks_path)]
    return "WITH RECURSIVE " + ",\n".join(steps) + "\nSELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(len(ids), 0) END::BIGINT AS n_tokens FROM o LEFT JOIN encoded ON key = own"
