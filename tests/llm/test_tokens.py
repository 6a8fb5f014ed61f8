"""Token counts and byte-pair encoding against the merges themselves."""

import numpy as np
import pyarrow as pa
import pytest
from fixtures import ROWS, empty, messy
from hypothesis import given, settings
from hypothesis import strategies as st

from lexward.llm import bpe, token_counts, vocabulary

OTHER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
ODD = ["", " ", "  a", "a  b", "\n\n  x", "don't we'll", "x" * 300, "ab" * 500, " ".join(["a"] * 50), "<|endoftext|>", "²³ ½ x1²", "\x1c \x1fa", "a  b", "　 x", "数字١٢٣", "\U0001f600\U0001f468‍\U0001f469", "\x85 a", "É é ß ſ", "1234567 89"]


def exact(text, path=vocabulary.DEFAULT_RANKS):
    return vocabulary.encoding(path).encode_ordinary(text)


def test_automaton_lists_every_token_at_its_place():
    coder = bpe.encoder(vocabulary.DEFAULT_RANKS)
    word = " international größe aaaa".encode()
    start, token = coder._matches(np.frombuffer(word, np.uint8), np.arange(len(word), 0, -1, dtype=np.int32))
    want = sorted((b, coder.ids[word[b:e]]) for e in range(1, len(word) + 1) for b in range(e) if word[b:e] in coder.ids)
    assert sorted(zip(start.tolist(), token.tolist())) == want


@pytest.mark.parametrize("path", [vocabulary.DEFAULT_RANKS, OTHER])
def test_halves_are_those_of_the_merges(path):
    coder = bpe.encoder(path)

    def merged(word, below):
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: (coder.ids.get(parts[i] + parts[i + 1], below), i))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [coder.ids[p] for p in parts]

    for token, i in list(coder.ids.items())[::37]:
        if len(token) > 1:
            assert [coder.left[i], coder.right[i]] == merged(token, i)


@pytest.mark.parametrize("path", [vocabulary.DEFAULT_RANKS, OTHER])
@pytest.mark.parametrize("text", ODD)
def test_ids_are_exact(text, path):
    coder = bpe.encoder(path)
    ids = coder.encode(text)
    assert ids == exact(text, path)
    assert coder.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from("ab \n\tés'l1²_- \x1c"), max_size=80))
def test_ids_of_any_text(text):
    coder = bpe.encoder()
    assert coder.encode(text) == exact(text)
    assert coder.decode_bytes(coder.encode(text)) == text.encode()


def test_memory_may_run_out(monkeypatch):
    monkeypatch.setattr(bpe, "PAIR_SLOTS", 16)
    monkeypatch.setattr(bpe, "STEP_BYTES", 20)
    monkeypatch.setattr(bpe, "LONG_WORD", 6)
    coder = bpe.Encoder(vocabulary.DEFAULT_RANKS)
    for text in ["some words that differ greatly", "others, unseeable qwzxkj vbnmzzq", "some words again", "an unbrokenchainofletterswithoutend " * 3, " " * 100, "ab" * 200]:
        assert coder.encode(text) == exact(text)


def test_slices_of_texts_are_put_together(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 30)
    texts = ["one, two", "", "two  two\n x", "größe größe one" * 5, "", "don't (stop) 12 1² one,two _a", None, "end."]
    ids, same = bpe._encode_array(pa.array(texts), vocabulary.DEFAULT_RANKS, check=True)
    assert ids.to_pylist() == [exact(t or "") for t in texts] and same.all()


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "\t " * 1_000_000 + "x", "ab" * 300_000, "é" * 100_000 + " " * 70_000 + "a b"], ids=["spaces", "feeds", "mixed", "unbroken", "both"])
def test_endless_runs(text):
    coder = bpe.encoder()
    ids = coder.encode(text)
    assert coder.decode(ids) == text
    assert token_counts.lengths(pa.array([text], pa.string())).tolist() == [len(ids)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8), st.integers(1, 50))
def test_lengths_of_any_texts(texts, batch):
    got = token_counts.lengths(pa.array(texts, pa.string()), batch_bytes=batch)
    assert got.tolist() == [len(exact(t)) for t in texts]


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    monkeypatch.setattr(token_counts, "LONG_CHARS", 10)
    texts = ["a b  c don't  stop\n now " * 30, "x" * 200, "  " * 50, "é ü ß " * 40]
    assert token_counts.lengths(pa.array(texts, pa.string())).tolist() == [len(exact(t)) for t in texts]
    for t in texts:
        points = token_counts.cut_points(t, 10)
        assert points[0] == 0 and sum((exact(t[a:b]) for a, b in zip(points, [*points[1:], len(t)])), []) == exact(t)


def test_counts_of_messy_documents(spark):
    got = sorted(map(tuple, token_counts.token_counts(messy(spark)).collect()), key=repr)
    assert got == sorted(((i, None if t is None else len(exact(t))) for i, t, *_ in ROWS), key=repr)
    assert token_counts.token_counts(empty(spark)).collect() == []


def test_ids_of_messy_documents(spark):
    got = sorted(((r["doc_id"], r["token_ids"], r["n_tokens"], r["round_trip"]) for r in bpe.bpe_encode(messy(spark)).collect()), key=repr)
    assert got == sorted(((i, *((None, None, None) if t is None else (exact(t), len(exact(t)), True))) for i, t, *_ in ROWS), key=repr)
    assert bpe.bpe_encode(empty(spark)).collect() == []
    rows = bpe.with_token_ids(messy(spark)).withColumn("back", bpe.decode_column("token_ids")).collect()
    assert all(r["back"] == r["text"] for r in rows)


def test_decoding_refuses_unknown_ids(spark):
    df = spark.createDataFrame([([5, 10**6],), ([None],), (None,), ([],), ([-1],)], "ids array<int>").select(bpe.decode_column("ids").alias("t"))
    assert [r["t"] for r in df.collect()] == [None, None, None, "", None]


def test_one_pass(spark):
    for df in (token_counts.token_counts(messy(spark)), bpe.bpe_encode(messy(spark))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
