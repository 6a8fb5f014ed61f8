import numpy as np
import pyarrow as pa
import pytest
from fixtures import ROWS, empty, messy

from lexward.llm import quality, subwords


@pytest.fixture(scope="module")
def labelled(spark, small):
    folder = small.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


@pytest.fixture(scope="module")
def model(labelled):
    return quality.fit(*labelled)


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    table = docs.join(labels, "doc_id").select("doc_id", "text", "quality").orderBy("doc_id").toPandas()
    test = np.arange(len(table)) % 4 == 0
    fitted = subwords.train(pa.array(table["text"][~test]), table["quality"][~test].to_numpy())
    said = fitted.probabilities(pa.array(table["text"][test])) >= quality.THRESHOLD
    good = table["quality"][test].to_numpy() > 0
    assert (said == good).mean() >= 0.95
    assert said[good].mean() >= 0.97  # clean documents stay


def test_fit_is_repeatable(labelled, model):
    again = quality.fit(*labelled)
    assert (again.scores == model.scores).all() and again.bias == model.bias


def test_batches_change_nothing(model, monkeypatch):
    texts = pa.array([t for _, t, *_ in ROWS if t is not None])
    whole = model.probabilities(texts)
    monkeypatch.setattr(subwords, "_SLICE", 10)
    assert np.allclose(model.probabilities(texts), whole)


def test_probability_equals_the_vectors_average():
    """What scores gathered bucket by bucket come to is the softmax of the averaged vectors."""
    texts = pa.array(["good words here", "bad bad stuff", "good things", "bad junk"])
    fitted = subwords.train(texts, np.array([1, 0, 1, 0]), epochs=30)
    margins = [(fitted.scores[b] * c).sum() / c.sum() + fitted.bias for b, c in subwords.bags(texts)]
    assert np.allclose(fitted.probabilities(texts), 1 / (1 + np.exp(-np.array(margins))), atol=1e-5)
    assert (fitted.probabilities(texts) > 0.5).tolist() == [True, False, True, False]


def plain_margin(fitted, text):
    """Features counted one by one, with the hash written anew."""
    m32 = (1 << 32) - 1

    def mixed(x, seed):
        x = (x ^ (seed * 0x9E3779B1 & m32)) * 0x7FEB352D & m32
        x ^= x >> 15
        x = x * 0x846CA68B & m32
        return x ^ x >> 16

    def bucket(x):
        return x % (subwords.BUCKETS - 2) + 2

    words, found = text.split(), []
    for at, word in enumerate(words):
        marked = [ord(c) for c in f"<{word}>"]
        for n in subwords.NGRAMS:
            for i in range(len(marked) - n + 1):
                rolled = marked[i]
                for c in marked[i + 1 : i + n]:
                    rolled = (rolled * 0x01000193 + c) & m32
                found.append(bucket(mixed(rolled, n)))
        total = sum(mixed(c ^ (i * 0x85EBCA6B & m32), 1) for i, c in enumerate([*marked, 10])) & m32
        found.append(bucket(mixed(total, 2)))
        if at:
            found.append(int(word == words[at - 1]))
    return np.mean([fitted.scores[b] for b in found]) if found else 0.0


def test_probabilities_equal_a_plain_version(model):
    texts = ["", "one", "the the the the", "größe  and\nmore, more 数字 \U0001f600", "a b a b a b " * 40, *[t for _, t, *_ in ROWS[:2]]]
    want = [1 / (1 + np.exp(-(plain_margin(model, t) + model.bias))) for t in texts]
    assert np.allclose(model.probabilities(pa.array(texts)), want, atol=1e-5)


def test_gradient_equals_a_plain_version():
    """One epoch of the trainer against the formulas written out, over dense vectors."""
    texts, classes = pa.array(["good words here", "bad bad stuff", "good things"]), np.array([1, 0, 1])
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / 4, 1 / 4, (subwords.BUCKETS, 4)).astype(np.float32)
    output, bias = np.zeros((2, 4)), np.zeros(2)
    dense = []
    for b, c in subwords.bags(texts):
        share = np.zeros(subwords.BUCKETS)
        share[b] = c / c.sum()
        dense.append(share)
    for step, i in enumerate(rng.permutation(3)):
        hidden = dense[i] @ vectors
        e = np.exp(output @ hidden + bias)
        error = e / e.sum() - np.eye(2)[classes[i]]
        rate = 0.3 * 3 / (2 * np.bincount(classes)[classes[i]]) * (1 - step / 3)
        grown = vectors - rate * np.sqrt(dense[i])[:, None] * (error @ output)
        output, bias, vectors = output - rate * np.outer(error, hidden), bias - rate * error, grown
    fitted = subwords.train(texts, classes, dim=4, epochs=1)
    assert np.allclose(fitted.scores, vectors @ (output[1] - output[0]), atol=1e-6)
    assert np.isclose(fitted.bias, bias[1] - bias[0])


def test_texts_beyond_the_bound_are_left_out(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    assert quality.training_rows(docs, labels, limit_bytes=750).count() == 7
    assert quality.training_rows(docs, labels, limit=5).count() == 5


def test_messy(spark, model):
    rows = quality.classify(messy(spark), model).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r["doc_id"] for r in rows if r["p_good"] is None), key=repr) == [5, 6]
    assert all(r["quality"] == int(r["p_good"] is not None and r["p_good"] >= 0.5) for r in rows)
    alike = {r["p_good"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(alike) == 1
    kept = quality.keep_good(messy(spark), model)
    assert kept.columns == messy(spark).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r["doc_id"] for r in rows if r["quality"]), key=repr)
    assert quality.classify(empty(spark), model).collect() == []


def test_labels_of_one_class_or_none(spark):
    docs = messy(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.fit(docs, none).probabilities(pa.array(["x"]))[0] > 0.5
    bad = spark.createDataFrame([(1, 0, 0), (None, 1, 0), (9, None, 0), (1, 1, 0)], none.schema)
    assert quality.fit(docs, bad).probabilities(pa.array(["x"]))[0] < 0.5
    assert quality.training_rows(docs, bad).count() == 1
