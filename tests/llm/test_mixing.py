import numpy as np
import pytest
from fixtures import ROWS, empty, messy

from lexward.llm import mixing as M
from lexward.llm import vocabulary


KEY = ["source", "lang", "topic"]


def test_raked_marginals():
    rng = np.random.default_rng(0)
    cells = rng.integers(1, 1000, 24).astype(float)
    codes = [np.arange(24) % 4, np.arange(24) // 4 % 3, np.arange(24) // 12]
    targets = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25]), np.array([0.7, 0.3])]
    factor, error = M.rake(cells, codes, targets, 60)
    weight = cells * factor
    for code, target in zip(codes, targets):
        assert np.allclose(np.bincount(code, weight) / weight.sum(), target, atol=1e-6)
    assert error < 1e-9
    assert M.rake(cells, codes, targets, 1)[1] > 1e-6


def test_targets_that_cannot_be_met_are_told(spark):
    """English in one source only, which is to have less than English: no factors give both."""
    docs = spark.createDataFrame([(1, "some words", "en", "a"), (2, "some words", "de", "b")], "doc_id bigint, text string, lang string, source string")
    with pytest.warns(UserWarning, match="miss their targets"):
        fitted = M.fit(docs, {"source": {"a": 0.1, "b": 0.9}, "lang": {"en": 0.9, "de": 0.1}, "topic": 1.0})
    assert fitted.error > 0.5


def test_cluster_and_driver_agree(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    here = M.fit(docs, rounds=4)
    monkeypatch.setattr(M, "DRIVER_CELLS", 0)
    there = M.fit(docs, rounds=4)
    a, b = (f.cells.toPandas().sort_values(KEY, ignore_index=True) for f in (here, there))
    assert here.n == there.n == len(a) and a[KEY].equals(b[KEY]) and np.allclose(a["probability"], b["probability"], atol=1e-12)
    assert np.isclose(here.error, there.error, rtol=1e-6)


def wanted(c, real):
    """Target shares written out anew."""
    want, seen = M.DEFAULT_TARGETS[c], real.groupby(c).sum() / real.sum()
    raw = seen**want if isinstance(want, float) else seen.index.to_series().map(lambda v: want.get(v, want["*"]))
    return raw / raw.sum()


def test_sample_has_the_targets(spark, small):
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.1')}/documents.parquet")
    got = M.mixture(docs).toPandas()
    table = docs.select("doc_id", "source", "lang", M.topic_of(docs["text"]).alias("topic"), M.tokens_of(docs["text"]).alias("tokens")).toPandas()
    for c in KEY:
        share = got.groupby(c)["tokens"].sum() / got["tokens"].sum()
        assert (share - wanted(c, table.set_index(KEY)["tokens"])).abs().max() < 0.05


def test_tokens_are_the_encoder_s(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    fitted = M.fit(docs)
    cells = fitted.cells.toPandas()
    table = docs.select("doc_id", "source", "lang", M.topic_of(docs["text"]).alias("topic"), "text").toPandas()
    table["real"] = [len(vocabulary.encoding(vocabulary.DEFAULT_RANKS).encode_ordinary(t)) for t in table["text"]]
    real = table.groupby(KEY)["real"].sum()
    assert cells.set_index(KEY)["tokens"].to_dict() == real.to_dict()
    weight = cells["tokens"] * cells["probability"]
    for c in KEY:
        share = weight.groupby(cells[c]).sum() / weight.sum()
        assert (share - wanted(c, real)).abs().max() < 1e-6 + fitted.error
    got = {r["doc_id"]: r["tokens"] for r in M.mixture(docs).collect()}
    assert got and got == {i: n for i, n in zip(table["doc_id"], table["real"]) if i in got}
    assert {r["doc_id"] for r in M.sample_mixture(docs).collect()} == set(got)


def test_given_weights(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    langs = [r["lang"] for r in docs.select("lang").distinct().collect()]
    got = M.fit(docs, {"source": 1.0, "lang": {langs[0]: 1.0, "none such": 5.0}, "topic": 1.0}).cells.toPandas()
    assert (got.loc[got["lang"] != langs[0], "probability"] == 0).all()
    with pytest.raises(ValueError):
        M.fit(docs, {"source": 1.0, "lang": {"none such": 1.0}, "topic": 1.0})


def test_topics_of_a_column(spark):
    docs = spark.createDataFrame([(i, f"words {i}", "en", "a", "x" if i % 4 else "y") for i in range(40)], "doc_id bigint, text string, lang string, source string, about string")
    targets = {"source": 1.0, "lang": 1.0, "topic": {"x": 0.5, "y": 0.5}}
    cells = M.fit(docs, targets, topic="about").cells.toPandas().set_index("topic")
    assert np.isclose(*(cells["tokens"] * cells["probability"]))
    assert {r["topic"] for r in M.mixture(docs, targets, topic="about").collect()} == {"x", "y"}


def test_messy(spark):
    docs = messy(spark)
    got = M.mixture(docs).collect()
    ids = [r["doc_id"] for r in got]
    assert set(ids) <= {r[0] for r in ROWS}
    assert ids.count(2) in (0, 2)  # repeated rows share one fate
    assert not {3, 5} - set(ids) or all(r["probability"] > 0 for r in got)
    kept = M.sample_mixture(docs)
    assert kept.columns == docs.columns and kept.count() == len(got)
    assert {r["source"] for r in got} <= {"web", "books", M.NONE}
    assert M.mixture(empty(spark)).collect() == [] and M.sample_mixture(empty(spark)).collect() == []


@pytest.mark.parametrize("cells", [M.DRIVER_CELLS, 0])
def test_only_empty_texts(spark, monkeypatch, cells):
    monkeypatch.setattr(M, "DRIVER_CELLS", cells)
    assert M.mixture(messy(spark, [(1, "", "en", "web"), (2, None, "en", "web")])).collect() == []


def test_fraction(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert M.mixture(docs, fraction=0.3).count() < M.mixture(docs).count()
