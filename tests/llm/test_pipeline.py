"""The queries of the corpus operators, and the pipeline against a plain version of its stages."""

import duckdb
import pyarrow as pa
import pytest
from test_near_dedup import brute as near
from test_queries import TABLES, rows

import corpus_pipeline as P
from lexward.llm import mixing, quality, queries, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, spark, small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, small).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())


def test_ten_queries_and_the_pipeline():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    import __spark_entry__ as e

    assert {"pipeline", *queries.queries()} <= set(e.queries())
    assert [n for n, _ in P.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "bpe encoding"]


def test_pipeline_equals_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    model = quality.fit(spark.createDataFrame(docs), spark.read.parquet(f"{small}/labels.parquet"))
    kept = docs[model.probabilities(pa.array(docs["text"])) >= quality.THRESHOLD]
    kept = kept.sort_values("doc_id").drop_duplicates("text")
    gone = {i for i, _ in near(kept["doc_id"].tolist(), kept["text"].tolist())}
    kept = kept[~kept["doc_id"].isin(gone)]
    con = duckdb.connect()
    con.register("documents", kept)
    drawn = set(con.execute(mixing.oracle()).df()["doc_id"])
    encode = vocabulary.encoding(vocabulary.DEFAULT_RANKS).encode_ordinary
    want = {r.doc_id: (r.text, encode(r.text)) for r in kept.itertuples() if r.doc_id in drawn}
    out = P.run(spark, small)
    assert out.columns == [*COLUMNS, "token_ids"]
    got = {r["doc_id"]: (r["text"], list(r["token_ids"])) for r in out.collect()}
    assert got == want and 0 < len(got) < len(docs)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, small).dtypes == docs.dtypes


def test_stages_bear_nulls_and_no_rows(spark, small):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (2, None, "en", "web", None), (1, "", None, None, 0)], docs.schema)
    for _, stage in P.STAGES:
        assert stage(spark, odd, small).count() <= 4
        assert stage(spark, odd.limit(0), small).count() == 0
        assert stage(spark, odd.withColumn("row", F.lit(1)), small).columns[:6] == [*COLUMNS, "row"]


def test_stages_bear_long_texts_and_clashing_names(spark, small):
    from fixtures import ROWS, messy

    docs = messy(spark, [*ROWS, (11, "word " * 200_000, "en", "web"), (12, " " * 300_000, "en", "web")])
    for name, stage in P.STAGES:
        out = stage(spark, docs, small)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        texts = {r["text"] for r in out.select("text").collect()}
        assert texts <= {r["text"] for r in docs.select("text").collect()}, name


def test_tables_between_stages_go(spark, small):
    from pathlib import Path

    def tables():
        return len(list(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("table-*")))

    before = tables()
    P.run(spark, small).count()
    assert tables() == before + 1  # that of the last stage's input


def test_near_dedup_stage_compares_long_lists_by_bits(spark, monkeypatch):
    """Documents of few words have uneven bytes and meet in long runs, as those of a large table do; only pairs that are near
    in the part over word pairs are verified, and no other document goes."""
    import random

    import numpy as np
    from fixtures import messy

    from lexward.llm import near_dedup as N
    from lexward.llm import simhash

    rng = random.Random(12)
    words = ["the", "of", "and", "to", "in", *("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))]
    texts = [" ".join(rng.choices(words, k=rng.randint(40, 80))) for _ in range(700)]
    array = simhash.fingerprints(pa.array(texts))
    prints = np.stack([array.field(i).to_numpy() for i in range(5)], 1).view(np.uint64)
    verified, similar = [], N._similar
    monkeypatch.setattr(N, "_similar", lambda w, a, b: verified.append(simhash.distances(w[a, 3:], w[b, 3:])) or similar(w, a, b))
    octets = prints[:, :3].copy().view(np.uint8).reshape(len(prints), 24)
    for value in np.unique(octets[:, 0]):
        N.list_forest(prints[octets[:, 0] == value], N.list_positions((0,)))
    assert all((d <= N.MAX_PAIR_BITS).all() for d in verified)
    docs = messy(spark, [(i, t, "en", "web") for i, t in enumerate(texts)])
    kept = {r["doc_id"] for r in P.near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in near(list(range(len(texts))), texts)}
