from collections import defaultdict

import numpy as np
import pytest
from fixtures import ROWS, empty, messy
from hypothesis import given, settings
from hypothesis import strategies as st

from lexward.llm import exact_dedup as X
from lexward.llm import golomb


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**48 - 1), max_size=200))
def test_golomb_round_trip(values):
    a = np.sort(np.array(values, np.int64))
    assert (golomb.decode(golomb.encode(a)) == a).all()


def test_golomb_is_small():
    a = np.sort(np.random.default_rng(1).integers(0, 2**48, 20_000))
    assert len(golomb.encode(a)) < 0.75 * 8 * len(a)


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        if text is not None:
            groups[text].append(i)
    out = []
    for ids in groups.values():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0]) for i in ids[1:]]
    return sorted(out, key=repr)


def test_messy(spark):
    got = sorted(map(tuple, X.exact_duplicates(messy(spark)).collect()), key=repr)
    assert got == brute(ROWS)
    kept = X.drop_exact_duplicates(messy(spark))
    assert kept.columns == messy(spark).columns
    rows = kept.select("doc_id", "text").collect()
    assert len([r for r in rows if r["text"] is None]) == 2
    texts = [r["text"] for r in rows if r["text"] is not None]
    assert len(texts) == len(set(texts)) == len({r[1] for r in ROWS if r[1] is not None})
    assert {r["doc_id"] for r in rows} == {1, 3, 5, 6, 7, 9, 10, None}


def test_empty(spark):
    assert X.exact_duplicates(empty(spark)).collect() == []
    assert X.drop_exact_duplicates(empty(spark)).collect() == []


def test_fingerprints_may_collide(spark, monkeypatch):
    monkeypatch.setattr(X, "FINGERPRINT_BITS", 3)
    rows = [(i, f"text {i % 40}", "en", "web") for i in range(60)]
    assert sorted(map(tuple, X.exact_duplicates(messy(spark, rows)).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("partitions", [1, 7])
def test_many_copies_over_partitions(spark, partitions):
    rows = [(i, "same" if i % 2 else f"own {i}", "en", "web") for i in range(400)]
    got = X.exact_duplicates(messy(spark, rows).repartition(partitions))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_digests_may_collide(spark, monkeypatch):
    """Bytes decide, not the digest that stands for them."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(X, "FINGERPRINT_BITS", 3)
    monkeypatch.setattr(X, "_digest", lambda text: F.pmod(F.xxhash64(text), F.lit(3)).cast("string").cast("binary"))
    rows = [(i, f"text {i % 40}", "en", "web") for i in range(60)] + [(None, "text 1", "en", "web")]
    assert sorted(map(tuple, X.exact_duplicates(messy(spark, rows)).collect()), key=repr) == brute(rows)


def test_rows_repeated_very_often(spark):
    rows = [(7, "again", "en", "web")] * 2503 + [(None, "none", "en", "web")] * 1002 + [(9, "again", "en", "web")]
    got = sorted(map(tuple, X.exact_duplicates(messy(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_owners_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "OWNED", 10)
    rows = [(i, f"text {i % 70}", "en", "web") for i in range(140)]
    assert sorted(map(tuple, X.exact_duplicates(messy(spark, rows)).collect()), key=repr) == brute(rows)


def test_ties_fall_by_any_column(spark):
    """Of rows that differ in an array, a struct or a map only the least stays, whatever the order of rows."""
    from pyspark.sql import functions as F

    rows = spark.range(6).select(
        F.lit(1).cast("bigint").alias("doc_id"), F.lit("t").alias("text"), F.array(F.col("id") % 2).alias("a"), F.struct((F.col("id") % 3).alias("x")).alias("s"), F.create_map(F.lit("k"), F.col("id")).alias("m")
    )
    for order in ("id", "-id"):
        (kept,) = X.drop_exact_duplicates(rows.orderBy(F.expr(order.replace("id", "m['k']"))).repartition(3)).collect()
        assert (kept["a"], kept["s"]["x"], kept["m"]) == ([0], 0, {"k": 0})
