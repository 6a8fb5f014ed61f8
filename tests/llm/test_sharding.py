import hashlib
import math
from collections import Counter

import pytest
from fixtures import ROWS, empty, messy

from lexward.llm import sharding as S


def draw(key, path, weight):
    u = (int(hashlib.md5(f"{key}/{path}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    return -math.log(u) / weight


def brute(key, tree):
    key, path, node = "null:" if key is None else f"key:{key}", [], tree
    while isinstance(node, dict):
        options = [(draw(key, "/".join([*path, n]), S._weight(c)), i, n) for i, (n, c) in enumerate(node.items()) if S._weight(c) > 0]
        name = min(options)[2]
        path, node = [*path, name], node[name]
    return tuple(path)


def placed(spark, tree, n=3000):
    return {r[0]: tuple(r)[1:] for r in S.assign_shards(spark.range(n).withColumnRenamed("id", "doc_id"), tree=tree).collect()}


def test_equals_brute_force(spark):
    assert placed(spark, S.DEFAULT_TREE, 500) == {i: brute(i, S.DEFAULT_TREE) for i in range(500)}


def test_shares_follow_the_weights(spark):
    got = Counter(p[2] for p in placed(spark, S.DEFAULT_TREE, 20_000).values())
    leaves = S.paths(S.DEFAULT_TREE)
    total = sum(w for *_, w in leaves)
    for *_, shard, weight in leaves:
        assert abs(got[shard] / 20_000 - weight / total) < 0.012


def test_movement_stays_in_changed_subtrees(spark):
    tree = {r: {k: dict(s) for k, s in racks.items()} for r, racks in S.DEFAULT_TREE.items()}
    tree["east"]["e1"]["e1a"], tree["east"]["e1"]["e1b"] = 6, 2  # the rack's weight stays
    before, after = placed(spark, S.DEFAULT_TREE), placed(spark, tree)
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved and all(a[:2] == b[:2] == ("east", "e1") for a, b in moved)
    tree["west"]["w3"]["w3a"] = 0.5  # now a region's weight falls: keys leave it, none come between the others
    third = placed(spark, tree)
    assert all(after[i][0] == "west" for i in after if after[i] != third[i])


def test_messy(spark):
    got = S.assign_shards(messy(spark)).collect()
    assert len(got) == len(ROWS) and {tuple(r)[1:] for r in got if r[0] is None} == {brute(None, S.DEFAULT_TREE)}
    assert S.assign_shards(empty(spark)).collect() == []
    assert {tuple(r)[1:] for r in S.assign_shards(messy(spark), tree={"a": {"b": {"c": 1, "d": 0}}, "e": {"f": {"g": 0}}}).collect()} == {("a", "b", "c")}
    with pytest.raises(ValueError):
        S.assign_shards(messy(spark), tree={"a": {"b": {"c": 0}}})


def test_thousands_of_shards(spark):
    """The tree is data, not code: three thousand shards are placed by the same few expressions."""
    tree = {f"r{r}": {f"k{k}": {f"s{r}-{k}-{s}": 1 + (r + k + s) % 3 for s in range(30)} for k in range(10)} for r in range(10)}
    got = placed(spark, tree, 200)
    assert got == {i: brute(i, tree) for i in range(200)}


def test_one_pass(spark):
    assert "Exchange" not in S.assign_shards(messy(spark))._jdf.queryExecution().executedPlan().toString()
