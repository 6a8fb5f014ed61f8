"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tree = Mapping[str, Mapping[str, Mapping[str, float]]]

#: Regions, racks and shards with their weights (capacities).
DEFAULT_TREE: Tree = {
    "east": {"e1": {"e1a": 4, "e1b": 4, "e1c": 2}, "e2": {"e2a": 3, "e2b": 3}, "e3": {"e3a": 6}},
    "north": {"n1": {"n1a": 2, "n1b": 2}, "n2": {"n2a": 4, "n2b": 1, "n2c": 1}},
    "west": {"w1": {"w1a": 5, "w1b": 5}, "w2": {"w2a": 2.5, "w2b": 2.5}, "w3": {"w3a": 1, "w3b": 1}},
}

LEVELS = ("region", "rack", "shard")

#: Draws are uniform multiples of 2**-48.
DRAW_BITS = 48


def _weight(node) -> float:
    return float(sum(map(_weight, node.values()))) if isinstance(node, Mapping) else float(node)


def paths(tree: Tree) -> list[tuple[str, str, str, float]]:
    """The leaves (region, rack, shard, weight) with a positive weight."""
    return [(r, k, s, float(w)) for r, racks in tree.items() for k, shards in racks.items() for s, w in shards.items() if w > 0]


def _nodes(tree: Tree) -> Column:
    """The tree as an array, level by level from the root: of each inner node the children with a positive weight as
    struct(name, path, weight, node), node being the child's place in the array, -1 for a shard."""
    nodes: list[list[dict]] = [[]]
    waiting: list[tuple[int, str, Mapping]] = [(0, "", tree)]
    for at, path, node in waiting:
        for name, child in node.items():
            if _weight(child) > 0:
                inner = isinstance(child, Mapping)
                nodes[at].append({"name": name, "path": f"{path}/{name}", "weight": _weight(child), "node": len(nodes) if inner else -1})
                if inner:
                    waiting.append((len(nodes), f"{path}/{name}", child))
                    nodes.append([])
    # JSON, which is folded to one literal when the query is planned.
    return F.from_json(F.lit(json.dumps(nodes)), "array<array<struct<name:string,path:string,weight:double,node:int>>>")


def _pick(key: Column, children: Column) -> Column:
    """The child that wins: each makes an exponential draw with its weight as rate, and the least falls on each in
    proportion to its weight. An only child wins without drawing."""

    def draw(child: Column, i: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, child["path"]).cast("binary")), 1, DRAW_BITS // 4)
        uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**DRAW_BITS)
        return F.struct((-F.log(uniform) / child["weight"]).alias("d"), i.alias("i"))

    return F.when(F.size(children) == 1, F.get(children, F.lit(0))).otherwise(F.get(children, F.array_min(F.transform(children, draw))["i"]))


def assign_shards(df: DataFrame, key: str = "doc_id", tree: Tree = DEFAULT_TREE) -> DataFrame:
    """(key, region, rack, shard) of every row of df, in one pass without a shuffle.

    At each level every child makes a hashed exponential draw with its subtree's weight as rate, and the
    least wins. A draw depends on the key and the child's path only, so a changed weight moves keys only
    into or out of the subtrees whose weights changed. The tree is a driver-side literal.

    A null key is placed as the key 'null:' of its own (all such rows together). Repeated keys go to the
    same shard. Equal draws go to the child named first. An empty table gives an empty result. Children
    of weight 0 get nothing; a tree without a positive weight is refused. Other columns are left out, so
    their names can't clash.
    """
    if not paths(tree):
        raise ValueError("the tree has no positive weight")
    column = df[f"`{key}`"]
    text = F.coalesce(F.concat(F.lit("key:"), column.cast("string")), F.lit("null:"))
    out, at, nodes = df.select(column.alias("key"), text.alias("text")), F.lit(0), _nodes(tree)
    # A projection a level: only the chosen node's children draw. The tree is one literal, so its size isn't the code's.
    for level in LEVELS:
        out = out.withColumn(level, _pick(F.col("text"), F.get(nodes, at)))
        at = F.col(level)["node"]
    return out.select(F.col("key").alias(key), *[F.col(level)["name"].alias(level) for level in LEVELS])


def oracle(tree: Tree = DEFAULT_TREE, table: str = "documents", key: str = "doc_id") -> str:
    """The same as DuckDB SQL: all draws are made and the least of each level is kept."""
    top = [(r, _weight(k)) for r, k in tree.items()]
    mid = [(r, k, _weight(s)) for r, racks in tree.items() for k, s in racks.items()]
    low = paths(tree)
    draw = f"(-ln((('0x' || substr(md5(t.k || '/' || {{path}}), 1, {DRAW_BITS // 4}))::BIGINT + 0.5::DOUBLE) / {2**DRAW_BITS}::DOUBLE) / w)"

    def level(rows, names, prior, ons):
        values = ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + f", {i})" for i, r in enumerate(rows) if r[-1] > 0)
        path = " || '/' || ".join(f"v.{n}" for n in names)
        return (
            f"SELECT t.*, v.{names[-1]} FROM {prior} t JOIN (VALUES {values}) v({', '.join(names)}, w, i) ON {ons} "
            f"QUALIFY row_number() OVER (PARTITION BY t.n ORDER BY {draw.format(path=path)}, i) = 1"
        )

    return f"""WITH t0 AS (SELECT {key}, row_number() OVER () AS n, coalesce('key:' || {key}::VARCHAR, 'null:') AS k FROM {table}),
t1 AS ({level(top, ['region'], 't0', 'true')}),
t2 AS ({level(mid, ['region', 'rack'], 't1', 't.region = v.region')}),
t3 AS ({level(low, ['region', 'rack', 'shard'], 't2', 't.region = v.region AND t.rack = v.rack')})
SELECT {key}, region, rack, shard FROM t3"""
