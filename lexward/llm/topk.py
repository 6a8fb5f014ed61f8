"""Exact top-k by inner product, by descending norms and partial sums in a rotated basis."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexward.llm.common import cut

K = 10

#: Rows whose id is divisible by this are the queries of the registered query.
QUERY_EVERY = 50

#: Vectors in a block of items; blocks in a range, which is what a task meets, at most; queries in a group, at most.
BLOCK = 1024
RANGE = 64
GROUP = 8192

#: Signs of so many leading coordinates tell directions apart, which queries of a group share.
SIGNS = 12

#: Scores are rounded to so many digits, and equal ones go to the lesser id.
DIGITS = 8

#: Room left to the bounds for floating-point error.
SLACK = 1e-6

_BLOCK = "r int, n int, top double, ids binary, data binary"


def clean_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(id, v) of the vectors that can be compared, one an id, and their dimension."""
    rows = vectors.select(vectors[f"`{vec_id}`"].cast("bigint").alias("id"), vectors[f"`{embedding}`"].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e100)))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = sizes["d"] if sizes else 0
    return rows.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), dim


def rotation(rows: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """The right singular vectors of all vectors by falling singular value, and how many hold most of the energy.

    Only dim x dim sums of products leave the partitions, added up by the cluster.
    """

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.ravel())], ["at", "s"])

    sums = rows.select("v").mapInArrow(gram, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).toPandas()
    matrix = np.zeros(dim * dim)
    matrix[sums["at"]] = sums["s"]
    values, basis = np.linalg.eigh(matrix.reshape(dim, dim))
    values, basis = np.clip(values[::-1], 0, None), basis[:, ::-1]
    head = int(np.searchsorted(np.cumsum(values), 0.6 * values.sum()) + 1)
    return np.ascontiguousarray(basis), min(head, dim)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by falling norm as blocks: the range, ids and vectors as bytes, and the greatest norm."""
    rest: list[pa.RecordBatch] = []
    partition = TaskContext.get().partitionId()

    def block(part: pa.Table) -> pa.RecordBatch:
        ids, norms = part.column("id").to_numpy(), part.column("norm").to_numpy()
        data = part.column("v").combine_chunks().flatten().to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array([partition], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([norms.max()]), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([data.astype(np.float64).tobytes()], pa.binary())],
            ["r", "n", "top", "ids", "data"],
        )

    for batch in batches:
        rest.append(batch)
        if sum(b.num_rows for b in rest) >= BLOCK:
            table = pa.Table.from_batches(rest)
            whole = table.num_rows // BLOCK * BLOCK
            for at in range(0, whole, BLOCK):
                yield block(table.slice(at, BLOCK))
            rest = table.slice(whole).to_batches()
    if sum(b.num_rows for b in rest):
        yield block(pa.Table.from_batches(rest))


class Search:
    """The k best items so far of a group of queries; blocks of items come by falling norm.

    floor: for each query a score that its k-th best reaches at least, known from other items; what is below isn't kept.
    met counts the pairs whose partial sums were worked out.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, basis: np.ndarray, head: int, k: int, floor: np.ndarray | None = None):
        self.ids, self.vectors, self.basis, self.head, self.k = ids, vectors, basis, head, k
        self.rotated = vectors @ basis
        self.norms = np.linalg.norm(vectors, axis=1)
        self.residuals = np.linalg.norm(self.rotated[:, head:], axis=1)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.met = 0

    def worst(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def reach(self) -> np.ndarray:
        """For each query the least norm of an item that could still enter its best."""
        worst = self.worst()
        return np.where(worst > SLACK, (worst - SLACK) / np.maximum(self.norms, 1e-300), 0.0)

    def add(self, ids: np.ndarray, vectors: np.ndarray, top: float) -> None:
        open_ = np.flatnonzero(self.norms * top >= self.worst() - SLACK)
        if not len(open_):
            return
        rotated = vectors @ self.basis
        residuals = np.linalg.norm(rotated[:, self.head :], axis=1)
        for at in range(0, len(open_), 1024):
            self._meet(open_[at : at + 1024], ids, vectors, rotated, residuals)

    def _meet(self, rows, ids, vectors, rotated, residuals) -> None:
        h, worst = self.head, self.worst()[rows] - SLACK
        self.met += len(rows) * len(ids)
        partial = self.rotated[rows, :h] @ rotated[:, :h].T
        # Cauchy-Schwarz: the other coordinates add at most the product of the residual norms.
        hopeful = partial + self.residuals[rows, None] * residuals[None, :] >= worst[:, None]
        share = np.count_nonzero(hopeful) / max(hopeful.size, 1)
        if not share:
            return
        if share < 0.05:
            r, c = np.nonzero(hopeful)
            rest = np.einsum("ij,ij->i", self.rotated[rows[r], h:], rotated[c, h:])
            good = partial[r, c] + rest >= worst[r]
            r, c = r[good], c[good]
        else:
            partial += self.rotated[rows, h:] @ rotated[:, h:].T
            floor = worst
            if partial.shape[1] > self.k + 1:  # the k + 1 best of the block, the query itself perhaps among them
                floor = np.maximum(worst, np.partition(partial, -(self.k + 1), axis=1)[:, -(self.k + 1)] - 2 * SLACK)
            r, c = np.nonzero(partial >= floor[:, None])
        other = self.ids[rows[r]] != ids[c]
        r, c = rows[r[other]], c[other]
        if len(r):
            self._merge(r, ids[c], np.round(np.einsum("ij,ij->i", self.vectors[r], vectors[c]), DIGITS) + 0.0)

    def _merge(self, r, ids, scores) -> None:
        touched = np.unique(r)
        row = np.concatenate([r, np.repeat(touched, self.k)])
        score = np.concatenate([scores, self.scores[touched].ravel()])
        item = np.concatenate([ids, self.found[touched].ravel()])
        order = np.lexsort((item, -score, row))
        row, score, item = row[order], score[order], item[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        take = (starts[:, None] + np.arange(self.k)).ravel()  # every touched row has k entries at least
        self.scores[touched], self.found[touched] = score[take].reshape(-1, self.k), item[take].reshape(-1, self.k)

    def result(self) -> pa.RecordBatch:
        real = ~np.isneginf(self.scores)
        ranks = np.broadcast_to(np.arange(1, self.k + 1, dtype=np.int32), self.scores.shape)
        ids = np.broadcast_to(self.ids[:, None], self.scores.shape)
        return pa.RecordBatch.from_arrays([pa.array(ids[real]), pa.array(ranks[real]), pa.array(self.found[real]), pa.array(self.scores[real])], ["vec_id", "rank", "neighbor_id", "score"])


def _arrays(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.float64).reshape(-1, dim)


def _grouped(queries: DataFrame, basis: np.ndarray, dim: int) -> DataFrame:
    """(g, id, v): queries in groups that share a direction, none of more than about GROUP rows.

    A direction is the signs of the leading rotated coordinates; one with more queries is split by a hash.
    """
    lead = basis[:, :SIGNS]

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, dim) @ lead
            code = ((x > 0) << np.arange(x.shape[1])).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(code)], ["id", "v", "code"])

    coded = cut(queries.mapInArrow(direct, "id bigint, v array<double>, code int"))
    sizes = {r["code"]: r["count"] for r in coded.groupBy("code").count().collect()}  # 2 to the power SIGNS at most
    # Small directions whose leading signs agree go together: their codes follow each other, read from the first sign.
    rank = sorted(sizes, key=lambda c: format(c, f"0{SIGNS}b")[::-1])
    places, held, groups = {}, 0, 0
    for code in rank:
        if held and held + sizes[code] > GROUP:
            groups, held = groups + 1, 0
        pieces = -(-sizes[code] // GROUP)
        places[code] = (groups, pieces)
        held += sizes[code]
        if pieces > 1:
            groups, held = groups + pieces, 0
    table = F.from_json(F.lit(json.dumps({str(c): {"first": f, "pieces": n} for c, (f, n) in places.items()})), "map<string,struct<first:int,pieces:int>>")
    place = F.element_at(table, F.col("code").cast("string"))
    return coded.select((place["first"] + F.pmod(F.xxhash64("id"), place["pieces"])).cast("int").alias("g"), "id", "v")


def top_k(vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", queries: Column | None = None) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): for every query the k others of greatest inner product, exactly.

    queries: a condition on vec_id for the rows that are queries, all by default; all rows are items. Items are packed
    into blocks by falling norm, and blocks into ranges. A group of queries of one direction first meets its own members
    and the longest items, which gives each query a floor of its k-th score; only ranges with an item long enough to
    reach some query's floor are met. A task is one group and one range: within a block the partial sums over the leading rotated coordinates
    plus the residuals' bound leave out most pairs. The best of each task are merged at the end.

    Scores are inner products in double precision rounded to DIGITS; ties go to the lesser id. Fewer than k
    others give fewer rows; one vector or none gives none. Left out, as queries and as items: null ids, null or
    empty vectors, vectors with a null, NaN or infinite (from 1e100 on) element, and those not of the commonest
    dimension (of several the greatest). Of rows that share an id, which must be numbers, the least vector counts. Zero
    vectors score 0. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows, dim = clean_vectors(vectors, vec_id, embedding)
    out = "vec_id bigint, rank int, neighbor_id bigint, score double"
    if not dim:
        return spark.createDataFrame([], out)
    rows = cut(rows)
    basis, head = rotation(rows, dim)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    total, tasks = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-total // (BLOCK * RANGE)), min(2 * tasks, -(-total // BLOCK)), 1)
    ordered = rows.select("id", "v", norm.alias("norm")).repartitionByRange(parts, F.desc("norm"), F.xxhash64("id"))
    blocks = cut(ordered.sortWithinPartitions(F.desc("norm"), F.xxhash64("id")).mapInArrow(_pack, _BLOCK))
    tops = {r["r"]: r["top"] for r in blocks.groupBy("r").agg(F.max("top").alias("top")).collect()}  # a row for BLOCK * RANGE vectors
    # Of the first range alone: two blocks reach the driver, however many ranges there are.
    longest = [_arrays(r.asDict(), dim) for r in blocks.where(F.col("r") == min(tops)).orderBy(F.desc("top"), F.xxhash64("ids")).limit(2).select("ids", "data").collect()]
    asked = rows.where(queries) if queries is not None else rows

    def seeds(table: pa.Table) -> pa.Table:
        ids, data = table.column("id").to_numpy(), table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        search = Search(ids, data, basis, head, k)
        own = set(ids.tolist())
        for other, x in longest:
            fresh = ~np.isin(other, ids)
            search.add(other[fresh], x[fresh], np.inf)
        for at in range(0, len(own), BLOCK):
            search.add(ids[at : at + BLOCK], data[at : at + BLOCK], np.inf)
        least = search.reach().min(initial=np.inf)
        ranges = pa.array([[r for r, top in tops.items() if top >= least]], pa.list_(pa.int32()))
        return pa.table({"g": table.column("g").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary()), "floor": pa.array([search.worst().tobytes()], pa.binary()), "ranges": ranges})

    grouped = cut(_grouped(asked, basis, dim).groupBy("g").applyInArrow(seeds, "g int, ids binary, data binary, floor binary, ranges array<int>"))
    # Every group goes to the ranges that it has to meet, and these ranges' blocks to it.
    pairs = grouped.select("g", F.explode("ranges").alias("r"))
    asking = grouped.select("g", F.explode("ranges").alias("r"), F.lit(0).alias("kind"), F.lit(0.0).alias("top"), "ids", "data", "floor")
    items = blocks.join(pairs, "r").select("g", "r", F.lit(1).alias("kind"), "top", "ids", "data", F.lit(None).cast("binary").alias("floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in ("g", "r", "kind", "top", "ids", "data", "floor")}
                if row["kind"] == 0:
                    if search is not None:
                        yield search.result()
                    now, search = (row["g"], row["r"]), Search(*_arrays(row, dim), basis, head, k, np.frombuffer(row["floor"], np.float64))
                else:
                    assert now == (row["g"], row["r"])  # a group comes before its items
                    search.add(*_arrays(row, dim), row["top"])
        if search is not None:
            yield search.result()

    many = max(1, min(pairs.count(), 4 * tasks))
    met = asking.unionAll(items).repartition(many, "g", "r").sortWithinPartitions("g", "r", "kind", F.desc("top"))
    best = met.mapInArrow(run, out)
    w = Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id")
    return best.select("vec_id", "neighbor_id", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "score")


ORACLE = f"""SELECT vec_id, (row_number() OVER w)::INT AS rank, neighbor_id, score FROM (
  SELECT q.vec_id, i.vec_id AS neighbor_id, round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), {DIGITS}) AS score
  FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0
) WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) QUALIFY row_number() OVER w <= {K}"""
