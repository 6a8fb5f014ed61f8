"""Near-duplicates by SimHash, found through an inverted index of positional bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexward.llm import simhash
from lexward.llm.common import cut, hinted
from lexward.llm.components import components

#: Pairs are kept that share at least so many of the 24 positional bytes: all that differ in up to 21 bits do.
MIN_SHARED = 3

#: Verified pairs differ in at most so many of the 192 bits over words, and of the 128 over word pairs.
MAX_WORD_BITS = 36
MAX_PAIR_BITS = 36

_PLACES = range(simhash.WORD_BYTES)

#: With more fingerprints than this a list is kept for each value of two bytes instead of one; the pairs are the same.
WIDE_FROM = 1 << 28

#: A list of more fingerprints is split into blocks, and every two blocks are one task.
BLOCK_ROWS = 1 << 20

#: Rows of a list that are sorted at once, for one or more positions, and comparisons that are worked out together.
_SORTED_ROWS = 1 << 20
_CELLS = 1 << 16

#: Rows of a run that meet by their distance in it, all such runs together; longer runs are met one by one, those beyond
#: the second number by a third byte where their position has some.
_SHORT_RUN = 192
_LONG_RUN = 3000

#: Pairs that are verified and joined together.
_FOUND_PAIRS = 1 << 18

_EDGES = "u bigint, v bigint"


def fingerprint_column(text):
    """Column of the fingerprint of a text; null for a text without a word."""

    @F.arrow_udf(", ".join(f"{f} bigint" for f in simhash.FIELDS))
    def run(texts: pa.Array) -> pa.Array:
        return simhash.fingerprints(texts)

    return run(text)


def _byte(position: int):
    return F.shiftrightunsigned(f"w{position // 8}", 8 * (position % 8)).bitwiseAND(255).cast("int")


def _half(position: int) -> range:
    """The half of the positions that it lies in. Of any three positions two lie in one half, so that lists of two bytes of
    one half hold all pairs that share three: 132 in place of 276, or of 2,024 for three bytes."""
    middle = len(_PLACES) // 2
    return _PLACES[:middle] if position < middle else _PLACES[middle:]


def keys_of(wide: bool) -> list[tuple[int, ...]]:
    """The positions whose bytes, one or two, key the lists: those after which others of their half are left to be shared."""
    return [(i, j) for i in _PLACES for j in _half(i) if i < j] if wide else [(i,) for i in _PLACES if i < _half(i)[-1]]


def _postings(prints: DataFrame, wide: bool) -> DataFrame:
    """A row for each fingerprint and list: key, the number of the list, and part, of the list's pairs of blocks one.

    Sizes of lists are counted first. A list that is larger than its share, as one with a group of very many copies,
    is cut into blocks by a hash, and each of its rows goes to all pairs with its block.
    """
    octets = prints.select("id", *simhash.FIELDS, F.array(*[_byte(i) for i in _PLACES]).alias("octets"))
    places = F.array(*[F.struct(F.lit(n << 16).alias("n"), F.lit(k[0]).alias("i"), F.lit(k[-1]).alias("j")) for n, k in enumerate(keys_of(wide))])
    key = F.transform(places, lambda k: k["n"] + (F.get("octets", k["i"]) * 256 if wide else F.lit(0)) + F.get("octets", k["j"]))
    posted = octets.select(F.explode(key).alias("key"), "id", *simhash.FIELDS)
    large = cut(posted.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")).where("blocks > 1"))
    n = large.count()
    if not n:
        return posted.withColumn("part", F.lit(0))
    blocks, own = F.coalesce("blocks", F.lit(1)), F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = posted.join(hinted(large, n, 16), "key", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return other.select("key", "id", *simhash.FIELDS, (F.least("own", "other") * blocks + F.greatest("own", "other")).alias("part"))


class _Labels:
    """Which rows are connected so far, and the edges that did it."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect pairs of rows; edges lead from the pairs' labels to the least that they are connected with."""
        x, y = self.of[a], self.of[b]
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(nodes))
        if moved.any():
            self.a.append(nodes[moved])
            self.b.append(nodes[label[moved]])
            to = np.arange(len(self.of))
            to[nodes] = nodes[label]
            self.of = to[self.of]


def _similar(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows whether it shares bytes enough and is verified."""
    k = len(simhash.WORD_FIELDS)
    x = words[a, :k] ^ words[b, :k]
    near = np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= MAX_WORD_BITS
    near &= np.count_nonzero(x.view(np.uint8).reshape(len(a), simhash.WORD_BYTES) == 0, axis=1) >= MIN_SHARED
    near[near] = simhash.distances(words[a[near], k:], words[b[near], k:]) <= MAX_PAIR_BITS
    return near


class _Found:
    """Pairs of rows that may be similar, gathered until they are many; those that are connect their rows."""

    def __init__(self, words: np.ndarray, labels: _Labels):
        self.words, self.labels = words, labels
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.count += len(a)
        if self.count >= _FOUND_PAIRS:
            self.join()

    def join(self) -> None:
        if self.waiting:
            a, b = (np.concatenate(x) for x in zip(*self.waiting))
            self.waiting, self.count = [], 0
            apart = self.labels.of[a] != self.labels.of[b]
            a, b = a[apart], b[apart]
            same = _similar(self.words, a, b)
            if same.any():
                self.labels.join(a[same], b[same])


def _alike(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Whether so few bits of the part over word pairs differ that the rows may be similar; few others pass."""
    differ = np.bitwise_count(x[0] ^ y[0])
    for a, b in zip(x[1:], y[1:]):
        differ += np.bitwise_count(a ^ b)
    return differ <= MAX_PAIR_BITS


def _meet_short(parts: list[np.ndarray], rows: np.ndarray, sizes: np.ndarray, found: _Found) -> None:
    """All rows of each run meet; runs of the given sizes, the largest first, stand one after the other in rows.

    Rows a distance apart are compared all at once, over the ends of runs too; only pairs of one run are handed on.
    """
    ends = np.cumsum(sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)
    own = [p[rows] for p in parts]
    for gap in range(1, int(sizes[0])):
        n = int(ends[np.searchsorted(-sizes, -gap) - 1])  # of runs that are longer than gap
        at = np.flatnonzero(_alike([p[: n - gap] for p in own], [p[gap:n] for p in own]))
        if len(at):
            at = at[run[at] == run[at + gap]]
            found.add(rows[at], rows[at + gap])


def _connect_run(parts: list[np.ndarray], rows: np.ndarray, found: _Found) -> None:
    """All rows of a run meet, which may be very many, but for those of a large set that is connected already.

    Each row meets those after it. Rows of the largest connected set are kept to the end and never meet each other, so a
    group of copies costs a comparison a row, in each run that it comes to.
    """
    at = 0
    while True:
        last = len(rows)  # rows from here on are connected
        found.join()
        own = found.labels.of[rows[at:]]
        if np.count_nonzero(own != rows[at:]) * 8 + 8 > last - at:  # else no set is large, as one row of each has its own label
            kinds, own, counts = np.unique(own, return_inverse=True, return_counts=True)
            if counts.max() * 8 > last - at:
                rest = own == counts.argmax()
                rows = np.concatenate([rows[at:][~rest], rows[at:][rest]])
                last, at = len(rows) - int(rest.sum()), 0
        own_parts = [p[rows] for p in parts]
        fresh = len(found.labels.a)
        while at < min(last, len(rows) - 1) and len(found.labels.a) == fresh:
            step = max(1, min(_CELLS // (len(rows) - at), last - at))
            i, j = divmod(np.flatnonzero(_alike([p[at : at + step, None] for p in own_parts], [p[None, at:] for p in own_parts])), len(rows) - at)
            i, j = i[i < j], j[i < j]
            if len(i):
                found.add(rows[at + i], rows[at + j])
                if 16 * len(i) > len(rows) - at:  # a group of copies
                    found.join()
            at += step
        if at >= min(last, len(rows) - 1):
            return


def _meet(octets: np.ndarray, parts: list[np.ndarray], rows: np.ndarray, places: list[tuple[int, list[int]]], found: _Found) -> None:
    """Rows that agree on the byte of one of the places meet, those of a long run only if on one of its further bytes too."""
    step = max(1, _SORTED_ROWS // max(len(rows), 1))
    for at in range(0, len(places), step):
        some = places[at : at + step]
        keys = octets[rows[:, None], [p for p, _ in some]].T
        order = np.argsort(keys, axis=1, kind="stable")
        keys = np.take_along_axis(keys, order, axis=1)
        # Runs of equal bytes, over all the places at once.
        new = np.ones(keys.shape, bool)
        new[:, 1:] = keys[:, 1:] != keys[:, :-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=keys.size)
        ordered = rows[order.ravel()]
        for a in np.flatnonzero(sizes > _SHORT_RUN):
            further = some[starts[a] // len(rows)][1]
            run = ordered[starts[a] : starts[a] + sizes[a]]
            if further and sizes[a] > _LONG_RUN:
                _meet(octets, parts, run, [(k, []) for k in further], found)
            else:
                _connect_run(parts, run, found)
        few = np.flatnonzero((sizes > 1) & (sizes <= _SHORT_RUN))
        few = few[np.argsort(-sizes[few], kind="stable")]
        starts, sizes = starts[few], sizes[few]
        pieces = np.cumsum(sizes) // _CELLS
        for piece in np.split(np.arange(len(few)), np.flatnonzero(np.diff(pieces)) + 1) if len(few) else []:
            s = sizes[piece]
            _meet_short(parts, ordered[np.repeat(starts[piece] - np.cumsum(s) + s, s) + np.arange(s.sum())], s, found)
        found.join()


def list_forest(words: np.ndarray, places: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all similar rows of a list that share the byte at any of the places too.

    Rows are sorted by their byte at each place; those that agree meet, and a pair is verified if few bits of its part over
    word pairs differ. Where very many agree they meet only if they share one more byte, as similar ones do.
    """
    k = len(simhash.WORD_FIELDS)
    octets = words[:, :k].copy().view(np.uint8).reshape(len(words), simhash.WORD_BYTES)
    labels = _Labels(len(words))
    if len(words) > 1:
        _meet(octets, [words[:, i].copy() for i in range(k, words.shape[1])], np.arange(len(words)), places, _Found(words, labels))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *labels.a]), np.concatenate([empty, *labels.b])


def list_positions(key: tuple[int, ...]) -> list[tuple[int, list[int]]]:
    """The places that rows of a list are sorted by, and for each the bytes of which similar rows share one more.

    Three shared positions are either of one half, and the list and place are the first two, or two of a half and one of
    the other.
    """
    half = _half(key[0])
    return [(j, [k for k in _PLACES if k not in half or k > j]) for j in (key[1:] or half) if j > key[0]]


def _list_edges(wide: bool):
    def run(posted: pa.Table) -> pa.Table:
        pairs = list_positions(keys_of(wide)[posted.column("key")[0].as_py() >> 16])
        ids = posted.column("id").to_numpy()
        words = np.stack([posted.column(f).to_numpy() for f in simhash.FIELDS], axis=1).view(np.uint64)
        a, b = list_forest(words, pairs)
        return pa.table({"u": pa.array(ids[a], pa.int64()), "v": pa.array(ids[b], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_doc_id) for every document of a group of near-duplicates but the one of least id, which stays.

    Groups are connected by pairs whose fingerprints share MIN_SHARED positional bytes and differ in few bits.
    Equal fingerprints are one entry of the index. Lists hand on a forest that connects what their verified pairs
    do, so that what leaves them grows with the documents and not with the pairs.

    A null text, and one without a word (empty, punctuation only), is like no other. Rows with a null id are
    left alone. Rows that share an id are one document; ids must be numbers. Texts of any length count whole. An
    empty table gives no rows. Other columns are not read.
    """
    column = docs[f"`{text}`"]
    prints = docs.select(docs[f"`{doc_id}`"].cast("bigint").alias("id"), column.alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    # Cut before the filter, which would work the fingerprints out a second time.
    prints = cut(prints.select("id", fingerprint_column(F.col("text")).alias("f"))).where("f IS NOT NULL").select("id", "f.*")
    grouped = cut(prints.groupBy(*simhash.FIELDS).agg(F.min("id").alias("id"), F.count("*").alias("n")))
    wide = grouped.count() > WIDE_FROM
    edges = _postings(grouped, wide).groupBy("key", "part").applyInArrow(_list_edges(wide), _EDGES)
    # Two fingerprints under one id are one node, and an id may be listed under several. Of a fingerprint that very many
    # documents have only the one row of grouped is sent to them.
    several = grouped.where("n > 1").select(*simhash.FIELDS, F.col("id").alias("v"))
    alike = prints.join(hinted(several, several.count(), 80), [*simhash.FIELDS]).select(F.col("id").alias("u"), "v")
    roots, _ = components(edges.unionAll(alike))
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("keep_doc_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates: the one of least id. Columns stay as they are.

    Rows with a null id, a null text or one without a word all stay, as do all rows of an id that stays. Texts of any
    length count whole, columns of any name pass through, and an empty table gives no rows.
    """
    gone = cut(near_duplicates(docs, doc_id, text).select(F.col("doc_id").alias("gone_")))
    side = hinted(gone, gone.count(), 40)
    return docs.join(side, docs[f"`{doc_id}`"] == side["gone_"], "left_anti")
