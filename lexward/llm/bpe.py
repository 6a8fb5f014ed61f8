"""Byte-pair encoding and decoding by dynamic programming over prefixes."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexward.llm import tokens_sql, vocabulary
from lexward.llm.common import byte_slices, gathered, plain

#: Bytes of text whose parts are told apart together, and bytes of pre-tokens that go through the programme together.
SLICE_BYTES = 4 << 20
STEP_BYTES = 1 << 17

#: A pre-token of more bytes goes through the programme alone, a place after the other.
LONG_WORD = 192

#: Slots of the table of token pairs that were tested; a pair that finds its slot taken takes it over.
PAIR_SLOTS = 1 << 20

#: Outside this range, or at these characters, Python's classes of letters and digits differ from Unicode's.
_ODD = re.compile("[\x1c-\x1f²³¹¼½¾]|[^\x00-ɏ]")
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

#: What most parts are: letters, then marks. None of these characters' classes differs between engines.
_COMMON = r"^(?P<letters>[A-Za-zªµºÀ-ÖØ-öø-ɏ]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"

#: White space before a space, as RE2 writes it: there, and only there, a split before each space could differ.
_UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "

_NONE = -1


class _Table:
    """A fixed map from integers of 63 bits to 32-bit integers, looked up for whole arrays; -1 for what isn't in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, _NONE, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        at, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[at[rest]] == _NONE]
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            won = self.keys[at[free]] == keys[free]
            self.values[at[free[won]]] = values[free[won]]
            rest = rest[self.keys[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return _slots(keys, self.bits)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        out = self.values[at]
        there = self.keys[at]
        rest = np.flatnonzero((there != keys) & (there != _NONE))
        out[there != keys] = _NONE
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[rest]]
            same = there == keys[rest]
            out[rest[same]] = self.values[at[rest[same]]]
            rest = rest[~same & (there != _NONE)]
        return out


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Encoder:
    """Exact ids of a byte-level BPE vocabulary, without running merges over the text.

    The last token of every prefix of a pre-token is unique. It is a token that ends there and that stays put
    next to the last token of the shorter prefix it leaves (a test on the pair alone). Back-pointers from the end
    give the ids. The tokens that lie in a pre-token are listed by an automaton over the vocabulary, the trie that all
    places walk in step, in the place of the method's suffix automaton: both list the same tokens at the same
    places, and this one is walked for all pre-tokens of a batch at once in numpy, as are the prefixes.
    """

    def __init__(self, path: str):
        import regex

        self.ids = vocabulary.ranks(path)
        self.bytes = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.bytes[i] = token
        self.odd = regex.compile(vocabulary.PATTERN)
        sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.sizes, self.stops = sizes.astype(np.int32), np.cumsum(sizes)
        self.data = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._grow_trie()
        self._halve()
        self.pair_keys = np.full(PAIR_SLOTS, _NONE, np.int64)
        self.pair_stands = np.zeros(PAIR_SLOTS, bool)

    def _grow_trie(self) -> None:
        """Edges (node, byte) of the vocabulary's trie, and the token of each node."""
        edges: dict[int, int] = {}
        token_of = [_NONE]
        for token, i in self.ids.items():
            node = 0
            for b in token:
                node = edges.setdefault(node << 8 | b, len(token_of))
                if node == len(token_of):
                    token_of.append(_NONE)
            token_of[node] = i
        self.first, self.second = np.full(256, _NONE, np.int32), np.full(1 << 16, _NONE, np.int32)
        for b in range(256):
            self.first[b] = node = edges.get(b, _NONE)
            for c in range(256 if node >= 0 else 0):
                self.second[b << 8 | c] = edges.get(node << 8 | c, _NONE)
        self.edges = _Table(np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.token_of = np.array(token_of, np.int32)

    def _halve(self) -> None:
        """For each token the two whose merge made it (a byte is its own halves), and every pair whose bytes are a token."""
        n = len(self.bytes)
        self.left, self.right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        find, pairs = self.ids.get, []
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                a, b = find(token[:cut]), find(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a, b, i))
        a, b, joint = np.array(pairs, np.int64).reshape(-1, 3).T
        self.joint = _Table(a << 32 | b, joint.astype(np.int32))
        # Of several splits of a token the one that stands under the merges before its own. Shorter tokens go first.
        made = (a < joint) & (b < joint)
        a, b, joint = a[made], b[made], joint[made]
        sizes = self.sizes[joint]
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            own = own[self._stand(a[own], b[own], joint[own])]
            self.left[joint[own]], self.right[joint[own]] = a[own], b[own]
        if ((self.left == self.right) & (self.left == np.arange(n)) & (self.sizes > 1)).any():
            raise ValueError("a token of the vocabulary isn't made by merges")

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether their bytes encode to just these two."""
        keys = left.astype(np.int64) << 32 | right
        at = _slots(keys, PAIR_SLOTS.bit_length() - 1)
        out = self.pair_stands[at]
        new = np.flatnonzero(self.pair_keys[at] != keys)
        if len(new):
            own, back = np.unique(keys[new], return_inverse=True)
            stands = self._stand(own >> 32, own & 0xFFFFFFFF)
            out[new] = stands[back]
            at = _slots(own, PAIR_SLOTS.bit_length() - 1)
            self.pair_keys[at] = own
            kept = self.pair_keys[at] == own  # of several for one slot the last stays
            self.pair_stands[at[kept]] = stands[kept]
        return out

    def _stand(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """The test itself: undo merges from the youngest back. Two tokens stand unless, at some stage, the pieces
        that face each other would have merged before the merge being undone. limit: the merge at which all ends."""
        out, at = np.zeros(len(left), bool), np.arange(len(left))
        limit = np.full(len(left), len(self.bytes), np.int64) if limit is None else limit
        while len(at):
            joint = self.joint.get(left << 32 | right)
            go = (joint < 0) | (joint >= limit)
            at, left, right, limit = at[go], left[go], right[go], limit[go]
            single_a, single_b = self.sizes[left] == 1, self.sizes[right] == 1
            ended = single_a & single_b
            out[at[ended]] = True
            # The younger of the two merges is undone; of equal ones the right, as merges run from the left.
            of_left = single_b | ~single_a & (left > right)
            limit = np.where(of_left, left, right + 1)
            left, right = np.where(of_left, self.right[left], left).astype(np.int64), np.where(of_left, right, self.left[right]).astype(np.int64)
            at, left, right, limit = (x[~ended] for x in (at, left, right, limit))
        return out

    def _matches(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, token) of every token that lies in the bytes; room: bytes from each place to its pre-token's end."""
        starts, tokens = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        at, node = np.arange(len(data), dtype=np.int32), self.first[data]
        depth = 1
        while len(at):
            token = self.token_of[node]
            known = token >= 0
            starts.append(at[known])
            tokens.append(token[known])
            at, node = at[room[at] > depth], node[room[at] > depth]
            node = self.second[data[at].astype(np.int64) << 8 | data[at + 1]] if depth == 1 else self.edges.get(node.astype(np.int64) << 8 | data[at + depth])
            at, node = at[node >= 0], node[node >= 0]
            depth += 1
        return np.concatenate(starts), np.concatenate(tokens)

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, whose bytes follow each other in data up to their ends: all ids, and each one's end in them."""
        sizes = np.diff(ends, prepend=0)
        begins = ends - sizes
        head = np.repeat(begins, sizes).astype(np.int32)
        start, token = self._matches(data, np.repeat(ends, sizes).astype(np.int32) - np.arange(len(data), dtype=np.int32))
        length = self.sizes[token]
        stop = start + length
        # last[i], size[i]: the last token of the prefix that ends before place i, and its bytes.
        last, size = np.full(len(data) + 1, _NONE, np.int32), np.zeros(len(data) + 1, np.int32)
        reach = stop - head[start]
        order = np.argsort((reach << 8 | np.minimum(length, 255)).astype(np.uint16), kind="stable")
        start, stop, token, length, reach = start[order], stop[order], token[order], length[order], reach[order]
        first = start == head[start]
        edges = np.searchsorted(reach, np.arange(1, (int(reach[-1]) if len(reach) else 0) + 2))
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            before = last[start[a:b]]
            good = first[a:b].copy()
            test = np.flatnonzero(~good & (before >= 0))
            good[test] = self.compatible(before[test], token[a:b][test])
            to = stop[a:b][good]
            last[to], size[to] = token[a:b][good], length[a:b][good]  # the longest comes last and stays
        if (last[ends] < 0).any():
            raise ValueError("the vocabulary can't encode these bytes")
        return self._walked_back(begins, ends, last, size)

    def _long_word(self, word: bytes) -> np.ndarray:
        """Ids of one very long pre-token, a place after the other in Python: linear time, and memory by the step."""
        data, n = np.frombuffer(word, np.uint8), len(word)
        last, seen, longest = np.full(n + 1, _NONE, np.int32), {}, int(self.sizes.max())
        held = memoryview(last)
        for at in range(0, n, STEP_BYTES):
            low, high = max(0, at - longest), min(n, at + STEP_BYTES)
            start, token = self._matches(data[low:high], np.arange(high - low, 0, -1, dtype=np.int32))
            start = start + low
            stop = start + self.sizes[token]
            new = stop > at
            start, token, stop = start[new], token[new], stop[new]
            order = np.lexsort((start, stop))  # the longest of those that end together comes first
            for s, e, t in zip(start[order].tolist(), stop[order].tolist(), token[order].tolist()):
                if held[e] >= 0:
                    continue
                if s:
                    if held[s] < 0:
                        continue
                    pair = (held[s], t)
                    stands = seen.get(pair)
                    if stands is None:
                        if len(seen) >= 1 << 16:
                            seen.clear()
                        stands = seen[pair] = bool(self._stand(np.array([pair[0]], np.int64), np.array([t], np.int64))[0])
                    if not stands:
                        continue
                held[e] = t
        out = np.zeros(n, np.int32)
        at, k = n, n
        while at:
            token = held[at]
            if token < 0:
                raise ValueError("the vocabulary can't encode these bytes")
            k -= 1
            out[k] = token
            at -= len(self.bytes[token])
        return out[k:].copy()

    def _walked_back(self, begins, ends, last, size) -> tuple[np.ndarray, np.ndarray]:
        at, word = ends.copy(), np.arange(len(ends))
        tokens, places, owners = [], [], []
        while len(at):
            tokens.append(last[at])
            places.append(at.copy())
            owners.append(word)
            at = at - size[at]
            more = at > begins[word]
            at, word = at[more], word[more]
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        token, place, owner = np.concatenate(tokens), np.concatenate(places), np.concatenate(owners)
        return token[np.argsort(place, kind="stable")], np.cumsum(np.bincount(owner, minlength=len(ends)))

    def pretokens(self, text: str) -> list[str]:
        return (self.odd if _ODD.search(text) else _PLAIN).findall(text)

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, none of them empty: all ids, and the end of each one's."""
        long = pc.binary_length(words).to_numpy(zero_copy_only=False) > LONG_WORD
        ids = [np.zeros(0, np.int32)]
        short = words.filter(pa.array(~long)) if long.any() else words
        counts = [np.zeros(0, np.int64)]
        for a, b in byte_slices(short, STEP_BYTES):
            part = short[a:b].cast(pa.large_binary())
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            own, ends = self.words(data, offsets[1:] - offsets[0])
            ids.append(own)
            counts.append(np.diff(ends, prepend=0))
        sizes = np.concatenate(counts)
        if not long.any():
            return np.concatenate(ids), np.cumsum(sizes)
        alone = [self._long_word(w.encode()) for w in words.filter(pa.array(long)).to_pylist()]
        sizes = np.concatenate([sizes, [len(x) for x in alone]])
        order = np.zeros(len(words), np.int64)
        order[~long], order[long] = np.arange(len(short)), len(short) + np.arange(len(alone))
        return gathered(np.concatenate([*ids, *alone]), np.cumsum(sizes), order)

    def parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of what follows a space, with that space: all ids, and the end of each part's."""
        common = pc.extract_regex(parts, _COMMON)
        letters, marks = (pc.fill_null(pc.struct_field(common, f), "") for f in ("letters", "marks"))
        some, more = pc.not_equal(letters, ""), pc.not_equal(marks, "")
        space, none = pa.scalar(" ", parts.type), pa.scalar("", parts.type)
        # A space belongs to the letters, or, without any, to the marks; alone, it is a pre-token itself.
        first = pc.binary_join_element_wise(space, pc.if_else(some, letters, marks), none)
        second = pc.filter(marks, pc.and_(some, more))
        counts = 1 + pc.and_(some, more).to_numpy(zero_copy_only=False).astype(np.int64)
        odd = np.flatnonzero(common.is_null().to_numpy(zero_copy_only=False))
        split = [self.pretokens(" " + p) for p in parts.take(pa.array(odd)).to_pylist()]
        words = pa.chunked_array([first, second, pa.array([w for s in split for w in s], parts.type)]).combine_chunks().dictionary_encode()
        ids, ends = self.distinct(words.dictionary)
        # Where each part's pre-tokens stand among the words.
        n = len(parts)
        ordinal = np.cumsum(counts) - counts
        where = np.zeros(counts.sum(), np.int64)
        where[ordinal] = np.arange(n)
        where[ordinal[counts > 1] + 1] = n + np.arange(len(second))
        if len(odd):
            sizes = np.array([len(s) for s in split], np.int64)
            lists = np.ones(n, np.int64) * counts
            lists[odd] = sizes
            begin = np.cumsum(lists) - lists
            plain_at = np.repeat(np.arange(n), lists)
            out = np.zeros(lists.sum(), np.int64)
            known = np.ones(n, bool)
            known[odd] = False
            inner = np.arange(len(out)) - begin[plain_at]
            keep = known[plain_at]
            out[keep] = where[ordinal[plain_at[keep]] + inner[keep]]
            out[~keep] = n + len(second) + np.arange(sizes.sum())
            where, counts = out, lists
        flat, flat_ends = gathered(ids, ends, words.indices.to_numpy()[where])
        return flat, np.concatenate([np.zeros(1, np.int64), flat_ends])[np.cumsum(counts)]

    def wholes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each on its own: all ids, and the end of each one's."""
        split = [self.pretokens(t) for t in texts]
        words = pa.array([w for s in split for w in s], pa.large_string()).dictionary_encode()
        flat, flat_ends = gathered(*self.distinct(words.dictionary), words.indices.to_numpy())
        return flat, np.concatenate([np.zeros(1, np.int64), flat_ends])[np.cumsum([len(s) for s in split], dtype=np.int64)]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without nulls: all ids, and the end of each text's.

        Texts are parted before each space, where a pre-token begins anyway, and every part is worked out
        once in a slice. A text in which a space follows white space is its own part.
        """
        unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(unsafe), pa.scalar("", texts.type), texts), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        heads = offsets[:-1]
        own = texts.filter(pa.array(unsafe)).to_pylist()
        # What stands before a text's first space has no space of its own.
        firsts = coded.dictionary.take(pa.array(codes[heads])).to_pylist()
        n = len(coded.dictionary)
        codes[heads] = n + np.arange(len(heads))
        for i, text in zip(np.flatnonzero(unsafe).tolist(), own):
            firsts[i] = text
        ids, ends = self.parts(coded.dictionary)
        more, more_ends = self.wholes(firsts)
        flat, flat_ends = gathered(np.concatenate([ids, more]), np.concatenate([ends, more_ends + len(ids)]), codes)
        return flat, np.concatenate([np.zeros(1, np.int64), flat_ends])[offsets[1:]]

    def encode(self, text: str) -> list[int]:
        return self.texts(pa.array([text], pa.large_string()))[0].tolist()

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of many ids."""
        return gathered(self.data, self.stops, ids)[0]

    def round_trips(self, ids: np.ndarray, ends: np.ndarray, texts: pa.Array) -> np.ndarray:
        """For each text whether its ids decode to it, byte for byte."""
        sizes = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.sizes[ids])])[np.concatenate([np.zeros(1, np.int64), ends])]
        whole = texts.cast(pa.large_binary())
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        out = np.diff(sizes) == np.diff(offsets)
        if out.all():
            data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            wrong = np.flatnonzero(self.decoded(ids) != data)
            out[np.searchsorted(offsets - offsets[0], wrong, side="right") - 1] = False
        else:
            for i in np.flatnonzero(out).tolist():
                a, b = (ends[i - 1] if i else 0), ends[i]
                out[i] = self.decode_bytes(ids[a:b].tolist()) == whole[i].as_py()
        return out


@functools.lru_cache(2)
def encoder(path: str = vocabulary.DEFAULT_RANKS) -> Encoder:
    return Encoder(path)


def _encode_array(texts: pa.Array, path: str, check: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Lists of ids of texts, and, if check, whether each decodes to its text."""
    coder, texts = encoder(path), plain(texts)
    parts, counts, same = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.ones(0, bool)]
    for a, b in byte_slices(texts, SLICE_BYTES):
        ids, ends = coder.texts(texts[a:b])
        parts.append(ids)
        counts.append(np.diff(ends, prepend=0))
        if check:
            same.append(coder.round_trips(ids, ends, texts[a:b]))
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(counts))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts), pa.int32())), np.concatenate(same)


def encode_column(text, ranks_path: str = vocabulary.DEFAULT_RANKS):
    """Column of the ids (array of int) of a text column; null where the text is."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return _encode_array(texts, ranks_path)[0]

    return F.when(text.isNotNull(), run(text))


def decode_column(ids, ranks_path: str = vocabulary.DEFAULT_RANKS):
    """Column of the texts of id arrays; null where the array is null, holds a null or an unknown id."""

    @F.arrow_udf("string")
    def run(arrays: pa.Array) -> pa.Array:
        coder = encoder(ranks_path)
        top, out = len(coder.bytes), []
        for one in arrays.to_pylist():
            known = one is not None and all(i is not None and 0 <= i < top for i in one)
            out.append(coder.decode(one) if known else None)
        return pa.array(out, pa.string())

    return run(ids)


def bpe_encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str = vocabulary.DEFAULT_RANKS) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip): the ids of every text, and whether they decode to it.

    One pass without a shuffle. A null text has null ids, an empty one none. Special tokens' strings are
    ordinary text. Texts of any length are encoded whole, in linear time. Repeated rows and null ids stay as
    they are; an empty table gives no rows. Only the two columns named are read.
    """

    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        ids, same = _encode_array(texts, ranks_path, check=True)
        return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "round_trip"])

    column = docs[f"`{text}`"]
    coded = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), F.when(column.isNotNull(), run(column)).alias("c"))
    return coded.select("doc_id", F.col("c.ids").alias("token_ids"), F.size("c.ids").alias("n_tokens"), F.col("c.round_trip").alias("round_trip"))


def with_token_ids(docs: DataFrame, text: str = "text", name: str = "token_ids", ranks_path: str = vocabulary.DEFAULT_RANKS) -> DataFrame:
    """docs with the ids of its texts as one more column, which takes the place of one so named.

    A null text has null ids, an empty one none; rows, ties and repeats stay as they are, texts of any length
    count whole, and an empty table stays empty. No other column is touched.
    """
    return docs.withColumn(name, encode_column(docs[f"`{text}`"], ranks_path))


def oracle(ranks_path: str = vocabulary.DEFAULT_RANKS) -> str:
    """bpe_encode() as DuckDB SQL, by the merges themselves; the ids as one text."""
    steps = ["o AS MATERIALIZED (SELECT *, row_number() OVER () AS own FROM documents)", *tokens_sql.stages("SELECT own AS key, text AS body FROM o", ranks_path)]
    return (
        "WITH RECURSIVE " + ",\n".join(steps) + "\nSELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(ids, ' '), '') END AS token_ids, "
        "CASE WHEN text IS NOT NULL THEN coalesce(len(ids), 0) END::INT AS n_tokens, CASE WHEN text IS NOT NULL THEN true END AS round_trip FROM o LEFT JOIN encoded ON key = own"
    )
