"""SimHash fingerprints of texts, over numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexward.llm.common import PUNCTUATION, byte_slices, hash_words, mix, plain, words_of

#: Bytes of the part over words, which the index uses, and of the part over word pairs; fields of 8 bytes each.
WORD_BYTES = 24
PAIR_BYTES = 16
WORD_FIELDS = ("w0", "w1", "w2")
FIELDS = (*WORD_FIELDS, "p0", "p1")

#: Bytes of text whose words are hashed together, and rows of bits that are summed at once.
_SLICE = 512 << 10
_ROWS = 1 << 14

#: For each byte its bits, spread over the eight bytes of a word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def _majority(hashes: np.ndarray, weights: np.ndarray, docs: np.ndarray, n: int, octets: int) -> np.ndarray:
    """For each document the bits (octets bytes) that more than half of its weight sets; docs is ascending, weights are small.

    Eight counters of a byte are added at once: runs of rows whose weights stay below 256 are summed so, and
    the runs' sums are then added up as integers.
    """
    if len(weights) and weights.max() > 100:  # a heavy row counts as several lighter ones
        times = -(-weights // 100)
        last = weights - 100 * (times - 1)
        hashes, docs = np.repeat(hashes, times), np.repeat(docs, times)
        weights = np.full(len(hashes), 100, np.int64)
        weights[np.cumsum(times) - 1] = last
    sums, total = np.zeros((n, 8 * octets), np.int32), np.zeros(n, np.int64)
    for a in range(0, len(hashes), _ROWS):
        h, w, d = hashes[a : a + _ROWS], weights[a : a + _ROWS], docs[a : a + _ROWS]
        wide = np.stack([h, *(mix(h, 7 + 2 * i) for i in range(octets // 8 - 1))], axis=1).view(np.uint8)
        lanes = _SPREAD[wide]
        lanes *= w.astype(np.uint64)[:, None]
        firsts = np.flatnonzero(np.diff(d, prepend=-1))
        before = np.cumsum(w) - w
        before -= np.repeat(before[firsts], np.diff(np.append(firsts, len(d))))
        runs = before // (255 - int(w.max()))
        starts = np.flatnonzero((np.diff(d, prepend=-1) != 0) | (np.diff(runs, prepend=-1) != 0))
        counted = np.add.reduceat(lanes, starts, axis=0).view(np.uint8)
        owners = d[starts]
        groups = np.flatnonzero(np.diff(owners, prepend=-1))
        sums[owners[groups]] += np.add.reduceat(counted, groups, axis=0, dtype=np.int32)
        total[d[firsts]] += np.add.reduceat(w, firsts)
    return np.packbits(2 * sums > total[:, None], axis=1)


def _slice_fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    docs, codes, words = words_of(texts)
    n = len(texts)
    bare = pc.utf8_trim(pc.utf8_lower(words), characters=PUNCTUATION)
    bare = bare.dictionary_encode()
    hashes = hash_words(bare.dictionary)
    lengths = pc.binary_length(bare.dictionary).to_numpy(zero_copy_only=False)
    codes = bare.indices.to_numpy()[codes]
    real = lengths[codes] > 0
    docs, codes = docs[real], codes[real]
    own = hashes[codes]
    some = np.zeros(n, bool)
    some[docs] = True
    # Words, weighted by twice the square root of their number in the document, rounded.
    keys = np.sort(docs.astype(np.int64) * max(len(hashes), 1) + codes)
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    d, c = np.divmod(keys[at], max(len(hashes), 1))
    first = _majority(hashes[c], np.rint(2 * np.sqrt(np.diff(np.append(at, len(keys))))).astype(np.int64), d, n, WORD_BYTES)
    # Pairs of neighbours, the document's two ends being words of their own.
    ends = np.flatnonzero(np.diff(docs, append=n))
    before = np.roll(own, 1)
    if len(ends):
        before[np.append(0, ends[:-1] + 1)] = 1
    with np.errstate(over="ignore"):
        pairs = mix(before * np.uint64(0x9DDFEA08EB382D69) ^ own, 3)
        tails = mix(own[ends] * np.uint64(0x9DDFEA08EB382D69) ^ np.uint64(2), 3)
    pairs, owners = np.insert(pairs, ends + 1, tails), np.insert(docs, ends + 1, docs[ends])
    second = _majority(pairs, np.ones(len(pairs), np.int64), owners, n, PAIR_BYTES)
    return np.hstack([first, second]), some


def fingerprints(texts: pa.Array) -> pa.Array:
    """Five 64-bit words for each text: 192 bits over its words, then 128 over its pairs; null without a word.

    Words are what white space separates, lower case and without punctuation at their ends. All words of a
    text count, however long it is.
    """
    texts = plain(texts)
    parts, known = [np.zeros((0, WORD_BYTES + PAIR_BYTES), np.uint8)], [np.zeros(0, bool)]
    for start, stop in byte_slices(texts, _SLICE):
        prints, some = _slice_fingerprints(texts[start:stop])
        parts.append(prints)
        known.append(some)
    data, some = np.concatenate(parts), np.concatenate(known)
    words = np.ascontiguousarray(data).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(words[:, i]) for i in range(len(FIELDS))], list(FIELDS), mask=pa.array(~some))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the rows of two arrays of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
