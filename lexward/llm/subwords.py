"""A linear classifier of texts over hashed subword vectors, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lexward.llm.common import byte_slices, joined, plain, words_of

#: Hash buckets that words and character n-grams share; a vector is learned for each. The first two are for pairs of
#: neighbouring words, told apart only by whether both are the same word: learned as all others, with no weight of their own.
BUCKETS = 1 << 17
NGRAMS = (3, 4, 5)

#: Bytes of text whose features are at hand at once; small, as every byte makes some 60 of them.
_SLICE = 512 << 10

_PAIRS = 2


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 32-bit finaliser, over uint32 values."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint32(seed * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        return x


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x % np.uint32(BUCKETS - _PAIRS)).astype(np.int32) + _PAIRS


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every feature of the words: each word whole and its n-grams, ends marked."""
    if not len(words):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    chars = np.frombuffer(("<" + joined(words, ">\n<") + ">\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = chars == 10
    owner = np.cumsum(breaks, dtype=np.int32) - breaks
    ends = np.flatnonzero(breaks).astype(np.int32)
    indexes, buckets = [], []
    rolled = chars.copy()
    with np.errstate(over="ignore"):
        for n in range(2, max(NGRAMS) + 1):
            rolled = rolled[:-1] * np.uint32(0x01000193) + chars[n - 1 :]
            if n in NGRAMS:
                room = ends[owner[: len(rolled)]] - np.arange(len(rolled), dtype=np.int32) >= n
                indexes.append(owner[: len(rolled)][room])
                buckets.append(_bucket(_mixed(rolled[room], n)))
        # A whole word: a sum of its characters, mixed with their places.
        starts = np.concatenate([np.zeros(1, np.int32), ends[:-1] + 1])
        place = (np.arange(len(chars), dtype=np.int32) - starts[owner]).astype(np.uint32)
        own = _mixed(np.add.reduceat(_mixed(chars ^ place * np.uint32(0x85EBCA6B), 1), starts, dtype=np.uint32), 2)
    indexes.append(np.arange(len(words), dtype=np.int32))
    buckets.append(_bucket(own))
    return np.concatenate(indexes), np.concatenate(buckets)


def _pairs(docs: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every pair of neighbouring words: one bucket for those of equal words, one for the others."""
    inside = np.flatnonzero(docs[1:] == docs[:-1])
    return docs[inside], (codes[inside] == codes[inside + 1]).astype(np.int32)


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and how often each occurs."""
    out = []
    for start, stop in byte_slices(texts, _SLICE):
        docs, codes, words = words_of(texts[start:stop])
        index, bucket = word_features(words)
        order = np.argsort(index, kind="stable")
        index, bucket = index[order], bucket[order]
        edges = np.searchsorted(index, np.arange(len(words) + 1))
        spans = np.searchsorted(docs, np.arange(stop - start + 1))
        of, pair = _pairs(docs, codes)
        pair_spans = np.searchsorted(of, np.arange(stop - start + 1))
        for i in range(stop - start):
            own, times = np.unique(codes[spans[i] : spans[i + 1]], return_counts=True)
            sizes = edges[own + 1] - edges[own]
            at = np.repeat(edges[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            both = np.concatenate([bucket[at], pair[pair_spans[i] : pair_spans[i + 1]]])
            some, where = np.unique(both, return_inverse=True)
            counts = np.bincount(where, np.concatenate([np.repeat(times, sizes), np.ones(len(both) - len(at))]), len(some))
            out.append((some.astype(np.int32), counts.astype(np.float32)))
    return out


@dataclass
class Model:
    """Score of each bucket for class 1 against class 0, and the bias: what the two matrices come to."""

    scores: np.ndarray
    bias: float

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """P(class 1) of each text; the softmax of two classes. A text without a word has the bias alone."""
        texts = plain(texts)
        margins = np.zeros(len(texts))
        for start, stop in byte_slices(texts, _SLICE):
            n = stop - start
            docs, codes, words = words_of(texts[start:stop])
            index, bucket = word_features(words)
            sums = np.bincount(index, self.scores[bucket], len(words))
            sizes = np.bincount(index, minlength=len(words))
            of, pair = _pairs(docs, codes)
            total = np.bincount(docs, sums[codes], n) + np.bincount(of, self.scores[pair], n)
            count = np.bincount(docs, sizes[codes], n) + np.bincount(of, minlength=n)
            margins[start:stop] = np.divide(total, count, out=np.zeros(n), where=count > 0)
        return 1 / (1 + np.exp(-np.clip(margins + self.bias, -60, 60)))


def train(texts: pa.Array, classes: np.ndarray, dim: int = 16, epochs: int = 6, rate: float = 0.3, seed: int = 7) -> Model:
    """Learn bucket vectors and a softmax layer by stochastic gradient descent, one text at a step.

    Classes weigh the same in all. With one class only, or no text, the model says that class (or 1) always.
    """
    classes = np.asarray(classes, np.int64)
    n = np.bincount(classes, minlength=2)
    if not n.all():
        return Model(np.zeros(BUCKETS, np.float32), 30.0 if n[1] >= n[0] else -30.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    data = [(b, (c / c.sum()).astype(np.float32)) if len(b) else (b, c.astype(np.float32)) for b, c in bags(plain(texts))]
    weight = len(classes) / (2.0 * n)
    steps, done = epochs * len(data), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            bucket, share = data[i]
            own = vectors[bucket]
            hidden = share @ own
            logits = output @ hidden + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[classes[i]] -= 1
            lr = rate * weight[classes[i]] * (1 - done / steps)
            # A feature's own step grows with the root of its share: rare and frequent ones both learn.
            vectors[bucket] = own - (lr * np.sqrt(share))[:, None] * (error @ output)
            output -= lr * np.outer(error, hidden)
            bias -= lr * error
            done += 1
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))
