import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import CLASHING, ROWS, empty, messy

from lexward.llm import near_dedup as N
from lexward.llm import simhash
from lexward.llm.components import components


def prints(texts):
    a = simhash.fingerprints(pa.array(texts, pa.string()))
    words = np.stack([a.field(i).to_numpy(zero_copy_only=False) for i in range(5)], 1).astype(np.int64).view(np.uint64)
    return words, a.is_valid().to_numpy(zero_copy_only=False)


def roots_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def brute(ids, texts):
    """(doc_id, keep) by comparing every pair of fingerprints."""
    words, known = prints(texts)
    pairs = []
    for i in range(len(texts)):
        x = words[i, :3] ^ words[:, :3]
        shared = (x.copy().view(np.uint8).reshape(len(words), 24) == 0).sum(1)
        near = (shared >= N.MIN_SHARED) & (np.bitwise_count(x).sum(1, dtype=int) <= N.MAX_WORD_BITS) & (simhash.distances(words[i, 3:][None], words[:, 3:]) <= N.MAX_PAIR_BITS)
        pairs += [(i, j) for j in np.flatnonzero(near & known) if j > i and known[i]]
    order = np.argsort(ids)
    place = {int(p): k for k, p in enumerate(order)}
    roots = roots_of(len(texts), [(place[i], place[j]) for i, j in pairs])
    return {(ids[order[k]], ids[order[r]]) for k, r in enumerate(roots) if k != r}


def edited(text, rng, share=0.03):
    words = text.split(" ")
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = rng.choice(("changed", "word", "here"))
    return " ".join(words)


def corpus(n=120, copies=3):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = []
    for _ in range(n):
        base = " ".join(rng.choices(vocabulary, k=rng.randint(60, 400)))
        texts += [base, *(edited(base, rng) for _ in range(copies - 1))]
    ids = list(range(1, len(texts) + 1))
    rng.shuffle(ids)
    return ids, texts


def test_index_equals_all_pairs(spark):
    ids, texts = corpus()
    docs = messy(spark, [(i, t, "en", "web") for i, t in zip(ids, texts)])
    got = {tuple(r) for r in N.near_duplicates(docs).collect()}
    assert got == brute(ids, texts)
    groups = [ids[k : k + 3] for k in range(0, len(ids), 3)]
    wanted = {(i, min(g)) for g in groups for i in g if i != min(g)}
    assert len(wanted & got) / len(wanted) >= 0.95  # recall of planted copies
    assert not got - wanted  # and nothing else


def all_pairs(words):
    """Verified pairs among all, without any condition of the index."""
    out = []
    for i in range(len(words)):
        near = (simhash.distances(words[i, :3][None], words[i + 1 :, :3]) <= N.MAX_WORD_BITS) & (simhash.distances(words[i, 3:][None], words[i + 1 :, 3:]) <= N.MAX_PAIR_BITS)
        out += [(i, i + 1 + int(j)) for j in np.flatnonzero(near)]
    return out


def indexed(words, wide=False):
    """Edges of all lists of the index."""
    octets = words[:, :3].copy().view(np.uint8).reshape(len(words), 24)
    out = []
    for key in N.keys_of(wide):
        of = [tuple(r) for r in octets[:, list(key)]]
        for value in sorted(set(of)):
            rows = np.array([i for i, v in enumerate(of) if v == value])
            a, b = N.list_forest(words[rows], N.list_positions(key))
            out += [(int(x), int(y)) for x, y in zip(rows[a], rows[b])]
    return out


@pytest.mark.parametrize(("low", "high"), [(8, 20), (20, 60), (60, 200), (200, 600)])
def test_recall_against_all_pairs(low, high):
    """Of the verified pairs among all, those that the index connects; by length of text."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    bases = [" ".join(rng.choices(vocabulary, k=rng.randrange(low, high))) for _ in range(400)]
    words, _ = prints([t for b in bases for t in (b, edited(b, rng, 0.06), edited(b, rng, 0.12))])
    verified = all_pairs(words)
    roots = roots_of(len(words), indexed(words))
    joined = [roots[a] == roots[b] for a, b in verified]
    assert roots_of(len(words), verified) == roots_of(len(words), verified + list(enumerate(roots)))  # nothing else is connected
    assert np.mean(joined) >= 0.97
    shared = [(words[a, :3] ^ words[b, :3]).view(np.uint8).tolist().count(0) for a, b in verified]
    print(low, high, "pairs that share bytes enough", np.mean(np.array(shared) >= N.MIN_SHARED), "connected", np.mean(joined))
    assert np.mean(np.array(shared) >= N.MIN_SHARED) >= 0.9


def test_few_differing_bits_are_always_found():
    """Up to 21 bits leave three bytes untouched, whichever they are."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        words = rng.integers(0, 1 << 63, (2, 5)).astype(np.uint64)
        words[1] = words[0]
        octets = words[1:, :3].view(np.uint8)
        for bit in rng.choice(192, 21, replace=False):
            octets[0, bit // 8] ^= np.uint8(1 << bit % 8)
        assert indexed(words)


def test_long_runs_equal_pairs(monkeypatch):
    """Rows of a hot group meet only what they aren't connected with; the outcome is that of all pairs."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (6, 5)).astype(np.uint64)
    words = np.repeat(base, 60, axis=0)
    octets = words.view(np.uint8)
    for row in octets:
        for bit in rng.choice(np.arange(64, 192), rng.integers(0, 34), replace=False):
            row[bit // 8] ^= np.uint8(1 << bit % 8)
    pairs = N.list_positions((0,))
    outcomes = []
    for short in (1, 3, 10_000):
        monkeypatch.setattr(N, "_SHORT_RUN", short)
        outcomes.append(roots_of(len(words), list(zip(*map(np.ndarray.tolist, N.list_forest(words, pairs))))))
    assert outcomes[0] == outcomes[1] == outcomes[2]
    assert len(set(outcomes[0])) < 60


def test_any_three_positions_have_a_list():
    """Of pairs that share three bytes a list holds all, whichever the bytes and however long the runs."""
    found = set()
    for key in N.keys_of(False):
        found |= {tuple(sorted((key[0], j, k))) for j, further in N.list_positions(key) for k in further}
    assert found == set(itertools.combinations(range(24), 3))
    assert sorted((k[0], j) for k in N.keys_of(False) for j, _ in N.list_positions(k)) == sorted(N.keys_of(True))


@pytest.mark.parametrize(("short", "long"), [(1, 1), (3, 5), (3, 50), (10_000, 10_000)])
@pytest.mark.parametrize("wide", [False, True])
def test_runs_of_any_length_equal_all_pairs(monkeypatch, short, long, wide):
    """Hot groups and others among rows that agree on many bytes, with blocks of a few rows and of many."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, (40, 5)).astype(np.uint64)
    words = np.concatenate([np.repeat(base[:1], 60, axis=0), np.repeat(base[1:2], 30, axis=0), np.repeat(base[2:], 3, axis=0)])
    octets = words.view(np.uint8)
    for row in octets:
        for bit in rng.choice(np.arange(320), rng.integers(0, 40), replace=False):
            row[bit // 8] ^= np.uint8(1 << bit % 8)
    octets[:, [1, 4, 14]] &= 1  # few values, so that rows of different groups meet
    verified = [p for p in all_pairs(words) if (words[p[0], :3] ^ words[p[1], :3]).view(np.uint8).tolist().count(0) >= N.MIN_SHARED]
    monkeypatch.setattr(N, "_SHORT_RUN", short)
    monkeypatch.setattr(N, "_LONG_RUN", long)
    monkeypatch.setattr(N, "_CELLS", 10 * long)
    monkeypatch.setattr(N, "_FOUND_PAIRS", 10 * long)
    assert roots_of(len(words), indexed(words, wide)) == roots_of(len(words), verified)


def test_long_runs_cost_little(monkeypatch):
    """Rows that agree on two bytes, as most lists of a large table have them, are told apart without being verified."""
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 63, (3000, 5)).astype(np.uint64)
    words.view(np.uint8)[:, [0, 1, 20]] = 7
    verified = []
    similar = N._similar
    monkeypatch.setattr(N, "_similar", lambda w, a, b: verified.append(len(a)) or similar(w, a, b))
    a, _ = N.list_forest(words, N.list_positions((0,)))
    assert not len(a) and sum(verified) < 3000 * 2999 / 2 / 100


def test_connected_rows_of_middle_runs_meet_once(monkeypatch):
    """A group too small for a long run comes to a run at many places; once connected, its rows aren't compared again."""
    rng = np.random.default_rng(11)
    words = np.concatenate([np.repeat(rng.integers(0, 1 << 63, (1, 5)).astype(np.uint64), 1200, axis=0), rng.integers(0, 1 << 63, (100, 5)).astype(np.uint64)])
    octets = words.view(np.uint8)
    for row in octets[:1200]:
        for bit in rng.choice(np.arange(96, 320), 12, replace=False):
            row[bit // 8] ^= np.uint8(1 << bit % 8)
    octets[1200:, :12] = octets[0, :12]  # others in the group's runs
    assert N._SHORT_RUN < len(words) <= N._LONG_RUN
    compared, alike = [], N._alike

    def counted(x, y):
        out = alike(x, y)
        compared.append(out.size)
        return out

    monkeypatch.setattr(N, "_alike", counted)
    a, b = N.list_forest(words, N.list_positions((0,)))
    assert roots_of(len(words), zip(a.tolist(), b.tolist())) == [0] * 1200 + list(range(1200, 1300))
    assert sum(compared) < 2 * 1200 * 1200


def test_wide_lists_and_blocks_give_the_same(spark, monkeypatch):
    ids, texts = corpus(30)
    docs = messy(spark, [(i, t, "en", "web") for i, t in zip(ids, texts)])
    narrow = {tuple(r) for r in N.near_duplicates(docs).collect()}
    monkeypatch.setattr(N, "BLOCK_ROWS", 3)
    assert {tuple(r) for r in N.near_duplicates(docs).collect()} == narrow
    monkeypatch.setattr(N, "WIDE_FROM", 0)
    assert {tuple(r) for r in N.near_duplicates(docs).collect()} == narrow


def test_given_documents_equal_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    table = docs.select("doc_id", "text").toPandas()
    assert {tuple(r) for r in N.near_duplicates(docs).collect()} == brute(table["doc_id"].tolist(), table["text"].tolist())


def test_messy(spark):
    got = sorted(map(tuple, N.near_duplicates(messy(spark)).collect()))
    assert got == [(2, 1), (8, 7)]
    kept = N.drop_near_duplicates(messy(spark))
    assert kept.columns == ["doc_id", "text", "lang", "source", *CLASHING]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in ROWS if r[0] not in (2, 8)), key=repr)


def test_empty(spark):
    assert N.near_duplicates(empty(spark)).collect() == []
    assert N.drop_near_duplicates(empty(spark)).collect() == []


def test_one_id_with_two_texts_is_one_document(spark):
    ids, texts = corpus(2, 1)
    docs = messy(spark, [(1, texts[0], "en", "web"), (2, texts[0], "en", "web"), (2, texts[1], "en", "web"), (3, texts[1], "en", "web")])
    assert sorted(map(tuple, N.near_duplicates(docs).collect())) == [(2, 1), (3, 1)]


def test_batches_change_nothing():
    _, texts = corpus(10)
    whole, _ = prints(texts)
    assert (whole == np.concatenate([prints([t])[0] for t in texts])).all()


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 420)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u bigint, v bigint"))[0].collect()}
    roots = roots_of(421, pairs)
    assert got == {i: r for i, r in enumerate(roots) if i != r}
