import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import ngram_join, shingling


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(docs, numerator):
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= numerator * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def corpus(seed, groups, copies, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(4)]
    texts = [None, "", " \n", "one two", "One TWO", "a b c d e", "éA É x y z", "éa É x y z", "a b c d e f", "a b c d e f g h i j", "a b c d e f g h i j k"]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))] + rng.choice([[], *common]) * (rng.random() < 0.6)
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[: rng.randint(3, len(words))]
            texts.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("chunk", "groups", "copies", "rare", "common", "numerator"), [(512, 60, 12, 16, 256, 80), (16, 6, 70, 3, 12, 80), (8, 20, 20, 1, 4, 60)])
def test_like_brute_force(spark, monkeypatch, chunk, groups, copies, rare, common, numerator):
    """Small bounds bring pairs and triples, chunks and open blocks into play."""
    from tessella.llm import minhash

    for module, name, value in ((minhash, "CHUNK", chunk), (ngram_join, "CHUNK", chunk), (minhash, "PIVOTS", 2)):
        monkeypatch.setattr(module, name, value)
    docs = corpus(chunk, groups, copies, 6)
    df = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, node string, token int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, numerator, rare, common).collect()}
    assert got == brute(docs, numerator)


@pytest.mark.parametrize("numerator", [50, 80, 85, 100])
@pytest.mark.parametrize(("rare", "common"), [(1, 2), (2, 3), (4, 30), (1, 10**9)])
def test_every_link_shares_a_key(numerator, rare, common):
    """Without Spark: all pairs of generated sets that link have an index key in common, whatever the classes."""
    rng = random.Random(numerator + rare)
    sets = []
    for _ in range(25):
        base = [rng.getrandbits(63) for _ in range(rng.choice([3, 20, 62, 66, 100, 124, 130, 400]))]
        for _ in range(8):
            drop, more = rng.randint(0, len(base) // 4), rng.randint(0, len(base) // 8)
            sets.append(set(rng.sample(base, len(base) - drop)) | {rng.getrandbits(63) for _ in range(more)})
    df = Counter(t for s in sets for t in s)
    keys, most = [], []
    for s in sets:
        shared = sorted((df[t], t) for t in s if df[t] > 1)
        tokens, counts = np.array([t for _, t in shared], np.uint64), np.array([c for c, _ in shared], np.int64)
        keys.append(set(ngram_join.prefix_keys(tokens, counts, len(s), numerator, rare, common).tolist()))
        most.append((100 + numerator) * len(shared) // numerator - len(s))
    linked = 0
    for a, b in combinations(range(len(sets)), 2):
        common_tokens = len(sets[a] & sets[b])
        if 100 * common_tokens >= numerator * len(sets[a] | sets[b]):
            linked += sets[a] != sets[b]
            assert keys[a] & keys[b]
            small, large = sorted((a, b), key=lambda i: len(sets[i]))
            assert most[small] >= len(sets[large]) and most[large] >= len(sets[small])
    assert linked > 5 or numerator == 100


def test_keys_in_proportion_to_the_size():
    """A long document of nothing but frequent tokens has few combinations, not their square."""
    rng = np.random.default_rng(1)
    for n in (100, 1000, 20_000):
        for df in (100, 10_000):
            keys = ngram_join.prefix_keys(rng.integers(0, 1 << 63, n, dtype=np.uint64), np.full(n, df), n, 80)
            assert len(keys) < 4 * n


def test_edge_cases(spark):
    docs = [(4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (None, "a b c d e f"), (None, None), (5, None), (6, "x y z"), (6, "a b c d e f")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = ngram_join.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id) == [(4, 4), (4, 4), (5, 5), (6, 4), (6, 6), (9, 4)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_shingles_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcÉé語") * rng.randint(1, 12) for _ in range(rng.randint(0, 9))) * rng.randint(0, 2) for _ in range(300)]
    texts += [None, "", " ", "\n\tLong" * 50, "x" * 9000, "A b", "a B"]
    array = pa.array(texts)
    whole, counts = shingling.shingle_sets(array)
    assert counts.tolist() == [len(shingle_set(t)) for t in texts]
    monkeypatch.setattr(shingling, "PIECE", 7)
    pieces, again = shingling.shingle_sets(array.slice(0))
    assert (whole == pieces).all() and (counts == again).all()
    part, n = shingling.shingle_sets(array.slice(100, 50))
    assert (part == whole[counts[:100].sum() : counts[:150].sum()]).all()
    first = np.cumsum(counts) - counts
    as_sets = {}
    for i, t in enumerate(texts):
        as_sets.setdefault(shingle_set(t), set()).add(whole[first[i] : first[i] + counts[i]].tobytes())
    assert all(len(v) == 1 for v in as_sets.values()) and len({v for s in as_sets.values() for v in s}) == len(as_sets)


def test_numbers_of_sets_are_those_of_spark(spark):
    digests = [bytes(range(16)), bytes(16), b"\xff" * 16]
    rows = spark.createDataFrame([(bytearray(d),) for d in digests], "d binary").selectExpr("xxhash64(d) AS h").collect()
    assert ngram_join.set_numbers(digests).tolist() == [r.h for r in rows]
