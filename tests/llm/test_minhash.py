import random
import re

import numpy as np
import pytest

from tessella.llm import minhash


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(docs):
    sets = {}
    for d, t in docs:
        if d is not None:
            sets[d] = shingle_set(t)
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def corpus(seed, groups, copies, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "one two", "One TWO", "a b c d e", "éA É x y z", "éa É x y z"]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            if rng.random() < 0.3:
                texts.append(" ".join(base).upper())
                continue
            words = list(base)
            for _ in range(rng.randint(1, edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("chunk", "groups", "copies"), [(512, 40, 12), (16, 6, 60)])
def test_like_brute_force(spark, monkeypatch, chunk, groups, copies):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    docs = corpus(chunk, groups, copies, 4)
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, root string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute(docs)


def test_edge_cases(spark):
    docs = [(4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (None, "a b c d e f"), (None, None), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in rows if r.doc_id) == [(4, 4, True), (4, 4, True), (5, 5, True), (9, 4, False)]
    assert len(rows) == 6
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_estimate():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets = [np.concatenate([common, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]) for _ in range(40)]
    codes = minhash.signature(sets)[1]
    values = [minhash.estimate(codes[i : i + 1], codes[i + 1 : i + 2])[0, 0] for i in range(39)]
    assert abs(np.mean(values) - 900 / 1100) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (300, 300)]
    got = dict(minhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


def test_rows_not_ids_are_judged(spark):
    a, b, c = "one two three four five six seven", "some quite different words that stand here alone", "a third text of words that nothing else has"
    docs = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (3, b.upper(), "z"), (4, c, "p"), (4, c, "p"), (None, a, "n"), (None, a, "n"), (5, None, "e"), (5, "", "e"), (6, " ", "e")]
    df = spark.createDataFrame(docs, "doc_id long, text string, single string").withColumn("text_key", minhash.F.lit("clash"))
    kept = sorted((r.doc_id or -1, r.text or "", r.single) for r in minhash.one_of_each(df).collect())
    assert kept == sorted([(1, a, "x"), (1, b, "y"), (4, c, "p"), (-1, a, "n"), (-1, a, "n"), (5, "", "e"), (5, "", "e"), (6, " ", "e")])
    assert minhash.one_of_each(df).columns == df.columns
    rows = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect() if r.n_shingles)
    assert rows == [(-1, 3, None, True), (-1, 3, None, True), (1, 3, 1, True), (1, 4, 1, True), (2, 3, 1, False), (3, 4, 1, False), (4, 5, 4, True), (4, 5, 4, True)]
    assert minhash.one_of_each(df.limit(0)).count() == 0


def template_pages(n, seed=3):
    """Pages that share about 0.77 of their shingles, so that one candidate cluster has next to no links."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(220)]
    out = []
    for i in range(n):
        words = list(base)
        for k in range(6):
            words[rng.randrange(36 * k, 36 * k + 36)] = f"v{rng.randrange(1 << 40)}"
        out.append((i, " ".join(words)))
    return out


def test_template_pages(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 40)
    monkeypatch.setattr(minhash, "SIGNATURES", 64)
    docs = template_pages(300)
    docs += [(1000 + i, docs[i][1] + " end") for i in range(0, 300, 9)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    assert got == brute(docs)


def test_common_counts_agree():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 300), rng.integers(0, 1 << 62, 30, dtype=np.uint64)])) for _ in range(20)]
    s = minhash.Sets(list(range(20)), [c.tobytes() for c in minhash.signature(sets)[1]], [x.tobytes() for x in sets], 85)
    rows, cols = np.arange(5), np.arange(5, 20)
    want = np.array([[len(np.intersect1d(sets[i], sets[j])) for j in cols] for i in rows])
    assert (s.common(rows, cols, np.ones((5, 15), bool)) == want).all()
    few = np.zeros((5, 15), bool)
    few[2, 3] = True
    assert s.common(rows, cols, few)[2, 3] == want[2, 3]
