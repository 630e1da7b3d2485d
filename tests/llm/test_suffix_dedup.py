import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import suffix_dedup as sd


def brute(docs):
    raws = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(r[i : i + 200] for _, r in raws for i in range(len(r) - 199))
    out = []
    for d, r in raws:
        keep = bytearray(b"\1" * len(r))
        for i in range(len(r) - 199):
            if count[r[i : i + 200]] > 1:
                keep[i : i + 200] = bytes(200)
        left = bytes(b for b, k in zip(r, keep) if k)
        spans = sum(1 for i in range(len(r)) if not keep[i] and (i == 0 or keep[i - 1]))
        out.append((d if d is not None else -1, len(r), len(r) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(30, 90)) for _ in range(6)]
    docs = [None, "", "a" * 150, "a" * 199, "b" * 200, "b" * 200, "c" * 900, "xy" * 500, "\0" * 400]
    for _ in range(120):
        parts = [text(rng.randint(5, 120)) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, 20)
            parts.insert(rng.randrange(len(parts) + 1), p[cut : len(p) - rng.randint(0, 20)])
        docs.append(" ".join(parts))
    junk = [" ".join(word() for _ in range(4)) for _ in range(4)]
    docs += [f"{text(20)} {(j + ' ') * rng.randint(3, 60)}{text(5)}" for j in junk for _ in range(4)]
    docs += rng.sample(docs[9:], 15)
    for d in rng.sample(docs[9:], 30):
        i = rng.randrange(len(d) + 1)
        docs.append(d[:i] + "#" + d[i:])
    return list(enumerate(docs))


@pytest.mark.parametrize("most", [4096, 3])
def test_like_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(sd, "MOST", most)
    docs = [*corpus(most), (None, "d" * 500)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, pos int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df).collect())
    assert got == brute(docs)


def test_repeated_rows_and_empty(spark):
    body = "".join(random.Random(1).choice("abc ") for _ in range(500))
    df = spark.createDataFrame([(1, body), (1, body), (2, "z" * 10)], "doc_id long, text string")
    assert sorted(r.n_removed for r in sd.remove_repeats(df).collect()) == [0, 500, 500]
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(30):
        s = rng.integers(1, 3, rng.integers(2, 60)).astype(np.int16)
        n = len(s)
        lcp = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or s[i + k] != s[j + k]), n)
        want = [max(lcp(i, j) for j in range(n) if j != i) for i in range(n)]
        assert sd.matching_statistics(s, 64).tolist() == want


def test_groups_of_contexts():
    rng = random.Random(6)
    for _ in range(15):
        parts = ["".join(rng.choice("ab") for _ in range(120)) for _ in range(4)]
        bodies = ["".join(rng.choice(parts) for _ in range(3))[rng.randrange(90) :].encode() for _ in range(30)]
        groups = [rng.randrange(4) for _ in bodies]
        got = sd.repeated(bodies, groups)
        for body, g, spans in zip(bodies, groups, got):
            count = Counter(b[i : i + 200] for b, x in zip(bodies, groups) if x == g for i in range(len(b) - 199))
            assert spans == sd.merged([(i, i + 200) for i in range(len(body) - 199) if count[body[i : i + 200]] > 1])


def test_segments(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd") for _ in range(n)) for n in (150, 200, 5000, 999)]
    whole = sd.anchors(texts)
    monkeypatch.setattr(sd, "SEGMENT", 97)
    monkeypatch.setattr(sd, "BLOCK", 700)
    cut = sd.anchors(texts)
    assert all((whole[k] == cut[k]).all() for k in whole)
