import math
import random

import numpy as np
import xxhash

from tessella.llm import resample
from tessella.llm.hashing import MIX, SEED


def slow_features(text):
    """Buckets of words and word pairs with plain integers."""
    mask = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    h = [xxhash.xxh3_64_intdigest(w.lower().encode(), SEED) for w in (text or "").split()]
    return [x % resample.BUCKETS for x in h] + [mixed(a * int(MIX) + b & mask) % resample.BUCKETS for a, b in zip(h, h[1:])]


def test_like_brute_force(spark, monkeypatch):
    rng = random.Random(0)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(good if i % 3 else bad) for _ in range(rng.randint(0, 40))]
        docs.append((i, " ".join(words) if i % 50 else None, "x"))
        if i % 2:
            labels.append((i, int(i % 3 > 0), 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, key string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    target, raw = np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS)
    wanted = {i for i, q, _ in labels if q}
    for i, t, _ in docs:
        for f in slow_features(t):
            raw[f] += 1
            target[f] += i in wanted
    ratio = [math.log((t + 1) / (target.sum() + resample.BUCKETS) * (raw.sum() + resample.BUCKETS) / (r + 1)) for t, r in zip(target, raw)]
    monkeypatch.setattr(resample, "SMALL", 20)
    monkeypatch.setattr(resample, "BINS", 8)
    for fraction in (0.01, 0.05, 0.3, 1.0):
        out = resample.importance_resample(df, lab, fraction).collect()
        k = math.ceil(fraction * 600)
        for r in out[::37]:
            assert abs(r.log_weight - sum(ratio[f] for f in slow_features(docs[r.doc_id][1]))) < 1e-6
        best = {r.doc_id for r in sorted(out, key=lambda r: (-r.key, r.doc_id))[:k]}
        assert {r.doc_id for r in out if r.kept} == best
        if fraction == 0.3:  # a light share still prefers documents like the targets
            assert sum(d % 3 > 0 for d in best) > 0.85 * k
    kept = resample.importance_resample(df, lab, 0.5).where("kept").count()
    assert kept == 300


def test_edge_cases(spark):
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    assert resample.importance_resample(df, lab, 1.0).where("kept").count() == 4
    assert resample.importance_resample(df, lab.limit(0), 0.5).count() == 4
    assert resample.importance_resample(df.limit(0), lab).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000), (2, "a")], "doc_id long, text string")
    assert resample.importance_resample(long, lab, 0.5).where("kept").count() == 1


def test_kth_with_many_ties(spark, monkeypatch):
    monkeypatch.setattr(resample, "SMALL", 3)
    rows = spark.createDataFrame([(i, 0.0, 1.0) for i in range(50)] + [(99, 0.0, 5.0)], "doc_id long, log_weight double, key double")
    assert resample.kth_largest(rows, 11) == (1.0, 9)
    assert resample.kth_largest(rows, 1) == (5.0, 99)
