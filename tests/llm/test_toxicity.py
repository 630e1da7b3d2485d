import random
import zlib

import numpy as np

from tessella.llm import toxicity


def slow_kernel(unit, landmark):
    """Subsequences of three letters by brute force, with their least spans."""

    def features(s):
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.REACH)):
                    if s[i].isalpha() and s[j].isalpha() and s[k].isalpha():
                        key = s[i] + s[j] + s[k]
                        out[key] = max(out.get(key, 0), toxicity.DECAY ** (k - i + 1))
        return out

    a, b = features(unit), features(landmark)
    value = sum(w * a.get(s, 0) for s, w in b.items()) / sum(w * w for w in b.values())
    return min(1, max(0, (value - toxicity.FLOOR) / (1 - toxicity.FLOOR)))


def test_kernel():
    rng = random.Random(1)
    landmarks = ["idiot", "stupid", "moron"]
    kernel = toxicity.Kernel(landmarks)
    units = ["idiot", "idxiot", "stuuupid", "moro", "", "a", *("".join(rng.choice("idotsumrn ") for _ in range(rng.randint(1, 20))) for _ in range(200))]
    got = kernel.rows(units)
    for u, row in zip(units, got):
        assert np.allclose(row, [slow_kernel(u, m) for m in landmarks], atol=1e-5), u
    assert kernel.of(["x" * 100 + "idiot" + "y" * 100])[0, 0] > 0.9


def sample(rng, toxic):
    words = ["".join(rng.choice(["ka", "mo", "ri", "the", "ten", "sul"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(10, 60))]
    if toxic:
        for _ in range(rng.randint(1, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(["grobian", "flegel", "lump" + rng.choice(["en", "ig", "s"])]))
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)


def test_held_out_and_edges(spark):
    rng = random.Random(2)
    docs = [(i, sample(rng, i % 4 == 0), 0) for i in range(800)] + [(2000, None, 0), (2001, "", 0), (2002, "g r o b i a n", 0), (2003, "you gro-bian", 0), (2004, "fleegel", 0), (None, "flegel", 0)]
    labels = [(i, int(i % 4 == 0), 1) for i in range(800) if i % 3]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    out = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    assert len(out) == len(docs)
    held = [r for r in out.values() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held if r.doc_id < 800]) > 0.97
    assert [out[i].predicted for i in (2000, 2001, 2002, 2003, 2004, None)] == [0, 0, 1, 1, 1, 1]
    assert all(0 <= r.score <= 1 for r in out.values())
    assert toxicity.toxicity(df.limit(0), lab).count() == 0
    assert {r.score for r in toxicity.toxicity(df, lab.where("toxic = 0")).collect()} == {0.0}


def test_scores_like_brute_force(spark):
    """Whole scores from plain loops over the tokens; repeated rows and a very long text among them."""
    rng = random.Random(6)
    texts = [sample(rng, i % 3 == 0) for i in range(300)]
    machine = toxicity.train(texts, np.array([i % 3 == 0 for i in range(300)]))
    cases = [*(t.replace(".", "") for t in texts[:40]), "grobian " * 3 + "flegel", "und " * 50_000 + "flegel"]

    def slow(text):
        values = sorted((sum(w * slow_kernel(u, m) for w, m in zip(machine.weights, machine.landmarks)) + machine.bias for u in set(text.split())), reverse=True)
        return 1 / (1 + np.exp(-(machine.slope * sum(v for v in values[: toxicity.TOP] if v > 0) + machine.offset)))

    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate([x for c in cases for x in (c, c)])], "doc_id long, text string")
    rows = toxicity.score_toxicity(docs, machine).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        assert abs(r.score - slow(cases[r.doc_id])) < 1e-3


def test_few_labels_and_long_documents(spark):
    rng = random.Random(8)
    docs = [(i, sample(rng, i % 4 == 0)) for i in range(60)] + [(100, "und " * 9000 + "flegel grobian")]
    labels = [(i, int(i % 4 == 0)) for i in range(60)] + [(100, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    scores = [r.score for r in toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()]
    assert len(set(scores)) > 1 and np.mean([s for i, s in enumerate(scores[:60]) if i % 4 == 0]) > np.mean([s for i, s in enumerate(scores[:60]) if i % 4]) + 0.2
