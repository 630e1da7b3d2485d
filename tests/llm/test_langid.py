import random
import zlib

import numpy as np

from tessella.llm import langid


def test_gradients():
    rng = np.random.default_rng(0)
    network = langid.Network.fresh(["a", "b", "c"], rng)
    data, label = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    for array in network.parameters():
        array += 0.1 * rng.standard_normal(array.shape).astype(np.float32)
    _, grads = network.gradients(data, label)
    for p, g in zip(network.parameters(), grads):
        for i in {int(x) for x in np.argsort(-np.abs(g).ravel())[:3]}:
            old, eps = p.flat[i], 2e-2
            p.flat[i] = old + eps
            up = network.gradients(data, label)[0]
            p.flat[i] = old - eps
            down = network.gradients(data, label)[0]
            p.flat[i] = old
            assert abs((up - down) / (2 * eps) - g.flat[i]) < 2e-3 + 0.05 * abs(g.flat[i])


def sample(rng, lang):
    syllables = {"aa": ["ka", "mo", "ri"], "bb": ["sch", "ung", "ein"], "cc": ["été", "oux", "le"]}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, sample(rng, lang := rng.choice(["aa", "bb", "cc"])), lang if i % 5 else None, lang) for i in range(600)]
    rows += [(1000, None, "aa", ""), (1001, "", "aa", ""), (1002, "12 34 !!", "bb", ""), (None, "ka mo ri", "aa", "aa"), (5, rows[5][1], rows[5][2], rows[5][3])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = langid.identify(df).collect()
    truth = {r[0]: r[3] for r in rows}
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held if truth[r.doc_id]]) > 0.97
    assert {r.lang_pred for r in out if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.drop("lang").withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


def test_long_texts_are_read_whole():
    rng = np.random.default_rng(2)
    network = langid.Network.fresh(["a", "b"], rng)
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, 128 * 5000 + 17))
    both = langid.classify(network, [text[:128], text, "x"])
    assert both[0] == langid.classify(network, [text[:128]])[0]
    parts = langid.classify(network, [text[i : i + 128] for i in range(0, len(text), 128)])
    weights = [128] * 5000 + [17]
    a = sum(w * (s if p == "a" else 1 - s) for w, (p, s) in zip(weights, parts)) / len(text)
    assert abs((both[1][1] if both[1][0] == "a" else 1 - both[1][1]) - a) < 1e-4


def test_every_language_is_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "PER_LANGUAGE", 3)
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.append((texts, langs)))
    rows = [(i, f"text {i}", f"l{i % 90}") for i in range(900)] + [(5000 + i, "rare", "rare") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.learn(df)
    free = {r.doc_id: r.lang for r in df.where(~langid.held_out()).collect()}
    order = {r.doc_id: r.h for r in df.select("doc_id", langid.F.xxhash64("doc_id", langid.F.lit(langid.SEED)).alias("h")).collect()}
    want = {lang: sorted((d for d, x in free.items() if x == lang), key=order.get)[:3] for lang in set(free.values())}
    assert len(want) == 91
    texts, langs = seen[0]
    assert sorted(zip(langs, texts)) == sorted((lang, "rare" if lang == "rare" else f"text {d}") for lang, ds in want.items() for d in ds)


def test_many_languages_are_scored_alike():
    rng = np.random.default_rng(3)
    network = langid.Network.fresh([f"l{i}" for i in range(300)], rng)
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, 128 * 700))
    whole, half = langid.classify(network, [text, text[: 128 * 300]])
    alone = langid.classify(network, [text[: 128 * 300]])[0]
    assert half[0] == alone[0] and abs(half[1] - alone[1]) < 1e-6 and whole[0] in network.languages


def by_loops(network, text):
    """(language, score) of a text by loops over its bytes, one number at a time."""
    from math import exp, tanh

    h = langid.HIDDEN
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    raw = text.encode()
    sums = [0.0] * len(network.languages)
    for begin in range(0, len(raw), 128):
        segment = raw[begin : begin + 128].ljust(128, b" ")
        states = []
        for d, places in ((0, range(128)), (1, range(127, -1, -1))):
            w, u, b = (x.tolist() for x in (network.inputs[d], network.recurrent[d], network.bias[d]))
            state, found = [0.0] * h, {}
            for t in places:
                hidden = [sum(u[i][j] * state[j] for j in range(h)) for i in range(3 * h)]
                gate = [0.5 + 0.5 * tanh(w[i][segment[t]] + hidden[i]) for i in range(2 * h)]
                new = [tanh(w[2 * h + i][segment[t]] + gate[h + i] * (hidden[2 * h + i] + b[i][0])) for i in range(h)]
                state = [gate[i] * state[i] + (1 - gate[i]) * new[i] for i in range(h)]
                found[t] = state
            states.append(found)
        out, bias = network.output.tolist(), network.output_bias.tolist()
        for t in range(min(128, len(raw) - begin)):
            both = states[0][t] + states[1][t]
            odds = [exp(sum(a * x for a, x in zip(out[k], both)) + bias[k][0]) for k in range(len(network.languages))]
            sums = [s + o / sum(odds) for s, o in zip(sums, odds)]
    best = max(range(len(sums)), key=lambda k: (sums[k], -k))
    return network.languages[best], sums[best] / len(raw)


def test_predictions_like_loops_over_bytes(spark):
    """The query's whole result, with the network that it learned, against plain loops; ties go to the first language."""
    rng = random.Random(8)
    rows = [(i, sample(rng, lang := rng.choice(["aa", "bb", "cc"])), lang) for i in range(90)]
    rows += [(200, "été " * 90, None), (201, "k" * 128, None), (202, "k" * 129, None), (203, "ümlaut 語 😀", None), (204, "x", None), (205, None, None), (206, " 1 ", None), (None, "schung", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = langid.learn(df)
    got = {(r.doc_id, r.held_out): (r.lang_pred, r.score) for r in langid.identify(df, network).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        want, score = by_loops(network, text)
        lang, found = got[doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2]
        assert lang == want and abs(found - score) < 1e-4
    even = langid.Network.fresh(["a", "b"], np.random.default_rng(0))
    even.output[:] = 0
    assert langid.classify(even, ["tie"]) == [("a", 0.5)] and by_loops(even, "tie") == ("a", 0.5)
