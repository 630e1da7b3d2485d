import random
import re
from collections import Counter, defaultdict

from tessella.llm import divergence


def brute(rows, least):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in docs.keys() | {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = {s: c for (x, s), c in groups.items() if x == lang}
        p = {}
        for s, c in [*mine.items(), (None, sum(mine.values(), Counter()))]:
            total = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for s, c in mine.items():
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in mine if o != s]
            best = [(p[None][t] - p[s][t], t.encode()) for t in kept if c[t] and p[s][t] > p[None][t]]
            out |= {(lang, s, "pair", i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(best)[:50])}
    return out


def corpus():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("x", "Y", "é", "語", "ß", "ñ")]
    rows = []
    for i in range(400):
        lang = rng.choice(["de", "de", "fr", None, "lone"])
        source = "only" if lang == "lone" else rng.choice(["a", "a", "a", "b", "é", None, "c"])
        rows.append((" ".join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice(["", "!", "\x7f9Zz"]), lang, source))
    return [*rows, (None, "de", "silent"), ("", "void", "u"), ("1 2 3", "void", "v"), ("rare", "void", "w"), *rows[:20]]


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH", 100)
    monkeypatch.setattr(divergence, "PIECE", 16)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, source string, place int, term string").repartition(5)
    for least, groups in ((30, 100), (3, 2)):  # with and without broadcasts
        monkeypatch.setattr(divergence, "GROUPS", groups)
        got = [tuple(r) for r in divergence.divergence(df, least).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, least)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = ("Wort " * 50 + "eins-zwei Straße" + "x" * 100 + " ende").encode()
    assert [w for part in divergence.terms(text) for w in part] == re.findall(rb"[a-z\x80-\xff]+", text.lower())


def test_counts_beyond_long_arithmetic(spark):
    """A count of 10**12 times SCALE doesn't fit in a long."""
    counts = spark.createDataFrame([("de", s, t, n, 40) for s, t, n in [("a", "", 0), ("b", "", 0), ("a", "x", 10**12), ("b", "x", 3), ("b", "y", 10**12 + 7)]], "lang string, source string, term string, n long, documents long")
    rows = divergence.shares(*divergence.wide_vectors(counts))[1].orderBy("term").collect()
    a, b = 10**12 + 10, 10**12 + 20
    assert [r.p for r in rows] == [[1 + 10**9 * (10**12 + 5) // a, 1 + 10**9 * 8 // b], [1 + 10**9 * 5 // a, 1 + 10**9 * (10**12 + 12) // b]]
