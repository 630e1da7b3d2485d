import string

from pyspark.sql import functions as F

from tessella.functions import noise as N
from tessella.functions.filters import CONNECTORS
from tessella.operators import synth
from tessella.sources import corpora


def test_fixed_values():
    """Literal values of the behaviour that is matched."""
    assert set(N.SAFE_ACCENTS) == {"en", "es", "fr", "it", "nl", "pt"}
    assert set(N.LETTERS) == {"Latin", "Cyrillic", "Arabic", "Hebrew", "Devanagari", "Bengali"} and set(N.DIGITS_IN) == {"Latin", "Cyrillic", "Arabic"}
    assert N._confused()["a"] == "4@" and N._confused()["S"] == "5$" and N._confused()["g"] == "9" and N._confused()["G"] == "6" and "x" not in N._confused()
    assert set(N.KEYS) == set(string.ascii_lowercase) and N.KEYS["s"] == "adwx" and N.KEYS["p"] == "ol"
    assert N.ACCENTS["n"] == "ñńņň" and not {"q", "x"} & set(N.ACCENTS)
    assert "an" in CONNECTORS and corpora.SMOL_CODES == {"pt-PT": "pt", "yue": "zh", **dict.fromkeys(("ar-MA", "arz", "aeb", "ayl", "apd"), "ar")}
    mixed = synth.KINDS[-1]
    assert (mixed.outside, mixed.swap, synth.SPAN_TOKENS, synth.CODE_TOKENS, synth.RETRIES) == (0.06, 0.06, 40, 120, 8)
    assert "]" in synth.STARTER_SIGNS and {"‣", "⁃", "–", "—"} <= set(synth.STARTER_SYMBOLS) and [len(h) for h in synth.STARTER_HASHES] == [2, 3, 4]


def applied(spark, texts, noise):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r.x for r in rows.select("i", noise(F.col("s"), F.col("i").cast("string")).alias("x")).orderBy("i").collect()]


def test_char_noise_changes_one_letter_of_a_word(spark):
    texts = ["Große Kinder gehen, 12 x nach Hause!"] * 400
    out = applied(spark, texts, lambda s, k: N.char_noise(s, k, 1.0))
    kinds, confused = set(), N._confused()
    for old, new in zip(texts, out):
        assert len(new) == len(old)
        changed = [(a, b) for a, b in zip(old, new) if a != b]
        assert len(changed) <= 1
        for a, b in changed:
            options = {"ocr": set(confused.get(a, "")), "accent": set(N.ACCENTS.get(a.lower(), "")), "key": set(N.KEYS.get(a.lower(), ""))}
            if a.isupper():
                options = {k: {x.upper() for x in v} for k, v in options.items()}
            mine = {k for k, v in options.items() if b in v}
            assert mine
            kinds |= mine
    assert kinds == {"ocr", "accent", "key"} and sum(a != b for a, b in zip(texts, out)) > 300
    assert applied(spark, ["1 2 a b", "", "x"], lambda s, k: N.char_noise(s, k, 1.0)) == ["1 2 a b", "", "x"]
    assert applied(spark, texts[:20], lambda s, k: N.char_noise(s, k, 0.0)) == texts[:20]


def test_signs_stand_between_words(spark):
    texts = ["one", "", "one  two\nthree"] * 60
    for noise, signs in ((lambda s, k: N.digit_noise(s, F.lit("Latin"), k, 1.0), set("0123456789")), (lambda s, k: N.letter_noise(s, F.lit("Latin"), k, 1.0), set(string.ascii_letters))):
        out = applied(spark, texts, noise)
        assert all(a == b for a, b in zip(texts, out) if len(a.split()) < 2)
        put = [b.split() for b in out if len(b.split()) == 4]
        assert len(put) == 60 and {w[0] for w in put} == {"one"} and {w[-1] for w in put} == {"three"}
        assert {x for w in put for x in w[1:3]} - {"two"} <= signs and len({w.index("two") for w in put}) == 2
    for script, some in (("Devanagari", set(N.LETTERS["Devanagari"])), ("Cyrillic", set(N.LETTERS["Cyrillic"] + N.LETTERS["Cyrillic"].upper()))):
        assert {w for b in applied(spark, ["a b"] * 50, lambda s, k: N.letter_noise(s, F.lit(script), k, 1.0)) for w in b.split()[1:2]} <= some
    assert applied(spark, ["a b"] * 20, lambda s, k: N.letter_noise(s, F.lit("Greek"), k, 1.0)) == ["a b"] * 20
    assert applied(spark, ["a b"] * 20, lambda s, k: N.digit_noise(s, F.lit("Devanagari"), k, 1.0)) == ["a b"] * 20


def test_overlong_documents_are_drawn_anew(spark):
    """With one sentence in eight of 300 words, documents of several are too long: they come back with other sentences, whole."""
    rows = [("wiki", lang, f"{lang}s{i} " + " ".join(["wort"] * (300 if i % 8 == 0 else 6))) for lang in ("en", "fr", "de") for i in range(900)]
    df = spark.createDataFrame(rows, "source string, lang string, sentence string")
    out = synth.build(df, 120).collect()
    assert len({r.doc for r in out}) == len(out) == 120
    used = [w for r in out for w in r.original_text.lower().replace("(", " ").split() if w.startswith(("ens", "frs", "des")) and w[3:].isdigit()]
    assert len(used) == len(set(used)) > 200  # no sentence twice
    for r in out:
        assert len(r.tokens) == len(r.ner_tags) <= 510 and len(r.input_ids) == len(r.tokens) + 2
    pure = [r for r in out if r.kind == "spliced"]
    assert all(abs(r.original_text.lower().count("wort") - sum("wort" in t.lower() for t in r.tokens)) <= 8 for r in pure)
    assert any(len(r.tokens) > 300 for r in out)


def test_code_goes_to_mixed_documents_of_one_sentence(spark):
    """Where pools run dry, a mixed document of one sentence gets a span of code, labelled O."""
    demands = [(f"mixed-{i}", s, "en", "main", 1, "mixed", 3) for i in range(4) for s in range(3)]
    wanted = spark.createDataFrame(demands, "doc string, slot int, lang string, pool string, n int, kind string, n_slots int")
    pool = spark.createDataFrame([("main", "en", i, f"sentence number {i} of few") for i in range(10)], "pool string, lang string, idx long, sentence string")
    out = {r.doc: r for r in synth.documents(wanted, pool).collect()}
    assert set(out) == {f"mixed-{i}" for i in range(4)}
    single = out["mixed-3"]
    assert 0 in single.ner_tags and len(single.tokens) > 5 and max(single.ner_tags) > 0
    assert all(set(out[f"mixed-{i}"].ner_tags) - {0} for i in range(4))
