import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import filters
from tessella.functions.dims import with_lang
from tessella.operators import membership


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    words = "the of and cities city car cars walks house ES ies haus straße und der die 12 a_b Café women berry berries".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["", None, "the of and the of and"]
    langs = ["sw", "de", "fr", "en", "ru", "af"]
    return with_lang(spark.createDataFrame([(i, langs[i % 6], t) for i, t in enumerate(texts)], "i int, lang string, s string")).cache()


def test_leaks_like_the_rule_by_arrays(spark, rows):
    stop, broad = ["the", "of", "and"], ["city", "car", "walk", "house", "berry", "es"]
    frame = lambda ws: spark.createDataFrame([(w,) for w in [*ws, ws[0]]], "word string")
    lists = [F.array(*map(F.lit, ws)) for ws in (stop, broad)]
    for use in (1, 2):
        want = {r.i: r.leak for r in rows.select("i", filters.english_leak("s", *lists[:use]).alias("leak")).collect()}
        got = {r.i: r.leak for r in membership.english_leaks(rows, "i", "s", frame(stop), *([frame(broad)] if use == 2 else [])).collect()}
        assert got == want and any(want.values()) and not all(want.values())


def test_a_million_words(spark):
    """The filter loses no word of a large dictionary, and lets few others pass."""
    known = spark.range(1_000_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    df = spark.range(4000).select("id", F.concat_ws(" ", F.concat(F.lit("w"), (F.col("id") * 251).cast("string")), F.concat(F.lit("x"), F.col("id").cast("string")), F.concat(F.lit("W"), F.col("id").cast("string"))).alias("s"))
    got = {r.id: r.hits for r in membership.word_hits(df, "id", "s", known).collect()}
    assert got == {i: 1 + (i * 251 < 1_000_000) for i in range(4000)}
    others = spark.range(100_000).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("word"))
    assert membership.maybe_in(others, membership.bloom(known)).count() < 3000
    plan = membership.word_hits(df, "id", "s", known)._jdf.queryExecution().toString()
    assert "array_contains" not in plan


def test_phrases_by_automaton_and_by_join(spark):
    rng = random.Random(2)
    words = "new york city of los angeles san el le mans".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(300)] + [None, ""]
    phrases = ["new york", "city of los angeles", "le mans", "san", "york city of"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    known = spark.createDataFrame([(p,) for p in [*phrases, "", "new york"]], "phrase string")
    want = {i for i, t in enumerate(texts) if t and any(f" {p} " in f" {t} " for p in phrases)}
    for most in (membership.AUTOMATON, 0):
        assert {r.i for r in membership.phrase_hits(df, "i", "s", known, most).collect()} == want
        assert membership.phrase_hits(df, "i", "s", known.limit(0), most).count() == 0


def test_names_with_places_like_the_rule_by_arrays(spark):
    texts = ["Puerto Rico Ocean View Villas", "The Hotel of the New York Bay", "the New York City of Lights", "Grand Hotel New York and Spa", "Only Three Words", "one two three", "Big Old Le Mans Race Track", "Big Old Some Long Race Track"]
    df = with_lang(spark.createDataFrame([(i, "xh", t) for i, t in enumerate(texts)] + [(99, "en", texts[0])], "i int, lang string, s string"))
    places = ["New York", "Le Mans", "Rico"]
    want = {r.i: r.n for r in df.select("i", filters.titlecase_entity("s", F.array(F.lit("new york"), F.lit("le mans"), F.lit("rico"))).alias("n")).collect()}
    table = spark.createDataFrame([(p,) for p in places], "place string")
    for most in (membership.AUTOMATON, 0):
        assert {r.i: r.is_name for r in membership.titlecase_entities(df, "i", "s", table, most).collect()} == want
    assert want[0] and want[6] and not want[7] and not want[99]
