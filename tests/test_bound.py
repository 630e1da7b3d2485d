"""Expressions that lambdas use more than once or for every element are bound first, so that they run once a row."""

from pyspark.sql import functions as F

from tessella.functions import labels as L
from tessella.functions import noise as N
from tessella.operators import membership


def uses(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_multi_hot_sorts_once(spark):
    df = spark.createDataFrame([([1, 2, 5],), ([],), (None,)], "l array<long>")
    hot = df.select("l", L.multi_hot(L.languages_present(F.col("l"))).alias("h"))
    assert [[i for i, x in enumerate(r.h or []) if x] for r in hot.collect()] == [[0, 2], [], []]
    plan = hot._jdf.queryExecution().optimizedPlan().toString()
    # the list is an element of an array that a lambda takes, and no part of the lambda over languages
    assert plan.index("array_sort") < plan.index("array_contains") and "array_contains(array_sort" not in plan


def test_noise_hashes_a_word_once(spark):
    """One hash a word for its case, and none a word for the gap."""
    df = spark.createDataFrame([("one  two three", "k")], "s string, k string")
    assert uses(df.select(N.word_casing(F.col("s"), F.col("k"), 0.3, 0.3, 0.1).alias("x")), "md5(") == 1
    spaced = N.spacing(F.col("s"), F.col("k"), 0.4, 0.5).alias("x")
    plan = df.select(spaced)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("gap") == 2
    assert df.select(N.spacing(F.lit(None).cast("string"), F.col("k"), 1.0, 1.0).alias("x")).first().x is None


def test_bits_are_read_from_numbers(spark):
    """No text is made of a bit for every word."""
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    some = membership.maybe_in(words, spark.createDataFrame([(1, [0] * 512)], "_bucket long, _longs array<long>"))
    assert uses(some, "getbit") and not uses(some, "conv(") and not uses(some, "hex(")
    assert some.columns == ["word"]


def test_phrases_cut_no_lists(spark):
    """Sequences of words are read off the text, one row a word, and only as long as phrases are."""
    df = spark.createDataFrame([(1, "a b c d"), (2, "b"), (3, ""), (4, None), (5, "c d"), (6, "x a"), (7, "ab c")], "i long, s string")
    known = spark.createDataFrame([("a b",), ("b c d",)], "phrase string")
    hits = membership.phrase_hits(df, "i", "s", known, 0)
    assert [r.i for r in hits.collect()] == [1] and not uses(hits, "array_join(") and not uses(hits, "slice(")
    found = df.orderBy("i").select(membership.word_sequences("s", 2, 3).alias("x")).collect()
    assert [r.x for r in found] == [["a b c", "b c d", "c d"], [], [], None, ["c d"], ["x a"], ["ab c"]]


LEAKS = ["the of and to in that is was", "das ist der Hund und die Katze", "Das İst der Straße_1 und die 12", "le la les de chat", "Cities of the cars and flies", "the_of and 1 the of is", "", "der die das", "ΑΣ of the and it", "É the of and in to", None]


def test_words_are_looked_up_by_hash(spark):
    """Lists of words give what arrays give, and no word is compared with one after the other."""
    from tessella.functions import filters
    from tessella.functions.dims import with_lang

    df = with_lang(spark.createDataFrame([(i, lang, s) for i, s in enumerate(LEAKS) for lang in ("sw", "en", "de", "fr")], "i int, lang string, s string"))
    arr = lambda words: F.array(*map(F.lit, words))
    stop, broad = "the of and to in that is was for it with as".split(), ["city", "car", "fly", "the"]
    lexicon = {"de": "der die das ist und".split(), "fr": "le la les de et".split()}
    as_map = F.create_map(*(x for k, v in lexicon.items() for x in (F.lit(k), arr(v))))
    for lists, arrays in (
        (filters.english_leak("s", stop), filters.english_leak("s", arr(stop))), (filters.english_leak("s", stop, broad), filters.english_leak("s", arr(stop), arr(broad))),
        (filters.major_latin_leak("s", lexicon), filters.major_latin_leak("s", as_map)),
    ):
        rows = df.select("i", "lang", lists.alias("a"), arrays.alias("b"))
        got = rows.collect()
        assert [r for r in got if r.a != r.b] == [] and {r.a for r in got} == {True, False}
        assert not uses(df.select(lists.alias("a")), "array_contains(")
    assert filters.english_leak("s", []) is not None and {r.a for r in df.select(filters.english_leak("s", [], []).alias("a")).collect()} == {False}


def test_names_are_looked_for_in_minor_latin_only(spark):
    """The words of other texts aren't taken apart."""
    from tessella.functions import filters
    from tessella.functions.dims import with_lang

    df = with_lang(spark.createDataFrame([("sw", "San Juan Puerto"), ("de", "San Juan Puerto"), ("xx", "San Juan Puerto")], "lang string, s string"))
    name = filters.titlecase_entity("s").alias("x")
    assert {r.lang: r.x for r in df.select("lang", name).collect()} == {"sw": True, "de": False, "xx": False}
    plan = df.select(name)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("minor_latin") < plan.index("regexp_extract_all")
