import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.functions import dims, filters, udfs
from tessella.functions import text as T

CASES = [
    (lambda c: T.valid_tokens(c), "3 + 2 x 5", 1),
    (lambda c: T.valid_tokens(c), "यह एक सादा वाक्य है", 5),
    (lambda c: T.valid_tokens(c), "This is a valid sentence.", 5),
    (lambda c: T.sentences(c), "Hello world. 你好世界。Next.", ["Hello world.", "你好世界。", "Next."]),
    (lambda c: T.sentences(c), "句子一。句子二。", ["句子一。", "句子二。"]),
    (lambda c: T.is_valid_word(c), "bonjour", True),
    (lambda c: T.is_valid_word(c), "!!!", False),
    (lambda c: T.is_valid_word(c), "12345", False),
    (lambda c: T.is_valid_word(c), "bonjour-123", False),
    (lambda c: T.split_list(c), "1: short item 2: short item", ["1: short item 2: short item"]),
    (lambda c: T.split_list(c), "1: " + "a b " * 14 + "2: " + "c d " * 14 + "3: last", ["1: " + ("a b " * 14).strip(), "2: " + ("c d " * 14).strip(), "3: last"]),
    (lambda c: T.expand_wrapped(c), '"Je vais tres bien aujourd\'hui. Merci beaucoup pour votre aide."', ["Je vais tres bien aujourd'hui.", "Merci beaucoup pour votre aide."]),
    (lambda c: T.strip_edge_quotes(c), "'n huis is mooi.", "'n huis is mooi."),
    (lambda c: T.strip_edge_quotes(c), "'quoted text'", "quoted text"),
    (lambda c: T.strip_accents(c), "mañana cómo está", "manana como esta"),
    (lambda c: T.strip_wrappers(c), '(["«deep»"])', "deep"),
    (lambda c: T.collapse_punct(c), "What??!! Yes...", "What?! Yes."),
    (lambda c: T.strip_leading_orphan(c), ", b word", "word"),
    (lambda c: T.paragraphs(c), "one\n\n two \n \n\nthree", ["one", "two", "three"]),
    (lambda c: T.strip_markup(c), "a [[b]] c {{d\ne}} == f == g", "a  c   g"),
    (lambda c: T.rot13(c), "Hello", "Uryyb"),
]


@pytest.mark.parametrize(("make", "value", "want"), CASES)
def test_text(spark, make, value, want):
    assert spark.createDataFrame([(value,)], "s string").select(make("s").alias("x")).first().x == want


def rows(spark, *pairs):
    return dims.with_lang(spark.createDataFrame([(i, lang, s) for i, (lang, s) in enumerate(pairs)], "pos int, lang string, s string"))


def stop():
    return F.array(*(F.lit(w) for w in "this is the a of and to in that it for with".split()))


def test_clean(spark):
    pairs = [
        ("en", "Profit was $5 + tax = €7 and ₪20, with more than enough words to pass."),
        ("en", "This sentence has 😀 emojis, ☀️ symbols, and more than enough words to pass."),
        ("hi", "Это кириллица"),
        ("xh", "Puerto Rico Ocean View Villas"),
        ("fr", "Bonjour العربية monde"),
        ("ru", "Привет мир hello"),
    ]
    got = [r.s for r in filters.cleaned(rows(spark, *pairs), "s", stop()).orderBy("pos").collect()]
    assert got == [pairs[0][1], "This sentence has emojis, symbols, and more than enough words to pass.", "", "", "Bonjour monde", "Привет мир"]
    again = filters.cleaned(rows(spark, *((lang, s) for (lang, _), s in zip(pairs, got))), "s", stop())
    assert [r.s for r in again.orderBy("pos").collect()] == got


def test_post_clean(spark):
    long = "This is the actual sentence after the list markers and it is long enough."
    pairs = [("en", "1) 2) " + long), ("en", "Profit = much more than enough words to pass here."), ("zh", "今天天气很好啊啊啊。"), ("en", "too short")]
    assert [r.s for r in filters.post_cleaned(rows(spark, *pairs), "s", stop()).orderBy("pos").collect()] == [long, "今天天气很好啊啊啊。"]


def test_reasons(spark):
    broad = F.array(*(F.lit(w) for w in "simple english clear speech leak".split()))
    pairs = [("su", "This is the simple English clear speech leak."), ("su", "Ngeunaan basa Sunda."), ("en", "This is the simple English clear speech leak."), ("hi", "Это кириллица")]
    df = rows(spark, *pairs).withColumn("reason", filters.reject_reason("s", stop(), broad))
    assert [r.reason for r in df.orderBy("pos").collect()] == ["english_leak", None, None, "mixed_script"]
    lexicon = F.create_map(F.lit("fr"), F.array(*map(F.lit, "le monde est beau".split())))
    df = rows(spark, ("sw", "le monde est beau leo"), ("fr", "le monde est beau")).select("pos", filters.major_latin_leak("s", lexicon).alias("x"))
    assert [r.x for r in df.orderBy("pos").collect()] == [True, False]
    places = F.array(F.lit("new south wales"))
    df = rows(spark, ("xh", "In New South Wales Today Again"), ("xh", "one two three four")).select("pos", filters.titlecase_entity("s", places).alias("x"))
    assert [r.x for r in df.orderBy("pos").collect()] == [True, False]


def test_scripts_and_labels(spark):
    df = rows(spark, ("fr", "bonjour"), ("fr", "bonjour한"), ("uz", "sўz")).select("pos", filters.is_script_contaminated("s").alias("x"))
    assert [r.x for r in df.orderBy("pos").collect()] == [False, True, False]
    df = rows(spark, ("ar", "arb_Latn"), ("ar", "arb_Arab"), ("en", "eng_Latn")).select("pos", filters.label_script_ok("s").alias("x"))
    assert [r.x for r in df.orderBy("pos").collect()] == [False, True, True]


def test_dims(spark):
    assert dims.wiki_cap("en") == 225_000 and dims.canonical(" NOB ") == "no" and len(dims.LANGUAGES) == 105
    assert set(dims.GROUP_OF) == set(dims.LANGUAGES)
    df = spark.createDataFrame([("ENG",), ("nn",), ("zz",)], "lang string")
    assert [r.lang for r in dims.with_canonical(df).collect()] == ["en", "no", "zz"]


def test_edges_like_the_plain_patterns(spark):
    """Cheap tests before a pattern, and trims, leave what the plain patterns leave."""
    import random

    rng = random.Random(5)
    signs = ["a", "B", "é", "ß", "Ⅳ", "²", " ", "\t", "\n", "\r\n", " ", " ", ".", "…", "“", "'", "-", "$", "\\[", "€", "☃", "‍", "⃣", "+", "1"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    S, Q, L, E = T.SPACE, T.OPENING_QUOTES, r"[\p{L}\p{Nl}\p{No}]", "[,.;:!?…،。！？]"
    gone = lambda c, p: F.regexp_replace(c, p, "")
    plain = {
        "strip_trailing_orphan": gone(gone("s", rf"(?:{S}|{E})+{L}$"), rf"{S}+$"), "strip_leading_orphan": gone(gone("s", rf"^(?:{S}|[{Q},.;:!?…،。！？])+{L}{S}+"), rf"^{S}+"),
        "strip_leading_punct": gone(gone("s", rf"^{S}+"), rf"^(?![{Q}])(?:{S}|\p{{P}})+"), "strip_terminal_punct": gone("s", rf"(?:\p{{P}}|{S})+$"), "strip_symbols": gone("s", rf"[\p{{S}}&&[^\p{{ASCII}}{T.CURRENCY}]]|[⃣︎️]"),
        "clean_formula": T.trim(T.collapse_spaces(gone("s", r"\$+|\\[\[\]()]"))),
    }
    for name, want in plain.items():
        assert df.where(~getattr(T, name)("s").eqNullSafe(want)).select("s").limit(3).collect() == [], name
    # the search for a letter at the end only runs where there is one
    assert df.limit(1).select(T.strip_trailing_orphan("s").alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") == 1


def test_letter_words_and_sentences_match_the_plain_patterns(spark):
    """Odd texts: runs of letters one by one, and the split that looks behind at every place."""
    import random

    pieces = ["a", "Σ", "ΑΣ", "İ", "ß", "é", "1", "_", ".", "!", "?", " ", "  ", "\n", " ", " ", "。", "！", "'", "-", "𝒜", "漢", "\x85", "\t"]
    rng = random.Random(3)
    df = spark.createDataFrame([("".join(rng.choice(pieces) for _ in range(rng.randrange(14))),) for _ in range(4000)] + [(None,)], "s string")
    words = F.transform(F.regexp_extract_all("s", F.lit(r"\p{L}+"), F.lit(0)), F.lower)
    first = F.when(F.size(words) >= 3, F.array_join(F.slice(words, 1, 3), " ")).otherwise("")
    split = F.filter(F.split("s", rf"(?<=[.!?]){T.SPACE}+|(?<=[。！？]){T.SPACE}*"), lambda s: s.rlike(T.FULL))
    rows = df.select("s", F.array_join(words, " ").alias("a"), T.letter_words("s").alias("b"), first.alias("c"), F.coalesce(T.first_letter_words("s", 3), F.lit("")).alias("d"), split.alias("e"), T.sentences("s").alias("f")).collect()
    assert [r for r in rows if (r.a, r.c, r.e) != (r.b, r.d, r.f)] == []


def test_text_digests(spark, monkeypatch):
    """Pieces smaller than a text, batches of few rows, ranges with several groups, equal texts, an empty text, a group without name."""
    monkeypatch.setattr(udfs, "PIECE", 7)
    groups = {None: ["b", "a", "a"], "de": [f"{i % 37} straße" for i in range(200)], "fr": ["", "é", "z" * 40, "\U0001f600", "\uffff"], "xx": [""], "yy": [None]}
    df = spark.createDataFrame([(k, t) for k, v in groups.items() for t in v], "g string, t string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.g: (r.n, r.digest) for r in udfs.text_digests(df, "g", "t").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sets = {k: sorted({t.encode() for t in v if t is not None}) for k, v in groups.items()}
    assert got == {k: (len(v), hashlib.md5(b"".join(v)).hexdigest()) for k, v in sets.items() if v}
