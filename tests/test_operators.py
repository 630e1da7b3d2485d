import dataclasses

import pytest
from pyspark.sql import functions as F

from tessella.functions import generators
from tessella.functions import labels as L
from tessella.functions import text as T
from tessella.operators import capacity, dedupe, lexicon, pools, reports, synth
from tessella.plans import flows
from tessella.sources import corpora, stores
from tessella.streaming import ingest


def test_first_wins_and_caps(spark):
    df = spark.createDataFrame([("fr", 3, "a"), ("fr", 1, " a "), ("fr", 2, "b"), ("de", 0, "a")], "lang string, pos int, sentence string")
    assert sorted(map(tuple, dedupe.dedupe_sentences(df).collect())) == [("de", 0, "a"), ("fr", 1, " a "), ("fr", 2, "b")]
    assert sorted(r.pos for r in dedupe.capped(df, "lang", ["pos"], 2).collect()) == [0, 1, 2]
    assert [r.pos for r in dedupe.every_nth(df, "lang", ["pos"], 2).collect()] == [2]
    assert dedupe.dedupe_summary(df, "lang", F.col("sentence")).where("lang = 'fr'").first().n_removed == 0


def test_miss_streak_and_budget(spark):
    hits = [True, False, False, None, True, False, False, False, True]
    df = spark.createDataFrame([("x", i, h, 10) for i, h in enumerate(hits)], "g string, pos int, h boolean, n int")
    assert sorted(r.pos for r in dedupe.miss_streak_cut(df, "g", ["pos"], F.col("h"), 3).collect()) == list(range(8))
    assert dedupe.budget(df, "g", ["pos"], "n", 35).count() == 4


def test_bucketed_selection(spark):
    rows = [("x", i, i, float(-i), 0.0, 0.0, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "lang string, pos int, sentence_token_length int, score double, og_quality_score double, og_language_score double, og_token_count int")
    out = dedupe.bucketed_selection(df, "lang", 9).collect()
    assert len(out) == 9 and {r.bucket for r in out} == {0, 1, 2} and {r.pos for r in out if r.bucket == 0} == {0, 1, 2}


def test_words(spark):
    lines = spark.createDataFrame([("fr", i, s) for i, s in enumerate(["100 bonjour", "90 salut", "80 merci", "word 70", "75 bonjour한", "60 monde", "3 rare", "50 'apos"])], "lang string, pos int, line string")
    out = lexicon.word_list(lines, 100)
    assert sorted(r.word for r in out.where("not contaminated").collect()) == ["bonjour", "merci", "monde", "salut", "word"]
    assert out.where("contaminated").count() == 1
    words = spark.createDataFrame([("en", "a", 1, 9), ("en", "b", 2, 8), ("es", "a", 1, 9), ("es", "c", 2, 7)], "lang string, word string, rank int, count int")
    rows = {(r.lang, r.word): r for r in lexicon.with_relative_rank(lexicon.with_overlaps(words)).withColumn("n", lexicon.repeats()).collect()}
    assert rows["en", "a"].relative_rank == 1 and rows["es", "c"].relative_rank == 0
    assert rows["en", "a"].overlaps == ["es"] and rows["en", "a"].n == 3 and rows["en", "b"].n == 1
    text = spark.createDataFrame([("fr", "Bonjour le monde."), ("fr", "Bonjour encore et encore."), ("fr", "Le monde est beau.")], "lang string, sentence string")
    assert lexicon.word_counts(text).count() == 7


@pytest.fixture(scope="module")
def sentences(spark):
    rows = [("wiki", lang, f"{lang} sentence number {i} goes on, and on.") for lang in ("en", "de", "fr") for i in range(120)]
    return spark.createDataFrame(rows, "source string, lang string, sentence string")


def test_pools(spark, sentences):
    split = pools.split_by_hash(sentences)
    assert 0.35 < split.where("pool = 'reserved'").count() / 360 < 0.75
    numbered = pools.numbered(split)
    for r in numbered.groupBy("pool", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("a"), F.max("idx").alias("b"), F.count_distinct("idx").alias("d")).collect():
        assert (r.a, r.b, r.d) == (0, r.n - 1, r.n)
    again = pools.numbered(pools.split_by_hash(sentences.repartition(5)))
    assert sorted(map(tuple, numbered.select("pool", "lang", "sentence", "idx").collect())) == sorted(map(tuple, again.select("pool", "lang", "sentence", "idx").collect()))
    plan = pools.doc_plan(spark.createDataFrame([("en", 30), ("de", 5), ("fr", 0)], "lang string, capacity long"), 20)
    rows = plan.collect()
    assert len(rows) == 20 and {r.lang for r in rows} == {"en", "de"} and sum(r.lang == "de" for r in rows) <= 5
    demands = spark.createDataFrame([("p", "en", "a", 0, 3), ("p", "en", "b", 0, 2), ("p", "en", "b", 1, 4)], "pool string, lang string, doc string, slot int, n int")
    pool = spark.range(8).select(F.lit("p").alias("pool"), F.lit("en").alias("lang"), F.col("id").alias("idx"), F.col("id").cast("string").alias("sentence"))
    drawn = pools.draw(demands, pool).collect()
    assert len(drawn) == 8 and len({r.sentence for r in drawn}) == 8


def test_labels(spark):
    one = spark.range(1)
    made = one.select(L.model_inputs(F.expr("array(10L, 11L)"), F.expr("array(1L, 2L)"), 101, 102).alias("m")).first().m
    assert made.input_ids == [101, 10, 11, 102] and made.attention_mask == [1] * 4 and made.labels == [-100, 1, 2, -100]
    pieces = one.select(L.wordpiece_labels(F.expr("array(null, 0, 0, 0, null)"), F.expr("array(1L)")).alias("x")).first().x
    assert pieces == [-100, 1, 2, 2, -100]
    assert one.select(L.languages_present(F.expr("array(0L, 5L, 6L, 1L, -100L)")).alias("x")).first().x == [0, 2]
    assert sum(one.select(L.multi_hot(F.expr("array(0, 2)")).alias("x")).first().x) == 2
    assert one.select(L.drop_punct(F.expr("array('a', '!', '▁.', 'b.')")).alias("x")).first().x == ["a", "b."]
    assert L.label_dim(spark).count() == 211


def test_synthetic_documents(spark, sentences):
    out = synth.build(sentences, 40).cache()
    rows = out.collect()
    assert {r.kind for r in rows} == {"pure", "homogeneous", "spliced", "mixed"}
    for r in rows:
        assert len(r.tokens) == len(r.ner_tags) and len(r.input_ids) == len(r.attention_mask) == len(r.labels) == len(r.tokens) + 2
    assert {r.doc for r in synth.build(sentences.repartition(3), 40).collect()} == {r.doc for r in rows}
    ready = synth.model_ready(out)
    assert ready.count() == len([r for r in rows if r.kind != "spliced"])
    assert {len(r.labels) for r in synth.multilabel(ready).collect()} == {105}
    assert reports.label_counts(ready).count() >= 3 and reports.sampling_stats(out).count() == 105


def test_evaluation(spark):
    spans = spark.createDataFrame([(1, 0, "en", 0, 10, 0.9), (1, 1, "de", 10, 13, 0.8), (2, 0, "fr", 0, 10, 0.5), (2, 1, "es", 10, 20, 0.5)], "doc int, pos int, lang string, start int, end int, score double")
    stats = reports.span_coverage(spans)
    assert abs(stats.where("doc = 1 and lang = 'de'").first().char_coverage - 1.05) < 1e-9
    truth = spark.createDataFrame([(1, "en"), (2, "es"), (3, "it")], "doc int, true_lang string")
    got = {r.doc: (r.pred_lang, r.by_runner_up) for r in reports.predictions(stats, truth).collect()}
    assert got == {1: ("en", False), 2: ("es", True), 3: ("", False)}
    tags = spark.createDataFrame([(1, [1, 2, 0, 3, 4], [1, 2, 0, 3, 0])], "doc int, g array<long>, p array<long>")
    assert reports.span_scores(tags, "g", "p").first().f1 == 0.5


def test_generators(spark):
    a = generators.math_expressions(spark, 200, 3)
    assert a.count() == 200 and a.where("text like '%{a}%' or text is null").count() == 0
    assert a.repartition(7).orderBy("id").collect() == generators.math_expressions(spark, 200, 3).orderBy("id").collect()
    with pytest.raises(ValueError):
        generators.math_expressions(spark, 1, domain="none")
    assert {r.domain for r in generators.code_snippets(spark, 500).collect()} == set(generators.CODE)
    assert set(generators.neutral_pools(spark, None, 10, 10)) == {"math", "html", "css", "code", "symbol", "numeric"}
    supply = spark.createDataFrame([("reserved", "en", 100), ("reserved", "de", 5), ("main", "en", 40), ("main", "de", 0)], "pool string, lang string, n long")
    trials = capacity.simulate(supply, 50, 6)
    for r in trials.collect():
        assert r.used == min(r.wanted, r.available) and r.depleted == (r.wanted > r.available)
    stats = capacity.summary(trials, supply)
    assert stats.count() == 4 and capacity.bottlenecks(stats, 1).first().headroom == 0
    assert capacity.most_headroom(stats, 2).count() == 2 and {r.lang for r in capacity.most_present(stats).collect()} == {"en", "de"}


STOP = "this is the a of and to in that it for with".split()


def test_sources(spark, tmp_path):
    stop = F.array(*map(F.lit, STOP))
    (tmp_path / "t.tsv").write_text("1\tfr\tBonjour العربية monde\n2\tfr\tالعربية\n3\tbad\n4\tnob\tHei verden\n", encoding="utf-8")
    rows = corpora.tab_sentences(corpora.tab_separated(spark, str(tmp_path / "t.tsv"))).collect()
    assert sorted((r.lang, r.sentence) for r in rows) == [("fr", "Bonjour  monde"), ("no", "Hei verden")]
    assert corpora.parse_remaps(["A=b"]) == {"a": "b"}
    configs = spark.createDataFrame([("all",), ("fra_Latn",), ("hin_Latn",), ("hin_Deva",), ("qqq_Latn",)], "config string")
    assert {(r.config, r.lang) for r in corpora.matching_configs(configs).collect()} == {("fra_Latn", "fr"), ("hin_Deva", "hi")}
    text = "\n\n".join(f"Paragraph number word{chr(97 + i)} is here with more than enough words to pass. It is the second sentence of the same paragraph, word{chr(97 + i)}." for i in range(20))
    articles = spark.createDataFrame([("en", 0, "t", text), ("en", 1, "short", "too short")], "lang string, pos int, title string, text string")
    out = corpora.article_sentences(articles, stop)
    assert out.count() == 30 and out.where("pos = 1").count() == 1
    pairs = spark.createDataFrame([("smoldoc__en_xx", 0, None, ["This is an English sentence that has enough words in it."], None, ["nothing"]), ("smolsent__en_fr", 0, None, None, "Ceci est une phrase qui est assez longue pour passer ici.", None)], "config string, pos int, src string, srcs array<string>, trg string, trgs array<string>")
    assert {r.lang for r in corpora.pair_sentences(pairs).collect()} == {"en", "fr"}
    row = (["Ceci est une phrase qui est assez longue pour passer ici.\nUne autre ligne avec assez de mots pour passer aussi."], None, None, None, "fr", 0.99, 100, 0.9, None, None, "http://x.org", "fr", 0)
    parallel = spark.createDataFrame([row, (*row[:10], "http://fr.wikipedia.org/x", "fr", 1)], corpora.PARALLEL_SCHEMA + ", lang string, pos int")
    assert sorted(r.sentence[:4] for r in corpora.parallel_sentences(parallel, stop).collect()) == ["Ceci", "Une "]


def test_stores_and_flows(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("wiki", "fr", 1, '"Je vais tres bien aujourd\'hui. Merci beaucoup pour votre aide."'), ("wiki", "en", 2, "Short.")], stores.SENTENCES)
    stores.write_sentences(rows, path)
    assert stores.known_languages(spark, path) == ["en", "fr"] and stores.read_sentences(spark, path, ["fr"]).count() == 1
    stores.write_json(spark, str(tmp_path / "m.json"), {"é": 1})
    assert stores.read_json(spark, str(tmp_path / "m.json")) == {"é": 1} and stores.read_json(spark, str(tmp_path / "none.json")) is None
    built = []
    for _ in range(2):
        stores.cached(spark, str(tmp_path / "c"), {"seed": 1}, lambda: built.append(1) or rows)
    assert len(built) == 1
    counts = flows.refilter(spark, path, lambda df: df.where("lang <> 'en' or length(sentence) > 10").where("lang = 'fr'"))
    assert counts["fr"] == 1 and counts["en"] == 0
    assert [r.lang for r in stores.read_sentences(spark, path).collect()] == ["fr"]
    assert stores.read_records(spark, str(tmp_path / "nothing")).count() == 0
    assert "| lang |" in flows.markdown(rows.select("lang"))


def test_streaming(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    df = spark.createDataFrame([("fr", "a", 1), ("fr", "b", 2)], "lang string, sentence string, pos int")
    df.write.parquet(src)
    clean = lambda b: b.withColumn("sentence", T.trim("sentence"))
    assert ingest.ingest(spark, src, "lang string, sentence string, pos int", clean, out, check) == 1
    assert ingest.ingest(spark, src, "lang string, sentence string, pos int", clean, out, check) == 0
    df.write.mode("append").parquet(src)
    ingest.ingest(spark, src, "lang string, sentence string, pos int", clean, out, check)
    assert spark.read.parquet(out).count() == 4


def test_refilter_with_equal_counts(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [("wiki", "en", 0, "(one)"), ("wiki", "en", 1, "two"), ("wiki", "fr", 0, "un"), ("wiki", "de", 0, "eins")]
    stores.write_sentences(spark.createDataFrame(rows, "source string, lang string, pos long, sentence string"), path)

    def transform(df):
        lost = df.where("lang <> 'de'").withColumn("sentence", F.regexp_replace("sentence", "[()]", ""))
        return lost.unionByName(df.where("lang = 'de'").withColumn("sentence", F.lit("zwei")))

    assert flows.refilter(spark, path, transform) == {"en": 2, "fr": 1, "de": 1}
    assert {(r.lang, r.sentence) for r in stores.read_sentences(spark, path).collect()} == {("en", "one"), ("en", "two"), ("fr", "un"), ("de", "zwei")}


def test_unknown_and_swapped_tokens(spark, monkeypatch):
    assert {k.name: (k.unknown, k.swap) for k in synth.KINDS} == {"pure": (0.002, 0), "homogeneous": (0.002, 0), "spliced": (0.002, 0), "mixed": (0, 0.06)}
    words = "one two three four five six seven eight nine ten".split()
    rows = [("wiki", lang, f"{lang} {' '.join(words[i % 7 :])} number {chr(97 + i % 26)}{chr(97 + i // 26)}") for lang in ("en", "fr", "de") for i in range(120)]
    df = spark.createDataFrame(rows, "source string, lang string, sentence string")

    def built(**probabilities):
        monkeypatch.setattr(synth, "KINDS", tuple(dataclasses.replace(k, **{n: p if getattr(k, n) else 0.0 for n, p in probabilities.items()}) for k in kinds))
        return {r.doc: r for r in synth.build(df, 40).collect()}

    kinds = synth.KINDS
    plain, noisy = built(unknown=0.0, swap=0.0), built(unknown=1.0, swap=1.0)
    assert plain.keys() == noisy.keys() and {r.kind for r in plain.values()} == {k.name for k in kinds}
    for doc, r in noisy.items():
        old = plain[doc]
        if r.kind == "mixed":
            assert r.original_text == old.original_text and r.tokens != old.tokens
            assert sorted(zip(r.tokens, r.ner_tags)) == sorted(zip(old.tokens, old.ner_tags))
        else:
            assert [t for t in r.tokens if t != "<unk>"] == old.tokens and [x for t, x in zip(r.tokens, r.ner_tags) if t != "<unk>"] == old.ner_tags
            assert all(r.ner_tags[i] == r.ner_tags[i + 1] for i, t in enumerate(r.tokens) if t == "<unk>")
            assert r.tokens.count("<unk>") == r.original_text.split().count("<unk>") > 0


def test_formatting_and_spans_without_language(spark, monkeypatch):
    monkeypatch.setattr(synth, "KINDS", tuple(dataclasses.replace(k, wrap=1.0 if k.wrap else 0.0, outside=1.0 if k.outside else 0.0) for k in synth.KINDS))
    rows = [("wiki", lang, f"{lang} one two three four number {i}") for lang in ("en", "fr", "de") for i in range(120)]
    out = synth.build(spark.createDataFrame(rows, "source string, lang string, sentence string"), 40).collect()
    for r in out:
        assert len(r.tokens) == len(r.ner_tags)
        if r.kind in ("mixed", "pure"):
            assert 0 in r.ner_tags
        if r.kind == "mixed":
            assert len(r.ner_tags) - r.ner_tags.count(0) <= 4 * 8
    pure = " ".join(r.original_text for r in out if r.kind == "pure")
    assert any(a in pure for a, _ in synth.TAGS) and any(a in pure for a, _ in synth.PAIRS) and any(t in pure for t in synth.TRAILS)
