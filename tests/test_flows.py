import pytest
from pyspark.sql import functions as F

from tessella.operators import lexicon
from tessella.plans import flows
from tessella.sources import corpora, stores
from tessella.streaming import ingest


def test_frequency_lines_to_short_texts(spark, tmp_path):
    """Word lists of two languages, one of them only in full, to words, overlaps, kept words and stored short texts."""
    (tmp_path / "fr_50k.txt").write_text("bonjour 100\nmerci 90\nmonde 80\nrare 2\n'l 70\n", encoding="utf-8")
    (tmp_path / "fr_full.txt").write_text("never 1\n", encoding="utf-8")
    (tmp_path / "es_full.txt").write_text("100 hola\r\n90 mundo\r\n80 monde\r\n", encoding="utf-8")
    lines = corpora.frequency_lines(spark, str(tmp_path), ["fr", "es"])
    assert sorted((r.lang, r.pos, r.line) for r in lines.where("line <> ''").collect())[:2] == [("es", 0, "100 hola"), ("es", 1, "90 mundo")]
    assert lines.where("line like '%never%'").count() == 0
    with pytest.raises(FileNotFoundError):
        corpora.frequency_lines(spark, str(tmp_path), ["fr", "xx"])
    words = lexicon.with_relative_rank(lexicon.with_overlaps(lexicon.word_list(lines.where("line <> ''"), 100).where("not contaminated")))
    assert {(r.lang, r.word): r.overlaps for r in words.collect()} == {("fr", "bonjour"): [], ("fr", "merci"): [], ("fr", "monde"): ["es"], ("es", "hola"): [], ("es", "mundo"): [], ("es", "monde"): ["fr"]}
    path = str(tmp_path / "pools")
    out = lexicon.short_pools(spark, words, path).collect()
    assert stores.language_counts(spark, path) == {lang: sum(r.lang == lang for r in out) for lang in ("es", "fr")}
    vocabulary = {"fr": {"bonjour", "merci", "monde"}, "es": {"hola", "mundo", "monde"}}
    for r in out:
        assert len(r.tokens) == len(set(r.tokens)) == r.n and r.word in r.tokens and set(r.tokens) <= vocabulary[r.lang]
        assert r.text == " ".join(r.tokens) and r.source_type == ("unigram", "bigram", "trigram")[r.n - 1]
    assert {r.word: max(x.n for x in out if x.lang == "fr" and x.word == r.word) for r in out if r.lang == "fr"} == {"bonjour": 3, "merci": 2, "monde": 2}


def test_all_sources_in_one_store(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "lang string, sentence string")
    path = str(tmp_path / "all")
    out = flows.stored_sources(spark, path, {"wiki": frame([("de", "a"), ("de", "a"), ("fr", "b")]), "tatoeba": frame([("de", "a")]), "other": frame([("de", "not a source")])})
    assert sorted((r.source, r.lang, r.sentence) for r in out.collect()) == [("tatoeba", "de", "a"), ("wiki", "de", "a"), ("wiki", "fr", "b")]
    flows.stored_sources(spark, path, {"wiki": frame([("it", "c")])})
    assert stores.known_languages(spark, path) == ["it"]
    assert stores.sentence_store(spark, path).read(1).count() == 3


def test_running_counts_leave_out_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = lambda *r: spark.createDataFrame(list(r), "t string, lang string").select(F.to_timestamp("t").alias("ts"), "lang").coalesce(1).write.mode("append").parquet(folder)
    rows(("2026-01-01 00:01:00", "de"), ("2026-01-01 00:02:00", "de"), ("2026-01-01 00:03:00", "fr"))
    stream = spark.readStream.schema("ts timestamp, lang string").option("maxFilesPerTrigger", 1).parquet(folder)
    counts = ingest.running_language_counts(stream)
    start = lambda: counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    start()
    rows(("2026-01-01 01:00:00", "fr"))
    start()
    rows(("2026-01-01 00:04:00", "de"), ("2026-01-01 02:00:00", "it"))  # the first is behind the watermark
    start()
    start()
    got = {(str(r.window.start), r.lang): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2026-01-01 00:00:00", "de"] == 2 and got["2026-01-01 00:00:00", "fr"] == 1
