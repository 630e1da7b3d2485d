import pytest
from pyspark.sql import functions as F

from tessella import cli
from tessella.functions import udfs
from tessella.plans import evaluate, queries


def test_udfs(spark):
    df = spark.createDataFrame([("ﬁne Ünï",), (None,)], "s string")
    rows = df.select(udfs.nfkc("s").alias("a"), udfs.without_marks("s").alias("b"), udfs.compatible_phrase("s").alias("c")).collect()
    assert (rows[0].a, rows[0].b, rows[0].c, rows[1].a) == ("fine Ünï", "fine Uni", "fine ünï", None)
    assert df.select(udfs.segmented_by(lambda: lambda x: x.split(" "), "s").alias("x")).first().x == ["ﬁne", "Ünï"]
    assert df.limit(1).select(udfs.segmented_by(lambda: lambda x: 1 / 0, "s").alias("x")).first().x == ["ﬁne Ünï"]
    assert df.select(udfs.tokenized_by(lambda: lambda x: [len(x)], "s").alias("x")).collect()[1].x == [0]
    words = spark.createDataFrame([(["ab", "c"], [1, 0])], "w array<string>, l array<long>")
    got = words.select(udfs.aligned(F.col("w"), F.col("l"), lambda: lambda w: [ord(c) for c in w]).alias("x")).first().x
    assert got.ids == [97, 98, 99] and got.labels == [1, 2, 0]


def test_evaluation(spark):
    found = evaluate.active({"defaults": {"batch": 8, "other": 1}, "runs": [{"name": "a", "model": "m", "dataset": "d"}, {"name": "b", "model": "m", "dataset": "d", "active": False}]})
    assert [r.name for r in found] == ["a"] and found[0].batch == 8
    with pytest.raises(ValueError):
        evaluate.runs([{"name": "a", "model": "m", "dataset": "d"}] * 2)
    rows = spark.createDataFrame([(1, "one", "eng_Latn"), (2, "deux", "fra_Latn"), (3, "x", "arb_Latn"), (4, "y", "qqq_Latn")], "doc int, text string, label string")
    truth = evaluate.labelled_set(rows, "label")
    assert {r.true_lang for r in truth.collect()} == {"en", "fr"}
    scores = udfs.predicted_by(truth, lambda: lambda ts: [[("B-EN", 0.9), ("fr", 0.85)] for _ in ts], "doc", "text")
    out = evaluate.evaluated(truth, evaluate.multilabel_spans(scores))
    assert {r.true_lang: r.band for r in out["accuracy"].collect()} == {"en": "good", "fr": "good", None: "good"}


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "t.tsv").write_text("".join(f"{i}\ten\tThis is sentence number word{'abcdefghij'[i % 10]} and it goes on for a while here.\n" for i in range(60)))
    cli.main(["tab", "--input", str(tmp_path / "t.tsv"), "--output", str(tmp_path / "store")])
    cli.main(["lexicon", "--input", str(tmp_path / "store"), "--output", str(tmp_path / "lex"), "--top", "5"])
    assert spark.read.parquet(str(tmp_path / "lex")).count() == 5
    cli.main(["synthesize", "--store", str(tmp_path / "store"), "--output", str(tmp_path / "syn"), "--total", "10"])
    cli.main(["count", "--input", str(tmp_path / "syn" / "ready")])
    cli.main(["simulate", "--store", str(tmp_path / "store"), "--documents", "20", "--trials", "2"])
    assert "Bottlenecks" in capsys.readouterr().out


def test_every_sql_has_a_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) > 40


def test_stop_words_are_read_whole(spark, tmp_path, monkeypatch):
    from tessella.plans import flows

    seen = []
    monkeypatch.setattr(flows, "leak_filter", lambda stop: seen.append(spark.range(1).select(F.size(stop)).first()[0]))
    monkeypatch.setattr(flows, "refilter", lambda *args: {})
    (tmp_path / "stop").write_text("".join(f"w{i}\n" for i in range(2500)))
    cli.main(["refilter", "--store", str(tmp_path), "--stop", str(tmp_path / "stop")])
    assert seen == [2500]


def test_spans_and_stats_of_whole_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "word " * 2000, "en"), (2, "mot " * 30, "fr")], "doc_id long, text string, lang string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    stats = {r.lang: (r.n_examples, r.n_tokens) for r in queries.QUERIES["sampling_stats"](spark, str(tmp_path)).where("n_tokens > 0").collect()}
    assert stats == {"en": (1, 2000), "fr": (1, 30)}
    sizes = queries.labelled(spark, str(tmp_path)).select(F.size("tokens").alias("n")).collect()
    assert sorted(r.n for r in sizes) == [30, 2000]
