import json
import random

from pyspark.sql import functions as F

from tessella.functions import tables
from tessella.functions import text as T
from tessella.sources import variants
from tessella.sources.snapshots import Snapshots


def test_list_or_json(spark):
    rows = [("[1, 2]", [1, 2]), ('"[3]"', [3]), ("[]", []), ("[1, ", None), ("7", None), ('{"a": 1}', None), (None, None), ("", None), ('["x"]', [None]), ("[1, null]", [1, None])]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, r string")
    got = {r.i: r.x for r in df.select("i", variants.list_or_json(df, "r").alias("x")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}
    arrays = spark.createDataFrame([([1, 2],), (None,)], "r array<int>")
    assert [r.x for r in arrays.select(variants.list_or_json(arrays, "r").alias("x")).collect()] == [[1, 2], None]


def test_map_entries_and_migration(spark, tmp_path):
    texts = ['{"de": ["a", "b ü"], "fr": "c", "it": [], "es": [1, true, null, {"x": 1}]}', "{broken", "[1]", None, "3"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    got = sorted((r.i, r.key, r.pos, r.value) for r in variants.map_entries(df, "raw").where("key <> 'es'").collect())
    assert got == [(0, "de", 0, "a"), (0, "de", 1, "b ü"), (0, "fr", 0, "c")]
    assert [r.value for r in variants.map_entries(df, "raw").where("key = 'es'").orderBy("pos").collect()][:2] == ["1", "true"]
    legacy = tmp_path / "legacy.json"
    legacy.write_text(json.dumps({"de": ["eins", "zwei"], "fr": ["un"]}, indent=1))
    out = variants.migrated(spark, str(legacy), str(tmp_path / "store"))
    assert sorted(tuple(r) for r in out.collect()) == [("de", 0, "eins"), ("de", 1, "zwei"), ("fr", 0, "un")]
    legacy.write_text("{}")
    assert variants.migrated(spark, str(legacy), str(tmp_path / "store")).count() == 3
    assert Snapshots(spark, str(tmp_path / "store"), ("lang",)).version() == 1


def test_table_functions_like_the_expressions(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "B", ".", "!", "?", "。", "！", " ", "  ", "\n", "　", "\x85", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", " ", "One. Two! 三。四"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    tables.register(spark)
    df.createOrReplaceTempView("some_texts")
    got = {(r.i, r.no): r.sentence for r in spark.sql("SELECT i, s.* FROM some_texts, LATERAL split_sentences(text) AS s").collect()}
    want = {(r.i, r.no): r.s for r in df.select("i", F.posexplode(T.sentences("text")).alias("no", "s")).collect()}
    assert got == want
    records = spark.sql("SELECT i, r.* FROM some_texts, LATERAL text_records(text, 3) AS r ORDER BY i, part").collect()
    back = {}
    for r in records:
        assert r.n_tokens == len(r.record.split()) <= 3 and r.first == 3 * r.part
        back.setdefault(r.i, []).extend(r.record.split())
    assert back == {i: t.split() for i, t in enumerate(texts) if t and t.split()}
    scores = spark.createDataFrame([("a", 1.0, 2.0), ("a", 0.0, 2.0), ("a", None, 9.0), ("b", 1.0, 0.0), ("c", None, None)], "k string, s double, w double")
    scores.createOrReplaceTempView("some_scores")
    assert {r.k: r.x for r in spark.sql("SELECT k, chunk_score(s, w) AS x FROM some_scores GROUP BY k").collect()} == {"a": 0.5, "b": None, "c": None}
