import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import dedupe
from tessella.plans import load
from tessella.sources import corpora
from tessella.sources.snapshots import Snapshots
from tessella.streaming import stops

ROWS = [(f"{lang}_{part}", lang, 10 * k + i, f"{lang} sentence {i % 7} of {part if i % 3 else 'all'}") for lang in ("de", "fr") for k, part in enumerate("abc") for i in range(9)]


@pytest.fixture
def corpus(spark):
    rows = spark.createDataFrame(ROWS, "config string, lang string, pos long, sentence string")
    reads = []

    def read(batch):
        reads.append(sorted(r.config for r in batch.collect()))
        return rows.join(batch.select("config"), "config").select("lang", "pos", "sentence")

    return rows.select("config", "lang").distinct(), read, reads


def contents(df):
    return sorted((r.lang, r.sentence) for r in df.collect())


def test_three_runs_equal_a_full_one(spark, tmp_path, corpus):
    configs, read, reads = corpus
    full = contents(load.load(Snapshots(spark, str(tmp_path / "full"), ("lang",)), configs, read, {"seed": 1}))
    assert full == sorted({(r[1], r[3]) for r in ROWS})
    store = Snapshots(spark, str(tmp_path / "s"), ("lang",))
    reads.clear()
    load.load(store, configs.where("config like '%a'"), read, {"seed": 1})
    load.load(store, configs, read, {"seed": 1})
    assert contents(load.load(store, configs, read, {"seed": 2})) == full
    assert reads == [["de_a", "fr_a"], ["de_b", "de_c", "fr_b", "fr_c"]]
    assert store.version() == 3 and store.meta()["describes"] == {"seed": 2} and store.meta()["status"] == load.COMPLETE
    assert contents(load.load(store, configs, read, {"seed": 2})) == full and store.version() == 3
    assert load.compared(load.completed_configs(spark, store), configs) == "exact"


def test_a_load_that_died_goes_on(spark, tmp_path, corpus):
    configs, read, reads = corpus
    store = Snapshots(spark, str(tmp_path / "s"), ("lang",))

    def dies(batch):
        if len(reads) == 2:
            raise OSError("lost")
        return read(batch)

    with pytest.raises(OSError):
        load.load(store, configs, dies, {"seed": 1}, per_commit=2)
    assert store.meta()["status"] == load.CHECKPOINT and len(store.meta()["completed"]) == 4
    assert load.compared(load.completed_configs(spark, store), configs) == "subset"
    with pytest.raises(load.Stale):
        load.load(store, configs, read, {"seed": 2})
    assert contents(load.load(store, configs, read, {"seed": 1}, per_commit=2)) == sorted({(r[1], r[3]) for r in ROWS})
    assert reads == [["de_a", "de_b"], ["de_c", "fr_a"], ["fr_b", "fr_c"]] and store.meta()["status"] == load.COMPLETE
    assert store.read().count() == len({(r[1], r[3]) for r in ROWS})


def test_rebuild_replaces_in_one_commit(spark, tmp_path, corpus):
    configs, read, _ = corpus
    store = Snapshots(spark, str(tmp_path / "s"), ("lang",))
    load.load(store, configs, read, {"seed": 1})
    load.load(store, configs.where("lang = 'de'"), read, {"seed": 3}, rebuild=True, per_commit=1)
    assert store.version() == 2 and set(store.partitions()) == {("de",)} and store.meta()["completed"] == [["de_a", "de"], ["de_b", "de"], ["de_c", "de"]]


def test_multisets_of_configs(spark):
    frame = lambda *pairs: spark.createDataFrame(list(pairs) or [], load.CONFIGS)
    a, b = ("a", "x"), ("b", "y")
    assert load.compared(frame(a, b), frame(b, a)) == "exact"
    assert load.compared(frame(a), frame(a, a)) == "subset" and load.compared(frame(), frame()) == "exact"
    assert load.compared(frame(a, a), frame(a, b)) == "other"


def test_load_parallel(spark, tmp_path):
    text = lambda i: [f"Ceci est une phrase numero {i} qui est assez longue pour passer ici."]
    rows = [(text(i), None, None, None, "fr", 0.99, 100, 0.9, None, None, "http://x.org", c, i) for c, i in (("fra_Latn", 0), ("fra_Latn", 1), ("fra_Latn", 1), ("all", 2), ("rus_Latn", 3))]
    df = spark.createDataFrame(rows, corpora.PARALLEL_SCHEMA + ", config string, pos int").withColumn("config", F.when(F.col("config") == "fra_Latn", "fr_Latn").otherwise(F.col("config")))
    stop = F.array(F.lit("the"))
    for _ in range(2):
        out = load.load_parallel(spark, str(tmp_path / "p"), df, stop, {"seed": 1})
        assert {r.lang for r in out.collect()} == {"fr"} and out.count() == 2
    assert Snapshots(spark, str(tmp_path / "p"), ("lang",)).version() == 1


def one_by_one(rows, streak, cap):
    """The rules row by row: (place, streak so far) of the rows scanned."""
    out, run, accepted = [], 0, 0
    for place, hit, amount in rows:
        if accepted >= cap:
            break
        if hit == 1:
            run, accepted = 0, accepted + amount
        elif hit == 0:
            run += 1
        out.append((place, run))
        if run >= streak:
            break
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 0, -1]), st.integers(0, 3)), max_size=40), st.integers(1, 5), st.integers(1, 12), st.lists(st.integers(1, 9), min_size=1, max_size=9))
def test_scanned_in_batches_of_any_size(flags, streak, cap, sizes):
    rows = [(3 * i, h, a) for i, (h, a) in enumerate(flags)]
    state, got, at, k = (-1, 0, 0, False), [], 0, 0
    while at < len(rows):
        low = max(0, at - 2)  # rows that come again are passed over
        batch = rows[low : at + sizes[k % len(sizes)]]
        place, hit, amount = (np.array(x, np.int64) for x in zip(*batch))
        first, end, streaks, state = stops.scanned(place, hit, amount, state, streak, cap)
        got += list(zip(place[first:end].tolist(), streaks.tolist()))
        at, k = at + sizes[k % len(sizes)], k + 1
    assert got == one_by_one(rows, streak, cap)


@pytest.mark.parametrize("per_trigger", [1, 3, 100])
def test_stream_equals_batch(spark, tmp_path, per_trigger):
    df = spark.range(400).select(F.col("id").alias("pos"), (F.col("id") % 7).cast("string").alias("config"), (F.xxhash64("id") % 3 == 0).alias("ok"), F.lit("x").alias("text"))
    want = {(r.config, r.pos, r.streak) for r in dedupe.miss_streak_cut(df, "config", ["pos"], F.col("ok"), 6).collect()}
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "pos long, config string, ok boolean, text string"
    run = lambda: stops.scan(spark, folder, schema, "config", "pos", F.col("ok"), 6, 10**9, out, check, per_trigger=per_trigger)
    stops.fed(df.where("pos < 150"), folder, "config", "pos", [60])
    run()
    stops.fed(df.where("pos >= 150"), folder, "config", "pos", [200, 333])
    got = [(r.config, r.pos, r.streak) for r in run().collect()]  # goes on where the first call ended
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) < 400
