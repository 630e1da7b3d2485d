import hashlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tessella.operators import pools


@pytest.mark.parametrize("cell", [64, 1])
def test_exact_distribution(spark, monkeypatch, cell):
    """Ordered pairs drawn without replacement, the row's own value apart, against their exact probabilities (chi-square)."""
    monkeypatch.setattr(pools, "CELL", cell)
    weights = {"a": 1, "b": 2, "c": 5, "d": 12, "own": 7}
    choices = spark.createDataFrame([("x", w, k) for w, k in weights.items()], "lang string, word string, weight long")
    n = 6000
    rows = spark.range(n).select("id", F.lit("x").alias("lang"), F.lit(2).alias("many"), F.lit("own").alias("own"))
    drawn = pools.weighted_draws(rows, choices, F.col("id").cast("string"), "many", but="own").collect()
    assert len(drawn) == n and {r.id for r in drawn} == set(range(n))
    seen = Counter(tuple(r.drawn) for r in drawn)
    total = sum(k for w, k in weights.items() if w != "own")
    chi, cells = 0.0, 0
    for one, two in permutations([w for w in weights if w != "own"], 2):
        expected = n * weights[one] / total * weights[two] / (total - weights[one])
        chi += (seen[one, two] - expected) ** 2 / expected
        cells += 1
    assert sum(seen.values()) == sum(seen[p] for p in permutations("abcd", 2))
    assert chi < 31.3  # 99.9 % point for 11 degrees of freedom
    assert cells == 12


def test_every_value_can_be_drawn(spark):
    """5,000 values in two groups, cells of 64: none is out of reach, and groups that are too small give all they have."""
    choices = spark.createDataFrame([("x", f"w{i}", 1 + i % 9) for i in range(2500)] + [("y", f"v{i}", 10**6) for i in range(2500)] + [("z", "alone", 3), ("two", "p", 1), ("two", "q", 99)], "lang string, word string, weight long")
    rows = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("lang"), F.col("id").cast("string").alias("word"), F.lit(2).alias("n"))
    more = spark.createDataFrame([("z", "alone", 2), ("z", "other", 2), ("two", "q", 2), ("none", "a", 2), ("x", "w1", 0)], "lang string, word string, n int")
    out = pools.weighted_draws(rows.unionByName(more), choices, F.concat_ws("-", "lang", "word"), "n", but="word").collect()
    assert len(out) == 30_005
    few = {(r.lang, r.word): r.drawn for r in out if r.lang in ("z", "two", "none") or r.n == 0}
    assert few == {("z", "alone"): [], ("z", "other"): ["alone"], ("two", "q"): ["p"], ("none", "a"): [], ("x", "w1"): []}
    many = [r for r in out if r.n == 2 and r.lang in "xy"]
    assert all(len(set(r.drawn)) == 2 and {d[0] for d in r.drawn} == {"w" if r.lang == "x" else "v"} for r in many)
    assert len({d for r in many if r.lang == "y" for d in r.drawn}) == 2500
    light, heavy = (sum(int(d[1:]) % 9 == k for r in many if r.lang == "x" for d in r.drawn) for k in (0, 8))
    assert 7 < heavy / light < 11.5


def test_numbering_of_a_part_of_the_pools(spark):
    """Places below a limit are the same whether all rows are numbered or only ranges that begin below it."""
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "reserved").otherwise("main").alias("pool"), F.when(F.col("id") % 10 < 8, "en").otherwise("de").alias("lang"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("sentence"))
    whole = {(r.pool, r.lang, r.idx): r.sentence for r in pools.numbered(df).collect()}
    assert len(whole) == 20_000
    upto = spark.createDataFrame([("main", "en", 500), ("reserved", "de", 3), ("main", "de", 0)], "pool string, lang string, most long")
    part = {(r.pool, r.lang, r.idx): r.sentence for r in pools.numbered(df, upto=upto, counts=pools.slice_counts(df)).collect()}
    assert all(whole[k] == v for k, v in part.items()) and len(part) < 1000
    assert {("main", "en", i) for i in range(500)} | {("reserved", "de", i) for i in range(3)} <= set(part)


def test_repeated_rows_count_once(spark):
    """Documents of rows that are repeated are those of the rows without repeats; all rows meet once, to be counted."""
    from tessella.operators import synth

    rows = [("wiki", lang, f"Sentence {i} of language {lang} goes on.") for lang in ("en", "de", "fr") for i in range(150)]
    make = lambda r, **k: sorted(map(str, synth.build(spark.createDataFrame(r, "source string, lang string, sentence string"), 40, **k).collect()))
    assert make(rows + rows[::2] + rows[::3], repeated=True) == make(rows)


def test_rows_are_hashed_once_for_their_ranges(spark):
    df = spark.createDataFrame([("main", "en", "a")], "pool string, lang string, sentence string")
    joined = pools._sliced(df, 1, ("pool", "lang")).join(F.broadcast(pools.slice_counts(df, 1)), ["pool", "lang", "_slice"])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "md5" in line for line in plan.splitlines())


def test_draws_are_few(spark, monkeypatch):
    """A row is drawn for once more than it lacks at first, and what it gets is what eight draws gave."""
    written, real = [], pools.stores.materialized
    monkeypatch.setattr(pools.stores, "materialized", lambda df, name: written.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name))
    words = spark.createDataFrame([("en", f"w{i}", 1 + i * i) for i in range(9)], "lang string, word string, weight long")
    rows = words.select("lang", "word", F.lit(3).alias("many"))
    got = {r.word: r.drawn for r in pools.weighted_draws(rows, words, F.concat_ws("-", "lang", "word"), "many", but="word").collect()}
    laid, total = [], 0
    for w, weight in sorted((r.word, r.weight) for r in words.collect()):
        total += weight
        laid.append((total, w))
    for word, drawn in got.items():
        want, k = [], 0
        while len(want) < 3:
            x = int(hashlib.md5(f"en-{word}\0{k}".encode()).hexdigest()[:13], 16) * total >> 52
            other = next(w for end, w in laid if x < end)
            want, k = want + [other] * (other != word and other not in want), k + 1
        assert drawn == want
    plans = [p for name, p in written if name == "drawn"]
    assert plans and "sequence(_from" in plans[0] and "_need" in plans[0]
