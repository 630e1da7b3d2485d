import sys

import pytest
from pyspark.sql import functions as F

from tessella.functions import filters
from tessella.functions.dims import SCRIPTS, script_pattern, with_lang
from tessella.plans import operator_queries

LANGS = ("en", "ru", "ja", "hi", "th")


@pytest.fixture(scope="module")
def letters(spark):
    """All characters, once for each language."""
    text = "".join(chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    parts = [(lang, i, text[i : i + 70_000]) for lang in LANGS for i in range(0, len(text), 70_000)]
    return with_lang(spark.createDataFrame(parts, "lang string, i int, s string").repartition(8))


def test_every_character_by_script(letters):
    """Foreign letters are those of the other scripts, and only those."""
    plain = lambda own: F.regexp_replace("s", script_pattern(tuple(x for x in SCRIPTS if x not in own)), "")
    want = F.coalesce(*(F.when(F.col("script") == k, plain(own)) for k, own in filters.OWN.items() if k in ("Latin", "Cyrillic", "Japanese", "Devanagari", "Thai")))
    got = filters.strip_foreign_letters("s")
    out = letters.select("lang", (F.md5(got.cast("binary")) == F.md5(want.cast("binary"))).alias("same"), (filters.has_foreign_letters("s") == (want != F.col("s"))).alias("has")).collect()
    assert len(out) > 50 and all(r.same and r.has for r in out)


def test_patterns_are_literals(spark, letters):
    """A pattern from a column would be compiled for every row."""
    kinds = (filters.strip_foreign_letters("s"), filters.has_foreign_letters("s"), filters.has_own_letters("s"), filters.is_script_contaminated("s"), filters.reject_reason("s", F.array(F.lit("the"))))
    plan = letters.select(*(k.alias(f"k{i}") for i, k in enumerate(kinds)))._jdf.queryExecution().optimizedPlan()
    used = {a.name() for a in (plan.references().toSeq().apply(i) for i in range(plan.references().size()))}
    assert {"s", "script"} <= used and not used & {"foreign_letters", "own_letters"}


def test_unknown_languages_and_missing_texts(spark):
    rows = with_lang(spark.createDataFrame([("qq", "Слово x"), ("ru", None), (None, "abc"), ("ru", "Слово x")], "lang string, s string"))
    out = rows.select(filters.strip_foreign_letters("s").alias("s"), filters.has_foreign_letters("s").alias("f"), filters.has_own_letters("s").alias("o"), filters.reject_reason("s", F.array(F.lit("the"))).alias("r")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([("Слово x", False, False, None), (None, False, False, None), ("abc", False, False, None), ("Слово ", True, True, None)], key=str)
