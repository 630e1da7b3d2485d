"""Queries against their SQL on a few odd documents."""

import duckdb
import pytest

from tessella.plans import operator_queries, queries  # noqa: F401

TEXTS = (
    "Die große Straße ist lang. Sie führt nach Gießen! Ja.",
    "La Straße de Große est ici. Élève à Besançon, où l'on va? GROSSE STRASSE de Große.",
    "the of and to in that is was for it with as. The cities of 12 cars, a_b the of and. ÉCOLE Über x.",
    "« ¿ a) 1) Quoted “text” here … and – more !! 'n huis. Δελτα Слово 漢字 かな カナ 한글 שלום عربي 😀 €5 ☃ ok.",
    "- 1. Ein Punkt. (note) [x] Das ist der und die das ein nicht. http://x.y <b>fett</b> a=b.",
    "le la les de des et un une que. Le chat est sur la table et de la maison. ",
    "el la de que y en un por. \n\n  El perro de la casa y el gato de la que. Nueva York ciudad.",
    "", "   ", "x", "ß", "1 2 3 4 5 6. 7 8 9.",
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, TEXTS[i % len(TEXTS)] + ("" if i < len(TEXTS) else f" Again {TEXTS[i // 5 % len(TEXTS)]}"), ("de", "fr", "en", "es")[i // 3 % 4], ("web", "wiki")[i % 2]) for i in range(60)]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def same(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = sorted((tuple(r) for r in queries.QUERIES[name](spark, folder).collect()), key=str)
    assert got == sorted(con.sql(queries.ORACLE_SQL[name]).fetchall(), key=str) and got


def test_refiltered(spark, folder):
    """The sharp s has no capital of one sign."""
    same(spark, folder, "refiltered")


def test_refiltered_holds_no_language_whole(spark, folder):
    """No aggregate collects or joins the sentences of a language."""
    plan = queries.QUERIES["refiltered"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("collect_set", "collect_list", "listagg", "array_join"))


@pytest.mark.parametrize("name", ["scripted_sentences", "scripted_reasons", "cleaned_examples"])
def test_scripts(spark, folder, name):
    same(spark, folder, name)


def test_words_are_counted_once(spark, folder, monkeypatch):
    """The three lists are read from written counts."""
    plans, real = [], queries.flows.word_array
    monkeypatch.setattr(queries.flows, "word_array", lambda counts, *a: plans.append(counts._jdf.queryExecution().optimizedPlan().toString()) or real(counts, *a))
    queries.QUERIES["major_latin_hits"](spark, folder)
    assert len(plans) == 3 and not any("Aggregate" in p for p in plans)


@pytest.mark.parametrize("name", ["phrase_sentences", "english_leak_policy", "major_latin_leaks", "refilter_rejects", "short_text_examples"])
def test_leaks_phrases_and_short_texts(spark, folder, name):
    same(spark, folder, name)
