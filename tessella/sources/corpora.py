"""Readers of the five corpora, each a lazy plan to (source, lang, pos, sentence) or to scored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import filters
from tessella.functions import text as T
from tessella.functions.dims import PARALLEL, WIKI, with_canonical, with_lang
from tessella.operators import dedupe
from tessella.sources import stores

# fixed values: codes of the pair corpus that stand for another language
SMOL_CODES = {"pt-PT": "pt", "yue": "zh", "ar-MA": "ar", "arz": "ar", "aeb": "ar", "ayl": "ar", "apd": "ar"}


# ---- encyclopedia articles: (lang, pos, title, text)
def article_paragraphs(articles: DataFrame) -> DataFrame:
    """Leading paragraphs of articles that are long enough for their language, longest first, as (lang, pos, title, par_no, paragraph).

    The share of paragraphs kept is the language's, plus a tenth (up to 0.9) where two long paragraphs follow each other.
    """
    rows = with_lang(articles).where(F.length("text") >= F.col("min_chars")).withColumn("pars", T.paragraphs(T.strip_markup("text"))).where(F.size("pars") > 0)
    long_ = F.transform("pars", lambda p: F.length(p) >= F.col("long_paragraph"))
    streak = F.exists(F.arrays_zip(F.slice("_long", 1, F.size("_long") - 1).alias("a"), F.slice("_long", 2, F.size("_long")).alias("b")), lambda x: x["a"] & x["b"])
    rows = rows.withColumn("_long", long_).withColumn("_streak", (F.size("_long") > 1) & streak)
    share = F.when(F.col("_streak"), F.least(F.lit(0.90), F.col("paragraph_share") + 0.10)).otherwise(F.col("paragraph_share"))
    rows = rows.withColumn("pars", F.slice("pars", 1, F.greatest(F.lit(1), F.floor(F.size("pars") * share).cast("int"))))
    ordered = F.array_sort(F.transform("pars", lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p"))))
    return rows.select("lang", "pos", "title", F.posexplode(F.transform(ordered, lambda x: x["p"])).alias("par_no", "paragraph"))


def article_sentences(articles: DataFrame, stop: Column, **lists: Column) -> DataFrame:
    """Clean, valid sentences of articles in reading order, within each language's cap, without duplicates."""
    pars = article_paragraphs(articles)
    rows = pars.select("lang", "pos", "par_no", F.posexplode(T.segments("paragraph")).alias("no", "sentence"))
    rows = filters.post_cleaned(with_lang(rows), "sentence", stop, **lists)
    rows = dedupe.first_wins(rows.select("lang", "wiki_cap", "pos", "par_no", "no", "sentence"), ["lang", "sentence"], ["pos", "par_no", "no"])
    rows = dedupe.placed(rows, ["lang"], ["pos", "par_no", "no"]).where(F.col("_place") <= F.col("wiki_cap"))
    return rows.select(F.lit("wiki").alias("source"), "lang", F.col("_place").alias("pos"), "sentence")


def priority_articles(articles: DataFrame, scan: int = WIKI["scan"]) -> DataFrame:
    """Of the first scan articles of a language, those long enough, longest first."""
    rows = with_lang(dedupe.capped(articles, "lang", ["pos"], scan)).where(F.length("text") >= F.col("min_chars"))
    return dedupe.placed(rows.select(*articles.columns), ["lang"], [-F.length("text"), "pos"], "priority")


def shuffled_articles(articles: DataFrame, seed: int) -> DataFrame:
    """Articles numbered anew by hash."""
    order = T.md5_number(F.concat_ws("\0", F.lit(str(seed)), "lang", F.col("pos").cast("string")))
    return dedupe.placed(articles, ["lang"], [order, "pos"], "_new").withColumn("pos", F.col("_new")).drop("_new")


# ---- parallel corpus rows
PARALLEL_SCHEMA = (
    "og_chunks array<string>, og_full_text string, translated_chunks array<string>, translated_text string, og_language string, og_language_score double, og_token_count bigint, "
    "og_quality_score double, edu_score_raw double, edu_score double, url string"
)


def config_language(config: Column | str) -> Column:
    """Language code of a configuration such as fra_Latn; null for 'all'."""
    c = T._c(config)
    return F.when(c != "all", F.lower(F.split_part(c, F.lit("_"), F.lit(1))))


def matching_configs(configs: DataFrame) -> DataFrame:
    """(config, lang) of configurations of known languages; a Latin-script one only for a language written in Latin."""
    rows = configs.withColumn("lang", config_language("config")).where("lang is not null")
    rows = with_lang(with_canonical(rows)).where(F.col("lang_group").isNotNull())
    return rows.where(~F.col("config").rlike("_Latn$") | F.col("latin")).select("config", "lang")


def chunks(which: str, whole: str) -> Column:
    """Non-empty chunks, or the whole text as one."""
    kept = F.filter(F.coalesce(which, F.array().cast("array<string>")), lambda c: T.trim(c) != "")
    rest = F.filter(F.array(T.trim(F.coalesce(whole, F.lit("")))), lambda c: c != "")
    return F.when(F.size(kept) > 0, kept).otherwise(rest)


def longest(array: Column, n: int = 2) -> Column:
    keyed = F.array_sort(F.transform(array, lambda c, i: F.struct((-F.length(c)).alias("n"), i.alias("i"), c.alias("c"))))
    return F.transform(F.slice(keyed, 1, n), lambda x: x["c"])


def parallel_records(rows: DataFrame, stop: Column, translated: bool = False, **lists: Column) -> DataFrame:
    """Scored sentence records of (lang, pos, PARALLEL_SCHEMA) rows; cheap row tests come before any sentence is built.

    Latin source texts give the lines of their two longest chunks; other and translated texts are segmented.
    """
    rows = with_lang(rows.where(filters.parallel_row_ok()))
    if translated:
        rows = rows.where(filters.translated_ok())
        pieces = F.flatten(F.transform(chunks("translated_chunks", "translated_text"), T.segments))
    else:
        lines = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(longest(chunks("og_chunks", "og_full_text")), lambda c: F.split(c, r"\r\n|[\n\r]"))), T.trim), lambda x: x != ""))
        pieces = F.when(F.col("latin"), lines).otherwise(F.flatten(F.transform(chunks("og_chunks", "og_full_text"), T.segments)))
    rows = rows.select("lang", "pos", filters.row_score().alias("_row"), "og_language_score", "og_token_count", filters.quality_score().alias("og_quality_score"), (filters.edu_score() if translated else F.lit(None).cast("double")).alias("edu_score_raw"), F.lower("og_language").alias("source_language"), filters.is_wikipedia("url").alias("is_wikipedia"), F.posexplode(pieces).alias("no", "sentence"))
    rows = filters.post_cleaned(with_lang(rows), "sentence", stop, **lists)
    n = F.size(F.regexp_extract_all(F.lower("sentence"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).cast("long")
    rows = rows.withColumn("sentence_token_length", n).withColumn("score", F.col("_row") + F.least(F.col("sentence_token_length") / 8.0, F.lit(4.0)))
    rows = dedupe.first_wins(rows.select("lang", "pos", "no", "sentence", "sentence_token_length", "og_language_score", "og_token_count", "og_quality_score", "edu_score_raw", "source_language", "is_wikipedia", "score"), ["lang", "pos", "sentence"], ["no"])
    return rows


def parallel_sentences(rows: DataFrame, stop: Column, include_english: bool = True, **lists: Column) -> DataFrame:
    """Records within stop rules and quotas: the miss streak cuts the scan, the best by length bucket are kept."""
    scanned = dedupe.miss_streak_cut(rows, "lang", ["pos"], filters.parallel_row_ok(), PARALLEL["miss"]).drop("streak")
    own = dedupe.first_wins(parallel_records(scanned, stop, **lists), ["lang", "sentence"], ["pos", "no"])
    if include_english:
        english = parallel_records(scanned.where(F.col("lang").isin(*PARALLEL["english_for"])), stop, True, **lists)
        english = dedupe.every_nth(english, "lang", ["pos", "no"], PARALLEL["every"]).withColumn("lang", F.lit("en"))
        own = own.unionByName(dedupe.first_wins(english, ["sentence"], ["pos", "no"]))
    own = own.withColumn("pos", F.struct("pos", "no"))
    return dedupe.bucketed_selection(own, "lang", PARALLEL["kept"]).drop("bucket", "no", "pos")


# ---- sentence pairs and documents with configurations prefix__source_target
def parse_config(config: Column | str) -> Column:
    pair = F.split_part(T._c(config), F.lit("__"), F.lit(2))
    return F.when(T._c(config).rlike("^.*?__.*?_"), F.struct(F.regexp_extract(pair, "^(.*?)_", 1).alias("source_lang"), F.regexp_extract(pair, "^.*?_(.*)$", 1).alias("target_lang")))


def pair_sentences(rows: DataFrame, cap: int = 5_000, seed: int = 42) -> DataFrame:
    """(config, pos, src, srcs, trg, trgs): every target, and each source language from its first configuration only."""
    codes = F.create_map(*(F.lit(x) for p in SMOL_CODES.items() for x in p))
    rows = rows.withColumn("p", parse_config("config")).where("p is not null").select("*", "p.*")
    firsts = rows.groupBy("source_lang").agg(F.min("config").alias("first_config"))
    rows = rows.join(F.broadcast(firsts), "source_lang")
    listed = lambda many, one: F.coalesce(many, F.when(F.col(one).isNotNull(), T.segments(one) if one == "trg" else F.array(one)))
    target = rows.select(F.coalesce(F.try_element_at(codes, F.col("target_lang")), F.col("target_lang")).alias("lang"), "config", "pos", F.posexplode(listed(F.col("trgs"), "trg")).alias("no", "sentence"))
    source = rows.where("config = first_config").select(F.col("source_lang").alias("lang"), "config", "pos", F.posexplode(listed(F.col("srcs"), "src")).alias("no", "sentence"))
    out = with_canonical(target.unionByName(source)).withColumn("sentence", F.explode(T.split_list("sentence"))).withColumn("sentence", T.collapse_spaces(T.strip_brackets("sentence")))
    out = with_lang(out).where(F.col("lang_group").isNotNull() & filters.is_valid("sentence")).select("lang", "config", "pos", "no", "sentence")
    out = dedupe.first_wins(out, ["lang", "sentence"], ["config", "pos", "no"])
    order = T.md5_number(F.concat_ws("\0", F.lit(str(seed)), "lang", "sentence"))
    return dedupe.capped(out.withColumn("_h", order), "lang", ["_h", "sentence"], cap).drop("_h")


# ---- tab-separated sentences: id, lang, text
def tab_separated(spark: SparkSession, path: str) -> DataFrame:
    """Rows of three fields or more; quotes and backslashes are plain characters."""
    lines = spark.read.text(path).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 3)
    return lines.select(F.expr("try_cast(f[0] as bigint)").alias("pos"), F.col("f")[1].alias("lang"), F.col("f")[2].alias("text"))


def tab_sentences(rows: DataFrame, remaps: dict[str, str] | None = None) -> DataFrame:
    """(pos, lang, text) under each language's cap, in file order: letters of other scripts go, rows without own letters too."""
    if remaps:
        table = F.create_map(*(F.lit(x) for p in remaps.items() for x in p))
        rows = rows.withColumn("lang", F.coalesce(F.try_element_at(table, F.lower(T.trim("lang"))), F.col("lang")))
    rows = with_lang(with_canonical(rows)).where(F.col("lang_group").isNotNull())
    # exploding what is kept strips a text once, and ordering by range reads its input twice
    kept = F.filter(F.array(T.trim(filters.strip_foreign_letters("text"))), filters.has_own_letters)
    rows = stores.materialized(rows.select("lang", "pos", "tatoeba_cap", F.explode(kept).alias("sentence")), "tab")
    return dedupe.capped(rows, "lang", ["pos"], F.col("tatoeba_cap")).select("lang", "pos", "sentence")


def parse_remaps(specs: list[str]) -> dict[str, str]:
    """old=new pairs."""
    out = {}
    for spec in specs:
        old, sep, new = spec.partition("=")
        if not sep or not old.strip() or not new.strip():
            raise ValueError(f"not old=new: {spec}")
        out[old.strip().lower()] = new.strip().lower()
    return out


# ---- plain lists
def frequency_lines(spark: SparkSession, folder: str, langs: list[str]) -> DataFrame:
    """(lang, pos, line) of {lang}_50k.txt, or {lang}_full.txt where that is missing."""
    out = None
    fs = spark._jvm.org.apache.hadoop.fs
    for lang in langs:
        paths = [f"{folder}/{lang}_50k.txt", f"{folder}/{lang}_full.txt"]
        there = [p for p in paths if fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs.Path(p))]
        if not there:
            raise FileNotFoundError(paths[0])
        rows = spark.read.text(there[0], wholetext=True).select(F.lit(lang).alias("lang"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
        out = rows if out is None else out.unionByName(rows)
    return out


def formulas(df: DataFrame, column: str = "formula", least: int = 8, most: int = 300) -> DataFrame:
    return df.select(T.clean_formula(column).alias("formula")).where(F.length("formula").between(least, most))


def refresh(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources in one table (source, lang, pos, sentence)."""
    out = None
    for name in ("wiki", "ft", "tatoeba", "smol", "freq"):
        if name in sources:
            part = sources[name].select(F.lit(name).alias("source"), "lang", "sentence")
            out = part if out is None else out.unionByName(part)
    return out
