"""Word lexicons, frequency lists and overlaps between languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import filters
from tessella.functions import labels as L
from tessella.functions import text as T
from tessella.functions.dims import MAJOR_LATIN, MINOR_LATIN_GROUPS, lang_dim, with_lang
from tessella.operators import pools
from tessella.sources import stores

TOP = 25_000
NORDIC = ("sv", "da", "is", "af", "fi", "no")


def word_counts(df: DataFrame, column: str = "sentence") -> DataFrame:
    """lang, word, count of the words of letters, in lower case."""
    words = F.regexp_extract_all(F.col(column), F.lit(r"(?<![\p{L}\p{N}_])\p{L}++(?![\p{N}_])"), F.lit(0))
    # the lower case of a letter may be two signs, one of them a mark
    rows = df.select("lang", F.explode(words).alias("word")).select("lang", F.lower("word").alias("word")).where(~F.contains("word", F.lit("\u0307")))
    return rows.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("count"))


def lexicon(counts: DataFrame, top: int = TOP) -> DataFrame:
    """The top words of each language with their ranks, ties by word."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "word", "count")


def parse_frequency_lines(lines: DataFrame, sample: int = 10) -> DataFrame:
    """(lang, pos, line) as word and freq. The number's column is what most of the first lines have; a row of the other kind is swapped."""
    parts = F.split(T.trim("line"), rf"{T.SPACE}+")
    rows = lines.withColumn("p", parts).where(F.size("p") >= 2).select("lang", "pos", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    number = lambda c: F.col(c).rlike("^-?[0-9]+$")
    votes = rows.where(F.col("pos") < sample).groupBy("lang").agg((F.count_if(number("a")) > F.count_if(number("b"))).alias("first"))
    rows = rows.join(F.broadcast(votes), "lang", "left")
    use_a = F.when(F.coalesce("first", F.lit(False)), number("a")).otherwise(number("a") & ~number("b"))
    freq = F.when(use_a, F.col("a")).when(number("b"), F.col("b"))
    return rows.select("lang", "pos", F.when(use_a, F.col("b")).otherwise(F.col("a")).alias("word"), freq.alias("f")).where("f is not null").select("lang", "pos", "word", F.expr("try_cast(f as bigint)").alias("freq"))


def word_list(lines: DataFrame, cutoff: int, least: int = 5) -> DataFrame:
    """Word, freq and rank of the first cutoff lines, and whether its script is foreign; without rare, apostrophe-led and invalid words."""
    rows = parse_frequency_lines(lines).where((F.col("pos") < cutoff) & (F.col("freq") >= least) & ~F.startswith("word", F.lit("'"))).withColumn("word", F.lower("word"))
    rows = with_lang(rows.where(T.is_valid_word("word")))
    return rows.select("lang", "word", "freq", (F.col("pos") + 1).alias("rank"), filters.is_script_contaminated("word").alias("contaminated"))


def with_overlaps(words: DataFrame) -> DataFrame:
    """words with the sorted other languages of each word; a word's languages meet as one aggregated row, not as pairs."""
    words = stores.materialized(words, "words")  # both sides of the join read it
    langs = words.groupBy("word").agg(F.array_sort(F.collect_set("lang")).alias("all_langs"))
    return words.join(langs, "word").withColumn("overlaps", F.array_remove("all_langs", F.col("lang"))).drop("all_langs")


def with_relative_rank(words: DataFrame) -> DataFrame:
    """words with relative_rank, from 1 for the first to 0 for the last of its language, ties by word."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "word"))
    n = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    return words.withColumn("relative_rank", F.when(n <= 1, 1.0).otherwise(1 - (place - 1) / (n - 1)))


def keeps_word(lang: str = "lang", overlaps: str = "overlaps") -> Column:
    """Words of minor Latin languages that a major one has too go; needs lang_group."""
    return ~(F.col("lang_group").isin(*MINOR_LATIN_GROUPS) & F.arrays_overlap(overlaps, F.array(*map(F.lit, MAJOR_LATIN))))


def word_weight() -> Column:
    """Weight of a word in samples, by relative rank, length and overlaps."""
    n, over, lang = F.length("word"), F.size("overlaps") > 0, F.col("lang")
    has = lambda code: F.array_contains("overlaps", code)
    length = F.when(n <= 3, 1.30).when(n <= 5, 1.10).otherwise(1.0)
    shared = F.when(~over, 1.0).when(lang.isin(*MAJOR_LATIN), 1.10).when(lang.isin(*NORDIC), 0.85).when((lang == "ru") & has("uk"), 1.25).when((lang == "uk") & has("ru"), 0.75).otherwise(1.0)
    return (0.35 + 1.75 * F.col("relative_rank")) * length * shared


def repeats() -> Column:
    """How often a word seeds an example: one to three by relative rank, two at least where it overlaps."""
    n = F.when(F.col("relative_rank") >= 0.85, 3).when(F.col("relative_rank") >= 0.45, 2).otherwise(1)
    return F.when(F.size("overlaps") > 0, F.greatest(n, F.lit(2))).otherwise(n)


def short_examples(words: DataFrame, seed: int = 42) -> DataFrame:
    """Short texts (lang, word, n, source_type, tokens, text, labels): repeat n of a word is an n-gram of it and n - 1 other words of its language.

    The others are drawn by weight without replacement from all words of the language, never the seed word itself; the
    words of a text are in order of a hash.
    """
    weighted = stores.materialized(words.withColumn("weight", F.greatest(F.lit(1), F.round(F.round(word_weight(), 9) * 1_000_000).cast("long"))).withColumn("repeats", repeats()).select("lang", "word", "weight", "repeats"), "weights")
    rows = weighted.select("lang", "word", F.explode(F.sequence(F.lit(1), "repeats")).alias("n")).withColumn("others", F.col("n") - 1)
    key = lambda *parts: F.concat_ws("\0", F.lit(str(seed)), "lang", "word", F.col("n").cast("string"), *parts)
    rows = pools.weighted_draws(rows, weighted, key(), "others", but="word")
    mixed = F.array_sort(F.transform(F.concat(F.array("word"), F.col("drawn")), lambda w: F.struct(T.md5_number(key(F.lit("order"), w)).alias("k"), w.alias("w"))))
    rows = rows.withColumn("tokens", F.transform(mixed, lambda x: x["w"]))
    label = F.broadcast(lang_dim(words.sparkSession).select("lang", "label"))
    kind = F.element_at(F.array(*map(F.lit, ("unigram", "bigram", "trigram"))), F.size("tokens"))
    return rows.join(label, "lang").select("lang", "word", "n", kind.alias("source_type"), "tokens", F.array_join("tokens", " ").alias("text"), L.bio(F.col("tokens"), "label").alias("labels"))


def short_pools(spark, words: DataFrame, path: str, seed: int = 42) -> DataFrame:
    """Short texts of the words that are kept, stored by language with a manifest of counts."""
    return stores.write_language_map(spark, short_examples(words, seed), path, {"seed": seed})
