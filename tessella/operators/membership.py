"""Which words and phrases of sentences are in a dictionary, for dictionaries of any size.

Words are exploded and joined to the dictionary by equality, behind a Bloom filter: a bitmap of BITS bits, whatever the
number of words, made by Spark's bitmap aggregates and broadcast as rows of 4 KB. Words that are certainly not in the
dictionary go no further than their task; what is left is counted per row and word before it is shuffled. A row's words
never meet a list of words.

Phrases are found by an Aho-Corasick automaton that is broadcast, as long as the phrases have at most AUTOMATON characters;
beyond, sequences of words are joined to the phrases by equality. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions import filters
from tessella.functions import text as T
from tessella.sources.stores import materialized

#: Bits of the filter, 8 MB at most; bits of one row of it, as Spark's bitmap functions have them.
BITS, BUCKET = 1 << 26, 32_768
#: Characters of phrases that an automaton is made of.
AUTOMATON = 8_000_000


def _bit(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BITS)) + 1


def bloom(words: DataFrame) -> DataFrame:
    """(_bucket, _longs) of a column word: at most BITS / BUCKET rows, of 64 bits a number, so that a bit is read without text of it."""
    rows = words.select(_bit(F.col("word")).alias("x"))
    maps = rows.groupBy(F.bitmap_bucket_number("x").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("_bitmap"))
    number = lambda i: F.conv(F.hex(F.substring("_bitmap", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return maps.select("_bucket", F.transform(F.sequence(F.lit(0), F.lit(BUCKET // 64 - 1)), number).alias("_longs"))


def maybe_in(df: DataFrame, bitmap: DataFrame) -> DataFrame:
    """The rows of df whose word may be in the dictionary of a bitmap; none that is in it is lost."""
    rows = df.withColumn("_bit", _bit(F.col("word"))).withColumn("_bucket", F.bitmap_bucket_number("_bit")).withColumn("_at", F.bitmap_bit_position("_bit"))
    # the first of eight bytes has the highest bits of a number
    hit = F.expr("getbit(get(_longs, cast(_at div 64 as int)), cast(56 - 8 * (_at div 8 % 8) + _at % 8 as int)) = 1")
    return rows.join(F.broadcast(bitmap), "_bucket").where(hit).drop("_bit", "_bucket", "_at", "_longs")


def with_plurals(words: DataFrame) -> DataFrame:
    """A dictionary with the plurals of its words, so that one look-up finds a word and what it would be without its ending."""
    word = F.col("word")
    forms = F.array(word, F.concat(word, F.lit("s")), F.when(word.endswith("y") & (F.length(word) > 1), F.concat(F.regexp_replace(word, "y$", ""), F.lit("ies"))))
    return words.select(F.explode(forms).alias("word")).where("word is not null").distinct()


def word_hits(df: DataFrame, key: str, column: str, dictionary: DataFrame) -> DataFrame:
    """(key, hits): how many words of a text are in a dictionary (word, in lower case, each once); keys without a hit are left out.

    key is unique in df. The dictionary's side has one row a word, so a word that every text has is Spark's to split.
    """
    words = dictionary.select("word").where("word is not null").distinct()
    found = df.select(key, F.explode(T.words(column)).alias("word")).select(key, F.lower("word").alias("word"))
    counts = maybe_in(found, bloom(words)).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(words, "word").groupBy(key).agg(F.sum("n").alias("hits"))


def english_leaks(df: DataFrame, key: str, column: str, stop: DataFrame, broad: DataFrame | None = None) -> DataFrame:
    """df with leak, the rule of filters.english_leak with dictionaries of any size; df has the columns of with_lang() and a unique key.

    Only texts that are ASCII enough are taken apart.
    """
    ascii_words = F.regexp_count(F.lower(F.col(column)), F.lit(r"(?<![\p{L}\p{N}_])[a-z]++(?![\p{L}\p{N}_])"))
    judged = df.where("lang <> 'en'").select(key, column, "lang", "min_stop", "secondary", "min_hits", "min_hit_share", "min_ascii_share", T.alpha_count(column).alias("_alpha"), ascii_words.alias("_ascii"))
    # written, as it is read for the hits of either dictionary and for what they are joined to
    judged = materialized(judged.where("_alpha >= 4 and _ascii >= 0.70 * _alpha"), "judged")
    first = word_hits(judged, key, column, stop).withColumnRenamed("hits", "_hits")
    found = judged.join(first, key).where(F.col("_hits") >= F.coalesce("min_stop", F.lit(3)))
    if broad is not None:
        found = materialized(found, "stopped")
        wide = word_hits(found, key, column, with_plurals(broad)).withColumnRenamed("hits", "_wide")
        joint = F.col("_hits") + F.coalesce("_wide", F.lit(0))
        second = (joint >= F.col("min_hits")) & (joint / F.col("_alpha") >= F.col("min_hit_share")) & (F.col("_ascii") / F.col("_alpha") >= F.col("min_ascii_share"))
        found = found.join(wide, key, "left").where(~F.coalesce("secondary", F.lit(True)) | second)
    return df.join(found.select(key, F.lit(True).alias("leak")), key, "left").withColumn("leak", F.coalesce("leak", F.lit(False)))


def phrase_hits(df: DataFrame, key: str, column: str, phrases: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """The keys of df whose text (words parted by single blanks) has a phrase of phrases (phrase, of the same form) at word boundaries."""
    known = phrases.select("phrase").where("phrase <> ''").distinct()
    # how many words phrases have: a number for each length that occurs
    size = known.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("n"), F.collect_set(F.size(F.split("phrase", " "))).alias("lengths")).first()
    if size["n"] <= most:
        return _by_automaton(df, key, column, [r["phrase"] for r in known.collect()])
    if not size["lengths"]:
        return df.select(key).limit(0)
    least, lengths = min(size["lengths"]), sorted(size["lengths"])
    first = lambda c, n: F.substring_index(c, " ", n)
    # one row for each word, with what follows it up to the longest phrase; most go no further than the words that phrases begin with
    rows = df.select(key, F.explode(word_sequences(column, least, lengths[-1])).alias("_s")).withColumn("word", first("_s", least))
    rows = maybe_in(rows, bloom(known.select(first("phrase", least).alias("word"))))
    if len(lengths) > 1:
        rows = rows.withColumn("_n", F.size(F.split("_s", " "))).select(key, F.explode(F.array_compact(F.array(*(F.when(F.col("_n") >= n, first("_s", n)) for n in lengths)))).alias("word"))
        rows = maybe_in(rows, bloom(known.select(F.col("phrase").alias("word"))))
    return rows.join(known, F.col("word") == F.col("phrase"), "left_semi").select(key).distinct()


def word_sequences(c: Column | str, least: int, most: int) -> Column:
    """For each word of a text (words parted by single blanks) the sequence of most words that begins with it, or of fewer at the end, but least."""
    # a match takes a word and looks at the sequence ahead, so that no lists are cut and joined
    return F.regexp_extract_all(T._c(c), F.lit(rf"(?=([^ ]++(?: [^ ]++){{{least - 1},{most - 1}}}))[^ ]++"), F.lit(1))


def _by_automaton(df: DataFrame, key: str, column: str, phrases: list[str]) -> DataFrame:
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(f" {p} ", True)
    automaton.make_automaton()
    shared = df.sparkSession.sparkContext.broadcast(automaton) if phrases else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared is None:
            return
        for batch in batches:
            found = [t is not None and next(shared.value.iter(f" {t} "), None) is not None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(found, pa.bool_()))], names=[key])

    return df.select(key, column).mapInArrow(run, StructType([df.schema[key]])).distinct()


def titlecase_entities(df: DataFrame, key: str, column: str, places: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """df with is_name, the rule of filters.titlecase_entity with a table of places (place); df has the columns of with_lang() and a unique key."""
    shape = df.select(key, T.phrase_key(F.array_join(T.alpha_words(column), " ")).alias("_text"), filters.titlecase_shape(column).alias("_s")).where(F.col("_s.named"))
    phrases = places.select(T.phrase_key("place").alias("phrase")).where(F.size(F.split("phrase", " ")).between(2, 6))
    placed = phrase_hits(shape, key, "_text", phrases, most)
    names = shape.where("_s.short").select(key).unionByName(placed).distinct()
    return df.join(names.withColumn("is_name", F.lit(True)), key, "left").withColumn("is_name", F.coalesce("is_name", F.lit(False)))
