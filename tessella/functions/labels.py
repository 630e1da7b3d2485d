"""Token labels: O is 0, B- of language i is 2i + 1, I- is 2i + 2. Array functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.dims import LANGUAGES

IGNORED = -100


def label_dim(spark: SparkSession) -> DataFrame:
    """label id -> label, language (null for O) and whether it begins a span."""
    rows = [(0, "O", None, False)] + [(2 * i + 1 + k, f"{'BI'[k]}-{lang.upper()}", lang, k == 0) for i, lang in enumerate(LANGUAGES) for k in (0, 1)]
    return spark.createDataFrame(rows, "label_id int, label string, lang string, begins boolean")


def tokens(c: Column | str) -> Column:
    """Default tokenizer: words and single signs."""
    return F.regexp_extract_all(T._c(c), F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"), F.lit(0))


def token_ids(tokens_: Column, size: int = 32_000, reserved: int = 1000) -> Column:
    """Ids of tokens by hash, for use without a vocabulary."""
    return F.transform(tokens_, lambda t: (reserved + F.pmod(F.xxhash64(t), F.lit(size - reserved))).cast("long"))


def bio(tokens_: Column, label: Column | str) -> Column:
    """B- for the first token of a sentence and I- for the others."""
    k = T._c(label)
    return F.transform(tokens_, lambda _, i: F.when(i == 0, 2 * k + 1).otherwise(2 * k + 2).cast("long"))


def label_language(c: Column) -> Column:
    """Index of a label's language; null for O and ignored."""
    return F.when(c > 0, F.floor((c - 1) / 2).cast("int"))


def drop_punct(tokens_: Column) -> Column:
    return F.filter(tokens_, lambda t: ~t.rlike(r"^▁?\p{P}+$"))


def model_inputs(ids: Column, labels: Column, start: int, end: int, most: int = 512) -> Column:
    """input_ids with special tokens, attention_mask and labels, cut to most."""
    body, tags = F.slice(ids, 1, most - 2), F.slice(labels, 1, most - 2)
    one = lambda x: F.array(F.lit(x).cast("long"))
    mask = F.array_repeat(F.lit(1).cast("long"), F.size(body) + 2)
    return F.struct(F.concat(one(start), body, one(end)).alias("input_ids"), mask.alias("attention_mask"), F.concat(one(IGNORED), tags, one(IGNORED)).alias("labels"))


def wordpiece_labels(word_ids: Column, labels: Column) -> Column:
    """Labels of pieces: a word's first piece keeps its label, later ones have the I- label; -100 without a word."""

    def of(ids: Column, tags: Column, w: Column, i: Column) -> Column:
        own = F.get(tags, w)
        again = (i > 0) & (F.get(ids, i - 1) == w)
        return F.when(w.isNull(), F.lit(IGNORED).cast("long")).when(F.coalesce(again, F.lit(False)) & (own % 2 == 1), own + 1).otherwise(own)

    return T.bind(F.struct(word_ids.alias("w"), labels.alias("l")), lambda x: F.transform(x["w"], lambda w, i: of(x["w"], x["l"], w, i)))


def languages_present(labels: Column) -> Column:
    """Indices of the languages in a label array, in canonical order."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(labels, lambda x: x > 0), lambda x: F.floor((x - 1) / 2).cast("int"))))


def multi_hot(indices: Column, n: int = len(LANGUAGES)) -> Column:
    # bound, as an expression inside the lambda runs once for every language
    return T.bind(indices, lambda found: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(found, i.cast("int")).cast("int")))


def decoded_list(c: Column | str, kind: str = "array<bigint>") -> Column:
    """A list stored as JSON text."""
    return F.from_json(T._c(c), kind)


def wrap_outside(tokens_: Column, labels: Column, before: Column, after: Column) -> Column:
    """(tokens, labels) between formatting tokens labelled O."""
    none = lambda a: F.transform(a, lambda _: F.lit(0).cast("long"))
    return F.struct(F.concat(before, tokens_, after).alias("tokens"), F.concat(none(before), labels, none(after)).alias("labels"))


def swapped(zipped: Column, i: Column, j: Column) -> Column:
    """An array with two places exchanged."""
    return F.transform(zipped, lambda x, k: F.when(k == i, F.get(zipped, j)).when(k == j, F.get(zipped, i)).otherwise(x))
