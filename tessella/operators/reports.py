"""Counts, coverage, capacity and evaluation reports as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.dims import GROUP_OF, LANGUAGES, lang_dim


def label_counts(df: DataFrame) -> DataFrame:
    """Sentences (B-) and tokens (B- and I-) by split and language."""
    tags = df.select("split", F.explode("labels").alias("x")).where("x > 0")
    out = tags.groupBy("split", F.floor((F.col("x") - 1) / 2).cast("int").alias("label")).agg(F.count_if(F.col("x") % 2 == 1).alias("n_sentences"), F.count(F.lit(1)).alias("n_tokens"))
    return out.join(F.broadcast(lang_dim(df.sparkSession).select("lang", "label")), "label").select("split", "lang", "n_sentences", "n_tokens")


def with_share(df: DataFrame, value: str, by: str, name: str = "share") -> DataFrame:
    """df with a value's percentage of its group's total."""
    return df.withColumn(name, F.round(100 * F.col(value) / F.sum(value).over(Window.partitionBy(by)), 2))


def token_pairs(df: DataFrame) -> DataFrame:
    """(split, label, token_id, count) of unmasked labelled tokens."""
    pairs = df.select("split", F.explode(F.arrays_zip("input_ids", "attention_mask", "labels")).alias("x")).where("x.attention_mask = 1 and x.labels > 0")
    return pairs.groupBy("split", F.floor((F.col("x.labels") - 1) / 2).cast("int").alias("label"), F.col("x.input_ids").alias("token_id")).agg(F.count(F.lit(1)).alias("count"))


def vocabulary_rollup(df: DataFrame) -> DataFrame:
    """Token counts by language, by group and overall, told apart by level; one pass with grouping sets."""
    dim = df.sparkSession.createDataFrame([(i, lang, GROUP_OF[lang]) for i, lang in enumerate(LANGUAGES)], "label int, lang string, lang_group string")
    rows = token_pairs(df).join(F.broadcast(dim), "label")
    out = rows.groupingSets([["split", "lang", "token_id"], ["split", "lang_group", "token_id"], ["split", "token_id"]], "split", "lang", "lang_group", "token_id").agg(F.sum("count").alias("count"), F.grouping("lang").alias("gl"), F.grouping("lang_group").alias("gg"))
    level = F.when(F.col("gl") == 0, "lang").when(F.col("gg") == 0, "group").otherwise("overall")
    return out.select("split", level.alias("level"), "lang", "lang_group", "token_id", "count")


def vocabulary_size(df: DataFrame) -> DataFrame:
    return df.agg((F.max(F.array_max("input_ids")) + 1).alias("vocab_size"))


def sampling_stats(df: DataFrame, key: str = "doc") -> DataFrame:
    """Examples with a language and its tokens, for all languages; those without examples have zeros."""
    tags = df.select(key, F.explode("labels").alias("x")).where("x > 0").select(key, F.floor((F.col("x") - 1) / 2).cast("int").alias("label"))
    per = tags.groupBy("label", key).agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.count(F.lit(1)).alias("n_examples"), F.sum("n").alias("n_tokens"))
    dim = lang_dim(df.sparkSession).select("label", "lang", "lang_group")
    return dim.join(per, "label", "left").select("lang", "lang_group", F.coalesce("n_examples", F.lit(0)).alias("n_examples"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def missing_languages(df: DataFrame) -> DataFrame:
    return lang_dim(df.sparkSession).select("lang", "lang_group").join(df.select("lang").distinct(), "lang", "left_anti")


ARTIFACT_CHARS, ARTIFACT_SCORE, ARTIFACT_WEIGHT = 4, 0.5, 0.35


def span_coverage(spans: DataFrame) -> DataFrame:
    """Per document and language of (doc, pos, lang, start, end, score): weighted characters, share, confidence and rank score.

    Spans of at most four characters with a score of 0.5 or more are artifacts and count a third.
    """
    n = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    w = n * F.when((n <= ARTIFACT_CHARS) & (F.col("score") >= ARTIFACT_SCORE), ARTIFACT_WEIGHT).otherwise(1.0)
    rows = spans.where((F.col("lang") != "o") & F.col("start").isNotNull() & F.col("end").isNotNull()).withColumn("w", w)
    out = rows.groupBy("doc", "lang").agg(F.sum("w").alias("char_coverage"), F.sum(F.col("w") * F.col("score")).alias("_cs"), F.count(F.lit(1)).alias("entity_count"), F.min("pos").alias("first_pos"))
    out = out.withColumn("avg_confidence", F.col("_cs") / F.col("char_coverage")).withColumn("coverage_pct", F.col("char_coverage") / F.sum("char_coverage").over(Window.partitionBy("doc")))
    return out.withColumn("rank_score", F.col("coverage_pct") * F.col("avg_confidence")).drop("_cs")


def ranked(stats: DataFrame) -> DataFrame:
    """stats with place by rank score within a document, ties by first appearance."""
    return stats.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("rank_score"), "first_pos", "lang")))


def predictions(stats: DataFrame, truth: DataFrame, ratio: float = 0.9) -> DataFrame:
    """Per document the best language, or the true one if it is second with at least ratio of the best score."""
    two = ranked(stats).where("place <= 2").groupBy("doc").agg(
        F.max(F.when(F.col("place") == 1, F.col("lang"))).alias("first"), F.max(F.when(F.col("place") == 1, F.col("rank_score"))).alias("s1"),
        F.max(F.when(F.col("place") == 2, F.col("lang"))).alias("second"), F.max(F.when(F.col("place") == 2, F.col("rank_score"))).alias("s2"),
    )
    close = F.coalesce((F.col("second") == F.col("true_lang")) & (F.col("s2") >= F.col("s1") * ratio), F.lit(False))
    return truth.join(two, "doc", "left").select("doc", "true_lang", F.when(close, F.col("second")).otherwise(F.coalesce("first", F.lit(""))).alias("pred_lang"), close.alias("by_runner_up"))


def accuracy(df: DataFrame, truth: str = "true_lang", predicted: str = "pred_lang") -> DataFrame:
    """Rows, right ones and accuracy, by true language and overall (null)."""
    right = F.count_if(F.col(truth) == F.col(predicted))
    return df.rollup(truth).agg(F.count(F.lit(1)).alias("total"), right.alias("correct"), F.round(right / F.count(F.lit(1)), 6).alias("accuracy"))


def first_errors(df: DataFrame, n: int = 3, key: str = "doc") -> DataFrame:
    wrong = df.where(F.col("true_lang") != F.col("pred_lang"))
    return wrong.withColumn("place", F.row_number().over(Window.partitionBy("true_lang").orderBy(key))).where(F.col("place") <= n)


def best_language(acc: DataFrame, least: int = 5) -> DataFrame:
    return acc.where((F.col("total") > least) & F.col("true_lang").isNotNull()).orderBy(F.desc("accuracy"), F.desc("total"), "true_lang").limit(1)


def micro_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Micro precision, recall, F1 and exact matches of multi-hot arrays."""
    both = F.aggregate(F.zip_with(gold, predicted, lambda a, b: a * b), F.lit(0), lambda x, y: x + y)
    total = lambda c: F.aggregate(F.col(c), F.lit(0), lambda x, y: x + y)
    s = df.agg(F.sum(both).alias("tp"), F.sum(total(predicted)).alias("p"), F.sum(total(gold)).alias("g"), F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("exact"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    s = s.select(F.round(ratio("tp", "p"), 6).alias("precision"), F.round(ratio("tp", "g"), 6).alias("recall"), F.round("exact", 6).alias("exact_match"))
    return s.withColumn("f1", F.round(F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)), 6))


def label_spans(df: DataFrame, column: str, key: str = "doc") -> DataFrame:
    """Spans (doc, kind, start, end) of a label array: a span goes on while I- of its language follows."""
    x = df.select(key, F.posexplode(column).alias("at", "x")).withColumn("lang", F.when(F.col("x") > 0, F.floor((F.col("x") - 1) / 2)))
    w = Window.partitionBy(key).orderBy("at")
    new = F.col("lang").isNotNull() & ((F.col("x") % 2 == 1) | ~F.lag("lang").over(w).eqNullSafe(F.col("lang")))
    x = x.withColumn("new", new.cast("int")).withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("lang is not null")
    return x.groupBy(key, "no", "lang").agg(F.min("at").alias("start"), F.max("at").alias("end")).drop("no")


def span_scores(df: DataFrame, gold: str, predicted: str, key: str = "doc") -> DataFrame:
    """Precision, recall and F1 of exact spans."""
    g, p = label_spans(df, gold, key).withColumn("g", F.lit(1)), label_spans(df, predicted, key).withColumn("p", F.lit(1))
    j = g.join(p, [key, "lang", "start", "end"], "full").agg(F.sum(F.coalesce("g", F.lit(0)) * F.coalesce("p", F.lit(0))).alias("tp"), F.sum("p").alias("np"), F.sum("g").alias("ng"))
    r = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return j.select(r("tp", "np").alias("precision"), r("tp", "ng").alias("recall"), F.coalesce(2 * F.col("tp") / F.nullif(F.col("np") + F.col("ng"), F.lit(0)), F.lit(0.0)).alias("f1"))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def headroom(supply: DataFrame, demand: DataFrame) -> DataFrame:
    """(lang, n) against (lang, wanted): what is left, its share, and who runs dry."""
    out = supply.join(demand, "lang", "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))
    out = out.withColumn("used", F.least("n", "wanted")).withColumn("remaining", F.col("n") - F.col("used"))
    return out.select("lang", "n", "wanted", "remaining", F.round(F.col("remaining") / F.col("n"), 6).alias("headroom"), (F.col("wanted") > F.col("n")).alias("depleted"))


def named_tokens(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Token counts with the strings of a vocabulary (token_id, token); ids without one have none."""
    return counts.join(vocabulary, "token_id", "left")


def top_tokens(counts: DataFrame, k: int = 20, by: tuple[str, ...] = ("split", "level", "lang", "lang_group")) -> DataFrame:
    """The k commonest tokens of each group, ties by token_id."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "token_id"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def group_stats(stats: DataFrame) -> DataFrame:
    """sampling_stats() by language group: languages, those without examples, and tokens."""
    return stats.groupBy("lang_group").agg(F.count(F.lit(1)).alias("n_langs"), F.count_if(F.col("n_examples") == 0).alias("n_missing"), F.sum("n_examples").alias("n_examples"), F.sum("n_tokens").alias("n_tokens"))


def count_table(counts: DataFrame, value: str = "n_sentences") -> DataFrame:
    """Rows per language with a column for train and eval, their total and its percentage of all, and a row of totals (lang null)."""
    part = lambda name: F.coalesce(F.sum(F.when(F.col("split") == name, F.col(value))), F.lit(0)).alias(name)
    out = counts.rollup("lang").agg(part("train"), part("eval"), F.sum(value).alias("total"), F.grouping("lang").alias("g"))
    whole = F.max(F.when(F.col("g") == 1, F.col("total"))).over(Window.partitionBy())  # at most a row a language
    return out.withColumn("percent", F.round(100 * F.col("total") / whole, 2)).orderBy("g", F.desc("total"), "lang").drop("g")
