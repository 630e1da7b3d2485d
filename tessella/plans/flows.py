"""Whole flows: refresh of sources, refiltering of stored sentences, synthetic data, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import filters
from tessella.functions import text as T
from tessella.functions.dims import with_lang
from tessella.operators import dedupe, lexicon, reports, synth
from tessella.sources import corpora, stores


def top_words(counts: DataFrame, lang: str, top: int) -> list[str]:
    """The top words of a language; top bounds them."""
    rows = lexicon.lexicon(counts.where(F.col("lang") == lang), top).collect()
    return [r["word"] for r in sorted(rows, key=lambda r: r["rank"])]


def word_array(counts: DataFrame, lang: str, top: int) -> Column:
    """The top words of a language as a literal array."""
    words = top_words(counts, lang, top)
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def clean_funnel(docs: DataFrame) -> DataFrame:
    """Documents to sentences, cleaned and deduplicated: counts by language at each step."""
    rows = docs.select("lang", "doc_id", F.posexplode(T.sentences("text")).alias("no", "sentence"))
    rows = T.stepwise(rows, "sentence", T.strip_html, T.strip_brackets, T.collapse_punct, T.collapse_spaces, T.trim)
    rows = with_lang(rows).withColumn("ok", ~filters.has_artifact("sentence") & filters.is_valid("sentence"))
    # equal sentences meet by digest, so no text is shuffled
    keys = rows.groupBy("lang", *(c.alias(f"h{i}") for i, c in enumerate(dedupe.digest("sentence")))).agg(F.count(F.lit(1)).alias("n"), F.first("ok").alias("ok"))
    out = keys.groupBy("lang").agg(F.sum("n").alias("n_sentences"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("n_valid"), F.count_if("ok").alias("n_kept"))
    return out.withColumn("n_removed", F.col("n_valid") - F.col("n_kept"))


def refilter(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], rejected: str | None = None, reason: Callable[[DataFrame], Column] | None = None, eligible: Column | None = None) -> dict[str, int]:
    """Commit a version of a sentence store with the rows that a transform gives; returns the rows by language afterwards.

    The transform runs once, into new folders. Partitions (a source and a language) whose contents are as before keep
    their folders, those without rows are left out of the new version. Rows that are gone are written to rejected with
    their place in the store (source_index) and a reason, if a function of with_lang() rows gives one. Only eligible
    languages (a condition on lang_dim columns) are transformed.
    """
    store = stores.sentence_store(spark, path)
    version = store.version()
    base = store.partitions(version)
    langs = [lang for _, lang in base]
    if eligible is not None:
        known = with_lang(spark.createDataFrame([(x,) for x in sorted({x for x in langs if x is not None})], "lang string"))
        langs = [r["lang"] for r in known.where(F.coalesce(eligible, F.lit(False))).collect()]  # one row a language
    before = store.read(version, lang=langs)
    new = store.written(stores.typed(transform(before), stores.SENTENCES))
    among = {k for k in base if k[1] in set(langs)}
    changed = store.replace(new, among, version)
    store.discard(p for k, p in new.items() if k not in changed)
    if rejected and changed:
        gone = before.where(F.col("lang").isin([lang for _, lang in changed]))
        after = store.read().select("source", "lang", *(c.alias(f"h{i}") for i, c in enumerate(dedupe.digest("sentence"))))
        keyed = gone.select("*", *(c.alias(f"h{i}") for i, c in enumerate(dedupe.digest("sentence"))))
        gone = with_lang(keyed.join(after, ["source", "lang", "h0", "h1"], "left_anti").drop("h0", "h1"))
        gone = gone.withColumn("reason", reason(gone) if reason else F.lit(None).cast("string"))
        gone.select("source", "lang", F.col("pos").alias("source_index"), "sentence", "reason").write.mode("overwrite").parquet(rejected)
    counts = dict.fromkeys(sorted({x for x in langs if x is not None}), 0)
    for (_, lang), p in (base if not changed else store.partitions()).items():
        if lang in counts:
            counts[lang] += p["rows"]
    return counts


def leak_filter(stop: Column | list[str], **lists: Column) -> Callable[[DataFrame], DataFrame]:
    """Transform that drops English and major-Latin leaks from stored sentences."""

    def transform(df: DataFrame) -> DataFrame:
        reason = filters.reject_reason("sentence", stop, **lists)
        return with_lang(df).withColumn("_r", reason).where(F.col("_r").isNull() | ~F.col("_r").isin("english_leak", "major_latin_leak")).select(*df.columns)

    return transform


def unwrap(df: DataFrame) -> DataFrame:
    """Transform that splits wrapped fragments into sentences and keeps the valid ones."""
    rows = df.withColumn("sentence", F.explode(T.expand_wrapped("sentence")))
    return with_lang(rows).where(filters.is_valid("sentence")).select(*df.columns)


def synthetic_data(spark: SparkSession, sentences: DataFrame, total: int, path: str, seed: int = 42, rebuild: bool = False) -> dict[str, DataFrame]:
    """Examples, model-ready and multilabel tables with their reports, behind a manifest."""
    examples = stores.cached(spark, path, {"total": total, "seed": seed, "kinds": [k.name for k in synth.KINDS]}, lambda: synth.build(sentences, total, seed), rebuild)
    ready = synth.model_ready(examples)
    return {
        "examples": examples,
        "ready": ready,
        "multilabel": synth.multilabel(ready),
        "counts": reports.count_table(reports.label_counts(ready)),
        "vocabulary": (vocabulary := reports.vocabulary_rollup(ready)),
        "vocabulary_top": reports.top_tokens(vocabulary),
        "vocabulary_size": reports.vocabulary_size(ready),
        "stats": reports.sampling_stats(examples),
    }


def stored_sources(spark: SparkSession, path: str, sources: dict[str, DataFrame]) -> DataFrame:
    """Refresh all sources into one sentence store."""
    rows = corpora.refresh(sources)
    numbered = dedupe.first_wins(rows.withColumn("pos", F.xxhash64("sentence")), ["source", "lang", "sentence"], ["pos"])
    stores.write_sentences(numbered.select("source", "lang", "pos", "sentence"), path)
    return stores.read_sentences(spark, path)


def markdown(df: DataFrame, title: str = "") -> str:
    """A small report as a markdown table."""
    rows = df.collect()
    lines = [f"## {title}", ""] * bool(title) + ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(str, r)) + " |" for r in rows])
