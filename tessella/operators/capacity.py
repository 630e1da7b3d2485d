"""Monte-Carlo estimate of how far sentence pools carry: each trial draws documents, phase by phase, until languages run dry.

A draw is a hash of seed, trial, phase and document, so trials are rows like any others: documents of all trials are
spread over tasks, and what is kept is one row per trial, phase and language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import pools
from tessella.operators.synth import KINDS, targets


def simulate(supply: DataFrame, documents: int, trials: int, seed: int = 0) -> DataFrame:
    """(trial, phase, pool, lang, docs, wanted, available, used, depleted) for supply (pool, lang, n), one row per pool and language.

    A phase draws its share of the documents, each in a language in proportion to the pool's sentences, and takes so many
    sentences of it; what earlier phases used of the pool is gone.
    """
    spark, parts = supply.sparkSession, None
    counts = targets(documents)
    for no, kind in enumerate(KINDS):
        rows = spark.range(trials).select(F.col("id").alias("trial")).select("trial", F.explode(F.sequence(F.lit(1), F.lit(counts[kind.name]))).alias("doc")) if counts[kind.name] else spark.range(0).select(F.col("id").alias("trial"), F.lit(0).alias("doc"))
        key = F.concat_ws("\0", F.lit(str(seed)), F.lit(kind.name), F.col("trial").cast("string"), F.col("doc").cast("string"))
        rows = pools.weighted_choice(rows, supply.where(F.col("pool") == kind.pool), F.concat_ws("\0", key, F.lit("lang")), "n")
        size = kind.least + F.pmod(T.md5_number(F.concat_ws("\0", key, F.lit("size"))), F.lit(kind.most - kind.least + 1))
        part = rows.groupBy("trial", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(size).alias("wanted"))
        part = part.select("trial", F.lit(no).alias("no"), F.lit(kind.name).alias("phase"), F.lit(kind.pool).alias("pool"), "lang", "docs", "wanted")
        parts = part if parts is None else parts.unionByName(part)
    earlier = Window.partitionBy("trial", "pool", "lang").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(supply.select("pool", "lang", "n"), ["pool", "lang"]).withColumn("available", F.greatest(F.col("n") - F.coalesce(F.sum("wanted").over(earlier), F.lit(0)), F.lit(0)))
    return out.select("trial", "phase", "pool", "lang", "docs", "wanted", "available", F.least("wanted", "available").alias("used"), (F.col("wanted") > F.col("available")).alias("depleted"))


def summary(trials: DataFrame, supply: DataFrame) -> DataFrame:
    """By pool and language over all trials: mean and population deviation of what is used, presence in documents, what is left, and how often it runs dry."""
    per = trials.groupBy("trial", "pool", "lang").agg(F.sum("used").alias("used"), F.sum("docs").alias("docs"), F.max("depleted").alias("depleted"))
    n = trials.select("trial").distinct().count()
    out = per.groupBy("pool", "lang").agg(F.sum("used").alias("s"), F.sum(F.col("used") * F.col("used")).alias("q"), F.sum("docs").alias("d"), F.count_if("depleted").alias("dry"))
    out = supply.select("pool", "lang", "n").join(out, ["pool", "lang"], "left").withColumn("trials", F.lit(n))
    of = lambda c: F.coalesce(c, F.lit(0)) / F.col("trials")
    mean = of("s")
    return out.select(
        "pool", "lang", "n", mean.alias("used_mean"), F.sqrt(F.greatest(of("q") - mean * mean, F.lit(0.0))).alias("used_std"), of("d").alias("docs_mean"),
        F.when(F.col("n") > 0, 1 - mean / F.col("n")).otherwise(0.0).alias("headroom"), of("dry").alias("depleted_share"),
    )


def bottlenecks(stats: DataFrame, k: int = 10) -> DataFrame:
    """Those that run dry most often, then those with the least headroom."""
    return stats.orderBy(F.desc("depleted_share"), F.asc("headroom"), "pool", "lang").limit(k)


def most_headroom(stats: DataFrame, k: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("headroom"), F.desc("n"), "pool", "lang").limit(k)


def most_present(stats: DataFrame, k: int = 10) -> DataFrame:
    """Languages in most documents over all pools."""
    return stats.groupBy("lang").agg(F.sum("docs_mean").alias("docs_mean")).orderBy(F.desc("docs_mean"), "lang").limit(k)
