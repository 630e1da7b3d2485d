"""Incremental load of a corpus, configuration by configuration, into a versioned store.

The store's meta is the log: what describes the load, the (config, lang) pairs that are completed, and whether the load is
complete or at a checkpoint. It changes in the same commit as the rows, so a load that died goes on with the first
configuration that isn't logged, and rows are never there twice. There are at most some hundreds of configurations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import dedupe
from tessella.sources import corpora, stores
from tessella.sources.snapshots import Snapshots

CONFIGS = "config string, lang string"
COMPLETE, CHECKPOINT = "complete", "checkpoint"


class Stale(RuntimeError):
    """An unfinished load was described otherwise."""


def compared(completed: DataFrame, wanted: DataFrame) -> str:
    """exact, subset (all that is completed is wanted, as often at most) or other, comparing (config, lang) as multisets."""
    done, want = completed.select("config", "lang"), wanted.select("config", "lang")
    if not done.exceptAll(want).isEmpty():
        return "other"
    return "exact" if want.exceptAll(done).isEmpty() else "subset"


def completed_configs(spark: SparkSession, store: Snapshots) -> DataFrame:
    """The log of a store."""
    return spark.createDataFrame([tuple(p) for p in store.meta().get("completed", [])], CONFIGS)


def unseen_sentences(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """The first of equal (lang, sentence) rows, without those that are known; texts meet by digest."""
    fresh = dedupe.first_wins(rows, ["lang", "sentence"], ["pos"])
    if known is None:
        return fresh
    keys = [c.alias(f"_h{i}") for i, c in enumerate(dedupe.digest("sentence"))]
    return fresh.select("*", *keys).join(known.select("lang", *keys), ["lang", "_h0", "_h1"], "left_anti").select(*fresh.columns)


def load(store: Snapshots, wanted: DataFrame, read: Callable[[DataFrame], DataFrame], describes: dict, rebuild: bool = False, per_commit: int = 20) -> DataFrame:
    """Bring a store of (lang, ..., pos, sentence) up to the wanted (config, lang) pairs and return it.

    read gives the rows of some configurations. Configurations in the log are not read again, whatever describes them now;
    rows whose sentence the store has are not added. Each per_commit configurations are a commit, all but the last at a
    checkpoint. A checkpoint with another description raises Stale; rebuild replaces the whole store in one commit.
    """
    spark = wanted.sparkSession
    meta = {} if rebuild else store.meta()
    if meta.get("status") == CHECKPOINT and meta["describes"] != describes:
        raise Stale("the store is at a checkpoint of another description: rebuild it, or finish it first")
    done = [tuple(p) for p in meta.get("completed", [])]
    todo = sorted(tuple(r) for r in stores.pending(wanted, spark.createDataFrame(done, CONFIGS)).select("config", "lang").distinct().collect())
    if not todo and meta:
        if meta["describes"] != describes or meta["status"] != COMPLETE:
            store.describe({"describes": describes, "status": COMPLETE, "completed": sorted(done)})
        return store.read()
    step = max(1, len(todo) if rebuild else per_commit)
    for at in range(0, max(1, len(todo)), step):
        batch = todo[at : at + step]
        done += batch
        now = {"describes": describes, "status": COMPLETE if at + step >= len(todo) else CHECKPOINT, "completed": sorted(done)}
        rows = read(spark.createDataFrame(batch, CONFIGS))
        if rebuild or not store.version():
            store.overwrite(unseen_sentences(rows, None), now)
        else:
            # the language of a row is not always its configuration's, so all languages of the store are compared
            store.append(unseen_sentences(rows, store.read()), now)
    return store.read()


def load_parallel(spark: SparkSession, path: str, rows: DataFrame, stop, describes: dict, rebuild: bool = False, per_commit: int = 20, **lists) -> DataFrame:
    """The parallel corpus's sentences (lang, pos, sentence) of the configurations in rows (config, pos, PARALLEL_SCHEMA) that match a language."""
    wanted = corpora.matching_configs(rows.select("config").distinct())

    def read(batch: DataFrame) -> DataFrame:
        own = rows.drop("lang").join(F.broadcast(batch), "config").drop("config")
        out = corpora.parallel_sentences(own, stop, **lists)
        return out.select("lang", F.xxhash64("sentence").alias("pos"), "sentence")

    return load(Snapshots(spark, path, ("lang",)), wanted, read, describes, rebuild, per_commit)
