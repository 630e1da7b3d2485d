"""Importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample of the documents.

A document's features are the counts of its words and word pairs in BUCKETS hash buckets. The raw model counts all
documents; the target model counts the labelled documents of good quality, at most TARGETS of them, chosen by a hash of
doc_id. Both come from one pass: a task emits one dense vector per model, so the driver receives bounded vectors. A
document's log weight is the sum of log(target / raw) over its features. Keys are log weights plus Gumbel noise, a
function of seed and doc_id; the sample is the k largest keys, a draw without replacement in proportion to the weights.
The k-th key is found by counting keys in ever finer bins, never by sorting all keys in one task.

Nulls and edge cases: null and empty texts have no features and weight 0; rows with equal doc_id share their noise, and
rows that tie with the last of the sample in key and doc_id are all in; rows without doc_id get the noise of id 0; an
empty table gives an empty result; without labelled targets all weights are 0 and the sample is uniform.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, spark_schema, staged, with_key
from tessella.llm.hashing import MIX, lower_words, mixed, word_hashes

BUCKETS, TARGETS, FRACTION, SEED = 10_000, 20_000, 0.85, 11
BINS, SMALL = 4096, 10_000


def features(text: str | None) -> np.ndarray:
    """Bucket of each word and word pair."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.int64)
    h = word_hashes(words)
    pairs = mixed(h[:-1] * MIX + h[1:])
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def models(docs: DataFrame, targets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts (target, raw)."""
    wanted = frozenset(targets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                counts = np.bincount(features(text.as_py()), minlength=BUCKETS)
                raw += counts
                if i.as_py() in wanted:
                    target += counts
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": at, "target": target[at], "raw": raw[at]}, schema=COUNTS)

    rows = with_key(docs, ("doc_id", "text")).mapInArrow(count, spark_schema(COUNTS)).groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, t, r in rows:
        target[bucket], raw[bucket] = t, r
    return target, raw


COUNTS = pa.schema([("bucket", pa.int64()), ("target", pa.int64()), ("raw", pa.int64())])


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw) of each bucket, with one count added to each."""
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def keyed(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and key."""
    start = np.uint64(seed * 2 + 1)

    def block(rows: dict) -> dict:
        weights = [round(float(ratio[features(t)].sum()), 9) for t in rows["text"]]
        ids = np.array([i or 0 for i in rows["doc_id"]], np.int64).view(np.uint64)
        u = ((mixed(mixed(ids * MIX + start)) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
        return {"doc_id": rows["doc_id"], "log_weight": weights, "key": [w + g for w, g in zip(weights, (-np.log(-np.log(u))).tolist())]}

    schema = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64()), ("key", pa.float64())])
    return map_rows(with_key(docs, ("doc_id", "text")), block, schema)


def kth_largest(rows: DataFrame, k: int) -> tuple[float, int | None]:
    """The k-th of (key, doc_id) in order of key descending, then doc_id ascending, nulls first."""
    low, high, n = rows.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    before = 0
    inside = rows
    while n > SMALL and low < high:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("key") - low) / F.lit(width)), F.lit(BINS - 1))
        bins = sorted(inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)), F.min("key"), F.max("key")).collect(), reverse=True)
        for _, count, least, most in bins:
            if before + count >= k:
                n, low, high = count, least, most
                break
            before += count
        inside = rows.where(F.col("key").between(low, high))
    if low < high:  # at most SMALL rows are left
        rest = sorted(inside.select("key", "doc_id").collect(), key=lambda r: (-r["key"], r["doc_id"] is not None, r["doc_id"] or 0))
        return tuple(rest[k - before - 1])
    for doc_id, count in inside.groupBy("doc_id").count().orderBy(F.asc_nulls_first("doc_id")).toLocalIterator():
        before += count
        if before >= k:
            break
    return low, doc_id


def importance_resample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, log_weight, key and kept (in the sample of ceil(fraction * rows))."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    targets = [r[0] for r in good.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(TARGETS).collect()]
    rows = staged(keyed(docs, log_ratio(*models(docs, targets)), seed), "keys")
    n = rows.count()
    if not n:
        return rows.withColumn("kept", F.lit(True))
    key, doc_id = kth_largest(rows, max(1, math.ceil(fraction * n)))
    tie = F.col("doc_id").isNull() if doc_id is None else F.coalesce(F.col("doc_id") <= doc_id, F.lit(True))
    return rows.withColumn("kept", (F.col("key") > key) | ((F.col("key") == key) & tie))
