"""Source divergence audit: how far the word distributions of a language's sources lie apart, and which words set a source apart.

1. Terms are counted in one pass: a task keeps counts per (lang, source, term) and hands them on when it holds FLUSH of
   them, so frequent terms and hot sources are reduced before the shuffle.
2. Each term that enough documents of its language have is pivoted into a vector with one count for each source of the
   language, in order of the sources' names.
3. Vectors become smoothed shares in integers of 1 / SCALE (decimals in between, so counts of any size are exact), and
   higher-order functions emit each pair's difference. A task adds up pairs before the shuffle. Pairs are emitted source
   by source, so that no array is longer than the number of sources.
4. Words that set a source apart are the best 50 of each group by a window that Spark limits before its shuffle.

Nulls and edge cases: null text, lang and source count as ''; groups without any term take part in pairs, with the
smoothing alone; where a language keeps no term its pairs have the value 0; a language with one source has no pairs;
ties are broken by the item; repeated rows count as often as they occur; an empty table gives an empty result; columns
other than text, lang and source are not read. A language's vectors grow with its sources, as the pairs asked for do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import blocks, spark_schema, staged

#: A term is kept where so many documents of its language have it; smoothing; parts of one in which shares are given.
DOCUMENTS, SMOOTHING, SCALE = 30, 5, 1_000_000_000
#: Best terms of a source that are given.
TERMS = 50
#: With at most so many groups of language and source, tables of groups are broadcast; with more, they are joined like any other.
GROUPS = 100_000
#: Counts that a task holds; bytes of a text that are split into terms at once.
FLUSH, PIECE = 200_000, 1 << 20

#: A-Z in lower case; bytes of other scripts stay; all else separates.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("documents", pa.int64())])


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of about PIECE bytes that end between terms."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _BYTES[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_BYTES).split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, lang, source) to counts of terms and of documents by group and term; an empty term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, documents) in held.items():
            keys = [b"", *n]
            columns = [pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.string()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(documents[k] for k in n)], pa.int64())], schema=COUNTS)
        held.clear()

    for batch in batches:
        for part in blocks(batch, 4 << 20):
            for text, lang, source in zip(*(c.to_pylist() for c in part.columns)):
                n, documents = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for words in terms(text):
                    n.update(words)
                    own.update(words)
                documents.update(own)
            if sum(len(n) + 1 for n, _ in held.values()) > FLUSH:
                yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and documents; each group has one row with an empty term."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source"))).withColumn("text", F.col("text").cast("binary"))
    counted = rows.mapInArrow(_counted, spark_schema(COUNTS))
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")).withColumn("term", F.col("term").cast("string"))


def as_it_is(df: DataFrame) -> DataFrame:
    return df


def wide_vectors(counts: DataFrame, least: int = DOCUMENTS, side: Callable[[DataFrame], DataFrame] = as_it_is) -> tuple[DataFrame, DataFrame]:
    """(lang, sources) with the sorted sources, and (lang, term, vector) with the counts of each kept term in their order."""
    groups = counts.where("term = ''").select("lang", "source")
    languages = groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    place = languages.select("lang", F.posexplode("sources").alias("place", "source"))
    entries = F.map_from_entries(F.collect_list(F.struct("place", "n")))
    pivoted = counts.where("term <> ''").join(side(place), ["lang", "source"]).groupBy("lang", "term").agg(F.sum("documents").alias("documents"), entries.alias("entries")).where(F.col("documents") >= least)
    vector = F.transform(F.sequence(F.lit(0), F.size("sources") - 1), lambda i: F.coalesce(F.try_element_at("entries", i), F.lit(0)))
    return languages, pivoted.join(side(languages), "lang").select("lang", "term", vector.alias("vector"))


def shares(languages: DataFrame, wide: DataFrame, side: Callable[[DataFrame], DataFrame] = as_it_is) -> tuple[DataFrame, DataFrame]:
    """The languages with the number of kept terms and totals by source, and the vectors with the sources' shares p and the language's q."""
    sums = wide.select("lang", F.posexplode("vector").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kept"))
    totals = F.transform(F.array_sort(F.collect_list(F.struct("place", "n"))), lambda x: x["n"])
    sums = sums.groupBy("lang").agg(totals.alias("totals"), F.first("kept").alias("kept"))
    sums = sums.withColumn("total", F.aggregate("totals", F.lit(0).cast("long"), lambda a, x: a + x))
    share = "1 + ({scale}BD * ({count} + {more})) div ({total} + {more} * kept)"
    values = {"scale": SCALE, "more": SMOOTHING}
    p = F.expr(f"transform(vector, (x, i) -> {share.format(count='x', total='totals[i]', **values)})")
    q = F.expr(share.format(count="aggregate(vector, 0L, (a, x) -> a + x)", total="total", **values))
    return languages.join(sums, "lang", "left"), wide.join(side(sums), "lang").select("lang", "term", "vector", p.alias("p"), q.alias("q"))


def divergence(docs: DataFrame, least: int = DOCUMENTS) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: distances to the other sources, and the terms that set a source apart."""
    counts = staged(term_counts(docs), "terms")
    # a table of groups is as large as there are groups of language and source, whatever their documents
    side = F.broadcast if counts.where("term = ''").count() <= GROUPS else as_it_is
    languages, wide = wide_vectors(counts, least, side)
    languages, wide = staged(languages, "sources"), staged(wide, "vectors")
    languages, weighted = shares(languages, wide, side)
    later = F.expr("transform(sequence(i + 1, size(p) - 1), j -> struct(j, abs(p[i] - p[j]) AS f))")
    by_source = weighted.select("lang", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("i")).where("i < size(p) - 1")
    emitted = by_source.select("lang", "i", F.inline(later).alias("j", "f"))
    # every pair once with nothing, so that languages without kept terms have their pairs as well
    none = languages.select("lang", F.posexplode("sources").alias("i", "source"), F.size("sources").alias("n")).where("i < n - 1")
    none = none.select("lang", "i", F.explode(F.expr("sequence(i + 1, n - 1)")).alias("j"), F.lit(0).cast("long").alias("f"))
    sums = emitted.unionByName(none).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    both = sums.join(side(languages.select("lang", "sources")), "lang").select("lang", "value", F.inline(F.expr("array(struct(sources[i] AS source, sources[j] AS item), struct(sources[j] AS source, sources[i] AS item))")))
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    apart = weighted.select("lang", "term", "vector", "q", F.posexplode("p").alias("i", "p")).where("vector[i] > 0 and p > q")
    apart = apart.select("lang", "i", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = [F.desc("value"), F.asc("item")]
    rank = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("rank")
    best = apart.select("*", rank("lang", "i")).where(F.col("rank") <= TERMS)
    best = best.join(side(languages.select("lang", "sources")), "lang").select("lang", F.expr("sources[i]").alias("source"), F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.select("*", rank("lang", "source")).unionByName(best)
