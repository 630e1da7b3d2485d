"""Sentence pools: stable hashes, reserved and main parts, worker buckets, document plans and draws without replacement.

All randomness is a function of seed and key, so results don't depend on partitions or machines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.dims import RESERVES
from tessella.operators import dedupe
from tessella.sources import stores


def merged(sources: dict[str, DataFrame]) -> DataFrame:
    """One table of (source, lang, pos, sentence)."""
    out = None
    for name, df in sources.items():
        part = df.select(F.lit(name).alias("source"), "lang", "pos", "sentence")
        out = part if out is None else out.unionByName(part)
    return out


def key_hash(seed: int, *columns: Column | str) -> Column:
    return T.md5_number(F.concat_ws("\0", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)))


def reserve_size(n: Column, source: Column | str) -> Column:
    """min(n, max(least, min(round half to even (n * share), most))) with the source's limits."""
    rules = {name: F.least(n, F.greatest(F.lit(least), F.least(F.rint(n * share), F.lit(most)))) for name, (share, least, most) in RESERVES.items()}
    out = F.lit(None).cast("double")
    for name, size in rules.items():
        out = F.when(F.col(source) == name if isinstance(source, str) else source == name, size).otherwise(out)
    return out.cast("long")


def split_by_hash(df: DataFrame, seed: int = 42, workers: int = 8, totals: DataFrame | None = None) -> DataFrame:
    """df of (source, lang, sentence) with pool ('reserved' or 'main') and bucket.

    A row is reserved if its hash modulo the language's rows is below the reserve size, so the split needs counts only.
    Rows emptied by normalisation are dropped after counting. totals has (source, lang, total), where rows are counted already.
    """
    totals = df.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("total")) if totals is None else totals
    n = totals.withColumn("reserve_n", reserve_size(F.col("total"), "source"))
    h = key_hash(seed, "source", "lang", "sentence")
    out = df.join(F.broadcast(n), ["source", "lang"]).withColumn("_h", h)
    out = out.withColumn("pool", F.when(F.pmod("_h", F.col("total")) < F.col("reserve_n"), "reserved").otherwise("main"))
    return out.withColumn("bucket", F.pmod(F.floor(F.col("_h") / 7), F.lit(workers)).cast("int")).drop("_h", "total", "reserve_n")


def pool_stats(df: DataFrame) -> DataFrame:
    """Rows, reserved and main by source and language, with sub-totals."""
    return df.rollup("source", "lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("pool") == "reserved").alias("reserved"), F.count_if(F.col("pool") == "main").alias("main"))


def exact_reserve(df: DataFrame, size: Column, seed: int = 42) -> DataFrame:
    """df with pool, the reserve being exactly the rows of least hash per language."""
    out = dedupe.placed(df, ["lang"], [key_hash(seed, "lang", "sentence"), "sentence"])
    return out.withColumn("pool", F.when(F.col("_place") <= size, "reserved").otherwise("main")).drop("_place")


#: Ranges of hashes that a pool is numbered in.
SLICES = 1 << 10


def _sliced(df: DataFrame, seed: int, by: tuple[str, ...]) -> DataFrame:
    # never null, and said to be, as a join would hash every row once more to leave nulls out
    return df.withColumn("_h", key_hash(seed, *by, "sentence")).withColumn("_slice", F.coalesce(F.floor(F.col("_h") / ((1 << 32) // SLICES)), F.lit(0)))


def slice_counts(df: DataFrame, seed: int = 42, by: tuple[str, ...] = ("pool", "lang"), per: tuple[str, ...] = ()) -> DataFrame:
    """(*per, *by, _slice, _n): rows of each pool by range of their hashes, and by other columns: at most SLICES rows a pool for each of their values."""
    return _sliced(df, seed, by).groupBy(*per, *by, "_slice").agg(F.count(F.lit(1)).alias("_n"))


def numbered(df: DataFrame, seed: int = 42, by: tuple[str, ...] = ("pool", "lang"), upto: DataFrame | None = None, counts: DataFrame | None = None, repeated: bool = False) -> DataFrame:
    """df with idx, the row's place in its pool by hash, from 0.

    Places come from counts per hash range (counts, where slice_counts() has been called before) and a row number inside
    each range, so no pool is sorted by one task. With upto (*by, most), only ranges that begin below most are numbered:
    rows beyond them stay in their task, and the numbers of the others are the same. Where rows are repeated, equal ones
    count as one, as they do in counts; with upto only those of the ranges meet.
    """
    once = lambda rows: rows.distinct() if repeated else rows
    counts = slice_counts(once(df), seed, by) if counts is None else counts
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_h", "sentence"))
    if upto is None:
        rows = _sliced(once(df), seed, by).withColumn("_place", place).join(before, [*by, "_slice"])
    else:
        # pools and languages times SLICES rows at most
        before = before.join(F.broadcast(upto), list(by)).where("_before < most").drop("most")
        rows = once(_sliced(df, seed, by).join(F.broadcast(before), [*by, "_slice"])).withColumn("_place", place)
    return rows.withColumn("idx", (F.col("_before") + F.col("_place") - 1).cast("long")).drop("_h", "_slice", "_before", "_place")


def striped(df: DataFrame, n: int, by: str = "lang", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """df with part: rows dealt in turn within each group."""
    return dedupe.placed(df, [by], list(order)).withColumn("part", ((F.col("_place") - 1) % n).cast("int")).drop("_place")


def chunked(df: DataFrame, n: int, by: str = "lang", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """df with chunk: n contiguous parts of each group, the first ones a row longer where it doesn't divide."""
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    rows = dedupe.placed(df, [by], list(order))
    rows = rows.join(sizes, rows[by].eqNullSafe(sizes["_by"])).withColumn("_q", F.floor(F.col("_n") / n)).withColumn("_r", F.col("_n") % n)
    at, longer = F.col("_place") - 1, F.col("_r") * (F.col("_q") + 1)
    chunk = F.when(at < longer, F.floor(at / (F.col("_q") + 1))).otherwise(F.col("_r") + F.floor((at - longer) / F.greatest("_q", F.lit(1))))
    return rows.withColumn("chunk", chunk.cast("int")).drop("_by", "_n", "_place", "_q", "_r")


def doc_plan(capacity: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """Languages of target documents, as (doc_no, lang): one for each language, then by what is left of their capacities.

    Drawing in proportion to what is left is drawing from an urn, so each language lays its slots into it and the slots
    of least hash are drawn: a language never lays more slots than documents are wanted.
    """
    slots = capacity.where("capacity > 0").select("lang", F.explode(F.sequence(F.lit(1), F.least("capacity", F.lit(target)).cast("int"))).alias("slot"))
    out = dedupe.placed(slots, [], [F.col("slot") > 1, key_hash(seed, "lang", "slot"), "lang", "slot"], "doc_no")
    return out.where(F.col("doc_no") <= target).select((F.col("doc_no") - 1).alias("doc_no"), "lang")


def offsets(demands: DataFrame, by: tuple[str, ...] = ("pool", "lang")) -> DataFrame:
    """demands (doc, slot, n) with start: the first pool index that each may draw; draws never overlap."""
    return dedupe.running_before(demands, list(by), ["doc", "slot"], "n").withColumnRenamed("_before", "start")


def remaining(pool: DataFrame, demands: DataFrame, by: tuple[str, ...] = ("pool", "lang")) -> DataFrame:
    """How many sentences each pool has, how many are wanted of it, and how many are left."""
    wanted = demands.groupBy(*by).agg(F.sum("n").alias("wanted"))
    out = pool.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(wanted, list(by), "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))
    return out.withColumn("remaining", F.greatest(F.col("n") - F.col("wanted"), F.lit(0)))


def weighted_choice(df: DataFrame, choices: DataFrame, key: Column, weight: str = "weight", name: str = "lang") -> DataFrame:
    """df with one of the choices for each row, in proportion to their weights: a uniform number by key falls into a choice's range.

    choices has one row per language: at most as many as there are languages.
    """
    rows = sorted((r[name], r[weight]) for r in choices.where(F.col(weight) > 0).select(name, weight).collect())
    total, upto, ranges = sum(w for _, w in rows), 0, []
    for value, w in rows:
        upto += w
        ranges.append(F.struct(F.lit(upto / total).alias("upto"), F.lit(value).alias("value")))
    if not ranges:
        return df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumn(name, T.bind(T.uniform(key), lambda u: F.coalesce(F.element_at(F.filter(F.array(*ranges), lambda x: x["upto"] > u), 1)["value"], F.lit(rows[-1][0]))))


def draw(demands: DataFrame, pool: DataFrame, by: tuple[str, ...] = ("pool", "lang"), used: DataFrame | None = None) -> DataFrame:
    """The sentences of each demand, in order; a pool that runs out yields fewer.

    used has (*by, used): how many sentences of a pool were drawn before, at most a row for each language and pool.
    """
    wanted = offsets(demands, by)
    if used is not None:
        wanted = wanted.join(F.broadcast(used), list(by), "left").withColumn("start", F.col("start") + F.coalesce("used", F.lit(0)))
    wanted = wanted.select(*by, "doc", "slot", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("idx"))
    return wanted.join(pool, [*by, "idx"]).withColumn("part", F.col("idx") - F.col("start")).drop("start", "idx")


#: Values of a language in a cell of its weights; draws of a row in a round; rounds.
CELL, ATTEMPTS, ROUNDS = 64, 8, 200


def weighted_draws(rows: DataFrame, choices: DataFrame, key: Column, many: str, by: str = "lang", value: str = "word", weight: str = "weight", but: str | None = None) -> DataFrame:
    """rows with drawn: many different values of their group, one after the other without replacement and in proportion to weight, never that of column but.

    Weights are whole numbers above 0. They are laid end to end, a number by key and attempt falls into one of them, and
    values that a row has already are passed over, which is drawing without replacement. A lookup is a join on a cell of
    the group's weights, which holds about CELL values however many the group has, so no row meets a list of words. A row
    is drawn for once more than it lacks values at first, which does for nearly all, and ATTEMPTS times in each round after
    that, always from the number it has come to. Groups without enough values give all they have.
    """
    laid = dedupe.running_before(choices.select(by, F.col(value).alias("_value"), F.col(weight).cast("long").alias("_w")), [by], ["_value"], "_w")
    laid = stores.materialized(laid, "laid")
    totals = laid.groupBy(by).agg(F.sum("_w").alias("_total"), F.count(F.lit(1)).alias("_n"))
    totals = stores.materialized(totals.withColumn("_cells", F.expr(f"1 + _n div {CELL}")), "totals")
    cell = lambda x: F.expr(f"cast(cast({x} as decimal(20,0)) * _cells div _total as long)")
    cells = laid.join(totals, by).withColumn("_low", cell("_before")).withColumn("_high", cell("(_before + _w - 1)"))
    cells = stores.materialized(cells.select(by, F.explode(F.sequence("_low", "_high")).alias("_cell"), "_before", (F.col("_before") + F.col("_w")).alias("_end"), "_value"), "cells")
    own = F.struct(*rows.columns)
    excluded = F.col(but) if but else F.lit(None).cast("string")
    now = rows.select(by, own.alias("_row"), key.alias("_key"), F.col(many).alias("_many"), excluded.alias("_but"), F.array().cast("array<string>").alias("_got"), F.lit(0).alias("_from"))
    # a row's own value is one that can't be drawn
    known = laid.select(by, F.col("_value").alias("_but"), F.lit(1).alias("_in"))
    now = now.join(totals.select(by, "_n"), by, "left").join(known, [by, "_but"], "left")
    now = now.withColumn("_need", F.least("_many", F.coalesce("_n", F.lit(0)) - F.coalesce("_in", F.lit(0)))).drop("_n", "_in", "_many")
    now, done = stores.materialized(now, "wanted"), None
    for turn in range(ROUNDS):
        enough = now.where("size(_got) >= _need").select("_row", "_got")
        done = enough if done is None else done.unionByName(enough)
        lacking = now.where("size(_got) < _need")
        if lacking.isEmpty():
            return done.select("_row.*", F.col("_got").alias("drawn"))
        times = F.least(F.col("_need") + 1, F.lit(ATTEMPTS)).cast("int") if turn == 0 else F.lit(ATTEMPTS)
        tries = lacking.withColumn("_upto", F.col("_from") + times).withColumn("_k", F.explode(F.sequence("_from", F.col("_upto") - 1))).join(totals, by)
        number = T.md5_number52(F.concat_ws("\0", "_key", F.col("_k").cast("string")))
        tries = tries.withColumn("_x", number).withColumn("_x", F.expr("cast(cast(_x as decimal(20,0)) * cast(_total as decimal(18,0)) div 4503599627370496 as long)")).withColumn("_cell", cell("_x"))
        hits = tries.join(cells, [by, "_cell"]).where("_x >= _before and _x < _end")
        found = hits.groupBy(by, "_key").agg(*(F.first(c).alias(c) for c in ("_row", "_but", "_need", "_got")), F.first("_upto").alias("_from"), F.array_sort(F.collect_list(F.struct("_k", "_value"))).alias("_new"))
        got = F.array_distinct(F.concat("_got", F.filter(F.transform("_new", lambda x: x["_value"]), lambda v: ~F.coalesce(v == F.col("_but"), F.lit(False)))))
        now = stores.materialized(found.withColumn("_got", F.slice(got, 1, F.col("_need").cast("int"))).drop("_new"), "drawn")
    raise RuntimeError(f"weights are too uneven: some rows lack values after {ROUNDS * ATTEMPTS} draws")


def weighted_sample(df: DataFrame, by: str, weight: str, k: int, key: str, seed: int = 0) -> DataFrame:
    """k rows a group without replacement, in proportion to weight: the least of -ln(u) / weight."""
    draw_key = F.round(-F.log(T.uniform(F.concat_ws("\0", F.lit(str(seed)), F.col(by), F.col(key)))) / F.col(weight), 9)
    place = F.row_number().over(Window.partitionBy(by).orderBy(draw_key, key))
    return df.withColumn("place", place).where(F.col("place") <= k)


def limited_sample(examples: DataFrame, n: int, key: str = "doc", share: float = 0.7, seed: int = 0) -> DataFrame:
    """n examples for a quick run: share of them of kinds with one main language, the rest mixed, each the first by hash."""
    mixed = F.col("kind").isin("mixed", "random")
    rows = examples.withColumn("_mixed", mixed)
    place = F.row_number().over(Window.partitionBy("_mixed").orderBy(key_hash(seed, key), key))
    first = int(n * share)
    picked = rows.withColumn("_place", place).where(F.col("_place") <= max(first, n - first))  # a constant limit is taken per task first
    return picked.where(F.col("_place") <= F.when(F.col("_mixed"), F.lit(n - first)).otherwise(F.lit(first))).drop("_mixed", "_place")


def train_eval(df: DataFrame, key: Column, share: float = 0.95, coverage: Column | None = None) -> DataFrame:
    """df with split: by hash, rows of the coverage set always in train."""
    train = T.uniform(key) < share
    return df.withColumn("split", F.when(train if coverage is None else coverage | train, "train").otherwise("eval"))
