"""First-wins deduplication, caps, budgets, quotas and stop rules over ordered rows. Every order ends in a unique key.

Groups may hold a third of all rows, so no group is sorted by one task: ordered() numbers rows by range, and what runs
along a group (sums, streaks) is put together from one row for each group and range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.sources.stores import materialized

#: Places of a group that one task of a rolling window has.
BLOCK = 1 << 16


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digest(*columns: Column | str) -> list[Column]:
    """128 bits of some columns, as two numbers: keys that are shuffled instead of texts."""
    return [F.xxhash64(F.lit(seed), *map(_column, columns)) for seed in (1, 2)]


def first_wins(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key (by a digest of the keys), ties by a hash of the row. Equal keys meet as one row per task, however many there are."""
    row = F.struct(*df.columns)
    place = F.struct(*(_column(o).alias(f"o{i}") for i, o in enumerate(order)), F.xxhash64(*df.columns).alias("tie"))
    a, b = digest(*(F.struct(_column(k).isNull().alias("n"), _column(k).alias("k")) for k in keys))
    return df.groupBy(a.alias("_a"), b.alias("_b")).agg(F.min_by(row, place).alias("first")).select("first.*")


def same(a: DataFrame, b: DataFrame, names: dict[str, str]) -> Column:
    """Columns of a equal those of b, nulls being equal."""
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[v]) for k, v in names.items()), F.lit(True))


def ordered(df: DataFrame, by: list[str], order: list[Column | str]) -> tuple[DataFrame, DataFrame]:
    """Rows with _part (a range of the order of by and order) and _at (the place in it), and one row (by, _part, first, n) for each group and range.

    Rows are dealt by range and written, so ranges are of like size whatever the groups are, and stay what they are.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select("*", *(_column(o).alias(n) for n, o in zip(names, order)))
    rows = rows.repartitionByRange(*by, *names).sortWithinPartitions(*by, *names).withColumn("_id", F.monotonically_increasing_id()).drop(*names)
    rows = materialized(rows, "ordered").withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    spans = rows.groupBy(*by, "_part").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
    return rows, spans


def along(spans: DataFrame, by: list[str]) -> Window:
    """The ranges of a group before a range: as many rows as ranges have tasks."""
    return Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def with_spans(rows: DataFrame, spans: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """rows with columns of the spans, which have one row for each group and range."""
    there = spans.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate([*by, "_part"])), *columns)
    names = {k: f"_b{i}" for i, k in enumerate([*by, "_part"])}
    return rows.join(there, same(rows, there, names)).drop(*names.values())


def placed(df: DataFrame, by: list[str], order: list[Column | str], name: str = "_place") -> DataFrame:
    """df with each row's place in its group, from 1."""
    rows, spans = ordered(df, by, order)
    spans = spans.withColumn("_skip", F.coalesce(F.sum("n").over(along(spans, by)), F.lit(0)) - F.col("first") + 1)
    return with_spans(rows, spans, by, "_skip").withColumn(name, (F.col("_at") + F.col("_skip")).cast("long")).drop("_part", "_at", "_skip")


def running_before(df: DataFrame, by: list[str], order: list[Column | str], amount: str, most: int | None = None) -> DataFrame:
    """df with _before, the sum of the amounts before each row of its group; with most, only ranges that begin below it, as no later row can be."""
    rows, spans = ordered(df, by, order)
    sums = rows.groupBy(*by, "_part").agg(F.sum(amount).alias("_sum"))
    sums = sums.withColumn("_skip", F.coalesce(F.sum("_sum").over(along(sums, by)), F.lit(0)))
    if most is not None:
        sums = sums.where(F.col("_skip") < most)
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return with_spans(rows, sums, by, "_skip").withColumn("_before", F.col("_skip") + inside).drop("_part", "_at", "_skip")


def dedupe_sentences(df: DataFrame, column: str = "sentence", order: str = "pos") -> DataFrame:
    """Per language, the first of equal trimmed sentences."""
    return first_wins(df, ["lang", T.trim(column)], [order])


def dedupe_summary(df: DataFrame, by: str, key: Column) -> DataFrame:
    """Rows before, after and removed by deduplication, per group."""
    pairs = df.groupBy(by, key.alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy(by).agg(F.sum("n").alias("n_before"), F.count(F.lit(1)).alias("n_after"))
    return out.withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def capped(df: DataFrame, by: str, order: list[Column | str], cap: Column | int) -> DataFrame:
    """The first cap rows of each group; a constant cap is taken per task before rows are shuffled."""
    if isinstance(cap, int):
        place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
        return df.withColumn("_place", place).where(F.col("_place") <= cap).drop("_place")
    return placed(df, [by], order).where(F.col("_place") <= cap).drop("_place")


def cap_status(df: DataFrame, by: str, order: list[str], cap: int) -> DataFrame:
    """Rows written and skipped under a cap, per group, without ordering anything."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.select(by, F.least("n", F.lit(cap)).cast("long").alias("n_written"), F.greatest(F.col("n") - cap, F.lit(0)).cast("long").alias("n_skipped"))


def budget(df: DataFrame, by: str, order: list[str], amount: str, most: int, rows: int | None = None) -> DataFrame:
    """Rows until the amounts before them reach a budget, or until so many rows."""
    out = running_before(df, [by], order, amount, most).where(F.col("_before") < most).drop("_before")
    return capped(out, by, order, rows) if rows else out


def miss_streak_cut(df: DataFrame, by: str, order: list[str], hit: Column, streak: int) -> DataFrame:
    """Rows up to the one that completes a streak of misses, and each row's streak so far; a null hit leaves the streak alone."""
    rows, _ = ordered(df.withColumn("_hit", hit), [by], order)
    inside = Window.partitionBy(by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_misses", F.count_if(~F.col("_hit")).over(inside)).withColumn("_kept", F.max(F.when(F.col("_hit"), F.col("_misses"))).over(inside))
    # misses before a range, and how many of them had come when the last hit before it came
    spans = rows.groupBy(by, "_part").agg(F.max("_misses").alias("m"), F.max("_kept").alias("k"))
    spans = spans.withColumn("_skip", F.coalesce(F.sum("m").over(along(spans, [by])), F.lit(0))).withColumn("k", F.col("k") + F.col("_skip"))
    spans = spans.withColumn("_known", F.coalesce(F.max("k").over(along(spans, [by])), F.lit(0)))
    at_hit = F.coalesce(F.col("_skip") + F.col("_kept"), F.col("_known"))
    out = with_spans(rows, spans, [by], "_skip", "_known").withColumn("streak", F.col("_skip") + F.col("_misses") - at_hit)
    place = F.struct("_part", "_at")
    ends = out.where(F.col("streak") >= streak).groupBy(F.col(by).alias("_by")).agg(F.min(place).alias("_end"))
    out = out.join(ends, out[by].eqNullSafe(ends["_by"]), "left")
    return out.where(F.col("_end").isNull() | (place <= F.col("_end"))).drop("_hit", "_misses", "_kept", "_skip", "_known", "_part", "_at", "_by", "_end")


def every_nth(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """Each n-th row of a group, counted from one."""
    return placed(df, [by], order).where(F.col("_place") % n == 0).drop("_place")


def rolling_average(df: DataFrame, by: str, order: list[str], value: str, width: int = 250) -> DataFrame:
    """Mean of the last width values, to one decimal. A task has a block of a group's places, and the last places before it."""
    size = max(BLOCK, width)
    rows = placed(df, [by], order).withColumn("_block", F.floor((F.col("_place") - 1) / size))
    last = (F.col("_place") - 1) % size > size - width
    rows = rows.withColumn("_at", F.explode(F.when(last, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array("_block"))))
    mean = F.avg(value).over(Window.partitionBy(by, "_at").orderBy("_place").rowsBetween(1 - width, 0))
    return rows.withColumn("rolling", F.round(mean, 1)).where("_at = _block").drop("_place", "_block", "_at")


def nearest_rank(values: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles by nearest rank, the place rounded half to even.

    Values are counted before anything is ordered, so a group is as large as its distinct values.
    """
    counts = values.groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy("v")
    upto = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    place = lambda q: F.rint((F.col("total") - 1) * q)
    return upto.groupBy(by).agg(*(F.min(F.when(F.col("upto") > place(q), F.col("v"))).alias(name) for name, q in shares.items()))


BEST_FIRST = ("score", "sentence_token_length", "og_quality_score", "og_language_score", "og_token_count")


def bucketed_selection(df: DataFrame, by: str, most: int, length: str = "sentence_token_length", best: tuple[str, ...] = BEST_FIRST, key: str = "pos") -> DataFrame:
    """At most ``most`` rows a group: a third each of short, medium and long by quartiles, filled with the best of the rest."""
    limits = nearest_rank(df, by, length, {"q25": 0.25, "q75": 0.75})
    order = [F.desc_nulls_last(c) for c in best] + [F.asc(key)]
    out = df.join(limits, by).withColumn("bucket", F.when(F.col(length) <= F.col("q25"), 0).when(F.col(length) <= F.col("q75"), 1).otherwise(2))
    third = max(1, most // 3)
    # rows beyond most + third in their bucket can't be chosen; a constant limit is taken per task before rows are shuffled
    out = out.withColumn("_rank", F.row_number().over(Window.partitionBy(by, "bucket").orderBy(*order))).where(F.col("_rank") <= most + third)
    order = [F.when(F.col("_rank") <= third, F.col("bucket")).otherwise(3).asc(), *order]
    out = out.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out.where(F.col("_place") <= most).drop("q25", "q75", "_rank", "_place")


def unseen(df: DataFrame, seen: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns aren't in seen, nulls being equal."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & df[c].eqNullSafe(seen[c])
    return df.join(seen.select(*columns).distinct(), condition, "left_anti")
