"""JSON of no fixed shape, by Spark's variants: lists that may be text, and the map-shaped files of earlier layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessella.functions import text as T
from tessella.sources import stores


def parsed(c: Column | str) -> Column:
    """JSON text as a variant; null where it is broken. A JSON text inside JSON text is read as what it holds."""
    outer = F.try_parse_json(T._c(c))
    inner = F.try_variant_get(outer, "$", "string")
    return F.when(F.schema_of_variant(outer) == "STRING", F.try_parse_json(inner)).otherwise(outer)


def list_or_json(df: DataFrame, column: str, kind: str = "array<bigint>") -> Column:
    """A column of lists, whether it has arrays or JSON text; null for broken text and other values, elements of another kind are null."""
    if isinstance(df.schema[column].dataType, ArrayType):
        return F.col(column).cast(kind)
    return F.try_variant_get(parsed(column), "$", kind)


def map_entries(df: DataFrame, column: str, value: str = "value") -> DataFrame:
    """One row for each entry of a map-shaped JSON text: the other columns, key, pos and value.

    An entry's value may be a list, whose elements are counted by pos, or a single value. Broken texts and other shapes
    give no rows, and so do elements that are no text, number or boolean.
    """
    spark = df.sparkSession
    others = [c for c in df.columns if c != column]
    rows = df.select(*others, parsed(column).alias("_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    entries = rows.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(*others, F.col("key"), F.col("value").alias("_v"))
    single = F.when(F.schema_of_variant("_v").startswith("ARRAY"), F.col("_v")).otherwise(F.try_parse_json(F.concat(F.lit("["), F.to_json("_v"), F.lit("]"))))
    out = entries.select(*others, "key", F.posexplode(F.try_variant_get(single, "$", "array<variant>")).alias("pos", "_e"))
    return out.select(*others, "key", "pos", F.try_variant_get("_e", "$", "string").alias(value)).where(F.col(value).isNotNull())


def migrated(spark: SparkSession, source: str, path: str, meta: dict | None = None) -> DataFrame:
    """The sentences of a map-shaped file (language to list of sentences), published as a versioned table of (lang, pos, sentence).

    Where the table is there already and described alike, it is returned as it is.
    """
    from tessella.sources.snapshots import Snapshots

    store = Snapshots(spark, path, ("lang",))
    described = {"migrated": True} | (meta or {})
    if store.version() and store.meta() == described:
        return store.read()
    rows = map_entries(spark.read.text(source, wholetext=True), "value", "sentence")
    stores.publish(spark, rows.select(F.col("key").alias("lang"), F.col("pos").cast("long").alias("pos"), F.col("sentence").cast(StringType())), path, ("lang",), described)
    return store.read()
