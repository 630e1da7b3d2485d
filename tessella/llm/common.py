"""What the operators of this subpackage share: reading, staging and text passes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessella/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write go when it ends, rather than when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    delete(df.sparkSession, df._staged_at)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """An aggregate by key, to be joined by key: both sides of the join are then shuffled for it, so Spark may split a hot key."""
    from pyspark.sql import functions as F

    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    known = {c.lower() for c in df.columns}
    while name in known:
        name += "_"
    return name


_caches: dict[str, Callable[[], None]] = {}
_user: list[str] = [""]


def use_cache(name: str, clear: Callable[[], None]) -> None:
    """A worker keeps the cache of one operator at a time: before another operator fills its own, the others are cleared."""
    if _user[0] != name:
        for other, forget in _caches.items():
            if other != name:
                forget()
        _caches[name] = clear
        _user[0] = name


def map_rows(df: DataFrame, per_block: Callable[[dict], dict], schema: pa.Schema, block_chars: int = 4 << 20) -> DataFrame:
    """Apply per_block to blocks of rows, as dicts of lists of values; a block ends at about block_chars bytes of text.

    Only a block's values are Python objects at a time, so long texts in one Arrow batch don't add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, block_chars):
                yield pa.RecordBatch.from_pydict(per_block(values(part)), schema=schema)

    return df.mapInArrow(run, spark_schema(schema))


def add_columns(df: DataFrame, inputs: tuple[str, ...], per_block: Callable[[dict], dict], schema: pa.Schema, block_chars: int = 4 << 20) -> DataFrame:
    """df with the columns of schema, which per_block makes from the inputs; names of schema must be new."""
    from pyspark.sql.types import StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, block_chars):
                made = pa.RecordBatch.from_pydict(per_block(values(part.select(list(inputs)))), schema=schema)
                yield pa.RecordBatch.from_arrays([*part.columns, *made.columns], names=[*part.schema.names, *schema.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *spark_schema(schema).fields]))


def values(batch: pa.RecordBatch) -> dict[str, list]:
    return {name: column.to_pylist() for name, column in zip(batch.schema.names, batch.columns)}


def blocks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about most bytes of strings and binaries; one row at least."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(total, total[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def spark_schema(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def with_key(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Only the columns an operator reads, so that extra columns never clash with its own."""
    return df.select(*columns)
