"""Where tables are kept: partitioned sentence and example stores, atomic JSON, manifests that decide whether a cache holds."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCES = "source string, lang string, pos bigint, sentence string"
EXAMPLES = "kind string, original_text string, tokens array<string>, ner_tags array<bigint>, input_ids array<bigint>, attention_mask array<bigint>, labels array<bigint>"
RECORDS = (
    "lang string, sentence string, sentence_token_length bigint, og_language_score double, og_token_count bigint, og_quality_score double, edu_score_raw double, source_language string, is_wikipedia boolean, score double"
)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _renamed(spark: SparkSession, part, target, over: bool) -> bool:
    """Rename a file in one step, so that readers always see all of one; without over, False if the target is there."""
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(rename, int(over))
    if over:
        options[0] = rename.OVERWRITE
    try:
        context.rename(part, target, options)
    except Py4JJavaError as error:
        if over or "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
            raise
        return False
    return True


def _linked(spark: SparkSession, target, data: bytes, over: bool) -> bool:
    """As write_json on a local disk, where Hadoop's rename takes several steps: an atomic move, or a hard link that only one writer gets."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    nio = jvm.java.nio.file
    to = jvm.java.io.File(target.toUri().getPath()).toPath()
    nio.Files.createDirectories(to.getParent(), array(nio.attribute.FileAttribute, 0))
    part = to.resolveSibling(f".{uuid.uuid4().hex}.tmp")
    nio.Files.write(part, bytearray(data), array(nio.OpenOption, 0))
    try:
        if over:
            options = array(nio.CopyOption, 2)
            options[0], options[1] = nio.StandardCopyOption.ATOMIC_MOVE, nio.StandardCopyOption.REPLACE_EXISTING
            nio.Files.move(part, to, options)
        else:
            nio.Files.createLink(to, part)
    except Py4JJavaError as error:
        if over or error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    finally:
        nio.Files.deleteIfExists(part)
    return True


def write_json(spark: SparkSession, path: str, payload: Any, over: bool = True) -> bool:
    """Write beside the target, then rename: readers see the old file or the new one. Without over, False if there is one."""
    data = json.dumps(payload, ensure_ascii=False, sort_keys=True, indent=1).encode()
    fs, target = _fs(spark, path)
    if fs.getScheme() == "file":
        return _linked(spark, target, data, over)
    _, part = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    done = _renamed(spark, part, target, over)
    if not done:
        fs.delete(part, False)
    return done


def read_json(spark: SparkSession, path: str) -> Any:
    """The content; None if the file is missing or broken."""
    fs, p = _fs(spark, path)
    try:
        stream = fs.open(p)
        try:
            return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    except ValueError:
        return None
    except Py4JJavaError as error:
        if str(error.java_exception.getClass().getSimpleName()) not in ("FileNotFoundException", "NoSuchFileException", "ChecksumException"):
            raise
        return None


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in spark.checkpoint.dir (a folder of our own where it is unset and Spark is local) and read back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go when each ends, rather than when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"


def sentence_store(spark: SparkSession, path: str):
    """The versioned table of (source, lang, pos, sentence), a partition per source and language."""
    from tessella.sources.snapshots import Snapshots

    return Snapshots(spark, path, ("source", "lang"))


def write_sentences(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Commit df as a version of a sentence store: overwrite, append, or errorifexists."""
    store = sentence_store(df.sparkSession, path)
    rows = typed(df, SENTENCES)
    if mode == "errorifexists" and store.version():
        raise FileExistsError(path)
    if mode == "append":
        store.append(rows)
    else:
        store.overwrite(rows)


def read_sentences(spark: SparkSession, path: str, langs: list[str] | None = None) -> DataFrame:
    """The rows of the current version; of some languages, only their partitions are listed."""
    store = sentence_store(spark, path)
    return store.read(lang=langs) if langs else store.read()


def known_languages(spark: SparkSession, path: str) -> list[str]:
    """Languages in a store, from its manifest alone."""
    return sorted({lang for _, lang in sentence_store(spark, path).partitions()})


def typed(df: DataFrame, schema: str) -> DataFrame:
    """Fixed columns in fixed order, missing ones null."""
    from pyspark.sql.types import StructType

    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields))


def write_records(df: DataFrame, path: str, schema: str = RECORDS) -> None:
    """Fixed columns in fixed order, missing ones null."""
    typed(df, schema).write.mode("overwrite").parquet(path)


def write_language_map(spark: SparkSession, df: DataFrame, path: str, describes: dict | None = None) -> DataFrame:
    """A folder per language, and a manifest with the rows of each; returns what was written."""
    df.write.mode("overwrite").partitionBy("lang").parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    counts = {r["lang"]: r["count"] for r in out.groupBy("lang").count().collect()}  # one row a language
    Manifest(spark, path).write(describes or {}, languages=counts)
    return out


def read_language_map(spark: SparkSession, path: str, schema: str, langs: list[str] | None = None) -> DataFrame:
    """The tables of a map, or of some languages; an empty table if there is no map."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(path)
    return df.where(F.col("lang").isin(langs)) if langs else df


def language_counts(spark: SparkSession, path: str) -> dict[str, int]:
    """Rows of each language, from the manifest alone."""
    return (read_json(spark, Manifest(spark, path).path) or {}).get("languages", {})


def publish(spark: SparkSession, df: DataFrame, path: str, keys: tuple[str, ...] = (), meta: dict | None = None) -> int:
    """Put a table in the place of another in one step: readers see all of one version; returns its number."""
    from tessella.sources.snapshots import Snapshots

    return Snapshots(spark, path, keys).overwrite(df, meta)


def clear(spark: SparkSession, path: str) -> None:
    """Delete a table and its manifest, where there are any."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)
    fs.delete(_fs(spark, f"{path.rstrip('/')}.manifest.json")[1], False)


def write_splits(df: DataFrame, path: str) -> None:
    """A partition per split, published in one step."""
    publish(df.sparkSession, df, path, ("split",))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    from tessella.sources.snapshots import Snapshots

    return Snapshots(spark, path, ("split",)).read(split=[split])


def read_records(spark: SparkSession, path: str, schema: str = RECORDS) -> DataFrame:
    """Records of all shards below path; an empty table if there are none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).parquet(path)


def write_examples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples; texts that were not kept are their tokens joined."""
    df = spark.read.schema(EXAMPLES).parquet(path)
    return df.withColumn("original_text", F.coalesce("original_text", F.array_join("tokens", " ")))


def compacted(df: DataFrame, *drop: str) -> DataFrame:
    """Without columns that training doesn't read."""
    return df.drop(*drop)


class Manifest:
    """A JSON file beside a table; the table holds as long as its description is the wanted one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}.manifest.json"

    def holds(self, wanted: dict) -> bool:
        found = read_json(self.spark, self.path)
        return found is not None and found.get("describes") == json.loads(json.dumps(wanted))

    def write(self, wanted: dict, **stats: Any) -> None:
        write_json(self.spark, self.path, {"describes": wanted} | stats)

    def completed(self) -> set[str]:
        return set((read_json(self.spark, self.path) or {}).get("completed", ()))


def cached(spark: SparkSession, path: str, describes: dict, build, rebuild: bool = False) -> DataFrame:
    """The table at path if its manifest holds, else built, written and described."""
    manifest = Manifest(spark, path)
    if rebuild or not manifest.holds(describes) or not exists(spark, path):
        df = build()
        df.write.mode("overwrite").parquet(path)
        manifest.write(describes, rows=spark.read.parquet(path).count())
    return spark.read.parquet(path)


def pending(configs: DataFrame, completed: DataFrame) -> DataFrame:
    """Configurations that aren't completed."""
    return configs.join(completed.select("config"), "config", "left_anti")
