"""Where Python is needed: Unicode compatibility forms, foreign segmenters and tokenizers, model inference, digests of more text than a row holds. All in Arrow batches."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.sources import stores

#: Bytes of a piece of joined texts, at most.
PIECE = 1 << 20


def _mapped(c: Column | str, change: Callable[[str], str]) -> Column:
    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else change(x))

    return apply(T._c(c))


def nfkc(c: Column | str) -> Column:
    return _mapped(c, lambda x: x if unicodedata.is_normalized("NFKC", x) else unicodedata.normalize("NFKC", x))


def without_marks(c: Column | str) -> Column:
    """Letters of any script without combining marks; for Latin alone strip_accents() needs no Python."""
    return _mapped(c, lambda x: x if x.isascii() else unicodedata.normalize("NFC", "".join(m for m in unicodedata.normalize("NFKD", x) if not unicodedata.combining(m))))


def compatible_phrase(c: Column | str) -> Column:
    """phrase_key() of the compatibility form."""
    return T.phrase_key(nfkc(c))


def segmented_by(load: Callable[[], Callable[[str], list[str]]], c: Column | str) -> Column:
    """Sentences by a segmenter, loaded once per worker; a text that it fails on is split by rule."""
    return segmented_or_error(load, c)["sentences"]


def segmented_or_error(load: Callable[[], Callable[[str], list[str]]], c: Column | str) -> Column:
    """(sentences, error): as segmented_by(), with the segmenter's error where it failed, for a log of failures."""

    @F.pandas_udf("struct<sentences: array<string>, error: string>")
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        split = load()

        def of(x: str | None) -> tuple[list[str] | None, str | None]:
            if x is None:
                return None, None
            try:
                return list(split(x)), None
            except Exception as error:  # the segmenter is the caller's: whatever it raises is the row's error
                return None, f"{type(error).__name__}: {error}"

        for s in batches:
            yield pd.DataFrame([of(x) for x in s], columns=["sentences", "error"])

    return T.bind(segment(T._c(c)), lambda r: F.struct(F.coalesce(r["sentences"], T.sentences(c)).alias("sentences"), r["error"].alias("error")))


def tokenized_by(load: Callable[[], Callable[[str], list[int]]], c: Column | str) -> Column:
    """Token ids by a tokenizer, loaded once per worker."""

    @F.pandas_udf("array<bigint>")
    def tokenize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in batches:
            yield s.map(lambda x: [int(i) for i in encode(x or "")])

    return tokenize(T._c(c))


def predicted_by(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[tuple[str, float]]]]], key: str, column: str, batch: int = 32) -> DataFrame:
    """(key, pos, lang, score) of a model that gives labels with scores for lists of texts; loaded once per worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                rows: list[tuple[Any, ...]] = [(k, i, label, float(s)) for k, labels in zip(part[key], model([t or "" for t in part[column]])) for i, (label, s) in enumerate(labels)]
                yield pd.DataFrame(rows, columns=[key, "pos", "lang", "score"])

    return df.select(key, column).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, pos int, lang string, score double")


def aligned(words: Column, labels: Column, load: Callable[[], Callable[[str], list[int]]], most: int = 510) -> Column:
    """ids and labels of the pieces of words: a word's label goes to its first piece, later pieces continue it."""

    @F.pandas_udf("struct<ids: array<bigint>, labels: array<bigint>>")
    def align(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encode = load()
        for tokens, tags in batches:
            out = []
            for ws, ls in zip(tokens, tags):
                pairs = [(int(i), int(tag if k == 0 or tag == 0 or tag % 2 == 0 else tag + 1)) for w, tag in zip(ws, ls) for k, i in enumerate(encode(w))][:most]
                out.append(([p[0] for p in pairs], [p[1] for p in pairs]))
            yield pd.DataFrame(out, columns=["ids", "labels"])

    return align(words, labels)


def text_digests(df: DataFrame, by: str, column: str) -> DataFrame:
    """(by, n, digest): the different texts of each group, and the MD5 of all of them joined in order; by is a string column.

    Texts are made distinct and written, then sorted by range and joined to compressed pieces by many tasks. MD5 takes its
    input in order, so the pieces of a group go to one task; it streams them and holds a batch at a time, however large the
    group is.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch.column("by").unique():
                own = batch.filter(pc.equal(batch.column("by"), key) if key.is_valid else pc.is_null(batch.column("by")))
                data = b"".join(own.column("text").cast(pa.binary()).to_pylist())
                for at in range(0, max(1, len(data)), PIECE):
                    part = data[at : at + PIECE]
                    yield table(by=[key.as_py()], first=[own.column("id")[0].as_py()], at=[at], n=[0 if at else own.num_rows], size=[len(part)], data=[pa.compress(part, "zstd", asbytes=True)])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Any] = []  # value, texts and hash of the group that is being read
        for batch in batches:
            for key, n, size, data in zip(*batch.columns):
                if not found or found[0] != key.as_py():
                    if found:
                        yield result(*found)
                    found = [key.as_py(), 0, hashlib.md5(usedforsecurity=False)]
                found[1] += n.as_py()
                found[2].update(pa.decompress(data.as_buffer(), size.as_py(), "zstd"))
        if found:
            yield result(*found)

    def result(key: str | None, n: int, digest: Any) -> pa.RecordBatch:
        return table(**{by: [key], "n": [n], "digest": [digest.hexdigest()]})

    def table(**columns: list) -> pa.RecordBatch:
        kinds = {int: pa.int64(), bytes: pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(type(v[0]), pa.string())) for v in columns.values()], names=list(columns))

    with stores.without_leftovers(df.sparkSession):
        texts = stores.materialized(df.where(F.col(column).isNotNull()).select(F.col(by).alias("by"), F.col(column).alias("text")).distinct(), "texts")
    # a range has few groups, which needn't be apart: sorted by text alone, rows are compared by their first bytes
    texts = texts.repartitionByRange("by", "text").sortWithinPartitions("text").withColumn("id", F.monotonically_increasing_id())
    pieces = texts.mapInArrow(joined, "by string, first long, at long, n long, size long, data binary")
    return pieces.repartition("by").sortWithinPartitions("by", "first", "at").select("by", "n", "size", "data").mapInArrow(hashed, f"`{by}` string, n long, digest string")
