"""Functions that SQL calls by name: table functions for LATERAL, and an aggregate of chunk scores. All in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# white space as in text.SPACE
_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_END = re.compile(rf"(?<=[.!?]){_SPACE}+|(?<=[。！？]){_SPACE}*")
_TOKEN = re.compile(r"\S+")


class SplitSentences:
    """split_sentences(text) -> (no, sentence): the sentences of a text by the splitting rule, counted from 0."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        no = 0
        for part in _END.split(text or ""):
            if re.fullmatch(rf"{_SPACE}*", part) is None:
                yield no, part
                no += 1


class TextRecords:
    """text_records(text, size) -> (part, first, n_tokens, record): a text in records of at most size tokens, with the place of each one's first token."""

    def eval(self, text: str, size: int) -> Iterator[tuple[int, int, int, str]]:
        tokens = list(_TOKEN.finditer(text or ""))
        for part, first in enumerate(range(0, len(tokens), max(1, size))):
            own = tokens[first : first + max(1, size)]
            yield part, first, len(own), text[own[0].start() : own[-1].end()]


def chunk_score(score: pd.Series, weight: pd.Series) -> float:
    """Mean of chunk scores by weight (their lengths); null without weight. A group is one document's chunks."""
    known = score.notna() & weight.notna()
    total = float(weight[known].sum())
    return float((score[known] * weight[known]).sum()) / total if total > 0 else None


def register(spark: SparkSession) -> None:
    """Make split_sentences, text_records and chunk_score known to a session's SQL."""
    spark.udtf.register("split_sentences", F.udtf(SplitSentences, returnType="no int, sentence string", useArrow=True))
    spark.udtf.register("text_records", F.udtf(TextRecords, returnType="part int, first int, n_tokens int, record string", useArrow=True))
    spark.udf.register("chunk_score", F.pandas_udf(chunk_score, "double"))
