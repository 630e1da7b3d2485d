"""Fill-in-the-middle: cut every text into prefix, middle and suffix and put the middle last, behind markers.

Units are runs of ASCII letters and single other characters. One pass over a text counts its units and notes a
checkpoint (number of units, bytes and code points before it) every STEP units, block by block of the text's bytes. A
cut is then found by binary search among the checkpoints and a scan of fewer than STEP units from the nearest one
before it, so no list of units is ever held and a text is scanned once whatever its length.

Where the cuts fall and which form a text gets are functions of the seed and doc_id alone, so that retries and other
partitionings give the same rows.

Nulls and edge cases: a null text is empty; an empty text, and one that contains a marker, stays plain, since it could
not be told apart when restored; a null doc_id counts as an empty string in the hash; rows with equal doc_id and text
give equal rows; an empty table gives an empty result; columns other than doc_id and text are not read, so their names
can't clash. Texts are valid UTF-8, as Spark's strings are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between checkpoints; bytes of a text that are counted at once.
STEP, BLOCK = 256, 1 << 16
#: Of 100 texts, those that are cut; of 100 cut ones, those with the suffix first.
CUT, SUFFIX_FIRST = 90, 20

UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xBF][\x80-\xBF]*")
_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
_LEAD = np.array([c & 0xC0 != 0x80 for c in range(256)])


class Checkpoints:
    """Places of every STEP-th unit of a text: lists of equal length of units, bytes and code points before them."""

    def __init__(self, data: bytes, step: int = STEP):
        self.data = data
        places: tuple[list[int], list[int], list[int]] = ([], [], [])
        units = chars = 0
        letter_before = False
        for at in range(0, len(data), BLOCK):
            block = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at)
            letter, lead = _LETTER[block], _LEAD[block]
            before = np.concatenate([[letter_before], letter[:-1]])
            starts = np.flatnonzero(lead & ~(letter & before))
            chosen = starts[-units % step :: step]
            if len(chosen):
                leads = np.cumsum(lead)
                places[0].extend(range(units + -units % step, units + len(starts), step))
                places[1].extend((chosen + at).tolist())
                places[2].extend((leads[chosen] - 1 + chars).tolist())
            units += len(starts)
            chars += int(np.count_nonzero(lead))
            letter_before = bool(letter[-1])
        self.units, self.bytes, self.chars = places
        self.n_units, self.n_chars = units, chars

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) before the unit of that number, counted from 0; the text's end for n_units."""
        if units >= self.n_units:
            return len(self.data), self.n_chars
        near = bisect_right(self.units, units) - 1
        start, chars = self.bytes[near], self.chars[near]
        place = next(islice(UNIT.finditer(self.data, start), units - self.units[near], None)).start()
        return place, chars + len(self.data[start:place].decode("utf-8"))


def choices(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits that decide a document's two cuts, whether it is cut, and its form."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: bytes | None, doc_id: int | None, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    text = text or b""
    places = Checkpoints(text)
    one, two, three, four = choices(doc_id, seed)
    if not text or three % 100 >= cut or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return places.n_units, "plain", None, None, text
    low, high = sorted((one % (places.n_units + 1), two % (places.n_units + 1)))
    (first, before), (second, until) = places.cut(low), places.cut(high)
    prefix, suffix, middle = PREFIX.encode() + text[:first], SUFFIX.encode() + text[second:], MIDDLE.encode() + text[first:second]
    form = "spm" if four % 100 < suffix_first else "psm"
    return places.n_units, form, before, until - before, (suffix + prefix if form == "spm" else prefix + suffix) + middle


def fill_in_middle(docs: DataFrame, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars and output, the text to train on, for each row of docs."""

    def block(rows: dict) -> dict:
        made = [transformed(t, d, seed, cut, suffix_first) for d, t in zip(rows["doc_id"], rows["text"])]
        return {"doc_id": rows["doc_id"]} | {name: [m[i] for m in made] for i, name in enumerate(("n", "form", "prefix_chars", "middle_chars", "output"))}

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])
    rows = map_rows(docs.select("doc_id", F.col("text").cast("binary").alias("text")), block, schema)
    return rows.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from its markers; none of them is in a text that was cut."""
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    body = F.split(rest, F.when(form == "spm", PREFIX).otherwise(SUFFIX), 2)
    first, others = body[0], F.split(body[1], MIDDLE, 2)
    return F.when(form == "psm", F.concat(first, others[1], others[0])).when(form == "spm", F.concat(others[0], others[1], first)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle with hashes in place of the texts: output_sha256, and restored_sha256 of the text rebuilt from the output."""
    rows = fill_in_middle(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
