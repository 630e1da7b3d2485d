"""BPE encoding and decoding over a contiguous rank array.

A word is held as two parallel arrays: the boundaries of its parts, and for each pair of neighbouring parts the rank
of their merge. The loop scans the ranks for the minimum (leftmost of ties), deletes the boundary between the two
parts and refreshes the two neighbouring ranks, until no pair has a rank. Words are short, so scanning beats a heap.
Long runs without white space go through the same steps with the scan kept in blocks (see _merge_long).

The vocabulary is a tokenizers JSON file of the kind NFC + white space + lower case, split by a pattern, byte-level
letters, end-of-word suffix; its path is a parameter and its content stays outside this repository.

Nulls and edge cases: null and empty texts have no tokens and decode to the empty string; texts of any length are
encoded whole; repeated rows are encoded one by one; an empty table gives an empty result; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import map_rows, use_cache, with_key

#: Words longer than this many symbols take the heap; the result is the same.
SHORT = 64
#: Entries that the caches of one worker may hold.
CACHE = 250_000
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Ranks, ids and strings of one tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        splits = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in splits if p["type"] == "Split"))
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letters = byte_letters()
        self.words: dict[str, tuple[bytes, str]] = {}
        self.runs: dict[str, tuple[bytes, str]] = {}

    def merge(self, word: str) -> list[str]:
        """The parts of one pre-token, in byte letters without the suffix."""
        symbols = [*word[:-1], word[-1] + self.suffix]
        if len(symbols) > SHORT:
            return _merge_long(symbols, self.ranks)
        bounds = list(range(len(symbols) + 1))  # part i is text[bounds[i]:bounds[i + 1]]
        text, end = word + self.suffix, len(word) + len(self.suffix)
        bounds[-1] = end
        rank = self.ranks.get
        ranks = [rank((symbols[i], symbols[i + 1]), NEVER) for i in range(len(symbols) - 1)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            part = text[bounds[i] : bounds[i + 1]]
            if i:
                ranks[i - 1] = rank((text[bounds[i - 1] : bounds[i]], part), NEVER)
            if i < len(ranks):
                ranks[i] = rank((part, text[bounds[i + 1] : bounds[i + 2]]), NEVER)
        return [text[a:b] for a, b in zip(bounds, bounds[1:])]

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded parts, each followed by a space, of one pre-token."""
        found = self.words.get(word)
        if found is None:
            parts = self.merge("".join(map(self.letters.__getitem__, word.encode("utf-8"))))
            ids = [self.ids[p] for p in parts if p in self.ids]
            found = struct.pack(f"<{len(ids)}I", *ids), "".join(self.strings[i] + " " for i in ids)
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = found
        return found

    def run(self, run: str) -> tuple[bytes, str]:
        """The same of a run without white space."""
        found = self.runs.get(run)
        if found is None:
            parts = [self.word(w) for w in self.pattern.findall(run)]
            found = b"".join(p[0] for p in parts), "".join(p[1] for p in parts)
            if len(run) <= SHORT:
                if len(self.runs) >= CACHE:
                    self.runs.clear()
                self.runs[run] = found
        return found

    def plain(self, text: str) -> Iterator[tuple[bytes, str]]:
        """A text without special tokens."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        for c in "\x1c\x1d\x1e\x1f":  # str.split() takes these for white space, the vocabulary doesn't
            if c in text:
                return map(self.run, split_at_spaces(lower(text)))
        return map(self.run, lower(text).split())

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids packed as little-endian 32-bit integers, and their decoding."""
        if not text:
            return b"", ""
        ids, strings = [], []
        at = 0
        if self.special_pattern is not None and any(s in text for s in self.special):
            for m in self.special_pattern.finditer(text):
                for i, s in self.plain(text[at : m.start()]):
                    ids.append(i)
                    strings.append(s)
                ids.append(struct.pack("<I", self.special[m[0]]))
                strings.append(m[0] + " ")
                at = m.end()
        for i, s in self.plain(text[at:]):
            ids.append(i)
            strings.append(s)
        return b"".join(ids), "".join(strings)[:-1]

    def decode(self, ids: bytes) -> str:
        """The strings of the ids with a space between: what a vocabulary without decoder gives."""
        return " ".join([self.strings[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids)])


def split_at_spaces(text: str) -> list[str]:
    """Splits at Unicode white space as the vocabulary's pattern sees it."""
    import regex

    return [x for x in regex.split(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text) if x]



def lower(text: str) -> str:
    """Lower case letter by letter: a final sigma is like any other."""
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


def _merge_long(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same merges for runs of any length, in n log n: minima come from a heap, boundaries from a linked list."""
    n = len(symbols)
    part, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(ranks[p], i, *p) for i in range(n - 1) if (p := (part[i], part[i + 1])) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if part[i] == a else -1
        if j < 0 or part[j] != b:
            continue
        part[i], part[j], after[i] = a + b, "", after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (p := (part[x], part[y])) in ranks:
                heapq.heappush(heap, (ranks[p], x, *p))
    return [p for p in part if p]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker and path."""
    use_cache("vocabulary", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of ints) and decoded (string) per document."""
    path = path or default_path()

    def block(rows: dict) -> dict:
        v = vocabulary(path)
        packed = [v.encode(t)[0] for t in rows["text"]]
        ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        return {"doc_id": rows["doc_id"], "ids": ids, "decoded": [v.decode(p) for p in packed]}

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return map_rows(with_key(docs, ("doc_id", "text")), block, schema, 1 << 20)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, and the SHA-256 of its packed ids and of their decoding."""
    path = path or default_path()

    def block(rows: dict) -> dict:
        v, n, ids_hash, decoded_hash = vocabulary(path), [], [], []
        for text in rows["text"]:
            ids, decoded = v.encode(text)
            n.append(len(ids) // 4)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            decoded_hash.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
        return {"doc_id": rows["doc_id"], "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": decoded_hash}

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return map_rows(with_key(docs, ("doc_id", "text")), block, schema)
