"""64-bit hashes of words and of sequences of them, over numpy arrays."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

from tessella.llm.common import use_cache

SEED = 20240229
MIX = np.uint64(0x9E3779B97F4A7C15)
UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words that a worker remembers.
CACHE = 300_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_hash(raw: bytes) -> int:
    return xxh3_64_intdigest(raw, SEED)


_words: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, remembered for the words seen before."""
    use_cache("words", _words.clear)
    known = _words
    out = [known.get(w) for w in words]
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                h = out[i] = text_hash(words[i])
                if len(known) >= CACHE:
                    known.clear()
                known[words[i]] = h
    return np.array(out, dtype=np.uint64)


def lower_words(text: str | None) -> list[bytes]:
    """Words between the six ASCII blanks, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(UPPER).split()
