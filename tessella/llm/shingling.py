"""Word shingle sets of many texts at once, by array operations over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessella.llm.hashing import MIX, SEED, mixed

#: Bytes that are hashed at once; a word that crosses the end of a piece makes it longer.
PIECE = 1 << 20

_rng = np.random.default_rng(SEED + 11)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: A random number for each byte, the same for both cases of A-Z and none for blanks; each further byte of a word counts FACTOR times more.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_BLANK] = 0
FACTOR = np.uint64(0x5851F42D4C957F2D)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of FACTOR."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), FACTOR, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts laid end to end, and the place of each one's first byte."""
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    at = int(offsets[0])
    while at < offsets[-1]:
        end = at + PIECE
        while end < offsets[-1] and not _BLANK[data[end]]:
            blank = np.flatnonzero(_BLANK[data[end : end + 4096]])
            end += int(blank[0]) if len(blank) else 4096
        end = min(end, int(offsets[-1]))
        piece = data[at:end]
        word = ~_BLANK[piece]
        start = word.copy()
        start[1:] &= ~word[:-1]
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        start[inside] |= word[inside]
        first = np.flatnonzero(start)
        if len(first):
            place = _places(first, len(piece))
            place[~word] = 0
            hashes.append(mixed(np.add.reduceat(_BYTE[piece] * powers(int(place.max()) + 1)[place], first)))
            places.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def _places(first: np.ndarray, n: int) -> np.ndarray:
    """How far each of n bytes is from the last of the first bytes before it; 0 before any."""
    out = np.zeros(n, np.int64)
    out[first[0] :] = np.arange(first[0], n) - np.repeat(first, np.diff(first, append=n))
    return out


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of the shingles of each text, laid end to end, and their number for each text.

    A text of fewer than size words has its whole sequence as one; null and blank texts have none.
    """
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, ends, raw = texts.buffers()
    if raw is None or not len(texts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    offsets = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    h, places = words(np.frombuffer(raw, np.uint8), offsets)
    text = np.searchsorted(offsets, places, side="right") - 1
    found, owner = [], []
    if len(h) >= size:
        n = len(h) - size + 1
        at = np.flatnonzero(text[:n] == text[size - 1 :])
        found.append(_hashed(h, at, size))
        owner.append(text[at])
    counts = np.bincount(text, minlength=len(texts))
    first = np.cumsum(counts) - counts
    for short in range(1, size):
        some = np.flatnonzero(counts == short)
        if len(some):
            found.append(_hashed(h, first[some], short))
            owner.append(some)
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    tokens, text = np.concatenate(found), np.concatenate(owner)
    if len(found) > 1:
        order = np.argsort(text, kind="stable")
        tokens, text = tokens[order], text[order]
    many = np.bincount(text, minlength=len(texts))
    stop = np.cumsum(many)
    for a, b in zip((stop - many)[many > 1].tolist(), stop[many > 1].tolist()):
        tokens[a:b].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])
    return tokens[new], np.bincount(text[new], minlength=len(texts))


def _hashed(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = mixed(out * MIX + h[at + k])
    return out
