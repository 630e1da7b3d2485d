"""Removal of repeated byte strings with a run-length index (run-compressed Burrows-Wheeler transform).

Every byte covered by a string of LENGTH bytes that also starts elsewhere, in any document, is removed.

1. Anchors. Of the K-byte strings inside each LENGTH-byte window, the one with the least hash (leftmost of ties) is the
   window's anchor: equal windows have equal anchors at equal places. A row per anchor carries hashes of the anchor and
   of its context, the bytes that windows with this anchor can cover (at most SIDE + LENGTH bytes).
2. Anchors that occur once are dropped. Equal contexts collapse into one with a count; where the count is two or more,
   the whole context is repeated. Contexts that occur once, of anchors with other contexts, need their bytes compared.
3. The index. An anchor's distinct contexts go to one task, many anchors to a block, cut to the part whose cores occur
   in other contexts of the anchor and that isn't equal to another context's. The block's suffixes are sorted by
   prefix doubling; its transform is cut into runs, and suffixes are sampled at run starts and ends. Longest common
   prefixes are computed at these samples only: elsewhere the neighbour's value is one less than at the byte before
   (reducible values). Streaming them in text order gives each byte's matching statistic, and stretches of at least
   LENGTH are marked.
4. Anchors with more than MOST distinct contexts (common passages in ever different surroundings) never meet in a task:
   their windows' hashes are counted, rows being spread by hash, and windows counted twice or more are marked.
5. Marks meet their documents by key; their union is removed.

Nulls and edge cases: null and empty texts have zero bytes; texts shorter than LENGTH keep all bytes; texts of any
length are cut into overlapping segments, never prefixes; repeated rows are documents of their own, so their texts of
LENGTH bytes or more repeat each other; an empty table gives an empty result; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import dealt_anew, discard, map_rows, spark_schema, staged
from tessella.llm.hashing import SEED, mixed

LENGTH, K = 200, 32
SIDE = LENGTH - K
MOST, RANGES = 4096, 8
SEGMENT, BLOCK = 1 << 18, 1 << 19
PLACE = np.uint64((1 << 24) - 1)

_rng = np.random.default_rng(SEED + 1)
LETTERS = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Powers:
    """Powers of BASE and of its inverse, modulo 2^64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (BASE, BASE_INVERSE))
        return self.up[:n], self.down[:n]


_powers = Powers()


class Hashed:
    """Prefix hashes of a byte array: the hash of any stretch in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers.to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTERS[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def rows(self, length: int) -> np.ndarray:
        """Of every stretch of this length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def pieces(texts: list[str | None]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int, int]]]]:
    """Blocks of bytes; for each stretch in them (document, first byte, first and last window start, document's length)."""
    data, rows, size = [], [], 0
    for d, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for a in range(0, max(0, len(raw) - LENGTH + 1), SEGMENT):
            b = min(a + SEGMENT, len(raw) - LENGTH + 1)
            low, high = max(0, a - SIDE), min(len(raw), b + SIDE + LENGTH)
            if size and size + high - low > BLOCK:
                yield b"".join(data), rows
                data, rows, size = [], [], 0
            data.append(raw[low:high])
            rows.append((d, low, a, b, len(raw)))
            size += high - low
    if size:
        yield b"".join(data), rows


def anchors(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Of all texts' windows, the distinct anchors: document, pos, left, right, anchor and context (hashes)."""
    parts = []
    for raw, rows in pieces(texts):
        data = np.frombuffer(raw, np.uint8)
        hashed = Hashed(data)
        keys = hashed.rows(K)
        keys ^= keys >> np.uint64(31)
        keys *= np.uint64(0x94D049BB133111EB)
        keys = (keys & ~PLACE) | np.arange(len(keys), dtype=np.uint64)
        least, width, span = keys, 1, SIDE + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        document, low, first, last, length = np.array(rows, np.int64).T
        size = np.minimum(length, last + SIDE + LENGTH) - low
        offset = np.concatenate([[0], np.cumsum(size)[:-1]])
        counts = last - first
        index = np.arange(counts.sum()) + np.repeat(offset + first - low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        place = (least[index] & PLACE).astype(np.int64)
        place = place[np.flatnonzero(np.diff(place, prepend=-1))]
        piece = np.searchsorted(offset, place, side="right") - 1
        pos = place - offset[piece] + low[piece]
        left, right = np.minimum(SIDE, pos), np.minimum(LENGTH, length[piece] - pos)
        parts.append((document[piece], pos, left, right, hashed.of(place, place + K), hashed.of(place - left, place + right)))
    if not parts:
        parts = [(np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2]
    columns = [np.concatenate(c) for c in zip(*parts)]
    again = np.flatnonzero((np.diff(columns[0], prepend=-1) != 0) | (np.diff(columns[1], prepend=-1) != 0))  # segments share anchors at their ends
    return dict(zip(("document", "pos", "left", "right", "anchor", "context"), (c[again] for c in columns)))


def suffix_order(symbols: np.ndarray, depth: int, group: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order of group and their first depth symbols or more; ranks by the first h symbols for each h."""
    n, bits = len(symbols), int(symbols.max()).bit_length()
    h = 63 // bits
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(h, np.int64)])
    keys = np.zeros(n, np.int64)
    for i in range(h):
        keys = keys << bits | padded[i : i + n]
    if group is not None:
        keys = group * (n + 1) + np.unique(keys, return_inverse=True)[1]
    levels = []
    while True:
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.empty(n, bool)
        new[0], new[1:] = True, ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32)
        levels.append((h, rank))
        if h >= depth or new.all():
            return order, levels
        keys = rank.astype(np.int64) * (n + 1)
        keys[: max(0, n - h)] += rank[h:]
        h *= 2


def common_prefixes(symbols: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes a and b, by descent through the ranks."""
    n, out = len(symbols), np.zeros(len(a), np.int64)
    for h, rank in reversed(levels):
        x, y = a + out, b + out
        live = np.flatnonzero((x < n) & (y < n))
        same = live[rank[x[live]] == rank[y[live]]]
        out[same] += h
    for _ in range(levels[0][0]):
        x, y = a + out, b + out
        live = np.flatnonzero((x < n) & (y < n))
        same = live[symbols[x[live]] == symbols[y[live]]]
        out[same] += 1
    return out


def matching_statistics(symbols: np.ndarray, depth: int, group: np.ndarray | None = None) -> np.ndarray:
    """For each place, the length of its longest match elsewhere in its group (exact up to depth), from samples at run ends.

    Where there are groups, each text begins with a separator of its own, all separators are larger than other symbols,
    and form the last group. So no two suffixes are alike up to the ends of their texts, and the order doesn't depend
    on what comes behind them.
    """
    n = len(symbols)
    order, levels = suffix_order(symbols, depth, group)
    transform = symbols[order - 1]  # the symbol before each suffix
    transform[order == 0] = -1
    new = transform[1:] != transform[:-1]
    if group is not None:
        new |= group[order[1:]] != group[order[:-1]]
    change = np.flatnonzero(new) + 1
    run_starts, run_ends = np.concatenate([[0], change]), np.concatenate([change - 1, [n - 1]])
    best = np.zeros(n, np.int64)
    for at, step in ((run_starts, -1), (run_ends, 1)):
        other = at + step
        inside = (other >= 0) & (other < n)
        sampled = np.full(n, -1, np.int64)
        sampled[order[at[~inside]]] = 0
        places = order[at[inside]]
        sampled[places] = common_prefixes(symbols, levels, places, order[other[inside]])
        # a place that isn't sampled has one less than the place before it
        last = np.maximum.accumulate(np.where(sampled >= 0, np.arange(n), -1))
        value = np.where(last >= 0, sampled[last] - (np.arange(n) - last), 0)
        best = np.maximum(best, value)
    return best


def repeated(contexts: list[bytes], groups: list[int]) -> list[list[tuple[int, int]]]:
    """For each context, its stretches that are covered by LENGTH-byte strings found in another context of its group.

    Contexts of different anchors may overlap in their document, so they aren't compared.
    """
    sizes = np.array([len(c) + 1 for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    symbols = np.empty(int(sizes.sum()), np.int32)
    text = np.ones(len(symbols), bool)
    text[starts] = False
    symbols[text] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int32) + 1
    symbols[starts] = 257 + np.arange(len(contexts))  # a separator before each context
    group = np.repeat(np.array(groups, np.int64), sizes)
    group[starts] = max(groups) + 1
    found = matching_statistics(symbols, int(sizes.max()), group)
    found[starts] = 0
    end = np.repeat(starts + sizes, sizes)
    hit = np.flatnonzero((found >= LENGTH) & (end - np.arange(len(symbols)) >= LENGTH))
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    if len(hit):
        owner = np.searchsorted(starts, hit, side="right") - 1
        cut = np.flatnonzero((np.diff(hit) > LENGTH) | (np.diff(owner) != 0)) + 1
        for group in np.split(np.arange(len(hit)), cut):
            o = owner[group[0]]
            out[o].append((int(hit[group[0]] - starts[o]) - 1, int(hit[group[-1]] - starts[o]) - 1 + LENGTH))
    return out


def hulls(contexts: list[bytes], left: list[int], groups: list[int]) -> tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]:
    """For each context the part that needs the index, (0, 0) if none, and the stretches known to occur in another of its group.

    Windows go by RANGES ranges of their start. All windows of a range contain its core, so a range whose core occurs in
    no other context has no match. A range whose bytes as a whole occur in another context is repeated as a whole; of
    such equal ranges one goes on, where others share its core, as what those may match. The part runs from the first
    range that goes on to the last.
    """
    n = len(contexts)
    sizes = np.array([len(c) for c in contexts])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hashed = Hashed(np.frombuffer(b"".join(contexts), np.uint8))
    before = np.array(left)  # bytes before the anchor
    group = np.array(groups, np.uint64) << np.uint64(8)
    width = -(-(SIDE + 1) // RANGES)
    low, high, known = np.full(n, LENGTH * 4), np.full(n, -1), np.zeros(n, np.int64)
    for r in range(RANGES):
        start, end = r * width, min(SIDE, (r + 1) * width - 1)  # of windows, counted from SIDE bytes before the anchor
        fits = np.flatnonzero((end >= SIDE - before) & (K + start <= sizes - before))
        at = first[fits] + before[fits]
        core = np.unique(mixed(hashed.of(at - SIDE + end, at + K + start) + group[fits]), return_inverse=True)[1]
        alive = np.bincount(core)[core] > 1
        fits, at, core = fits[alive], at[alive], core[alive]
        whole = (start >= SIDE - before[fits]) & (K + end <= sizes[fits] - before[fits])
        bytes_ = np.arange(len(fits), dtype=np.uint64)  # a range cut off by its text's end is like no other
        bytes_[whole] = mixed(hashed.of(at[whole] - SIDE + start, at[whole] + K + end) + group[fits[whole]]) | np.uint64(1 << 63)
        _, place, inverse, counts = np.unique(bytes_, return_index=True, return_inverse=True, return_counts=True)
        known[fits[counts[inverse] > 1]] |= 1 << r
        goes = place[np.bincount(core[place], minlength=core.max(initial=0) + 1)[core[place]] > 1]
        low[fits[goes]] = np.minimum(low[fits[goes]], start)
        high[fits[goes]] = end
    a = np.maximum(0, before - SIDE + low)
    b = np.minimum(sizes, before + K + high)
    parts = [(x, y) if h >= 0 and y - x >= LENGTH else (0, 0) for x, y, h in zip(a.tolist(), b.tolist(), high.tolist())]
    stretches = [[(p - SIDE + x * width, p + K + min(SIDE, (y + 1) * width - 1)) for x, y in RUNS[m]] for p, m in zip(left, known.tolist())]
    return parts, stretches


#: Runs of ones in each mask of ranges, as (first, last).
RUNS = [[(i, next(j for j in range(i, RANGES) if not m >> (j + 1) & 1)) for i in range(RANGES) if m >> i & 1 and not (i and m >> (i - 1) & 1)] for m in range(1 << RANGES)]

OCCURRENCE = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int32()), ("left", pa.int16()), ("right", pa.int16()), ("anchor", pa.int64()), ("context", pa.int64())])
MARK = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
CONTEXT = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("anchor", pa.int64()), ("context", pa.int64()), ("n", pa.int64()), ("crowded", pa.bool_()), ("at", pa.int16()), ("bytes", pa.binary())])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")


def occurrences(docs: DataFrame) -> DataFrame:
    def block(rows: dict) -> dict:
        found = anchors(rows["text"])
        ids, keys = pa.array(rows["doc_id"], pa.int64()), pa.array(rows["row_key"], pa.int64())
        at = pa.array(found["document"])
        return {"doc_id": ids.take(at), "row_key": keys.take(at), "pos": found["pos"].astype(np.int32)} | {k: found[k].astype(np.int16) for k in ("left", "right")} | {k: found[k].view(np.int64) for k in ("anchor", "context")}

    return map_rows(keyed(docs), block, OCCURRENCE, BLOCK)


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts (doc_id, row_key, pos, left, right, anchor, context, n, crowded)."""
    fields = ("pos", "left", "right", "anchor", "context", "n", "crowded")
    asked = wanted.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    rows = _with_marks(docs, asked, "asked").where("asked is not null")

    def block(values: dict) -> dict:
        out: dict[str, list] = {n: [] for n in CONTEXT.names}
        for doc_id, key, text, asked in zip(values["doc_id"], values["row_key"], values["text"], values["asked"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for x in asked:
                start = x["pos"] - x["left"]
                for name, value in zip(CONTEXT.names, (doc_id, key, start, x["anchor"], x["context"], x["n"], x["crowded"], x["left"], raw[start : x["pos"] + x["right"]])):
                    out[name].append(value)
        return out

    return map_rows(rows, block, CONTEXT, 1 << 20)


def _with_marks(docs: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """keyed docs with the marks of each row, null where there are none."""
    theirs = marks.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), name)
    own = keyed(docs)
    return own.join(theirs, (own["row_key"] == theirs["_key"]) & own["doc_id"].eqNullSafe(theirs["_id"]), "left").select("doc_id", "row_key", "text", name)


def stretches_of_documents(parts: list[tuple]) -> list[tuple]:
    """(group, doc_id, row_key, start, bytes) with overlapping parts of a document joined.

    In periodic texts an anchor recurs within its own context; joined, each place of a document is in its group once, so
    what matches it is elsewhere.
    """
    out: list[tuple] = []
    for part in sorted(parts, key=lambda p: (p[0], p[1] is not None, p[1] or 0, p[2], p[3])):
        last = out[-1] if out else None
        if last and last[:3] == part[:3] and part[3] < last[3] + len(last[4]):
            out[-1] = (*last[:4], last[4] + part[4][last[3] + len(last[4]) - part[3] :])
        else:
            out.append(part)
    return out


def _index_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of contexts() in order of their anchors: marks of those that occur once, by an index over a block of anchors."""
    held: list[tuple] = []
    size, seen, last = 0, set(), None

    def marks() -> pa.RecordBatch:
        groups = np.unique([r[3] for r in held], return_inverse=True)[1].tolist()
        hull, known = hulls([r[8] for r in held], [r[7] for r in held], groups)
        parts = stretches_of_documents([(g, r[0], r[1], r[2] + a, r[8][a:b]) for r, g, (a, b) in zip(held, groups, hull) if b])
        found = repeated([p[4] for p in parts], [p[0] for p in parts]) if parts else []
        rows = [(p[1], p[2], p[3] + x, p[3] + y) for p, spans in zip(parts, found) for x, y in spans]
        rows += [(r[0], r[1], r[2] + x, r[2] + y) for r, spans in zip(held, known) if r[5] == 1 for x, y in spans]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(MARK.types)], schema=MARK)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[3] != last:
                if size >= BLOCK // 2:
                    yield marks()
                    held, size = [], 0
                seen, last = set(), row[3]
            place = (row[0], row[1], row[2], row[7])
            if place not in seen:  # equal rows of the input bring a context twice
                seen.add(place)
                held.append(row)
                size += len(row[8]) + 1
    if held:
        yield marks()


WINDOW = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("anchor", pa.int64()), ("start", pa.int32()), ("n", pa.int64()), ("at", pa.int16()), ("window", pa.int64())])


def _windows(rows: dict) -> dict:
    """Every window of the contexts: its place relative to the anchor and its hash."""
    parts = []
    for i, raw in enumerate(rows["bytes"]):
        hashed = Hashed(np.frombuffer(raw, np.uint8))
        start = np.arange(len(raw) - LENGTH + 1)
        parts.append((np.full(len(start), i), start, hashed.of(start, start + LENGTH)))
    at, start, window = (np.concatenate(c) if parts else np.empty(0, np.int64) for c in (zip(*parts) if parts else ((), (), ())))
    take = lambda name, kind: pa.array(rows[name], kind).take(pa.array(at, pa.int64()))
    first = np.array(rows["start"], np.int64)[at] if len(at) else start
    left = np.array(rows["at"], np.int64)[at] if len(at) else start
    return {"doc_id": take("doc_id", pa.int64()), "row_key": take("row_key", pa.int64()), "anchor": take("anchor", pa.int64()), "start": (first + start).astype(np.int32), "n": take("n", pa.int64()), "at": (left - start).astype(np.int16), "window": window.view(np.int64)}


def all_marks(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, start, end: stretches that repeat elsewhere; they may overlap."""
    seen = staged(occurrences(docs), "anchors")
    often = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("anchor")
    again = staged(seen.join(dealt_anew(often, "anchor"), "anchor"), "repeated-anchors")
    discard(seen)
    key = ("anchor", "context", "left", "right")
    rep = F.min(F.struct("doc_id", "row_key", "pos")).alias("rep")
    distinct = staged(again.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), rep), "contexts")
    copied = distinct.where("n > 1").select(*key)
    whole = again.join(copied, list(key)).where(F.col("left") + F.col("right") >= LENGTH)
    whole = whole.select("doc_id", "row_key", (F.col("pos") - F.col("left")).cast("int").alias("start"), (F.col("pos") + F.col("right")).cast("int").alias("end"))
    mixed_anchors = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("n") == 1).alias("single")).where("m > 1 and single > 0")
    wanted = distinct.join(dealt_anew(mixed_anchors, "anchor").select("anchor", (F.col("m") > MOST).alias("crowded")), "anchor").select(*key, "n", "crowded", "rep.*")
    whole = staged(whole, "whole")
    discard(again)
    stored = staged(contexts(docs, wanted), "context-bytes")
    indexed = stored.where("not crowded").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_index_marks, spark_schema(MARK))
    windows = staged(map_rows(stored.where("crowded"), _windows, WINDOW, 1 << 17), "windows")
    twice = windows.groupBy("anchor", "at", "window").agg(F.sum("n").alias("total")).where("total > 1").select("anchor", "at", "window")
    counted = windows.where("n = 1").join(twice, ["anchor", "at", "window"]).select("doc_id", "row_key", "start", (F.col("start") + LENGTH).cast("int").alias("end"))
    marks = staged(whole.unionByName(indexed).unionByName(counted), "marks")
    for table in (whole, stored, windows):
        discard(table)
    return marks


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def merged(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of stretches, as maximal disjoint ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(marks):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that are kept."""
    spans = all_marks(docs).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "end")).alias("marks"))

    def block(rows: dict) -> dict:
        out: dict[str, list] = {n: [] for n in KEPT.names}
        for doc_id, text, marks in zip(rows["doc_id"], rows["text"], rows["marks"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            gone = merged([(m["start"], m["end"]) for m in marks or ()])
            ends = [0, *(x for span in gone for x in span), len(raw)]
            kept = hashlib.sha256(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))).hexdigest()
            for name, value in zip(KEPT.names, (doc_id, len(raw), sum(b - a for a, b in gone), len(gone), kept)):
                out[name].append(value)
        return out

    return map_rows(_with_marks(docs, spans, "marks"), block, KEPT)
