"""Toxicity by a subsequence string kernel machine with Nyström landmarks.

Units are tokens between blanks without punctuation, and runs of single-character tokens joined ("i d i o t"). The
kernel of a unit and a landmark is the gap-weighted subsequence kernel of order three: every common subsequence counts
with DECAY to the power of its least spans in both, so gaps and inserted characters cost little, and repeated syllables
don't add up. Divided by own kernel it is 1 for the landmark itself; what chance overlaps reach (FLOOR) counts as 0.

Landmarks are words and word beginnings of the training sentences that best tell the classes apart, and words of stems
that take many endings in toxic documents; no two of them are alike. Unit vectors are whitened by the landmarks' own
kernel matrix (Nyström), and a linear support vector machine is trained on them. Labels are per document, so a toxic
document lends its label to its highest unit only, in a few rounds, against all units of the others. A document is worth
the sum of its TOP highest distinct units beyond the margin of the clean ones. The sum becomes a probability by a
logistic curve fitted on the training documents. Each distinct unit is scored once per worker.

Training uses at most POSITIVES + NEGATIVES labelled documents and CHARACTERS characters of them, chosen by a hash of
doc_id among rows that aren't held out; their texts are read whole, whatever their length (the first that goes beyond
CHARACTERS, and those behind it, stay out). Scoring reads whole texts of all documents.

Nulls and edge cases: null, empty and blank texts score like a sentence without units; texts of any length are read
whole, and tokens longer than WIDTH are cut into overlapping windows; rows without doc_id aren't held out nor learned
from; repeated rows are scored one by one; without labelled documents of both classes every score is 0 (as without a word that tells them apart); an empty table
gives an empty result; columns other than doc_id and text (and toxic in labels) are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, use_cache
from tessella.llm.langid import held_out

DECAY, REACH, WIDTH, STEP, FLOOR = 0.7, 8, 24, 12, 0.4
LANDMARKS, POSITIVES, NEGATIVES, CHARACTERS, SEED = 96, 1500, 2500, 8_000_000, 17
THRESHOLD, SURE, TELLING, TOP, CACHE = 0.3, 0.7, 20, 3, 300_000
#: Lengths of stems, least words of a telling one in toxic documents, and how many times more often than in others.
STEMS, STEM_WORDS, STEM_TELLING = (5, 6, 7), 6, 10
OTHER, GAP, BASE = 26, 31, 32
BREAK = "\x03"


def _symbols() -> np.ndarray:
    """Symbol of each code point below 0x250: a to z, classes of other letters, and some digits as letters they stand for."""
    table = np.full(0x250, GAP, np.uint8)
    for cp in range(0x250):
        c = chr(cp).lower()[0]
        if "a" <= c <= "z":
            table[cp] = ord(c) - 97
        elif chr(cp).isalpha():
            table[cp] = OTHER + cp % 5
    for digit, letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}.items():
        table[ord(digit)] = ord(letter) - 97
    return table


SYMBOLS = _symbols()
#: Signs that are left out of units.
DROPPED = dict.fromkeys(map(ord, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„‘’«»‹›…–—·•"))


def encode(units: list[str]) -> np.ndarray:
    """Units of at most WIDTH characters as rows of symbols, filled up with gaps."""
    width = max(map(len, units), default=0)
    flat = np.frombuffer("".join(u.ljust(width, " ") for u in units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), width)
    return np.where(flat < len(SYMBOLS), SYMBOLS[np.minimum(flat, len(SYMBOLS) - 1)], np.where(flat > 0x24F, OTHER + flat % 5, GAP)).astype(np.int32)


def subsequences(symbols: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """For each pair of distances: codes of the three symbols at every place of every row (-1 where one is a gap), and the weight."""
    out = []
    n = symbols.shape[1]
    full = symbols != GAP
    for far in range(2, min(REACH, n)):
        ends = full[:, : n - far] & full[:, far:]
        outer = symbols[:, : n - far] * (BASE * BASE) + symbols[:, far:]
        for near in range(1, far):
            code = np.where(ends & full[:, near : n - far + near], outer + symbols[:, near : n - far + near] * BASE, -1)
            out.append((code, DECAY ** (far + 1)))
    return out


class Kernel:
    """Scaled subsequence kernels with fixed landmarks, above FLOOR."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.features = np.zeros((BASE**3, len(landmarks)), np.float32)
        for code, weight in subsequences(encode(landmarks)):
            row, place = np.nonzero(code >= 0)
            np.maximum.at(self.features, (code[row, place], row), weight)
        self.used = self.features.any(axis=1)
        # the landmarks of each code, laid end to end: a code is in few of them
        code, self.among = np.nonzero(self.features)
        self.weight = self.features[code, self.among]
        self.starts = np.searchsorted(code, np.arange(BASE**3 + 1))
        own = (self.features**2).sum(axis=0)
        self.scale = np.where(own > 0, 1 / np.maximum(own, 1e-30), 0).astype(np.float32)

    def rows(self, units: list[str]) -> np.ndarray:
        """Kernel of each unit (of at most WIDTH characters) with each landmark."""
        sums = np.zeros((len(units), len(self.landmarks)), np.float32)
        if not units:
            return sums
        rows, codes, weights = [], [], []
        for code, weight in subsequences(encode(units)):
            row, place = np.nonzero((code >= 0) & self.used[code])
            if len(row):
                rows.append(row)
                codes.append(code[row, place])
                weights.append(np.full(len(row), weight, np.float32))
        if rows:
            row, code, weight = map(np.concatenate, (rows, codes, weights))
            order = np.lexsort((-weight, row * BASE**3 + code))
            order = order[np.flatnonzero(np.diff(row[order] * BASE**3 + code[order], prepend=-1))]  # its least span
            row, code, weight = row[order], code[order], weight[order]
            many = self.starts[code + 1] - self.starts[code]
            at = np.arange(many.sum()) + np.repeat(self.starts[code] - np.cumsum(many) + many, many)
            place = np.repeat(row, many) * len(self.landmarks) + self.among[at]
            sums = np.bincount(place, self.weight[at] * np.repeat(weight, many), sums.size).reshape(sums.shape).astype(np.float32)
        return np.clip((sums * self.scale - FLOOR) / (1 - FLOOR), 0, 1)

    def of(self, units: list[str]) -> np.ndarray:
        """The same of units of any length: the largest over their windows."""
        windows, owner = [], []
        for i, u in enumerate(units):
            u = u.translate(DROPPED)
            for a in range(0, max(1, len(u) - STEP), STEP):
                windows.append(u[a : a + WIDTH])
                owner.append(i)
        out = np.zeros((len(units), len(self.landmarks)), np.float32)
        by_length = np.argsort([len(w) for w in windows], kind="stable")  # short ones aren't filled up to the longest
        for part in np.array_split(by_length, max(1, len(windows) // 8192 + 1) if len(windows) > 64 else 1):
            if len(part):
                np.maximum.at(out, np.array(owner)[part], self.rows([windows[i] for i in part]))
        return out


class Units:
    """Splits texts into sentences of units; units are numbered, and keep what was computed for them."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.short: list[bool] = []
        self.ends: list[bool] = []

    def split(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit numbers, the sentence of each, and the text of each sentence (every text has one unit and sentence at least)."""
        tokens: list[str] = []
        bounds = []
        for text in texts:
            tokens += f"{text or ''} {BREAK}".lower().replace("\n", f" {BREAK} ").split()
            bounds.append(len(tokens))
        get = self.index.get
        ids = [get(t) for t in tokens]
        if None in ids:
            ids = [self.number(t) if i is None else i for i, t in zip(ids, tokens)]
        ids = np.array(ids, np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds, prepend=0))
        ends, short = np.array(self.ends, bool)[ids], np.array(self.short, bool)[ids]
        sentence = np.concatenate([[0], np.cumsum(ends)[:-1]]) if len(ids) else np.empty(0, np.int64)
        # runs of three or more single characters are units too
        edge = np.flatnonzero(np.diff(np.concatenate([[0], short.astype(np.int8), [0]])))
        more = [(self.number("".join(tokens[a:b])), sentence[a]) for a, b in zip(edge[::2], edge[1::2]) if b - a >= 3]
        if more:
            ids, sentence = np.concatenate([ids, [m[0] for m in more]]), np.concatenate([sentence, [m[1] for m in more]])
        return ids, sentence, owner[np.flatnonzero(ends)]

    def number(self, unit: str) -> int:
        return self.index[unit] if unit in self.index else self.add(unit)

    def add(self, unit: str) -> int:
        self.index[unit] = i = len(self.names)
        self.names.append(unit)
        self.short.append(len(bare := unit.strip(".,;:!?\"'()*")) == 1 and bare.isalpha())
        self.ends.append(unit == BREAK or unit.rstrip("\"'”’)]")[-1:] in (".", "!", "?"))
        return i


@dataclass
class Machine:
    """Value of a unit: bias + weights . kernel row, 0 where the margin of clean units begins; probability of a document's sum by slope and offset."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def digest(self) -> str:
        return hashlib.sha256(repr((self.landmarks, self.weights.tolist(), self.bias, self.slope, self.offset)).encode("utf-8", "surrogatepass")).hexdigest()


def hash_of(words: tuple[str, ...]) -> int:
    return zlib.crc32(" ".join(words).encode("utf-8", "surrogatepass"))


def choose_landmarks(texts: list[str], toxic: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Words and word beginnings that toxic documents have much more often, most telling first, none alike.

    A word tells if many more toxic documents have it. A stem tells if, in all, toxic documents have many more different
    words of it; then its words that toxic documents rather than others have are landmarks too, however rare. Of
    documents with the same least three-word window, which copies share, one counts.
    """
    counts, kinds, n, seen = [Counter(), Counter()], [Counter(), Counter()], [0, 0], set()
    whole: set[str] = set()
    for i in [*np.flatnonzero(toxic), *np.flatnonzero(~toxic)]:  # of the others, only what toxic documents have is counted
        text, label = texts[i], toxic[i]
        tokens = text.lower().split()
        least = min(map(hash_of, zip(tokens, tokens[1:], tokens[2:])), default=None)
        if least is not None and least in seen:
            continue
        seen.add(least)
        n[int(label)] += 1
        words = {w.strip(".,;:!?\"'()")[:WIDTH] for w in tokens}
        words = {w for w in words if len(w) >= 4}
        parts, stems = {w[:k] for w in words for k in (4, 5, 6, len(w))}, (w[:k] for w in words for k in STEMS if k < len(w))
        counts[int(label)].update(parts if label else parts & counts[1].keys())
        kinds[int(label)].update(stems if label else (w for w in stems if w in kinds[1]))
        whole |= words if label else set()
    rate = lambda c: ((c[1] + 0.5) / (n[1] + 1), (c[0] + 0.5) / (n[0] + 1))
    telling = lambda c, least: (r := rate(c))[0] > least * r[1]
    score, least_docs = {}, max(min(5, max(2, n[1] // 6)), n[1] // 60)
    for w, c in counts[1].items():
        pair = (counts[0][w], c)
        stem = w in whole and any(kinds[1][w[:k]] >= STEM_WORDS and telling((kinds[0][w[:k]], kinds[1][w[:k]]), STEM_TELLING) for k in STEMS)
        if (c >= least_docs and telling(pair, TELLING)) or (stem and c > pair[0]):
            p, q = rate(pair)
            score[w] = (p - q) / np.sqrt(q + 0.01)
    out: list[str] = []
    for w in sorted(score, key=lambda w: (-score[w], -len(w), w))[: 16 * most]:
        if len(out) < most and (encode([w]) != GAP).sum() >= 3:
            if not out or max(Kernel(out).rows([w])[0].max(), Kernel([w]).rows(out).max()) < 0.9:
                out.append(w)
    return out


def fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge) by accelerated gradient steps; y is +1 or -1."""
    w, b = np.zeros(x.shape[1]), 0.0
    pace = 1 / (2 * (weight[:, None] * x * x).sum() + 2 * weight.sum() + penalty)
    pw, pb = w.copy(), b
    for t in range(1, steps + 1):
        vw, vb = w + (t - 1) / (t + 2) * (w - pw), b + (t - 1) / (t + 2) * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * weight * y
        pw, pb = w, b
        w, b = vw + pace * (2 * (x.T @ slack) - penalty * vw), vb + pace * 2 * slack.sum()
    return w, b


def fit_curve(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, with smoothed targets."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        r, g = p * (1 - p) + 1e-9, p - target
        h = np.array([[(r * f * f).sum() + 1e-3, (r * f).sum()], [(r * f).sum(), r.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * f).sum() + 1e-3 * a, g.sum()])
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def train(texts: list[str], toxic: np.ndarray) -> Machine | None:
    """A machine for documents with labels."""
    if not len(texts) or toxic.all() or not toxic.any():
        return None
    landmarks = choose_landmarks(texts, toxic)
    if not landmarks:
        return None
    kernel, units = Kernel(landmarks), Units()
    ids, sentence, owner = units.split(texts)
    text = owner[sentence]
    x = kernel.of(units.names)
    gram = np.maximum(kernel.rows(landmarks), kernel.rows(landmarks).T)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-2 * np.eye(len(landmarks)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    near = x.max(axis=1)
    # units without any kernel are one point (the last row), which counts as often as all of them
    some = np.flatnonzero(near)
    row = np.full(len(near), len(some))
    row[some] = np.arange(len(some))
    x, near = np.concatenate([x[some], np.zeros((1, len(landmarks)), np.float32)]), np.append(near[some], 0)
    z, ids = x @ root, row[ids]
    clean = np.unique(ids[~toxic[text]] * np.int64(len(texts)) + text[~toxic[text]]) // len(texts)  # once per document
    negative, often = np.unique(clean, return_counts=True)
    value = x.sum(axis=1)
    for _ in range(4):
        best = highest(value[ids], text, len(texts))
        top = np.flatnonzero((value[ids] == best[text]) & toxic[text])
        positive = ids[top[np.unique(text[top], return_index=True)[1]]]  # one unit per toxic document
        positive = positive[near[positive] >= SURE]  # without one that is near a landmark, there is no witness
        if not len(positive):
            return None
        pick = np.concatenate([positive, negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.concatenate([np.full(len(positive), 1 / len(positive)), often * (near[negative] ** 2 + 1e-5)])
        weight[len(positive) :] /= weight[len(positive) :].sum()
        w, b = fit_line(z[pick], y, weight)
        value = z @ w + b
    weights, bias = (root @ w).astype(np.float32), min(0.0, float(b) + 1)
    slope, offset = fit_curve(top_sum(x @ weights + np.float32(bias), ids, text, len(texts)), toxic)
    return Machine(landmarks, weights, bias, slope, offset)


def highest(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, owner, values)
    return out


def top_sum(values: np.ndarray, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Of each text, the sum of the TOP highest positive values of its distinct units."""
    some = np.flatnonzero(values[ids] > 0)
    pairs = np.unique(owner[some] * np.int64(len(values)) + ids[some])
    owner, value = pairs // len(values), values[pairs % len(values)]
    order = np.lexsort((-value, owner))
    owner, value = owner[order], value[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    out = np.zeros(n)
    np.add.at(out, owner[place < TOP], value[place < TOP])
    return out


class Scorer:
    """Scores texts; remembers the decision values of units."""

    def __init__(self, machine: Machine):
        self.machine, self.kernel, self.units = machine, Kernel(machine.landmarks), Units()
        self.values = np.empty(0, np.float32)

    def __call__(self, texts: list[str | None]) -> list[float]:
        if len(self.units.names) > CACHE:
            self.units.clear()
            self.values = self.values[:0]
        ids, sentence, owner = self.units.split(texts)
        if len(self.values) < len(self.units.names):
            self.values = np.concatenate([self.values, self.kernel.of(self.units.names[len(self.values) :]) @ self.machine.weights + np.float32(self.machine.bias)])
        f = self.machine.slope * top_sum(self.values, ids, owner[sentence], len(texts)) + self.machine.offset
        return (1 / (1 + np.exp(-np.clip(f, -30, 30)))).tolist()


def learn(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """Train on a bounded sample of labelled documents that aren't held out."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64("doc_id", F.lit(SEED))
    picked = [r for c, most in ((1, POSITIVES), (0, NEGATIVES)) for r in known.where(F.col("toxic") == c).orderBy(place, "doc_id").limit(most).collect()]
    if not picked:
        return None
    sample = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in sorted(picked)], "doc_id long, toxic int"))
    texts = docs.where("text is not null").select("doc_id", "text").join(sample, "doc_id")
    # both classes share the characters; sums of lengths need no text
    lengths = sorted((r["place"], r["doc_id"], r["toxic"], r["n"]) for r in texts.groupBy("doc_id", "toxic").agg(F.sum(F.length("text")).alias("n")).withColumn("place", place).collect())
    used, within = [0, 0], []
    for _, doc_id, toxic, n in lengths:
        used[toxic] += n
        if used[toxic] <= CHARACTERS // 2 or used[toxic] == n:
            within.append((doc_id,))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(within, "doc_id long"))
    rows = sorted(texts.join(chosen, "doc_id").select("doc_id", "toxic", "text").collect()) if within else []
    return train([r["text"] for r in rows], np.array([r["toxic"] == 1 for r in rows], bool))


def score_toxicity(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted."""
    key = machine.digest() if machine else ""  # tasks unpickle copies of the machine, which share a worker's scorer

    def block(rows: dict) -> dict:
        if machine is None:
            scores = [0.0] * len(rows["doc_id"])
        else:
            use_cache("scorers", _scorers.clear)
            if key not in _scorers:
                _scorers.clear()
                _scorers[key] = Scorer(machine)
            scores = _scorers[key](rows["text"])
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    return map_rows(docs.select("doc_id", held_out().alias("held_out"), "text"), block, schema, 2 << 20)


_scorers: dict[str, Scorer] = {}


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, learn(docs, labels))
