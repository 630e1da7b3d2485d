"""Language of texts by a bidirectional gated recurrent network over bytes, trained here in numpy.

Two gated recurrent layers read segments of SEGMENT bytes, one from each end; a softmax over both states labels every
byte, and a document's probabilities are the mean over all its bytes. Training is backpropagation through time with
Adam on random segments of at most PER_LANGUAGE documents of each language that has a row to learn from, chosen by a
hash of doc_id among the rows that may be learned from; of texts over PIECES * PIECE characters, pieces drawn from the
whole text are learned from. Weights are a few kilobytes; inference steps through thousands
of segments at once.

Nulls and edge cases: null texts and texts without a letter are ``und`` with score 0; texts of any length are read
whole; rows without lang are not learned from; without any row to learn from every text is ``und``; rows without doc_id
are not held out; repeated rows are labelled one by one; an empty table gives an empty result; columns other than
doc_id, text and lang are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows

HIDDEN, SEGMENT, BATCH = 8, 128, 1024
#: Languages that segments of a full batch are labelled with; with more, a batch has fewer segments.
FULL_BATCH = 64
PER_LANGUAGE, SEED = 300, 5
#: Of a long document to learn from, so many pieces of so many characters are used.
PIECES, PIECE = 40, 200
STEPS, TRAIN_BATCH, TRAIN_LENGTH, RATE = 260, 512, 48, 0.02


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Network:
    """Per direction: inputs (3H x 256), recurrent (3H x H), bias of the candidate (H); output (L x 2H) and its bias.

    Rows of the first two thirds are the update and reset gates, halved so that a gate is 0.5 + 0.5 tanh.
    """

    languages: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    bias: list[np.ndarray]
    output: np.ndarray
    output_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> Network:
        h, f = HIDDEN, np.float32
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(f)
        return cls(languages, [draw(3 * h, 256) for _ in range(2)], [draw(3 * h, h) for _ in range(2)], [np.zeros((h, 1), f) for _ in range(2)], draw(len(languages), 2 * h), np.zeros((len(languages), 1), f))

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, *self.bias, self.output, self.output_bias]

    def states(self, data: np.ndarray, d: int, keep: list | None = None) -> np.ndarray:
        """States (T x H x B) of direction d over bytes (T x B)."""
        h, (steps, width) = HIDDEN, data.shape
        out = np.empty((steps, h, width), np.float32)
        state = np.zeros((h, width), np.float32)
        gates, hidden = np.empty((3 * h, width), np.float32), np.empty((3 * h, width), np.float32)
        w, u, b = self.inputs[d], self.recurrent[d], self.bias[d]
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            if keep is not None:
                gates, hidden = np.empty_like(gates), np.empty_like(hidden)
            np.take(w, data[t], axis=1, out=gates, mode="clip")
            np.matmul(u, state, out=hidden)
            zr = gates[: 2 * h]
            zr += hidden[: 2 * h]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            inner = hidden[2 * h :]
            inner += b
            n = gates[2 * h :]
            before = inner * gates[h : 2 * h]
            n += before
            np.tanh(n, out=n)
            previous = state
            state = state - n
            state *= gates[:h]
            state += n
            out[t] = state
            if keep is not None:
                keep.append((t, previous, gates, inner))
        return out

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """Label probabilities (T x L x B) of bytes (T x B)."""
        both = self.states(data, 0), self.states(data, 1)
        logits = np.matmul(self.output[:, :HIDDEN], both[0])
        logits += np.matmul(self.output[:, HIDDEN:], both[1])
        logits += self.output_bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, data: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over bytes, and its gradients in the order of parameters()."""
        h, (steps, width) = HIDDEN, data.shape
        kept: list[list] = [[], []]
        both = [self.states(data, d, kept[d]) for d in (0, 1)]
        logits = np.matmul(self.output[:, :h], both[0]) + np.matmul(self.output[:, h:], both[1]) + self.output_bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        at = np.arange(width)
        loss = float(-np.log(p[:, label, at] + 1e-9).mean())
        p[:, label, at] -= 1
        p /= steps * width
        d_output = np.concatenate([np.einsum("tlb,thb->lh", p, s, optimize=True) for s in both], axis=1)
        d_bias = p.sum(axis=(0, 2))[:, None]
        grads: list[list[np.ndarray]] = [[], [], []]
        for d in (0, 1):
            back = np.matmul(self.output[:, d * h : (d + 1) * h].T, p)
            du, db, carried = np.zeros_like(self.recurrent[d]), np.zeros_like(self.bias[d]), np.zeros((h, width), np.float32)
            dw = np.zeros((256, 3 * h), np.float32)
            for t, previous, gates, inner in reversed(kept[d]):
                z, r, n = gates[:h], gates[h : 2 * h], gates[2 * h :]
                ds = back[t] + carried
                dn = ds * (1 - z) * (1 - n * n)
                da = np.concatenate([ds * (previous - n) * z * (1 - z) * 2, dn * inner * r * (1 - r) * 2, dn])
                dh = da.copy()
                dh[2 * h :] *= r
                du += dh @ previous.T
                db += dh[2 * h :].sum(axis=1, keepdims=True)
                carried = ds * z + self.recurrent[d].T @ dh
                order = np.argsort(data[t], kind="stable")
                values, first = np.unique(data[t][order], return_index=True)
                dw[values] += np.add.reduceat(da.T[order], first, axis=0)
            grads[0].append(dw.T)
            grads[1].append(du)
            grads[2].append(db)
        return loss, [*grads[0], *grads[1], *grads[2], d_output, d_bias]


def train(texts: list[str], langs: list[str], seed: int = SEED, steps: int = STEPS) -> Network | None:
    """A network for the languages of some texts; each batch has every language alike."""
    raws: dict[str, list[bytes]] = {}
    for text, lang in zip(texts, langs):
        raw = text.encode("utf-8", "surrogatepass")
        if raw:
            raws.setdefault(lang, []).append(raw)
    if not raws:
        return None
    rng = np.random.default_rng(seed)
    names = sorted(raws)
    network = Network.fresh(names, rng)
    ends = {n: np.cumsum([len(r) for r in raws[n]]) for n in names}
    flat = {n: np.frombuffer(b"".join(raws[n]) + b" " * TRAIN_LENGTH, np.uint8) for n in names}
    first, second = ([np.zeros_like(p) for p in network.parameters()] for _ in range(2))
    for step in range(1, steps + 1):
        label = rng.integers(0, len(names), TRAIN_BATCH)
        data = np.empty((TRAIN_LENGTH, TRAIN_BATCH), np.uint8)
        for i, n in enumerate(names):
            own = np.flatnonzero(label == i)
            start = rng.integers(0, ends[n][-1], len(own))
            data[:, own] = flat[n][start[None, :] + np.arange(TRAIN_LENGTH)[:, None]]
        _, grads = network.gradients(data, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(network.parameters(), grads, first, second):
            g = g * min(1, 1 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return network


def classify(network: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if network else []
    if not rows:
        return out
    raws = [texts[i].encode("utf-8", "surrogatepass") for i in rows]
    sizes = np.array([len(r) for r in raws])
    counts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(raws)), counts)
    data = np.frombuffer(b"".join(r.ljust(int(c) * SEGMENT, b" ") for r, c in zip(raws, counts)), np.uint8).reshape(-1, SEGMENT)
    length = np.full(len(owner), SEGMENT)
    length[np.cumsum(counts) - 1] = sizes - (counts - 1) * SEGMENT
    sums = np.empty((len(owner), len(network.languages)))
    batch = max(1, min(BATCH, BATCH * FULL_BATCH // len(network.languages)))
    for a in range(0, len(owner), batch):
        part = np.ascontiguousarray(data[a : a + batch].T)
        p = network.probabilities(part)
        p *= (np.arange(SEGMENT)[:, None] < length[a : a + batch])[:, None, :]
        sums[a : a + batch] = p.sum(axis=0).T
    pooled = np.add.reduceat(sums, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0) / sizes[:, None]
    for i, best, p in zip(rows, pooled.argmax(axis=1).tolist(), pooled.max(axis=1).tolist()):
        out[i] = network.languages[best], min(1.0, max(0.0, p))
    return out


def sampled_pieces(text: str) -> Column:
    """A text of up to PIECES * PIECE characters whole; of a longer one, so many pieces from all over it, drawn by hash."""
    n = F.length(text)
    starts = F.transform(F.sequence(F.lit(1), F.lit(PIECES)), lambda i: (F.pmod(F.xxhash64("doc_id", i, F.lit(SEED)), n - PIECE + 1) + 1).cast("int"))
    pieces = F.transform(starts, lambda a: F.substring(F.col(text), a, F.lit(PIECE)))
    return F.when(n > PIECES * PIECE, F.array_join(pieces, "\n")).otherwise(F.col(text))


def learn(docs: DataFrame) -> Network | None:
    """Train on a bounded sample of the rows that aren't held out."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return None
    place = F.xxhash64("doc_id", F.lit(SEED))
    # the smallest hashes of all languages in one pass: twice PER_LANGUAGE rows are expected below a language's bound
    bounds = [(name, min((1 << 63) - 1, -(1 << 63) + (2 * PER_LANGUAGE << 64) // n)) for name, n in counts.items()]
    bound = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    first: dict[str, list[tuple[int, int]]] = {name: [] for name in counts}
    for r in known.join(bound, "lang").select("lang", place.alias("place"), "doc_id", "bound").where("place <= bound").collect():
        first[r["lang"]].append((r["place"], r["doc_id"]))
    ids: set[int] = set()
    for name, n in counts.items():
        if len(first[name]) < min(PER_LANGUAGE, n):
            first[name] = [tuple(r) for r in known.where(F.col("lang") == name).select(place.alias("place"), "doc_id").orderBy("place", "doc_id").limit(PER_LANGUAGE).collect()]
        ids |= {i for _, i in sorted(first[name])[:PER_LANGUAGE]}
    wanted = sorted(ids)  # at most PER_LANGUAGE a language
    if not wanted:
        return None
    picked = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in wanted], "doc_id long"))
    rows = sorted(known.join(picked, "doc_id").where(F.col("text").isNotNull()).select("doc_id", "lang", sampled_pieces("text").alias("text")).collect())
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred and score."""
    network = network or learn(docs)

    def block(rows: dict) -> dict:
        found = classify(network, rows["text"])
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return map_rows(docs.select("doc_id", held_out().alias("held_out"), "text"), block, schema, 1 << 20)
