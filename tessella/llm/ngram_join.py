"""Jaccard self-join of word shingle sets by token-combination prefixes.

Tokens are the hashes of a document's distinct shingles. At a similarity of T / 100 or more, a document of n tokens lacks
at most (100 - T) n / 100 of its own in any partner.

1. Documents with equal sets collapse to the one with the smallest doc_id.
2. Where too many tokens occur in no other document, there can be no partner. Those of a third of all tokens (by hash) are
   counted first: that takes out most documents for a third of the work, and takes nothing away from the others, as
   tokens are only ever looked for among documents that may still have a partner.
3. What is left is counted in full. Tokens are ordered from rare to frequent, and are of class 1 to RARE documents, of
   class 2 to COMMON, of class 3 beyond. Classes 2 and 3 are dealt by hash into groups. Two partners share, within their
   prefixes, either a class 1 token, or two tokens of a class 2 group, or three of a class 3 group, where a prefix is as
   long as needed for its units (class 1 tokens, and tokens of a group beyond the first one or two) to outnumber the
   tokens that may be lacking. So prefixes are extended by a token or two a group, and combinations are indexed for
   frequent classes. The number of groups follows the document's size, which keeps combinations in proportion to it; a
   document near the next size also takes the groups of that.
4. Tokens that nobody else has also bound the sizes of partners: with a tokens shared with anyone, a document of n has
   partners of at most (100 + T) a / T - n tokens. One of two partners (the smaller) has a bound of at least its own
   size; documents of an indexed key are candidates with its first such document, and others only if one is small enough.
5. Connected candidates form clusters, whose sets are shipped once and compared exactly, by postings within a task. Large
   clusters are split into chunks with common pivots, and what isn't in a cluster's largest group is compared block
   against block, as in minhash; no link is lost and no pair of an index key is ever emitted.

Nulls and edge cases: null, empty and blank texts have an empty set and are linked with nothing; texts of fewer words than
a shingle have one, their whole sequence; repeated rows count as one document and are all returned; rows that share a
doc_id but not a set are documents of their own; rows without doc_id are returned unlinked; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessella.llm.common import blocks, dealt_anew, discard, spark_schema, staged
from tessella.llm.hashing import MIX, mixed
from tessella.llm.minhash import CHUNK, EDGES, _edges, _grouped, against_each_other, chunk_numbers, components, documents_of, with_chunks
from tessella.llm.shingling import shingle_sets

#: A link is a similarity of NUMERATOR / 100 or more.
NUMERATOR = 80
#: Documents of a token: single tokens are indexed to RARE, pairs to COMMON, triples beyond.
RARE, COMMON = 16, 256
#: Below so many tokens, all are indexed as single ones; a size class of 2**s tokens has 2**s / PER_GROUP groups of each frequent class.
SMALL, PER_GROUP = 64, 12
#: Of 64-bit hashes, those below are counted first.
FIRST = (1 << 64) // 3
BLOCK_BYTES = 2 << 20


def lacking(n, numerator: int):
    """How many of n tokens a partner may lack at most."""
    return (100 - numerator) * n // 100


def set_digests(tokens: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """128 bits of each of some sets that lie end to end; None for empty ones."""
    full = np.flatnonzero(n)
    out = np.zeros((len(n), 2), np.uint64)
    if len(full):
        first = (np.cumsum(n) - n)[full]
        out[full, 0] = np.bitwise_xor.reduceat(mixed(tokens), first)
        out[full, 1] = np.add.reduceat(tokens, first)
    return [d.tobytes() if k else None for d, k in zip(out, n)]


def set_numbers(digests: list[bytes | None]) -> np.ndarray:
    """64 bits of digests, as Spark's xxhash64 has them."""
    return np.array([xxh64_intdigest(d or b"", 42) for d in digests], np.uint64).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles and set_hash (null for empty sets)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, BLOCK_BYTES):
                tokens, n = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(n, pa.int64()), pa.array(set_digests(tokens, n), pa.binary())], schema=schema)

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, spark_schema(schema))


TOKENS = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32())])
SETS = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("set", pa.binary())])


def _first_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) to the tokens below FIRST, with the number and the size of their sets; equal sets have equal numbers."""
    for batch in batches:
        for part in blocks(batch, BLOCK_BYTES):
            tokens, n = shingle_sets(part.column("text"))
            node = np.repeat(set_numbers(set_digests(tokens, n)), n)
            below = tokens < np.uint64(FIRST)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[below].view(np.int64)), pa.array(node[below]), pa.array(np.repeat(n, n)[below].astype(np.int32))], schema=TOKENS)


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, node) to sets."""
    for batch in batches:
        for part in blocks(batch, BLOCK_BYTES):
            tokens, n = shingle_sets(part.column("text"))
            sets = [s.tobytes() for s in np.split(tokens, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(n, pa.int32()), pa.array(sets, pa.binary())], schema=SETS)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SETS to tokens."""
    for batch in batches:
        for part in blocks(batch, BLOCK_BYTES):
            n = part.column("n").to_numpy()
            tokens = np.frombuffer(b"".join(part.column("set").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(part.column("node").to_numpy(), n)), pa.array(np.repeat(n, n))], schema=TOKENS)


def combinations(tokens: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all combinations of size (2 or 3) tokens of a group; tokens of a group stand together, in the common order."""
    found = [np.empty(0, np.uint64)]
    _, counts = np.unique(group, return_counts=True)
    most = int(counts.max(initial=0))
    for d in range(1, most):
        one = np.flatnonzero(group[:-d] == group[d:])
        if size == 2:
            found.append(mixed(mixed(tokens[one] * MIX + np.uint64(2)) + tokens[one + d]))
            continue
        for e in range(d + 1, most):
            if len(group) > e:
                a = one[one + e < len(group)]
                a = a[group[a] == group[a + e]]
                found.append(mixed(mixed(mixed(tokens[a] * MIX + np.uint64(3)) + tokens[a + d]) * MIX + tokens[a + e]))
    return np.concatenate(found)


def prefix_keys(tokens: np.ndarray, df: np.ndarray, n: int, numerator: int, rare: int = RARE, common: int = COMMON) -> np.ndarray:
    """Index keys of a document of n tokens; tokens are those that others have too, from rare to frequent, df their documents."""
    need = lacking(n, numerator) + 1 - (n - len(tokens))
    if need <= 0:
        return np.empty(0, np.uint64)
    size = n.bit_length() - 1
    sizes = [size, size + 1] if 100 * n >= numerator << (size + 1) else [size]
    found = []
    for s in sizes:
        small = 1 << s < SMALL
        kind = np.ones(len(tokens), np.int64) if small else 1 + (df > rare) + (df > common)
        groups = max(1, (1 << s) // PER_GROUP)
        group = np.where(kind == 1, 0, (mixed(tokens) % np.uint64(groups)).astype(np.int64) * 4 + kind)
        order = np.argsort(group, kind="stable")
        place = np.empty(len(tokens), np.int64)
        start = np.flatnonzero(np.diff(group[order], prepend=-1))
        place[order] = np.arange(len(tokens)) - np.repeat(start, np.diff(start, append=len(tokens)))
        units = np.cumsum((kind == 1) | (place >= kind - 1))
        cut = int(np.searchsorted(units, need)) + 1
        order = order[order < cut]
        for k in (1, 2, 3):
            of = order[kind[order] == k]
            found.append(mixed(tokens[of] + np.uint64(1)) if k == 1 else combinations(tokens[of], group[of], k))
    return np.unique(np.concatenate(found))


KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("most", pa.int64())])


def _keyed(batches: Iterator[pa.RecordBatch], numerator: int, rare: int, common: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, df, token, n) in order of the first three, to the keys of each node and the size of its largest possible partner."""

    def keys(rows: np.ndarray) -> pa.RecordBatch:
        node, n, tokens = int(rows[0, 0]), int(rows[3, 0]), rows[2].copy().view(np.uint64)
        found = prefix_keys(tokens, rows[1], n, numerator, rare, common)
        most = (100 + numerator) * len(tokens) // numerator - n
        columns = [pa.array(found.view(np.int64)), pa.array(np.full(len(found), node)), pa.array(np.full(len(found), n, np.int32)), pa.array(np.full(len(found), most))]
        return pa.RecordBatch.from_arrays(columns, schema=KEYS)

    held = np.empty((4, 0), np.int64)
    for batch in batches:
        rows = np.array([batch.column(c).to_numpy() for c in ("node", "df", "token", "n")], np.int64)
        rows = np.concatenate([held, rows], axis=1)
        stops = (np.flatnonzero(np.diff(rows[0])) + 1).tolist()
        for a, b in zip([0, *stops], stops):
            yield keys(rows[:, a:b])
        held = rows[:, stops[-1] if stops else 0 :]
    if held.shape[1]:
        yield keys(held)


class Postings:
    """Sets in one task, with the places of each token; group joins linked ones."""

    def __init__(self, ids: list[int], sets: list[bytes], numerator: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.numerator = np.array(ids, np.int64)[order], numerator
        raw = [np.frombuffer(sets[i], np.uint64) for i in order]
        self.sizes = np.array([len(s) for s in raw])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        values, self.flat = np.unique(np.concatenate(raw), return_inverse=True)
        self.owner = np.repeat(np.arange(len(raw)), self.sizes)[np.argsort(self.flat, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.flat, minlength=len(values)))])
        self.group = np.arange(len(raw))

    def links(self, i: int) -> np.ndarray:
        """Whether each document links with the i-th."""
        own = self.flat[self.starts[i] : self.starts[i + 1]]
        many = self.first[own + 1] - self.first[own]
        place = np.arange(many.sum()) + np.repeat(self.first[own] - np.cumsum(many) + many, many)
        common = np.bincount(self.owner[place], minlength=len(self.ids))
        return 100 * common >= self.numerator * (self.sizes[i] + self.sizes - common)

    def join(self, i: int, among: np.ndarray) -> list[tuple[int, int]]:
        """Unite the i-th document's group with those of its links among some; returns a link for each group that was joined."""
        others = np.flatnonzero(self.links(i) & among & (self.group != self.group[i]))
        names, one = np.unique(self.group[others], return_index=True)
        if not len(names):
            return []
        merged = np.isin(self.group, [*names, self.group[i]])
        self.group[merged] = self.group[merged].min()
        return [(int(self.ids[i]), int(self.ids[k])) for k in others[one]]

    def settle(self) -> None:
        """Find all groups; every document outside the largest one is compared with all."""
        done, everyone = np.zeros(len(self.ids), bool), np.ones(len(self.ids), bool)
        while True:
            counts = np.bincount(self.group, minlength=len(self.ids))
            open_ = np.flatnonzero(~done & (self.group != np.argmax(counts))) if done.any() else np.arange(len(self.ids))
            if not len(open_) or counts.max() == len(self.ids):
                return
            done[open_[0]] = True
            self.join(int(open_[0]), everyone)


def _chunk_groups(batches: Iterator[pa.RecordBatch], numerator: int) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, chunk, node, set) in order of the first two: a link from each node to its group's first."""
    for held in _grouped(batches, (0, 1)):
        if len(held) > 1:
            sets = Postings([r[2] for r in held], [r[3] for r in held], numerator)
            sets.settle()
            yield _edges([(int(sets.ids[i]), int(sets.ids[g])) for i, g in enumerate(sets.group) if i != g])


def _block_links(batches: Iterator[pa.RecordBatch], numerator: int) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, left block, right block, on the left, node, group, size, set): links between the sides that unite two groups."""
    for held in _grouped(batches, (0, 1, 2)):
        group, left = {r[4]: r[5] for r in held}, {r[4] for r in held if r[3]}
        sets = Postings([r[4] for r in held], [r[7] for r in held], numerator)
        sets.group = np.unique([group[i] for i in sets.ids.tolist()], return_inverse=True)[1]
        on_left = np.isin(sets.ids, np.array(list(left), np.int64))
        right = on_left if held[0][1] == held[0][2] else ~on_left
        pairs = [p for i in np.flatnonzero(on_left) if right.any() and (sets.group != sets.group[i]).any() for p in sets.join(int(i), right)]
        if pairs:
            yield _edges(pairs)


def possible(docs: DataFrame, sets: DataFrame, numerator: int) -> DataFrame:
    """node, n and set of the distinct sets of which not too many tokens are nobody else's, judged by the tokens below FIRST.

    Tokens are counted under a number of their set, so equal sets count once and no text is joined for it. The texts of
    what is left are merged with it, as it grows with the corpus.
    """
    first = docs.select("text").mapInArrow(_first_tokens, spark_schema(TOKENS))
    alone = first.groupBy("token").agg(F.min("node").alias("number"), F.max("node").alias("z"), F.max("n").alias("n")).where("number = z")
    out = alone.groupBy("number").agg(F.count(F.lit(1)).alias("alone"), F.max("n").alias("n")).where(F.col("alone") > F.expr(f"(100 - {numerator}) * n div 100")).select("number")
    numbered = sets.select("doc_id", "text_key", "node", F.xxhash64("set_hash").alias("number"))
    left = staged(numbered.join(staged(out, "alone"), "number", "left_anti").drop("number"), "possible")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return texts.join(left.hint("merge"), ["doc_id", "text_key"]).select("text", "node").mapInArrow(_packed_sets, spark_schema(SETS)).dropDuplicates(["node"])


def candidates(sets: DataFrame, numerator: int, rare: int, common: int) -> DataFrame:
    """(a, b): documents that share an index key and may link by their sizes, each with the key's first document of the kind that every link has.

    Tokens and keys are always merged with their counts, which grow with the corpus, so plans are alike at every size.
    """
    tokens = sets.mapInArrow(_unpacked, spark_schema(TOKENS))
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(dealt_anew(frequency, "token").hint("merge"), "token").select("node", "df", "token", "n")
    keyed = shared.repartition("node").sortWithinPartitions("node", "df", "token").mapInArrow(partial(_keyed, numerator=numerator, rare=rare, common=common), spark_schema(KEYS))
    keyed = staged(keyed, "keys")
    strong = F.col("most") >= F.col("n")
    heads = keyed.groupBy("key").agg(F.min(F.when(strong, F.col("node"))).alias("head"), F.min(F.when(strong, F.col("n"))).alias("least"), F.min("node").alias("a"), F.max("node").alias("z"))
    heads = heads.where("head is not null and a <> z").select("key", "head", "least")
    pairs = keyed.join(dealt_anew(heads, "key").hint("merge"), "key").where(strong | (F.col("least") <= F.col("most")))
    out = staged(pairs.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "candidates")
    discard(keyed)
    return out


def linked_groups(docs: DataFrame, full: DataFrame, sets: DataFrame, numerator: int, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """(node, root) for the nodes of distinct sets that are linked to others."""
    packed = staged(possible(docs, sets, numerator), "token-sets")
    clusters = components(candidates(packed, numerator, rare, common)).join(packed.select("node", F.col("n").cast("long").alias("n_shingles")), "node")
    members = staged(with_chunks(staged(clusters, "clusters")), "members")
    stored = staged(chunk_numbers(members).join(packed, "node").select("node", "root", "chunks", "chunk", F.col("n").cast("long").alias("size"), "set"), "cluster-sets")
    discard(packed)
    rows = stored.select("root", F.explode("chunk").alias("part"), "node", "set").repartition("root", "part").sortWithinPartitions("root", "part")
    links = staged(rows.mapInArrow(partial(_chunk_groups, numerator=numerator), spark_schema(EDGES)), "links")
    groups = components(links)
    split = stored.where("chunks > 1")
    if split.isEmpty():
        return groups
    placed = split.select("root", "node", "size", "set").join(groups.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    sizes = placed.groupBy("root", "group").count()
    largest = sizes.groupBy("root").agg(F.max_by("group", F.struct("count", "group")).alias("largest"))
    placed = staged(placed.join(dealt_anew(largest, "root"), "root").withColumn("main", F.col("group") == F.col("largest")).drop("largest"), "split")
    pairs = against_each_other(placed, CHUNK, ("set",)).mapInArrow(partial(_block_links, numerator=numerator), spark_schema(EDGES))
    return components(links.unionByName(staged(pairs, "links")))


def near_duplicates(docs: DataFrame, numerator: int = NUMERATOR, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id; numerator (50 to 100) is the least similarity in hundredths."""
    if not 50 <= numerator <= 100:
        raise ValueError("prefixes are long enough for similarities of 50 to 100 hundredths")
    base, of_set = documents_of(docs, numerator, sketches, partial(linked_groups, rare=rare, common=common))
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("first.doc_id")), "doc_id")
    return base.join(staged(of_set, "components"), "set_hash", "left").select("doc_id", "n_shingles", component.alias("component_id"))
