"""Near-duplicate groups by b-bit MinHash, with every link confirmed on full shingle sets.

1. One pass over the texts gives each document's shingle set as hashes, its digest, the minima of HASHES hash
   functions reduced to b-bit codes in a packed signature, and BANDS keys of ROWS minima each.
2. Documents with equal sets collapse to the one with the smallest doc_id. At a similarity of 0.85 a pair misses all
   24 bands of 5 with a probability of 8e-7, at 0.8 with 7e-5.
3. Bucket-mates form candidate clusters: each member links to its bucket's smallest doc_id (one row per member, never
   pairs), and connected components join buckets that share members.
4. Each cluster's sets are shipped once. A cluster of more than CHUNK members, or more than CHUNK_BYTES of sets, is split
   by hash into chunks that all contain the same PIVOTS members. In a chunk, documents are compared by bit counts of
   their signatures, corrected for collisions; pairs within MARGIN of the threshold are confirmed on their sets.
   Documents that are already connected need no further comparison, and every document outside the chunk's largest
   group is compared with all others, so a chunk's groups are exact.
5. Of split clusters, members outside the largest group (the open ones) are compared with each other and with the
   largest group, block against block. Signatures go first, in blocks of SIGNATURES members: members that no member of
   another group comes near are left out. The sets of the others follow in blocks of CHUNK members or CHUNK_BYTES. A
   task holds two blocks, whatever the cluster's size, and no link between different chunks is lost.

Nulls and edge cases: null, empty and blank texts have an empty set and are linked with nothing; texts shorter than a
shingle have one, their whole sequence; repeated rows (equal doc_id and set) count as one document in links and are all
returned; rows that share a doc_id but not a set are documents of their own; rows without doc_id are returned as kept
and unlinked; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import dealt_anew, fresh, map_rows, spark_schema, staged
from tessella.llm.hashing import MIX, SEED, lower_words, mixed, word_hashes

#: A link is a similarity of NUMERATOR / DENOMINATOR or more, unless a caller gives another numerator.
WORDS, NUMERATOR, DENOMINATOR = 5, 85, 100
BANDS, ROWS, HASHES, BITS = 24, 5, 128, 4
CHUNK, CHUNK_BYTES, PIVOTS, MARGIN = 512, 16 << 20, 8, 0.16
#: Members of a block of signatures; rows of a block that are compared at once.
SIGNATURES, SLAB = 4096, 64

_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(words) - size + 1)
    out = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for i in range(min(size, len(words))):
        out = mixed(out * MIX + h[i : i + n])
    return np.unique(out)


def signature(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minima of non-empty sets: band keys (n x BANDS) and packed b-bit codes (n x HASHES * BITS / 8)."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values = np.concatenate(sets)
    minima = np.empty((len(sets), HASHES), np.uint64)
    for i, f in enumerate(FACTORS):
        minima[:, i] = np.minimum.reduceat(values * f, starts)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(ROWS):
            key = mixed(key * MIX + minima[:, b * ROWS + r])
        keys[:, b] = key
    codes = (mixed(minima) >> np.uint64(64 - BITS)).astype(np.uint8)
    return keys, codes[:, 0::2] << 4 | codes[:, 1::2]


#: Equal codes in a byte of two codes, by the byte's difference.
EQUAL = np.array([(x >> BITS == 0) + (x & (1 << BITS) - 1 == 0) for x in range(256)], np.uint8)


def estimate(some: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity (some x many) by equal b-bit codes, corrected for codes that are equal by chance."""
    equal = EQUAL[some[:, None, :] ^ many[None, :, :]].sum(axis=2, dtype=np.int16)
    chance = 1 / (1 << BITS)
    return (equal / HASHES - chance) / (1 - chance)


def may_link(codes: np.ndarray, sizes: np.ndarray, rows: np.ndarray, cols: np.ndarray, numerator: int) -> np.ndarray:
    """Which pairs (rows x cols) are near enough by their signatures, and of sizes that allow a link."""
    a, b = sizes[rows][:, None], sizes[cols][None, :]
    near = DENOMINATOR * np.minimum(a, b) >= numerator * np.maximum(a, b)
    some = np.flatnonzero(near.any(axis=1))
    if len(some):
        near[some] &= estimate(codes[rows[some]], codes[cols]) >= numerator / DENOMINATOR - MARGIN
    return near


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, set_hash (null for empty sets) and bands."""

    def block(rows: dict) -> dict:
        sets = [shingles(t) for t in rows["text"]]
        full = [i for i, s in enumerate(sets) if len(s)]
        digest: list[bytes | None] = [None] * len(sets)
        bands: list[list | None] = [None] * len(sets)
        at = 0
        while at < len(full):
            end, total = at, 0
            while end < len(full) and (end == at or total + len(sets[full[end]]) <= 1 << 16):
                total += len(sets[full[end]])
                end += 1
            keys, _ = signature([sets[i] for i in full[at:end]])
            for j, i in enumerate(full[at:end]):
                s = sets[i]
                digest[i] = np.array([np.bitwise_xor.reduce(mixed(s)), s.sum(dtype=np.uint64)], np.uint64).tobytes()
                bands[i] = keys[j].view(np.int64).tolist()
            at = end
        return {"doc_id": rows["doc_id"], "text_key": rows["text_key"], "n_shingles": [len(s) for s in sets], "set_hash": digest, "bands": bands}

    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64()))])
    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), block, schema, 8 << 20)


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root): for the nodes of the edges (a, b), the smallest node that each reaches.

    Alternates joining each node to the smallest neighbour (large star) and its smaller neighbours to that (small
    star); stars have one row per node, hot nodes are pre-aggregated minima, and each round is a written table.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    previous = None
    for _ in range(most):
        for large in (True, False):
            both = now.select("a", "b")
            if large:
                both = both.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            linked = both.join(dealt_anew(least, "a"), "a")
            linked = linked.where("b > a") if large else linked
            stars = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
            if not large:
                stars = stars.unionByName(least.select("a", F.col("m").alias("b")))
            now = staged(stars.where("a <> b").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class Sets:
    """Documents in one task: signatures and sets, the sets laid end to end over small integers; group joins linked ones."""

    def __init__(self, ids: list[int], packed: list[bytes], sets: list[bytes], numerator: int):
        self.numerator = numerator
        order = np.argsort(ids, kind="stable")
        self.ids = np.array(ids, np.int64)[order]
        self.codes = np.array([np.frombuffer(packed[i], np.uint8) for i in order])
        raw = [np.frombuffer(sets[i], np.uint64) for i in order]
        self.sizes = np.array([len(s) for s in raw])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        values, self.flat, counts = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
        self.seen = np.zeros(len(values), bool)
        #: Place of each shingle among those of several documents; other shingles are never common to two.
        self.place = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)
        self.group = np.arange(len(order))

    def shingles(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i + 1]]

    def common(self, rows: np.ndarray, cols: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Common shingles of the near pairs (rows x cols; other entries mean nothing): one by one, or by matrix products where that costs less."""
        width = int(self.place.max(initial=-1)) + 1
        pairs = np.argwhere(near)
        out = np.zeros(near.shape, np.float32)
        if len(pairs) * (2000 + self.sizes[cols].mean()) < width * near.size / 4:
            for a in np.unique(pairs[:, 0]):
                own = self.shingles(rows[a])
                self.seen[own] = True
                for b in np.flatnonzero(near[a]):
                    out[a, b] = np.count_nonzero(self.seen[self.shingles(cols[b])])
                self.seen[own] = False
            return out
        step = 4096
        places = [self.place[self.shingles(i)] for i in np.concatenate([rows, cols])]
        owner = np.repeat(np.arange(len(places)), [len(p) for p in places])
        flat = np.concatenate(places)
        for low in range(0, width, step):
            here = (flat >= low) & (flat < low + step)
            has = np.zeros((len(places), min(step, width - low)), np.float32)
            has[owner[here], flat[here] - low] = 1
            out += has[: len(rows)] @ has[len(rows) :].T
        return out

    def join(self, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
        """Unite the groups of linked documents, one of rows and one of cols each; returns the links that united two groups."""
        near = may_link(self.codes, self.sizes, rows, cols, self.numerator) & (self.group[rows][:, None] != self.group[cols][None, :])
        some, most = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(some):
            return []
        rows, cols, near = rows[some], cols[most], near[np.ix_(some, most)]
        common = self.common(rows, cols, near)
        linked = near & (DENOMINATOR * common >= self.numerator * (self.sizes[rows][:, None] + self.sizes[cols][None, :] - common))
        used = []
        for a, b in np.argwhere(linked):
            x, y = self.group[rows[a]], self.group[cols[b]]
            if x != y:
                self.group[self.group == max(x, y)] = min(x, y)
                used.append((int(self.ids[rows[a]]), int(self.ids[cols[b]])))
        return used

    def groups(self) -> np.ndarray:
        """The index of each document's group, exactly; every document outside the largest group is compared with all."""
        everyone, done, at_once = np.arange(len(self.ids)), np.zeros(len(self.ids), bool), 1
        while True:
            names, counts = np.unique(self.group, return_counts=True)
            open_ = np.flatnonzero(~done & (self.group != names[np.argmax(counts)])) if done.any() else everyone
            if len(names) == 1 or not len(open_):
                return self.group
            rows = open_[:at_once]
            done[rows] = True
            self.join(rows, everyone)
            at_once = min(SLAB, 2 * at_once)  # one document often joins most others, which then need no comparison


def _grouped(rows: Iterator[pa.RecordBatch], keys: tuple[int, ...]) -> Iterator[list[tuple]]:
    """Consecutive rows with equal keys."""
    held: list[tuple] = []
    for batch in rows:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and any(held[0][k] != row[k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


EDGES, NODES = pa.schema([("a", pa.int64()), ("b", pa.int64())]), pa.schema([("node", pa.int64())])


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=EDGES)


def _chunk_groups(batches: Iterator[pa.RecordBatch], numerator: int) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, chunk, node, signature, set) in order of the first two: a link from each node to its group's first."""
    for held in _grouped(batches, (0, 1)):
        sets = Sets([r[2] for r in held], [r[3] for r in held], [r[4] for r in held], numerator)
        group = sets.groups()
        yield _edges([(int(sets.ids[i]), int(sets.ids[g])) for i, g in enumerate(group)])


def _near_nodes(batches: Iterator[pa.RecordBatch], numerator: int) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, left block, right block, on the left, node, group, size, signature): nodes that are near one of another group on the other side."""
    for held in _grouped(batches, (0, 1, 2)):
        left = np.array([i for i, r in enumerate(held) if r[3]], np.int64)
        right = left if held[0][1] == held[0][2] else np.array([i for i, r in enumerate(held) if not r[3]], np.int64)
        if not len(left) or not len(right):
            continue
        codes, sizes = np.array([np.frombuffer(r[7], np.uint8) for r in held]), np.array([r[6] for r in held])
        group, found = np.array([r[5] for r in held]), np.zeros(len(held), bool)
        for a in range(0, len(left), SLAB):
            for b in range(0, len(right), 8 * SLAB):
                rows, cols = left[a : a + SLAB], right[b : b + 8 * SLAB]
                near = may_link(codes, sizes, rows, cols, numerator) & (group[rows][:, None] != group[cols][None, :])
                found[rows[near.any(axis=1)]] = True
                found[cols[near.any(axis=0)]] = True
        yield pa.RecordBatch.from_arrays([pa.array([held[i][4] for i in np.flatnonzero(found)], pa.int64())], schema=NODES)


def _block_links(batches: Iterator[pa.RecordBatch], numerator: int) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, left block, right block, on the left, node, group, size, signature, set): links between the sides that unite two groups."""
    for held in _grouped(batches, (0, 1, 2)):
        group, left = {r[4]: r[5] for r in held}, {r[4] for r in held if r[3]}
        sets = Sets([r[4] for r in held], [r[7] for r in held], [r[8] for r in held], numerator)
        sets.group = np.unique([group[i] for i in sets.ids.tolist()], return_inverse=True)[1]
        on_left = np.isin(sets.ids, np.array(list(left), np.int64))
        rows = np.flatnonzero(on_left)
        cols = rows if held[0][1] == held[0][2] else np.flatnonzero(~on_left)
        pairs = [p for a in range(0, len(rows), SLAB) if len(cols) for p in sets.join(rows[a : a + SLAB], cols)]
        if pairs:
            yield _edges(pairs)


def documents_of(docs: DataFrame, numerator: int, sketch: Callable = sketches, linker: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and for each distinct set (set_hash) the first (doc_id, text_key) of its component."""
    base = staged(sketch(docs), "sketches")
    full = base.where("set_hash is not null and doc_id is not null")
    sets = full.groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_key")).alias("rep")).select("set_hash", "rep.*")
    # a set's node is its smallest doc_id; where several sets share that, a hash
    several = sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("several"))
    node = F.when(F.col("several"), F.xxhash64("doc_id", "set_hash")).otherwise(F.col("doc_id"))
    sets = staged(sets.join(several, "doc_id", "left").select("set_hash", "doc_id", "text_key", node.alias("node")), "sets")
    roots = (linker or linked_groups)(docs, full, sets, numerator)
    placed = staged(sets.join(roots, "node", "left").select("set_hash", F.struct("doc_id", "text_key").alias("rep"), F.coalesce("root", "node").alias("root")), "placed")
    first = placed.groupBy("root").agg(F.min("rep").alias("first"))
    return base, placed.join(dealt_anew(first, "root"), "root").select("set_hash", "first")


def near_duplicates(docs: DataFrame, numerator: int = NUMERATOR) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept; numerator is the least similarity in hundredths."""
    base, of_set = documents_of(docs, numerator)
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("first.doc_id")), "doc_id")
    return base.join(staged(of_set, "components"), "set_hash", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, numerator: int = NUMERATOR) -> DataFrame:
    """docs with one row of each group, by its smallest doc_id (and text hash, where rows share a doc_id).

    Rows are judged by their own text, so rows that share a doc_id only are kept apart; of rows with equal doc_id and text
    one stays. Rows without doc_id and rows without words stay.
    """
    base, of_set = documents_of(docs, numerator)
    empty = base.where("set_hash is null and doc_id is not null").select("doc_id", "text_key").distinct().withColumn("single", F.lit(False))
    kept = staged(of_set.select("first.*").distinct().withColumn("single", F.lit(True)).unionByName(empty), "kept")
    key, single, place = (fresh(docs, name) for name in ("text_key", "single", "place"))
    kept = kept.select("doc_id", F.col("text_key").alias(key), F.col("single").alias(single))
    rows = docs.where(F.col("doc_id").isNotNull()).withColumn(key, F.xxhash64("text")).join(kept, ["doc_id", key])
    order = F.xxhash64(*(c for c, t in docs.dtypes if not t.startswith(("map", "variant"))))
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(order))).where(~F.col(single) | (F.col(place) == 1))
    return rows.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def candidate_clusters(reps: DataFrame) -> DataFrame:
    """(node, root, chunks) of the nodes that share a band key with others: their connected cluster and its number of chunks."""
    keys = reps.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("z")).where("b <> z").drop("z")
    clusters = components(keys.join(dealt_anew(shared, "key"), "key").select(F.col("node").alias("a"), "b"))
    return with_chunks(staged(clusters.join(reps.select("node", "n_shingles"), "node"), "clusters"))


def with_chunks(clusters: DataFrame) -> DataFrame:
    """(node, root, n_shingles) to (node, root, chunks), the number of chunks that a cluster is split into."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n_shingles") * 8 / CHUNK_BYTES)).cast("int")
    chunks = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n"), parts.alias("chunks")).where("n > 2 and chunks > 1").drop("n")
    return clusters.join(dealt_anew(chunks, "root"), "root", "left").select("node", "root", F.coalesce("chunks", F.lit(1)).alias("chunks"))


def chunk_numbers(members: DataFrame) -> DataFrame:
    """node, root, chunks and chunk: the chunks that a member is in, all of them for the pivots of a split cluster."""
    least = [F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(PIVOTS)]
    pivots = members.where("chunks > 1").groupBy("root").agg(F.array_distinct(F.array(*least)).alias("nodes"))
    pivots = pivots.select(F.explode("nodes").alias("node"), F.lit(True).alias("pivot"))
    own = F.array(F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("chunks")).cast("int"))
    chunk = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(own)
    return members.join(pivots, "node", "left").select("node", "root", "chunks", chunk.alias("chunk"))


def cluster_sets(docs: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """node, root, chunks, chunk, size, signature and set of the members."""
    names = ("node", "root", "chunks", "chunk")
    dealt = chunk_numbers(members).join(sets.select("node", "doc_id", "text_key"), "node")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(dealt, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])

    def block(values: dict) -> dict:
        sets = [shingles(t) for t in values["text"]]
        packed = [c.tobytes() for c in signature(sets)[1]]
        return {k: values[k] for k in names} | {"size": [len(s) for s in sets], "signature": packed, "set": [s.tobytes() for s in sets]}

    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("chunks", pa.int32()), ("chunk", pa.list_(pa.int32())), ("size", pa.int64()), ("signature", pa.binary()), ("set", pa.binary())])
    return map_rows(rows.select(*names, "text"), block, schema, 1 << 20)


def against_each_other(rows: DataFrame, members: int, payload: tuple[str, ...]) -> DataFrame:
    """The open rows (root, node, group, main, size, ...) of each cluster in blocks, each block with itself, with later ones, and with blocks of the main group.

    A block has about so many members, or CHUNK_BYTES of sets where those are shipped. Rows are (root, x, y, on_left, ...)
    in order of the first three; a row goes once to each pair of blocks that its own is in.
    """
    open_, shipped = ~F.col("main"), "set" in payload
    parts = lambda which: F.greatest(F.ceil(F.count_if(which) / members), F.ceil(F.sum(F.when(which, F.col("size") * 8)) / CHUNK_BYTES) if shipped else F.lit(0)).cast("int")
    counts = rows.groupBy("root").agg(parts(open_).alias("p"), parts(F.col("main")).alias("q")).where("p > 0")
    rows = rows.join(dealt_anew(counts, "root"), "root").withColumn("own", F.pmod(F.xxhash64("node", F.lit(SEED + 1)), F.when(open_, F.col("p")).otherwise(F.col("q"))).cast("int"))
    pair = lambda x, y, left: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(left).alias("on_left"))
    later = F.transform(F.sequence(F.col("own"), F.col("p") + F.col("q") - 1), lambda y: pair(F.col("own"), y, True))
    earlier = F.transform(F.filter(F.sequence(F.lit(0), F.col("own")), lambda x: x < F.col("own")), lambda x: pair(x, F.col("own"), False))
    main = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda x: pair(x, F.col("p") + F.col("own"), False))
    dealt = rows.withColumn("at", F.explode(F.when(open_, F.concat(later, earlier)).otherwise(main)))
    out = dealt.select("root", "at.x", "at.y", "at.on_left", "node", "group", "size", *payload)
    return out.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")


def linked_groups(docs: DataFrame, full: DataFrame, sets: DataFrame, numerator: int) -> DataFrame:
    """(node, root) for the nodes of distinct sets that are linked to others."""
    keys = ["doc_id", "set_hash", "text_key"]
    reps = staged(full.join(sets.select("node", *keys), keys).select("node", "n_shingles", "bands").dropDuplicates(["node"]), "reps")
    members = staged(candidate_clusters(reps), "members")
    stored = staged(cluster_sets(docs, sets, members), "cluster-sets")
    rows = stored.select("root", F.explode("chunk").alias("part"), "node", "signature", "set")
    links = staged(rows.repartition("root", "part").sortWithinPartitions("root", "part").mapInArrow(partial(_chunk_groups, numerator=numerator), spark_schema(EDGES)).where("a <> b"), "links")
    groups = components(links)
    split = stored.where("chunks > 1")
    if split.isEmpty():
        return groups
    placed = split.select("root", "node", "size", "signature").join(groups.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    sizes = placed.groupBy("root", "group").count()
    largest = sizes.groupBy("root").agg(F.max_by("group", F.struct("count", "group")).alias("largest"))
    placed = staged(placed.join(dealt_anew(largest, "root"), "root").withColumn("main", F.col("group") == F.col("largest")).drop("largest"), "split")
    near = against_each_other(placed, SIGNATURES, ("signature",)).mapInArrow(partial(_near_nodes, numerator=numerator), spark_schema(NODES))
    near = staged(near.distinct(), "near")
    if near.isEmpty():
        return groups
    chosen = placed.join(near, "node", "left_semi").join(stored.select("node", "set"), "node")
    blocks = against_each_other(staged(chosen, "open"), CHUNK, ("signature", "set"))
    return components(links.unionByName(staged(blocks.mapInArrow(partial(_block_links, numerator=numerator), spark_schema(EDGES)), "links")))
