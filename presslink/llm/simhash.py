"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's 64-bit fingerprint has a bit set where over half of its word-shingle hashes (XXH64,
seed 42) have it. Two fingerprints link at ``max_distance`` (4) or fewer differing bits.

*Keys.* The 64 bits are cut into three segments of 22, 21 and 21 bits. With at most 4 errors the
segment with the most has at least 2 of any 3 or more, so some pair of segments has at most 2 errors
together (pigeonhole). Each segment, as a word of the perfect binary Golay code [23, 12, 7], is decoded
to nearby codeword indices: its own codeword, and for words at distance 3 also the five codewords at
distance 4. Any two words at distance 2 or less share one of these (at most six) indices. So the pair
of indices of two segments is a key, and linked fingerprints share a key; all pairs of a key are
verified by their bit distance. For other ``max_distance`` up to 6 the segment pairs still suffice
(two smallest of three sum to at most 4, each at most 2).

*Linking.* Equal fingerprints are one node. The members of a key are linked inside a task: members
within half the distance of a pivot are a clique by the triangle inequality, so a hot key costs pivots,
not pairs; only a spanning forest leaves the task, never all pairs. Keys travel in buckets of bounded content; where a bucket is too
full, a key with more than ``GROUP_ROWS`` members is dealt as blocks, and every pair of blocks meets in one task, so no group
outgrows a task and no link is lost. Components come from label propagation with pointer jumping.

Defined cases: null or blank text has fingerprint zero and links like any other; repeated rows give
repeated output rows; a null doc_id keeps its row and never is a component's id unless all ids of the
component are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslink.llm.common import deal, mix, pack, packed_schema, store, to_buckets, unpack

SEGMENTS = ((0, 22), (22, 21), (43, 21))          # first bit, bits
PAIRS = ((0, 1), (0, 2), (1, 2))
GROUP_ROWS = 4_096                                # members of a key's block
BUCKET_ROWS = 100_000                             # keys that travel together
FEW = 16                                          # groups up to this size are compared in vectors
GENERATOR = 0b101011100011                        # fixed value: x^11+x^9+x^7+x^6+x^5+x+1 (Golay code)

# -- fingerprints ---------------------------------------------------------------------------------

def fingerprint(text: str | None, k: int = 4, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()      # ASCII case and ASCII spaces only
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, n, ones = xxhash.xxh64_intdigest, len(words) - k + 1, np.zeros(64, dtype=np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = [0, *(ends[:n - 1] + 1).tolist()]
    last = ends[k - 1:].tolist()
    for at in range(0, n, 65_536):                                       # long texts in bounded steps
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first[at:at + 65_536], last[at:at + 65_536])),
                        dtype="<u8", count=min(65_536, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, tag, fp``: one row per row of ``docs`` (fp: the 64 bits as a signed long; tag: a hash of the text)."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, k) for t in b.column(2).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["id", "tag", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text")).mapInArrow(
        run, "id long, tag long, fp long")


# -- Golay code -----------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndrome of the upper 12 bits; by syndrome the coset leader, and the five weight-4 patterns of a
    weight-3 leader (-1 elsewhere)."""
    def syndrome(x):
        x = x.copy()
        for bit in range(22, 10, -1):
            x = np.where((x >> bit) & 1, x ^ (GENERATOR << (bit - 11)), x)
        return x

    def patterns(weight):
        from itertools import combinations
        return np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], dtype=np.int64)

    upper = syndrome(np.arange(1 << 12, dtype=np.int64) << 11)       # the code is linear: upper and lower bits add
    by_syndrome = upper
    leader = np.zeros(2048, dtype=np.int64)
    for w in (1, 2, 3):
        p = patterns(w)
        leader[by_syndrome[p >> 11] ^ (p & 2047)] = p
    p4 = patterns(4)
    s4 = by_syndrome[p4 >> 11] ^ (p4 & 2047)
    order = np.argsort(s4, kind="stable")
    p4, s4 = p4[order], s4[order]
    begin = np.searchsorted(s4, np.arange(2049))
    far = np.full((2048, 5), -1, dtype=np.int64)
    for s in range(2048):
        own = p4[begin[s]:begin[s + 1]]
        if len(own) == 5:                         # leaders of weight 3 only
            far[s] = own
    return by_syndrome, leader, far


def indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices near each 23-bit word; -1 where there is none."""
    by_syndrome, leader, far = golay()
    s = by_syndrome[words >> 11] ^ (words & 2047)
    own = (words ^ leader[s]) >> 11               # systematic: the upper 12 bits name the codeword
    more = np.where(far[s] >= 0, (words[:, None] ^ far[s]) >> 11, -1)
    return np.concatenate([own[:, None], more], axis=1)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all fuzzy keys of unsigned fingerprints; a key names its segment pair."""
    near = [indices(((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in SEGMENTS]
    rows, found = [], []
    for p, (i, j) in enumerate(PAIRS):
        a, b = near[i][:, :, None], near[j][:, None, :]
        ok = (a >= 0) & (b >= 0)
        key = (p << 24) | (a << 12) | np.maximum(b, 0)
        rows.append(np.nonzero(ok)[0])
        found.append(key[ok])
    return np.concatenate(rows), np.concatenate(found)


# -- links ----------------------------------------------------------------------------------------

def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_group(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (smallest fingerprint of a local component, member) of one group."""
    n = len(fps)
    if n == 2:
        near = np.bitwise_count(fps[0] ^ fps[1]) <= distance
        return (fps.min(keepdims=True), fps.max(keepdims=True)) if near else (fps[:0], fps[:0])
    fps = np.sort(fps)
    clique = np.full(n, -1)
    pivots: list[int] = []
    for i in range(n):
        if clique[i] < 0:
            ball = (np.bitwise_count(fps ^ fps[i]) <= distance // 2) & (clique < 0)
            clique[ball] = len(pivots)
            pivots.append(i)
    order = np.argsort(clique, kind="stable")
    begin = np.searchsorted(clique[order], np.arange(len(pivots) + 1))
    members = [fps[order[begin[c]:begin[c + 1]]] for c in range(len(pivots))]
    centre = fps[pivots]
    parent = np.arange(len(pivots))
    for c in range(len(pivots)):                  # cliques can touch only if their centres are near enough
        near = np.bitwise_count(centre[c + 1:] ^ centre[c]) <= distance + 2 * (distance // 2)
        for d in np.flatnonzero(near) + c + 1:
            a, b = _root(parent, c), _root(parent, d)
            if a != b and _touch(members[c], members[d], distance):
                parent[max(a, b)] = min(a, b)
    root = np.array([_root(parent, c) for c in range(len(pivots))])[clique]
    least = np.full(len(pivots), np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, root, fps)
    a = least[root]
    far = a != fps
    return a[far], fps[far]


def _touch(x: np.ndarray, y: np.ndarray, distance: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    step = max(1, 1 << 20 // max(1, len(y)))
    return any((np.bitwise_count(x[i:i + step, None] ^ y[None, :]) <= distance).any() for i in range(0, len(x), step))


def _group_links(distance: int):
    """Rows (key, block, fp) sorted by (key, block) to links; a group may reach over several batches."""

    def links(group, parts):
        a, b = link_group(np.unique(np.concatenate(parts)), distance) if parts else ((), ())
        return a, b

    def run(batches):
        open_key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            block = batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
            bounds = [0, *cut.tolist(), len(key)]
            out_a, out_b = [], []
            for s, e in zip(bounds[:-1], bounds[1:]):
                this = (key[s], block[s])
                if this != open_key:
                    if len(parts) > 1 or (parts and len(parts[0]) > 1):
                        a, b = links(open_key, parts)
                        out_a.append(a)
                        out_b.append(b)
                    open_key, parts = this, []
                parts.append(fp[s:e].copy())
            yield _pairs(out_a, out_b)
        if parts:
            a, b = links(open_key, parts)
            yield _pairs([a], [b])

    return run


def _pairs(a, b) -> pa.RecordBatch:
    a = np.concatenate(a) if a else np.zeros(0, np.uint64)
    b = np.concatenate(b) if b else np.zeros(0, np.uint64)
    both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i]).view(np.int64)) for i in (0, 1)],
                                      names=["a", "b"])


def small_group_links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of records sorted by key: groups of a few members pair by pair in vectors, others by pivots."""
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    size = np.diff(bounds)
    out_a, out_b = [], []
    for at in np.flatnonzero(size > FEW):
        a, b = link_group(np.unique(fp[bounds[at]:bounds[at + 1]]), distance)
        out_a.append(a)
        out_b.append(b)
    few = np.repeat(size <= FEW, size)
    key, fp = key[few], fp[few]
    for step in range(1, FEW):
        i = np.flatnonzero(key[step:] == key[:-step])
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
        x, y = fp[i], fp[i + step]
        out_a.append(np.minimum(x, y)[x != y])
        out_b.append(np.maximum(x, y)[x != y])
    return out_a, out_b


def fuzzy_links(fps: DataFrame, distance: int = 4, group_rows: int = GROUP_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints ``fp`` exactly as all links of
    at most ``distance`` bits do."""
    if not 0 <= distance <= 6:
        raise ValueError("three segments cover bit distances from 0 to 6")
    buckets = 1 + fps.count() * 85 // bucket_rows        # about 85 keys each

    def emit(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 16_384):
                part = fp[at:at + 16_384]
                row, key = keys(part)
                bucket = mix(key.astype(np.uint64)) % np.uint64(buckets)
                yield pack(bucket.astype(np.int32), [key.astype(np.int32), part[row]])

    def link(batches):
        for _, (key, fp) in unpack(batches, [np.int32, np.uint64]):
            order = np.argsort(key, kind="stable")
            yield _pairs(*small_group_links(key[order], fp[order], distance))

    def spell_out(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b.column("c0")[i].as_buffer(), np.int32)),
                     pa.array(np.frombuffer(b.column("c1")[i].as_buffer(), np.int64))], names=["key", "fp"])

    packed = store(fps.select("fp").coalesce(64).mapInArrow(emit, packed_schema(2)), "simhash-keys")
    full = (packed.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > 4 * bucket_rows).select("bucket"))
    full = store(full, "simhash-full")                   # at most a quarter of the buckets, in practice none
    if full.isEmpty():
        return to_buckets(packed, buckets).mapInArrow(link, "a long, b long").distinct()
    usual = to_buckets(packed.join(full, "bucket", "left_anti"), buckets).mapInArrow(link, "a long, b long")
    keyed = packed.join(full, "bucket", "left_semi").mapInArrow(spell_out, "key int, fp long")
    return usual.union(_hot_links(keyed, distance, group_rows)).distinct()


def _hot_links(keyed: DataFrame, distance: int, group_rows: int) -> DataFrame:
    """Links of ``key, fp`` rows where a key may have any number of members: blocks of a key meet in pairs."""
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    big = counts.where(F.col("n") > group_rows).select("key", F.ceil(F.col("n") / group_rows).cast("int").alias("blocks"))
    joined = keyed.join(store(big, "simhash-big"), "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1),
                        lambda o: F.least(own, o).cast("long") * (1 << 31) + F.greatest(own, o))
    grouped = joined.select("key", F.explode(pairs).alias("block"), "fp")
    spread = grouped.repartition("key", "block").sortWithinPartitions("key", "block")
    return spread.mapInArrow(_group_links(distance), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node with a link: labels spread to neighbours, then jump to their label's label."""
    edges = store(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    labels = store(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "cc-labels")
    while True:
        near = (edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("near")))
        hooked = labels.join(near, "node").select("node", F.least("root", "near").alias("root"))
        # a node's label takes over the smallest label that its members see
        lower = hooked.join(labels.select("node", F.col("root").alias("old")), "node").groupBy(F.col("old").alias("node")) \
            .agg(F.min("root").alias("low"))
        pulled = (hooked.join(lower, "node", "left").select("node", F.least("root", "low").alias("root")))
        jump = pulled.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = store(pulled.join(jump, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "cc-labels")
        same = after.join(labels.select("node", F.col("root").alias("old")), "node").where("root != old").isEmpty()
        labels = after
        if same:
            return labels


def near_duplicates(docs: DataFrame, k: int = 4, max_distance: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id, tag, fp, root, component`` per row; component: the smallest id of all rows it is linked with; tag: a hash
    of the text, which tells rows that repeat an id apart; root: the component's name, also where it has no id."""
    fps = store(fingerprints(docs, k, id_col, text_col), "simhash-fp")
    nodes = store(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = components(fuzzy_links(nodes, max_distance))
    own = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    own = store(own, "simhash-roots")
    least = own.groupBy("root").agg(F.min("least").alias("component"))
    table = store(own.join(least, "root").select("fp", "root", "component"), "simhash-components")
    return deal(fps, table, "fp", "left").select("id", "tag", "fp", "root", "component")


def keep_first(docs: DataFrame, k: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id (nulls last), then tag, once."""
    found = near_duplicates(docs, k, max_distance, id_col, text_col)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("tag"))
    stay = found.groupBy("root").agg(F.min(order).alias("f")).select(F.col("f.id").alias("_id"), F.col("f.tag").alias("_tag"))
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("key_id"),
                      F.xxhash64(F.col(text_col).cast("string")).alias("key_tag"))         # whatever the row's columns are called
    kept = own.join(stay, F.col("key_id").eqNullSafe(F.col("_id")) & (F.col("key_tag") == F.col("_tag")), "left_semi")
    return kept.dropDuplicates(["key_id", "key_tag"]).select("row.*")


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
