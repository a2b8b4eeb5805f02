"""Exact-substring removal by longest-previous-factor arrays.

A byte of a text goes if a string of ``min_len`` bytes that covers it also starts in a document with a
smaller id (matches never cross documents; all strings are judged on the input). So of every repeated
passage the first copy stays whole and the later ones go.

Only suffixes that can have a match of ``min_len`` bytes are brought together:

1. *Equal texts are one text* with the smallest id; the other copies are removed whole (if long enough).
   Distinct texts are dealt once into groups of a few MB (``d``); the three passes over them read the
   same exchange.
2. *Anchors.* Each window of ``min_len`` bytes belongs to its anchor, the leftmost k-gram of least hash in
   it (a minimizer), so equal windows have equal anchors. Pass 1 sends each group's distinct anchor
   hashes (4 bytes each, packed); those in more than one text come back.
3. *Suffixes.* Pass 2 sends the context of such anchors, i.e. the bytes of the windows they own, once per
   group with the smallest id that has it. A bucket keeps one of equal contexts, sorts the suffixes of
   the others that share an anchor, and takes for each the previous and the next suffix of smaller id
   (pointer jumping); the longer common prefix is its longest previous factor, an earlier match
   if it has ``min_len`` bytes.
4. Pass 3 marks the windows with an earlier match and cuts.

A hot passage costs one record per group, not per document. A bucket holds a bounded share of the
anchors; an anchor with more than ``wide`` different contexts (a very common k-gram) is marked in step 1,
and its suffixes are dealt one by one by a hash of their first ``min_len`` bytes instead.

Defined cases: a null text is empty; a null doc_id is larger than any id; rows that repeat an id are
not earlier than each other (equal texts with the smallest id all stay); texts below ``min_len`` bytes
are left alone; an empty table gives no rows; other columns are kept by ``cut`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslink.llm.common import (_BASE, _BASE_INV, _powers, BYTE_CODE, column_bytes, deal, mix, pack, pieces, store,
                                  to_buckets)

GROUP_BYTES = 4 << 20          # text of a group
BUCKET_ANCHORS = 400_000       # anchors of a bucket
WIDE = 20_000                  # contexts of an anchor from which its suffixes are dealt one by one
ONE = 1 << 15                  # marks such a suffix in the number of windows
NO_ID = (1 << 63) - 1
_U = np.uint64


def gram_size(min_len: int) -> int:
    return max(min(8, min_len), 2 * min_len // 5)


def anchors(raw: np.ndarray, offsets: np.ndarray, min_len: int):
    """Anchors of texts side by side: (text, first window, number of windows, anchor hash, context hash)."""
    n, k = len(raw), gram_size(min_len)
    w = min_len - k + 1
    none = np.zeros(0, np.int64)
    if n < min_len:
        return none, none, none, none.astype(_U), none.astype(_U)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(BYTE_CODE[raw] * _powers(_BASE, n), out=total[1:])
    inverse = _powers(_BASE_INV, n + 1)
    gram = (total[k:] - total[:-k]) * inverse[:n - k + 1]
    least = gram ^ (gram >> _U(32))
    least *= _U(0x9E3779B97F4A7C15)
    least &= _U(0xFFFFFFFF00000000)
    least |= np.arange(n - k + 1, dtype=_U)
    size = 1
    while 2 * size <= w:                                      # sliding minimum by doubling
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[:size - w], least[w - size:])
    ends = np.maximum(offsets[1:] - min_len + 1, offsets[:-1])            # a text's windows begin before here
    count = ends - offsets[:-1]
    text = np.repeat(np.arange(len(count)), count)
    window = np.arange(count.sum()) + np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    if not len(window):
        return none, none, none, none.astype(_U), none.astype(_U)
    owner = (least[window] & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(text) != 0)]))
    many = np.diff(np.concatenate([first, [len(window)]]))
    lo = window[first]
    context = mix((total[lo + many + min_len - 1] - total[lo]) * inverse[lo] + many.astype(_U))
    return text[first], lo, many, mix(gram[owner[first]]), context


def _texts(table: pa.Table):
    """Distinct texts of a group in order of their digests: (digests, raw, offsets)."""
    seen = {}
    digests = table.column("digest").to_pylist()
    for i, x in enumerate(digests):
        seen.setdefault(x, i)
    names = sorted(seen)
    texts = table.column("text").combine_chunks().take(pa.array([seen[x] for x in names], pa.int64()))
    raw, offsets = column_bytes(texts)
    return names, raw, offsets


def _all_anchors(raw, offsets, min_len):
    """anchors() in bounded steps of whole texts."""
    parts = []
    for s, e in pieces(offsets, 1 << 20):
        base = offsets[s]
        t, lo, m, a, c = anchors(raw[base:offsets[e]], offsets[s:e + 1] - base, min_len)
        parts.append((t + s, lo + base, m, a, c))
    return [np.concatenate(x) for x in zip(*parts)] if parts else anchors(raw, offsets, min_len)


def _split_key(anchor: np.ndarray, buckets: int):
    return ((anchor >> _U(32)) % _U(buckets)).astype(np.int32), (anchor & _U(0xFFFFFFFF)).astype(np.uint32)


def _with(batch: pa.RecordBatch, name: str, value: int) -> pa.RecordBatch:
    return batch.append_column(name, pa.array(np.full(batch.num_rows, value, np.int32)))


def _anchor_pass(min_len: int, buckets: int):
    def run(key, table):
        _, raw, offsets = _texts(table)
        text, _, _, anchor, context = _all_anchors(raw, offsets, min_len)
        order = np.lexsort((context, anchor))
        anchor, text, context = anchor[order], text[order], context[order]
        new = np.concatenate([[True], np.diff(anchor) != 0])[:len(anchor)]
        first = np.flatnonzero(new)
        if len(first):
            contexts = np.add.reduceat((new | np.concatenate([[True], np.diff(context) != 0])).astype(np.int64), first)
            several = np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first)
        else:
            contexts, several = first, first
        bucket, low = _split_key(anchor[first], buckets)
        note = (np.minimum(contexts, 127) + 128 * several).astype(np.uint8)       # in several texts; contexts
        return pa.Table.from_batches([_with(pack(bucket, [low, note]), "d", key[0].as_py())])

    return run


def _repeated(wide: int):
    """Per bucket the anchors that more than one text has, returned to each group that has them: usual, wide."""

    def answer(bucket, rows):
        low = np.concatenate([r[1] for r in rows])
        note = np.concatenate([r[2] for r in rows])
        order = np.argsort(low, kind="stable")
        s = low[order]
        run = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]])) - 1
        texts = np.bincount(run, weights=1 + (note[order] >> 7))
        contexts = np.bincount(run, weights=note[order] & 127)
        kind = np.empty(len(low), dtype=np.int8)
        kind[order] = ((texts > 1) * (1 + (contexts > wide)))[run]
        out, at = [], 0
        for d, own, _ in rows:
            k = kind[at:at + len(own)]
            at += len(own)
            if k.any():
                out.append((d, own[k == 1].tobytes(), own[k == 2].tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([bucket] * len(out), pa.int32()),
             pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())],
            names=["d", "bucket", "low", "extra"])

    def run(batches):
        now, rows = None, []
        for b in batches:
            for i in range(b.num_rows):
                bucket = b.column("bucket")[i].as_py()
                if bucket != now and rows:
                    yield answer(now, rows)
                    rows = []
                now = bucket
                rows.append((b.column("d")[i].as_py(), np.frombuffer(b.column("c0")[i].as_buffer(), np.uint32),
                             np.frombuffer(b.column("c1")[i].as_buffer(), np.uint8)))
        if rows:
            yield answer(now, rows)

    return run


def _side(table: pa.Table):
    """A group's second side: the id of each digest, and the other rows (bucket, bytes, bytes)."""
    ids, rest = {}, []
    for bucket, a, b, doc in zip(*(table.column(c).to_pylist() for c in ("bucket", "low", "extra", "doc"))):
        if bucket < 0:
            ids[a] = doc
        else:
            rest.append((bucket, a, b))
    return ids, rest


CONTEXT = "bucket int, n int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, bytes binary, d int"


def window_hashes(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """What anchors() gives as the context hash of a single window."""
    if not len(starts):
        return np.zeros(0, _U)
    view, power = np.lib.stride_tricks.sliding_window_view(raw, length), _powers(_BASE, length)
    parts = [(BYTE_CODE[view[starts[i:i + 65_536]]] * power).sum(axis=1, dtype=_U) for i in range(0, len(starts), 65_536)]
    return mix(np.concatenate(parts) + _U(1))


def spread_out(lo: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows: (row, start)."""
    row = np.repeat(np.arange(len(many)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)


def _context_pass(min_len: int, buckets: int):
    def wanted(blobs):
        own = [(_U(b) << _U(32)) | np.frombuffer(x, np.uint32).astype(_U) for b, x in blobs if x]
        return np.concatenate(own) if own else np.zeros(0, _U)

    def run(key, table, side):
        names, raw, offsets = _texts(table)
        ids, rest = _side(side)
        text, lo, many, anchor, context = _all_anchors(raw, offsets, min_len)
        bucket, low = _split_key(anchor, buckets)
        name = (bucket.astype(_U) << _U(32)) | low.astype(_U)
        own = np.array([ids[x] for x in names], dtype=np.int64)[text] if len(text) else np.zeros(0, np.int64)
        usual = np.isin(name, wanted([(b, x) for b, x, _ in rest]))
        wide = np.flatnonzero(np.isin(name, wanted([(b, x) for b, _, x in rest])))
        row, start = spread_out(lo[wide], many[wide])
        row = wide[row]
        single = window_hashes(raw, start, min_len)
        join = lambda a, b: np.concatenate([a[usual], b])
        bucket = join(bucket, (single % _U(buckets)).astype(np.int32))
        size = join(many, np.ones(len(row), np.int64)) + min_len - 1
        many = join(many, np.full(len(row), ONE + 1))
        lo, context, anchor, own = join(lo, start), join(context, single), join(anchor, anchor[row]), join(own, own[row])
        order = np.lexsort((own, anchor, context))                   # one record per context of the group
        new = np.concatenate([[True], (np.diff(context[order]) != 0) | (np.diff(anchor[order]) != 0)])[:len(order)]
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(order)]])[:len(first)] - 1
        pick, final = order[first], order[last]
        by_bucket = np.argsort(bucket[pick], kind="stable")
        pick, final = pick[by_bucket], final[by_bucket]
        batch = pack(bucket[pick], [anchor[pick], context[pick], own[pick], own[final], many[pick].astype(np.uint16)])
        body = [raw[a:a + n].tobytes() for a, n in zip(lo[pick].tolist(), size[pick].tolist())]
        at, blobs = 0, []
        for n in batch.column("n").to_pylist():
            blobs.append(b"".join(body[at:at + n]))
            at += n
        return pa.Table.from_batches([_with(batch.append_column("bytes", pa.array(blobs, pa.binary())), "d", key[0].as_py())])

    return run


def smaller_neighbours(value: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the previous and the next position of the same run with a smaller value (itself: none)."""
    n = len(value)

    def before(value, run):
        to = np.arange(n) - 1
        fixed = np.full(n, False)
        while True:
            ok = to >= 0
            ok[ok] = run[to[ok]] == run[ok]
            go = ok & ~fixed
            go[go] = value[to[go]] >= value[go]
            if not go.any():
                return np.where(ok, to, np.arange(n))
            fixed |= ~go
            step = to.copy()
            step[go] = to[to[go]]
            to = step

    prev = before(value, run)
    nxt = n - 1 - before(value[::-1], run[::-1])[::-1]
    return prev, nxt


def suffix_order(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The suffixes at ``starts`` sorted by their first ``length`` bytes."""
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    rows = np.ascontiguousarray(view[starts])
    pad = -length % 8
    if pad:
        rows = np.concatenate([rows, np.zeros((len(rows), pad), np.uint8)], axis=1)
    words = rows.view(">u8").astype(_U)
    order = np.argsort(words[:, 0], kind="stable")
    # refine only what is still tied
    for c in range(1, words.shape[1]):
        tied = np.zeros(len(order), dtype=bool)
        same = (words[order[1:], :c] == words[order[:-1], :c]).all(axis=1)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(np.concatenate([[True], ~same]))[at]
        order[at] = order[at][np.lexsort((words[order[at], c], group))]
    return order


def earlier_ids(raw: np.ndarray, starts: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Per suffix the smallest id of itself and of its previous and next smaller suffixes with a longest
    previous factor of ``length`` bytes or more."""
    order = suffix_order(raw, starts, length)
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    same = np.empty(len(order), dtype=bool)
    same[0] = False
    for at in range(1, len(order), 1 << 18):                           # common prefix with the suffix before
        a, b = order[at:at + (1 << 18)], order[at - 1:at + (1 << 18) - 1][:len(order) - at]
        same[at:at + len(a)] = (view[starts[a]] == view[starts[b]]).all(axis=1)
    run = np.cumsum(~same)
    value = doc[order]
    prev, nxt = smaller_neighbours(value, run)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.minimum(np.minimum(value[prev], value[nxt]), value)
    return out


def _match(min_len: int):
    """Rows of contexts of a bucket to earlier ids per window, for contexts with an occurrence to cut."""

    def answer(rows):
        ids: dict[bytes, int] = {}
        which, anchor = [], []
        for r in rows:
            at = 0
            for m in (r["many"] & (ONE - 1)).tolist():
                size = m + min_len - 1
                which.append(ids.setdefault(r["bytes"][at:at + size], len(ids)))
                at += size
        which = np.array(which, dtype=np.int64)
        anchor = np.concatenate([r["anchor"] for r in rows])
        least_here = np.concatenate([r["least"] for r in rows])
        many = np.concatenate([r["many"] for r in rows]).astype(np.int64) & (ONE - 1)
        n = len(ids)
        least = np.full(n, NO_ID, dtype=np.int64)
        np.minimum.at(least, which, least_here)
        own_anchor, own_many = np.zeros(n, _U), np.zeros(n, np.int64)
        own_anchor[which], own_many[which] = anchor, many
        begin = np.concatenate([[0], np.cumsum(own_many)])
        found = np.repeat(least, own_many)                              # earlier id of each window of each context
        _, inverse, count = np.unique(own_anchor, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(count[inverse] > 1)                      # contexts that share an anchor with another
        if len(mixed):
            texts = list(ids)
            raw = np.frombuffer(b"".join([texts[i] for i in mixed.tolist()]), np.uint8)
            size = own_many[mixed] + min_len - 1
            base = np.concatenate([[0], np.cumsum(size)[:-1]])
            row, start = spread_out(base, own_many[mixed])
            found[spread_out(begin[mixed], own_many[mixed])[1]] = earlier_ids(raw, start, least[mixed][row], min_len)
        lowest = np.minimum.reduceat(found, begin[:-1]) if n else found
        out, at = [], 0
        for r in rows:
            i = which[at:at + len(r["many"])]
            at += len(r["many"])
            cut = np.flatnonzero(lowest[i] < r["most"])
            if len(cut):
                head = np.stack([r["context"][cut], r["anchor"][cut], r["many"][cut].astype(_U)], axis=1)
                out.append((r["d"], head.tobytes(), found[spread_out(begin[i[cut]], own_many[i[cut]])[1]].tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([0] * len(out), pa.int32()),
             pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())],
            names=["d", "bucket", "low", "extra"])

    def run(batches):
        now, rows = None, []
        for b in batches:
            for i in range(b.num_rows):
                bucket = b.column("bucket")[i].as_py()
                if bucket != now and rows:
                    yield answer(rows)
                    rows = []
                now = bucket
                get = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)  # noqa: E731, B023
                rows.append({"d": b.column("d")[i].as_py(), "anchor": get("c0", _U), "context": get("c1", _U),
                             "least": get("c2", np.int64), "most": get("c3", np.int64), "many": get("c4", np.uint16),
                             "bytes": b.column("bytes")[i].as_py()})
        if rows:
            yield answer(rows)

    return run


RESULT = "digest binary, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept string"


def _cut_pass(min_len: int, keep_text: bool):
    def run(key, table, side):
        names, raw, offsets = _texts(table)
        ids, rest = _side(side)
        depth = np.zeros(len(raw) + 1, dtype=np.int32)
        if rest:
            head = np.concatenate([np.frombuffer(a, _U).reshape(-1, 3) for _, a, _ in rest])
            early = np.concatenate([np.frombuffer(b, np.int64) for _, _, b in rest])
            width = head[:, 2].astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(width & (ONE - 1))])
            order = np.lexsort((head[:, 1], head[:, 0]))
            text, lo, many, anchor, context = _all_anchors(raw, offsets, min_len)
            wide = np.isin(anchor, head[width >= ONE, 1])
            row, single = spread_out(lo[wide], many[wide])
            row = np.flatnonzero(wide)[row]
            context = np.concatenate([context[~wide], window_hashes(raw, single, min_len)])
            text, anchor = (np.concatenate([x[~wide], x[row]]) for x in (text, anchor))
            lo, many = np.concatenate([lo[~wide], single]), np.concatenate([many[~wide], np.ones(len(row), np.int64)])
            doc = np.array([ids[x] for x in names], dtype=np.int64)
            at = np.minimum(np.searchsorted(head[order, 0], context), len(order) - 1)
            while True:                                              # equal context hashes: go on to the same anchor
                miss = (head[order[at], 0] == context) & (head[order[at], 1] != anchor) & (at + 1 < len(order))
                if not miss.any():
                    break
                at[miss] += 1
            hit = np.flatnonzero((head[order[at], 0] == context) & (head[order[at], 1] == anchor))
            row, start = spread_out(lo[hit], many[hit])
            earlier = early[spread_out(begin[order[at[hit]]], many[hit])[1]] < doc[text[hit]][row]
            start = start[earlier]
            np.add.at(depth, start, 1)
            np.add.at(depth, start + min_len, -1)
        gone = np.cumsum(depth[:-1]) > 0
        out = []
        for i, name in enumerate(names):
            own = gone[offsets[i]:offsets[i + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            kept = raw[offsets[i]:offsets[i + 1]][~own].tobytes()
            out.append((name, int(own.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.tolist(),
                        kept.decode("utf-8", "ignore") if keep_text and len(edge) else None))
        types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
        fields = ["digest", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        return pa.Table.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=fields)

    return run


def _distinct(batches):
    """A task sends each text once."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for i, digest in enumerate(b.column("digest").to_pylist()):
            if digest not in seen:
                seen.add(digest)
                keep.append(i)
        yield b.take(pa.array(keep, pa.int64()))


def dedup(docs: DataFrame, min_len: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False,
          group_bytes: int = GROUP_BYTES, bucket_anchors: int = BUCKET_ANCHORS, wide: int = WIDE) -> DataFrame:
    """Per row of ``docs``: ``id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (starts and ends of the removed
    runs in turn) and, with ``keep_text``, ``kept`` (the text that stays; a character that a cut breaks goes whole; null
    where nothing is removed)."""
    if min_len < 2:
        raise ValueError("min_len must be 2 bytes or more")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    narrow = store(rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "suffix-rows")
    first = narrow.groupBy("digest").agg(F.coalesce(F.min("id"), F.lit(NO_ID)).alias("doc"), F.max("n_bytes").alias("n_bytes"))
    first = store(first.withColumn("live", F.col("n_bytes") >= min_len), "suffix-first")
    total = first.where("live").agg(F.sum("n_bytes")).first()[0] or 0
    groups = 1 + total // group_bytes
    buckets = 1 + 2 * total // (min_len - gram_size(min_len) + 2) // bucket_anchors
    parts = min(groups, 20_000)
    group = F.pmod(F.xxhash64("digest"), F.lit(groups)).cast("int")
    texts = (rows.where(F.octet_length("text") >= min_len).select("digest", "text")
             .mapInArrow(_distinct, "digest binary, text string").withColumn("d", group).repartition(parts, "d"))
    names = first.where("live").select(group.alias("d"), F.lit(-1).alias("bucket"), F.col("digest").alias("low"),
                                       F.lit(None).cast("binary").alias("extra"), "doc")

    def beside(answers: DataFrame) -> DataFrame:
        have = answers.select("d", "bucket", "low", "extra", F.lit(None).cast("long").alias("doc"))
        return names.unionByName(have).repartition(parts, "d")

    sent = texts.groupBy("d").applyInArrow(_anchor_pass(min_len, buckets), "bucket int, n int, c0 binary, c1 binary, d int")
    repeated = to_buckets(sent, buckets).mapInArrow(_repeated(wide), "d int, bucket int, low binary, extra binary")
    contexts = (texts.groupBy("d").cogroup(beside(repeated).groupBy("d"))
                .applyInArrow(_context_pass(min_len, buckets), CONTEXT))
    matched = to_buckets(contexts, buckets).mapInArrow(_match(min_len), "d int, bucket int, low binary, extra binary")
    cut = texts.groupBy("d").cogroup(beside(matched).groupBy("d")).applyInArrow(_cut_pass(min_len, keep_text), RESULT)
    table = first.join(store(cut, "suffix-cut"), "digest", "left").drop("n_bytes")
    joined = deal(narrow, table, "digest", "left")
    copy = F.col("live") & (F.coalesce("id", F.lit(NO_ID)) > F.col("doc"))      # a later copy of an equal text
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "id", "digest", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(
            F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if keep_text else []))
