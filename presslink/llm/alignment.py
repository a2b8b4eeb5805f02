"""Alignment of two tokenizers: where their tokens end together, and how often their ids meet.

A text (with a space before it) is encoded by tokenizer A, a byte-level BPE, and by tokenizer B, a BPE over
pieces with byte fallback. Both lists of token ends are increasing byte offsets. The shorter list drives a
galloping intersection: each of its ends is looked for in the longer list by doubling steps from a starting
place and then by halving the bracket found. All ends of a step search at once in numpy; every ``ANCHOR``-th end
starts from its share of the longer list, those between start on the line between the anchors' places. The
common ends cut both lists into groups, the differences of their ranks are the ranges of tokens of a group.

``align`` writes, per document, counts, the digest of the groups and the document's linked id pairs to the shared
folder, sums the pairs over the whole corpus in Spark, and reads the documents again to judge each link by
these counts. The table of pairs is broadcast when it has at most ``MAX_PAIRS`` rows, joined otherwise (pairs
that occur in very many documents are dealt over several tasks).

Encoding goes chunk by chunk through bounded caches where that gives the same ids: neither tokenizer has a
token that goes on over the start of a blank. Each text's joined token bytes are compared with its own.

Defined cases: null or empty texts, and texts that one of the tokenizers does not give back byte for byte
(U+2581 in a text reads as a space), have no tokens: all counts 0, an empty digest. Repeated rows count as often
as they occur. Empty tables give no rows; other columns are ignored. A document is one value of a task.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslink.llm.common import deal, store

ANCHOR = 16
STEP_CHARS = 1 << 19
CACHE_CHUNKS = 400_000
CACHE_CHARS = 64               # longer chunks are not kept
MAX_PAIRS = 2_000_000          # 34 MB are broadcast at most
TASK_PAIRS = 2_000_000         # distinct pairs that a task holds before it hands them on

_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯▁　﻿]")


LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class Encoder(dict):
    """Chunk to its ids (little-endian unsigned 32-bit) for many chunks; and the bytes of each id."""

    CHUNKS: re.Pattern
    by_chunk = True

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; the chunks that are not known yet are encoded together."""
        cut = [self.cut(t) if t and self.by_chunk and not _ODD.search(t) else None for t in texts]
        new = self.unknown(cut)
        if len(self) + len(new) > CACHE_CHUNKS:            # the shorter chunks stay, they come back more often
            sizes = np.array([len(c) for c in self], np.int64)
            limit = np.median(sizes) if len(sizes) else 0
            kept = [(c, ids) for c, ids in self.items() if len(c) < limit]
            self.clear()
            self.update(kept)
            new = self.unknown(cut)
        self.update(zip(new, map(_u4, self.encode(new))))
        out = [_u4(self.whole(t)) if chunks is None and t else b"".join(map(self.__getitem__, chunks or ()))
               for t, chunks in zip(texts, cut)]
        for c in new:
            if len(c) > CACHE_CHARS:
                del self[c]
        return out

    def cut(self, text: str) -> list[str]:
        return self.CHUNKS.findall(" " + text)

    def unknown(self, cut) -> list[str]:
        found = set()
        for chunks in cut:
            found.update(chunks or ())
        return [c for c in found if c not in self]

    def set_table(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        width = len(str(max(self.size - 1, 0)))
        self.digits = np.array([str(i).encode() for i in range(self.size)], f"S{width}").view(np.uint8).reshape(self.size, width)


def _u4(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class ByteLevel(Encoder):
    """Tokenizer A; its text has the space before it."""

    LETTERS_ONLY = re.compile(rf" ?[{LETTERS}]+")
    # the tokenizer's own rule joins one space to what follows, never crosses other white space and ends letters
    # before what is no letter
    CHUNKS = re.compile(rf" ?[{LETTERS}]+(?=[\x00-@\[-`{{-\x7f]|$)| ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]")

    def __init__(self, path: str):
        super().__init__()
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # the tasks are parallel already
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]      # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.shown = {b: c for c, b in byte.items()}       # byte to the character that stands for it
        self.set_table([bytes([byte[c] for c in self.own.id_to_token(i)]) for i in range(self.own.get_vocab_size())])

    def encode(self, chunks: list[str]):
        """A run of letters is one word of the tokenizer's rule and goes to its model directly."""
        shown = [c.encode().decode("latin-1").translate(self.shown) if self.LETTERS_ONLY.fullmatch(c) else None for c in chunks]
        rest = iter(self.own.encode_batch_fast([c for c, s in zip(chunks, shown) if s is None], add_special_tokens=False))
        tokenize = self.own.model.tokenize
        return [next(rest).ids if s is None else [t.id for t in tokenize(s)] for s in shown]

    def whole(self, text: str):
        return self.own.encode(" " + text, add_special_tokens=False).ids


class Pieces(Encoder):
    """Tokenizer B, which writes a space before the text itself."""

    CHUNKS = re.compile(rf" +[{LETTERS}]+(?=[\x00-@\[-`{{-\x7f]|$)| +[^ \n]*|\n?[^ \n]+|\n")

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.set_table([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
                        for p in pieces])
        self.blank = self.own.piece_to_id("▁")
        # chunks give the ids of the whole only if no piece crosses their edges and no text is rewritten
        probe = "x  éé ﬁ\tz\n w "
        crossing = re.compile(rf"[^▁]▁|\n|[{LETTERS}][\x00-@\[-`{{-\x7f]")
        self.by_chunk = not any(crossing.search(p) for p in pieces if not re.fullmatch("<.*>", p)) and \
            self.own.normalize(probe) == "▁" + probe.replace(" ", "▁") and \
            self.own.encode("\n", out_type=str) == ["▁", "<0x0A>"]

    def encode(self, chunks: list[str]):
        # the tokenizer's own space stands for the first one of the chunk; a chunk without any follows a line break here
        got = self.own.encode([c[1:] if c[0] == " " else "\n" + c for c in chunks], num_threads=1)
        return [(ids or [self.blank]) if c[0] == " " else ids[2:] for c, ids in zip(chunks, got)]

    def whole(self, text: str):
        return self.own.encode(text)


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(maxsize=2)
def piece_level(path: str) -> Pieces:
    return Pieces(path)


# -- galloping intersection -----------------------------------------------------------------------

def gallop(needles: np.ndarray, hay: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each needle the place of the first value of ``hay`` that is not below it; the last value is not below any."""
    at = np.clip(start, 0, len(hay) - 1)
    right = hay[at] < needles
    lo = np.where(right, at, -1)                           # a value below the needle, or the place before all
    hi = np.where(right, len(hay) - 1, at)                 # a value that is not below it
    own = np.arange(len(needles))
    step = 1
    while len(own):                                        # doubling steps, until the comparison turns
        to_right = right[own]
        probe = at[own] + np.where(to_right, step, -step)
        inside = (probe > lo[own]) & (probe < hi[own])
        own, probe, to_right = own[inside], probe[inside], to_right[inside]
        below = hay[probe] < needles[own]
        lo[own[below]] = probe[below]
        hi[own[~below]] = probe[~below]
        own = own[below == to_right]
        step *= 2
    own = np.flatnonzero(hi - lo > 1)
    while len(own):                                        # halving the bracket
        mid = (lo[own] + hi[own]) >> 1
        below = hay[mid] < needles[own]
        lo[own[below]] = mid[below]
        hi[own[~below]] = mid[~below]
        own = own[hi[own] - lo[own] > 1]
    return hi


def intersect(short: np.ndarray, long_: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists of their common values; ``guess``: where the values of ``short`` may stand in ``long_``."""
    if not len(short) or not len(long_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    anchors = np.arange(0, len(short) + ANCHOR - 1, ANCHOR)
    anchors[-1] = len(short) - 1
    found = gallop(short[anchors], long_, guess[anchors])
    start = np.interp(np.arange(len(short)), anchors, found).astype(np.int64)
    place = gallop(short, long_, start)
    own = np.flatnonzero(long_[place] == short)
    return own, place[own]


def common_ends(a_ends, a_first, b_ends, b_first) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common ends in both lists, for several texts in a row (ends go on rising over the texts).

    In each text the list with fewer ends drives.
    """
    n_a, n_b = np.diff(a_first), np.diff(b_first)
    a_drives = n_a <= n_b
    out = []
    for drives, s_ends, s_first, n_s, l_ends, l_first, n_l in ((a_drives, a_ends, a_first, n_a, b_ends, b_first, n_b),
                                                               (~a_drives, b_ends, b_first, n_b, a_ends, a_first, n_a)):
        text = np.repeat(np.arange(len(n_s)), n_s)
        own = np.flatnonzero(drives[text])
        t = text[own]
        guess = l_first[t] + (own - s_first[t]) * n_l[t] // np.maximum(n_s[t], 1)
        short, place = intersect(s_ends[own], l_ends, guess)
        out.append((own[short], place))
    (a1, b1), (b2, a2) = out
    order = np.argsort(np.concatenate([a1, a2]), kind="stable")
    return np.concatenate([a1, a2])[order], np.concatenate([b1, b2])[order]


# -- a step of texts ------------------------------------------------------------------------------

def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(first - (ends - n), n)


def _encode(coder: Encoder, ids: list[bytes], sizes: np.ndarray, raw: np.ndarray):
    """Ids of all texts in a row, first place of each text, and whether the tokens give the bytes back."""
    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)
    length = coder.length[flat]
    total = np.concatenate([[0], np.cumsum(length)])
    good = np.diff(total[first]) == sizes
    if good.all():
        same = coder.raw[_spread(coder.begin[flat], length)] == raw
        bad = np.flatnonzero(~same)
        good[np.searchsorted(np.cumsum(sizes), bad, side="right")] = False
    else:
        at = np.cumsum(sizes) - sizes
        for i in np.flatnonzero(good):
            own = flat[first[i]:first[i + 1]]
            good[i] = bool((coder.raw[_spread(coder.begin[own], coder.length[own])] == raw[at[i]:at[i] + sizes[i]]).all())
    return flat, first, good


def _keep(flat, first, good):
    n = np.diff(first) * good
    return flat[np.repeat(good, np.diff(first))], np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


class Aligned:
    """Tokens and groups of several texts.

    ``a``, ``b``: ids of all texts in a row; ``a_first``, ``b_first``: first token of each text (texts + 1);
    ``a_cut``, ``b_cut``: last token of each group; ``first``: first group of each text (texts + 1).
    """

    def __init__(self, texts: list[str | None], a: ByteLevel, b: Pieces):
        with_space = [(" " + t).encode() if t else b"" for t in texts]
        sizes = np.array([len(x) for x in with_space], np.int64)
        raw = np.frombuffer(b"".join(with_space), np.uint8)
        own = [_encode(c, c.encode_texts([t or "" for t in texts]), sizes, raw) for c in (a, b)]
        good = own[0][2] & own[1][2]
        (self.a, self.a_first), (self.b, self.b_first) = (_keep(flat, first, good) for flat, first, _ in own)
        self.a_cut, self.b_cut = common_ends(np.cumsum(a.length[self.a]), self.a_first, np.cumsum(b.length[self.b]), self.b_first)
        self.first = np.searchsorted(self.a_cut, self.a_first)
        self.coders = a, b

    def group_text(self) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2`` of all texts in a row, and where each text's begins (texts + 1; its last ``;`` is not its own)."""
        a, b = self.coders
        width = max(a.digits.shape[1], b.digits.shape[1]) + 1
        n = len(self.a) + len(self.b)
        out = np.zeros((n, width), np.uint8)
        group_a = np.searchsorted(self.a_cut, np.arange(len(self.a)))
        group_b = np.searchsorted(self.b_cut, np.arange(len(self.b)))
        b_before = np.concatenate([[0], self.b_cut + 1])[group_a]
        a_before = (self.a_cut + 1)[group_b]
        for ids, place, digits, cut, mark in ((self.a, np.arange(len(self.a)) + b_before, a.digits, self.a_cut, b"|"),
                                              (self.b, np.arange(len(self.b)) + a_before, b.digits, self.b_cut, b";")):
            sep = np.full(len(ids), ord(","), np.uint8)
            sep[cut] = mark[0]
            out[place, :digits.shape[1]] = digits[ids]
            out[place, width - 1] = sep
        size = np.concatenate([[0], np.cumsum((out != 0).sum(axis=1))])
        return out[out != 0].tobytes(), size[self.a_first + self.b_first]

    def pairs(self) -> np.ndarray:
        """The pair of ids of every link as one number."""
        return self.a[self.a_cut] * self.coders[1].size + self.b[self.b_cut]


def _steps(column: pa.Array):
    """Runs of texts of about ``STEP_CHARS`` characters."""
    texts = column.to_pylist()
    own, size, at = [], 0, 0
    for i, t in enumerate(texts):
        own.append(t)
        size += len(t or "")
        if size >= STEP_CHARS:
            yield at, own
            own, size, at = [], 0, i + 1
    if own:
        yield at, own


_ROW = ["uid", "id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
_ROW_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
_ROW_SCHEMA = "uid long, id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary"


def _documents(path_a: str, path_b: str):
    def run(batches):
        a, b = byte_level(path_a), piece_level(path_b)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for at, texts in _steps(batch.column(0)):
                got = Aligned(texts, a, b)
                said, begin = got.group_text()
                pairs = got.pairs()
                rows = []
                for i in range(len(texts)):
                    links = slice(got.first[i], got.first[i + 1])
                    own, times = np.unique(pairs[links], return_counts=True)
                    digest = hashlib.sha256(said[begin[i]:begin[i + 1] - 1]).hexdigest() if begin[i + 1] > begin[i] else ""
                    rows.append((uid, ids[at + i], int(got.a_first[i + 1] - got.a_first[i]), int(got.b_first[i + 1] - got.b_first[i]),
                                 int(got.first[i + 1] - got.first[i]), digest, own.astype("<i8").tobytes(), times.astype("<u4").tobytes()))
                    uid += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(_ROW_TYPES)], names=_ROW)

    return run


def _task_pairs(batches):
    """(pair, links) of a task's documents, added up."""
    keys, sums, size = [], [], 0

    def added():
        own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, inverse, np.concatenate(sums))
        return own, total

    def batch(own, total):
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total, pa.int64())], names=["pair", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        own = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8")
        keys.append(own)
        sums.append(np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").astype(np.int64))
        size += len(own)
        if size >= 2 * TASK_PAIRS:
            own, total = added()
            if len(own) >= TASK_PAIRS:
                yield batch(own, total)
                own, total = own[:0], total[:0]
            keys, sums, size = [own], [total], len(own)
    if keys:
        yield batch(*added())


def _judge(table):
    def run(batches):
        pair, n, best = table.value
        for b in batches:
            counts, firsts = [], []
            for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                at = np.searchsorted(pair, np.frombuffer(p, "<i8"))
                times = np.frombuffer(t, "<u4").astype(np.int64)
                counts.append(int((n[at] * times).sum()))
                firsts.append(int(times[best[at]].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64())],
                                             names=["uid", "n_best", "count_sum"])

    return run


def _explode(batches):
    for b in batches:
        for uid, p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            own = np.frombuffer(p, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), uid)), pa.array(own),
                                              pa.array(np.frombuffer(t, "<u4").astype(np.int64))], names=["uid", "pair", "times"])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row.

    A link is a pair of tokens that end together, so each group has one. ``n_best`` counts the links whose pair
    is linked as often in the corpus as any pair with the same id of B.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    own = store(rows.mapInArrow(_documents(path_a, path_b), _ROW_SCHEMA), "alignment-documents")
    pairs = store(own.select("pairs", "times").mapInArrow(_task_pairs, "pair long, n long")
                  .groupBy("pair").agg(F.sum("n").alias("n")), "alignment-pairs")
    size_b = piece_level(path_b).size
    most = pairs.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))
    judged = (pairs.join(most, F.col("pair") % size_b == F.col("b"))
              .select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    if pairs.count() <= MAX_PAIRS:
        t = judged.orderBy("pair").toArrow()
        table = spark.sparkContext.broadcast(tuple(c.to_numpy() for c in (t["pair"], t["n"], t["best"])))
        links = own.select("uid", "pairs", "times").mapInArrow(_judge(table), "uid long, n_best long, count_sum long")
    else:
        each = own.select("uid", "pairs", "times").mapInArrow(_explode, "uid long, pair long, times long")
        links = (deal(each, judged, "pair", "inner").groupBy("uid")
                 .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).cast("long").alias("n_best"),
                      F.sum(F.col("times") * F.col("n")).cast("long").alias("count_sum")))
    zero = F.lit(0).cast("long")
    return (own.drop("pairs", "times").join(links, "uid", "left")
            .select("id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"),
                    F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"))


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, a_ids, b_ids, groups`` per row; a group is the ranges of its tokens, ``a_from .. a_to`` and ``b_from .. b_to`` (exclusive)."""
    group = pa.struct([(x, pa.int32()) for x in ("a_from", "a_to", "b_from", "b_to")])

    def run(batches):
        a, b = byte_level(path_a), piece_level(path_b)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for at, texts in _steps(batch.column(0)):
                got = Aligned(texts, a, b)
                out = []
                for i in range(len(texts)):
                    links = slice(got.first[i], got.first[i + 1])
                    a_to, b_to = got.a_cut[links] + 1 - got.a_first[i], got.b_cut[links] + 1 - got.b_first[i]
                    a_from, b_from = np.concatenate([[0], a_to[:-1]]), np.concatenate([[0], b_to[:-1]])
                    out.append((ids[at + i], got.a[got.a_first[i]:got.a_first[i + 1]], got.b[got.b_first[i]:got.b_first[i + 1]],
                                [dict(zip(("a_from", "a_to", "b_from", "b_to"), map(int, g))) for g in zip(a_from, a_to, b_from, b_to)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.list_(pa.int32())),
                     pa.array([r[2] for r in out], pa.list_(pa.int32())), pa.array([r[3] for r in out], pa.list_(group))],
                    names=["id", "a_ids", "b_ids", "groups"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    return rows.mapInArrow(run, "id long, a_ids array<int>, b_ids array<int>, "
                                "groups array<struct<a_from:int,a_to:int,b_from:int,b_to:int>>")
