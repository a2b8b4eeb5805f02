"""Language-model scoring: causal self-attention over subword ids, trained in numpy.

One head of causal attention with a residual path reads the ids of a public tokenizer. The text's ids are cut
into windows of ``2 * HALF - 1`` inputs that overlap by half; each window scores only the ``HALF`` ids of its second
half, so every id is scored once, with ``HALF`` to ``2 * HALF - 1`` places before it (fewer at the text's
begin, where a start mark stands). A step runs the attention of many windows at once under one causal mask.

The softmax goes over classes of ids: the most frequent ids are classes of their own, the others share classes of
about equal mass (ids that end a word apart from those that don't); within a class an id has its share of all training ids (one added
to each), so every id of the tokenizer has a probability and all of them add up to 1. What attention adds to the
class logits starts from the classes' shares after the id before, counted over all training ids.

What it learns comes from all training rows: counts of words, of ids and of classes after ids are summed in Spark over every text. The
weights are trained where the rows are, on every training text, in ``ROUNDS`` rounds: the texts are dealt by hash over ``SHARE``
parts (no more than rounds), each round takes one part. A task starts from the broadcast weights, takes all windows of its
texts of this part through Adam steps, and hands on its weights; their mean, weighted by windows, starts the next round. Sums
go through a shuffle, the driver gets at most ``SLOTS`` vectors.

The base score needs the count of every word. Words with more than one in ``HEAD`` of all tokens (fewer than ``HEAD``,
whatever the input) are broadcast and counted in the task; for the others each document sends its distinct words to a
join with the counts, where no key has more than one in ``HEAD`` of all tokens.

Defined cases: null and empty texts have the end alone; repeated rows count and are scored each; with no training
row all counts are 0 and the model knows nothing but equal shares; empty tables give no rows; other columns are
ignored. Words are compared by a 64-bit hash of their bytes. A document is one value of a task.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslink.llm.common import LOWER, column_bytes, pieces, store, word_hashes, word_spans
from presslink.llm.packing import _LATIN, word_ids

DIM = 16
HALF = 16                      # ids scored by a window
CLASSES = 64
SINGLE = 48                    # classes of one id
INPUTS = 2_048                 # ids with an input vector of their own; others take their class's
STEP = 48                      # windows of a step
SCORED = 192                   # windows scored at once
ROUNDS = 2
SHARE = 2                      # parts of the training texts, one a round: every text is trained on
RATE = 0.01
SLOTS = 64
PRIOR = 4.0                    # weight of the classes' own shares in the shares after an id
HEAD = 1 << 21                 # 50 MB are broadcast at most
STEP_BYTES = 2 << 20
HASH_BYTES = 1 << 17
TASK_WORDS = 1 << 20           # distinct words that a task holds before it hands them on
CACHE_WORDS = 2_000_000        # of about 40 bytes each
END_WORD = np.uint64(0x51D7_E3A2_9C4B_F00D)


# -- the model ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Vocabulary:
    """``input``: id -> input row; ``cls``: id -> class; ``log_share``: natural logarithm of an id's share of its class."""

    input: np.ndarray
    cls: np.ndarray
    log_share: np.ndarray
    of_class: np.ndarray       # share of each class of all ids
    start: int


def build_vocabulary(counts: np.ndarray, ends_word: np.ndarray) -> Vocabulary:
    """Classes and input rows of the ids from their counts in the training rows."""
    n = len(counts)
    smooth = counts.astype(np.float64) + 1
    order = np.argsort(-counts, kind="stable")
    single = order[:min(SINGLE, n)]
    cls = np.zeros(n, np.int64)
    cls[single] = np.arange(len(single))
    rest = order[len(single):]
    if len(rest):
        rest = rest[np.lexsort((-counts[rest], ends_word[rest]))]
        mass = np.cumsum(smooth[rest])
        cls[rest] = SINGLE + np.minimum((mass - smooth[rest]) * (CLASSES - SINGLE) // mass[-1], CLASSES - SINGLE - 1)
    of_class = np.bincount(cls, smooth, minlength=CLASSES)
    rows = np.empty(n, np.int64)
    rows[:] = INPUTS + cls
    rows[order[:INPUTS]] = np.arange(min(INPUTS, n))
    return Vocabulary(rows, cls, np.log(smooth / of_class[cls]), of_class / of_class.sum(), INPUTS + CLASSES)


def after_table(vocabulary: Vocabulary, cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log share of each class after each input row, from the counts of ``row * CLASSES + class``."""
    counts = np.zeros((INPUTS + CLASSES + 1, CLASSES))
    counts.reshape(-1)[cells] = n
    counts += PRIOR * vocabulary.of_class
    with np.errstate(divide="ignore"):                     # a class without ids is never a target
        return np.maximum(np.log(counts / counts.sum(axis=1, keepdims=True)), -30.0).astype(np.float32)


SHAPES = {"emb": (INPUTS + CLASSES + 1, DIM), "pos": (2 * HALF - 1, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM),
          "o": (DIM, DIM), "out": (DIM, CLASSES)}
SIZE = sum(math.prod(s) for s in SHAPES.values())
_ENDS = np.cumsum([math.prod(s) for s in SHAPES.values()]).tolist()
#: Places of the numbers of an input row's vector.
CELLS = np.arange((INPUTS + CLASSES + 1) * DIM).reshape(-1, DIM)
#: Which inputs the id at each place of the second half may see; a last place that none sees makes the rows even.
MASK = np.where(np.arange(2 * HALF)[None] <= np.arange(HALF)[:, None] + HALF - 1, 0, -1e9).astype(np.float32)


def views(vector: np.ndarray) -> dict[str, np.ndarray]:
    return {name: vector[end - math.prod(shape):end].reshape(shape) for (name, shape), end in zip(SHAPES.items(), _ENDS)}


def first_weights() -> np.ndarray:
    """Small random weights; those of the logits are 0, so the model starts from the shares after the id before."""
    vector = np.random.default_rng(13).normal(0, 0.2, SIZE).astype(np.float32)
    views(vector)["out"][:] = 0
    return vector


@lru_cache(maxsize=8)
def ones(n: int, dtype) -> np.ndarray:
    """A product with these is faster than a sum over a short axis."""
    return np.ones(n, dtype)


def forward(w: dict[str, np.ndarray], after: np.ndarray, inputs: np.ndarray, safe: bool = True):
    """Class logits (windows * HALF, CLASSES) and what the gradient needs; ``safe``: no number overflows.

    The head is as wide as the vectors, so queries meet keys, and values the output, by one matrix each.
    """
    n = len(inputs)
    qk, vo = w["q"] @ w["k"].T, w["v"] @ w["o"]
    qk *= qk.dtype.type(DIM ** -0.5)
    both = np.concatenate([w["out"], vo @ w["out"]])
    padded = np.zeros((n, 2 * HALF), np.int64)
    padded[:, :-1] = inputs
    x = np.take(w["emb"], padded, axis=0)
    x[:, :-1] += w["pos"]
    oc = np.empty((n, HALF, 2 * DIM), x.dtype)             # own vectors, then what attention adds
    oc[:, :, :DIM] = x[:, HALF - 1:-1]
    flat = oc.reshape(-1, 2 * DIM)
    s = (flat[:, :DIM] @ qk).reshape(n, HALF, DIM)
    a = s @ x.transpose(0, 2, 1)
    a += MASK
    if safe:
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    part = 1 / (a.reshape(-1, a.shape[2]) @ ones(a.shape[2], a.dtype))[:, None]
    c = (a @ x).reshape(-1, DIM)
    c *= part                                              # fewer numbers than a
    flat[:, DIM:] = c
    z = flat @ both
    z += np.take(after, inputs[:, HALF - 1:].reshape(-1), axis=0)
    return z, (padded, qk, vo, both, x, flat, s, a, part, c)


def log_probabilities(z: np.ndarray, target: np.ndarray, safe: bool = True) -> np.ndarray:
    """log P(class) of each target; ``z`` is overwritten with probabilities times their sum."""
    own = np.take(z, target + np.arange(0, z.size, z.shape[1]))
    if safe:
        most = z.max(axis=1)
        z -= most[:, None]
        own -= most
    np.exp(z, out=z)
    own -= np.log(z @ ones(z.shape[1], z.dtype))
    return own


def blank() -> tuple[np.ndarray, dict[str, np.ndarray]]:
    out = np.zeros(SIZE, np.float32)
    return out, views(out)


def gradient(w: dict[str, np.ndarray], after: np.ndarray, inputs: np.ndarray, target: np.ndarray, valid: np.ndarray, into=None) -> tuple[np.ndarray, float]:
    """Gradient of the mean negative log probability of the valid targets (as one vector, ``into`` if given), and that mean."""
    target, valid = target.reshape(-1), valid.reshape(-1)
    total = max(int(np.count_nonzero(valid)), 1)
    share = valid.astype(after.dtype)
    share *= share.dtype.type(1 / total)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        z, state = forward(w, after, inputs, safe=False)
        loss = -float(log_probabilities(z, target, safe=False) @ share)
    if not math.isfinite(loss):
        z, state = forward(w, after, inputs)
        loss = -float(log_probabilities(z, target) @ share)
    padded, qk, vo, both, x, flat, s, a, part, c = state
    n, scale = len(inputs), w["q"].dtype.type(DIM ** -0.5)
    z *= (share / (z @ ones(z.shape[1], z.dtype)))[:, None]         # the probabilities now, by the share of their target
    at = target + np.arange(0, z.size, z.shape[1])
    z.reshape(-1)[at] -= share
    out, g = into or blank()
    gboth = (z.T @ flat).T
    gvo = gboth[DIM:] @ w["out"].T
    np.add(gboth[:DIM], vo.T @ gboth[DIM:], out=g["out"])
    g["v"][:], g["o"][:] = gvo @ w["o"].T, w["v"].T @ gvo
    d = z @ both.T
    dc = d[:, DIM:] * part                                 # in place of a divided by its sums
    c *= dc
    mean = (c @ ones(DIM, c.dtype)).reshape(n, HALF, 1)    # sum of each row of da * a
    dc = dc.reshape(n, HALF, DIM)
    ds = dc @ x.transpose(0, 2, 1)
    ds -= mean
    ds *= a
    dx = a.transpose(0, 2, 1) @ dc
    dx += ds.transpose(0, 2, 1) @ s
    ds = (ds @ x).reshape(-1, DIM)
    gqk = flat[:, :DIM].T @ ds
    gqk *= scale
    g["q"][:], g["k"][:] = gqk @ w["k"], gqk.T @ w["q"]
    down = ds @ qk.T
    down += d[:, :DIM]
    dx[:, HALF - 1:-1] += down.reshape(n, HALF, DIM)
    g["pos"][:] = dx.sum(axis=0)[:-1]
    g["emb"].reshape(-1)[:] = np.bincount(np.take(CELLS, padded.reshape(-1), axis=0).reshape(-1), dx.reshape(-1), minlength=CELLS.size)
    return out, loss


class Adam:
    def __init__(self, vector: np.ndarray):
        self.vector, self.m, self.v, self.t = vector, np.zeros_like(vector), np.zeros_like(vector), 0
        self.part = np.empty_like(vector)

    def step(self, g: np.ndarray):
        """``m`` and ``v`` are kept ten and fifty times as large: fewer passes over the numbers."""
        self.t += 1
        part = self.part
        self.m *= np.float32(0.9)
        self.m += g
        np.multiply(g, g, out=part)
        self.v *= np.float32(0.98)
        self.v += part
        np.sqrt(self.v, out=part)
        part += np.float32(1e-8 / math.sqrt(0.02))
        np.divide(self.m, part, out=part)
        part *= np.float32(RATE * 0.1 / math.sqrt(0.02) * math.sqrt(1 - 0.98 ** self.t) / (1 - 0.9 ** self.t))
        self.vector -= part


class Windows:
    """The windows of several texts: ``ids`` of all texts in a row, ``first`` their places (texts + 1)."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, vocabulary: Vocabulary):
        self.ids, self.vocabulary = ids, vocabulary
        n = -(-np.diff(first) // HALF)
        self.text = np.repeat(np.arange(len(n)), n)
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.number = number
        self.at = first[:-1][self.text] + number * HALF
        self.begin, self.end = first[:-1][self.text], first[1:][self.text]
        self.rows = np.concatenate([np.full(HALF, vocabulary.start), vocabulary.input[ids], np.full(HALF, vocabulary.start)])

    def take(self, which: np.ndarray):
        """Input rows, target ids' places, whether they are of the text."""
        at = self.at[which][:, None]
        inputs = self.rows[at + np.arange(2 * HALF - 1)]   # the row of a place stands HALF further on
        inputs[self.number[which] == 0, :HALF] = self.vocabulary.start
        target = at + np.arange(HALF)
        valid = target < self.end[which][:, None]
        return inputs, np.where(valid, target, 0), valid


def score_ids(vector: np.ndarray, after: np.ndarray, vocabulary: Vocabulary, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    w = views(vector)
    windows = Windows(ids, first, vocabulary)
    out = np.zeros(len(first) - 1)
    for at in range(0, len(windows.at), SCORED):
        which = np.arange(at, min(at + SCORED, len(windows.at)))
        inputs, target, valid = windows.take(which)
        own = ids[target.reshape(-1)]
        with np.errstate(over="ignore", invalid="ignore"):
            logs = log_probabilities(forward(w, after, inputs, safe=False)[0], vocabulary.cls[own], safe=False)
        if not np.isfinite(logs).all():
            logs = log_probabilities(forward(w, after, inputs)[0], vocabulary.cls[own])
        logs = logs.astype(np.float64) + vocabulary.log_share[own]
        np.add.at(out, windows.text[which], (logs.reshape(valid.shape) * valid).sum(axis=1))
    return out / np.log(10)


# -- words and ids of the corpus ------------------------------------------------------------------

def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2):
    """crc32 of the id as text, modulo ``folds``, is ``fold`` (a null id: as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _words(column: pa.Array):
    """In steps: first text, texts, distinct words (hashes; the end is one), number of each word and end, text of each, words' bytes.

    The words come text after text, then one end per text; ``bytes_of(which)``: the bytes of these distinct words (of the end: none).
    """
    raw, offsets = column_bytes(column)
    for lo, hi in pieces(offsets, STEP_BYTES):
        low = LOWER[raw[offsets[lo]:offsets[hi]]]
        own = offsets[lo:hi + 1] - offsets[lo]
        start, end, before = word_spans(low, own)
        n = hi - lo
        text = np.concatenate([np.repeat(np.arange(n), np.diff(before)), np.arange(n)])
        hashes = np.full(len(start) + n, END_WORD)
        for first, last in pieces(own, HASH_BYTES):        # arrays that the cache holds
            w = slice(before[first], before[last])
            hashes[w] = word_hashes(low[own[first]:own[last]], start[w] - own[first], end[w] - own[first])
        order = np.argsort(hashes)                         # np.unique with places takes a slower, stable sort
        ranked = hashes[order]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        h, place = ranked[fresh], order[fresh]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1

        def bytes_of(which, data=low.tobytes(), place=place, start=start, end=end):
            at = place[which]
            words = at < len(start)
            at = np.where(words, at, 0)
            first, last = (np.where(words, e[at] if len(e) else 0, 0).tolist() for e in (start, end))
            return [data[i:j] for i, j in zip(first, last)]

        yield lo, n, h, number, text, before, bytes_of


class WordCodes:
    """Word hash to the tokenizer's ids of the word: sorted hashes, each with its place among the ids; emptied when full."""

    def __init__(self, tokenizer_path: str):
        self.coder = word_ids(tokenizer_path)
        self.split = re.compile(rf"\n|{self.coder.split.pattern}").findall if self.coder.by_word else None
        self.clear()

    def clear(self):
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ends, self.codes = np.zeros(1, np.int64), np.zeros(0, np.uint32)      # word ``p`` has codes[ends[p]:ends[p + 1]]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has. Words of plain characters are split in one go, one to a line."""
        texts = b"\n".join(words).decode("utf-8", "replace").split("\n")
        plain = [w for w in texts if _LATIN.fullmatch(w)] if self.split else []
        lines = "\n".join(plain)
        pieces = self.split(lines.lower()) if plain and not self.coder.special(lines) else []
        if not pieces or pieces.count("\n") != len(plain) - 1:
            plain, pieces = [], []
        known, piece = self.coder.pieces.get, self.coder.piece
        coded = [b"" if p == "\n" else known(p) or piece(p) for p in pieces]
        sizes = np.array([len(x) >> 2 for x in coded], np.int64)
        ends = np.cumsum(sizes)
        if len(plain) == len(texts):
            return np.frombuffer(b"".join(coded), "<u4"), np.diff(ends[np.flatnonzero(sizes == 0)], prepend=0, append=ends[-1])
        split = np.diff(ends[np.flatnonzero(sizes == 0)], prepend=0, append=ends[-1]).tolist() if plain else []
        flat, out, at, i = b"".join(coded), [], 0, 0
        for w in texts:
            if plain and _LATIN.fullmatch(w):
                out.append(flat[at:at + 4 * split[i]])
                at += 4 * split[i]
                i += 1
            else:
                out.append(self.coder[w] if w else b"")
        return np.frombuffer(b"".join(out), "<u4"), np.array([len(x) >> 2 for x in out], np.int64)

    def ids(self, h: np.ndarray, number: np.ndarray, before: np.ndarray, bytes_of) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts' words in a row, and where each text's begin (texts + 1); ``h`` is sorted."""
        at = np.searchsorted(self.hashes, h)
        if len(self.hashes):
            new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != h)
        else:
            new = np.arange(len(h))
        if len(new) and len(self.hashes) and len(self.hashes) + len(new) > CACHE_WORDS:
            self.clear()
            at, new = np.zeros(len(h), np.int64), np.arange(len(h))
        if len(new):
            codes, n = self.encode(bytes_of(new))
            places = np.arange(len(new), dtype=np.int32) + np.int32(len(self.hashes))
            self.hashes, self.places = np.insert(self.hashes, at[new], h[new]), np.insert(self.places, at[new], places)
            self.codes, self.ends = np.concatenate([self.codes, codes]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
            at = np.searchsorted(self.hashes, h)
        own = self.places[at]
        words = own[number[:before[-1]]]
        begin = self.ends[words]
        sizes = self.ends[words + 1] - begin
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(ends[-1])
        place += np.repeat(begin - ends[:-1], sizes)
        return self.codes[place], ends[before]


@lru_cache(maxsize=2)
def word_codes(tokenizer_path: str) -> WordCodes:
    return WordCodes(tokenizer_path)


def _count_words(batches):
    """(word, occurrences in training rows, in all rows) of a task."""
    parts, size = [], 0

    def added(parts):
        h, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return [h, *(np.bincount(inverse, np.concatenate([p[i] for p in parts]), minlength=len(h)).astype(np.int64) for i in (1, 2))]

    def batch(h, train, every):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(train), pa.array(every)], names=["word", "train", "every"])

    for b in batches:
        learns = ~np.array(b.column(1).to_pylist(), bool)
        for lo, n, h, number, text, _, _ in _words(b.column(0)):
            parts.append([h, np.bincount(number, learns[lo:lo + n][text], minlength=len(h)), np.bincount(number, minlength=len(h))])
            size += len(parts[-1][0])
            if size >= 2 * TASK_WORDS:
                parts = [added(parts)]
                if len(parts[0][0]) >= TASK_WORDS:
                    yield batch(*parts[0])
                    parts = []
                size = sum(len(p[0]) for p in parts)
    if parts:
        yield batch(*added(parts))


_DOC = ["uid", "id", "held_out", "n_tokens", "n_known", "base", "words", "times", "ids"]
_DOC_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
_DOC_SCHEMA = "uid long, id long, held_out boolean, n_tokens long, n_known long, base double, words binary, times binary, ids binary"


def _documents(tokenizer_path: str, end_id: int, head):
    """Counts over the broadcast words, the other words, and the ids of each text."""
    def run(batches):
        known, train = head.value
        log_count = np.log10(train + 1.0)
        codes = word_codes(tokenizer_path)
        kind = id_type(codes.coder.tokenizer.get_vocab_size())
        end = np.array([end_id], kind).tobytes()
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            ids, held = b.column(1).to_pylist(), b.column(2).to_pylist()
            for lo, n, h, number, text, before, bytes_of in _words(b.column(0)):
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                is_head = known[at] == h if len(known) else np.zeros(len(h), bool)
                seen, part = np.zeros(len(h)), np.zeros(len(h))
                seen[is_head] = train[at[is_head]] > 0
                part[is_head] = log_count[at[is_head]]
                base = np.bincount(text, part[number], minlength=n)
                seen = np.bincount(text, seen[number], minlength=n)
                tokens = np.bincount(text, minlength=n)
                rare = ~is_head[number]
                cell, times = np.unique(text[rare] * len(h) + number[rare], return_counts=True)
                cut = np.searchsorted(cell, np.arange(n + 1) * len(h))
                words = h[cell % len(h)]
                coded, first = codes.ids(h, number, before, bytes_of)
                coded = coded.astype(kind)
                rows = []
                for i in range(n):
                    own = slice(cut[i], cut[i + 1])
                    rows.append((uid, ids[lo + i], held[lo + i], int(tokens[i]), int(seen[i]), float(base[i]), words[own].astype("<u8").tobytes(),
                                 times[own].astype("<u4").tobytes(), coded[first[i]:first[i + 1]].tobytes() + end))
                    uid += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(_DOC_TYPES)], names=_DOC)

    return run


def _rare_words(batches):
    for b in batches:
        words = [np.frombuffer(x, "<i8") for x in b.column(1).to_pylist()]
        if not words:
            continue
        uid = np.repeat(b.column(0).to_numpy(), [len(x) for x in words])
        times = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(np.concatenate(words)), pa.array(times)], names=["uid", "word", "times"])


def _id_counts(size: int):
    def run(batches):
        counts = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                counts += np.bincount(np.frombuffer(x, id_type(size)), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["token", "n"])

    return run


def _after_counts(vocabulary):
    """(row * CLASSES + class, times) of a task: which class comes after which input."""
    def run(batches):
        counts = np.zeros((INPUTS + CLASSES + 1) * CLASSES, np.int64)
        for b in batches:
            ids, first = _flat(b.column(0), len(vocabulary.value.cls))
            rows = np.concatenate([[0], vocabulary.value.input[ids[:-1]]])
            rows[first[:-1]] = vocabulary.value.start
            counts += np.bincount(rows * CLASSES + vocabulary.value.cls[ids], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["cell", "n"])

    return run


def id_type(size: int) -> np.dtype:
    """How the ids of a tokenizer of this many are stored."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _flat(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = column_bytes(column)
    kind = id_type(size)
    return np.frombuffer(raw.tobytes(), kind).astype(np.int64), offsets // kind.itemsize


_WEIGHTS = "slot int, n long, weights binary"


def _weights_batch(slot: int, n: int, vector: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([n], pa.int64()), pa.array([vector.tobytes()], pa.binary())],
                                      names=["slot", "n", "weights"])


def _train(shared, after, vocabulary):
    """A task's windows of this round, step by step from the common weights; the weights times the windows go on."""
    def run(batches):
        adam = Adam(shared.value.copy())
        w, into = views(adam.vector), blank()
        waiting, n = [], 0
        total = 0

        def step(parts):
            inputs, target, valid = parts[0] if len(parts) == 1 else (np.concatenate([p[i] for p in parts]) for i in range(3))
            adam.step(gradient(w, after.value, inputs, target, valid, into)[0])
            return len(inputs)

        for b in batches:
            ids, first = _flat(b.column(0), len(vocabulary.value.cls))
            windows = Windows(ids, first, vocabulary.value)
            mine = np.arange(len(windows.at))
            for at in range(0, len(mine), STEP):
                inputs, target, valid = windows.take(mine[at:at + STEP])
                waiting.append((inputs, vocabulary.value.cls[ids[target]], valid))
                n += len(inputs)
                if n >= STEP:
                    total += step(waiting)
                    waiting, n = [], 0
        if waiting:
            total += step(waiting)
        if total:
            yield _weights_batch(TaskContext.get().partitionId(), total, adam.vector.astype(np.float64) * total)

    return run


def _add_weights(batches):
    total, n = None, 0
    for b in batches:
        for own, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            x = np.frombuffer(x)
            total = x.copy() if total is None else total + x
            n += own
    if n:
        yield _weights_batch(0, n, total)


def rounds(own: DataFrame) -> list[DataFrame]:
    """The training rows of each round: together all of ``own``."""
    return [own.where(F.pmod(F.xxhash64("id", "n_tokens"), F.lit(SHARE)) == r % SHARE) for r in range(ROUNDS)]


def fit(own: DataFrame, vocabulary) -> tuple[np.ndarray, object]:
    """Weights after ``ROUNDS`` rounds over the training rows of ``own`` (``ids``, ``id``, ``n_tokens``), and the broadcast shares after an id."""
    sc = own.sparkSession.sparkContext
    cells = (own.select("ids").mapInArrow(_after_counts(vocabulary), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
             .toArrow())                                   # at most (INPUTS + CLASSES + 1) * CLASSES rows
    after = sc.broadcast(after_table(vocabulary.value, cells["cell"].to_numpy(), cells["n"].to_numpy()))
    vector = first_weights()
    for mine in rounds(own):
        tasks = mine.select("ids").mapInArrow(_train(sc.broadcast(vector), after, vocabulary), _WEIGHTS)
        sums = tasks.repartition(SLOTS, "slot").mapInArrow(_add_weights, _WEIGHTS).collect()      # at most SLOTS vectors
        n = sum(x.n for x in sums)
        if n:
            vector = (sum(np.frombuffer(x.weights) for x in sums) / n).astype(np.float32)
    return vector, after


def _score(shared, after, vocabulary):
    def run(batches):
        for b in batches:
            ids, first = _flat(b.column(1), len(vocabulary.value.cls))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(score_ids(shared.value, after.value, vocabulary.value, ids, first))],
                                             names=["uid", *_DOC[1:6], "score"])

    return run


def score(docs: DataFrame, tokenizer_path: str, end_id: int, folds: int = 7, fold: int = 2, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    The model and all counts learn from the rows whose id's crc32 modulo ``folds`` is not ``fold``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"),
                       held_out(id_col, folds, fold).alias("held_out"))
    counts = store(rows.select("text", "held_out").mapInArrow(_count_words, "word long, train long, every long")
                   .groupBy("word").agg(F.sum("train").alias("train"), F.sum("every").alias("every")), "attention-words")
    sums = counts.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count_if(F.col("train") > 0).alias("v"),
                      F.coalesce(F.sum("every"), F.lit(0)).alias("every")).first()
    frequent = counts.where(F.col("every") > sums.every // HEAD).select("word", "train").toArrow()      # fewer than HEAD rows
    words = frequent["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    head = spark.sparkContext.broadcast((words[order], frequent["train"].to_numpy()[order]))
    own = store(rows.mapInArrow(_documents(tokenizer_path, end_id, head), _DOC_SCHEMA), "attention-documents")

    coder = word_ids(tokenizer_path).tokenizer
    size = coder.get_vocab_size()
    learned = own.where(~F.col("held_out"))
    id_counts = np.zeros(size, np.int64)
    for r in learned.select("ids").mapInArrow(_id_counts(size), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        id_counts[r.token] = r.n                           # at most one row per id of the tokenizer
    ends = np.array([(coder.id_to_token(i) or "").endswith("</w>") for i in range(size)])
    vocabulary = spark.sparkContext.broadcast(build_vocabulary(id_counts, ends))
    vector, after = fit(learned, vocabulary)

    scored = own.select("uid", "ids", *_DOC[1:6]).mapInArrow(
        _score(spark.sparkContext.broadcast(vector), after, vocabulary),
        "uid long, id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    rare = (own.select("uid", "words", "times").mapInArrow(_rare_words, "uid long, word long, times long")
            .join(counts.where("train > 0").select("word", "train"), "word").groupBy("uid")
            .agg(F.sum("times").alias("rare"), F.sum(F.col("times") * F.log10(F.col("train") + 1.0)).alias("rare_base")))
    return (scored.join(rare, "uid", "left")
            .select("id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare", F.lit(0))).alias("n_known"),
                    F.lit(sums.n).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(sums.n + sums.v + 1))))
                    .alias("base_score"), "score"))
