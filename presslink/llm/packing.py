"""Best-fit packing of tokenised documents by bin completion.

``token_pieces`` tokenises whole texts (ids of a public tokenizer, then one end id) and cuts only
documents longer than a sequence. ``pack`` deals the pieces over shards of bounded size; a shard packs
its own: best-fit decreasing gives the incumbent, and where that misses the lower bound, its wasteful bins
are searched in groups of a few dozen: a depth-first bin completion places the largest piece with each
undominated filling of the rest, prunes by the waste that a better solution may have, and keeps the best
solution found within ``steps`` steps (exact where the search ends before). The least filled sequence of
each shard is opened again and packed with those of the other shards.

Tokenising goes word by word through a bounded cache: the tokenizer's rules never join characters over
white space, so the ids of a text are those of its words. A word of plain Latin letters, digits and marks
goes to the tokenizer's model directly; any other goes through the whole tokenizer.

Defined cases: a null or empty text is the end id alone; repeated rows (also of one id) are packed each
on their own; an empty table packs into no sequence; other columns are ignored; a document of any length
is cut as a stream of ids, so only its own ids are in memory.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslink.llm.common import store

SHARD_PIECES = 20_000
CACHE_WORDS = 400_000
STEPS = 6_000             # steps of the search for one group of bins
GROUP = 24
ROUNDS = 4


# -- tokens ---------------------------------------------------------------------------------------

_LATIN = re.compile(r"[\x21-\x7eÀ-ÿ]+")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")            # Python splits there, the tokenizer does not


class WordIds(dict):
    """Word to its ids as little-endian unsigned 32-bit bytes; emptied when full."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the direct way holds for this kind of tokenizer only; any other takes the whole tokenizer
        norms = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = norms == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] \
            and not pre[1]["add_prefix_space"] and spec["post_processor"] is None
        if self.by_word:
            pattern = pre[0]["pattern"]["Regex"]
            for a, b in ((r"\p{L}", "a-zß-öø-ÿ"), (r"\p{N}", "0-9")):
                pattern = pattern.replace("[" + a + "]", "[" + b + "]").replace(a, b)
            self.split = re.compile(pattern)
        special = [re.escape(x["content"]) for x in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(special) or r"(?!)").search
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]      # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in visible]
        self.byte_chars = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        if _LATIN.fullmatch(word) and not self.special(word):
            known = self.pieces.get
            out = b"".join([known(p) or self.piece(p) for p in self.split.findall(word.lower())])
        else:
            out = _bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out
        return out

    def piece(self, p: str) -> bytes:
        shown = p if p.isascii() else "".join([self.byte_chars[b] for b in p.encode()])
        got = _bytes([t.id for t in self.model.tokenize(shown)])
        if len(self.pieces) >= CACHE_WORDS:
            self.pieces.clear()
        self.pieces[p] = got
        return got

    def ids(self, text: str) -> bytes:
        if not self.by_word or _ODD_SPACE.search(text):
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, text.split()))


def _bytes(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


PIECE = "id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32`` per piece of at most ``max_len`` ids."""
    end, step = _bytes([end_id]), 4 * max_len

    def run(batches):
        cache = word_ids(tokenizer_path)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = cache.ids(text or "") + end
                for i, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    out.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECE)


# -- bins -----------------------------------------------------------------------------------------

def best_fit(lengths: list[int], cap: int) -> list[list[int]]:
    """Best-fit decreasing: each length into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for x in sorted(lengths, reverse=True):
        at = bisect_left(rooms, x)
        if at == len(rooms):
            bins.append([x])
            b, room = len(bins) - 1, cap - x
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            bins[b].append(x)
            room -= x
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return bins


def lower_bound(lengths: list[int], cap: int) -> int:
    """Bins that any packing needs: by volume, and by pieces above each threshold that exclude one another."""
    best = -(-sum(lengths) // cap)
    a = np.sort(np.asarray(lengths, dtype=np.int64))
    sums = np.concatenate([[0], np.cumsum(a)])
    for k in np.unique(a[a <= cap // 2])[:512].tolist():
        big = len(a) - np.searchsorted(a, cap - k, side="right")            # share a bin with nothing of k or more
        half = np.searchsorted(a, cap - k, side="right") - np.searchsorted(a, cap // 2, side="right")
        lo, hi = np.searchsorted(a, k), np.searchsorted(a, cap // 2, side="right")
        free = half * cap - (sums[np.searchsorted(a, cap - k, side="right")] - sums[hi])
        more = max(0, -(-int(sums[hi] - sums[lo] - free) // cap))
        best = max(best, int(big + half + more))
    return best


def fillings(counts: dict[int, int], room: int, steps: int) -> tuple[list[tuple[int, ...]], int]:
    """Undominated fillings of ``room``, least waste first, and the steps the search took. Dominated is a filling of
    which a part can give way to one remaining length that is no shorter (or as long as two or more pieces
    together): the part then fits where that length would have gone. After ``steps`` steps the ones found so far
    are returned, at least one."""
    sizes = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    found: list[tuple[int, ...]] = []
    spent = 0

    def dominated(part: tuple[int, ...], left: int) -> bool:
        used: dict[int, int] = {}
        for x in part:
            used[x] = used.get(x, 0) + 1
        one, more = {0, *part}, set()
        sums = {0}
        for x in part[-12:]:                               # more subsets would prune more, fewer lose nothing
            more |= {s + x for s in sums if s}
            sums |= {s + x for s in sums}
        # the largest remaining lengths decide first: they take the place of the largest parts
        for x in sizes:
            if counts[x] > used.get(x, 0) and (x in more or any(s < x <= s + left for s in one | more)):
                return True
        return False

    def grow(at: int, left: int, part: tuple[int, ...]):
        nonlocal spent
        spent += 1
        fits = False
        for i in range(at, len(sizes)):
            x = sizes[i]
            if x <= left and counts[x] > part.count(x):
                fits = True
                grow(i, left - x, (*part, x))
                if found and (spent > steps or found[-1] == (room,)):       # one piece that fills the room dominates all
                    return
        if not fits and not dominated(part, left):
            found.append(part)

    grow(0, room, ())
    return sorted(set(found), key=lambda p: (-sum(p), [-x for x in p])), spent


def bin_completion(lengths: list[int], cap: int, incumbent: list[list[int]] | None = None, steps: int = STEPS) -> list[list[int]]:
    """Fewest bins found: best-fit decreasing (or ``incumbent``, if better), then depth-first completion around the
    largest length left, pruned by waste. Exact where the search ends within ``steps`` steps of enumeration; each
    level may use its share of the steps left, so a long search still reaches whole solutions."""
    best = best_fit(lengths, cap)
    if incumbent is not None and len(incumbent) <= len(best):
        best = incumbent
    floor = lower_bound(lengths, cap) if lengths else 0
    if len(best) <= floor:
        return best
    counts: dict[int, int] = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    volume, left = sum(lengths), steps
    # one level per bin: (largest, fillings to try, waste above)
    stack: list[list] = []
    done: list[list[int]] = []
    waste = 0

    def take(part, sign):
        for x in part:
            counts[x] = counts.get(x, 0) - sign

    def open_level():
        nonlocal left
        top = max(x for x, n in counts.items() if n)
        counts[top] -= 1
        options, spent = fillings(counts, cap - top, max(64, left // max(1, len(best) - len(done))))
        counts[top] += 1
        left -= spent
        stack.append([top, options[::-1], waste])

    open_level()
    whole = False                                          # a search goes on until it reached one whole solution
    while stack and (left > 0 or not whole) and len(best) > floor:
        top, options, above = stack[-1]
        if len(done) == len(stack):                       # undo the filling tried last
            take(done.pop(), -1)
        if not options:
            stack.pop()
            whole = whole or left <= 0
            continue
        part = [top, *options.pop()]
        left -= 1
        waste = above + cap - sum(part)
        # a better solution has one bin less, hence at most this much waste
        if waste > (len(best) - 1) * cap - volume:
            done.append([])
            continue
        take(part, 1)
        done.append(part)
        if not any(counts.values()):
            whole = True
            if len(done) < len(best):
                best = [list(p) for p in done]
            continue
        if len(done) + 1 >= len(best):
            continue
        open_level()
    return best


def complete(lengths: list[int], cap: int, group: int = GROUP, rounds: int = ROUNDS, steps: int = STEPS) -> list[list[int]]:
    """Bins of many pieces: best fit, then bin completion over groups of its wasteful bins.

    Bins without waste stay. The others are dealt into groups of about ``group`` bins, larger where a group must be to
    hold a bin's worth of waste; a group that misses its bound is searched, its own bins being the incumbent. Up to
    ``rounds`` rounds deal anew: first by waste, then by fixed permutations. Stops at the lower bound of all."""
    best = best_fit(lengths, cap)
    floor = lower_bound(lengths, cap) if lengths else 0
    for r in range(rounds):
        open_bins = [b for b in best if sum(b) < cap]
        spare = len(open_bins) * cap - sum(map(sum, open_bins))
        if len(best) <= floor or spare < cap:
            break
        groups = max(1, min(len(open_bins) // group, spare // cap))
        order = sorted(range(len(open_bins)), key=lambda i: sum(open_bins[i])) if r == 0 else \
            np.random.default_rng(r).permutation(len(open_bins)).tolist()
        kept = [b for b in best if sum(b) == cap]
        for g in range(groups):
            mine = [open_bins[i] for i in order[g::groups]]
            if len(best) > floor:
                got = bin_completion([x for b in mine for x in b], cap, mine, steps)
                kept += got
            else:
                kept += mine
        best = kept
    return best


def place(lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of the least filled bin (the last)."""
    bins = complete(lengths.tolist(), cap)
    bins.sort(key=sum, reverse=True)
    order = np.argsort(-lengths, kind="stable")
    first = {}
    for rank, i in enumerate(order.tolist()):
        first.setdefault(int(lengths[i]), []).append(i)
    for rows in first.values():
        rows.reverse()
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, content in enumerate(bins):
        at = 0
        for x in content:
            i = first[x].pop()
            bin_of[i], offset[i] = b, at
            at += x
    return bin_of, offset, len(bins) - 1


PLACED = PIECE + ", sequence_id long, offset long, reopened boolean"


def _shard(cap: int, phase: int):
    def run(key, table):
        shard = key[0].as_py()
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        bin_of, offset, last = place(table.column("length").to_numpy(), cap)
        out = table.select(["id", "piece", "start", "length", "ids_crc32"])
        out = out.append_column("sequence_id", pa.array((phase << 62) + (shard << 31) + bin_of))
        out = out.append_column("offset", pa.array(offset))
        return out.append_column("reopened", pa.array((bin_of == last) & (phase == 0)))

    return run


def pack(pieces: DataFrame, max_len: int = 4096, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces: sequences of at most ``max_len`` ids, gapless from 0."""
    pieces = store(pieces, "pack-pieces")
    shards = 1 + pieces.count() // shard_pieces
    name = F.xxhash64("id", "piece", "start", "length", "ids_crc32")
    if shards == 1:
        one = pieces.withColumn("_s", F.lit(0).cast("long"))
        return one.groupBy("_s").applyInArrow(_shard(max_len, 1), PLACED).drop("reopened")
    first = store(pieces.withColumn("_s", F.pmod(name, F.lit(shards))).groupBy("_s")
                  .applyInArrow(_shard(max_len, 0), PLACED), "pack-first")
    again = first.where("reopened")
    more = 1 + again.count() // shard_pieces
    second = (again.withColumn("_s", F.pmod(F.xxhash64("sequence_id"), F.lit(more))).groupBy("_s")
              .applyInArrow(_shard(max_len, 1), PLACED))
    return first.where("NOT reopened").unionByName(second).drop("reopened")
