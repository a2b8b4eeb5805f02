"""K1 inside tasks: token-set ratios of one string against a block of strings, vectorised."""

from __future__ import annotations

import numpy as np


class StringBlock:
    """Contributor strings of one field, prepared for vector scoring."""

    def __init__(self, strings, idxs, alphabet: dict[str, int]):
        n = len(strings)
        self.idxs = [list(x) for x in idxs]
        self.min_idx = np.array([x[0] if len(x) else np.iinfo(np.int64).max for x in self.idxs], dtype=np.int64)
        toks = [sorted(set(c.split())) for c in strings]
        self.n_tok = np.array([len(t) for t in toks], dtype=np.int64)
        self.tok_len = np.array([sum(map(len, t)) for t in toks], dtype=np.int64)
        postings: dict[str, list[tuple[int, int]]] = {}
        # sorted token strings as a padded code matrix; ``owner``: the token a character (or the space after it) is of
        width = max((len(" ".join(t)) for t in toks), default=0)
        self.codes = np.zeros((n, width), dtype=np.int32)
        self.owner = np.zeros((n, width), dtype=np.int32)
        self.space = alphabet.setdefault(" ", len(alphabet) + 1)
        for j, t in enumerate(toks):
            at = 0
            for i, w in enumerate(t):
                postings.setdefault(w, []).append((j, i))
                for ch in w + " " * (i + 1 < len(t)):
                    self.codes[j, at] = alphabet.setdefault(ch, len(alphabet) + 1)
                    self.owner[j, at] = i
                    at += 1
        self.postings = {w: np.array(v, dtype=np.int64).T for w, v in postings.items()}

    def without(self, rows: np.ndarray, shared: list[str]) -> np.ndarray:
        """Codes of ``rows`` with the ``shared`` tokens (and the spaces they leave) blanked out."""
        if not shared:
            return self.codes[rows]
        kept = np.arange(max(int(self.n_tok.max()), 1)) < self.n_tok[rows, None]
        for w in shared:
            hit, token = self.postings[w]
            at = np.searchsorted(hit, rows)          # rows hold every shared token once
            kept[np.arange(len(rows)), token[at]] = False
        last = kept.shape[1] - 1 - np.argmax(kept[:, ::-1], axis=1)
        codes, owner = self.codes[rows], self.owner[rows]
        stays = np.take_along_axis(kept, owner, axis=1)
        stays &= (codes != self.space) | (owner < last[:, None])
        return np.where(stays, codes, 0)


LCS_BITS = 62        # bits of a pattern per uint64: room for a carry


def lcs_many(pattern: str, codes: np.ndarray, alphabet: dict[str, int]) -> np.ndarray:
    """LCS(pattern, each row of codes), bit-parallel over as many uint64 per candidate as
    the pattern needs. Code 0 has an empty match mask, which leaves the state unchanged,
    so padding and blanked characters need no masking."""
    m, n = len(pattern), len(codes)
    words = -(-m // LCS_BITS)
    table = np.zeros((words, len(alphabet) + 2), dtype=np.uint64)
    for q, ch in enumerate(pattern):
        code = alphabet.get(ch)
        if code is not None:
            table[q // LCS_BITS, code] |= np.uint64(1) << np.uint64(q % LCS_BITS)
    full = [np.uint64((1 << min(LCS_BITS, m - w * LCS_BITS)) - 1) for w in range(words)]
    v = [np.full(n, f, dtype=np.uint64) for f in full]
    for col in range(codes.shape[1]):
        c = codes[:, col]
        carry = np.uint64(0)
        for w in range(words):
            u = v[w] & table[w][c]
            total = v[w] + u + carry
            carry = total >> np.uint64(LCS_BITS)
            v[w] = (total | (v[w] - u)) & full[w]
    return m - sum((np.bitwise_count(x).astype(np.int64) for x in v), np.zeros(n, dtype=np.int64))


def scores(m: str, block: StringBlock, alphabet: dict[str, int], keep: np.ndarray | None = None) -> np.ndarray:
    """Exact token-set ratio of ``m`` against every string of the block (vectorised).

    With ``keep`` the strings outside it get -1 where their score would take an LCS.
    """
    n = len(block.idxs)
    ta = sorted(set(m.split()))
    if not ta or n == 0:
        return np.zeros(n)
    n_a, len_a = len(ta), sum(map(len, ta))
    has = np.zeros((n, n_a), dtype=bool)
    for q, w in enumerate(ta):
        hit = block.postings.get(w)
        if hit is not None:
            has[hit[0], q] = True
    inter_n = has.sum(axis=1)
    inter_len = has @ np.array([len(w) for w in ta], dtype=np.int64)
    xn, yn = n_a - inter_n, block.n_tok - inter_n
    i = inter_len + np.maximum(inter_n - 1, 0)
    x = (len_a - inter_len) + np.maximum(xn - 1, 0)
    y = (block.tok_len - inter_len) + np.maximum(yn - 1, 0)
    s = (inter_n > 0).astype(np.int64)
    l1, l2 = i + s + x, i + s + y
    with np.errstate(divide="ignore", invalid="ignore"):
        side = np.where(i > 0, np.maximum(100.0 - 100.0 * (s + x) / (i + l1), 100.0 - 100.0 * (s + y) / (i + l2)),
                        0.0)
        r0_bound = 100.0 - 100.0 * np.abs(x - y) / (l1 + l2)
        score = np.where(r0_bound <= side, side, np.nan)
    score = np.where(block.n_tok == 0, 0.0, score)
    score = np.where((inter_n > 0) & ((xn == 0) | (yn == 0)), 100.0, score)
    if keep is not None:
        score[np.isnan(score) & ~keep] = -1.0
    todo = np.flatnonzero(np.isnan(score))
    if len(todo):   # the rest of the tokens decides: one pass per set of shared tokens
        sets, which = np.unique(has[todo], axis=0, return_inverse=True)
        which = which.ravel()
        for g, shared in enumerate(sets):
            rows = todo[which == g]
            rest = " ".join(w for w, gone in zip(ta, shared) if not gone)
            lcs = lcs_many(rest, block.without(rows, [w for w, gone in zip(ta, shared) if gone]), alphabet)
            r0 = 100.0 - 100.0 * (x[rows] + y[rows] - 2 * lcs) / (l1[rows] + l2[rows])
            score[rows] = np.maximum(r0, side[rows])
    return score


def topk_records(score: np.ndarray, block: StringBlock, k: int) -> list[tuple[float, int]]:
    """Top-k records by (score desc, idx asc): only the k best strings by
    (score, smallest idx) can hold them."""
    if len(score) == 0:
        return []
    order = np.lexsort((block.min_idx, -score))[:k]
    recs = [(float(score[j]), ix) for j in order for ix in block.idxs[j][:k]]
    recs.sort(key=lambda t: (-t[0], t[1]))
    return recs[:k]
