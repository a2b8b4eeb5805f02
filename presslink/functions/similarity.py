"""Token-set similarity (K1), the scorer behind the fuzzy top-k join.

Public definition (token-set ratio over whitespace tokens, no preprocessing):
A, B are the token sets; I = A∩B, X = A\\B, Y = B\\A, each sorted and
space-joined with lengths i, x, y. Empty A or B -> 0. I non-empty and X or Y
empty -> 100. Otherwise with s = (i > 0), d = x + y - 2*LCS(X, Y),
L1 = i + s + x, L2 = i + s + y:
    r0 = 100 - 100*d/(L1+L2)
and, when i > 0, the result is max(r0, 100 - 100*(s+x)/(i+L1), 100 - 100*(s+y)/(i+L2)).

These are small helpers called inside Spark tasks (mapInPandas); Spark
partitions and shuffles the work.
"""

from __future__ import annotations


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence length, bit-parallel over the shorter string."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for ch in a:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def _ratio(dist: int, lensum: int) -> float:
    return 100.0 - 100.0 * dist / lensum if lensum > 0 else 100.0


def token_set_ratio(a: str, b: str) -> float:
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    inter = sorted(ta & tb)
    xa, yb = sorted(ta - tb), sorted(tb - ta)
    if inter and (not xa or not yb):
        return 100.0
    sx, sy, si = " ".join(xa), " ".join(yb), " ".join(inter)
    x, y, i = len(sx), len(sy), len(si)
    s = 1 if i else 0
    l1, l2 = i + s + x, i + s + y
    r0 = _ratio(x + y - 2 * lcs_length(sx, sy), l1 + l2)
    if not i:
        return r0
    return max(r0, _ratio(s + x, i + l1), _ratio(s + y, i + l2))
