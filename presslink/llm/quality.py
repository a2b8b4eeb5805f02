"""Quality rules, line first.

Every line that has a word is judged by its own rules; failing lines go, then a document goes that is
too short, repeats itself, or has lost too much of its text:

* *symbols*: more than a third of the line's words end in or consist of marks (``$$$``, ``!!``), or the line is
  written in capitals with such marks;
* *navigation*: short items between ``|``, ``»``, ``>`` or bullets: two or more separators, one for every
  ``NAV_WORDS`` words or fewer;
* *boilerplate*: known phrases of notices, consents and placeholders, in a short line;
* *punctuation*: a line of prose length (``PROSE_WORDS`` words or more) without a sentence end or other closing
  mark anywhere in it. A short line without one is a heading and stays.

Defined cases: a null or blank text has no words and fails the base rule; an empty table gives no rows;
repeated rows give repeated rows; other columns are ignored. Texts of any length are one value of a task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30                # percent of words in repeated windows
MAX_LOST = 0.5                 # share of word characters in removed lines
NAV_WORDS = 3
PROSE_WORDS = 12
BOILERPLATE_WORDS = 30
#: Phrases of notices, consents and placeholders (lower case).
BOILERPLATE = ("all rights reserved", "cookie policy", "we use cookies", "accept cookies", "privacy policy", "terms of use",
               "terms of service", "terms and conditions", "enable javascript", "javascript is disabled", "javascript is required",
               "lorem ipsum", "subscribe to our newsletter", "sign up for our newsletter", "click here to", "skip to content",
               "back to top", "powered by wordpress", "share this article", "read more", "log in or register")
_BOILERPLATE = re.compile("|".join(re.escape(p) for p in BOILERPLATE))
_SEPARATOR = re.compile(r"(?:^|\s)[|»›>•·](?=\s|$)")
_SENTENCE = re.compile(r"[.!?…。！？:;](?:[\"'”’)\]]*)(?:\s|$)")
_MARKS = re.compile(r"[#*$%&<>=~^_+\\/@!|»›•·]")            # without any of these the first two rules cannot fail
_MARKED = re.compile(r"[#*$%&<>=~^_+\\/@]{2,}$|!!+$")


def line_rule(line: str, n: int) -> str | None:
    """The rule that a line with ``n`` words (1 or more) fails, or None."""
    if _MARKS.search(line):
        if 3 * sum(1 for w in line.split() if _MARKED.search(w)) > n:
            return "symbols"
        separators = len(_SEPARATOR.findall(line))
        if separators >= 2 and n - separators <= NAV_WORDS * (separators + 1):
            return "navigation"
    if n <= BOILERPLATE_WORDS and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if n >= PROSE_WORDS and "," not in line and not _SENTENCE.search(line):
        return "punctuation"
    return None


def _spaces(text: str) -> int:
    return sum(map(text.count, " \t\n\v\f\r"))


def repeat_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    # windows by rank doubling: equal rank, equal words
    rank, length = ids, 1
    while length < size:
        step = min(length, size - length)
        pair = rank[:len(rank) - step] * (rank.max() + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        length += step
    count = np.bincount(rank)
    if count.max() < 2:
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(count[rank] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(text: str | None, max_lost: float = MAX_LOST) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, failed lines, clean text)."""
    text = text or ""
    n_words = n_dup = lost = failed = 0
    seen: set[str] = set()
    all_words: list[bytes] = []
    clean = []
    for line in text.split("\n"):
        raw = line.encode("utf-8", "surrogatepass").split()               # the contract's separators, exactly
        if not raw:
            clean.append(line)
            continue
        n_dup += line in seen
        seen.add(line)
        n_words += len(raw)
        all_words += raw
        if line_rule(line, len(raw)) is None:
            clean.append(line)
        else:
            lost += len(line) - _spaces(line)
            failed += 1
    word_chars = len(text) - _spaces(text)
    repeats = repeat_words(all_words)
    base_failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT * n_words
    kept = not base_failed and lost <= max_lost * word_chars
    return (n_words, word_chars, len(SYMBOLS.findall(text)), n_dup, repeats, base_failed, kept, lost, failed, "\n".join(clean))


COLUMNS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
           ("base_failed", "boolean"), ("kept", "boolean"), ("lost_chars", "long"), ("n_failed_lines", "long"), ("clean_text", "string"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST,
          with_text: bool = True) -> DataFrame:
    """``id``, the counts, the verdict and (``with_text``) the text without its failing lines, per row."""
    fields = COLUMNS if with_text else COLUMNS[:-1]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches):
        for b in batches:
            got = [judge(t, max_lost) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[j] for g in got], types[t]) for j, (_, t) in enumerate(fields))],
                                             names=["id", *(n for n, _ in fields)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{n} {t}" for n, t in fields))
