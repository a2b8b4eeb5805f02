"""Language identification: multinomial naive Bayes over hashed character n-grams.

``train`` counts the n-grams (1 to 3 characters, lower case, everything but letters read as one blank)
of all labelled texts in hashed bins inside tasks, sums the counts in Spark, and builds the matrix of log
probabilities on the driver: languages x ``BINS`` numbers, so its size is bounded by the number of
languages (checked). ``predict`` broadcasts the matrix and scores whole texts in bounded steps.

Defined cases: null text, or text without a letter, is ``und`` with score 0; such texts and rows with a
null label do not train; repeated rows count as often as they occur; with no labelled text everything
is ``und``; an empty table gives no rows; other columns are ignored. The score is the posterior
probability of the language (ties: the first language in code-point order).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1 << 15
ORDERS = (1, 2, 3)
SEGMENT = 1 << 18              # characters per step
MAX_LANGUAGES = 512            # 512 x 32,768 x 4 bytes: 64 MB are broadcast at most
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray       # languages x BINS


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point to its lower-case letter, 32 if it is no letter."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _blocks(texts: list[str | None], most: int = SEGMENT):
    """Segments of padded texts in groups: lists of (text number, characters, number of starts that count)."""
    group, size = [], 0
    table = letters()
    for i, t in enumerate(texts):
        if not t:
            continue
        cp = table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not (cp != 32).any():
            continue
        cp = np.concatenate([[32], cp, [32]]).astype(np.uint32)
        for at in range(0, len(cp), most):
            own = cp[at:at + most + max(ORDERS) - 1]
            group.append((i, own, min(most, len(cp) - at)))
            size += len(own)
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


def _bins(group) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bin) of every n-gram of a group that is not blank, in order of text and order n."""
    cp = np.concatenate([x for _, x, _ in group]).astype(np.uint64)
    lens = np.array([len(x) for _, x, _ in group])
    end = np.cumsum(lens)
    begin = end - lens
    starts = np.array([n for _, _, n in group])
    pos = np.arange(len(cp))
    limit = np.repeat(begin + starts, lens)
    stop = np.repeat(end, lens)
    text = np.repeat(np.array([i for i, _, _ in group]), lens)
    out_t, out_b = [], []
    h = np.zeros(len(cp), dtype=np.uint64)
    blank = np.ones(len(cp), dtype=bool)
    for n in ORDERS:
        shifted = np.zeros(len(cp), dtype=np.uint64)
        shifted[:len(cp) - n + 1] = cp[n - 1:]
        h = (h + shifted + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        blank &= shifted == 32
        ok = (pos < limit) & (pos + n <= stop) & ~blank
        out_t.append(text[ok])
        out_b.append(((h[ok] ^ (h[ok] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int32))
    return np.concatenate(out_t), np.concatenate(out_b)


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}

    def rows():
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            n = len(at) + 1                       # bin -1: number of texts
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array(np.concatenate([[-1], at]).astype(np.int32)),
                 pa.array(np.concatenate([[texts[lang]], c[at]]).astype(np.int64))], names=["lang", "bin", "n"])

    for b in batches:
        lang, text = b.column(0).to_pylist(), b.column(1).to_pylist()
        for group in _blocks(text):
            which, bins = _bins(group)
            names = {i: lang[i] for i, _, _ in group}
            for name in set(names.values()):
                own = [i for i, x in names.items() if x == name]
                c = counts.setdefault(name, np.zeros(BINS, dtype=np.int64))
                c += np.bincount(bins[np.isin(which, own)] if len(set(names.values())) > 1 else bins, minlength=BINS)
        for i, t in enumerate(text):
            if t and any(ch.isalpha() for ch in t):
                texts[lang[i]] = texts.get(lang[i], 0) + 1
        if len(counts) > 64:
            yield from rows()
            counts.clear()
            texts.clear()
    yield from rows()


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", alpha: float = 1.0) -> Model:
    """A model from all rows of ``docs`` with a label and a letter."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sums = rows.mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    per_language = (sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("c")).limit(MAX_LANGUAGES + 1)
                    .collect())                   # at most BINS + 1 numbers each
    if len(per_language) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the matrix would not fit a broadcast")
    found = sorted((r.lang, r.c) for r in per_language)
    langs = tuple(x for x, _ in found)
    counts = np.zeros((len(langs), BINS))
    docs_of = np.zeros(len(langs))
    for i, (_, c) in enumerate(found):
        for x in c:
            if x.bin < 0:
                docs_of[i] = x.n
            else:
                counts[i, x.bin] = x.n
    counts += alpha
    log_prob = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True)) if len(langs) else counts
    prior = np.log(docs_of) - np.log(docs_of.sum()) if len(langs) else docs_of
    return Model(langs, prior, np.ascontiguousarray(log_prob.astype(np.float32)))


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and posterior probability of each whole text."""
    n, k = len(texts), len(model.languages)
    total = np.zeros((k, n))
    seen = np.zeros(n, dtype=bool)
    for group in _blocks(texts):
        which, bins = _bins(group)
        lo, hi = group[0][0], group[-1][0] + 1
        seen[[i for i, _, _ in group]] = True
        cell, times = np.unique((which - lo).astype(np.int64) * BINS + bins, return_counts=True)   # sparse counts
        row, column = cell // BINS, cell % BINS
        for j in range(k):
            total[j, lo:hi] += np.bincount(row, weights=times * model.log_prob[j, column].astype(np.float64), minlength=hi - lo)
    if not k:
        return [UNKNOWN] * n, [0.0] * n
    total += model.log_prior[:, None]
    best = total.argmax(axis=0)
    score = 1.0 / np.exp(total - total.max(axis=0)).sum(axis=0)
    return ([model.languages[b] if s else UNKNOWN for b, s in zip(best, seen)], np.where(seen, score, 0.0).tolist())


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("_text"))
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(rows.schema.fields[:-1]).add("lang_pred", StringType()).add("score", DoubleType())

    def run(batches):
        for b in batches:
            lang, score = score_texts(shared.value, b.column("_text").to_pylist())
            columns = [b.column(i) for i in range(len(keep))] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``, is 0 (a null id: as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
