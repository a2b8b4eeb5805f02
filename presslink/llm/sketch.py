"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's sketch holds the ``k`` smallest distinct 64-bit hashes of its 5-word shingles (fewer words: one
shingle of all; no word: none). Sketches of parts merge by keeping the k smallest of their union, and give
estimates of resemblance, containment and the number of distinct shingles (exact below k).

``with_next`` pairs every document with the next one in ascending order of id: texts are dealt once into
ranges of ids and sorted inside them; the first document of each range is also sent to the range before
it, so no task needs more than its own range and whole texts move once.

Defined cases: a null text is empty; two empty sketches are alike (1), an empty and a non-empty one are not
(0); rows with equal ids are ordered by their text; null ids come last; the next of the last document is the
first (of a single document: itself); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslink.llm.common import pieces, shingle_hashes, word_hashes, word_spans

K = 256
SHINGLE = 5
STEP_BYTES = 1 << 20
RANGE_BYTES = 8 << 20


def sketches(texts: list[str], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct bottom-k hashes of each whole text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    out = []
    for s, e in pieces(offsets, STEP_BYTES):
        raw = np.frombuffer(b"".join(data[s:e]), np.uint8)
        start, end, first = word_spans(raw, offsets[s:e + 1] - offsets[s])
        words = word_hashes(raw, start, end)
        runs = shingle_hashes(words, shingle)
        for i in range(e - s):
            a, b = first[i], first[i + 1]
            own = runs[a:b - shingle + 1] if b - a >= shingle else shingle_hashes(words[a:b], max(1, b - a))
            if len(own) > 8 * k:                                     # the smallest 4k include k distinct ones, mostly
                low = np.unique(np.partition(own, 4 * k)[:4 * k])
                own = low if len(low) >= k else own
            out.append(np.unique(own)[:k])
    return out


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact if the sketch is not full, else from its largest hash."""
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) / (float(sketch[k - 1]) + 1.0) * 2.0 ** 64


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a) and not len(b):
        return 1.0
    x, y = set(a.tolist()), set(b.tolist())
    both = x & y
    if not both:
        return 0.0
    union = x | y
    if len(union) <= k:
        return len(both) / len(union)
    limit = sorted(union)[k - 1]
    return sum(1 for h in both if h <= limit) / k


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return min(1.0, j / (1 + j) * (na + nb) / na)


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                     shingle: int = SHINGLE) -> DataFrame:
    """``id, n_shingles`` (distinct, estimated) and ``sketch`` per row."""

    def run(batches):
        for b in batches:
            got = sketches([t or "" for t in b.column(1).to_pylist()], k, shingle)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([distinct_count(x, k) for x in got], pa.float64()),
                 pa.array([to_text(x) for x in got], pa.string())], names=["id", "n_shingles", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles double, sketch string")


def merge_by(sketched: DataFrame, by: str, k: int = K) -> DataFrame:
    """One sketch per value of ``by``: each task merges its own rows first, so a hot group sends one row per task."""

    def partial(batches):
        have: dict = {}
        for b in batches:
            for g, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = from_text(s)
                have[g] = merge(have[g], x, k) if g in have else x
            if len(have) > 50_000:
                yield rows(have)
                have = {}
        yield rows(have)

    def rows(have):
        return pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()),
                                           pa.array([to_text(x) for x in have.values()], pa.string())], names=["g", "sketch"])

    def final(key, batches):
        now = np.zeros(0, np.uint64)
        for s in batches.column("sketch").to_pylist():
            now = merge(now, from_text(s), k)
        return pa.table({"g": [key[0].as_py()], "n_shingles": [distinct_count(now, k)], "sketch": [to_text(now)]},
                        schema=pa.schema([("g", pa.string()), ("n_shingles", pa.float64()), ("sketch", pa.string())]))

    part = sketched.select(F.col(by).cast("string").alias("g"), "sketch").mapInArrow(partial, "g string, sketch string")
    return part.groupBy("g").applyInArrow(final, "g string, n_shingles double, sketch string").withColumnRenamed("g", by)


def _ranges(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their range of ids, the first row of each range, and the number of ranges."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(1 + total // RANGE_BYTES, 20_000))
    # any bounds are right, they only balance the ranges; at most 20,000 numbers
    bounds = np.unique(np.array(rows.approxQuantile("id", [i / n for i in range(1, n)], max(0.25 / n, 1e-4)) if n > 1 else [],
                                dtype=np.float64))

    @F.pandas_udf("int")
    def range_of(ids):
        import pandas as pd

        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(bounds) + 1, dtype=np.int32)          # null ids: after all others
        out[known] = np.searchsorted(bounds, ids.to_numpy()[known].astype(np.float64), side="right")
        return pd.Series(out)

    rows = rows.withColumn("r", range_of("id"))
    least = rows.groupBy("r").agg(F.min("id").alias("lead"))                # at most 20,001 rows
    heads = (rows.join(F.broadcast(least.withColumnRenamed("r", "_r")), (F.col("r") == F.col("_r")) & F.col("id").eqNullSafe(F.col("lead")))
             .groupBy("r").agg(F.first("lead").alias("id"), F.min("text").alias("text")))
    return rows, heads, len(bounds) + 1


PAIR = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_shingles double, edited_containment double")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Each document's sketch, that of the document with its second half replaced by the beginning of the next
    document, and their likeness to each other and to the next document."""
    rows, heads, n = _ranges(docs, id_col, text_col)
    order = sorted(r.r for r in heads.select("r").collect())                # the ranges that have rows
    if not order:
        return docs.sparkSession.createDataFrame([], PAIR)
    before = dict(zip(order, order[-1:] + order[:-1]))
    previous = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("r")] if len(order) <= 64 else None
    if previous is None:
        table = docs.sparkSession.createDataFrame(list(before.items()), "r int, p int")
        moved = heads.join(F.broadcast(table), "r").select("id", "text", F.col("p").alias("r"))
    else:
        moved = heads.select("id", "text", previous.alias("r"))
    both = rows.select("r", "id", "text", F.lit(0).alias("guest")).unionByName(
        moved.select("r", "id", "text", F.lit(1).alias("guest")))
    dealt = (both.repartition(max(n, 1), "r")
             .sortWithinPartitions("r", "guest", F.col("id").asc_nulls_last(), "text"))

    def run(batches):
        held: list = []                                                    # the last rows seen: (r, id, text, guest)
        for b in batches:
            held += zip(*(b.column(c).to_pylist() for c in ("r", "id", "text", "guest")))
            if len(held) > 1:
                yield answer(held)
                held = held[-1:]

    def answer(rows):
        """All but the last row, each with the row after it."""
        at = [i for i in range(len(rows) - 1) if not rows[i][3]]
        texts, edited = [r[2] for r in rows], []
        for i in at:
            half = len(texts[i]) // 2
            edited.append(texts[i][:len(texts[i]) - half] + texts[i + 1][:half])
        own, other = sketches(texts, k, shingle), sketches(edited, k, shingle)
        out = [(rows[i][1], len(texts[i]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own[i]), to_text(x),
                resemblance(own[i], x, k), resemblance(own[i], own[i + 1], k), distinct_count(own[i], k), containment(own[i], x, k))
               for i, e, x in zip(at, edited, other)]
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles",
                 "edited_containment"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=names)

    return dealt.select("r", "id", "text", "guest").mapInArrow(run, PAIR)


def text_sketch(column: str) -> Column:
    """The sketch of a text column as an expression (for use beside other columns)."""

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd

        return pd.Series([to_text(x) for x in sketches([t or "" for t in texts.tolist()])])

    return run(F.col(column))
