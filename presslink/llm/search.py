"""Ranked lexical search, reversed: the items are the index and the documents the stream.

The index holds the items' terms only: term -> (item, occurrences). It is broadcast, in blocks of at most
``BLOCK_ITEMS`` items and about ``BLOCK_BYTES`` bytes of item text, so its size has a bound however many
items there are; each block takes its own pass over the documents. A first stream counts what the weights
need (documents, terms, documents per item term); a second one scores every document against the items that
share a term with it and updates a heap of ``k`` rows per item in each task. The heaps are merged in Spark in
two steps, first those of tasks with the same share, so that no task reads the heaps of all tasks.

A term is a run of bytes that are digits, letters or above 0x7F (A-Z lower-cased); terms are found by hash and
compared byte by byte, so two terms never mix.

Defined cases: null or empty text has no term and is never found, such an item finds nothing; rows that repeat
a document id are documents of their own; rows that repeat an item (id and text) each get the full result; equal
scores go by ascending id, null ids last; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from presslink.llm.common import LOWER, column_bytes, pieces, word_hashes, word_spans

BLOCK_ITEMS = 4_096
BLOCK_BYTES = 32 << 20
STEP_BYTES = 1 << 20
STEP_POSTINGS = 2 << 20        # postings followed at once
SHARES = 256

#: Bytes that separate terms.
SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[0x30:0x3A] = SEPARATOR[0x41:0x5B] = SEPARATOR[0x61:0x7B] = SEPARATOR[0x80:] = False


@dataclass(frozen=True)
class Index:
    """Terms of a block of items, in order of their hashes, and where they occur."""

    hashes: np.ndarray
    raw: np.ndarray            # the terms' bytes
    begin: np.ndarray          # term -> its place in ``raw`` (terms + 1)
    first: np.ndarray          # term -> its first posting (terms + 1)
    item: np.ndarray           # posting -> item
    times: np.ndarray          # posting -> occurrences in the item
    items: int


def build_index(texts: list[str | None]) -> Index:
    column = pa.array([t or "" for t in texts], pa.large_string())
    raw, offsets = column_bytes(column)
    raw = LOWER[raw]
    start, end, before = word_spans(raw, offsets, SEPARATOR)
    found: dict[bytes, dict[int, int]] = {}
    data = raw.tobytes()
    owner = np.repeat(np.arange(len(texts)), np.diff(before)).tolist()
    for s, e, i in zip(start.tolist(), end.tolist(), owner):
        own = found.setdefault(data[s:e], {})
        own[i] = own.get(i, 0) + 1
    terms = list(found)
    ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
    begin = np.concatenate([[0], ends]).astype(np.int64)
    hashes = word_hashes(np.frombuffer(b"".join(terms), np.uint8), begin[:-1], begin[1:])
    order = np.argsort(hashes, kind="stable")
    terms = [terms[i] for i in order]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
    postings = [sorted(found[t].items()) for t in terms]
    flat = [p for own in postings for p in own]
    return Index(hashes[order], np.frombuffer(b"".join(terms), np.uint8), begin,
                 np.concatenate([[0], np.cumsum([len(p) for p in postings])]).astype(np.int64),
                 np.array([p[0] for p in flat], np.int64), np.array([p[1] for p in flat], np.int64), len(texts))


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), first[1], ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(first - (ends - n), n)


def term_counts(raw: np.ndarray, offsets: np.ndarray, index: Index):
    """Number of terms of each text, and (text, index term, occurrences) of the index terms in them."""
    low = LOWER[raw]
    start, end, before = word_spans(low, offsets, SEPARATOR)
    n = np.diff(before)
    none = np.zeros(0, np.int64)
    if not len(start) or not len(index.hashes):
        return n, none, none, none
    at = np.searchsorted(index.hashes, h := word_hashes(low, start, end))
    at[at == len(index.hashes)] = 0
    hit = np.flatnonzero((index.hashes[at] == h) & (np.diff(index.begin)[at] == end - start))
    term = at[hit]
    if len(hit):                                           # the bytes decide, not the hash
        size = (end - start)[hit]
        same = low[_spread(start[hit], size)] == index.raw[_spread(index.begin[term], size)]
        good = np.logical_and.reduceat(same, np.cumsum(size) - size)
        hit, term = hit[good], term[good]
    text = np.searchsorted(before, hit, side="right") - 1
    cell, times = np.unique(text * len(index.hashes) + term, return_counts=True)
    return n, cell // len(index.hashes), cell % len(index.hashes), times


def _statistics(index):
    def run(batches):
        texts = terms = 0
        df = np.zeros(len(index.value.hashes), np.int64)
        for b in batches:
            raw, offsets = column_bytes(b.column(0))
            for lo, hi in pieces(offsets, STEP_BYTES):
                at = offsets[lo]
                n, _, term, _ = term_counts(raw[at:offsets[hi]], offsets[lo:hi + 1] - at, index.value)
                texts += int((n > 0).sum())
                terms += int(n.sum())
                df += np.bincount(term, minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at]).astype(np.int32)),
                                          pa.array(np.concatenate([[texts, terms], df[at]]).astype(np.int64))], names=["term", "n"])

    return run


class Heaps:
    """The ``k`` best rows of each item: highest score, then smallest id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.own: list[list] = [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)             # no row below this score can enter

    def add(self, ids: list, scores: np.ndarray):
        text, item = np.nonzero((scores > 0) & (scores >= self.least))
        for t, i, s in zip(text.tolist(), item.tolist(), scores[text, item].tolist()):
            heap, doc = self.own[i], ids[t]
            row = (s, doc is not None, -doc if doc is not None else 0)
            if len(heap) < self.k:
                heapq.heappush(heap, row)
            elif row > heap[0]:
                heapq.heapreplace(heap, row)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def batch(self, share: int) -> pa.RecordBatch:
        rows = [(i, -d if known else None, s) for i, heap in enumerate(self.own) for s, known, d in heap]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([share] * len(rows), pa.int32())],
            names=["item", "doc_id", "score", "share"])


def score_texts(raw: np.ndarray, offsets: np.ndarray, index: Index, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Scores, texts x items."""
    n, text, term, tf = term_counts(raw, offsets, index)
    scores = np.zeros((len(n), index.items), np.int64)
    if not len(text):
        return scores
    m = np.array([100 - 25 + 25 * x * n_docs // n_terms for x in n.tolist()], np.int64)      # Python's integers: no overflow
    part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[text]))
    size = np.diff(index.first)[term]
    ends = np.cumsum(size)
    flat = scores.reshape(-1)
    at = 0
    while at < len(text):
        to = max(int(np.searchsorted(ends, ends[at] - size[at] + STEP_POSTINGS, side="right")), at + 1)
        posting = _spread(index.first[term[at:to]], size[at:to])
        np.add.at(flat, np.repeat(text[at:to], size[at:to]) * index.items + index.item[posting],
                  np.repeat(part[at:to], size[at:to]) * index.times[posting])
        at = to
    return scores


def _search(index, weight, n_docs: int, n_terms: int, k: int):
    def run(batches):
        heaps = Heaps(index.value.items, k)
        for b in batches:
            raw, offsets = column_bytes(b.column(0))
            ids = b.column(1).to_pylist()
            for lo, hi in pieces(offsets, STEP_BYTES):
                step = max(1, STEP_POSTINGS // max(index.value.items, 1))        # bounds texts x items
                for first in range(lo, hi, step):
                    last = min(first + step, hi)
                    at = offsets[first]
                    heaps.add(ids[first:last], score_texts(raw[at:offsets[last]], offsets[first:last + 1] - at, index.value,
                                                           weight.value, n_docs, n_terms))
        yield heaps.batch(TaskContext.get().partitionId() % SHARES)

    return run


def _best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of each item with the highest scores above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    wanted = (items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
              .groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies")))
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size.n / BLOCK_ITEMS), math.ceil(size.bytes / BLOCK_BYTES))
    out = None
    for b in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(build_index([r.text for r in block]))
        sums = dict(rows.select("text").mapInArrow(_statistics(index), "term int, n long").groupBy("term").agg(F.sum("n"))
                    .collect())                            # one row per index term
        n_docs, n_terms = sums.get(-1, 0), sums.get(-2, 0)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sums.get(t, 0) + 1)))
                           for t in range(len(index.value.hashes))], np.int64)
        heaps = rows.mapInArrow(_search(index, spark.sparkContext.broadcast(weight), n_docs, n_terms, k),
                                "item int, doc_id long, score long, share int")
        best = _best(_best(heaps, ["item", "share"], k).drop("rank"), ["item"], k)
        schema = StructType().add("item", IntegerType()).add("item_id", wanted.schema["item_id"].dataType).add("copies", LongType())
        names = spark.createDataFrame([(i, r.item_id, r.copies) for i, r in enumerate(block)], schema)
        found = (best.join(F.broadcast(names), "item")
                 .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
                 .select("item_id", "rank", "doc_id", "score"))
        out = found if out is None else out.unionAll(found)
    return out


ORACLE_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), i AS (
  SELECT item_id, term, count(*) AS qtf
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), s AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0
), tf AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs
), m AS (
  SELECT r, doc_id, (100 - 25 + ((25 * len(t) * n_docs) // n_terms))::BIGINT AS m FROM d, s WHERE len(t) > 0
), scored AS (
  SELECT item_id, doc_id, r, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM tf JOIN i USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
