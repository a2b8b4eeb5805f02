"""Exact top-k strings by token-set ratio (K1) without scoring all pairs.

With A and B the sorted, joined token sets, i the length of what they share and O the characters they have in common
(as bags), a pair's score is at most the greater of

* ``200 * O / (|A| + |B|)``: the ratio of the rest is an LCS ratio, and an LCS is no longer than the common bag;
* ``200 * i / (i + min(|A|, |B|))``: the ratio of the shared tokens alone. If t is the rarest shared token, i is at most
  the length of t and all commoner tokens, on both sides.

So two indexes over the contributor strings answer everything, both tables of *blocks* of at most ``BLOCK`` strings:

* bag blocks: strings of similar length and letters; the directory has the greatest count of each letter and the
  least length in a block. It is broadcast: blocks grow when there would be more than ``MAX_BLOCKS`` of them;
* token blocks: per token t, the strings of length |B| whose tokens from t on to the commonest have length W.
  The directory has one row per token, joined by token; the tokens that very many mentions hold are dealt.

Each mention string starts with its best ``SEED_BLOCKS`` bag blocks, which gives a k-th score. Then it meets only
those token blocks, and after that only those bag blocks, whose bound is not below the k-th score so far; within
a block only strings whose own bound reaches it are scored. Pairs of score 0 need no search: only the k
smallest record ids of a field can stand for them.
"""

from __future__ import annotations

import math
import string
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslink.operators.strings import StringBlock, scores, topk_records
from presslink.session import cores, materialize

BLOCK = 128                  # strings of a block, unless there are too many blocks
MAX_BLOCKS = 100_000         # bag blocks in the broadcast directory: at most 20 MB
BLOCK_CHARS = 1 << 20        # characters of a block, if each string were as long as its longest
SEED_BLOCKS = 2
KEPT_BLOCKS = 256            # blocks that a task keeps prepared
SMALL = 4_096                # contributor strings that need no index
HOT_ROWS = 100_000           # mention rows of one token that go to one task
SLACK = 1e-9                 # bounds and scores are floating-point numbers

_COLUMN = {c: i for i, c in enumerate(string.ascii_lowercase + string.digits + " ")}
_OTHERS = 11                 # all other characters share these columns
COLUMNS = len(_COLUMN) + _OTHERS
#: Letters from rare to frequent: strings with the same rare letters become neighbours.
_BY_RARITY = "jqxzwvkfybhpgmcdulonrtisae"


def token_form(s: str) -> str:
    return " ".join(sorted(set(s.split())))


def bag(s: str) -> np.ndarray:
    """Characters of a string per column."""
    out = np.zeros(COLUMNS, np.int32)
    for ch in s:
        out[_COLUMN.get(ch, len(_COLUMN) + ord(ch) % _OTHERS)] += 1
    return out


def bag_bound(counts: np.ndarray, length: int, columns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bound by common characters; ``columns``: (COLUMNS, n) greatest counts, ``lengths``: least lengths."""
    common = np.zeros(len(lengths), np.int64)
    for j in np.flatnonzero(counts):
        common += np.minimum(columns[j], counts[j])
    return 200.0 * common / np.maximum(length + lengths, 1)


# -- the two indexes ------------------------------------------------------------------------------

def _sort_key(batches):
    for pdf in batches:
        forms = [token_form(c) for c in pdf["c"]]
        yield pd.DataFrame({"field": pdf["field"], "c": pdf["c"], "idxs": pdf["idxs"], "len": [len(f) for f in forms],
                            "key": ["".join("1" if ch in f else "0" for ch in _BY_RARITY) for f in forms]})


def _cut_bag_blocks(size: int):
    def run(batches):
        field, own, longest = None, [], 0

        def block():
            bags = np.array([bag(token_form(c)) for c, _ in own])
            return pd.DataFrame({"field": [field], "strings": [[c for c, _ in own]], "idxs": [[list(x) for _, x in own]],
                                 "env": [bags.max(axis=0).tolist()], "least": [int(bags.sum(axis=1).min())]})

        for pdf in batches:
            for f, c, idxs in zip(pdf["field"], pdf["c"], pdf["idxs"]):
                longest = max(longest, len(c))
                if own and (f != field or len(own) >= size or (len(own) + 1) * longest > max(BLOCK_CHARS, 64 * size)):
                    yield block()
                    own, longest = [], len(c)
                field = f
                own.append((c, idxs))
        if own:
            yield block()

    return run


def bag_blocks(cands: DataFrame, n_strings: int, block: int = BLOCK) -> DataFrame:
    """``block, field, strings, idxs, env, least``: neighbours in length and letters, ``block`` strings each."""
    size = max(block, math.ceil(2 * n_strings / MAX_BLOCKS))
    parts = max(1, math.ceil(n_strings / max(50 * size, 50_000)))
    sorted_ = (cands.mapInPandas(_sort_key, "field string, c string, idxs array<long>, len int, key string")
               .withColumn("_l", F.expr("len div 6")).repartitionByRange(parts, "field", "_l", "key", "c")
               .sortWithinPartitions("field", "_l", "key", "c"))
    cut = sorted_.mapInPandas(_cut_bag_blocks(size), "field string, strings array<string>, idxs array<array<long>>, "
                                                     "env array<int>, least int")
    return materialize(cut.withColumn("block", F.monotonically_increasing_id()))


def token_order(cands: DataFrame) -> DataFrame:
    """``field, c, idxs, ranked``: a string's tokens from the rarest to the commonest with the length of the rest from each."""
    tokens = cands.select("field", "c", F.explode(F.array_distinct(F.split("c", r"\s+"))).alias("t")).filter(F.col("t") != "")
    df = tokens.groupBy("field", "t").agg(F.count(F.lit(1)).alias("df"))
    return tokens.join(df, ["field", "t"])


def _with_rest(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ``rest``: joined length of the tokens of a string from this one on to the commonest."""
    w = Window.partitionBy(*keys).orderBy(F.col("df").desc(), F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("rest", (F.sum(F.length("t") + 1).over(w) - 1).cast("int"))


def token_blocks(cands: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Blocks ``field, t, rest, len, part, strings, idxs``, and the directory ``field, t, df, spans`` (``rest, len, parts``)."""
    whole = Window.partitionBy("field", "c")
    per_place = materialize(_with_rest(token_order(cands), "field", "c").withColumn(
        "len", (F.sum(F.length("t") + 1).over(whole) - 1).cast("int")))
    # several parts per place of a frequent token; a part is a hash range, so none is collected whole
    sizes = per_place.groupBy("field", "t", "rest", "len").agg(
        F.count(F.lit(1)).alias("n"), F.first("df").alias("df")).withColumn(
        "parts", F.ceil(F.col("n") / F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"{BLOCK_CHARS} div len")))).cast("int"))
    place = ["field", "t", "rest", "len"]
    dealt = (per_place.drop("df").join(sizes.select(*place, "parts"), place)
             .withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
             .join(cands, ["field", "c"]))
    blocks = dealt.groupBy(*place, "part").agg(F.sort_array(F.collect_list(F.struct("c", "idxs"))).alias("own")).select(
        *place, "part", F.col("own.c").alias("strings"), F.col("own.idxs").alias("idxs"))
    directory = sizes.groupBy("field", "t").agg(F.first("df").alias("df"), F.collect_list(F.struct("rest", "len", "parts")).alias("spans"))
    return blocks, directory


# -- what a mention meets -------------------------------------------------------------------------

def _meet_bags(directory, seeds: bool):
    """(m, field, block) of the bag blocks that a mention starts with, or of the others that may hold a better string."""
    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                form = token_form(row.m)
                counts = bag(form)
                for field, (ids, columns, lengths) in directory.value.items():
                    if not seeds and field != row.field:
                        continue
                    bound = bag_bound(counts, len(form), columns, lengths)
                    first = np.lexsort((ids, -bound))[:SEED_BLOCKS]
                    if seeds:
                        chosen = first[bound[first] > 0]
                    else:
                        far = (bound > 0) & (bound >= row.floor - SLACK)
                        far[first] = False
                        chosen = np.flatnonzero(far)
                    out += [(row.m, field, int(ids[j]), 0.0 if seeds else row.floor) for j in chosen]
            yield pd.DataFrame(out, columns=["m", "field", "block", "floor"]).astype({"block": "int64", "floor": "float64"})

    return run


def _score_rows(k: int, bounded: bool, scored):
    """Rows ``m, field, floor, key, strings, idxs`` -> the best ``k`` records of each row."""
    def run(batches):
        alphabet: dict[str, int] = {}
        kept: OrderedDict = OrderedDict()
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                got = kept.get(row.key)
                if got is None:
                    strings = list(row.strings)
                    forms = [token_form(c) for c in strings]
                    got = (StringBlock(strings, [list(x) for x in row.idxs], alphabet), np.array([bag(f) for f in forms]).T,
                           np.array([len(f) for f in forms]))
                    kept[row.key] = got
                    if len(kept) > KEPT_BLOCKS:
                        kept.popitem(last=False)
                block, columns, lengths = got
                keep = None
                if bounded:
                    form = token_form(row.m)
                    bound = bag_bound(bag(form), len(form), columns, lengths)
                    keep = (bound > 0) & (bound >= row.floor - SLACK)
                own = scores(row.m, block, alphabet, keep)
                if scored is not None:
                    scored.add(int(len(own) if keep is None else keep.sum()))
                out += [(row.m, row.field, i, s) for s, i in topk_records(own, block, k) if s > 0]
            yield pd.DataFrame(out, columns=["m", "field", "idx", "score"]).astype({"idx": "int64", "score": "float64"})

    return run


_FOUND = "m string, field string, idx long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    """A record may be found by several blocks: once each, then the ``k`` best."""
    w = Window.partitionBy("m", "field").orderBy(F.col("score").desc(), F.col("idx"))
    # equal rows share a dense rank, so that one exchange serves both steps
    return found.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= k).dropDuplicates(["m", "field", "idx"])


def _floors(mentions: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The k-th score so far of every mention string and field, 0 with fewer records."""
    kth = best.filter(F.col("rank") == k).select("m", "field", "score")
    return mentions.join(kth, ["m", "field"], "left").select("m", "field", F.coalesce("score", F.lit(0.0)).alias("floor"))


def _against_all(strings, k: int, scored):
    """Mention strings -> their ``k`` best records of each field, ranked, from all strings of the field."""
    def run(batches):
        alphabet: dict[str, int] = {}
        fields: dict[str, list[StringBlock]] = {}
        for field, own in strings.value.items():
            own = sorted(own, key=lambda x: len(x[0]))     # a block's matrix is as wide as its longest string
            fields[field] = [StringBlock([c for c, _ in own[i:i + 512]], [x for _, x in own[i:i + 512]], alphabet)
                             for i in range(0, len(own), 512)]
        for pdf in batches:
            out = []
            for m in pdf["m"]:
                for field, blocks in fields.items():
                    found = sorted((r for b in blocks for r in topk_records(scores(m, b, alphabet), b, k)), key=lambda r: (-r[0], r[1]))
                    out += [(m, field, i, s, n + 1) for n, (s, i) in enumerate(found[:k])]
                    if scored is not None:
                        scored.add(sum(len(b.idxs) for b in blocks))
            yield pd.DataFrame(out, columns=["m", "field", "idx", "score", "rank"]).astype({"idx": "int64", "score": "float64", "rank": "int32"})

    return run


def nearest(mention_norms: DataFrame, cands: DataFrame, k: int, block: int = BLOCK, small: int = SMALL, scored=None) -> DataFrame:
    """``m, field, idx, score, rank``: the ``k`` best records per mention string and field (score, then smallest id).

    ``mention_norms(m)`` distinct; ``cands(field, c, idxs)`` distinct strings with their ``k`` smallest record ids.
    ``scored``: an accumulator that counts the scored pairs.
    """
    from presslink.operators.matching import join_hot

    spark = cands.sparkSession
    cands = materialize(cands)
    n, chars = cands.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("c")), F.lit(0))).first()
    if n <= small and chars <= BLOCK_CHARS:
        strings: dict[str, list] = {}
        for r in cands.collect():                          # at most ``small`` rows
            strings.setdefault(r.field, []).append((r.c, list(r.idxs)))
        return mention_norms.select("m").repartition(cores(spark)).mapInPandas(
            _against_all(spark.sparkContext.broadcast(strings), k, scored), _FOUND + ", rank int")
    mentions = materialize(mention_norms.select("m").repartition(cores(spark)))
    bags = bag_blocks(cands, n, block)
    directory = {}
    for r in bags.select("field", "block", "env", "least").orderBy("field", "block").collect():     # at most about MAX_BLOCKS rows
        own = directory.setdefault(r.field, ([], [], []))
        for x, v in zip(own, (r.block, r.env, r.least)):
            x.append(v)
    directory = spark.sparkContext.broadcast({
        f: (np.array(ids, np.int64), np.ascontiguousarray(np.array(env, np.int32).T), np.array(least, np.int64))
        for f, (ids, env, least) in directory.items()})

    def by_bag(rows):
        joined = rows.join(bags.select(F.col("block"), "strings", "idxs"), "block")
        return (joined.select("m", "field", "floor", F.col("block").cast("string").alias("key"), "strings", "idxs")
                .sortWithinPartitions("key").mapInPandas(_score_rows(k, True, scored), _FOUND))

    # the k smallest ids of each field stand for all pairs of score 0
    w = Window.partitionBy("field").orderBy("idx")
    least = (cands.select("field", "c", F.explode("idxs").alias("idx")).withColumn("_n", F.row_number().over(w))
             .filter(F.col("_n") <= k).groupBy("field").agg(F.collect_list(F.struct("c", "idx")).alias("own")))
    zero = F.broadcast(least.select("field", F.col("own.c").alias("strings"),                       # k strings per field
                                    F.transform("own", lambda x: F.array(x["idx"])).alias("idxs")))
    every = mentions.withColumn("field", F.explode(F.array(*[F.lit(f) for f in sorted(directory.value)]))) if directory.value else \
        mentions.withColumn("field", F.lit("")).limit(0)
    start = every.join(zero, "field").select("m", "field", F.lit(0.0).alias("floor"), F.col("field").alias("key"), "strings", "idxs")
    base = start.mapInPandas(_zero_rows, _FOUND)

    met = mentions.mapInPandas(_meet_bags(directory, True), "m string, field string, block long, floor double")
    found = materialize(base.unionAll(by_bag(met)))
    floors = _floors(every, _best(found, k), k)

    blocks, tokens = token_blocks(cands, block)
    own = (floors.select("m", "field", "floor", F.explode(F.array_distinct(F.split("m", r"\s+"))).alias("t"))
           .filter(F.col("t") != ""))
    own = own.withColumn("la", (F.sum(F.length("t") + 1).over(Window.partitionBy("m", "field")) - 1).cast("int"))
    held = _with_rest(join_hot(own, tokens, "t", "m", on=("field",), hot_rows=HOT_ROWS), "m", "field")
    held = held.withColumnRenamed("rest", "ra")
    shared = F.least(F.col("s.rest"), F.col("ra"))
    may = 200.0 * shared / (shared + F.least(F.col("la"), F.col("s.len"))) >= F.col("floor") - SLACK
    spans = held.withColumn("s", F.explode("spans")).filter(may).select(
        "m", "field", "floor", "t", F.col("s.rest").alias("rest"), F.col("s.len").alias("len"),
        F.explode(F.sequence(F.lit(0), F.col("s.parts") - 1)).alias("part"))
    by_token = (spans.join(blocks, ["field", "t", "rest", "len", "part"])
                .select("m", "field", "floor", F.concat_ws("\t", "field", "t", "rest", "len", "part").alias("key"), "strings", "idxs")
                .sortWithinPartitions("key").mapInPandas(_score_rows(k, False, scored), _FOUND))
    found = materialize(_best(found.unionAll(by_token), k))
    floors = _floors(every, found, k).repartition(cores(spark))

    far = floors.mapInPandas(_meet_bags(directory, False), "m string, field string, block long, floor double")
    return _best(found.drop("rank").unionAll(by_bag(far)), k)


def _zero_rows(batches):
    """The stand-ins of a field with their true scores."""
    from presslink.functions.similarity import token_set_ratio

    for pdf in batches:
        out = [(row.m, row.field, int(x[0]), token_set_ratio(row.m, c))
               for row in pdf.itertuples(index=False) for c, x in zip(row.strings, row.idxs)]
        yield pd.DataFrame(out, columns=["m", "field", "idx", "score"]).astype({"idx": "int64", "score": "float64"})
