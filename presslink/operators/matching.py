"""Fuzzy contribution matching (P14, K1, J2-J5, O1, A9, F5, P15, P16, F6, S7 lines).

Plan (exact):
1. normalise names once (P14) and keep **distinct** strings: a hot mention or
   contributor string costs one score, not one per row;
2. per distinct contributor string keep only its ``k`` smallest record indexes
   (row_number <= k, planned as a partial+final WindowGroupLimit) - more can
   never enter a top-k ordered by (score desc, idx asc);
3. distinct mention strings meet only those blocks of contributor strings whose
   upper bound reaches the mention's k-th score so far (``nearest``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from presslink.functions.names import normalize_name
from presslink.functions.replies import bare_numbers, has_braces, is_whole_object, last_values, slice_json, whole_object
from presslink.functions.text import strip

TOP_K = 5
LOW_THRESHOLD = 62
HIGH_THRESHOLD = 93          # read by the reference configuration, never used for a decision (T11)
HOT_ROWS = 100_000           # mention rows of one name that go to one task

FIELDS = {"name": "contributor_name", "employer": "contributor_employer"}


# ------------------------------------------------------------------ inputs

def normalize_mentions(mentions: DataFrame) -> DataFrame:
    """``mention_id, name`` -> adds ``norm``."""
    return mentions.withColumn("norm", normalize_name("name"))


def normalize_contributions(contribs: DataFrame) -> DataFrame:
    """``idx, contributor_name, contributor_employer`` -> adds ``name_norm``, ``emp_norm``."""
    return (contribs.withColumn("name_norm", normalize_name("contributor_name"))
            .withColumn("emp_norm", normalize_name("contributor_employer")))


def contributor_strings(contribs_norm: DataFrame, k: int = TOP_K) -> DataFrame:
    """Distinct contributor strings per field with their ``k`` smallest indexes:
    ``field, c, idxs``."""
    both = contribs_norm.select(F.inline(F.array(
        F.struct(F.lit("name").alias("field"), F.col("name_norm").alias("c"), F.col("idx").alias("idx")),
        F.struct(F.lit("employer").alias("field"), F.col("emp_norm").alias("c"), F.col("idx").alias("idx")),
    )))
    w = Window.partitionBy("field", "c").orderBy("idx")
    return (both.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
            .groupBy("field", "c").agg(F.array_sort(F.collect_list("idx")).alias("idxs")))


def fuzzy_topk(mention_norms: DataFrame, cands: DataFrame, k: int = TOP_K, **options) -> DataFrame:
    """Top-k records per distinct mention string and field, exact (see :mod:`presslink.operators.nearest`).

    ``mention_norms(m)`` distinct; ``cands(field, c, idxs)`` from
    :func:`contributor_strings`. Returns ``m, field, rank, idx, score``.
    """
    from presslink.operators.nearest import nearest
    return nearest(mention_norms, cands, k, **options)


# ------------------------------------------------------------------ merge, rank, gate

def merge_candidates(top: DataFrame) -> DataFrame:
    """Both shortlists by record; missing side 0; scores truncated to int."""
    def side(field, column):
        return F.max(F.when(F.col("field") == field, F.col(column)))

    # one pass over the scored rows: a join of the two sides would score every pair twice
    return top.groupBy("m", "idx").agg(
        side("name", "rank").alias("name_rank"), F.coalesce(side("name", "score").cast("int"), F.lit(0)).alias("name_score"),
        side("employer", "rank").alias("emp_rank"), F.coalesce(side("employer", "score").cast("int"), F.lit(0)).alias("employer_score"))


def rank_candidates(merged: DataFrame) -> DataFrame:
    """O1: better score first; ties keep first-seen order (name list, then employer list)."""
    side = F.when(F.col("name_rank").isNotNull(), F.lit(0)).otherwise(F.lit(1))
    w = Window.partitionBy("m").orderBy(
        F.greatest("name_score", "employer_score").desc(), side, F.coalesce("name_rank", "emp_rank"))
    return merged.withColumn("cand_rank", F.row_number().over(w)).withColumn(
        "n_cands", F.count(F.lit(1)).over(Window.partitionBy("m")))


def best_candidates(ranked: DataFrame) -> DataFrame:
    """First candidate and its score per mention string."""
    return ranked.filter(F.col("cand_rank") == 1).select(
        "m", F.col("idx").alias("best_idx"),
        F.greatest("name_score", "employer_score").alias("best_score"), "n_cands")


def gate(best: DataFrame, low: int = LOW_THRESHOLD) -> DataFrame:
    """only mention strings whose best score is above ``low`` go on."""
    return best.filter(F.col("best_score") > low)


def shortlist(mentions_norm: DataFrame, contribs_norm: DataFrame, k: int = TOP_K, **options) -> DataFrame:
    """P14 -> J2/J3 -> J4 -> O1 for every distinct mention string: ranked candidates
    ``m, idx, cand_rank, n_cands, name_score, employer_score, name_rank, emp_rank``."""
    m = mentions_norm.select(F.col("norm").alias("m")).distinct()
    top = fuzzy_topk(m, contributor_strings(contribs_norm, k), k, **options)
    return rank_candidates(merge_candidates(top))


# ------------------------------------------------------------------ adjudication

# The adjudication prompt's opening lines and closing line.
ADJUDICATION_HEAD = [
    "You are a forensic document analyst. Temperature=0. Return JSON only.",
    "Task: Determine whether the company/organization mentioned in news coverage is the SAME ENTITY as a "
    "campaign contribution source — either as the contributor name or the contributor's employer.",
    "Decision policy: Return MATCH if the mention clearly refers to the same legal entity as one candidate's "
    "contributor name OR employer. Return NO_MATCH if overlap is only generic tokens or semantics differ. "
    "Return REVIEW if uncertain.",
    "NEVER match media organizations, government entities, political parties/committees, or copyright holders.",
    "Do not rely on generic words alone (e.g., 'American', 'International', 'National', 'Global', 'Group', "
    "'Fund', 'Holding', 'Company', 'LLC', 'Inc', 'Corp'). Require distinctive overlap beyond these.",
    "Allow for legal suffix variations, common abbreviations, and known trade/parent-subsidiary relationships "
    "only if distinctive tokens align.",
    "Example: 'American Ireland Fund' vs 'American Cab' => NO_MATCH (only 'American' overlaps).",
    "Example: 'American Ireland Fund' vs 'The Ireland Funds' => NO_MATCH (distinct entities despite token "
    "similarity).",
]
ADJUDICATION_TAIL = ('Return JSON: {"decision": "MATCH|NO_MATCH|REVIEW", "index": <1-based index or 0 if none>, '
                     '"reason": "..."}')


def candidate_line(rank: Column, name: Column, name_norm: Column, emp: Column, emp_norm: Column,
                   name_score: Column, employer_score: Column) -> Column:
    return F.concat(rank.cast("string"), F.lit(". name='"), name, F.lit("' (norm='"), name_norm,
                    F.lit("'), employer='"), emp, F.lit("' (norm='"), emp_norm, F.lit("'), name_score="),
                    name_score.cast("string"), F.lit(", employer_score="), employer_score.cast("string"))


def candidate_details(ranked: DataFrame, contribs_norm: DataFrame) -> DataFrame:
    """Ranked candidates with the record's original (trimmed) strings."""
    recs = contribs_norm.select("idx", "contributor_name", "contributor_employer", "name_norm", "emp_norm")
    return ranked.join(recs, "idx", "inner")


def join_hot(many: DataFrame, few: DataFrame, key: str, salt: str, on: tuple[str, ...] = (), how: str = "inner",
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """``many`` joined to ``few`` on ``key`` (and ``on``), where one key may hold any share of ``many``'s rows.

    A key with more than ``hot_rows`` rows is dealt by a hash of ``salt`` into shares of about that size; ``few``'s
    rows of such a key (a shortlist, so at most 2k) are repeated once per share. The list of hot keys has one row
    per ``hot_rows`` rows of ``many`` at most; whether it is broadcast is decided by its size at run time.
    """
    hot = (many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
           .select(key, F.ceil(F.col("_n") / hot_rows).cast("long").alias("_shares")))
    shares = F.coalesce(F.col("_shares"), F.lit(1).cast("long"))
    dealt = many.join(hot, key, "left").withColumn("_share", F.pmod(F.xxhash64(salt), shares)).drop("_shares")
    repeated = few.join(hot, key, "left").withColumn(
        "_share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("_shares")
    return dealt.join(repeated, [key, "_share", *on], how).drop("_share")


def adjudication_prompts(mentions_norm: DataFrame, details: DataFrame, gated: DataFrame,
                         hot_rows: int = HOT_ROWS) -> DataFrame:
    """One prompt per gated mention row ``mention_id, prompt``."""
    lines = details.join(gated.select("m"), "m", "left_semi").groupBy("m").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            F.col("cand_rank"),
            candidate_line(F.col("cand_rank"), F.col("contributor_name"), F.col("name_norm"),
                           F.col("contributor_employer"), F.col("emp_norm"), F.col("name_score"),
                           F.col("employer_score")).alias("line")))), lambda x: x["line"]), "\n").alias("cands"))
    head = "\n".join(ADJUDICATION_HEAD)
    rows = mentions_norm.select("mention_id", "name", "norm")
    return join_hot(rows, lines.withColumnRenamed("m", "norm"), "norm", "mention_id", hot_rows=hot_rows).select(
        "mention_id",
        F.concat(F.lit(head + "\nCompany mention (original): "), F.col("name"),
                 F.lit("\nCompany mention (normalized): "), F.col("norm"), F.lit("\nCandidates:\n"),
                 F.col("cands"), F.lit("\n" + ADJUDICATION_TAIL)).alias("prompt"))


def _py_str(v: Column) -> Column:
    """``str()`` of a JSON scalar as Python prints it (strings, null, booleans, numbers)."""
    t = F.schema_of_variant(v)
    return (F.when(t == "STRING", F.try_variant_get(v, "$", "string"))
            .when(t == "VOID", F.lit("None"))
            .when(t == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit("True"))
                  .otherwise(F.lit("False")))
            .otherwise(F.try_variant_get(v, "$", "string")))


def parse_adjudication(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """``decision`` (upper-cased), ``index`` (int), ``reason``; any failure gives
    (``REVIEW``, 0, ``Unparseable LLM response``) (T15)."""
    r = F.col(reply_col)
    # int() and str() of a number that isn't finite are those of its name as a string
    df = df.withColumn("_js", slice_json(r)).withColumn("_js", bare_numbers(F.col("_js"), '"nan"', '"inf"', '"-inf"')).withColumn("_v", whole_object(F.col("_js")))
    js, v = F.col("_js"), F.col("_v")
    strict = F.struct(*[F.try_variant_get(v, f"$.{c}", "variant").alias(c) for c in ("decision", "index", "reason")])
    repeated = F.when(is_whole_object(js), F.struct(*[last_values(js, f"`{c}` variant")[c].alias(c) for c in ("decision", "index", "reason")]))
    df = df.withColumn("_reply", F.when(v.isNotNull(), strict).when(js.isNotNull(), repeated))
    reply, dec_v, idx_v, rea_v = F.col("_reply"), F.col("_reply.decision"), F.col("_reply.index"), F.col("_reply.reason")
    it = F.schema_of_variant(idx_v)
    idx_str = strip(F.try_variant_get(idx_v, "$", "string"))
    index = (F.when(idx_v.isNull(), F.lit(0).cast("long"))
             .when(it == "BOOLEAN", F.try_variant_get(idx_v, "$", "boolean").cast("long"))
             .when(it.startswith("DECIMAL") | (it == "DOUBLE") | (it == "BIGINT") | (it == "INT"),
                   F.try_variant_get(idx_v, "$", "double").cast("long"))
             .when((it == "STRING") & idx_str.rlike(r"^[+-]?\d+$"), idx_str.cast("long")))
    decision = F.upper(F.when(dec_v.isNull(), F.lit("REVIEW")).otherwise(_py_str(dec_v)))
    reason = F.when(rea_v.isNull(), F.lit("")).otherwise(_py_str(rea_v))
    ok = has_braces(r) & reply.isNotNull() & index.isNotNull()
    return (df.withColumn("parse_ok", ok)
            .withColumn("decision", F.when(ok, decision).otherwise(F.lit("REVIEW")))
            .withColumn("index", F.when(ok, index).otherwise(F.lit(0).cast("long")))
            .withColumn("reason", F.when(ok, reason).otherwise(F.lit("Unparseable LLM response"))).drop("_reply", "_js", "_v"))


def resolve(parsed: DataFrame, mentions_norm: DataFrame, details: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``mention_id, decision, detail``.

    MATCH with index in 1..n -> ACCEPT line from that candidate's original strings;
    NO_MATCH -> ``NO_MATCH (LLM)``; otherwise ``REVIEW (LLM)``; a failed call
    (``error`` set) -> ``REVIEW (LLM error)`` with the error as detail.
    """
    pm = parsed.join(mentions_norm.select("mention_id", "norm"), "mention_id", "inner")
    cand = details.select(
        F.col("m").alias("norm"), F.col("cand_rank").alias("index"), "n_cands",
        F.when(F.col("name_score") >= F.col("employer_score"), F.lit("Name")).otherwise(F.lit("Employer"))
        .alias("_field"), F.greatest("name_score", "employer_score").alias("_score"),
        "contributor_name", "contributor_employer")
    j = join_hot(pm, cand, "norm", "mention_id", on=("index",), how="left", hot_rows=hot_rows)
    accept = F.concat(F.lit("ACCEPT ("), F.col("_field"), F.lit(" score="), F.col("_score").cast("string"),
                      F.lit(") -> Contributor Name='"), F.col("contributor_name"),
                      F.lit("', Contributor Employer='"), F.col("contributor_employer"), F.lit("'"))
    err = F.col("error").isNotNull()
    decision = (F.when(err, F.lit("REVIEW (LLM error)"))
                .when((F.col("decision") == "MATCH") & F.col("_field").isNotNull(), accept)
                .when(F.col("decision") == "NO_MATCH", F.lit("NO_MATCH (LLM)"))
                .otherwise(F.lit("REVIEW (LLM)")))
    detail = F.when(err, F.col("error")).otherwise(F.col("reason"))
    return j.select("mention_id", decision.alias("decision"), detail.alias("detail"))


def kept_matches(decisions: DataFrame) -> DataFrame:
    """keep ACCEPT and REVIEW, suppress NO_MATCH."""
    d = F.col("decision")
    return decisions.filter(d.startswith("ACCEPT") | d.startswith("REVIEW"))


def match_report_lines(kept: DataFrame, mentions: DataFrame) -> DataFrame:
    """S7 body as rows ``(mention_id, line_no, line)``; the header has mention_id -1.
    File order is ``(mention_id, line_no)``: mention (file) order, duplicates kept."""
    spark = kept.sparkSession
    head = spark.createDataFrame([(-1, 0, "Matches Report"), (-1, 1, "=" * 40), (-1, 2, "")],
                                 "mention_id long, line_no int, line string")
    body = kept.join(mentions.select("mention_id", "name"), "mention_id", "inner").select(
        "mention_id", F.inline(F.array(
            F.struct(F.lit(0).alias("line_no"), F.concat(F.lit("Mention: "), F.col("name")).alias("line")),
            F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("Decision: "), F.col("decision")).alias("line")),
            F.struct(F.lit(2).alias("line_no"), F.concat(F.lit(" - "), F.col("detail")).alias("line")),
            F.struct(F.lit(3).alias("line_no"), F.lit("").alias("line")))))
    return head.unionByName(body)


@F.pandas_udf(DoubleType())
def token_set_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """K1 as an Arrow-batched column function (for pairwise use on already paired rows)."""
    from presslink.functions.similarity import token_set_ratio
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
