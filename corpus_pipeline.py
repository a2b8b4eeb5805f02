"""The corpus pipeline: language ID, near-duplicates, repeated passages, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; all but the last
return the columns of their input, whatever else they are called beside ``doc_id, text, lang, source, n_chars``. Parameters
are those of the operators' contracts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslink.llm import langid, mixing, packing, simhash, suffix
from presslink.llm.common import read_table, store, tune


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose text has a language; the model learns from the labelled rows of this table."""
    tune(spark)
    model = langid.train(docs.where(~langid.held_out("doc_id", 5)))
    # numbered columns can't meet the names of the prediction
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    judged = langid.predict(numbered, model, text_col=f"c{docs.columns.index('text')}", keep=tuple(numbered.columns))
    return judged.where(F.col("lang_pred") != langid.UNKNOWN).drop("lang_pred", "score").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays."""
    tune(spark)
    return simhash.keep_first(docs, k=4, max_distance=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of strings of 50 bytes from the texts; a character that a cut breaks goes whole."""
    tune(spark)
    cut = suffix.dedup(docs, min_len=50, keep_text=True).where("n_removed > 0").select(
        F.col("id").alias("cut_id"), F.col("digest").alias("cut_digest"), "kept").dropDuplicates(["cut_id", "cut_digest"])
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("row_id"),
                       F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("row_digest"))
    joined = rows.join(cut, F.col("row_id").eqNullSafe(F.col("cut_id")) & (F.col("row_digest") == F.col("cut_digest")), "left")
    cut_here = F.col("cut_digest").isNotNull()
    new = {"text": F.when(cut_here, F.col("kept")).otherwise(F.col("row.text")),
           "n_chars": F.when(cut_here, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return joined.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents once per copy that the mix takes, in its order."""
    tune(spark)
    return mixing.mix(docs, weights=(1, 2, 3), max_epochs=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 4096 tokens."""
    tune(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), max_len=4096, end_id=1)
    return packing.pack(pieces, max_len=4096).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("mix", mix), ("pack", pack)]

#: Tokens and fingerprints have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; each result is written to the shared folder and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
