"""Registered queries of this subpackage and the SQL that some of them have."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslink.llm import alignment, attention, chaining, langid, licenses, mixing, packing, quality, search, simhash, sketch, suffix, warc
from presslink.llm.common import read_table


def op1_warc(spark, sf_dir):
    return warc.page_digests(read_table(spark, sf_dir, "pages"), min_bytes=0)


def op2_chaining(spark, sf_dir):
    d = chaining.passages(read_table(spark, sf_dir, "documents"), k=4, min_words=25, min_similarity=0.8)
    return d.withColumnRenamed("id", "doc_id").withColumnRenamed("ref_id", "ref_doc_id")


def op3_langid(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id", 5))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def op4_simhash(spark, sf_dir):
    d = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), k=4, max_distance=4)
    return d.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"),
                    F.col("component").alias("component_id"))


def op5_packing(spark, sf_dir):
    import public_tokenizers

    pieces = packing.token_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                                  max_len=4096, end_id=1)
    return packing.pack(pieces, max_len=4096).withColumnRenamed("id", "doc_id")


def op6_sketch(spark, sf_dir):
    d = sketch.with_next(read_table(spark, sf_dir, "documents"), k=256, shingle=5)
    return d.withColumnRenamed("id", "doc_id")


def op7_licenses(spark, sf_dir):
    return licenses.scan(read_table(spark, sf_dir, "documents"), min_dice=0.8).withColumnRenamed("id", "doc_id")


def op8_mixing(spark, sf_dir):
    d = mixing.taken(read_table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_epochs=3)
    return d.withColumnRenamed("id", "doc_id")


def op9_suffix(spark, sf_dir):
    d = suffix.dedup(read_table(spark, sf_dir, "documents"), min_len=50)
    return d.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_quality(spark, sf_dir):
    d = quality.clean(read_table(spark, sf_dir, "documents"), with_text=False)
    return d.withColumnRenamed("id", "doc_id")


def op11_search(spark, sf_dir):
    return search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=20)


def op12_alignment(spark, sf_dir):
    import public_tokenizers

    d = alignment.align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("piece_bpe_32k.model"))
    return d.withColumnRenamed("id", "doc_id")


def op13_attention(spark, sf_dir):
    import public_tokenizers

    d = attention.score(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=49407)
    return d.withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_chaining": op2_chaining,
    "op3_langid": op3_langid,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_sketch": op6_sketch,
    "op7_licenses": op7_licenses,
    "op8_mixing": op8_mixing,
    "op9_suffix": op9_suffix,
    "op10_quality": op10_quality,
    "op11_search": op11_search,
    "op12_alignment": op12_alignment,
    "op13_attention": op13_attention,
}

ORACLES = {"op1_warc": warc.ORACLE_OP1, "op7_licenses": licenses.oracle(), "op11_search": search.ORACLE_OP11}
