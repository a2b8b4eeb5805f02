from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_simhash import brute_components, brute_fp
from tests.llm.test_suffix import brute as brute_cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_small_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    a = stages["language"](spark, docs, sf).cache()
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    b = stages["near_duplicates"](spark, a, sf).cache()
    rows = a.collect()
    comp = brute_components([r.doc_id for r in rows], [brute_fp(r.text) for r in rows])
    assert sorted(r.doc_id for r in b.collect()) == sorted(r.doc_id for r, c in zip(rows, comp) if r.doc_id == c)
    c = stages["repeated_passages"](spark, b, sf).cache()
    assert c.columns == docs.columns and c.count() == b.count()
    lost = {r[0]: r[1] - r[2] for r in brute_cut([(r.doc_id, r.text) for r in b.collect()])}
    for r in c.collect():
        assert lost[r.doc_id] - 3 * 40 <= len(r.text.encode()) <= lost[r.doc_id] and r.n_chars == len(r.text)
    d = stages["mix"](spark, c, sf).cache()
    assert d.columns == docs.columns and 0 < max(Counter(r.doc_id for r in d.collect()).values()) <= 3
    e = stages["pack"](spark, d, sf).collect()
    assert Counter(r.doc_id for r in e if r.piece == 0) == Counter(r.doc_id for r in d.collect())


def test_odd_rows_and_empty_table(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "123", "en", "a", 3), (None, "some words in here", None, None, None),
            (None, "quite other words of text", "de", "b", 5), (5, "repeat me now", "en", "a", 3), (5, "repeat me now", "en", "a", 3)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, DOCS)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/nowhere").cache()
            if name == "near_duplicates":
                assert docs.count() == (3 if data else 0)
        assert docs.count() >= (1 if data else 0)


def test_clashing_column_names(spark):
    """Columns with the names that operators use themselves come through every stage with their values."""
    names = ["kept", "lang_pred", "score", "_id", "_own", "_tag", "_cut", "_row", "row", "id", "key_id", "_digest", "c1", "cut_id"]
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    stages = corpus_pipeline.STAGES
    plain = table
    docs = table.select(*[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names[:7]], "*",
                        *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names[7:]])
    for name, stage in stages:
        plain, docs = stage(spark, plain, "/nowhere").cache(), stage(spark, docs, "/nowhere").cache()
        if name == "pack":
            break
        assert docs.columns == [*names[:7], *table.columns, *names[7:]]
        assert all(r[n] == f"{n}-{r.doc_id}" for r in docs.collect() for n in names)
        assert sorted(map(str, docs.select(*table.columns).collect())) == sorted(map(str, plain.collect()))
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in plain.collect())


def test_run_is_registered(spark):
    import __spark_entry__
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
