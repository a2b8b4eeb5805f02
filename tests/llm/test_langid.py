import zlib

import numpy as np

from presslink.llm import catalog, langid


def test_ngrams_do_not_depend_on_neighbours_or_steps():
    texts = ["Ab c", "É!x", None, "12", "zz" * 50]
    alone = [np.sort(np.concatenate([langid._bins(g)[1] for g in langid._blocks([t])] or [np.zeros(0)])) for t in texts]
    for most in (7, 1 << 18):
        own = {i: [] for i in range(len(texts))}
        for g in langid._blocks(texts, most):
            t, b = langid._bins(g)
            for i in own:
                own[i] += b[t == i].tolist()
        assert [sorted(own[i]) for i in range(5)] == [x.tolist() for x in alone]
    assert len(alone[0]) == 3 + 5 + 4                 # "_ab_c_": no blank alone
    assert len(alone[2]) == len(alone[3]) == 0


def test_accuracy_and_shape(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = catalog.QUERIES["op3_langid"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id] is not None]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = [(i, ("der die das und " if i % 2 else "the and of with ") * 5, "de" if i % 2 else "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", langid.held_out())
    model = langid.train(df.where("NOT h"))
    flipped = spark.createDataFrame([(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, t, x in rows],
                                    "doc_id long, text string, lang string").withColumn("h", langid.held_out())
    again = langid.train(flipped.where("NOT h"))
    assert model.languages == again.languages == ("de", "en") and (model.log_prob == again.log_prob).all()


def test_edges(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "123 !?", "de", "a"), (4, "word", None, "a"), (None, "the", "en", "a"),
            (6, "x" * 600_000, "en", "a"), (6, "und der", "de", "b"), (6, "und der", "de", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.predict(df, langid.train(df)).collect()
    assert len(got) == 8 and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    empty = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), empty).collect() == []
