import random
import re

import duckdb
import pytest

from presslink.llm import catalog, licenses

WORD = re.compile(r"[^\W_]+")


def bigrams(t):
    w = WORD.findall(t.lower())
    return set(zip(w, w[1:]))


TEMPLATES = [(n, bigrams(x)) for n, x in licenses.TEMPLATES]


def brute(text):
    if text is None:
        return (None, 0.0, None, 0)
    lines = text.split("\n")
    units = [(-1, "\n".join(x for x in lines if not re.match(r"(?i)\s*(copyright|\(c\)|©)", x)))]
    units += list(enumerate(lines)) if len(lines) > 1 else []
    hits = []
    for line, u in units:
        a = bigrams(u)
        for name, b in TEMPLATES:
            if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                hits.append((-2 * len(a & b) / (len(a) + len(b)), name, line))
    if not hits:
        return (None, 0.0, None, 0)
    d, name, line = min(hits)
    return (name, -d, None if line < 0 else line, len({h[2] for h in hits}))


TEXTS = [None, "", "word", "Released under the MIT License.", "x\nReleased under the MIT License.\ny", "Copyright (c) 2020 Me\n" + licenses.TEMPLATES[0][1],
         licenses.TEMPLATES[0][1].upper(), "licensed under CC BY-NC 4.0\nlicensed under cc by 4.0!", "Released under a MIT like License, maybe.",
         "the and the and " * 500, "Licensed under the Apache License , version 2.0 .", "é ü ß ñ " * 9, "© x\n\n\n",
         "This work is licensed under the GNU General Public License, version 3.\n" * 3, "Use of this source code is governed by a BSD license in LICENSE"]


def test_brute_force(spark):
    rows = [(i, t, "dup", 1.0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "d", 1.0), (4, TEXTS[4], "d", 1.0), (4, TEXTS[5], "d", 1.0), (None, TEXTS[4], "d", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string, dice double").repartition(3)
    got = [(r.id, r.license, r.dice, r.line, r.n_units) for r in licenses.scan(df).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *brute(t))) for i, t, *_ in rows)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_size_bounds_do_not_lose_a_match():
    for a in range(1, 60):
        for b in range(1, 60):
            if 2 * min(a, b) / (a + b) >= 0.8:
                assert 0.8 / 1.2 * b - 1e-9 <= a <= 1.2 / 0.8 * b + 1e-9


def test_signal_words_are_in_every_match(spark):
    """Templates with words dropped, doubled and replaced, down to the least Dice, against brute force."""
    rng = random.Random(5)
    texts = []
    for _, t in licenses.TEMPLATES:
        for share in (0.05, 0.1, 0.15, 0.2):
            words = [w for w in t.split() if rng.random() > share]
            texts.append(" ".join(rng.choice([w, w, w, w, "zebra", w.upper()]) if rng.random() < share else w for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.id, r.license, r.dice, r.line, r.n_units) for r in licenses.scan(df).collect())
    want = [(i, *brute(t)) for i, t in enumerate(texts)]
    assert got == want and 0.8 <= min(w[2] for w in want if w[1]) < 0.83
    assert any(w[1] is None for w in want)


def test_signal_words_are_few(spark):
    words = licenses.signal_words(licenses.template_table(spark).collect())
    assert len(words) < 60 and len(set(words)) == len(words)


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    rel = con.execute(catalog.ORACLES["op7_licenses"])
    names = [d[0] for d in rel.description]
    want = sorted(map(str, rel.fetchall()))
    got = catalog.QUERIES["op7_licenses"](spark, f"/root/testdata/{sf}").select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == want and any("MIT" in w or "CC" in w for w in want)
