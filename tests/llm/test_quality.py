import random
import re
from collections import Counter

import pytest

from presslink.llm import catalog, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    cover = set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            cover |= set(range(i, i + 8))
    n = len(words)
    failed = n < 20 or 100 * len(cover) > 30 * n
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover), failed)


PROSE = "The quick brown fox jumps over the lazy dog, and then it rests for a while. It is warm today.\n" \
        "Nobody knows why the old house by the river was painted green. People have asked many times!"
TEXTS = [None, "", " \n\t\x0b", "word", PROSE, PROSE + "\n" + PROSE, "a b " * 4000, "x\x1cy z\x85w " * 30, "# * $ % & | < >" * 3,
         "same\nsame\n same\nsame \n\n\n", "a b c d e f g h " * 2 + "z", "Home | News | Sport | Weather | Contact\n" + PROSE,
         "é😀 " * 25, "\r\n".join([PROSE] * 2)]


def texts():
    rnd = random.Random(3)
    return TEXTS + ["".join(rnd.choice(["a", "b", "c d", " ", "\n", "| ", "$$$ "]) + rnd.choice(["", " "]) for _ in range(rnd.randrange(400)))
                    for _ in range(150)]


def test_base_counts():
    for t in texts():
        assert quality.judge(t)[:6] == brute(t), t


@pytest.mark.parametrize("line,rule", [
    ("Home | News | Sport | Weather | Contact", "navigation"),
    ("This site uses cookies: read our Cookie Policy.", "boilerplate"),
    ("WIN!! BIG!! MONEY!! NOW!!", "symbols"),
    ("foo$$$ bar%%% baz### words&&&", "symbols"),
    ("word " * 14, "punctuation"),
    ("A heading without a stop", None),
    ("The price rose to $5 & fell by 3% | a note.", None),
    ("Released under the MIT License.", None),
    (PROSE.split("\n")[0], None)])
def test_line_rules(line, rule):
    assert quality.line_rule(line, len(line.split())) == rule


def test_clean_prose_stays_and_lost_text_rejects():
    assert quality.judge(PROSE)[6] and quality.judge("Home | News | Sport | Weather\n" + PROSE)[6]
    menu = "\n".join("Item%d | Other%d | Third%d | Last%d" % (i, i, i, i) for i in range(40))
    v = quality.judge(menu + "\n" + PROSE)
    assert not v[5] and not v[6] and v[9] == PROSE


def test_operator(spark):
    rows = [(i, t, 1, True) for i, t in enumerate(texts())] + [(None, PROSE, 1, True), (4, PROSE, 1, True), (4, PROSE, 1, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long, kept boolean")
    got = quality.clean(df).collect()
    assert sorted(map(str, ((r.id, *r[1:7]) for r in got))) == sorted(str((i, *brute(t))) for i, t, *_ in rows)
    assert all(not (r.base_failed and r.kept) for r in got)
    assert quality.clean(df.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalog.QUERIES["op10_quality"](spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[r.doc_id])
