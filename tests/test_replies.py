"""Reply parsing and exclusion rules (P9-P12, F1-F4) with the reference's reply cases."""

import json

import pytest
from pyspark.sql import functions as F

from presslink.operators.replies import build_analyses, parse_mentions


def analyse(spark, replies, source="Test Source"):
    df = spark.createDataFrame([("p", i, "Title", source, "2024-01-01", r) for i, r in enumerate(replies)],
                               "path string, seg long, title string, source string, date string, response string")
    out = build_analyses(parse_mentions(df)).orderBy("seg").collect()
    return [(r.status, [(m.company_name, m.description) for m in r.company_mentions]) for r in out]


VALID = {"company_mentions": [{"company_name": "Acme Corp", "description": "Manufacturer"},
                              {"company_name": "Beta LLC", "description": "Supplier"}]}


def test_valid_and_prose_wrapped(spark):
    r = analyse(spark, [json.dumps(VALID), "Here you go:\n" + json.dumps(VALID) + "\nThanks!"])
    assert r[0] == r[1] == ("ok", [("Acme Corp", "Manufacturer"), ("Beta LLC", "Supplier")])


@pytest.mark.parametrize("reply,status", [
    ("No companies here.", "no_json"),
    ('{"company_mentions": [ {"company_name": "X" ]}', "invalid_json"),
    ('} backwards {', "invalid_json"),
    ('{"companies": []}', "missing_key"),
    ('{"company_mentions": 5}', "bad_type"),
    ('{"company_mentions": null}', "bad_type"),
    ('{"company_mentions": {"a": 1}}', "ok"),
    ('{"company_mentions": "text"}', "ok"),
    ('{"company_mentions": [{"company_name": null, "description": "d"}]}', "bad_type"),
    ('{"company_mentions": [{"company_name": "", "description": 7}]}', "bad_type"),
    (None, "no_reply"),
])
def test_failure_kinds(spark, reply, status):
    [(st, mentions)] = analyse(spark, [reply])
    assert st == status and mentions == []


def test_filters_and_truncation(spark):
    long = "x" * 350
    reply = json.dumps({"company_mentions": [
        "not an object",
        {"company_name": "  ", "description": "blank"},
        {"company_name": "test source", "description": "the publication"},
        {"company_name": "Green Party", "description": "party"},
        {"company_name": "Democrats"},
        {"company_name": "Partyline Inc", "description": "not a party"},
        {"company_name": "Holder Co", "description": "Owns the COPYRIGHT"},
        {"company_name": "Symbol Co", "description": "© 2024"},
        {"company_name": "Long Co", "description": long},
        {"company_name": "  Acme  ", "description": "  trimmed  "},
        {"company_name": "Acme", "description": "duplicate kept"},
        {"description": "no name key"},
    ]})
    [(st, m)] = analyse(spark, [reply])
    assert st == "ok"
    assert m == [("Partyline Inc", "not a party"), ("Long Co", "x" * 297 + "..."), ("Acme", "trimmed"),
                 ("Acme", "duplicate kept")]
    assert len(m[1][1]) == 300


def plain_mentions(text):
    """The rules over Python's own parser (before the exclusions)."""
    at, end = text.find("{"), text.rfind("}") + 1
    if at < 0 or end == 0:
        return "no_json", []
    try:
        data = json.loads(text[at:end])
    except ValueError:
        return "invalid_json", []
    if "company_mentions" not in data:
        return "missing_key", []
    try:
        out = []
        for m in data["company_mentions"]:
            if isinstance(m, dict):
                out.append((m.get("company_name", "").strip(), m.get("description", "").strip()))
        return "ok", out
    except (TypeError, AttributeError):
        return "bad_type", []


ODD = ['{"company_mentions": [], "company_mentions": [{"company_name": "A", "description": "d"}]}',
       '{"company_mentions": [{"company_name": "A", "company_name": "B", "description": "d", "x": NaN}, 5, "s", null]}',
       '{"company_mentions": 5, "company_mentions": "5"}', '{"company_mentions": "5", "company_mentions": 5}',
       '{"company_mentions": [], "company_mentions": {"a": 1, "a": 2}}', '{"company_mentions": [], "company_mentions": null}',
       '{"a": 1, "a": 2}', '{"a": 1, "a": 2} x }', '{"company_mentions": [{"company_name": 5, "company_name": "A"}]}',
       '{"company_mentions": [{"company_name": "A", "company_name": 5}]}', '{"company_mentions": [{"company_name": NaN}]}',
       '{"company_mentions": [{"description": "NaN, -Infinity \\" Infinity"}], "score": -Infinity, "n": [Infinity,NaN,-1]}',
       '{"company_mentions": NaN}', '{"company_mentions": [], "a": NaNa}', '{"company_mentions": [], "a": +Infinity}',
       '{"company_mentions": [], "a": -NaN}', '{"company_mentions": [], "a": 1NaN}', '{"company_mentions": [], "a": NaN.5}',
       '{"company_mentions": [{"company_name": "A", "description": null, "description": "x"}], "company_mentions_": 1}',
       '{"a": {"b": 1, "b": 2}, "company_mentions": [{"company_name": " A\\u00e9 "}]}', "{'company_mentions': [], 'a': 1, 'a': 2}",
       '{"company_mentions": [[{"company_name": "in", "company_name": "a list"}], {"company_name": "A"}, {}]}']


def test_replies_as_pythons_parser_reads_them(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "i long, response string")
    got = [(r.status, [(m.company_name, m.description) for m in r.mentions]) for r in parse_mentions(df).orderBy("i").collect()]
    assert dict(zip(ODD, got)) == {t: plain_mentions(t) for t in ODD}


def plain_decision(text):
    at, end = text.find("{"), text.rfind("}") + 1
    try:
        data = json.loads(text[at:end])
        return str(data.get("decision", "REVIEW")).upper(), int(data.get("index", 0)), str(data.get("reason", ""))
    except (ValueError, OverflowError, TypeError):
        return "REVIEW", 0, "Unparseable LLM response"


def test_decisions_as_pythons_parser_reads_them(spark):
    from presslink.operators.matching import parse_adjudication
    texts = ['{"decision": "a", "decision": "match", "index": 1, "index": 2, "reason": "r"}', '{"decision": NaN, "index": 1, "reason": -Infinity}',
             '{"decision": "match", "index": NaN}', '{"decision": "match", "index": Infinity}', '{"index": "2", "index": "x", "reason": "r"}',
             '{"index": "x", "index": " 2 ", "reason": null, "reason": null}', '{"decision": "match", "index": 1, "index": 1} y }',
             '{"a": 1, "a": 2}', '{"index": 1, "index": null}', '{"decision": true, "decision": false, "index": true, "x": NaN, "x": 1}']
    df = spark.createDataFrame(list(enumerate(texts)), "i long, reply string")
    got = [(r.decision, r["index"], r.reason) for r in parse_adjudication(df).orderBy("i").collect()]
    assert dict(zip(texts, got)) == {t: plain_decision(t) for t in texts}


def test_slice_json_column(spark):
    from presslink.functions.replies import slice_json
    df = spark.createDataFrame([("a {x} b {y} c",), ("none",)], "r string")
    assert [r[0] for r in df.select(slice_json(F.col("r"))).collect()] == ["{x} b {y}", None]


def test_raw_mentions_parse_each_reply_once(spark):
    """A filter on the list before it is opened would repeat the parsing in the plan, once per use of each part."""
    rows = [("p", 0, "s", '{"company_mentions": [{"company_name": "A", "description": "d"}, {"company_name": " ", "description": "e"}]}'),
            ("p", 1, "s", '{"company_mentions": []}'), ("p", 2, None, None), ("p", 3, "s", "no reply"), ("p", 3, "s", '{"company_mentions": [{}]}')]
    from presslink.operators import replies as rep
    parsed = rep.parse_mentions(spark.createDataFrame(rows, "path string, seg long, source string, response string"))
    raw = rep.explode_raw(parsed)
    got = sorted((r.seg, r.pos, r.company_name, r.description, r.source) for r in raw.collect())
    assert got == [(0, 0, "A", "d", "s"), (0, 1, "", "e", "s"), (3, 0, "", "", "s")]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    kept = raw.filter(~rep.is_blank_name(F.struct("company_name", "description")))
    assert plan(kept).count("regexp_replace") == plan(parsed).count("regexp_replace")
