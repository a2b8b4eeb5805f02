"""End-to-end flows: annotate once (T13), reply functions, report files."""

import glob
import os

from conftest import paragraphs_df

from presslink.plans.flows import analyze_news, match_contributions, write_news
from presslink.sources.sinks import write_match_report


def news_paragraphs(spark):
    rows = []
    for i in range(6):
        rows += [(f"Plant Opening Case {i}", "Heading 1", False), (f"Source: Wire {i % 2}", "Normal", False),
                 ("Acme Widgets and Beta Tools expanded.", "Normal", False), ("End of Document", "Normal", False)]
    return paragraphs_df(spark, rows)


def test_reply_function_runs_once_per_article(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def fake_model(prompt):
        calls.add(1)
        if "Case 3" in prompt:
            raise RuntimeError("refused")
        return '{"company_mentions": [{"company_name": "Acme Widgets", "description": "Expanded"}]}'

    res = analyze_news(news_paragraphs(spark), reply_fn=fake_model)
    t = res.totals.first()
    assert (t.total_articles, t.articles_with_mentions, t.total_mentions) == (6, 5, 5)
    res.mentions.count()
    res.report.count()
    assert calls.value == 6                      # later reports read the checkpoint, not the function
    write_news(res, str(tmp_path))
    assert glob.glob(os.path.join(tmp_path, "company_mentions", "part-*.csv"))


def test_match_flow_with_function_and_report_file(spark, tmp_path):
    m = spark.createDataFrame([(0, "Acme Widgets"), (1, "Acme Widgets"), (2, "Zzz")], "mention_id long, name string")
    c = spark.createDataFrame([(0, "Acme Widgets LLC", "Other"), (1, "Bob", "Beta")],
                              "idx long, contributor_name string, contributor_employer string")

    def adjudicate(prompt):
        return '{"decision": "MATCH", "index": 1, "reason": "same"}'

    res = match_contributions(m, c, reply_fn=adjudicate)
    out = str(tmp_path / "report")
    write_match_report(res.report, out)
    lines = []
    for f in sorted(glob.glob(os.path.join(out, "part-*"))):
        lines += open(f, encoding="utf-8").read().splitlines()
    accept = "Decision: ACCEPT (Name score=100) -> Contributor Name='Acme Widgets LLC', Contributor Employer='Other'"
    assert lines == ["Matches Report", "=" * 40, "", "Mention: Acme Widgets", accept, " - same", "",
                     "Mention: Acme Widgets", accept, " - same", ""]


def test_extraction_prompt_content(spark):
    from presslink.operators.annotate import extraction_prompt
    a = spark.createDataFrame([("p", 0, "Test Article", "Test Source", "2024-01-15", "Body 100% here {x}")],
                              "path string, seg long, title string, source string, date string, content string")
    prompt = extraction_prompt(a).first().prompt
    assert "Title: Test Article\nSource: Test Source\nDate: 2024-01-15\nContent: Body 100% here {x}" in prompt
    assert prompt.count("Test Source") == 2
    assert '"company_mentions": [' in prompt and "{{" not in prompt
    assert "maximum 300 characters" in prompt


def test_empty_input_gives_zero_totals(spark):
    from presslink.operators.annotate import annotation_audit
    from presslink.operators.replies import parse_mentions
    empty = paragraphs_df(spark, [])
    res = analyze_news(empty, reply_fn=lambda p: "{}")
    t = res.totals.first()
    assert (t.total_articles, t.articles_with_mentions, t.total_mentions) == (0, 0, 0)
    assert res.breakdown.count() == 0
    none = spark.createDataFrame([], "response string")
    audit = annotation_audit(parse_mentions(none)).first()
    assert (audit.ok, audit.failed, audit.total, audit.success_rate) == (0, 0, 0, 0.0)
