"""End-to-end flows composed from the operators (what a user of the library runs)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from presslink.operators import annotate as ann
from presslink.operators import matching as mt
from presslink.operators import replies as rep
from presslink.operators import reports as rpt
from presslink.operators.articles import DEFAULT_BLOCK, assemble_articles
from presslink.options import Options
from presslink.session import materialize
from presslink.sources import sinks


@dataclass
class NewsResult:
    articles: DataFrame
    analyses: DataFrame
    mentions: DataFrame
    totals: DataFrame
    breakdown: DataFrame
    report: DataFrame


def analyze_news(paragraphs: DataFrame, responses: DataFrame | None = None,
                 reply_fn: Callable[[str], str] | None = None, opts: Options = Options(),
                 block: int | None = DEFAULT_BLOCK) -> NewsResult:
    """Paragraphs -> articles -> replies (a reply table, or ``reply_fn`` run once per
    article) -> analyses -> mention rows and summaries.

    ``block=None`` segments each path in one window (right for Word corpora, where a
    path is one file); the default two-level form is safe for arbitrarily large paths.
    """
    articles = assemble_articles(paragraphs, opts.default_source, opts.default_date, block=block)
    if reply_fn is not None:
        replied = ann.annotate(ann.extraction_prompt(articles), reply_fn).drop("prompt")
    elif responses is not None:
        replied = ann.attach_responses(articles, responses)
    else:
        raise ValueError("pass a reply table or a reply function")
    analyses = materialize(rep.build_analyses(rep.parse_mentions(replied), opts.max_description_length))
    return NewsResult(articles, analyses, rpt.explode_mentions(analyses), rpt.summary_totals(analyses),
                      rpt.publication_breakdown(analyses), rpt.summary_report(analyses))


def write_news(result: NewsResult, out_dir: str) -> None:
    sinks.write_mentions(result.mentions, f"{out_dir}/company_mentions")
    sinks.write_summary(result.report, f"{out_dir}/summary_stats")


@dataclass
class MatchResult:
    ranked: DataFrame
    prompts: DataFrame
    decisions: DataFrame
    kept: DataFrame
    report: DataFrame


def match_contributions(mentions: DataFrame, contributions: DataFrame, replies: DataFrame | None = None,
                        reply_fn: Callable[[str], str] | None = None, opts: Options = Options(),
                        **blocks) -> MatchResult:
    """Mentions (``mention_id, name``) x contributions (``idx, contributor_name,
    contributor_employer``) -> shortlist -> gate -> adjudication -> decisions -> report.

    Replies come from a table ``mention_id, reply, error`` or from ``reply_fn``
    applied once per gated mention (errors become ``REVIEW (LLM error)``).
    """
    mn = mt.normalize_mentions(mentions)
    cn = mt.normalize_contributions(contributions)
    ranked = materialize(mt.shortlist(mn, cn, opts.top_k, **blocks))
    details = materialize(mt.candidate_details(ranked, cn))   # read by prompts and decisions
    gated = mt.gate(mt.best_candidates(ranked), opts.low_threshold)
    prompts = mt.adjudication_prompts(mn, details, gated)
    if reply_fn is not None:
        answered = ann.annotate(prompts, reply_fn).withColumnRenamed("response", "reply")
    elif replies is not None:
        answered = replies.join(prompts.select("mention_id"), "mention_id", "left_semi")
    else:
        raise ValueError("pass a reply table or a reply function")
    decisions = mt.resolve(mt.parse_adjudication(answered), mn, details)
    kept = mt.kept_matches(decisions)
    report = mt.match_report_lines(kept, mentions)
    return MatchResult(ranked, prompts, decisions, kept, report)
