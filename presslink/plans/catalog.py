"""Query catalog: one Spark query and (where SQL can say it) one DuckDB oracle per operator.

Every query reads the driver tables under ``sf_dir`` whole and derives its
shaped input in-query (``presslink.plans.fixtures``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslink.functions import extract_date, extract_date_raw, extract_source, is_heading, normalize_date
from presslink.operators import annotate as ann
from presslink.operators import articles as art
from presslink.operators import replies as rep
from presslink.operators import reports as rpt
from presslink.functions.replies import slice_json, truncate_description
from presslink.plans import fixtures as fx
from presslink.plans import oracle as o
from presslink.session import materialize, scratch_folder

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ------------------------------------------------------------ shared Spark inputs

def _clean(spark, sf):
    return art.clean_paragraphs(fx.fx_paragraphs(spark, sf))


def _segmented(spark, sf):
    return art.segment_documents(fx.fx_paragraph_arrays(spark, sf))


def _summary(spark, sf):
    return art.segment_summary(_segmented(spark, sf))


def fx_articles(spark, sf):
    return art.build_articles(_summary(spark, sf))


# ------------------------------------------------------------ 2.1 / 2.2 paragraphs

@register("text_paragraphs", o.with_(o.fx_paragraphs_text(), "SELECT * FROM fx_paragraphs_text"))
def q_text_paragraphs(spark, sf):
    return fx.fx_paragraphs_text(spark, sf)


@register("clean_paragraphs", o.with_(o.clean_paragraphs(), "SELECT path, ix, text FROM clean"))
def q_clean_paragraphs(spark, sf):
    return _clean(spark, sf).select("path", "ix", "text")


@register("boundaries", o.with_(o.clean_paragraphs(),
                                f"SELECT path, ix, {o.is_boundary('text')} AS is_boundary FROM clean"))
def q_boundaries(spark, sf):
    return art.mark_boundaries(_clean(spark, sf)).select("path", "ix", "is_boundary")


@register("extract_source", o.with_(o.clean_paragraphs(),
                                    f"SELECT path, ix, {o.extract_source('text')} AS source FROM clean"))
def q_extract_source(spark, sf):
    return _clean(spark, sf).select("path", "ix", extract_source("text").alias("source"))


@register("extract_date", o.with_(
    o.clean_paragraphs(),
    f"SELECT path, ix, {o.nonblank(o.normalize_date(o.strip(o.extract_date_raw('text'))))} AS date FROM clean"))
def q_extract_date(spark, sf):
    return _clean(spark, sf).select("path", "ix", extract_date("text").alias("date"))


@register("normalize_date", o.with_(
    o.clean_paragraphs() + [("raw", f"SELECT path, ix, {o.extract_date_raw('text')} AS date_raw FROM clean")],
    f"SELECT path, ix, date_raw, {o.normalize_date(o.strip('date_raw'))} AS date_norm FROM raw "
    f"WHERE date_raw IS NOT NULL"))
def q_normalize_date(spark, sf):
    return (_clean(spark, sf).select("path", "ix", extract_date_raw("text").alias("date_raw"))
            .filter(F.col("date_raw").isNotNull())
            .withColumn("date_norm", normalize_date("date_raw")))


@register("classify_headings", o.with_(
    o.clean_paragraphs(),
    f"SELECT path, ix, {o.is_heading('text', 'style', 'first_bold')} AS is_heading FROM clean"))
def q_classify_headings(spark, sf):
    return _clean(spark, sf).select("path", "ix", is_heading("text", "style", "first_bold").alias("is_heading"))


# ------------------------------------------------------------ 2.3 segmentation and articles

@register("segment_paragraphs", o.with_(o.segmented(), "SELECT path, ix, seg, text FROM segp"))
def q_segment_paragraphs(spark, sf):
    return _segmented(spark, sf).select("path", "ix", "seg", "text")


@register("segment_titles", o.with_(o.segment_summary(),
                                    "SELECT path, seg, title_ix, title FROM summary WHERE title IS NOT NULL"))
def q_segment_titles(spark, sf):
    return _summary(spark, sf).filter(F.col("title").isNotNull()).select("path", "seg", "title_ix", "title")


@register("segment_metadata", o.with_(o.segment_summary(), "SELECT path, seg, source, date FROM summary"))
def q_segment_metadata(spark, sf):
    return _summary(spark, sf).select("path", "seg", "source", "date")


@register("segment_content", o.with_(o.segment_summary(), "SELECT path, seg, n_parts, content FROM summary"))
def q_segment_content(spark, sf):
    return _summary(spark, sf).select("path", "seg", "n_parts", "content")


@register("build_articles", o.with_(o.articles(), "SELECT * FROM articles"))
def q_build_articles(spark, sf):
    return fx_articles(spark, sf)



# ------------------------------------------------------------ 2.4 annotation

def _attached(spark, sf):
    # The reply fixture is derived from the articles and joined back to them:
    # checkpoint the articles once instead of assembling them twice.
    # Only what the replies and reports use: the texts stay out of the checkpoint.
    a = materialize(fx_articles(spark, sf).select("path", "seg", "title", "source", "date"))
    return ann.attach_responses(a, fx.fx_responses(spark, sf, a))


def _parsed(spark, sf):
    return rep.parse_mentions(_attached(spark, sf))


def _analyses(spark, sf):
    # Reports read the analyses several times (totals, names, breakdown): parse once.
    return materialize(rep.build_analyses(_parsed(spark, sf)))


def _prompt_sql():
    parts = []
    for lit, field in ann.template_pieces(ann.EXTRACTION_TEMPLATE):
        if lit:
            parts.append(o.q(lit))
        if field:
            parts.append(field)
    return "concat(" + ", ".join(parts) + ")"


@register("extraction_prompts", o.with_(o.articles(), f"SELECT path, seg, {_prompt_sql()} AS prompt FROM articles"))
def q_extraction_prompts(spark, sf):
    return ann.extraction_prompt(fx_articles(spark, sf)).select("path", "seg", "prompt")


STUB_NAME_PATTERN = r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b"


def stub_extractor(prompt: str) -> str:
    """Deterministic stand-in for a model: names the capitalised two-word phrases of
    the article body (a real deployment passes its own client function)."""
    import json
    import re
    body = prompt.split("\nContent: ", 1)[-1].split("\n\nMANDATORY CHECKLIST", 1)[0]
    names = re.findall(STUB_NAME_PATTERN, body)
    return json.dumps({"company_mentions": [{"company_name": n, "description": "Named in the article"}
                                            for n in dict.fromkeys(names)]})


def _stub_sql():
    # RE2's word edge knows ASCII only: other word characters become "_" and other marks "|" before
    plain = ("regexp_replace(regexp_replace(content, '[^\\x00-\\x7F\\p{L}\\p{N}]', '|', 'g'), '[^\\x00-\\x7F]', '_', 'g')")
    names = f"list_distinct(regexp_extract_all({plain}, {o.q(STUB_NAME_PATTERN)}, 1))"
    keep = f"NOT ({o.is_publication('n', 'source')} OR {o.is_party('n')})"
    return o.with_(o.articles(), (
        f"SELECT path, seg, 'ok' AS status, CAST(len(list_filter({names}, lambda n: {keep})) AS BIGINT) "
        "AS n_mentions FROM articles"))


@register("annotate_stub", _stub_sql())
def q_annotate_stub(spark, sf):
    prompts = ann.extraction_prompt(fx_articles(spark, sf)).select("path", "seg", "title", "source", "date", "prompt")
    out = ann.annotate(prompts, stub_extractor)
    return rep.build_analyses(rep.parse_mentions(out)).select(
        "path", "seg", "status", F.size("company_mentions").cast("long").alias("n_mentions"))


@register("attach_responses", o.with_(o.attached(), "SELECT path, seg, title, source, date, response FROM attached"))
def q_attach_responses(spark, sf):
    return _attached(spark, sf).select("path", "seg", "title", "source", "date", "response")


@register("annotation_audit", o.with_(o.parsed(), (
    "SELECT count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS failed, "
    "count(*) AS total, CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE status = 'ok') AS DOUBLE) / "
    "count(*) ELSE 0.0 END AS success_rate FROM p3")))
def q_annotation_audit(spark, sf):
    return ann.annotation_audit(_parsed(spark, sf))


# ------------------------------------------------------------ 2.5 replies

@register("slice_json", o.with_(o.attached(), (
    "SELECT path, seg, nullif(regexp_extract(response, '(?s)\\{.*\\}', 0), '') AS json_text FROM attached")))
def q_slice_json(spark, sf):
    return _attached(spark, sf).select("path", "seg", slice_json("response").alias("json_text"))


@register("parse_mentions", o.with_(o.parsed(), (
    "SELECT path, seg, status, CAST(len(mentions) AS BIGINT) AS n_mentions, array_to_string(list_transform(mentions, "
    "lambda m: m.company_name || ' = ' || m.description), ' | ') AS mention_values FROM parsed")))
def q_parse_mentions(spark, sf):
    return _parsed(spark, sf).select("path", "seg", "status", F.size("mentions").cast("long").alias("n_mentions"),
                                     _values("mentions").alias("mention_values"))


def _values(mentions):
    return F.array_join(F.transform(mentions, lambda m: F.concat(
        m["company_name"], F.lit(" = "), m["description"])), " | ")


_RAW_COLS = "path, seg, pos, company_name, description"


def _raw(spark, sf):
    return rep.explode_raw(_parsed(spark, sf))


def _m():
    return F.struct(F.col("company_name").alias("company_name"), F.col("description").alias("description"))


@register("drop_blank_names", o.with_(o.parsed(), f"SELECT {_RAW_COLS} FROM raw_mentions WHERE company_name <> ''"))
def q_drop_blank_names(spark, sf):
    return _raw(spark, sf).filter(~rep.is_blank_name(_m())).drop("source")


@register("exclude_publication", o.with_(o.parsed(), (
    f"SELECT {_RAW_COLS} FROM raw_mentions WHERE NOT {o.is_publication('company_name', 'source')}")))
def q_exclude_publication(spark, sf):
    return _raw(spark, sf).filter(~rep.is_publication(_m(), F.col("source"))).drop("source")


@register("exclude_parties", o.with_(o.parsed(), (
    f"SELECT {_RAW_COLS} FROM raw_mentions WHERE NOT {o.is_party('company_name')}")))
def q_exclude_parties(spark, sf):
    return _raw(spark, sf).filter(~rep.is_party(_m())).drop("source")


@register("exclude_copyright", o.with_(o.parsed(), (
    f"SELECT {_RAW_COLS} FROM raw_mentions WHERE NOT {o.is_copyright('description')}")))
def q_exclude_copyright(spark, sf):
    return _raw(spark, sf).filter(~rep.is_copyright_holder(_m())).drop("source")


@register("truncate_description", o.with_(o.parsed(), (
    f"SELECT path, seg, pos, {o.truncate('description')} AS description FROM raw_mentions")))
def q_truncate_description(spark, sf):
    return _raw(spark, sf).select("path", "seg", "pos", truncate_description("description").alias("description"))


@register("build_analyses", o.with_(o.analyses(), (
    "SELECT path, seg, article_title, publication_source, publication_date, status, "
    "CAST(len(company_mentions) AS BIGINT) AS n_mentions, "
    "array_to_string(list_transform(company_mentions, lambda m: m.company_name || ' = ' || m.description), ' | ') "
    "AS mention_values "
    "FROM analyses")))
def q_build_analyses(spark, sf):
    return _analyses(spark, sf).select(
        "path", "seg", "article_title", "publication_source", "publication_date", "status",
        F.size("company_mentions").cast("long").alias("n_mentions"),
        _values("company_mentions").alias("mention_values"))


# ------------------------------------------------------------ 2.6 reports

@register("citations", o.with_(o.analyses(), (
    "SELECT path, seg, '\"' || publication_source || '\", \"' || article_title || '\"' AS citation FROM analyses")))
def q_citations(spark, sf):
    return _analyses(spark, sf).select("path", "seg",
                                       rpt.citation("publication_source", "article_title").alias("citation"))


@register("explode_mentions", o.with_(o.exploded(), "SELECT * FROM exploded"))
def q_explode_mentions(spark, sf):
    return rpt.explode_mentions(_analyses(spark, sf))


_TOTALS_SQL = ("SELECT count(*) AS total_articles, count(*) FILTER (WHERE len(company_mentions) > 0) "
               "AS articles_with_mentions, CAST(coalesce(sum(len(company_mentions)), 0) AS BIGINT) AS total_mentions "
               "FROM analyses")
_UNIQUE_SQL = "SELECT count(DISTINCT lower(company_name)) AS unique_companies FROM exploded"
_BREAKDOWN_SQL = ("SELECT publication_source AS publication, count(*) AS articles, "
                  "CAST(sum(len(company_mentions)) AS BIGINT) AS total_mentions FROM analyses GROUP BY 1")


@register("summary_totals", o.with_(o.analyses(), _TOTALS_SQL))
def q_summary_totals(spark, sf):
    return rpt.summary_totals(_analyses(spark, sf))


@register("unique_companies", o.with_(o.exploded(), _UNIQUE_SQL))
def q_unique_companies(spark, sf):
    return rpt.unique_companies(_analyses(spark, sf))


@register("publication_breakdown", o.with_(o.analyses(), _BREAKDOWN_SQL))
def q_publication_breakdown(spark, sf):
    return rpt.publication_breakdown(_analyses(spark, sf))


_REPORT_SQL = (
    "SELECT CAST(x.o AS BIGINT) AS ord, '' AS key, x.l AS line FROM totals, uniq, unnest(["
    "{'o': 0, 'l': 'Summary Statistics'}, "
    "{'o': 1, 'l': 'Total Articles Processed,' || CAST(total_articles AS VARCHAR)}, "
    "{'o': 2, 'l': 'Articles with Company Mentions,' || CAST(articles_with_mentions AS VARCHAR)}, "
    "{'o': 3, 'l': 'Total Company Mentions,' || CAST(total_mentions AS VARCHAR)}, "
    "{'o': 4, 'l': 'Unique Companies Mentioned,' || CAST(unique_companies AS VARCHAR)}, "
    "{'o': 5, 'l': ''}, {'o': 6, 'l': 'Publication Breakdown'}, "
    "{'o': 7, 'l': 'Publication,Articles,Total Mentions'}]) AS t(x) "
    f"UNION ALL SELECT 8, publication, {o.csv_field('publication')} || ',' || CAST(articles AS VARCHAR) || ',' || "
    "CAST(total_mentions AS VARCHAR) FROM breakdown")


@register("summary_report", o.with_(o.exploded() + [("totals", _TOTALS_SQL), ("uniq", _UNIQUE_SQL),
                                                    ("breakdown", _BREAKDOWN_SQL)], _REPORT_SQL))
def q_summary_report(spark, sf):
    return rpt.summary_report(_analyses(spark, sf))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Documents -> articles -> replies -> analyses -> mentions per publication."""
    return rpt.publication_breakdown(_analyses(spark, sf))


# ------------------------------------------------------------ 2.7 matching

from presslink.operators import matching as mt  # noqa: E402
from presslink.sources.tables import read_contributions_table, read_mentions_table  # noqa: E402


def _mentions_n(spark, sf):
    return mt.normalize_mentions(read_mentions_table(fx.fx_mentions(spark, sf)))


def _contribs_n(spark, sf):
    return mt.normalize_contributions(read_contributions_table(fx.fx_contributions(spark, sf)))


def _top(spark, sf, field=None, **options):
    m = _mentions_n(spark, sf).select(F.col("norm").alias("m")).distinct()
    cands = mt.contributor_strings(_contribs_n(spark, sf))
    return mt.fuzzy_topk(m, cands if field is None else cands.filter(F.col("field") == field), **options)


def _ranked(spark, sf):
    # Ranked shortlists feed both the candidate details and the gate.
    return materialize(mt.rank_candidates(mt.merge_candidates(_top(spark, sf))))


def _per_mention(spark, sf, df):
    mn = _mentions_n(spark, sf).select("mention_id", F.col("norm").alias("m"))
    return mn.join(df, "m", "inner").drop("m")


@register("normalize_names", o.with_(o.mentions_norm() + o.contribs_norm(), (
    "SELECT 'mention' AS kind, mention_id AS id, name AS original, norm AS normalized FROM mentions_norm "
    "UNION ALL SELECT 'name', idx, contributor_name, name_norm FROM contribs_n "
    "UNION ALL SELECT 'employer', idx, contributor_employer, emp_norm FROM contribs_n")))
def q_normalize_names(spark, sf):
    m = _mentions_n(spark, sf).select(F.lit("mention").alias("kind"), F.col("mention_id").alias("id"),
                                      F.col("name").alias("original"), F.col("norm").alias("normalized"))
    c = _contribs_n(spark, sf)
    n = c.select(F.lit("name").alias("kind"), F.col("idx").alias("id"), F.col("contributor_name").alias("original"),
                 F.col("name_norm").alias("normalized"))
    e = c.select(F.lit("employer").alias("kind"), F.col("idx").alias("id"),
                 F.col("contributor_employer").alias("original"), F.col("emp_norm").alias("normalized"))
    return m.unionByName(n).unionByName(e)


@register("token_set_scores", o.with_(
    o.contribs_norm()
    + [("adj_pairs", "SELECT a.idx, a.name_norm AS a_name, a.emp_norm AS a_emp, b.name_norm AS b_name "
                     "FROM contribs_n a JOIN contribs_n b ON b.idx = a.idx + 1")]
    + o.token_set_stages("adj_pairs", "a_name", "b_name", "idx", "nn")
    + o.token_set_stages("adj_pairs", "a_emp", "b_name", "idx", "en"),
    "SELECT nn_score.idx, nn_score.score AS name_score, en_score.score AS employer_name_score "
    "FROM nn_score JOIN en_score USING (idx)"))
def q_token_set_scores(spark, sf):
    c = _contribs_n(spark, sf)
    b = c.select((F.col("idx") - 1).alias("idx"), F.col("name_norm").alias("b_name"))
    pairs = c.select("idx", "name_norm", "emp_norm").join(b, "idx", "inner")
    return pairs.select("idx", mt.token_set_score("name_norm", "b_name").alias("name_score"),
                        mt.token_set_score("emp_norm", "b_name").alias("employer_name_score"))


def _topk_sql(field):
    return o.with_(o.shortlist(), (
        "SELECT mn.mention_id, CAST(t.rank AS INTEGER) AS rank, t.idx, CAST(trunc(t.score) AS INTEGER) AS score "
        f"FROM mentions_norm mn JOIN topk t ON t.m = mn.norm WHERE t.field = '{field}'"))


def _topk(spark, sf, field, **options):
    t = _top(spark, sf, field, **options).select(
        "m", "rank", "idx", F.col("score").cast("int").alias("score"))
    return _per_mention(spark, sf, t)


@register("topk_names", _topk_sql("name"))
def q_topk_names(spark, sf):
    return _topk(spark, sf, "name")


@register("topk_names_index", _topk_sql("name"))
def q_topk_names_index(spark, sf):
    """The same rows through the token and letter indexes, which large tables take by themselves."""
    return _topk(spark, sf, "name", small=0, block=16)


@register("topk_employers", _topk_sql("employer"))
def q_topk_employers(spark, sf):
    return _topk(spark, sf, "employer")


@register("merge_candidates", o.with_(o.shortlist(), (
    "SELECT mn.mention_id, r.idx, r.name_score, r.employer_score FROM mentions_norm mn JOIN merged r ON r.m = mn.norm")))
def q_merge_candidates(spark, sf):
    return _per_mention(spark, sf, mt.merge_candidates(_top(spark, sf)).select(
        "m", "idx", "name_score", "employer_score"))


@register("rank_candidates", o.with_(o.shortlist(), (
    "SELECT mn.mention_id, CAST(r.cand_rank AS INTEGER) AS cand_rank, r.idx FROM mentions_norm mn "
    "JOIN ranked r ON r.m = mn.norm")))
def q_rank_candidates(spark, sf):
    return _per_mention(spark, sf, _ranked(spark, sf).select("m", F.col("cand_rank").cast("int"), "idx"))


@register("best_candidates", o.with_(o.shortlist(), (
    "SELECT mn.mention_id, b.best_idx, b.best_score FROM mentions_norm mn JOIN best b ON b.m = mn.norm")))
def q_best_candidates(spark, sf):
    return _per_mention(spark, sf, mt.best_candidates(_ranked(spark, sf)).select("m", "best_idx", "best_score"))


@register("gated_mentions", o.with_(o.shortlist(), (
    "SELECT mn.mention_id, b.best_score FROM mentions_norm mn JOIN best b ON b.m = mn.norm "
    f"WHERE b.best_score > {mt.LOW_THRESHOLD}")))
def q_gated_mentions(spark, sf):
    return _per_mention(spark, sf, mt.gate(mt.best_candidates(_ranked(spark, sf))).select("m", "best_score"))


def _prompts(spark, sf):
    ranked = _ranked(spark, sf)
    details = mt.candidate_details(ranked, _contribs_n(spark, sf))
    return mt.adjudication_prompts(_mentions_n(spark, sf), details, mt.gate(mt.best_candidates(ranked))), details


@register("adjudication_prompts", o.with_(o.adjudication_prompts(), "SELECT * FROM prompts"))
def q_adjudication_prompts(spark, sf):
    return _prompts(spark, sf)[0]


@register("parse_adjudication", o.with_(o.parsed_adjudications(),
                                        "SELECT mention_id, decision, index, reason FROM adj3"))
def q_parse_adjudication(spark, sf):
    return mt.parse_adjudication(fx.fx_adjudications(spark, sf)).select("mention_id", "decision", "index", "reason")


def _decisions(spark, sf):
    prompts, details = _prompts(spark, sf)
    replies = fx.fx_adjudications(spark, sf).join(prompts.select("mention_id"), "mention_id", "left_semi")
    return mt.resolve(mt.parse_adjudication(replies), _mentions_n(spark, sf), details)


@register("resolve_decisions", o.with_(o.decisions(), "SELECT * FROM decisions"))
def q_resolve_decisions(spark, sf):
    return _decisions(spark, sf)


@register("kept_matches", o.with_(o.decisions(), "SELECT * FROM kept"))
def q_kept_matches(spark, sf):
    return mt.kept_matches(_decisions(spark, sf))


@register("match_report_lines", o.with_(o.decisions(), (
    "SELECT CAST(-1 AS BIGINT) AS mention_id, x.n AS line_no, x.l AS line FROM unnest(["
    "{'n': 0, 'l': 'Matches Report'}, {'n': 1, 'l': repeat('=', 40)}, {'n': 2, 'l': ''}]) AS t(x) "
    "UNION ALL SELECT k.mention_id, x.n, x.l FROM kept k JOIN fx_mentions f USING (mention_id), unnest(["
    "{'n': 0, 'l': 'Mention: ' || f.name}, {'n': 1, 'l': 'Decision: ' || k.decision}, "
    "{'n': 2, 'l': ' - ' || k.detail}, {'n': 3, 'l': ''}]) AS t(x)")))
def q_match_report_lines(spark, sf):
    return mt.match_report_lines(mt.kept_matches(_decisions(spark, sf)), fx.fx_mentions(spark, sf))


# ------------------------------------------------------------ 2.1 round trips through files

def _in_files(df, order, files=3):
    """Rows in ``files`` files whose names follow ``order``."""
    return df.repartitionByRange(files, order).sortWithinPartitions(order)


def _word_corpus(spark, sf):
    from presslink.sources.docx import parse_docx_files
    return parse_docx_files(fx.fx_word_files(spark, sf), persist=False)


_DOCX_SQL = (
    f"SELECT path, CAST(ix AS BIGINT) AS ix, text, style, first_bold, false AS failed FROM (SELECT CAST(ix // {fx.LINE_STRIDE} AS "
    f"VARCHAR) || '.docx' AS path, row_number() OVER (PARTITION BY ix // {fx.LINE_STRIDE} ORDER BY ix) - 1 AS ix, text, "
    f"style, first_bold FROM fx_paragraphs) UNION ALL "
    "SELECT CAST(doc_id AS VARCHAR) || '-broken.docx', NULL, NULL, NULL, NULL, true FROM documents WHERE doc_id % 10 = 9")


@register("docx_paragraphs", o.with_(o.fx_paragraphs(), _DOCX_SQL))
def q_docx_paragraphs(spark, sf):
    return _word_corpus(spark, sf).select("path", "ix", "text", "style", "first_bold",
                                          F.col("error").isNotNull().alias("failed"))


@register("ingest_audit", o.with_(o.segment_summary(), (
    "SELECT count(*) AS successful_files, count(*) FILTER (WHERE doc_id % 10 = 9) AS failed_files, "
    "count(*) + count(*) FILTER (WHERE doc_id % 10 = 9) AS total_files, (SELECT count(*) FROM summary WHERE title IS NOT NULL "
    "AND n_parts > 0) AS total_articles, CASE WHEN count(*) > 0 THEN CAST(count(*) AS DOUBLE) / (count(*) + count(*) "
    "FILTER (WHERE doc_id % 10 = 9)) ELSE 0.0 END AS success_rate FROM documents")))
def q_ingest_audit(spark, sf):
    from presslink.sources.docx import corpus_paragraphs, ingest_audit
    corpus = materialize(_word_corpus(spark, sf))
    return ingest_audit(corpus, art.assemble_articles(corpus_paragraphs(corpus), block=None))


@register("load_mentions", o.with_([o.FX_MENTIONS], (
    f"SELECT * FROM (SELECT row_number() OVER (ORDER BY mention_id) - 1 AS mention_id, {o.strip('name')} AS name "
    "FROM fx_mentions) WHERE name <> ''")))
def q_load_mentions(spark, sf):
    from presslink.sources.csv import MENTION_COLUMN, read_mentions
    path = scratch_folder(spark, "mentions")
    (_in_files(fx.fx_mentions(spark, sf), "mention_id").select(F.col("name").alias(MENTION_COLUMN))
     .write.option("header", "true").option("escape", '"').csv(path))
    return read_mentions(spark, path).select("mention_id", "name")


@register("load_contributions", o.with_([o.FX_CONTRIBUTIONS], (
    "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, "
    f"{o.strip('coalesce(contributor_name, ' + o.q('') + ')')} AS contributor_name, "
    f"{o.strip('coalesce(contributor_employer, ' + o.q('') + ')')} AS contributor_employer FROM fx_contributions")))
def q_load_contributions(spark, sf):
    from presslink.sources.csv import CONTRIBUTOR_EMPLOYER, CONTRIBUTOR_NAME, read_contributions
    path = scratch_folder(spark, "contributions")
    (_in_files(fx.fx_contributions(spark, sf), "idx").select(
        F.col("idx").alias("Record Id"), F.col("contributor_name").alias(CONTRIBUTOR_NAME),
        F.lit("extra column").alias("Memo"), F.col("contributor_employer").alias(CONTRIBUTOR_EMPLOYER))
     .write.option("header", "true").option("escape", '"').csv(path))
    return read_contributions(spark, path).select("idx", "contributor_name", "contributor_employer")


@register("write_mentions", o.with_(o.exploded(), (
    "SELECT citation, date, company_name, coalesce(description, '') AS description FROM exploded")))
def q_write_mentions(spark, sf):
    from presslink.sources.sinks import MENTION_HEADERS, write_mentions
    path = scratch_folder(spark, "mentions-out")
    write_mentions(rpt.explode_mentions(_analyses(spark, sf)), path)
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    names = ["citation", "date", "company_name", "description"]
    return back.select(*[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(n) for h, n in zip(MENTION_HEADERS, names)])


@register("write_summary", o.with_(o.exploded() + [("totals", _TOTALS_SQL), ("uniq", _UNIQUE_SQL),
                                                   ("breakdown", _BREAKDOWN_SQL)],
                                   f"SELECT line FROM ({_REPORT_SQL})"))
def q_write_summary(spark, sf):
    from presslink.sources.sinks import write_summary
    path = scratch_folder(spark, "summary")
    write_summary(rpt.summary_report(_analyses(spark, sf)), path)
    return spark.read.text(path).withColumnRenamed("value", "line")
