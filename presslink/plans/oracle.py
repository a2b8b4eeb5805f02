"""DuckDB SQL oracles, generated from the same fixed values as the Spark rules.

Each query's SQL is ``WITH <fixture and helper CTEs> <final select>``; the
fixture CTEs rebuild the shaped inputs from the driver tables row for row.
DuckDB's RE2 has ASCII classes, so the rules' patterns are written with explicit
Unicode classes here (:func:`uni`).
"""

from __future__ import annotations

from presslink.functions.dates import DATE_PATTERNS, MONTHS
from presslink.functions.headings import (BOLD_EXCLUDED_PREFIXES, SKIP_PHRASES, TITLE_EXCLUDED_PREFIXES,
                                          TITLE_EXCLUDED_SUFFIXES)
from presslink.functions.sources import SOURCE_PATTERNS
from presslink.functions.text import WS
from presslink.plans.fixtures import (DATE_LABELS, LINE_STRIDE, MONTH_ABBR, MONTH_NAMES, TWO_REPLIES)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def arr(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


WS_SQL = " || ".join(f"chr({ord(c)})" for c in WS)


def strip(e: str) -> str:
    return f"trim({e}, {WS_SQL})"


def nonblank(e: str) -> str:
    return f"nullif({strip(e)}, '')"


def any_of(parts) -> str:
    return "(" + " OR ".join(parts) + ")"


def with_(ctes, final: str) -> str:
    seen, out = set(), []
    for name, body in ctes:
        if name not in seen:
            seen.add(name)
            out.append(f"{name} AS (\n{body}\n)")
    return "WITH " + ",\n".join(out) + "\n" + final


# ---------------------------------------------------------------- rules

# Unicode meanings of the classes, as the inside of a bracket
_CLASS = {"s": r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}",
          "d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"}


def uni(p: str) -> str:
    """A pattern with Unicode instead of ASCII classes; a word edge before or after a group takes the edge character."""
    out, inside, i = [], False, 0
    while i < len(p):
        c, e = p[i], p[i + 1:i + 2]
        if c == "\\" and e in _CLASS:
            out.append(_CLASS[e] if inside else f"[{_CLASS[e]}]")
        elif c == "\\" and e == "b":
            out.append(f"(?:^|$|[^{_CLASS['w']}])")
        elif c == "\\":
            out.append(c + e)
        else:
            inside = (c == "[") or (inside and c != "]")
            out.append(c)
            i -= 1
        i += 2
    return "".join(out)


def extract_source(t: str) -> str:
    return "coalesce(" + ", ".join(
        nonblank(f"regexp_extract({t}, {q('(?im)' + uni(p))}, 1)") for p in SOURCE_PATTERNS) + ")"


def extract_date_raw(t: str) -> str:
    return "coalesce(" + ", ".join(
        f"nullif(regexp_extract({t}, {q('(?i)' + uni(p))}, 1), '')" for p in DATE_PATTERNS) + ")"


def month_of(e: str) -> str:
    return "(CASE lower(" + e + ") " + " ".join(
        f"WHEN {q(k)} THEN {q(v)}" for k, v in MONTHS.items()) + " END)"


def normalize_date(s: str) -> str:
    """``s`` must already be stripped."""
    iso, sl, da = r"^\d{4}-\d{2}-\d{2}$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
    ndy, dny, ny, y = (r"(?i)^(\w+)\s+(\d{1,2}),?\s+(\d{4})$", r"(?i)^(\d{1,2})\s+(\w+)\s+(\d{4})$",
                       r"(?i)^(\w+)\s+(\d{4})$", r"^(\d{4})$")

    iso, sl, da, ndy, dny, ny, y = (uni(p) for p in (iso, sl, da, ndy, dny, ny, y))

    def g(p, i):
        return f"regexp_extract({s}, {q(p)}, {i})"

    def lp(e):
        return f"lpad({e}, 2, '0')"

    return (
        f"(CASE WHEN regexp_matches({s}, {q(iso)}) THEN {s} "
        f"WHEN regexp_matches({s}, {q(sl)}) THEN {g(sl, 3)} || '-' || {lp(g(sl, 1))} || '-' || {lp(g(sl, 2))} "
        f"WHEN regexp_matches({s}, {q(da)}) THEN {g(da, 3)} || '-' || {lp(g(da, 1))} || '-' || {lp(g(da, 2))} "
        f"WHEN regexp_matches({s}, {q(ndy)}) AND {month_of(g(ndy, 1))} IS NOT NULL "
        f"THEN {g(ndy, 3)} || '-' || {month_of(g(ndy, 1))} || '-' || {lp(g(ndy, 2))} "
        f"WHEN regexp_matches({s}, {q(dny)}) AND {month_of(g(dny, 2))} IS NOT NULL "
        f"THEN {g(dny, 3)} || '-' || {month_of(g(dny, 2))} || '-' || {lp(g(dny, 1))} "
        f"WHEN regexp_matches({s}, {q(ny)}) AND {month_of(g(ny, 1))} IS NOT NULL "
        f"THEN {g(ny, 2)} || '-' || {month_of(g(ny, 1))} || '-01' "
        f"WHEN regexp_matches({s}, {q(y)}) THEN {s} || '-01-01' "
        f"ELSE {s} END)"
    )


def is_heading(t: str, style: str, bold: str) -> str:
    low = f"lower({t})"
    skip = any_of([f"contains({low}, {q(p)})" for p in SKIP_PHRASES])
    styled = f"coalesce(contains(lower({style}), 'heading'), false)"
    bold_rule = (f"(coalesce({bold}, false) AND length({t}) BETWEEN 10 AND 200 AND NOT "
                 + any_of([f"starts_with({t}, {q(p)})" for p in BOLD_EXCLUDED_PREFIXES]) + ")")
    caps = f"len(list_filter(string_split_regex({t}, {q(uni(chr(92) + 's+'))}), lambda w: regexp_matches(w, '^\\p{{Lu}}')))"
    title_like = (f"(length({t}) BETWEEN 10 AND 150 AND NOT "
                  + any_of([f"starts_with({t}, {q(p)})" for p in TITLE_EXCLUDED_PREFIXES])
                  + " AND NOT " + any_of([f"ends_with({t}, {q(p)})" for p in TITLE_EXCLUDED_SUFFIXES])
                  + f" AND {caps} >= 2)")
    return f"({t} <> '' AND NOT {skip} AND ({styled} OR {bold_rule} OR {title_like}))"


def is_boundary(t: str) -> str:
    return f"(lower({t}) = 'end of document')"


# ---------------------------------------------------------------- fixtures

FX_DOCUMENTS = ("fx_documents",
                "SELECT doc_id, source, text FROM documents")


def _date_text() -> str:
    m, d, y = "(doc_id % 12 + 1)", "(doc_id % 28 + 1)", "CAST(doc_id % 25 + 2000 AS VARCHAR)"
    ms, ds = f"CAST({m} AS VARCHAR)", f"CAST({d} AS VARCHAR)"
    m2, d2 = f"lpad({ms}, 2, '0')", f"lpad({ds}, 2, '0')"
    full, abbr = f"{arr(MONTH_NAMES)}[{m}]", f"{arr(MONTH_ABBR)}[{m}]"
    body = (f"CASE doc_id % 9 WHEN 0 THEN {y} || '-' || {m2} || '-' || {d2} "
            f"WHEN 1 THEN {ms} || '/' || {ds} || '/' || {y} "
            f"WHEN 2 THEN {m2} || '-' || {d2} || '-' || {y} "
            f"WHEN 3 THEN {full} || ' ' || {ds} || ', ' || {y} "
            f"WHEN 4 THEN {abbr} || ' ' || {ds} || ', ' || {y} "
            f"WHEN 5 THEN {ds} || ' ' || {full} || ' ' || {y} "
            f"WHEN 6 THEN {full} || ' ' || {y} "
            f"WHEN 7 THEN {abbr} || ' ' || {y} ELSE {y} END")
    return f"({arr(DATE_LABELS)}[doc_id % 4 + 1] || {body})"


def _source_text() -> str:
    pub = "translate(source, '0123456789', 'abcdefghij')"
    return (f"(CASE doc_id % 3 WHEN 0 THEN 'Source: ' || source || ' Wire' "
            f"WHEN 1 THEN 'Copyright ' || CAST(doc_id % 25 + 2000 AS VARCHAR) || ' The ' || {pub} || ' Daily Herald' "
            f"ELSE {pub} || ' Tribune - staff report' END)")


def _para(ix, text, style, bold):
    return f"{{'ix': CAST({ix} AS BIGINT), 'text': {text}, 'style': {style}, 'first_bold': {bold}}}"


def _fx_paragraphs_body() -> str:
    base = f"doc_id * {LINE_STRIDE}"
    title = (f"CASE WHEN doc_id % 10 <> 0 THEN "
             + _para(base, "'Plant Opening Case ' || CAST(doc_id AS VARCHAR)",
                     "CASE WHEN doc_id % 2 = 0 THEN 'Heading 1' ELSE 'Normal' END", "doc_id % 3 = 0") + " END")
    src = f"CASE WHEN doc_id % 10 <> 1 THEN " + _para(f"{base} + 1", _source_text(), "'Normal'", "false") + " END"
    dt = f"CASE WHEN doc_id % 10 <> 2 THEN " + _para(f"{base} + 2", _date_text(), "'Normal'", "false") + " END"
    body = (f"list_transform(string_split(text, chr(10)), lambda line, i: "
            + _para(f"{base} + 2 + i", "line", "'Normal'", "(i = 1 AND doc_id % 7 = 0)") + ")")
    end = _para(f"{base} + 3 + len(string_split(text, chr(10)))", "'End of Document'", "'Normal'", "false")
    return (f"SELECT path, p.ix AS ix, p.text AS text, p.style AS style, p.first_bold AS first_bold FROM ("
            f"SELECT source AS path, unnest(list_concat(list_filter([{title}, {src}, {dt}], lambda x: x IS NOT NULL), "
            f"{body}, [{end}])) AS p FROM fx_documents)")


def fx_paragraphs():
    return [FX_DOCUMENTS, ("fx_paragraphs", _fx_paragraphs_body())]


def fx_paragraphs_text():
    return [FX_DOCUMENTS, ("fx_paragraphs_text",
            "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(p.i - 1 AS BIGINT) AS ix, p.t AS text, "
            "'Normal' AS style, false AS first_bold FROM (SELECT doc_id, unnest(list_transform("
            "string_split(text, chr(10)), lambda t, i: {'t': t, 'i': i})) AS p FROM fx_documents)")]


def clean_paragraphs():
    return fx_paragraphs() + [("clean", f"SELECT path, ix, {strip('text')} AS text, style, first_bold "
                                         f"FROM fx_paragraphs WHERE {strip('text')} <> ''")]


def segmented():
    return clean_paragraphs() + [
        ("seg_all", "SELECT path, ix, text, style, first_bold, CAST(sum(CASE WHEN " + is_boundary("text")
         + " THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
         " AS BIGINT) AS seg FROM clean"),
        ("segp", "SELECT * FROM seg_all WHERE NOT " + is_boundary("text")),
    ]


def segment_summary():
    ann = (f"SELECT path, seg, ix, text, {is_heading('text', 'style', 'first_bold')} AS is_heading, "
           f"{extract_source('text')} AS src, {nonblank(normalize_date(strip(extract_date_raw('text'))))} AS dt "
           f"FROM segp")
    ann2 = "SELECT *, min(ix) FILTER (WHERE is_heading) OVER (PARTITION BY path, seg) AS title_ix FROM ann"
    summ = ("SELECT path, seg, min(title_ix) AS title_ix, arg_min(text, ix) FILTER (WHERE is_heading) AS title, "
            "arg_max(src, ix) FILTER (WHERE src IS NOT NULL) AS source, "
            "arg_max(dt, ix) FILTER (WHERE dt IS NOT NULL) AS date, "
            "CAST(count(*) FILTER (WHERE title_ix IS NULL OR ix <> title_ix) AS INTEGER) AS n_parts, "
            "coalesce(string_agg(text, chr(10) ORDER BY ix) FILTER (WHERE title_ix IS NULL OR ix <> title_ix), '')"
            " AS content FROM ann2 GROUP BY path, seg")
    return segmented() + [("ann", ann), ("ann2", ann2), ("summary", summ)]


def articles(default_source="Unknown Source", default_date="1900-01-01"):
    src, dt = "coalesce(source, '')", "coalesce(date, '')"
    raw = f"'Title: ' || title || chr(10) || 'Source: ' || {src} || chr(10) || 'Date: ' || {dt} || chr(10) || 'Content: ' || content"
    body = (f"SELECT path, seg, {strip('title')} AS title, "
            f"{strip(f'coalesce(nullif({src}, {chr(39)}{chr(39)}), {q(default_source)})')} AS source, "
            f"{strip(f'coalesce(nullif({dt}, {chr(39)}{chr(39)}), {q(default_date)})')} AS date, "
            f"{strip('content')} AS content, {strip(raw)} AS raw_text "
            f"FROM summary WHERE title IS NOT NULL AND n_parts > 0")
    return segment_summary() + [("articles", body)]


# ---------------------------------------------------------------- replies

def _obj(name, desc):
    return f"""('{{"company_name": "' || {name} || '", "description": "' || {desc} || '"}}')"""


def fx_responses():
    n1 = "(coalesce(p1.p_name, 'unnamed works') || ' Inc.')"
    n2 = "(coalesce(p2.p_name, 'unnamed works') || ' Partners')"

    def wrap(body):
        return f"""('{{"company_mentions": [' || {body} || ']}}')"""

    resp = (
        "CASE WHEN a.seg % 13 = 12 THEN NULL "
        f"WHEN a.seg % 8 = 0 THEN {wrap(_obj(n1, q('Opened a new plant')) + ' || ' + q(', ') + ' || ' + _obj(n2, q('Supplies parts')) + ' || ' + q(', \"stray entry\"'))} "
        f"WHEN a.seg % 8 = 1 THEN 'Here is my analysis.' || chr(10) || {wrap(_obj(n1, q('Main subject')))} || chr(10) || 'Let me know if you need more.' "
        "WHEN a.seg % 8 = 2 THEN 'I could not find any companies in this article.' "
        f"""WHEN a.seg % 8 = 3 THEN '{{"company_mentions": [{{"company_name": "' || {n1} || '" ]}}' """
        f"WHEN a.seg % 16 = 4 THEN {wrap(_obj(n1, q('Investor')))} || ' see {{note}}' "
        f"WHEN a.seg % 48 = 12 THEN {wrap(_obj(n1, q('Investor')))} || ', {{}}' "
        f"""WHEN a.seg % 8 = 4 THEN '{{"companies": [' || {_obj(n1, q('Investor'))} || ']}}' """
        f"WHEN a.seg % 8 = 5 THEN {wrap(' || '.join([_obj(q('Green Party'), q('Political group')), q(', '), _obj(n1, q('Investor')), q(', '), _obj(q('   '), q('blank')), q(', '), _obj(q('Democrats'), q('Party members'))]))} "
        f"WHEN a.seg % 8 = 6 THEN {wrap(_obj(n1, q('Holds the Copyright to the article')) + ' || ' + q(', ') + ' || ' + _obj(n2, "repeat('Long description ', 21)"))} "
        f"""WHEN a.seg % 16 = 15 THEN '{{"company_mentions": [{{"company_name": "' || {n1} || '", "description": null}}]}}' """
        f"ELSE {wrap(_obj('upper(a.source)', q('The publication itself')) + ' || ' + q(', ') + ' || ' + _obj(n2, q('Partner firm')))} END"
    )
    number = "coalesce(TRY_CAST(regexp_extract(a.path, '[0-9]+') AS BIGINT), 0)"
    key = f"((a.seg * 20 + {number}) * 2 % (SELECT max(p_partkey) FROM part) + 1)"
    body = (f"SELECT a.path, a.seg, {resp} AS response FROM articles a "
            f"LEFT JOIN part p1 ON p1.p_partkey = {key} LEFT JOIN part p2 ON p2.p_partkey = {key} + 1")
    return articles() + [("fx_responses", body)]


def attached():
    return fx_responses() + [("attached", "SELECT a.path, a.seg, a.title, a.source, a.date, a.content, r.response "
                                          "FROM articles a LEFT JOIN fx_responses r USING (path, seg)")]


def _string_or_missing(e, key):
    return f"coalesce(json_type({e}, '$.{key}'), 'VARCHAR') = 'VARCHAR'"


def parsed():
    p1 = "SELECT *, regexp_extract(response, '(?s)\\{.*\\}', 0) AS js FROM attached"
    p2 = ("SELECT *, CASE WHEN js <> '' AND json_valid(js) THEN json_type(js, '$.company_mentions') END AS kind, "
          "CASE WHEN js <> '' AND json_valid(js) AND json_type(js, '$.company_mentions') = 'ARRAY' "
          "THEN list_filter(json_extract(js, '$.company_mentions[*]'), lambda e: json_type(e) = 'OBJECT') "
          "ELSE [] END AS objs FROM p1")
    typed_ok = (f"len(list_filter(objs, lambda e: NOT ({_string_or_missing('e', 'company_name')} AND "
                f"{_string_or_missing('e', 'description')}))) = 0")
    p3 = ("SELECT *, CASE WHEN response IS NULL THEN 'no_reply' "
          "WHEN NOT (contains(response, '{') AND contains(response, '}')) THEN 'no_json' "
          "WHEN js = '' OR NOT json_valid(js) THEN 'invalid_json' "
          "WHEN kind IS NULL THEN 'missing_key' "
          f"WHEN kind = 'ARRAY' THEN CASE WHEN {typed_ok} THEN 'ok' ELSE 'bad_type' END "
          "WHEN kind IN ('OBJECT', 'VARCHAR') THEN 'ok' ELSE 'bad_type' END AS status FROM p2")
    name = strip("coalesce(json_extract_string(e, '$.company_name'), '')")
    desc = strip("coalesce(json_extract_string(e, '$.description'), '')")
    ment = (f"SELECT path, seg, title, source, date, status, CASE WHEN status = 'ok' THEN list_transform(objs, "
            f"lambda e: {{'company_name': {name}, 'description': {desc}}}) ELSE [] END AS mentions FROM p3")
    raw = ("SELECT path, seg, source, CAST(x.i - 1 AS BIGINT) AS pos, x.m.company_name AS company_name, "
           "x.m.description AS description FROM (SELECT path, seg, source, unnest(list_transform(mentions, "
           "lambda m, i: {'m': m, 'i': i})) AS x FROM parsed)")
    return attached() + [("p1", p1), ("p2", p2), ("p3", p3), ("parsed", ment), ("raw_mentions", raw)]


def is_blank(m):
    return f"({m}.company_name = '')"


def is_publication(name, source):
    src = strip(f"coalesce({source}, '')")
    return f"(lower({strip(name)}) = lower({src}))"


def is_party(name):
    from presslink.operators.replies import PARTY_NAMES, PARTY_SHORTHANDS, PARTY_SUFFIX
    n = f"lower({strip(name)})"
    return (f"({n} <> '' AND ({n} IN ({', '.join(q(x) for x in PARTY_NAMES)}) OR ends_with({n}, {q(PARTY_SUFFIX)}) "
            f"OR {n} IN ({', '.join(q(x) for x in PARTY_SHORTHANDS)})))")


def is_copyright(desc):
    from presslink.operators.replies import COPYRIGHT_TRIGGERS
    d = f"lower(coalesce({desc}, ''))"
    return any_of([f"contains({d}, {q(t)})" for t in COPYRIGHT_TRIGGERS])


def truncate(d, n=300):
    return f"(CASE WHEN length({d}) > {n} THEN substr({d}, 1, {n - 3}) || '...' ELSE {d} END)"


def analyses():
    keep = (f"NOT ({is_blank('m')} OR {is_publication('m.company_name', 'source')} OR "
            f"{is_party('m.company_name')} OR {is_copyright('m.description')})")
    body = (f"SELECT path, seg, title AS article_title, source AS publication_source, date AS publication_date, "
            f"status, list_transform(list_filter(mentions, lambda m: {keep}), lambda m: "
            f"{{'company_name': m.company_name, 'description': {truncate('m.description')}}}) AS company_mentions "
            "FROM parsed")
    return parsed() + [("analyses", body)]


def exploded():
    cit = "'\"' || publication_source || '\", \"' || article_title || '\"'"
    body = (f"SELECT path, seg, CAST(x.i - 1 AS BIGINT) AS pos, {cit} AS citation, publication_date AS date, "
            "x.m.company_name AS company_name, x.m.description AS description FROM (SELECT *, "
            "unnest(list_transform(company_mentions, lambda m, i: {'m': m, 'i': i})) AS x FROM analyses)")
    return analyses() + [("exploded", body)]


def csv_field(e):
    return (f"(CASE WHEN regexp_matches({e}, '[\",' || chr(13) || chr(10) || ']') "
            f"THEN '\"' || replace({e}, '\"', '\"\"') || '\"' ELSE {e} END)")


# ---------------------------------------------------------------- matching

def normalize_name(e):
    from presslink.functions.names import SUFFIX_WORDS, W
    s = f"lower(coalesce({e}, ''))"
    # RE2 looks neither back nor ahead: words are marked on both sides, suffixes go as marked words, then the marks
    s = f"regexp_replace({s}, '([{W}]+)', chr(1) || '\\1' || chr(1), 'g')"
    s = f"regexp_replace({s}, '\\x01l\\x01\\.\\x01l\\x01\\.\\x01c\\x01\\.(\\x01)', '\\1', 'g')"
    s = f"replace(regexp_replace({s}, '\\x01({SUFFIX_WORDS})\\x01', '', 'g'), chr(1), '')"
    s = f"regexp_replace({s}, '[^{W}{_CLASS['s']}]', ' ', 'g')"
    s = f"regexp_replace({s}, '[{_CLASS['s']}]+', ' ', 'g')"
    return strip(s)


def _suffix(k):
    from presslink.plans.fixtures import NAME_SUFFIXES
    return f"{arr(NAME_SUFFIXES)}[({k}) % 5 + 1]"


FX_MENTIONS = ("fx_mentions", (
    "SELECT p_partkey AS mention_id, CASE WHEN p_partkey % 3 = 2 THEN p_brand "
    "WHEN p_partkey % 2 = 1 THEN substr(p_name, 1, CAST((p_partkey // 2) % length(p_name) AS INTEGER)) || "
    "substr(p_name, CAST((p_partkey // 2) % length(p_name) + 2 AS INTEGER)) ELSE p_name END || "
    f"{_suffix('p_partkey')} AS name FROM part"))
FX_CONTRIBUTIONS = ("fx_contributions", (
    f"SELECT p_partkey AS idx, p_name || {_suffix('p_partkey + 2')} AS contributor_name, "
    "CASE WHEN p_partkey % 11 <> 0 THEN p_type || ' ' || p_name END AS contributor_employer FROM part"))


def mentions_norm():
    return [FX_MENTIONS, ("mentions_norm", f"SELECT mention_id, name, {normalize_name('name')} AS norm FROM fx_mentions")]


def contribs_norm():
    return [FX_CONTRIBUTIONS, ("contribs_norm", (
        f"SELECT idx, {strip('coalesce(contributor_name, ' + q('') + ')')} AS contributor_name, "
        f"{strip('coalesce(contributor_employer, ' + q('') + ')')} AS contributor_employer FROM fx_contributions")),
        ("contribs_n", (f"SELECT *, {normalize_name('contributor_name')} AS name_norm, "
                        f"{normalize_name('contributor_employer')} AS emp_norm FROM contribs_norm"))]


def _lcs(p, t):
    mask = (f"list_sum(list_transform(range(length({p})), lambda i: CASE WHEN {p}[i+1] = ch "
            f"THEN (1::BIGINT << i) ELSE 0::BIGINT END))")
    full = f"((1::BIGINT << length({p})) - 1)"
    return (f"(CASE WHEN length({p}) = 0 THEN 0 ELSE length({p}) - bit_count(list_reduce(string_split({t}, ''), "
            f"lambda v, ch: ((v + (v & {mask})) | (v - (v & {mask}))) & {full}, {full})) END)")


def token_set_stages(src: str, a: str, b: str, keep: str, prefix: str):
    """CTEs scoring column pairs (a, b) of ``src``; ``keep`` columns pass through;
    result CTE ``{prefix}_score`` has ``keep`` + ``score``."""
    toks = lambda e: f"list_sort(list_distinct(list_filter(string_split({e}, ' '), lambda t: t <> '')))"
    s1 = f"SELECT {keep}, {toks(a)} AS ta, {toks(b)} AS tb FROM {src}"
    s2 = (f"SELECT {keep}, ta, tb, list_filter(ta, lambda t: list_contains(tb, t)) AS inter, "
          f"list_filter(ta, lambda t: NOT list_contains(tb, t)) AS xa, "
          f"list_filter(tb, lambda t: NOT list_contains(ta, t)) AS yb FROM {prefix}_t1")
    s3 = (f"SELECT {keep}, len(ta) AS na, len(tb) AS nb, len(inter) AS ni, len(xa) AS nx, len(yb) AS ny, "
          f"array_to_string(xa, ' ') AS sx, array_to_string(yb, ' ') AS sy, "
          f"length(array_to_string(inter, ' ')) AS i FROM {prefix}_t2")
    s4 = (f"SELECT *, length(sx) AS x, length(sy) AS y, CASE WHEN i > 0 THEN 1 ELSE 0 END AS s, "
          f"CASE WHEN na = 0 OR nb = 0 OR (ni > 0 AND (nx = 0 OR ny = 0)) THEN NULL "
          f"WHEN length(sx) <= length(sy) THEN {_lcs('sx', 'sy')} ELSE {_lcs('sy', 'sx')} END AS lcs "
          f"FROM {prefix}_t3")
    d = "CAST(100 AS DOUBLE)"
    r0 = f"({d} - {d} * (x + y - 2 * lcs) / (i + s + x + i + s + y))"
    sa = f"({d} - {d} * (s + x) / (i + i + s + x))"
    sb = f"({d} - {d} * (s + y) / (i + i + s + y))"
    s5 = (f"SELECT {keep}, CASE WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE "
          f"WHEN ni > 0 AND (nx = 0 OR ny = 0) THEN 100.0::DOUBLE "
          f"WHEN i = 0 THEN {r0} ELSE greatest({r0}, {sa}, {sb}) END AS score FROM {prefix}_t4")
    return [(f"{prefix}_t1", s1), (f"{prefix}_t2", s2), (f"{prefix}_t3", s3), (f"{prefix}_t4", s4),
            (f"{prefix}_score", s5)]


def shortlist(k=5):
    pairs = ("pairs", "SELECT DISTINCT m.norm AS m, f.field, f.c FROM (SELECT DISTINCT norm FROM mentions_norm) m, "
             "(SELECT DISTINCT 'name' AS field, name_norm AS c FROM contribs_n UNION "
             "SELECT DISTINCT 'employer', emp_norm FROM contribs_n) f")
    recs = ("recs", "SELECT 'name' AS field, name_norm AS c, idx FROM contribs_n UNION ALL "
                    "SELECT 'employer', emp_norm, idx FROM contribs_n")
    top = ("topk", f"SELECT * FROM (SELECT p.m, p.field, r.idx, p.score, row_number() OVER (PARTITION BY p.m, p.field "
                   f"ORDER BY p.score DESC, r.idx) AS rank FROM pair_score p JOIN recs r ON p.field = r.field AND "
                   f"p.c = r.c) WHERE rank <= {k}")
    merged = ("merged", (
        "SELECT coalesce(n.m, e.m) AS m, coalesce(n.idx, e.idx) AS idx, n.rank AS name_rank, e.rank AS emp_rank, "
        "coalesce(CAST(trunc(n.score) AS INTEGER), 0) AS name_score, "
        "coalesce(CAST(trunc(e.score) AS INTEGER), 0) AS employer_score FROM "
        "(SELECT * FROM topk WHERE field = 'name') n FULL OUTER JOIN (SELECT * FROM topk WHERE field = 'employer') e "
        "ON n.m = e.m AND n.idx = e.idx"))
    ranked = ("ranked", (
        "SELECT *, row_number() OVER (PARTITION BY m ORDER BY greatest(name_score, employer_score) DESC, "
        "CASE WHEN name_rank IS NOT NULL THEN 0 ELSE 1 END, coalesce(name_rank, emp_rank)) AS cand_rank, "
        "count(*) OVER (PARTITION BY m) AS n_cands FROM merged"))
    best = ("best", "SELECT m, idx AS best_idx, greatest(name_score, employer_score) AS best_score, n_cands "
                    "FROM ranked WHERE cand_rank = 1")
    return (mentions_norm() + contribs_norm() + [pairs] + token_set_stages("pairs", "m", "c", "m, field, c", "pair")
            + [recs, top, merged, ranked, best])


def details():
    return shortlist() + [("details", "SELECT r.*, c.contributor_name, c.contributor_employer, c.name_norm, "
                                      "c.emp_norm FROM ranked r JOIN contribs_n c USING (idx)")]


def adjudication_prompts(low=62):
    from presslink.operators.matching import ADJUDICATION_HEAD, ADJUDICATION_TAIL
    line = ("CAST(cand_rank AS VARCHAR) || '. name=''' || contributor_name || ''' (norm=''' || name_norm || "
            "'''), employer=''' || contributor_employer || ''' (norm=''' || emp_norm || '''), name_score=' || "
            "CAST(name_score AS VARCHAR) || ', employer_score=' || CAST(employer_score AS VARCHAR)")
    lines = ("cand_lines", f"SELECT m, string_agg({line}, chr(10) ORDER BY cand_rank) AS cands FROM details "
                           f"WHERE m IN (SELECT m FROM best WHERE best_score > {low}) GROUP BY m")
    head = "\n".join(ADJUDICATION_HEAD).replace("'", "''").replace("\n", "' || chr(10) || '")
    tail = ADJUDICATION_TAIL.replace("'", "''")
    prompts = ("prompts", (
        f"SELECT mention_id, '{head}' || chr(10) || 'Company mention (original): ' || name || chr(10) || "
        f"'Company mention (normalized): ' || norm || chr(10) || 'Candidates:' || chr(10) || cands || chr(10) || "
        f"'{tail}' AS prompt FROM mentions_norm JOIN cand_lines ON norm = m"))
    return details() + [lines, prompts]


FX_ADJUDICATIONS = ("fx_adjudications", (
    "SELECT mention_id, CASE WHEN mention_id % 17 = 16 THEN NULL WHEN mention_id % 7 = 0 THEN "
    "'{\"decision\": \"MATCH\", \"index\": 1, \"reason\": \"Same entity\"}' "
    f"WHEN mention_id % 14 = 8 THEN {q(TWO_REPLIES)} WHEN mention_id % 7 = 1 THEN "
    "'{\"decision\": \"match\", \"index\": 99, \"reason\": \"Out of range\"}' WHEN mention_id % 7 IN (2, 6) THEN "
    "'Result: {\"decision\": \"NO_MATCH\", \"index\": 0, \"reason\": \"Generic overlap\"}' WHEN mention_id % 7 = 3 "
    "THEN '{\"decision\": \"REVIEW\", \"index\": 2, \"reason\": \"Unclear\"}' WHEN mention_id % 7 = 4 THEN "
    "'The model could not decide.' ELSE '{\"decision\": \"MATCH\", \"index\": \"2\", \"reason\": "
    "\"Index given as text\"}' END AS reply, CASE WHEN mention_id % 17 = 16 THEN 'APIError: request timed out' "
    "END AS error FROM fx_mentions"))


def parsed_adjudications():
    js = "regexp_extract(reply, '(?s)\\{.*\\}', 0)"
    ok_json = f"(contains(reply, '{{') AND contains(reply, '}}') AND {js} <> '' AND json_valid({js}))"
    it = f"json_type({js}, '$.index')"
    idx_s = strip(f"json_extract_string({js}, '$.index')")
    index = (f"CASE WHEN {it} IS NULL THEN 0 WHEN {it} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN "
             f"CAST(trunc(CAST(json_extract({js}, '$.index') AS DOUBLE)) AS BIGINT) "
             f"WHEN {it} = 'BOOLEAN' THEN CAST(CAST(json_extract({js}, '$.index') AS BOOLEAN) AS BIGINT) "
             f"WHEN {it} = 'VARCHAR' AND regexp_matches({idx_s}, '^[+-]?[0-9]+$') THEN CAST({idx_s} AS BIGINT) END")

    def pystr(key):
        t = f"json_type({js}, '$.{key}')"
        return (f"CASE WHEN {t} = 'NULL' THEN 'None' WHEN {t} = 'BOOLEAN' THEN CASE WHEN "
                f"CAST(json_extract({js}, '$.{key}') AS BOOLEAN) THEN 'True' ELSE 'False' END "
                f"ELSE json_extract_string({js}, '$.{key}') END")
    a1 = ("adj1", f"SELECT mention_id, reply, error, {ok_json} AS json_ok FROM fx_adjudications")
    a2 = ("adj2", f"SELECT *, CASE WHEN json_ok THEN {index} END AS idx_v FROM adj1")
    a3 = ("adj3", (
        "SELECT mention_id, reply, error, (json_ok AND idx_v IS NOT NULL) AS parse_ok, "
        f"CASE WHEN json_ok AND idx_v IS NOT NULL THEN upper(coalesce({pystr('decision')}, 'REVIEW')) ELSE 'REVIEW' END "
        "AS decision, CASE WHEN json_ok AND idx_v IS NOT NULL THEN idx_v ELSE 0 END AS index, "
        f"CASE WHEN json_ok AND idx_v IS NOT NULL THEN coalesce({pystr('reason')}, '') ELSE "
        "'Unparseable LLM response' END AS reason FROM adj2"))
    return [FX_MENTIONS, FX_ADJUDICATIONS, a1, a2, a3]


def decisions(low=62):
    accept = ("'ACCEPT (' || CASE WHEN c.name_score >= c.employer_score THEN 'Name' ELSE 'Employer' END || ' score=' "
              "|| CAST(greatest(c.name_score, c.employer_score) AS VARCHAR) || ') -> Contributor Name=''' || "
              "c.contributor_name || ''', Contributor Employer=''' || c.contributor_employer || ''''")
    res = ("decisions", (
        f"SELECT a.mention_id, CASE WHEN a.error IS NOT NULL THEN 'REVIEW (LLM error)' "
        f"WHEN a.decision = 'MATCH' AND c.idx IS NOT NULL THEN {accept} "
        "WHEN a.decision = 'NO_MATCH' THEN 'NO_MATCH (LLM)' ELSE 'REVIEW (LLM)' END AS decision, "
        "CASE WHEN a.error IS NOT NULL THEN a.error ELSE a.reason END AS detail "
        "FROM adj3 a JOIN prompts p ON a.mention_id = p.mention_id JOIN mentions_norm mn ON mn.mention_id = a.mention_id "
        "LEFT JOIN details c ON c.m = mn.norm AND c.cand_rank = a.index"))
    kept = ("kept", "SELECT * FROM decisions WHERE starts_with(decision, 'ACCEPT') OR starts_with(decision, 'REVIEW')")
    return adjudication_prompts(low) + parsed_adjudications() + [res, kept]
