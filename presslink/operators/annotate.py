"""Annotation over a table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from presslink.session import arrow_batch, materialize

ROWS_PER_BATCH = 256

# Fixed value: the extraction prompt; {title}, {source}, {date}, {content} are
# filled per article ({source} appears twice).
EXTRACTION_TEMPLATE = """You are acting as a forensic document analyst. Your responses must meet the standards to be included as documentary evidence in litigation. Zero creativity is allowed. You must be precise, accurate, and strictly follow the guidelines below.

Please analyze the following news article and identify all companies and organizations explicitly mentioned by name. For each company or organization found, provide:

1. The exact company/organization name as mentioned in the article
2. A brief description (maximum 300 characters) of how the company or organization is involved or mentioned in the article

Article Details:
Title: {title}
Source: {source}
Date: {date}
Content: {content}

MANDATORY CHECKLIST - Before returning any value as a company/organization name, you MUST verify that the entity is:
(A) NOT A CITY
(B) NOT A COUNTY  
(C) NOT A STATE
(D) NOT THE FEDERAL GOVERNMENT
(E) NOT THE NAME OF A NEWSPAPER
(F) NOT THE NAME OF OTHER NEWS MEDIA
(G) NOT THE NAME OF A NEWS ORGANIZATION
(H) NOT THE COPYRIGHT HOLDER LISTED IN THE ARTICLE'S COPYRIGHT INFORMATION
(I) NOT A POLITICAL PARTY OR POLITICAL COMMITTEE (e.g., "Democratic Party", "Republican Party", "Labour Party")

If ANY of these conditions are true, DO NOT include the entity as a company/organization name.

Please respond with a JSON object in this exact format:
{{
    "company_mentions": [
        {{
            "company_name": "Exact Company Name",
            "description": "Brief description of company's role in the article (max 300 chars)"
        }}
    ]
}}

Important guidelines:
- Only include companies and organizations that are explicitly named in the article
- Do not include generic terms like "the company" or "the organization" unless they are proper names
- Keep descriptions factual and concise
- If no companies or organizations are mentioned, return an empty array
- Ensure the JSON is valid and properly formatted

CRITICAL EXCLUSIONS - NEVER include:
- The news publication/newspaper name ("{source}") as a company mention
- Other news media outlets as companies unless they are the actual subject of the story (not just cited as sources)
- The author's name or byline information
- Any government entities (cities, counties, states, federal agencies)
- Political parties or their committees (e.g., "Democratic Party", "Republican Party")
- Focus only on private sector organizations that are subjects of the news story, not sources reporting it

Remember: You are a forensic document analyst. Your analysis must be precise and exclude all government entities, media organizations, and political parties."""


def template_pieces(template: str) -> list[tuple[str, str]]:
    """Split a ``{field}`` template into (literal, field) pieces; ``{{``/``}}`` are braces."""
    out, pos = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{(\w+)\}", template):
        lit = template[pos:m.start()]
        if m.group(1) is None:
            out.append((lit + m.group(0)[0], ""))
        else:
            out.append((lit, m.group(1)))
        pos = m.end()
    out.append((template[pos:], ""))
    merged: list[tuple[str, str]] = []
    for lit, field in out:
        if merged and merged[-1][1] == "":
            merged[-1] = (merged[-1][0] + lit, field)
        else:
            merged.append((lit, field))
    return merged


def extraction_prompt(articles: DataFrame, template: str = EXTRACTION_TEMPLATE) -> DataFrame:
    """One prompt per article, a plain ``concat`` projection."""
    parts = []
    for lit, field in template_pieces(template):
        if lit:
            parts.append(F.lit(lit))
        if field:
            parts.append(F.col(field))
    return articles.withColumn("prompt", F.concat(*parts))


def annotate(df: DataFrame, fn: Callable[[str], str], prompt_col: str = "prompt",
             persist: bool = True) -> DataFrame:
    """Apply a user prompt -> reply function to every row, in Arrow batches.

    A failing call (including a refusal raised by ``fn``) sets ``error`` and a NULL
    ``response``; it never fails the task. The output is checkpointed so the
    function runs once even though several reports read the result (T13).
    """
    schema = StructType(list(df.schema.fields) + [StructField("response", StringType()),
                                                   StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            responses, errors = [], []
            for p in pdf[prompt_col]:
                try:
                    responses.append(fn(p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - per-row isolation is the contract
                    responses.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(response=responses, error=errors)

    out = df.mapInPandas(run, schema)
    if not persist:
        return out
    with arrow_batch(df.sparkSession, ROWS_PER_BATCH):   # prompts carry whole articles
        return materialize(out)


def attach_responses(articles: DataFrame, responses: DataFrame, keys=("path", "seg")) -> DataFrame:
    """Replies from a table; an article without a reply keeps a NULL response."""
    return articles.join(responses.select(*keys, "response"), list(keys), "left")


def annotation_audit(parsed: DataFrame) -> DataFrame:
    """A4: ok / failed / total / success rate (0 when there is nothing)."""
    return parsed.agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") != "ok").alias("failed"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("success_rate", F.when(F.col("total") > 0, F.col("ok") / F.col("total")).otherwise(F.lit(0.0)))
