"""Reply parsing and exclusion rules.

Replies are parsed once into VARIANT; type checks reproduce the Python
``json``/``dict`` semantics of the rules (T9): a present but non-string
``company_name`` or ``description`` fails the whole article; non-object list
entries are skipped; an object or string ``company_mentions`` yields an empty
list; numbers, booleans and null fail.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslink.functions.replies import (bare_numbers, has_braces, is_whole_object, last_values, slice_json,
                                         truncate_description, whole_object)
from presslink.functions.text import strip

MAX_DESCRIPTION = 300

# Names always treated as political parties (all also end in " party").
PARTY_NAMES = [
    "democratic party", "republican party", "libertarian party", "green party", "labour party",
    "conservative party", "socialist party", "communist party", "people's party", "national party",
]
PARTY_SUFFIX = " party"
PARTY_SHORTHANDS = ["democrats", "republicans"]
# Description fragments that mark a copyright holder.
COPYRIGHT_TRIGGERS = ["copyright", "©", "all rights reserved", "rights to the article"]

MENTION_TYPE = "array<struct<company_name:string,description:string>>"


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _string_or_missing(v: Column) -> Column:
    return v.isNull() | (F.schema_of_variant(v) == "STRING")


def _strict(v: Column) -> Column:
    """``kind`` of the list's value and its object entries, of a reply whose keys are distinct."""
    cm = F.try_variant_get(v, "$.company_mentions", "variant")
    elems = F.coalesce(F.try_variant_get(cm, "$", "array<variant>"), F.array().cast("array<variant>"))
    entries = F.transform(F.filter(elems, _is_object), lambda e: F.struct(
        F.try_variant_get(e, "$.company_name", "variant").alias("n"), F.try_variant_get(e, "$.description", "variant").alias("d")))
    return F.struct(F.schema_of_variant(cm).alias("kind"), entries.alias("entries"))


def _repeated(js: Column) -> Column:
    """The same of a reply whose keys repeat: of each key the last value counts, in the reply and in its entries."""
    elems = last_values(js, "company_mentions array<string>")["company_mentions"]
    one = last_values(js, "company_mentions variant")["company_mentions"]
    named = F.map_contains_key(F.from_json(js, "map<string,string>", {"allowSingleQuotes": "false"}), "company_mentions")
    # a value that is neither a list nor readable by itself is an object whose own keys repeat
    kind = F.when(elems.isNotNull(), F.lit("ARRAY")).when(named, F.coalesce(F.schema_of_variant(one), F.lit("OBJECT")))
    objects = F.filter(F.coalesce(elems, F.array().cast("array<string>")), lambda e: e.startswith("{") & is_whole_object(e))
    entries = F.transform(objects, lambda e: F.struct(
        last_values(e, "company_name variant")["company_name"].alias("n"), last_values(e, "description variant")["description"].alias("d")))
    return F.when(is_whole_object(js), F.struct(kind.alias("kind"), entries.alias("entries")))


def parse_mentions(df: DataFrame, response_col: str = "response") -> DataFrame:
    """P10: adds ``status`` and ``mentions`` (objects only, names/descriptions stripped,
    reply order, duplicates kept; empty unless status is ``ok``). As in Python's parser the last of repeated
    keys counts, and bare ``NaN`` and ``Infinity`` are numbers."""
    r = F.col(response_col)
    # columns of their own: the rules below read them many times, and inlined they outgrow one compiled method
    df = df.withColumn("_js", slice_json(r)).withColumn("_js", bare_numbers(F.col("_js"), "0", "0", "0")).withColumn("_v", whole_object(F.col("_js")))
    df = df.withColumn("_reply", F.when(F.col("_v").isNotNull(), _strict(F.col("_v"))).when(F.col("_js").isNotNull(), _repeated(F.col("_js"))))
    reply, kind, entries = F.col("_reply"), F.col("_reply.kind"), F.col("_reply.entries")
    typed_ok = F.forall(entries, lambda e: _string_or_missing(e["n"]) & _string_or_missing(e["d"]))
    status = (
        F.when(r.isNull(), F.lit("no_reply"))
        .when(~has_braces(r), F.lit("no_json"))
        .when(reply.isNull(), F.lit("invalid_json"))
        .when(kind.isNull(), F.lit("missing_key"))
        .when(kind.startswith("ARRAY"), F.when(typed_ok, F.lit("ok")).otherwise(F.lit("bad_type")))
        .when(kind.startswith("OBJECT") | (kind == "STRING"), F.lit("ok"))
        .otherwise(F.lit("bad_type"))
    )
    mentions = F.transform(entries, lambda e: F.struct(
        strip(F.coalesce(F.try_variant_get(e["n"], "$", "string"), F.lit(""))).alias("company_name"),
        strip(F.coalesce(F.try_variant_get(e["d"], "$", "string"), F.lit(""))).alias("description"),
    ))
    return (df.withColumn("status", status)
            .withColumn("mentions", F.when(F.col("status") == "ok", mentions)
                        .otherwise(F.array().cast(MENTION_TYPE))).drop("_reply", "_js", "_v"))


def is_blank_name(m: Column) -> Column:
    """F1 predicate (drop when true)."""
    return m["company_name"] == ""


def is_publication(m: Column, source: Column) -> Column:
    """F2 predicate: the mention is the article's own publication."""
    return F.lower(strip(m["company_name"])) == F.lower(strip(F.coalesce(source, F.lit(""))))


def is_party(m: Column) -> Column:
    """F3 predicate: a political party name."""
    n = F.lower(strip(m["company_name"]))
    return (n != "") & (n.isin(PARTY_NAMES) | n.endswith(PARTY_SUFFIX) | n.isin(PARTY_SHORTHANDS))


def is_copyright_holder(m: Column) -> Column:
    """F4 predicate: the description names a copyright holder."""
    d = F.lower(F.coalesce(m["description"], F.lit("")))
    return reduce(lambda a, b: a | b, [d.contains(t) for t in COPYRIGHT_TRIGGERS])


def keep_mention(m: Column, source: Column) -> Column:
    return ~(is_blank_name(m) | is_publication(m, source) | is_party(m) | is_copyright_holder(m))


def clean_mentions(mentions: Column, source: Column, max_len: int = MAX_DESCRIPTION) -> Column:
    """F1-F4 then P11 over the whole array in one pass (P12's mention list)."""
    kept = F.filter(mentions, lambda m: keep_mention(m, source))
    return F.transform(kept, lambda m: F.struct(
        m["company_name"].alias("company_name"),
        truncate_description(m["description"], max_len).alias("description")))


def build_analyses(parsed: DataFrame, max_len: int = MAX_DESCRIPTION) -> DataFrame:
    """One row per article; failed replies give an empty list."""
    return parsed.select(
        "path", "seg",
        F.col("title").alias("article_title"),
        F.col("source").alias("publication_source"),
        F.col("date").alias("publication_date"),
        "status",
        clean_mentions(F.col("mentions"), F.col("source"), max_len).alias("company_mentions"),
    )


def explode_raw(parsed: DataFrame) -> DataFrame:
    """Raw parsed mentions, one row each with its list position (for single-rule views)."""
    # outer: a plain explode asks for non-empty lists, and that filter moves below the parsing and repeats all of it
    return parsed.select("path", "seg", "source", F.posexplode_outer("mentions").alias("pos", "m")).filter(F.col("pos").isNotNull()).select(
        "path", "seg", "source", F.col("pos").cast("long").alias("pos"),
        F.col("m.company_name").alias("company_name"), F.col("m.description").alias("description"))
