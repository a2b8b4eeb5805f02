"""Reply text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslink.functions.text import col_

JSON_SPAN = r"(?s)\{.*\}"


def has_braces(c) -> Column:
    """Both an opening and a closing brace occur somewhere in the reply."""
    r = col_(c)
    return F.coalesce(r.contains("{") & r.contains("}"), F.lit(False))


def slice_json(c) -> Column:
    """First ``{`` through last ``}``; NULL when there is none."""
    return F.nullif(F.regexp_extract(col_(c), JSON_SPAN, 0), F.lit(""))


def truncate_description(c, n: int = 300) -> Column:
    """Over ``n`` characters -> first ``n-3`` characters plus ``...``."""
    d = col_(c)
    return F.when(F.length(d) > n, F.concat(F.substring(d, 1, n - 3), F.lit("..."))).otherwise(d)


END_MARK = "\u0001end"


def whole_object(js: Column) -> Column:
    """The JSON object that ``js`` is as a whole, as VARIANT; NULL if it is not one object and nothing else.
    The text goes into an array before an end mark: text after the first value breaks the array, or
    leaves another number of elements or another second one."""
    two = F.try_parse_json(F.concat(F.lit("["), js, F.lit(',"\\u0001end"]')))
    first = F.try_variant_get(two, "$[0]", "variant")
    alone = (F.schema_of_variant(first).startswith("OBJECT") & (F.try_variant_get(two, "$[1]", "string") == END_MARK)
             & F.try_variant_get(two, "$[2]", "variant").isNull())
    return F.when(alone, first)


def bare_numbers(js: Column, nan: str, inf: str, minus_inf: str) -> Column:
    """``js`` with the bare words ``NaN``, ``Infinity`` and ``-Infinity`` outside strings replaced by the given JSON
    values, set apart by spaces so that no neighbour becomes part of them."""
    out = js
    for word, value in (("-Infinity", minus_inf), ("Infinity", inf), ("NaN", nan)):
        # before it stand whole strings, and anything that is neither a quote nor the word itself
        before = rf'(?s)\G((?:[^"\{word[0]}]|"(?:[^"\\]|\\.)*+"|{word[0]}(?!{word[1:]}))*+)'.replace("\\I", "I").replace("\\N", "N")
        out = F.regexp_replace(out, before + word, "$1 " + value + " ")
    return F.when(js.contains("NaN") | js.contains("Infinity"), out).otherwise(js)


def is_whole_object(js: Column) -> Column:
    """``js``, which begins with a brace, is one JSON object and nothing else; keys may repeat."""
    two = F.from_json(F.concat(F.lit("["), js, F.lit(',"\\u0001end"]')), "array<string>", {"allowSingleQuotes": "false"})
    return F.coalesce((F.size(two) == 2) & (F.element_at(two, 2) == END_MARK), F.lit(False))


def last_values(js: Column, fields: str) -> Column:
    """The named fields of an object (DDL); of repeated keys the last value counts."""
    return F.from_json(js, fields, {"allowSingleQuotes": "false"})
