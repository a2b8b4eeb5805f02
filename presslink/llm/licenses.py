"""Licence scans: Dice coefficient of word bigrams against licence templates, DataFrame functions only.

A unit is a line of a text, or the whole text without its copyright lines. Units and templates are
normalised alike: lower case, words are runs of letters and digits. For template size b, a unit of a
bigrams can reach Dice d only if a is between d/(2-d) * b and (2-d)/d * b; that size bound is part of the join,
and units outside the bounds of all templates are not spelled out at all. The same bound says how many of a
template's bigrams a unit must hold, so of some of its words it must hold at least one (:func:`signal_words`):
texts and lines with none of those words are passed over before they are split, and no match is lost by it.
Units meet templates by an equi-join on the bigram (the templates' bigrams are a fixed table, broadcast), so nothing is compared
that shares no bigram; counts are combined inside tasks before the shuffle.

Defined cases: null and empty texts match nothing; a unit of fewer than two words has no bigram; repeated
bigrams count once; equal scores go to the first licence in name order, then the whole text before the
first line; rows that repeat an id and its text get equal results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_DICE = 0.8
WORD = r"[\p{L}\p{N}]+"
COPYRIGHT = r"(?i)^\s*(copyright|\(c\)|©)"

_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:")
_MIT_NOTICE = ("The above copyright notice and this permission notice shall be included in all copies or substantial portions "
               "of the Software.")
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
          "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
          "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
          "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:")

#: Fixed values: (licence, text) of whole licences, their paragraphs and the notices that refer to them.
TEMPLATES = (
    [("MIT", f"MIT License {_MIT} {_MIT_NOTICE} {_AS_IS}"), ("MIT", _MIT), ("MIT", _MIT_NOTICE), ("MIT", _AS_IS),
     ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
     ("MIT", "This project is licensed under the terms of the MIT license."),
     ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted, provided that the above copyright notice and this permission notice appear in all copies."),
     ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
     ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                    "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                    "See the License for the specific language governing permissions and limitations under the License."),
     ("BSD", _BSD), ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
     ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                 "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
     ("Unlicense", "This is free and unencumbered software released into the public domain."),
     ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.")]
    + [(f"GPL-{v}.0", _GPL.format(v=v)) for v in (2, 3)]
    + [(f"{n}-{v}.0", f"This work is licensed under the GNU {long}General Public License, version {v}.")
       for n, long, versions in (("GPL", "", (2, 3)), ("LGPL", "Lesser ", (3,)), ("AGPL", "Affero ", (3,))) for v in versions]
    + [(f"CC-{p}-{v}", f"Licensed under CC {p} {v}.")
       for p in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")]
    + [(f"CC-{p}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License.")
       for p, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"))])


def _with_bigrams(units: DataFrame) -> DataFrame:
    """Add ``words`` and the distinct ``bigrams`` of ``unit``."""
    n = F.size("words")
    pairs = F.when(n > 1, F.array_distinct(F.zip_with(F.slice("words", 1, F.greatest(n - 1, F.lit(1))), F.slice("words", 2, F.greatest(n - 1, F.lit(1))),
                                                      lambda a, b: F.concat(a, F.lit(" "), b))))
    return units.withColumn("bigrams", F.coalesce(pairs, F.array().cast("array<string>"))).withColumn("size", F.size("bigrams"))


def _words(column: str):
    return F.regexp_extract_all(F.lower(F.col(column)), F.lit(f"({WORD})"), 1)


def template_table(spark, templates=TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """``license, template, t_size, lo, hi, pos, bigram``: a few thousand rows, whatever the input."""
    t = spark.createDataFrame([(n, i, x) for i, (n, x) in enumerate(templates)], "license string, template int, unit string")
    t = _with_bigrams(t.withColumn("words", _words("unit"))).where("size > 0")
    return t.select("license", "template", F.col("size").alias("t_size"), F.ceil(F.col("size") * (min_dice / (2 - min_dice)) - 1e-9).alias("lo"),
                    F.floor(F.col("size") * ((2 - min_dice) / min_dice) + 1e-9).alias("hi"), F.posexplode("bigrams").alias("pos", "bigram"))


def signal_words(table) -> list[str]:
    """Words of which every unit that matches a template holds at least one, from rows of :func:`template_table`.

    Dice d of a template of b bigrams needs d/(2-d) * b of them (``lo``), so a unit may lack ``t_size - lo``. A
    set of words that touches more of the template's bigrams than that cannot be missing as a whole. One set for
    all templates is grown greedily, long words first as they are rare in other texts.
    """
    need, touched = {}, defaultdict(set)
    for r in table:
        need[r.template] = r.t_size - r.lo + 1
        for word in r.bigram.split(" "):
            touched[word].add((r.template, r.bigram))
    chosen: list[str] = []
    while any(n > 0 for n in need.values()):
        def gain(word):
            per = Counter(t for t, _ in touched[word])
            return len(word) * sum(max(0, min(n, need[t])) for t, n in per.items()), word
        best = max(touched, key=gain)
        done = touched.pop(best)
        for t, _ in done:
            need[t] -= 1
        for rest in touched.values():
            rest -= done
        chosen.append(best)
    return chosen


def _holds_any(column: str, words: list[str]) -> Column:
    # lower case once per value: the lambda's variable
    return F.exists(F.array(F.lower(F.col(column))), lambda x: reduce(or_, [F.contains(x, F.lit(w)) for w in words]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """``id, license, dice, line, n_units`` per row: the best match (line: from 0, null for the whole text), how many
    units match; null licence and dice 0 where none does."""
    table = template_table(docs.sparkSession, templates, min_dice)
    known = table.collect()                                                # the templates, whatever the input
    lowest, highest, signals = min(r.lo for r in known), max(r.hi for r in known), signal_words(known)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    lines = F.split("text", "\n")
    line_units = F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("line"), x.alias("unit")))
    whole = F.struct(F.lit(None).cast("int").alias("line"),
                     F.array_join(F.filter(lines, lambda x: ~x.rlike(COPYRIGHT)), "\n").alias("unit"))
    units = (rows.where(F.col("text").isNotNull() & _holds_any("text", signals))
             .select("id", "key", F.explode(F.concat(F.array(whole), F.when(F.size(lines) > 1, line_units).otherwise(
                 F.array().cast("array<struct<line:int,unit:string>>")))).alias("u")).select("id", "key", "u.*"))
    # sizes first: words are at most one more than bigrams can be, and cost less than the bigrams
    units = units.where(_holds_any("unit", signals)).withColumn("words", _words("unit")).where(F.size("words") > lowest)
    units = _with_bigrams(units).where(F.col("size").between(lowest, highest)).select("id", "key", "line", "size", "bigrams")
    hits = (units.select("id", "key", "line", "size", F.explode("bigrams").alias("bigram"))
            .join(F.broadcast(table), "bigram").where("size BETWEEN lo AND hi")
            .groupBy("id", "key", "line", "license", "template", "size", "t_size")
            .agg(F.size(F.collect_set("pos")).alias("shared"))             # a set: rows may repeat
            .withColumn("dice", 2 * F.col("shared") / (F.col("size") + F.col("t_size"))).where(F.col("dice") >= min_dice))
    line = F.coalesce("line", F.lit(-1))
    best = (hits.groupBy("id", "key")
            .agg(F.min(F.struct((-F.col("dice")).alias("minus"), F.col("license"), line.alias("line"))).alias("b"),
                 F.countDistinct(line).alias("n_units"))
            .select("id", "key", "b.license", (-F.col("b.minus")).alias("dice"), F.nullif(F.col("b.line"), F.lit(-1)).alias("line"),
                    "n_units"))
    same = F.col("r.key").eqNullSafe(F.col("b.key")) & F.col("r.id").eqNullSafe(F.col("b.id"))
    found = rows.select("id", "key").alias("r").join(best.alias("b"), same, "left")
    return found.select("r.id", "license", F.coalesce("dice", F.lit(0.0)).alias("dice"), "line",
                        F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"))


def oracle(templates=TEMPLATES, min_dice: float = MIN_DICE) -> str:
    """The same by DuckDB over ``documents``."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, {i}, {quote(x)})" for i, (n, x) in enumerate(templates))
    return f"""
WITH t(license, template, unit) AS (VALUES {values}),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line,
         len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, line, unit FROM l0 WHERE n > 1 UNION ALL
  SELECT doc_id, -1, string_agg(unit, chr(10) ORDER BY line) FROM l0 WHERE NOT regexp_matches(unit, '{COPYRIGHT}') GROUP BY doc_id),
u AS (SELECT doc_id, line, regexp_extract_all(lower(unit), '{WORD}') AS words FROM units),
uw AS (SELECT doc_id, line, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM u),
ub AS (SELECT DISTINCT doc_id, line, bigram FROM (SELECT doc_id, line, w || ' ' || lead(w) OVER (PARTITION BY doc_id, line ORDER BY i) AS bigram FROM uw)
  WHERE bigram IS NOT NULL),
us AS (SELECT doc_id, line, count(*) AS size FROM ub GROUP BY ALL),
tw AS (SELECT license, template, unnest(words) AS w, generate_subscripts(words, 1) AS i
  FROM (SELECT license, template, regexp_extract_all(lower(unit), '{WORD}') AS words FROM t)),
tb AS (SELECT DISTINCT license, template, bigram FROM (SELECT license, template, w || ' ' || lead(w) OVER (PARTITION BY template ORDER BY i) AS bigram FROM tw)
  WHERE bigram IS NOT NULL),
ts AS (SELECT template, count(*) AS t_size FROM tb GROUP BY ALL),
h AS (SELECT doc_id, line, license, template, count(*) AS shared FROM ub JOIN tb USING (bigram) GROUP BY ALL),
d AS (SELECT doc_id, line, license, CAST(2 * shared AS DOUBLE) / (size + t_size) AS dice FROM h JOIN us USING (doc_id, line) JOIN ts USING (template)),
ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license, line) AS r,
  dense_rank() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM d WHERE dice >= {min_dice}),
b AS (SELECT doc_id, max(license) FILTER (r = 1) AS license, max(dice) FILTER (r = 1) AS dice, max(line) FILTER (r = 1) AS line, max(k) AS n_units
  FROM ok GROUP BY doc_id)
SELECT doc_id, license, coalesce(dice, 0.0)::DOUBLE AS dice, CAST(nullif(line, -1) AS INT) AS line, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units
FROM documents LEFT JOIN b USING (doc_id)
"""
