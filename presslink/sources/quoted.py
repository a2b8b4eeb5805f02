"""Quoted CSV read in splits, though quoted fields may hold line breaks.

A text scan gives the physical lines of every byte range of a file. Whether a line begins inside a quoted field
depends on all lines before it, so each range is read for both cases at once: :func:`line_states` runs the quote
automaton from "a record begins" (0) and from "inside quotes" (1). One row per range says where each case
ends; these functions are composed over a file's ranges in order (constant ranges reset the state, others keep or
flip it, so a running sum decides), which fixes the state and the number of records before each range. Lines
that are a record of their own, nearly all, are parsed where they were read; only records of several lines are
gathered by their number.

Rules: fields are separated by commas; a quote opens a field only at its beginning and is doubled inside; text after
a closing quote belongs to the field; records end with LF or CRLF; empty lines between records are skipped; a byte
order mark before the header is ignored; a quote that never closes makes one record of all that follows in its file.
"""

from __future__ import annotations

import csv
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslink.session import materialize

_CLOSED = r'(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+)?+'
#: a line that, read from the beginning of a record, ends inside a quoted field
LEFT_OPEN = re.compile(f'(?:{_CLOSED},)*+"(?:[^"]|"")*+\\Z')
# the states of one line, and how many records began in its range up to it, for both states at the range's start
LINE = "file string, start long, seq long, blank boolean, in0 boolean, in1 boolean, end0 boolean, end1 boolean, nth0 long, nth1 long"


def ends_inside(line: str, inside: bool) -> bool:
    """State after ``line``; a line that begins inside quotes reads like one whose first field just opened."""
    return LEFT_OPEN.match('"' + line if inside else line) is not None


def _states(begin: bool, quoted: list[int], lines: list[str], n: int) -> np.ndarray:
    """State before each of ``n`` lines and after the last; only lines with quotes change it."""
    state = np.empty(n + 1, dtype=bool)
    now, at = begin, 0
    for i, line in zip(quoted, lines):
        state[at:i + 1] = now
        now, at = ends_inside(line, now), i + 1
    state[at:] = now
    return state


def line_states(with_text: bool):
    """Arrow batches of ``value, file, start, seq`` (lines in the order of their range) to ``LINE`` rows."""

    def run(batches):
        where, now, count = None, [False, True], [0, 0]
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            text = t.column("value").combine_chunks()
            file, start = t.column("file").combine_chunks(), t.column("start").combine_chunks()
            same = pc.and_(pc.equal(file[1:], file[:-1]), pc.equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                here = (file[s].as_py(), start[s].as_py())
                if here != where:
                    where, now, count = here, [False, True], [0, 0]
                part = text[s:e]
                blank = pc.or_(pc.equal(part, ""), pc.equal(part, "\r")).to_numpy(zero_copy_only=False)
                quoted = np.flatnonzero(pc.match_substring(part, '"').to_numpy(zero_copy_only=False))
                lines = part.take(pa.array(quoted)).to_pylist()
                cols = {"blank": blank}
                for case in (0, 1):
                    state = _states(now[case], quoted.tolist(), lines, e - s)
                    nth = count[case] + np.cumsum(~state[:-1] & ~blank)
                    now[case], count[case] = bool(state[-1]), int(nth[-1])
                    cols |= {f"in{case}": state[:-1], f"end{case}": state[1:], f"nth{case}": nth}
                out = [file[s:e], start[s:e], t.column("seq").combine_chunks()[s:e],
                       *(pa.array(cols[c]) for c in ("blank", "in0", "in1", "end0", "end1", "nth0", "nth1"))]
                names = [f.split()[0] for f in LINE.split(", ")]
                if with_text:
                    out, names = [*out, part], [*names, "value"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _lines(spark: SparkSession, path: str, with_text: bool) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"))
    return rows.mapInArrow(line_states(with_text), LINE + (", value string" if with_text else ""))


def range_states(lines: DataFrame) -> DataFrame:
    """``file, start, state, before``: the state at the start of each range and the number of records of its file that
    began before it. The windows are keyed by file and have one row per range."""
    ranges = lines.groupBy("file", "start").agg(
        F.max_by("end0", "seq").alias("e0"), F.max_by("end1", "seq").alias("e1"), F.max("nth0").alias("n0"), F.max("nth1").alias("n1"))
    order = Window.partitionBy("file").orderBy("start")
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("flip", (F.col("e0") & ~F.col("e1")).cast("long")).withColumn("flips", F.sum("flip").over(upto))
    # after a range that ends alike in both cases the state is known; later flips change it
    known = F.when(F.col("e0") == F.col("e1"), F.pmod(F.col("e0").cast("long") + F.col("flips"), F.lit(2)))
    ranges = ranges.withColumn("known", known)
    last = F.coalesce(F.last("known", ignorenulls=True).over(earlier), F.lit(0))
    ranges = ranges.withColumn("state", F.pmod(last + F.col("flips") - F.col("flip"), F.lit(2)) == 1)
    n = F.when(F.col("state"), F.col("n1")).otherwise(F.col("n0"))
    return ranges.select("file", "start", "state", F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("before"),
                         n.alias("records"))


def _plain(c) -> Column:
    """A record without its CR and without a byte order mark."""
    return F.regexp_replace(c, r"(?s)\A\x{FEFF}|\r\z", "")


def records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``file, nth, record`` (nth from 1, the header) and ``file, records`` (their number)."""
    states = materialize(range_states(_lines(spark, path, False)))
    state = F.col("state")
    lines = _lines(spark, path, True).join(states.select("file", "start", "state", "before"), ["file", "start"]).select(
        "file", "start", "seq", "value", "blank", (F.col("before") + F.when(state, F.col("nth1")).otherwise(F.col("nth0"))).alias("nth"),
        F.when(state, F.col("in1")).otherwise(F.col("in0")).alias("inside"),
        F.when(state, F.col("end1")).otherwise(F.col("end0")).alias("open"))
    alone = lines.where("NOT inside AND NOT blank AND NOT open").select("file", "nth", F.col("value").alias("record"))
    whole = (lines.where("inside OR open").groupBy("file", "nth")
             .agg(F.array_sort(F.collect_list(F.struct("start", "seq", "value"))).alias("parts"))
             .select("file", "nth", F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("record")))
    return alone.unionByName(whole).withColumn("record", _plain("record")), states.groupBy("file").agg(F.sum("records").alias("records"))


def read_quoted(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``_row, source_file`` and the named columns of CSV files with a header: ``_row`` counts the records from 0 over
    all files in order of their names. A missing or empty field is null. Of two columns of one name the last counts.

    All files must have the header of the first; a ``ValueError`` says which column is missing or that one differs.
    The order of files is a window without a key over one row per file."""
    found, per_file = records(spark, path)
    heads = found.where("nth = 1")
    first = heads.orderBy("file").limit(1).select("record").collect()
    names = next(csv.reader([first[0].record])) if first else []
    for c in columns:
        if c not in names:
            raise ValueError(f"the CSV input has no column {c!r}")
    fields = ", ".join(f"_c{i} string" for i in range(len(names)))
    at = {c: len(names) - 1 - names[::-1].index(c) for c in columns}
    # the header as values: whatever its quoting, other files' must be the same
    parsed = F.from_csv("record", fields, {"quote": '"', "escape": '"', "multiLine": "true"})
    wrong = F.exists(F.array(*[F.struct(F.col(f"h._c{i}").alias("got"), F.lit(n or None).cast("string").alias("want")) for i, n in enumerate(names)]),
                     lambda x: ~x["got"].eqNullSafe(x["want"]))
    other = heads.select("file", parsed.alias("h")).where(wrong).limit(1).collect()
    if other:
        raise ValueError(f"{other[0].file} has another header than the first file")
    before = F.sum(F.col("records") - 1).over(Window.orderBy("file")) - (F.col("records") - 1)
    rows = found.where("nth > 1").select("file", "nth", parsed.alias("r")).join(per_file.select("file", before.alias("_before")), "file")
    return rows.select((F.col("_before") + F.col("nth") - 2).alias("_row"), F.col("file").alias("source_file"),
                       *[F.col(f"r._c{i}").alias(c) for c, i in at.items()])
