"""Literal and pattern search in texts, with places."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(docs: DataFrame, target: str, whole_word: bool = False, doc: str = "doc_id", text: str = "content") -> DataFrame:
    """(doc_id, lb, ub): all places of a literal that don't overlap, natively.

    The text is cut at the literal; running lengths of the pieces are the
    places. An empty target is nowhere. Whole words have no letter, digit or _
    beside them.
    """
    d = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("_t")).where(F.col("_t").contains(target) if target else F.lit(False))
    n = len(target)
    parts = F.split("_t", re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", target), -1)
    ends = F.expr(f"transform(_p, (x, i) -> aggregate(slice(_p, 1, i + 1), 0, (a, y) -> a + length(y)) + i * {n})")
    hits = d.withColumn("_p", parts).select("doc_id", "_t", F.posexplode(ends).alias("_i", "lb"), F.size("_p").alias("_n")).where("_i < _n - 1")
    hits = hits.withColumn("ub", F.col("lb") + n)
    if whole_word:
        before, after = F.expr("case when lb > 0 then substring(_t, lb, 1) else '' end"), F.expr("substring(_t, ub + 1, 1)")
        hits = hits.where(~before.rlike(r"(?U)\w") & ~after.rlike(r"(?U)\w"))
    return hits.select("doc_id", "lb", "ub")


def pattern_hits(docs: DataFrame, pattern: str, nocase: bool = False, doc: str = "doc_id", text: str = "content") -> DataFrame:
    """(doc_id, idx, lb, ub): successive places of a regular expression that don't overlap."""
    rx = re.compile(pattern, re.IGNORECASE if nocase else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, *m.span()) for i, t in enumerate(b.column(1).to_pylist()) if t for k, m in enumerate(x for x in rx.finditer(t) if x.end() > x.start())]
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0])), *(pa.array(x, pa.int32()) for x in c[1:])], names=["doc_id", "idx", "lb", "ub"])

    kind = docs.select(doc).schema[0].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("_t")).mapInArrow(run, f"doc_id {kind}, idx int, lb int, ub int")


def separator(c: Column) -> Column:
    """The one run of characters other than letters, digits and _ that a string holds, else null."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"((?U)\W+)"), F.lit(1)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def suggests(target: Column, candidate: Column) -> Column:
    """Whether one string lies in the other."""
    return F.coalesce(target.contains(candidate) | candidate.contains(target), F.lit(False))


def last_index(s: Column, e: Column) -> Column:
    """The place of the last character of the right-most occurrence, -1 without one."""
    return F.when(F.contains(s, e), F.length(s) - F.position(F.reverse(e), F.reverse(s))).otherwise(F.lit(-1))


def spread_tag(tags: DataFrame, docs: DataFrame, target: str, value: str, whole_word: bool = True) -> DataFrame:
    """`tags` (doc_id, lb, ub, value) with the value given to every occurrence of a literal that has no tag there yet."""
    hits = occurrences(docs, target, whole_word).withColumn("value", F.lit(value))
    return tags.unionByName(hits.join(tags, ["doc_id", "lb", "ub"], "left_anti"))


def unspread_tag(tags: DataFrame, docs: DataFrame, target: str, value: str, whole_word: bool = True) -> DataFrame:
    hits = occurrences(docs, target, whole_word).withColumn("value", F.lit(value))
    return tags.join(hits, ["doc_id", "lb", "ub", "value"], "left_anti")
