"""Occurrences and document frequency of every distinct term (problem 4).

Heavy-light aggregation. A bounded sketch over all rows names the heavy terms
first. Rows are then dealt out by document, once: there repeated rows fall out,
the heavy terms are counted into exact local arrays, and only counts of the
other terms are shuffled on. Both count tables are united.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most terms treated as heavy. Bounds what is collected and broadcast, whatever the input's size.
HEAVY_TERMS = 2_000
#: Counters of the sketch; it misses no term above rows / SKETCH_COUNTERS.
SKETCH_COUNTERS = 16_384
#: Positions of a document that are dealt out together; a longer document is parted, its document counts being made up apart.
PART = 65_536
#: Digests of runs a task remembers to drop a run it has sent on already.
REMEMBERED = 200_000


def surveyed(rows: DataFrame, term: str, position: str, limit: int = HEAVY_TERMS, counters: int = SKETCH_COUNTERS) -> tuple[list[str], int]:
    """(at most `limit` frequent terms, the greatest position), from one pass with a frequent-items sketch.

    The choice of terms only steers which path counts them, so an inexact sketch
    does not touch the result.
    """
    top, most = rows.agg(F.expr(f"approx_top_k(`{term}`, {max(limit, 1)}, {max(counters, 2 * limit)})"), F.max(position)).first()
    return sorted(x["item"] for x in (top or ())[:limit] if x["item"] is not None), most or 0


def _offsets(col: pa.Array) -> np.ndarray:
    return np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int32)


def _runs(width: int):
    """Neighbouring rows of one document and load as one row each: positions as steps, words as one text with lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            doc, at, pos, words = b.column(0), b.column(1), b.column(2).to_numpy(), b.column(3)
            codes = pc.rank(doc, tiebreaker="dense").to_numpy() if not pa.types.is_integer(doc.type) else doc.to_numpy()
            when = at.to_numpy()
            part = np.maximum(pos, 0) // width
            first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (when[1:] != when[:-1]) | (part[1:] != part[:-1])])
            ends = np.r_[first[1:], n]
            offs = _offsets(words)
            lens = np.where(words.is_null().to_numpy(zero_copy_only=False), -1, np.diff(offs)).astype(np.int32)
            steps = np.diff(pos, prepend=0)
            steps[first] = pos[first]
            cuts = pa.array(np.r_[first, n].astype(np.int32))
            text = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.ascontiguousarray(offs[np.r_[first, n]], np.int32)), words.buffers()[2] or pa.py_buffer(b""))
            out = pa.RecordBatch.from_arrays([doc.take(pa.array(first)), at.take(pa.array(first)), pa.array(part[first]), pa.ListArray.from_arrays(cuts, pa.array(steps)), pa.ListArray.from_arrays(cuts, pa.array(lens)), text], names=["_doc", "_at", "_part", "_steps", "_lens", "_text"])
            keep = []
            # a run sent again by a later load of the same content is the same run: later rows of equal content change nothing
            for i, (a, z) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
                h = hash((codes[a].item(), when[a].item(), steps[a:z].tobytes(), lens[a:z].tobytes(), text[i].as_py()))
                if h not in sent:
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(h)
                    keep.append(i)
            yield out if len(keep) == out.num_rows else out.take(pa.array(keep, pa.int64()))

    return run


def _count(heavy: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(heavy, pa.string())
        occ, docs = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)

        def counted(b: pa.RecordBatch) -> pa.RecordBatch | None:
            """The counts of the light terms of whole (document, part) groups; heavy ones go to the arrays."""
            doc, part = b.column(0), b.column(2).to_numpy()
            codes = pc.rank(doc, tiebreaker="dense").to_numpy() if not pa.types.is_integer(doc.type) else doc.to_numpy()
            fresh = np.r_[True, (codes[1:] != codes[:-1]) | (part[1:] != part[:-1])]
            sizes = np.diff(_offsets(b.column(3)))
            group = np.repeat(np.cumsum(fresh) - 1, sizes)
            steps = b.column(3).flatten().to_numpy()
            heads = np.cumsum(sizes) - sizes
            total = np.cumsum(steps)
            pos = total - np.repeat(np.where(heads > 0, total[heads - 1], 0), sizes) if len(steps) else total
            lens = b.column(4).flatten().to_numpy()
            offs = np.r_[0, np.cumsum(np.maximum(lens, 0))].astype(np.int64)
            text = b.column(5)
            base = int(_offsets(text)[0])
            words = pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(np.ascontiguousarray(offs + base)), text.buffers()[2] or pa.py_buffer(b""))
            # of rows with one key the last counts: runs are in order of their load
            place = np.lexsort((np.arange(len(pos)), pos, group))
            last = np.r_[(group[place][1:] != group[place][:-1]) | (pos[place][1:] != pos[place][:-1]), True] if len(place) else np.zeros(0, bool)
            rows = place[last]
            rows = rows[lens[rows] >= 0]
            if not len(rows):
                return None
            enc = words.take(pa.array(rows)).dictionary_encode()
            code, terms = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary.cast(pa.string())
            width = len(terms)
            pairs = np.unique(group[rows] * width + code)
            whole = part[np.flatnonzero(fresh)][pairs // width] == 0  # other parts' documents are made up apart
            n = np.bincount(code, minlength=width)
            d = np.bincount(pairs % width, weights=whole, minlength=width).astype(np.int64)
            at = pc.index_in(terms, value_set=known)
            light = at.is_null().to_numpy(zero_copy_only=False)
            idx = at.drop_null().to_numpy().astype(np.int64)
            occ[idx] += n[~light]
            docs[idx] += d[~light]
            return pa.RecordBatch.from_arrays([terms.filter(pa.array(light)), pa.array(n[light]), pa.array(d[light])], names=["term", "occ", "docs"])

        held: pa.RecordBatch | None = None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.concat_batches([held, b])
            doc, part = b.column(0), b.column(2)
            same = pc.and_(pc.equal(doc, doc[-1]), pc.equal(part, part[-1])).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on in the next batch
            held = b.slice(cut)
            if cut and (out := counted(b.slice(0, cut).take(pa.array(np.arange(cut))))) is not None:
                yield out
        if held is not None and (out := counted(held.take(pa.array(np.arange(held.num_rows))))) is not None:
            yield out
        seen = np.flatnonzero(occ)
        if len(seen):
            yield pa.RecordBatch.from_arrays([known.take(pa.array(seen)), pa.array(occ[seen]), pa.array(docs[seen])], names=["term", "occ", "docs"])

    return run


def term_frequency(
    rows: DataFrame,
    doc: str,
    position: str,
    term: str,
    order: str | None = None,
    min_docs: int = 3,
    max_share: float = 0.2,
    heavy_limit: int = HEAVY_TERMS,
    part: int = PART,
) -> DataFrame:
    """(term, occurrences, documents, total_documents, mark) for every distinct non-null term.

    (`doc`, `position`) identifies a row; of repeated rows the last by `order`
    counts, of equal ones the run of rows with the greatest text. `mark` is
    `rare` below `min_docs` documents, `common` above `max_share` of all
    distinct `doc` values (also those whose terms are all null), else null.
    Null documents are no document: their rows are left out; a null position is
    a position of its own. Terms are compared code point for code point; the
    empty string is a term. An empty table gives no rows. Columns other than
    those named are ignored, so clashing names in the input do no harm.

    Rows are shuffled once, by document and stretch of `part` positions, packed
    to one row a run, so that neither a long document nor one sent again and
    again makes a hot task. A term, which can be hot, is only shuffled outside
    the heavy list, as counts already summed up.
    """
    when = F.coalesce(F.unix_micros(F.col(order).cast("timestamp")) if order and dict(rows.dtypes)[order] == "timestamp_ntz" else F.unix_micros(order) if order and dict(rows.dtypes)[order] == "timestamp" else F.col(order).cast("long") if order else F.lit(0).cast("long"), F.lit(-(2**62)))
    rows = rows.select(F.col(doc).alias("_doc"), when.alias("_at"), F.coalesce(F.col(position).cast("long"), F.lit(-(2**40))).alias("_pos"), F.col(term).cast("string").alias("_term")).where("_doc is not null")
    kind = rows.schema["_doc"].dataType.simpleString()
    heavy, most = surveyed(rows, "_term", "_pos", heavy_limit)
    packed = rows.mapInArrow(_runs(part), f"_doc {kind}, _at bigint, _part bigint, _steps array<bigint>, _lens array<int>, _text string")
    dealt = packed.repartition("_doc", "_part").sortWithinPartitions("_doc", "_part", "_at", "_text")
    counted = dealt.mapInArrow(_count(heavy), "term string, occ bigint, docs bigint")
    if most >= part:  # documents longer than a part: their terms beyond it that the first part doesn't hold
        long_rows = rows.join(rows.where(F.col("_pos") >= part).select("_doc").distinct(), "_doc", "left_semi")
        last = long_rows.groupBy("_doc", "_pos").agg(F.max(F.struct("_at", "_term")).alias("_r")).select("_doc", (F.col("_pos") >= part).alias("_far"), F.col("_r._term").alias("term")).where("term is not null")
        only = last.groupBy("_doc", "term").agg(F.bool_and("_far").alias("_only")).where("_only")
        counted = counted.unionByName(only.groupBy("term").agg(F.lit(0).cast("long").alias("occ"), F.count("*").alias("docs")))
    both = counted.groupBy("term").agg(F.sum("occ").alias("occurrences"), F.sum("docs").alias("documents"))
    total = rows.select("_doc").distinct().agg(F.count("*")).scalar()
    both = both.withColumn("total_documents", total)
    common = F.col("documents") > F.lit(Decimal(str(max_share))) * F.col("total_documents")
    return both.withColumn("mark", F.when(F.col("documents") < min_docs, "rare").when(common, "common"))
