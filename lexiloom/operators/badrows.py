"""Loading rows held as text while setting apart those that don't parse (problem 6).

Lines are parsed in blocks by a fast columnar path, whose checks run over whole
columns. A block that holds anything the fast path can't vouch for is cut in
halves again and again, down to the single doubtful lines; those alone are read
by a strict parser that names the reason.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["sent", "pos", "word", "lb", "ub", "ner"]
#: Characters without ink that str.isspace() doesn't know.
INKLESS = {0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x2800, 0x3164, 0xFEFF, 0xFFA0, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)}
#: Those of them that count as letters, numbers, punctuation or symbols: the fillers of Hangul and the blank of Braille.
_FILLERS = "".join(chr(o) for o in sorted(INKLESS) if unicodedata.category(chr(o))[0] in "LNPS")
_DIGITS = frozenset("0123456789")


def blank(s: str) -> bool:
    return all(c.isspace() or ord(c) in INKLESS or unicodedata.category(c) in ("Cc", "Zs", "Zl", "Zp") for c in s)


def split_quoted(line: str, sep: str = "\t", quote: str = '"') -> list[str] | None:
    """The fields of a line, or None where its quoting is broken."""
    if quote not in line:
        return line.split(sep)
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == quote:
            i += 1
            part = []
            while True:
                j = line.find(quote, i)
                if j < 0:
                    return None
                part.append(line[i:j])
                if j + 1 < n and line[j + 1] == quote:
                    part.append(quote)
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < n and line[i] != sep:
                return None
            out.append("".join(part))
        else:
            j = line.find(sep, i)
            j = n if j < 0 else j
            if quote in line[i:j]:
                return None
            out.append(line[i:j])
            i = j
        if i >= n:
            return out
        i += 1  # the separator; a line that ends with one has an empty last field


def apart(lb: str, ub: str) -> Decimal:
    """ub - lb of two strings of digits, however long."""
    return Context(prec=max(len(lb), len(ub)) + 1).subtract(Decimal(ub), Decimal(lb))


_WHOLE = ("sent", "pos", "lb", "ub")
_LIMIT = 2**63


@dataclass(frozen=True)
class LineRules:
    """What a valid line of token rows looks like."""

    tags: frozenset[str]

    def diagnose(self, line: str | None) -> tuple[str | None, tuple | None]:
        """(reason, None) of a bad line, (None, row) of a good one, (None, None) of a comment or empty line.

        A row is (sent, pos, word, lb, ub, ner, beyond): a number that 64 bits don't hold is null, its digits are in the JSON object `beyond`.
        """
        if line is None:
            return "columns", None
        if line == "" or line.startswith("#"):
            return None, None
        f = split_quoted(line)
        if f is None:
            return "quoting", None
        if len(f) != len(FIELDS):
            return "columns", None
        sent, pos, word, lb, ub, ner = f
        if not all(x and _DIGITS.issuperset(x) for x in (sent, pos, lb, ub)) or blank(word):
            return "value", None
        if apart(lb, ub) != len(word):
            return "value", None
        if ner != "O" and not (ner[:2] in ("B-", "I-") and ner[2:] in self.tags):
            return "value", None
        bare = {n: x.lstrip("0") or "0" for n, x in zip(_WHOLE, (sent, pos, lb, ub), strict=True)}
        fits = {n: int(x) if len(x) < 20 and int(x) < _LIMIT else None for n, x in bare.items()}
        beyond = {n: bare[n] for n in _WHOLE if fits[n] is None}
        return None, (fits["sent"], fits["pos"], word, fits["lb"], fits["ub"], ner, json.dumps(beyond) if beyond else None)


_TYPES = {"sent": pa.int64(), "pos": pa.int64(), "word": pa.string(), "lb": pa.int64(), "ub": pa.int64(), "ner": pa.string(), "beyond": pa.string()}
#: A line of which every quoted field is plain: no tab, no quote inside.
_PLAIN = '^(?:"[^"\\t]*"|[^"\\t]*)(?:\\t(?:"[^"\\t]*"|[^"\\t]*))*$'
_INK = r"[\p{L}\p{N}\p{P}\p{S}]"


def fast_parse(lines: pa.Array, labels: pa.Array) -> tuple[np.ndarray, pa.Table]:
    """(which lines are sound, the typed columns of those that have six plain fields), for a whole block at once.

    Whatever column checks can't settle is in doubt: quotes or tabs within quotes, line
    ends, words without a letter, digit, punctuation or symbol, numbers of more than 18 digits.
    """
    ok = pc.and_not(pc.is_valid(lines), pc.fill_null(pc.match_substring_regex(lines, r"[\r\n\x00]"), True))
    quoted = pc.fill_null(pc.match_substring(lines, '"'), False)
    if pc.any(quoted).as_py():
        ok = pc.and_(ok, pc.or_(pc.invert(quoted), pc.fill_null(pc.match_substring_regex(lines, _PLAIN), False)))
        lines = pc.replace_substring(lines, '"', "")
    tabs = pc.fill_null(pc.count_substring(lines, "\t"), -1)
    at = pc.indices_nonzero(pc.and_(ok, pc.equal(tabs, len(FIELDS) - 1)))
    flat = pc.list_flatten(pc.split_pattern(lines.take(at), "\t"))
    step = pa.array(np.arange(0, len(at) * len(FIELDS), len(FIELDS)))
    t = {n: flat.take(pc.add(step, i)) for i, n in enumerate(FIELDS)}
    good = pa.array(np.ones(len(at), bool))
    for n in _WHOLE:
        digits = pc.match_substring_regex(t[n], "^[0-9]{1,18}$")
        good = pc.and_(good, digits)
        t[n] = pc.cast(pc.if_else(digits, t[n], "0"), pa.int64())
    good = pc.and_(good, pc.and_(pc.equal(pc.subtract(t["ub"], t["lb"]), pc.cast(pc.utf8_length(t["word"]), pa.int64())), pc.is_in(t["ner"], value_set=labels)))
    good = pc.and_(good, pc.and_not(pc.match_substring_regex(t["word"], _INK), pc.match_substring_regex(t["word"], f"[{_FILLERS}]")))
    sound = np.zeros(len(lines), bool)
    sound[at.to_numpy()[good.to_numpy(zero_copy_only=False)]] = True
    return sound, pa.table(t).filter(good)


def isolate(sound: np.ndarray) -> list[int]:
    """The doubtful lines of a block: it is bisected, and a half without any isn't looked into."""
    before = np.concatenate([[0], np.cumsum(~sound)])
    out, work = [], [(0, len(sound))]
    while work:
        lo, hi = work.pop()
        if before[lo] == before[hi]:
            continue
        if hi - lo == 1:
            out.append(lo)
            continue
        mid = (lo + hi) // 2
        work += [(mid, hi), (lo, mid)]
    return out


def _run(ids: list, rules: LineRules):
    names = [*[n for n, _ in ids], "reason", *_TYPES]

    def parse(b: pa.RecordBatch) -> pa.Table:
        labels = pa.array(["O", *(p + t for t in sorted(rules.tags) for p in ("B-", "I-"))], pa.string())
        raw = b.column(b.num_columns - 1)
        skip = pc.fill_null(pc.or_(pc.equal(raw, ""), pc.starts_with(raw, "#")), False)
        keep = pc.indices_nonzero(pc.invert(skip))
        lines = raw.take(keep)
        sound, t = fast_parse(lines, labels)
        bad = isolate(sound)
        found = [rules.diagnose(x) for x in lines.take(pa.array(bad, pa.int64())).to_pylist()]
        rows = [(r, *(row or (None,) * len(_TYPES))) for r, row in found]
        schema = pa.schema([("reason", pa.string()), *_TYPES.items()])
        strict = pa.Table.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        t = t.append_column("reason", pa.nulls(t.num_rows, pa.string())).append_column("beyond", pa.nulls(t.num_rows, pa.string())).select(schema.names).cast(schema)
        both = pa.concat_tables([t, strict])
        place = keep.take(pa.array(np.concatenate([np.flatnonzero(sound), np.array(bad, np.int64)])))
        return pa.table({**{n: b.column(i).take(place) for i, (n, _) in enumerate(ids)}, **{n: both[n] for n in schema.names}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from parse(b).select(names).combine_chunks().to_batches()

    return run


def parse_lines(rows: DataFrame, id_col: str, raw: str, tags: list[str], order: str | None = None) -> DataFrame:
    """(id, reason, sent, pos, word, lb, ub, ner, beyond): every line that holds a row or fails to.

    `reason` is null for valid rows, else the first that applies of `quoting`,
    `columns`, `value`; the columns of a failing line are null. Comments (`#` at
    the start) and empty lines give no row. A null line has no columns and fails
    as `columns`. Lines sent twice (same id) count once, the last by `order`.
    A number beyond 64 bits is valid, of whatever length; its column is null and
    its digits are in the JSON object `beyond`. `tags`, the tags a label may
    carry, is the small fixed tag table.
    """
    once = rows.select(F.col(id_col).alias("_id"), F.col(raw).cast("string").alias("_raw"), (F.col(order) if order else F.lit(0)).alias("_o"))
    once = once.groupBy("_id").agg(F.max(F.struct("_o", "_raw")).alias("_r")).select("_id", F.col("_r._raw").alias("_raw"))
    kind = rows.select(id_col).schema[0].dataType.simpleString()
    schema = f"_id {kind}, reason string, sent bigint, pos bigint, word string, lb bigint, ub bigint, ner string, beyond string"
    run = _run([("_id", kind)], LineRules(frozenset(t for t in tags if t)))
    return once.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def split_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and failed rows with their reason."""
    return parsed.where("reason is null").drop("reason"), parsed.where("reason is not null").select(parsed.columns[0], "reason")
