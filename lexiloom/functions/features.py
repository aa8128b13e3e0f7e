"""Token features as Column expressions.

Features of one token are plain expressions. Features that look at neighbours
are window expressions over (document, sentence) in token order; all of them
use one window specification, so any number of them costs one exchange and one
sort. Missing values follow one rule: a null word is no match, and a string
feature of it is null until `materialised` turns it into '#'.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

MISSING, EMPTY, UNTRIGGERED, UNMATCHED = "#", '""', "_untriggered_", "O"


def sentence_window(doc: str = "doc_id", sent: str = "sent", pos: str = "pos") -> WindowSpec:
    return Window.partitionBy(doc, sent).orderBy(pos)


def identity(c: Column) -> Column:
    return c


def bos(pos: Column) -> Column:
    return pos == 0


def eos(w: WindowSpec, pos: str = "pos") -> Column:
    return F.lead(pos).over(w).isNull()


def shifted(c: Column, shift: int, w: WindowSpec) -> Column:
    """The value `shift` tokens on; null outside the sentence."""
    return c if shift == 0 else F.lag(c, -shift).over(w) if shift < 0 else F.lead(c, shift).over(w)


def find_forward(match: Column, value: Column, w: WindowSpec) -> Column:
    """The value at the nearest following token that matches."""
    return F.first(F.when(match, value), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))


def find_backward(match: Column, value: Column, w: WindowSpec) -> Column:
    """The value at the nearest preceding token that matches."""
    return F.last(F.when(match, value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def lower(c: Column) -> Column:
    return F.lower(c)


def sliced(c: Column, start: int = 0, stop: int = 2**31, default: str = EMPTY) -> Column:
    """c[start:stop] with negative places counted from the end; `default` if that is empty."""
    n = F.length(c)

    def place(i: int) -> Column:
        return F.greatest(F.lit(0), n + i) if i < 0 else F.least(F.lit(i), n)

    a, b = place(start), place(stop)
    got = F.when(b > a, F.substring(c, a + 1, b - a)).otherwise("")
    return F.when(c.isNull(), None).when(got == "", default).otherwise(got)


def is_upper(c: Column, index: int = 0) -> Column:
    """Whether the character at `index` is an upper-case letter; false beyond the end."""
    n = F.length(c)
    ch = F.substring(c, (n + index + 1) if index < 0 else F.lit(index + 1), F.lit(1))
    inside = (n + index >= 0) if index < 0 else (n > index)
    return F.coalesce(inside & ch.rlike(r"^\p{Lu}$"), F.lit(False))


def java_replacement(repl: str) -> str:
    """A replacement with back references as the JVM writes them."""
    out = re.sub(r"\\(?!\d)(.)", r"\1", repl.replace("$", r"\$"))
    return re.sub(r"\\(\d)", r"$\1", out)


def substitute(c: Column, pattern: str, repl: str) -> Column:
    return F.regexp_replace(c, pattern, java_replacement(repl))


def sequence(c: Column, *steps) -> Column:
    """Each step reads what the one before gave."""
    return reduce(lambda x, f: f(x), steps, c)


def _flagged(pattern: str, nocase: bool, unicode: bool) -> str:
    return f"(?{'i' if nocase else ''}{'u' if nocase else ''}{'U' if unicode else ''}m){pattern}"


def matches(c: Column, pattern: str, nocase: bool = False, unicode: bool = True) -> Column:
    return F.coalesce(c.rlike(_flagged(pattern, nocase, unicode)), F.lit(False))


def matched_part(c: Column, pattern: str, default: str = MISSING, nocase: bool = False, unicode: bool = True) -> Column:
    """The matching substring, else the default; with an empty default the token itself."""
    p = _flagged(pattern, nocase, unicode)
    return F.when(F.coalesce(c.rlike(p), F.lit(False)), F.regexp_extract(c, p, 0)).otherwise(F.lit(default) if default else c)


def matched_token(c: Column, pattern: str, default: str = MISSING, nocase: bool = False, unicode: bool = True) -> Column:
    """The whole token if it matches, else the default."""
    return F.when(matches(c, pattern, nocase, unicode), c).otherwise(F.lit(default) if default else c)


def equals(c: Column, text: str, nocase: bool = False) -> Column:
    return F.coalesce((F.lower(c) == text.lower()) if nocase else (c == text), F.lit(False))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def both(*cs: Column) -> Column:
    return reduce(lambda a, b: a & b, map(_sure, cs))


def either(*cs: Column) -> Column:
    return reduce(lambda a, b: a | b, map(_sure, cs))


def negated(c: Column) -> Column:
    return ~_sure(c)


def some(*cs: Column) -> Column:
    return either(*cs)


def every(*cs: Column) -> Column:
    return both(*cs)


def none(*cs: Column) -> Column:
    return ~either(*cs)


def triggered(trigger: Column, operation: Column, default: str = UNTRIGGERED) -> Column:
    return F.when(_sure(trigger), operation).otherwise(F.lit(default))


def filled(condition: Column, entry: Column, filler: Column) -> Column:
    return F.when(_sure(condition), filler).otherwise(entry)


def materialised(c: Column, kind: str) -> Column:
    """A feature as it stands in the token table: booleans are 0 or 1, missing strings '#'."""
    return F.coalesce(c.cast("int"), F.lit(0)) if kind == "boolean" else F.coalesce(c.cast("string"), F.lit(MISSING))
