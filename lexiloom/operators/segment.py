"""Tokens, sentences and paragraphs with exact code-point offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space in patterns that the JVM and RE2 read alike.
SPACE = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def whitespace_tokens(docs: DataFrame, doc: str = "doc_id", text: str = "content") -> DataFrame:
    """(doc_id, tok, lb, ub, word): the longest runs of non-space characters.

    Offsets are running lengths of the pieces, spaces included; positions of
    regular expressions aren't used, as the JVM counts them in other units.
    Null and blank texts give none.
    """
    pieces = F.regexp_extract_all(F.col("_t"), F.lit(f"([{SPACE}]+|[^{SPACE}]+)"), F.lit(1))
    d = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("_t")).where("_t is not null")
    d = d.select("doc_id", pieces.alias("_p"))
    w = Window.partitionBy("doc_id").orderBy("_i")
    e = d.select("doc_id", F.posexplode("_p").alias("_i", "word"))
    e = e.withColumn("lb", (F.sum(F.length("word")).over(w) - F.length("word")).cast("int"))
    e = e.where(~F.col("word").rlike(f"^[{SPACE}]"))
    return e.select("doc_id", (F.row_number().over(w) - 1).alias("tok"), "lb", (F.col("lb") + F.length("word")).alias("ub"), "word")


# --- tokenisers as pure functions on one text: [(lb, ub)] ---

_URL = re.compile(r"<?(?:(?:https?|ftps?|file)://|mailto:|www\.)\S*[\w/]>?", re.IGNORECASE)
_MAIL = re.compile(r"[\w.!#$%&'*+/=?^`{|}~-]*[\w]@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
# French titles, abbreviations that stay whole, and pronouns split off after a hyphen; signs that stand alone.
FR_TITLES = "dr m mr ms mrs mm mms mme mmes mlle mlles melle melles st".split()
FR_ABBREVIATIONS = "i.e. e.g. c-à-d".split()
FR_PRONOUNS = "je tu nous vous".split()
FR_PRONOUNS_T = "on il ils elle elles".split()
FR_ALONE = frozenset(";:«»()[]{}=+*$£€/\\\"?!…%")
EN_ALONE = FR_ALONE - {"…"}
APOSTROPHES = "'ʼ’"


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


_FR_TITLE = re.compile(rf"\b(?:{_any(FR_TITLES)})\b\.?", re.IGNORECASE)
_FR_ABBREV = re.compile(rf"\b(?:{_any(FR_ABBREVIATIONS)})", re.IGNORECASE)
_CLITIC = rf"(?:-(?:{_any(FR_PRONOUNS)})|(?:-t)?-(?:{_any(FR_PRONOUNS_T)}))"
_FR_CLITICS = re.compile(rf"{_CLITIC}\b", re.IGNORECASE)
_FR_SUFFIX = re.compile(rf"{_CLITIC}$", re.IGNORECASE)
#: Between a digit and what is neither digit, comma nor full stop.
_UNIT = re.compile(r"(?<=[0-9])(?=[^0-9,.])|(?<=[^0-9,.])(?=[0-9])")


def _outside(spans: list[tuple[int, int]], i: int) -> bool:
    return not any(a < i < b for a, b in spans)


def fr_bounds(text: str) -> list[tuple[int, int]]:
    """French tokens by boundaries: spaces part, some signs stand alone, and no cut falls into a URL, address, title or abbreviation."""
    keep = [m.span() for p in (_URL, _MAIL, _FR_TITLE, _FR_ABBREV) for m in p.finditer(text)]
    keep += [m.span() for m in re.finditer(r"\.{2,}|\d+(?:[.,]\d+)+", text)]
    cuts: set[int] = set()
    n = len(text)
    joins = lambda c: c.isupper() or c in "0123456789,.-"
    for i, c in enumerate(text):
        if c in FR_ALONE or c in ".,":
            cuts.update((i, i + 1))
        elif c in APOSTROPHES:
            cuts.add(i + 1)
        elif c == "-" and (i == 0 or text[i - 1].isspace() or i + 1 == n or text[i + 1].isspace()):
            cuts.update((i, i + 1))
        elif c.isdigit():
            if i and not joins(text[i - 1]):
                cuts.add(i)
            if i + 1 < n and not joins(text[i + 1]):
                cuts.add(i + 1)
    cuts = {i for i in cuts if _outside(keep, i)}
    for m in _FR_CLITICS.finditer(text):  # forced, whatever they stand in
        cuts.update((m.start(), m.end()))
    return _pieces(text, cuts)


def _pieces(text: str, cuts: set[int]) -> list[tuple[int, int]]:
    out = []
    for m in re.finditer(r"\S+", text):
        a, b = m.span()
        edges = [a, *sorted(i for i in cuts if a < i < b), b]
        out += list(zip(edges, edges[1:], strict=False))
    return out


def _refined(s: str) -> list[int]:
    """Where the first rule that applies cuts a chunk: signs, commas, apostrophes, pronouns, numbers with units, the last stop."""
    at = next((i for i, c in enumerate(s) if c in FR_ALONE), None)
    if at is not None:
        return [at, at + 1]
    if m := re.search(r"(?<=[^0-9]),(?![0-9])", s):
        return [m.start(), m.end()]
    if m := re.search(f"[{APOSTROPHES}](?=.)", s):
        return [m.end()]
    if (m := _FR_SUFFIX.search(s)) and m.start():
        return [m.start()]
    if m := _UNIT.search(s):
        return [m.start()]
    return [len(s) - 1] if s[-1] in ".," and not (len(s) == 2 and s[0].isupper()) else []


def fr_spans(text: str) -> list[tuple[int, int]]:
    """French tokens as the pipeline cuts them: chunks between spaces, refined rule by rule until nothing changes.

    A chunk that begins with a URL, address, title or abbreviation stays whole.
    """
    out: list[tuple[int, int]] = []
    work = [m.span() for m in re.finditer(r"\S+", text)][::-1]
    while work:
        a, b = work.pop()
        s = text[a:b]
        whole = len(s) == 1 or s.isalpha() or any(p.match(s) for p in (_URL, _MAIL, _FR_ABBREV, _FR_TITLE))
        edges = [0, *(i for i in ([] if whole else _refined(s)) if 0 < i < len(s)), len(s)]
        if len(edges) == 2:
            out.append((a, b))
        else:
            work += [(a + x, a + y) for x, y in zip(edges, edges[1:], strict=False)][::-1]
    return out


def en_bounds(text: str) -> list[tuple[int, int]]:
    """English tokens: atomic signs alone, n't and 's split off, full stops and commas after digits only inside numbers."""
    cuts: set[int] = set()
    for i, c in enumerate(text):
        if c in EN_ALONE:
            cuts.update((i, i + 1))
        elif c in ".,":
            inside = i and i + 1 < len(text) and text[i - 1].isdigit() and text[i + 1].isdigit()
            if not inside:
                cuts.update((i, i + 1))
    for m in re.finditer(r"n['’]t\b|['’](?:s|re|ve|ll|d|m)\b|''|``", text, re.IGNORECASE):
        cuts.update((m.start(), m.end()))
    keep = [m.span() for p in (_URL, _MAIL) for m in p.finditer(text)] + [m.span() for m in re.finditer(r"\.{2,}", text)]
    return _pieces(text, {i for i in cuts if _outside(keep, i)})


def default_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


#: Tokenisers by name; add to it to extend.
TOKENISERS: dict[str, Callable[[str], list[tuple[int, int]]]] = {"fr": fr_spans, "fr_bounds": fr_bounds, "en": en_bounds, "default": default_spans}


def get_tokeniser(name: str) -> Callable[[str], list[tuple[int, int]]]:
    try:
        return TOKENISERS[name]
    except KeyError:
        raise ValueError(f"no tokeniser {name!r}; there are {', '.join(sorted(TOKENISERS))}") from None


def tokenise(docs: DataFrame, tokeniser: str, doc: str = "doc_id", text: str = "content", gaps: bool = False) -> DataFrame:
    """(doc_id, tok, lb, ub, word) by a named tokeniser, in Arrow batches and without a shuffle.

    With `gaps` also `gap_newlines`, the line ends between a token and the next; 0 for the last. Null and blank texts give no token.
    """
    cut = get_tokeniser(tokeniser)
    names = ["doc_id", "tok", "lb", "ub", "word", *(["gap_newlines"] if gaps else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    found = cut(t)
                    if gaps:
                        after = [t.count("\n", z, a) for (_, z), (a, _) in zip(found, found[1:], strict=False)] + [0]
                        rows += [(i, k, a, z, t[a:z], g) for k, ((a, z), g) in enumerate(zip(found, after, strict=False))]
                    else:
                        rows += [(i, k, a, z, t[a:z]) for k, (a, z) in enumerate(found)]
                if len(rows) > 100_000:
                    yield out(b, rows)
                    rows = []
            if rows:
                yield out(b, rows)

    def out(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()), strict=False))], names=names)

    kind = docs.select(doc).schema[0].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("_t")).mapInArrow(run, f"doc_id {kind}, tok int, lb int, ub int, word string{', gap_newlines int' if gaps else ''}")


# Tokens that open and close what a full stop doesn't end, by language.
NESTING = {"fr": ("«([", "»)]"), "en": (("«", "(", "[", "``"), ("»", ")", "]", "''"))}


def newlines_after(tokens: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "content") -> DataFrame:
    """`tokens` (doc_id, tok, lb, ub) with `gap_newlines`, the line ends between a token and the next; 0 for the last and where the text is missing."""
    w = Window.partitionBy("doc_id").orderBy("tok")
    t = tokens.withColumn("_next", F.lead("lb").over(w)).join(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("_t")), "doc_id", "left")
    gap = F.expr("substring(_t, ub + 1, _next - ub)")
    return t.withColumn("gap_newlines", F.coalesce(F.length(gap) - F.length(F.replace(gap, F.lit("\n"), F.lit(""))), F.lit(0))).drop("_next", "_t")


def sentence_ids(tokens: DataFrame, variant: str = "fr") -> DataFrame:
    """`tokens` (doc_id, tok, lb, ub, word) with `sent`.

    `fr` and `en`: a sentence ends after ?, !, runs of them, an ellipsis or two
    full stops and more, and after one full stop outside brackets and quotations.
    `fr` also ends one where more than one line end follows a token other than
    a full stop, if a column `gap_newlines` counts them. `default`: tokens that
    are line ends part sentences and belong to none (`sent` is null). A null
    word ends nothing by itself.
    """
    w = Window.partitionBy("doc_id").orderBy("tok")
    word = F.col("word")
    if variant == "default":
        cut = F.coalesce(word.isin("\r", "\n", "\r\n"), F.lit(False))
        return tokens.withColumn("sent", F.when(~cut, F.sum(cut.cast("int")).over(w).cast("int")))
    if variant not in NESTING:
        raise ValueError(f"no rules of sentences {variant!r}; there are default, {', '.join(sorted(NESTING))}")
    opens, closes = (word.isin(*x) for x in NESTING[variant])
    t = tokens.withColumn("_depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w))
    ends = F.coalesce(word.rlike(r"^([?!]+|…|\.\.+.*)$") | ((word == ".") & (F.col("_depth") == 0)), F.lit(False))
    if variant == "fr" and "gap_newlines" in tokens.columns:
        ends = ends | F.coalesce((F.col("gap_newlines") > 1) & ~word.eqNullSafe("."), F.lit(False))
    t = t.withColumn("_end", ends.cast("int"))
    return t.withColumn("sent", (F.sum("_end").over(w) - F.col("_end")).cast("int")).drop("_depth", "_end")


def paragraph_ids(sentences: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "content") -> DataFrame:
    """Sentences (doc_id, sent, lb, ub) with `par`: a new one where the gap before holds more than one line end."""
    w = Window.partitionBy("doc_id").orderBy("sent")
    s = sentences.withColumn("_before", F.lag("ub").over(w))
    s = s.join(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("_t")), "doc_id")
    gap = F.expr("substring(_t, _before + 1, lb - _before)")
    new = F.coalesce((F.length(gap) - F.length(F.replace(gap, F.lit("\n"), F.lit("")))) > 1, F.lit(False)).cast("int")
    return s.withColumn("_new", new).withColumn("par", F.sum("_new").over(w).cast("int")).drop("_before", "_t", "_new")


def lines(tokens: DataFrame, sep: str = " ", end: str = "\n") -> DataFrame:
    """(doc_id, text): tokens of a sentence joined by `sep`, sentences by `end`, in order."""
    s = tokens.groupBy("doc_id", "sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word", F.lit("")).alias("word")))), lambda x: x["word"]), sep).alias("line"))
    return s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent", "line"))), lambda x: x["line"]), end).alias("text"))


# --- markup ---

_TAG = re.compile(r"(?s)<[^>]*>")


def strip_tags(html: str = "html"):
    """Tags deleted and non-breaking space entities turned into spaces, as a Column."""
    return F.regexp_replace(F.regexp_replace(F.col(html), r"(?s)<.+?>", ""), "&nbsp;|&#160;", " ")


def blanked(html: str | None, keep_offsets: bool = True) -> str | None:
    """Text of headings and paragraphs only.

    With offsets kept, all else turns into as many spaces, so that places in the
    result are places in the source. Without a heading or paragraph: empty.
    """
    if html is None:
        return None
    out = list(" " * len(html))
    hidden = [m.span() for m in re.finditer(r"(?is)<(script|head|nav|style)\b.*?</\1\s*>", html)]
    regions, at = [], 0
    for m in re.finditer(r"(?is)<(h\d|p)\b[^>]*>.*?</\1\s*>", html):
        if m.start() >= at:
            regions.append(m.span())
            at = m.end()
    if not regions:
        return ""
    for a, b in regions:
        i = a
        for m in _TAG.finditer(html, a, b):
            out[i : m.start()] = html[i : m.start()]
            i = m.end()
        out[i:b] = html[i:b]
    for a, b in hidden:
        out[a:b] = " " * (b - a)
    text = "".join(out)
    for entity in ("&nbsp;", "&#160;"):
        text = text.replace(entity, " " * len(entity) if keep_offsets else " ")
    return text if keep_offsets else re.sub(r"[ \t]{2,}", " ", text).strip()


def blank_markup(docs: DataFrame, doc: str = "doc_id", html: str = "html", keep_offsets: bool = True) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([blanked(t, keep_offsets) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "content"])

    kind = docs.select(doc).schema[0].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc_id"), F.col(html).cast("string").alias("_t")).mapInArrow(run, f"doc_id {kind}, content string")
