"""Sentence units in every language and script (problem 2).

A pushdown automaton reads the events of a text: terminators, openers and
closers of quotations and brackets, line ends, list markers, and the spaces of
scripts that end sentences with one. Its stack holds the open levels of lists,
by their indent, and above them the open quotations and brackets; a terminator
only ends a unit on an empty stack, a list item ends with its level or the next
item. Abbreviations are looked up in a trie, read from the terminator backwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .mojibake import Contexts, Repairer
from .normalize import INVISIBLE, canonical, char_class

# Abbreviations that don't end a sentence, lower case, without the last full stop.
NEVER_LAST = {
    "fr": "mm mme mmes mlle mlles dr drs pr me st ste sts stes mgr art p pp no nos cf env av pl trim bd boul fg chap éd fig vol p.ex réf tél c.-à-d dép",
    "en": "mr mrs ms dr prof st rev hon sgt capt lt gen col maj mt ft dept gov sen no nos p pp art fig vol approx ca cf e.g i.e vs viz eds blvd",
    "de": "dr prof hr fr st nr abs art s bd kap abb b z.b u.a d.h bzw ca vgl gem lt evtl ggf inkl zzgl sog geb",
    "es": "sr sra srta sres dr dra dña ud uds pág págs núm art cap vol aprox p.ej ej pza avda av fig gral prof",
    "it": "sig sig.ra sigg dott dott.ssa dr prof avv ing pag pagg n art cap vol ca cfr es p.es ad.es p.zza v fig",
    "pt": "sr sra dr dra d pág págs n núm art cap vol aprox p.ex pç av r fig prof eng exmo",
    "ru": "ул пл пр д кв стр с т тт см ср рис гл прим им ст проф акад доц",
    "hi": "डॉ प्रो श्री सं पृ",
    "ar": "د",
}
# Months after the ordinal of a day, lower case.
MONTHS = "januar jänner februar märz april mai juni juli august september oktober november dezember jahrhundert januar. leden tammikuuta jan feb mär apr jun jul aug sep sept okt nov dez"
# Legal forms of firms; a number after one goes on with the sentence.
FIRMS = frozenset("ltd inc corp co bros s.p.a s.r.l s.a s.l plc mfg".split())
# Abbreviations that are words too and only count before a number.
BEFORE_NUMBERS = frozenset("no nos n art fig vol cap s jan janv feb févr mar apr avr jun jul juil aug août sep sept oct okt nov dec déc dez ene abr ago dic gen mag giu lug ott set out fev mai".split())
#: Characters a clause of Thai has at least to be a unit of its own; a shorter one goes with its neighbour.
THAI_CLAUSE = 16
TERMINATORS = ".!?…。．！？｡؟۔।॥‼⁉⁇⁈"
CASELESS_ENDS = "。！？｡।॥؟۔"
OPEN = {"«": "»", "“": "”", "„": "“”", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉", "{": "}"}
CLOSE = set("»”“›」』)]）】》〉}\"’'")
QUOTE_CLOSE = set("»”“›」』\"’'")
_BULLET = re.compile(r"(?:[-–—*•◦‣▪●○·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][)])(?=\s)")
_INV = char_class(INVISIBLE)
_EVENTS = re.compile(rf"[{re.escape(TERMINATORS)}](?:[{_INV}]*\s?[{re.escape(TERMINATORS)}])*|[«»“”„‹›「」『』()\[\]（）【】《》〈〉{{}}\"]|\n[^\S\n]*(?:\n\s*)?|(?<=[\u0e00-\u0e7f])[^\S\n]+(?=[\u0e00-\u0e7fA-ZÀ-Þ])")


class Trie:
    """Abbreviations by their letters from last to first."""

    def __init__(self, words: set[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for ch in reversed(w):
                node = node.setdefault(ch, {})
            node[""] = True

    def ends(self, text: str, end: int) -> bool:
        """Whether an abbreviation fills text before `end` back to a word's start."""
        node, i = self.root, end
        while True:
            if "" in node and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] in ".-&")):
                return True
            if i == 0 or text[i - 1] not in node:
                return False
            i -= 1
            node = node[text[i]]


@lru_cache(1)
def _trie() -> Trie:
    words = {w for ws in NEVER_LAST.values() for w in ws.split()}
    return Trie(words | {w.capitalize() for w in words} | {w.upper() for w in words if len(w) == 1})


@lru_cache(1)
def _months() -> frozenset[str]:
    return frozenset(MONTHS.split())


_WORD, _HALF, _CHUNK, _DOTTED = re.compile(r"\w+"), re.compile(r"\w\."), re.compile(r"\S+"), re.compile(r"(?:[A-Z]\.)+[A-Z]")
_THAI_GAP = re.compile("(?<=[\u0e00-\u0e7f])[^\\S\n]+(?=[\u0e00-\u0e7fA-ZÀ-Þ])|\n")


def _skip(text: str, i: int) -> int:
    while i < len(text) and (text[i].isspace() or text[i] in INVISIBLE):
        i += 1
    return i


def _word_before(text: str, end: int) -> str:
    i = end
    while i and not text[i - 1].isspace():
        i -= 1
    return text[i:end]


def _abbreviated(text: str, dot: int, nxt: int) -> bool:
    """Whether the full stop at `dot` belongs to an abbreviation, an initial or an ordinal; `nxt` is where the text goes on."""
    word = canonical(_word_before(text, dot))
    if not word:
        return False
    bare = re.sub(r"^.*['’«“„(\[]", "", word)
    if len(bare) == 1 and bare.isalpha() and bare.isupper():
        return True
    if bare.lower() in FIRMS and text[nxt].isdigit():
        return True
    if len(bare) == 1 and bare.isalpha() and _HALF.match(text, nxt):
        return True  # the first half of an abbreviation of two letters
    if bare.lower() in BEFORE_NUMBERS:
        return text[nxt].isdigit() or text[nxt] in "IVXLC" and bare.lower() not in ("mar", "set", "mai", "out")
    if _DOTTED.fullmatch(bare) and (m := _WORD.match(text, nxt)) and text[m.end() : m.end() + 1] == "." and _trie().ends(text, m.end()):
        return True  # letters with full stops before another abbreviation
    if _trie().ends(word, len(word)):
        return True
    if bare.lower() in ("ex", "e", "h", "a") and re.search(r"(?:^|[\s(])\w\.\s?$", text[max(0, dot - len(bare) - 4) : dot - len(bare)]):
        return True  # the second half of an abbreviation of two letters
    if re.fullmatch(r"\d{1,2}", bare) and (m := _WORD.match(canonical(_CHUNK.match(text, nxt).group()))):
        return m.group().lower() in _months()
    return False


def _pairs(text: str, lo: int, hi: int) -> dict[int, int]:
    """Matching openers and closers of a paragraph; what has no partner doesn't nest."""
    stack: list[tuple[str, int]] = []
    found: dict[int, int] = {}
    for m in re.finditer(r"[«»“”„‹›「」『』()\[\]（）【】《》〈〉{}\"]", text[lo:hi]):
        ch, i = m.group(), lo + m.start()
        at = next((k for k in range(len(stack) - 1, -1, -1) if ch in (OPEN.get(stack[k][0]) or stack[k][0])), None)
        if at is not None and (ch != "“" or stack[at][0] == "„"):
            found[stack[at][1]] = i
            del stack[at:]
        elif ch in OPEN or ch == '"':
            stack.append((ch, i))
    return found


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in re.finditer(r"\n[^\S\n]*\n\s*|[\u2028\u2029\x0b\x0c]+", text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _list_marker(text: str, lo: int, hi: int) -> str | None:
    """The marker that the first line after an introducing line starts with."""
    line = text[lo:hi].split("\n", 1)[0]
    m = _BULLET.match(line)
    if m:
        return None
    head = line.split(None, 1)
    if len(head) < 2:
        return None
    again = sum(x.startswith(head[0] + " ") for x in text[lo:hi].split("\n")) > 1
    return head[0] if not head[0].isalpha() or again and len(head[0]) <= 3 else None


def _block_units(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    start = _skip_space(text, lo, hi)
    if start >= hi:
        return
    pairs = _pairs(text, lo, hi)
    closing = set(pairs.values())
    levels: list[int] = []  # the lower part of the stack: indents of the open lists; an item goes to the end of its line
    stack: list[int] = []  # the upper part: the closers that are awaited
    marker: str | None = None
    if _BULLET.match(text, start, hi):
        levels.append(_indent(text, start))

    def item(at: int) -> None:
        """Lists deeper than the item at `at` are over; it opens a level or goes on with its own."""
        while levels and levels[-1] > _indent(text, at):
            levels.pop()
        if not levels or levels[-1] < _indent(text, at):
            levels.append(_indent(text, at))

    for m in _EVENTS.finditer(text, lo, hi):
        i, ev = m.start(), m.group()
        if i < start:
            continue
        ch = ev[0]
        if ch == "\n":
            nxt = _skip_space(text, m.end(), hi)
            before = text[start:i].rstrip()
            if not before or nxt >= hi:
                continue
            bullet = bool(_BULLET.match(text, nxt, hi)) or (marker is not None and text.startswith(marker, nxt))
            if before.endswith((":", "：")):
                if not bullet:
                    marker = _list_marker(text, nxt, hi) or marker
                cut = True
                bullet = bullet or marker is not None
            else:
                cut = bullet or _thai(before[-1])  # a terminator has had its say already
            if levels and not bullet and not cut:
                # a wrapped item goes on in lower case or indented; anything else leaves the list
                cut = not text[nxt].islower() and before[-1] in TERMINATORS and _indent(text, nxt) <= levels[-1]
            if cut:
                yield start, start + len(before)
                start, stack = nxt, []
                if bullet:
                    item(nxt)
                else:
                    levels.clear()
            continue
        if ch.isspace():  # the space that ends a Thai sentence
            if not stack and not levels and i - start >= THAI_CLAUSE:
                gap = _THAI_GAP.search(text, m.end(), hi)
                if (gap.start() if gap else hi) - m.end() >= THAI_CLAUSE:
                    yield start, i
                    start = m.end()
            continue
        if ch not in TERMINATORS:
            if i in pairs:
                stack.append(pairs[i])
            elif i in closing and i in stack:
                del stack[stack.index(i) :]
            continue
        end = m.end()
        if levels or stack and not _closes_here(text, end, hi, stack):
            continue
        quoted = False
        rest = list(stack)
        j = end
        while True:  # closing marks belong to the unit, the spaces before them too
            k = j
            while k < hi and (text[k] in " \u00a0\u202f" or text[k] in INVISIBLE):
                k += 1
            if k < hi and (k in closing and k in rest):
                quoted = quoted or text[k] in QUOTE_CLOSE
                del rest[rest.index(k) :]
                j = k + 1
            elif k < hi and k == j and text[k] in "’'\"" and k not in pairs:
                j = k + 1
            elif k > j and all(c in INVISIBLE for c in text[j:k]):
                j = k
            elif j < hi and text[j] in TERMINATORS:
                j += 1
            else:
                break
        if rest:
            continue
        nxt = _skip(text, j)
        if nxt < hi and _cut_after(text, ev, i, end, j, nxt, hi, quoted):
            yield start, j
            start, stack = _skip_space(text, j, hi), []
            if "\n" in text[j:nxt] and _BULLET.match(text, nxt, hi):
                item(nxt)
    tail = text[start:hi].rstrip()
    if tail:
        yield start, start + len(tail)


def _indent(text: str, at: int) -> int:
    return at - (text.rfind("\n", 0, at) + 1)


def _skip_space(text: str, i: int, hi: int) -> int:
    while i < hi and text[i].isspace():
        i += 1
    return i


def _thai(ch: str) -> bool:
    return "\u0e00" <= ch <= "\u0e7f"


def _east(ch: str) -> bool:
    return "\u3040" <= ch <= "ヿ" or "㐀" <= ch <= "鿿" or ch in "「『“《〈（"


def _closes_here(text: str, end: int, hi: int, stack: list[int]) -> bool:
    j = _skip(text, end)
    return j < hi and j in stack


def _cut_after(text: str, ev: str, i: int, end: int, j: int, nxt: int, hi: int, quoted: bool) -> bool:
    """Whether a unit ends after the terminators text[i:end] and the closing marks up to j; nxt is what follows."""
    after = text[nxt]
    spaced = nxt > j and any(c.isspace() for c in text[j:nxt])
    newline = "\n" in text[j:nxt]
    if ev[-1] in CASELESS_ENDS or ev[0] in CASELESS_ENDS:
        if quoted and not newline:  # the clause that reports a quotation goes with it
            return after in "「『“«"
        return after not in "，、；：,;:)）"
    if not spaced and not _east(after) and not _thai(after):
        return False
    if after in ",;:)]}»”，、；" or after in "—–-" and not _BULLET.match(text, nxt, hi):
        return False
    if after in "—–-":
        return newline
    if ev == "." and _abbreviated(text, i, nxt):
        return False
    if after.islower():
        return False
    return not (quoted and after.isdigit())


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, length) of each sentence unit, in code points; none for null and blank texts."""
    if not text:
        return []
    return [(s, e - s) for lo, hi in _blocks(text) for s, e in _block_units(text, lo, hi)]


def restored_units(text: str | None, repair: Repairer) -> list[tuple[int, int, str]]:
    """(start, length, restored text) of the units of a text, found in its restored form where it is garbled, placed in the text as it is."""
    if not text:
        return []
    clean, at = repair.aligned(text)
    if at is None:
        return [(s, n, text[s : s + n]) for s, n in units(text)]
    out: list[list] = []
    for s, n in units(clean):
        lo, hi = at[s], at[s + n]
        if out and text[out[-1][1] : lo].strip():  # what was restored to a space belongs to the unit before
            out[-1][1] = lo
        out.append([lo, hi, clean[s : s + n]])
    if out and text[out[-1][1] :].strip():
        out[-1][1] = len(text)
    if out and text[: out[0][0]].strip():
        out[0][0] = 0
    fitted = []
    for lo, hi, shown in out:
        part = text[lo:hi]
        if part.strip():
            fitted.append((lo + len(part) - len(part.lstrip()), len(part.strip()), shown))
    return fitted


def _run(samples: tuple[str, ...] | Contexts):
    pair = pa.list_(pa.struct([("s", pa.int32()), ("l", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repairer(samples) if samples else None
        for b in batches:
            found = [[{"s": x[0], "l": x[1]} for x in (restored_units(t, repair) if repair else units(t))] for t in b.column(2).to_pylist()]
            yield batch(b, found)

    def batch(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pair)], names=["doc_id", "_o", "units"])

    return run


def sentence_units(docs: DataFrame, doc: str = "doc_id", text: str = "content", order: str | None = None, only: DataFrame | None = None, samples: tuple[str, ...] | Contexts = ()) -> DataFrame:
    """(doc_id, s, l) of every sentence unit of each document.

    With clean sample texts, units of garbled texts are found in their restored form.
    Of a document sent several times the row last by `order` counts; with `only`,
    a table of doc_ids, other documents give nothing. Null, empty and blank
    texts give no unit. Units don't overlap and hold every non-space character.
    Texts are read where they are: only the places of units are shuffled.
    """
    picked = docs.select(F.col(doc).alias("doc_id"), (F.col(order) if order else F.lit(0)).alias("_o"), F.col(text).cast("string").alias("_t")).where("doc_id is not null")
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    rows = spread(picked).mapInArrow(_run(samples), f"doc_id {kinds['doc_id']}, _o {kinds['_o']}, units array<struct<s:int,l:int>>")
    last = rows.groupBy("doc_id").agg(F.max(F.struct("_o", "units")).alias("_r")).select("doc_id", "_r.units")
    if only is not None:
        last = last.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    return last.select("doc_id", F.explode("units").alias("u")).select("doc_id", "u.s", "u.l")
