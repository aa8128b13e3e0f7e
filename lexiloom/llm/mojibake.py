"""Text that was decoded with the wrong character encoding (problem 7).

A best-first search walks the texts reachable by encode, decode and unescape
operations. States are told apart by their hash; a character-plausibility cost,
learnt from clean samples, leads the search to the cheapest reachable text.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .normalize import canonical

# Encodings a text may have been read in, and those single-byte texts are written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "iso8859-15")
WRITTEN_IN = ("cp1252", "mac_roman", "cp850", "cp1251", "koi8-r", "cp866", "cp1256", "cp874")
MULTIBYTE = ("gb18030", "euc_jp", "shift_jis", "euc_kr", "big5")
TYPOGRAPHIC = "«»“”„‘’…–—•"
#: Gain in cost from which a stretch counts as garbled, and what each operation costs.
GAIN, STEP = 3.0, 0.5
#: What a byte sequence read again promises.
READ_AGAIN = 10.0

_HIGH = re.compile(r"[^\x00-\x7f]")
_OPENING, _CLOSING = "«“„\"‹「『", "»”“\"›」』"
#: One word in quotes, or signs beyond ASCII: what a text about such sequences holds.
_MENTION = re.compile(rf"(?<![^\s(\[–—-])[{_OPENING}]\s*(?:[^\s{_OPENING}{_CLOSING}]*[^\x00-\x7f\s{_OPENING}{_CLOSING}][^\s{_OPENING}{_CLOSING}]*|[^\x00-\x7f\s]+?)\s*[{_CLOSING}](?![^\W_]|[{_CLOSING}])")
_ASKED = re.compile(r"(?<=[a-zà-ÿ]{2})\?(?=[a-zà-ÿ])")
_ESCAPED = re.compile(r"&(?:[a-zA-Z]{2,32}|#\d{2,7}|#x[0-9a-fA-F]{2,6});")
#: What must stand somewhere in a text for it to be looked at: no text without it holds a doubtful character.
_L = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"
_SIGNS = "¢£¤¥¦§¨©¬®¯±´µ¶·¸¼½¾×÷†‡ˆ‰˜™€‚ƒ„‹›•…√∂∑∏∫∞≈≠≤≥◊⌐¬∩≡⌠⌡"
_SUSPECT = re.compile(
    "[\u0080-\u009f\u0100-\u0130\u0132-\u0151\u0154-\u02c5\u02c7-\u02db\u02dd-\u02ff\u0300-\u036f\u0400\u0402-\u040f\u0450\u0452-\u052f\u0530-\u05ff\ue000-\uf8ff\uff61-\uff9f\ufffd]"
    f"|(?<=[a-zß-öø-ÿœа-яёα-ω])[À-ÖØ-ÞŒŸА-ЯЁΑ-Ω]|(?<=[{_L}\u0370-\u052f])[{_SIGNS}«“¡¿]|[{_SIGNS}»](?=[{_L}\u0370-\u052f])|[{_L}](?=[\u0370-\u052f])|[\u0370-\u052f](?=[{_L}])"
    f"|[\u2200-\u25ff](?=[^\\W\\d_])|(?<=[^\\W\\d_])[\u2200-\u25ff]|(?<=[^\\W\\d_])[\u00a0\u202f](?=[^\\W\\d_])|[À-ÿ]{{3,}}|[{_SIGNS}\u0080-\u00ff]{{3,}}|[Ââ][\u00a0-\u00bf€\u0080]|[\u2500-\u25ff][{_SIGNS}\u00a0-\u00ff]"
    f"|[{_SIGNS}À-ÿ][{_SIGNS}\u00a0-\u00bf]|[“”][{_L}]|(?<=[{_L}])[”’‘„–—]+(?=[{_L}])(?<!’)|&[#a-zA-Z]|[a-zà-ÿ]\\?[a-zà-ÿ]"
)


_AROUND = re.compile(r"([\x00-\x7f]?[^\x00-\x7f]+)(?=([\x00-\x7f]?))")
_ENTITY, _INSIDE = re.compile("&[#a-zA-Z]"), re.compile(r"[a-zà-ÿ]\?[a-zà-ÿ]")
_judged: dict[str, bool] = {}


def suspicious(text: str) -> bool:
    """Whether a text must be looked at: its runs beyond ASCII are judged with their neighbours, each spelling once."""
    if "&" in text and _ENTITY.search(text) or "?" in text and _INSIDE.search(text):
        return True
    if text.isascii():
        return False
    for a, b in _AROUND.findall(text):
        got = _judged.get(a + b)
        if got is None:
            if len(_judged) > 200_000:
                _judged.clear()
            got = _judged[a + b] = bool(_SUSPECT.search(a + b))
        if got:
            return True
    return False


def _sloppy(text: str, codec: str) -> bytes:
    """`text` as bytes; code points a Windows page leaves open stand for their own byte."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if not codec.startswith("cp125"):
            raise
        return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) < 0xA0 else c.encode(codec) for c in text)


@lru_cache(100_000)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0]


_KNOWN = frozenset(c for c in "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýÿœßабвгдежзийклмнопрстуфхцчшщъыьэюяёαβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ")
_MONEY, _MARKS = "£¥€¢", "²³¹º°ª™®"
_OPERATORS = "±×÷≤≥≈≠√∞∑∏∫·→←↑↓†‡µ"


@dataclass(frozen=True)
class Contexts:
    """All characters beyond ASCII of clean samples, each between its two neighbours; what is learnt from the samples."""

    all: tuple[str, ...]

    def __bool__(self) -> bool:
        return bool(self.all)


def contexts(texts: Iterable[str]) -> set[str]:
    """The characters beyond ASCII of texts, in lower case and between their neighbours."""
    out: set[str] = set()
    for t in texts:
        t = f" {unicodedata.normalize('NFC', t).lower()} "
        out.update(t[m.start() - 1 : m.start() + 2] for m in _HIGH.finditer(t))
    return out


class Plausibility:
    """Cost of the characters of a text beyond ASCII: by the contexts clean samples show them in, else by what their kind may stand beside."""

    def __init__(self, samples: list[str] | Contexts):
        self.tri: set[str] = set(samples.all) if isinstance(samples, Contexts) else contexts(samples)
        self.uni: set[str] = {*TYPOGRAPHIC, *(c[1] for c in self.tri)}
        self.bi: set[str] = {x for c in self.tri for x in (c[:2], c[1:])}
        self.seen: dict[tuple[str, str, str], float] = {}

    def char(self, p: str, c: str, n: str) -> float:
        key = (p, c, n)
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            got = self.seen[key] = self._letter(p, c, n) if c.isalpha() else self._sign(p, c, n)
        return got

    def _sign(self, p: str, c: str, n: str) -> float:
        o = ord(c)
        beside = p.isalpha() + n.isalpha()
        if o == 0xFFFD:  # among letters one was lost; alone the sign itself is meant
            return 9.0 if beside else 0.5
        if 0x80 <= o < 0xA0 or unicodedata.category(c) in ("Cn", "Co", "Cs"):
            return 9.0
        if c in "\u00a0\u202f\u2007":
            if beside == 2:
                return 6.0
            if p.isupper() and ord(p) > 0x7F:
                return 3.0
            return 0.0 if n in ";:!?»%€°“0123456789" or p in "«.°§0123456789" else 2.0 if beside else 0.5
        if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Mc", "Cf"):
            if 0x0590 <= o < 0x1E00:  # vowel signs and the like stand in their own script
                return 0.3 if _script(c) == _script(p) else 4.0
            return 3.0 if p.isalpha() and ord(p) < 0x0590 else 0.5
        if o >= 0x2E80 or 0x0590 <= o < 0x1E00:  # punctuation and digits of other scripts
            latin = sum(x.isalpha() and ord(x) < 0x590 for x in (p, n))
            return 0.3 if latin < (2 if o >= 0x2E80 else 1) else 4.0
        if c in "¿¡":
            return 0.0 if not p.isalnum() and (n.isalpha() or n in "«“\"¿¡'(") else 4.0
        if c in "«“„‘‹":
            return 0.0 if (p.isspace() or p in "([«“¿¡-–—/'’\"") and (not n.isspace() or c in "«‹") or c == "“" and not p.isspace() and not n.isalnum() else 4.0 + beside
        if c in "»”“’›":
            if c == "’" and p.isalpha() and n.isalpha():
                return 0.3
            return 0.6 * (beside > 0) if not n.isalpha() and (not p.isspace() or c in "»›") else 4.0 + beside
        if c in "•◦▪‣●○■□":
            return 0.0 if not p.isalpha() and not n.isalpha() else 5.0
        if c in "…–—‐‑‒―":
            if p.isspace() or n.isspace() or p.isdigit() and n.isdigit() or c == "…" and (not n.isalnum() or p in "«“([\"") or n in "»”“\"),.;:!?":
                return 0.0
            return 1.5 if c != "…" and (beside == 2 or p.isalnum() and n.isalnum()) else 3.0
        if c in _MONEY:
            return 0.0 if not beside or (p.isdigit() and not n.isalpha()) or n.isdigit() else 4.0
        if c in _MARKS:  # signs that follow a word or a number
            return 0.0 if not n.isalpha() or p.isdigit() else 4.0
        if c in "½¼¾§№¶":
            return 0.3 if not beside else 4.0
        if c in "©":
            return 0.3 if not beside else 5.0
        if c in "│║┃":  # lines of tables
            return 1.0 if beside < 2 else 5.0
        if 0x2190 <= o < 0x2C00 or c in _OPERATORS:  # drawing, arrows, operators stand among themselves, spaces and digits
            return 0.3 if not beside and not (p in "ÂÃ" or n in "ÂÃ") and (p < "\x80" or p >= "\u2190") and (n < "\x80" or n >= "\u2190") else 5.0
        return 4.0 + beside

    def _letter(self, p: str, c: str, n: str) -> float:
        if c in "ªº":
            return 0.0 if p.isdigit() or p in ".nN" else 3.0
        o = ord(c)
        if c.isupper() and p.islower():
            return 5.0
        lp, lc, ln = p.lower(), c.lower(), n.lower()
        if c.isupper() and p.isupper() and n.islower():
            return 3.0
        if lp + lc + ln in self.tri:
            return 0.0
        mine = _script(c)
        for x in (p, n):
            if x.isalpha() and _script(x) != mine and not (max(o, ord(x)) >= 0x2E80 and min(o, ord(x)) < 0x80) and not (o >= 0x2E80 and ord(x) >= 0x2E80):
                return 0.0 if c in "µΩμ" and not p.isalpha() else 5.0
        if o >= 0x590 and not 0xFF61 <= o <= 0xFF9F and not 0x1D00 <= o < 0x2000:
            beside = any("A" <= x <= "z" and x.isalpha() for x in (p, n))
            return (0.5 if beside else 0.3) if lc in self.uni else 4.0 if beside else 1.0
        both = (lp + lc in self.bi) + (lc + ln in self.bi)
        if lc not in self.uni and lc not in _KNOWN or o < 0x250 and both < 2 and all(0x7F < ord(x) < 0x250 and x.isalpha() for x in (p, n)):
            return 2.5
        return (1.2, 0.9, 0.3)[both]

    def costs(self, text: str) -> Iterator[float]:
        t = f" {text} "
        char = self.char
        return (char(t[i - 1], t[i], t[i + 1]) for i in (m.start() for m in _HIGH.finditer(t)))

    def cost(self, text: str) -> float:
        return self.marks(text) + sum(self.costs(text))

    def doubt(self, text: str) -> float:
        """The cost of the characters that no clean text shows in such company; one alone may be just a rare word."""
        return self.marks(text) + sum(c for c in self.costs(text) if c >= 2.0)

    def marks(self, text: str) -> float:
        """The cost of entities in running text, and of question marks inside words."""
        out = 1.5 * sum(len(_ASKED.findall(w)) for w in text.split() if "?" in w and not re.search(r"[/=.:&]", w)) if "?" in text else 0.0
        for m in _ESCAPED.finditer(text) if "&" in text else ():
            was, now = m.group(), html.unescape(m.group())
            if now == was or now.endswith(";") and len(now) > 2:
                continue
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if now in "&<>\"":  # alone it is named; between names, before letters or another entity it stands for the sign
                named = (before.isspace() or not before) and (after.isspace() or not after)
                near = re.search(r"(\w+)\s$", text[: m.start()]), re.match(r"\s(\w+)", text[m.end() :])
                out += 0.0 if named and not (now == "&" and all(near) and all(x.group(1)[0].isupper() or x.group(1)[0].isdigit() for x in near)) else 2.5
            elif not (now.isspace() or now.isalpha()) or before.isalnum() or after.isalnum() or now.isspace() and (before or after):
                out += 2.5 if now.isalpha() and (before.isalpha() or after.isalpha()) or not now.isalpha() and (before or after) and not (before.isspace() and after.isspace() and not now.isspace()) else 0.0
        return out


@lru_cache(32)
def _high(codec: str) -> re.Pattern:
    """Runs of the characters that a byte from 0x80 on is read as."""
    chars = set()
    for byte in range(0x80, 0x100):
        try:
            chars.add(bytes([byte]).decode(codec))
        except UnicodeDecodeError:
            chars.add(chr(byte))
    return re.compile("[" + "".join(re.escape(c) for c in sorted(chars)) + "]+")


_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


Part = tuple[int, int, str]


def _joined(text: str, parts: list[Part]) -> str:
    out, at = [], 0
    for lo, hi, new in parts:
        out += text[at:lo], new
        at = hi
    return "".join([*out, text[at:]])


def _utf8_parts(text: str, codec: str) -> list[Part]:
    """The byte sequences of UTF-8 in runs of high characters, as (start, end, character)."""
    out: list[Part] = []
    for m in _high(codec).finditer(text):
        for x in _SEQUENCE.finditer(_sloppy(m.group(), codec)):
            try:
                out.append((m.start() + x.start(), m.start() + x.end(), x.group().decode("utf-8")))
            except UnicodeDecodeError:
                continue
    return out


def _multibyte_parts(text: str, codec: str, to: str) -> list[Part]:
    """Runs of four high characters or more that are whole in a multi-byte encoding, character by character."""
    form = _high(codec)
    if to in ("shift_jis", "big5"):
        form = re.compile("(?:" + form.pattern[:-1] + "[@-~]?)+")
    out: list[Part] = []
    for m in form.finditer(text):
        if len(m.group()) < 4:
            continue
        try:
            got = _sloppy(m.group(), codec).decode(to)
            at = m.start()
            for c in got:
                n = len(c.encode(to))
                out.append((at, at + n, c))
                at += n
        except (UnicodeDecodeError, UnicodeEncodeError):
            continue
    return out


def _utf8(text: str, codec: str) -> str | None:
    """`text` with the byte sequences of UTF-8 in it read again; None if there are none."""
    parts = _utf8_parts(text, codec)
    return _joined(text, parts) if parts else None


def _multibyte(text: str, codec: str, to: str) -> str | None:
    parts = _multibyte_parts(text, codec, to)
    return _joined(text, parts) if parts else None


def _moves(text: str) -> Iterator[tuple[str, str]]:
    for codec in READ_AS:
        out = _utf8(text, codec)
        if out is not None:
            yield f"{codec}>utf-8", out
    high = {ord(c) for c in _HIGH.findall(text)}
    for a in READ_AS:
        for b in WRITTEN_IN:
            if a == b or (a, b) in (("latin-1", "cp1252"), ("iso8859-15", "cp1252")) or not high <= _table(a, b).keys():
                continue
            out = text.translate(_table(a, b))
            if out != text:
                yield f"{a}>{b}", out
    for a in ("latin-1", "cp1252"):
        if any(len(m) >= 4 for m in _high(a).findall(text)):
            for b in MULTIBYTE:
                out = _multibyte(text, a, b)
                if out is not None:
                    yield f"{a}>{b}", out
    if "&" in text and _ESCAPED.search(text):
        yield "unescape", html.unescape(text)


@lru_cache(128)
def _table(a: str, b: str) -> dict[int, str]:
    out: dict[int, str] = {}
    for byte in range(0x80, 0x100):
        try:
            out[ord(bytes([byte]).decode(a))] = bytes([byte]).decode(b)
        except UnicodeDecodeError:
            continue
    return out


def _recode(text: str, a: str, b: str) -> str | None:
    """Every high character read again in another single-byte encoding; None unless all of them can be."""
    t = _table(a, b)
    if any(ord(c) not in t for c in set(_HIGH.findall(text))):
        return None
    return text.translate(t)


def parts_of(op: str, text: str) -> list[Part] | None:
    """What an operation replaces where; None if it maps character by character."""
    if op == "unescape":
        return [(m.start(), m.end(), html.unescape(m.group())) for m in _ESCAPED.finditer(text)]
    a, b = op.split(">")
    return _utf8_parts(text, a) if b == "utf-8" else _multibyte_parts(text, a, b) if b in MULTIBYTE else None


def apply(op: str, text: str) -> str:
    parts = parts_of(op, text)
    if parts is not None:
        return _joined(text, parts)
    out = _recode(text, *op.split(">"))
    return text if out is None else out


def aligned(text: str, path: tuple[str, ...]) -> tuple[str, list[int]]:
    """The text after the operations, and where each of its characters (and its end) lies in the source."""
    at = list(range(len(text) + 1))
    for op in path:
        parts = parts_of(op, text)
        if parts is None:
            text = apply(op, text)
            continue
        out, places, i = [], [], 0
        for lo, hi, new in parts:
            out += text[i:lo], new
            places += at[i:lo] + [at[lo]] * len(new)
            i = hi
        text, at = "".join([*out, text[i:]]), places + at[i:]
    return text, at


_RUN = re.compile(r"[^ \t\r\n]+")


def worth(text: str) -> list[str]:
    """The distinct words of a text that operations may change, in order: all a search needs to look at."""
    return list(dict.fromkeys(w for w in _RUN.findall(text) if not w.isascii() or "&" in w and _ESCAPED.search(w)))


def search(text: str, model: Plausibility) -> tuple[str, float, tuple[str, ...]]:
    """(cheapest text, gain, operations) reachable from `text`.

    Best-first: the most promising state is opened next, and the search ends when
    none promises more than the best text found, or when in that nothing is in
    doubt any more. Each byte sequence of UTF-8 that is read again promises more,
    as no other text holds such sequences; other operations are only followed
    where they make the text cheaper and no word worse.
    """
    # letters of look-alike scripts are another defect: in their plain form they speak against an encoding error
    start = model.cost(text)
    plain = min(start, model.cost(canonical(text)))
    best, best_cost, best_path = text, plain, ()
    queue = [(start, 0, start, text, ())]
    visited = {hash(text)}
    ticket = 0
    while queue:
        promise, _, cost, at, path = heapq.heappop(queue)
        if path and promise >= best_cost or path and at == best and not model.doubt(at):
            break
        for op, out in _moves(at):
            h = hash(out)
            if h in visited:
                continue
            visited.add(h)
            # each operation costs something, and a change that creates characters no sample knows costs more
            c = model.cost(out) + STEP * (len(path) + 1)
            if op.endswith(">utf-8"):
                wide, hopeful = all(x.endswith(">utf-8") for x in path), min(c, promise - READ_AGAIN * len(parts_of(op, at)))
            else:
                wide, hopeful = False, c
            if not wide:
                if c >= cost - 1 and hopeful == c:
                    continue
                worse, sound = _words(text, (*path, op), model)
                if worse:
                    continue
            if c < best_cost and (wide or sound):
                best, best_cost, best_path = out, c, (*path, op)
            ticket += 1
            heapq.heappush(queue, (hopeful, ticket, c, out, (*path, op)))
    return best, plain - best_cost, best_path


def _words(text: str, path: tuple[str, ...], model: Plausibility) -> tuple[bool, bool]:
    """(some word gets worse by the operations, they explain whole words better): two get sound, or one that no text may hold."""
    sound, never = 0, False
    for w in _RUN.findall(text):
        if w.isascii() and "&" not in w:
            continue
        now = w
        for op in path:
            now = apply(op, now)
        if now == w:
            continue
        cost, after = model.cost(w), model.cost(now)
        if after > cost + 0.5 and after >= 2:
            return True, False
        if cost >= after + 1.5:
            sound += 1
            never = never or any(x >= 4 for x in model.costs(w)) or path == ("unescape",)
    return False, sound > 1 or never


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that were garbled or not as a whole: lines, cut after terminators."""
    at = 0
    for m in re.finditer(r"\n|(?<=[.!?…])\s+(?=\S)", text):
        if m.end() > at:
            yield at, m.end()
            at = m.end()
    if at < len(text):
        yield at, len(text)


@lru_cache(8)
def model_of(samples: tuple[str, ...] | Contexts) -> Plausibility:
    return Plausibility(samples)


class Repairer:
    def __init__(self, samples: tuple[str, ...] | Contexts):
        self.model = model_of(samples)
        self.memo: dict[str, tuple[str, float]] = {}

    def piece(self, text: str) -> tuple[str, float, tuple[str, ...]]:
        """(restored text, gain, operations) of one stretch; gain 0 where nothing is wrong."""
        if not suspicious(text):
            return text, 0.0, ()
        got = self.memo.get(text)
        if got is not None:
            return got
        bare = _MENTION.sub(" ", text)
        got = (text, 0.0, ())
        if self.model.doubt(bare) >= 2.0:
            words = worth(bare)
            odd = " ".join(words)
            if self.model.doubt(odd) >= 2.0 and self.model.doubt(canonical(odd)) >= 2.0:
                _, gain, path = search(odd, self.model)
                if path and gain >= (GAIN if any(not op.endswith(">utf-8") for op in path) else GAIN / 2):
                    got = (self.replay(text, path), gain, path)
        if len(self.memo) > 50_000:
            self.memo.clear()
        self.memo[text] = got
        return got

    def replay(self, text: str, path: tuple[str, ...]) -> str:
        """The operations applied to everything but what is only mentioned in quotes."""

        def run(part: str) -> str:
            for op in path:
                part = apply(op, part)
            return part

        out, at = [], 0
        for m in _MENTION.finditer(text):
            out += run(text[at : m.start()]), m.group()
            at = m.end()
        return "".join([*out, run(text[at:])])

    def document(self, text: str | None) -> tuple[bool, str | None]:
        """(garbled, text restored as far as it can be).

        A document is garbled if a search found a cheaper text for part of it, or
        if what it found at best still holds places of lost characters.
        """
        if not text or not suspicious(text):
            return False, text
        got = [(text[lo:hi], *self.piece(text[lo:hi])) for lo, hi in _pieces(text)]
        paths = sorted({p for *_, p in got if p})
        now = "".join(x for _, x, _ in self._settled(got, paths)) if paths else text
        return bool(paths) or self._lost(now) >= GAIN, now

    def _lost(self, text: str) -> float:
        """The cost of what stands for lost characters."""
        bare = _MENTION.sub(" ", text)
        asked = 1.5 * sum(len(_ASKED.findall(w)) for w in bare.split() if "?" in w and not re.search(r"[/=.:&]", w)) if "?" in bare else 0.0
        t = f" {bare} "
        return (asked if asked > GAIN else 0.0) + sum(self.model.char(t[m.start() - 1], "\ufffd", t[m.end()]) for m in re.finditer("\ufffd", t) if t[m.start() - 1].isalpha() or t[m.end()].isalpha())

    def _settled(self, got: list, paths: list) -> list[tuple[str, str, tuple[str, ...]]]:
        """(source, restored, operations) of each stretch of a garbled document: what explains other stretches is likelier here too."""
        out, votes = [], Counter(p for *_, p in got if p)
        for was, now, gain, path in got:
            if _HIGH.search(was) and (gain or self.model.cost(was) >= 1):
                options = [(was, ()), (now, path), *((self.replay(was, p), p) for p in paths if p != path)]
                cost = lambda t, p: self.model.cost(t) + (t != was) + STEP * len(p) - min(3, votes[p] - (p == path)) * (p != ())
                _, _, now, path = min((cost(t, p) if not (gain and p == ()) else 1e9, t != was, t, p) for t, p in options)
            out.append((was, now, path))
        return out

    def aligned(self, text: str) -> tuple[str, list[int] | None]:
        """The restored text, and where each of its characters (and its end) lies in `text`; no places if nothing is wrong."""
        if not suspicious(text):
            return text, None
        got = [(text[lo:hi], *self.piece(text[lo:hi])) for lo, hi in _pieces(text)]
        paths = sorted({p for *_, p in got if p})
        if not paths:
            return text, None
        out, at, base = [], [], 0
        for was, _, path in self._settled(got, paths):
            i = 0
            for m in [*_MENTION.finditer(was), None]:
                part = was[i : m.start() if m else len(was)]
                now, places = aligned(part, path)
                out.append(now)
                at += [base + i + p for p in places[:-1]]
                if m:
                    out.append(m.group())
                    at += range(base + m.start(), base + m.end())
                    i = m.end()
            base += len(was)
        return "".join(out), [*at, base]


def samples_of(df: DataFrame, text: str = "text") -> Contexts:
    """What all clean sample texts show: read where they are, only contexts of three characters are shuffled and collected, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(contexts(filter(None, b.column(0).to_pylist()))), pa.string())], names=["c"])

    return Contexts(tuple(sorted(r["c"] for r in df.select(F.col(text).cast("string")).mapInArrow(run, "c string").distinct().collect())))


def restored(docs: DataFrame, samples: tuple[str, ...] | Contexts, doc: str = "doc_id", text: str = "content", order: str | None = None) -> DataFrame:
    """(doc_id, garbled, restored) of every document.

    `restored` is the text as far as it can be had back, null where nothing was
    garbled: characters already replaced by U+FFFD are lost, but make the
    document count as garbled. Text that only names such sequences in quotes
    isn't garbled. Null and empty texts aren't garbled. Of a document sent
    several times the row last by `order` counts. Texts are read where they are:
    only flags and restored texts are shuffled, the latter if they are asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Repairer(samples)
        for b in batches:
            got = [r.document(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g for g, _ in got], pa.bool_()), pa.array([t if g else None for g, t in got], pa.string())], names=["doc_id", "_o", "garbled", "restored"])

    picked = docs.select(F.col(doc).alias("doc_id"), (F.col(order) if order else F.lit(0)).alias("_o"), F.col(text).cast("string").alias("_t")).where("doc_id is not null")
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    rows = spread(picked).mapInArrow(run, f"doc_id {kinds['doc_id']}, _o {kinds['_o']}, garbled boolean, restored string")
    return rows.groupBy("doc_id").agg(F.max(F.struct("_o", "garbled", "restored")).alias("_r")).select("doc_id", "_r.garbled", "_r.restored")
