"""One form for text that looks the same (problem 1).

Quick-check properties split the characters into stable ones, which every text
may keep as they are, and unstable ones. Text without unstable characters passes
through untouched; otherwise only the segments around unstable characters are
normalised, with the letters next to them as boundary context, and spliced back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import latest, spread

# Letters of other scripts drawn like Latin ones.
CYRILLIC = dict(zip("асеорхуіјѕһԁԛԝӏАВСЕНІЈКМОРЅТХУԚԜ", "aceopxyijshdqwlABCEHIJKMOPSTXYQW", strict=True))
GREEK = dict(zip("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovABEZHIKMNOPTYX", strict=True))
# Letters that only among Latin ones pass for one of them: Greek, Armenian, Cherokee, phonetic.
ALIKE = dict(zip("αγικρυωӏօոսհցյԼՕՍՏᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏟᏢᏦᏚᏞᏙᏴᎥɡɑ", "ayikpuwlonuhgjLOUSDRTAJEWMHGZCPKSLVBiga", strict=True))
# Invisible characters, hyphens and spaces drawn like the ordinary ones.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160឴឵\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
HYPHENS, SPACES = "‐‑", "\u00a0\u2007\u202f"
SELECTORS = "\ufe0e\ufe0f"
RUSSIAN = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"

TO_LATIN = CYRILLIC | GREEK
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items() if k.lower() in RUSSIAN}
TO_GREEK = {v: k for k, v in GREEK.items()}


def script(ch: str) -> str:
    """Latin, Cyrillic or Greek for letters of those, else empty."""
    o = ord(ch)
    if o < 0x80:
        return "L" if ch.isalpha() else ""
    if o < 0xC0 or o in (0xD7, 0xF7):
        return ""
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G" if ch.isalpha() else ""
    if 0x400 <= o < 0x530:
        return "C" if ch.isalpha() else ""
    if 0x250 <= o < 0x2B0:
        return "L"
    if 0x530 <= o < 0x590 or 0x13A0 <= o < 0x1400:
        return "A" if ch.isalpha() else ""
    return ""


@cache
def folded(ch: str) -> str:
    """The ordinary spelling of a character of unusual width, ligature, position form or the like."""
    d = unicodedata.decomposition(ch)
    if not d.startswith("<"):
        return ch
    kind = d[1 : d.index(">")]
    name = unicodedata.name(ch, "")
    if kind in ("wide", "narrow", "font", "noBreak", "initial", "medial", "final", "isolated"):
        return unicodedata.normalize("NFKC", ch)
    if kind == "compat" and re.search(r"LIGATURE|ROMAN NUMERAL|RADICAL|DIGRAPH|LETTER (DZ|LJ|NJ)\b|PRECEDED BY APOSTROPHE", name) and "THAI" not in name:
        return unicodedata.normalize("NFKC", ch)
    return ch


@lru_cache(1)
def unstable() -> str:
    """The characters that may not stand in normalised text, or only depending on their neighbours."""
    seconds = set()
    odd = set(INVISIBLE + HYPHENS + SPACES + SELECTORS + "\u0e4d")
    # all of Unicode but unified ideographs, syllables of Hangul and private use, none of which is ever unstable
    for o in (*range(0xA0, 0x3400), *range(0x4DC0, 0x4E00), *range(0xA000, 0xAC00), *range(0xD7B0, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)):
        ch = chr(o)
        d = unicodedata.decomposition(ch)
        if d and not d.startswith("<") and " " in d:
            seconds.add(chr(int(d.split()[1], 16)))
        if unicodedata.normalize("NFC", ch) != ch or folded(ch) != ch:
            odd.add(ch)
        elif unicodedata.combining(ch):
            seconds.add(ch)
    seconds |= {chr(o) for o in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # vowels and finals of Hangul
    return "".join(sorted(odd | seconds | set(TO_LATIN) | {c for c in ALIKE if script(c) == "L"}))


def char_class(chars: str) -> str:
    """A character class usable in Python and Java, as ranges."""
    out, lo, hi = [], None, None
    for o in sorted({ord(c) for c in chars}):
        if hi is not None and o == hi + 1:
            hi = o
            continue
        if lo is not None:
            out.append((lo, hi))
        lo = hi = o
    out.append((lo, hi))
    esc = lambda o: re.escape(chr(o)) if o < 0x80 else chr(o)
    return "".join(esc(a) if a == b else f"{esc(a)}-{esc(b)}" for a, b in out)


@lru_cache(1)
def unstable_re() -> re.Pattern:
    return re.compile(f"[{char_class(unstable())}]")


# Letters of Latin beside letters of Cyrillic, Greek, Armenian or Cherokee, modifier letters between them or not.
_L, _CG, _MODIFIERS = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ", "\u0370-\u058f\u13a0-\u13ff\u1f00-\u1fff", "\u02b0-\u02ff"
MIXED = f"[{_L}](?=[{_MODIFIERS}]*[{_CG}])|[{_CG}](?=[{_MODIFIERS}]*[{_L}])"
_OTHER = re.compile(f"[{_CG}]")


@lru_cache(1)
def unstable_or_mixed_re() -> re.Pattern:
    return re.compile(f"[{char_class(unstable())}]|{MIXED}")


def gate(text: str) -> re.Pattern:
    """What finds the places of `text` that may need another spelling; only text with Cyrillic or Greek can mix scripts."""
    return unstable_or_mixed_re() if _OTHER.search(text) else unstable_re()


_RUN = re.compile(r"[^\W\d_]+")
#: Letters of scripts whose shapes join, so that a joiner may change how they look.
_JOINING = re.compile("[ؠ-ݏߊ-ߪࡀ-ࡘࢠ-ࣇᠠ-ᢪ]")
_NOT_LEFT = frozenset("آأؤإاةدذرزوىٱڈڑژۀےەء")
_INVISIBLE = re.compile(f"[{char_class(INVISIBLE + SELECTORS)}]")


def _emoji(ch: str) -> bool:
    return ord(ch) >= 0x1F000 or 0x2190 <= ord(ch) <= 0x2BFF or ch in "©®‼⁉™ℹ"


def shows(text: str, i: int) -> bool:
    """Whether the joiner or selector at i changes how its neighbours look."""
    ch = text[i]
    before = text[i - 1] if i else ""
    after = text[i + 1] if i + 1 < len(text) else ""
    if not before:
        return False
    if ch in SELECTORS:
        return _emoji(before) or before in "0123456789#*"
    if ch == "\u200d" and after and (_emoji(after)) and (_emoji(before) or before in SELECTORS):
        return True
    if ch in "\u200c\u200d":
        if unicodedata.combining(before) == 9:  # after a virama it forms or prevents a conjunct
            return bool(after)
        if _JOINING.match(before) and before not in _NOT_LEFT:
            return bool(after and _JOINING.match(after)) if ch == "\u200c" else not (after and _JOINING.match(after))
    return False


def _strip(text: str) -> str:
    if not _INVISIBLE.search(text):
        return text
    return "".join(c for i, c in enumerate(text) if not _INVISIBLE.match(c) or shows(text, i))


def resolve(run: str) -> tuple[str, str]:
    """(spelling in one script, verdict) of a run of letters of Latin, Cyrillic and Greek.

    Verdicts: `one`: certainly of one script; `mixed`: letters of several;
    `ask`: every letter could be of another script, only the context tells.
    """
    kinds = {s for c in run if (s := script(c))}
    if not kinds:
        return run, "one"
    bare = unicodedata.normalize("NFD", run)
    sure = {s for c in bare if (s := script(c)) and not (c in TO_LATIN or (s == "L" and c in TO_CYRILLIC))}
    odd = [c for c in bare if script(c) not in ("L", "") and c not in TO_LATIN or c in ALIKE and script(c) == "L"]
    if odd and len(run) > 1 and all(c in ALIKE for c in odd) and any(c < "\x80" and c not in TO_CYRILLIC and c not in TO_GREEK for c in bare) and not any(0x250 <= ord(c) < 0x2B0 and c not in ALIKE for c in bare):
        return unicodedata.normalize("NFC", "".join(TO_LATIN.get(c, ALIKE.get(c, c)) for c in bare)), "mixed"
    if len(kinds) > 1:
        if "C" in sure and "L" not in sure and "G" not in sure:
            return unicodedata.normalize("NFC", "".join(TO_CYRILLIC.get(c, c) if script(c) == "L" else c for c in bare)), "mixed"
        if "G" in sure and "C" not in sure and sum(script(c) == "G" and c not in TO_LATIN for c in bare) > 1:
            # one letter among Latin ones is a sign, as in units; several make a Greek word
            greek = [c if script(c) not in ("L", "C") else TO_GREEK.get(CYRILLIC.get(c, c)) for c in bare]
            if None not in greek:
                return unicodedata.normalize("NFC", "".join(greek)), "mixed"
        if "C" in sure or "G" in sure:  # scripts that really stand side by side
            return run, "mixed" if any(c in TO_LATIN for c in bare) else "one"
        return unicodedata.normalize("NFC", "".join(TO_LATIN.get(c, c) for c in bare)), "mixed"
    return run, "one" if sure else "ask"


#: Sara am typed as two signs, a tone mark between them or not.
_SARA_AM = re.compile("\u0e4d([\u0e48-\u0e4b]?)\u0e32")


def _ordinary(seg: str) -> str:
    seg = _SARA_AM.sub("\\1\u0e33", seg)
    out = "".join(folded(c) for c in _strip(seg))
    for h in HYPHENS:
        out = out.replace(h, "-")
    for s in SPACES:
        out = out.replace(s, " ")
    return unicodedata.normalize("NFC", out)


@lru_cache(200_000)
def _segment(seg: str) -> str:
    seen: set[str] = set()
    while seg not in seen:  # a resolved letter may compose with a mark after it, and so on
        seen.add(seg)
        seg = unicodedata.normalize("NFC", _RUN.sub(lambda m: resolve(m.group())[0], _ordinary(seg)))
    return seg


def _spans(text: str, places: re.Pattern) -> Iterator[tuple[int, int]]:
    """The unstable segments with their boundary context: whole runs between spaces and ideographs, which no neighbour changes."""
    end, n = 0, len(text)
    apart = lambda c: c.isspace() or "\u3400" <= c <= "\u9fff"
    for m in places.finditer(text):
        i = m.start()
        if i < end:
            continue
        lo = i
        while lo > end and not apart(text[lo - 1]):
            lo -= 1
        if lo > end and not text[lo - 1].isspace():
            lo -= 1
        hi = m.end()
        while hi < n and not apart(text[hi]):
            hi += 1
        while hi < n and unicodedata.combining(text[hi]):
            hi += 1
        yield lo, hi
        end = hi


def canonical(text: str | None) -> str | None:
    """`text` in composed letters of ordinary width, one script a word, nothing invisible."""
    if text is None or not (places := gate(text)).search(text):
        return text
    out, at = [], 0
    for lo, hi in _spans(text, places):
        out += text[at:lo], _segment(text[lo:hi])
        at = hi
    out.append(text[at:])
    return "".join(out)


_LATIN_TABLE = {ord(k): v for k, v in TO_LATIN.items()} | {ord(unicodedata.normalize("NFC", k + m)): unicodedata.normalize("NFC", v + m) for k, v in TO_LATIN.items() for m in "̀́̈" if len(unicodedata.normalize("NFC", k + m)) == 1 and len(unicodedata.normalize("NFC", v + m)) == 1}


def look(text: str) -> str:
    """What two texts that look the same have in common."""
    return canonical(text).translate(_LATIN_TABLE)


def judge(word: str) -> str:
    """`plain`, `variant`, or `ask` where the script of the neighbouring words decides."""
    if not gate(word).search(word):
        # letters of Latin all of which are drawn like Cyrillic ones
        return "ask_latin" if (bare := word.rstrip(".")) and all(c in TO_CYRILLIC for c in bare) and resolve(bare)[1] == "ask" else "plain"
    verdict = "plain"
    shown = _strip(word)
    if shown != word or _SARA_AM.search(word) or unicodedata.normalize("NFC", word) != word or any(h in word for h in HYPHENS + SPACES):
        return "variant"
    for c in word:
        if folded(c) != c:
            if "！" <= c <= "｠" and not c.isalnum():
                verdict = "ask_wide"
                continue
            if unicodedata.decomposition(c).startswith("<wide>") and not c.isalnum():
                continue
            return "variant"
    sure, asked = set(), None
    for m in _RUN.finditer(word):
        v, kind = resolve(m.group())[1], script(m.group()[0])
        if v == "mixed":
            return "variant"
        if v == "ask":
            asked = asked or kind
        else:
            sure.add(kind)
    if asked and asked not in sure and verdict == "plain":
        if sure & {"L", "C", "G"} and asked != "L":
            return "variant"  # the rest of the word tells
        verdict = "ask_latin" if asked == "L" else "ask_other"
    return verdict


@F.pandas_udf(T.StringType())
def canonical_udf(col):
    return col.map(canonical, na_action="ignore")


@F.pandas_udf(T.StringType())
def judge_udf(col):
    seen = {w: judge(w) for w in col.dropna().unique()}
    return col.map(seen)


def normalized(df: DataFrame, col: str, out: str) -> DataFrame:
    """`df` with `out`, the one form of the text in `col`; null stays null, empty stays empty."""
    return df.withColumn(out, canonical_udf(F.col(col).cast("string")))


_LATIN_ASK = "".join(sorted(TO_CYRILLIC))
#: Ranges without any unstable character.
SETTLED = "!-~\u00a1-\u00ac\u00ae-\u0131\u0134-\u0148\u014a-\u0173\u3041-\u3096\u30a1-\u30fa\u30fc\u4e00-\u9fff\u3001-\u3002\u300c-\u300d\u2013-\u2014\u2018-\u201e\u2026"


def variant_words(tokens: DataFrame, doc: str = "doc_id", tok: str = "tok", sent: str = "sent", word: str = "word", order: str | None = None) -> DataFrame:
    """(doc, tok) of each token not in plain spelling, each key once.

    Words without unstable characters are passed by in the JVM. The rest is
    judged word by word; only for words all of whose letters exist in two
    scripts is the sentence's other vocabulary counted, one row a sentence.
    A longer Latin word among Cyrillic ones may also be a name: it is left alone
    if it occurs in Latin sentences and its Cyrillic twin in no Cyrillic one.
    Of a position sent several times the row last by `order` counts. Null words,
    documents and positions are left out.
    """
    t = tokens.select(F.col(doc).alias("doc_id"), F.col(tok).alias("tok"), F.coalesce(F.col(sent), F.lit(-1)).alias("sent"), F.col(word).cast("string").alias("word"), (F.col(order) if order else F.lit(0)).alias("_at"))
    t = t.where("doc_id is not null and tok is not null")
    if order:
        t = latest(t, ["doc_id", "tok"], "_at", ["doc_id", "tok", "sent", "word"])
    t = t.where("word is not null")
    # most words consist of characters that are stable in any company: one small class settles them
    odd = F.when(F.col("word").rlike(f"^[{SETTLED}]*$"), False).otherwise(F.col("word").rlike(f"[{char_class(unstable())}]|{MIXED}"))
    latin = F.col("word").rlike(f"^[{_LATIN_ASK}]+\\.?$")
    twin = F.translate(F.rtrim(F.col("word"), F.lit(".")), _LATIN_ASK, "".join(TO_CYRILLIC[c] for c in _LATIN_ASK))
    long = F.length(twin) > 3
    doubtful = t.where(odd | latin)
    doubtful = doubtful.select("doc_id", "tok", "sent", F.when(latin & long, twin).alias("twin"), judge_udf("word").alias("verdict")).where("verdict <> 'plain'")
    sure_latin = F.col("word").rlike("[bdfghijklmnqrstuvwzDFGIJLNQRSUVWZÀ-ÖØ-öø-ɏ]")
    sure_other = F.col("word").rlike("[бгджзийлнпфцчшщъыьэюявкмтБГДЖЗИЙЛПФЦ-Яα-μξπ-ώ]") & ~F.col("word").rlike("[A-Za-z]")
    east = F.col("word").rlike("[\u3040-ヿ㐀-鿿가-\ud7af]")
    context = t.groupBy("doc_id", "sent").agg(F.count_if(sure_latin).alias("n_latin"), F.count_if(sure_other).alias("n_other"), F.count_if(east).alias("n_east"))
    context = context.where("n_other > 0 or n_latin > 0 or n_east > 0")
    spelt = t.where(F.col("word").rlike(f"^(?:[{_LATIN_ASK}]{{4,}}|[{''.join(TO_CYRILLIC.values())}]{{4,}})\\.?$")).select("doc_id", "sent", twin.alias("twin"), latin.alias("is_latin"))
    names = spelt.join(context, ["doc_id", "sent"]).groupBy("twin").agg(F.max(F.expr("is_latin and n_latin > n_other")).alias("at_home"), F.max(F.expr("not is_latin and n_other > n_latin")).alias("has_twin"))
    names = names.where("at_home and not has_twin").select("twin")
    known = doubtful.join(context, ["doc_id", "sent"], "left").join(names, "twin", "left_anti")
    wrong = known.where("case verdict when 'variant' then true when 'ask_other' then n_latin > n_other when 'ask_latin' then n_other > n_latin else coalesce(n_east, 0) = 0 end")
    return wrong.select("doc_id", "tok").distinct()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        look_of, raw_of = [], []
        for x in b.column(2).to_pylist():
            raw_of.append(None if x is None else blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            look_of.append(None if x is None else blake2b(look(x).encode("utf-8", "surrogatepass"), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(look_of, pa.binary()), pa.array(raw_of, pa.binary())], names=["doc_id", "_o", "look", "raw"])


def _looks(docs: DataFrame, doc: str, text: str, order: str) -> DataFrame:
    """(doc_id, look, raw): digests of what each text looks like and of its code points; only they leave the scan."""
    src = docs.select(F.col(doc).alias("doc_id"), F.col(order).alias("_o"), F.col(text).cast("string").alias("_t")).where("doc_id is not null")
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    d = spread(src).mapInArrow(_digests, f"doc_id {kinds['doc_id']}, _o {kinds['_o']}, look binary, raw binary")
    return d.groupBy("doc_id").agg(F.max(F.struct("_o", "look", "raw")).alias("_r")).select("doc_id", "_r.look", "_r.raw").where("look is not null")


def look_classes(docs: DataFrame, doc: str = "doc_id", text: str = "content", order: str = "loaded_at") -> DataFrame:
    """(doc_id, class, spelling, spellings, links): the class of texts that look like a document's.

    `class` and `spelling` are digests, `spellings` the number of spellings of
    the class, `links` that of its documents in another spelling: all pairs
    without their being written out. Null texts have no class; of a document
    sent twice the last counts. Counts are summed up on the map side, so a class
    may hold any share of the documents.
    """
    d = _looks(docs, doc, text, order)
    forms = d.groupBy("look", "raw").agg(F.count("*").alias("n"))
    whole = forms.groupBy("look").agg(F.sum("n").alias("all"), F.count("*").alias("spellings"))
    counted = forms.join(whole, "look").select("raw", "spellings", (F.col("all") - F.col("n")).alias("links"))
    return d.join(counted, "raw").select("doc_id", F.hex("look").alias("class"), F.hex("raw").alias("spelling"), "spellings", "links")


def look_pairs(docs: DataFrame, doc: str = "doc_id", text: str = "content", order: str = "loaded_at") -> DataFrame:
    """(key_a, key_b): documents that look the same but differ in code points.

    Only digests leave the scan. Distinct spellings of one look are paired
    first; documents join those pairs, so no time goes into pairs of equal
    texts however many there are. Null texts look like nothing; of a document
    sent twice the last counts.
    """
    d = _looks(docs, doc, text, order)
    forms = d.select("look", "raw").distinct()
    several = forms.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    forms = forms.join(several, "look", "left_semi")
    a, b = forms.select("look", F.col("raw").alias("raw_a")), forms.select("look", F.col("raw").alias("raw_b"))
    pairs = a.join(b, "look").where("raw_a < raw_b")
    left, right = d.select(F.col("doc_id").alias("x"), F.col("raw").alias("raw_a")), d.select(F.col("doc_id").alias("y"), F.col("raw").alias("raw_b"))
    out = pairs.join(left, "raw_a").join(right, "raw_b")
    return out.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
