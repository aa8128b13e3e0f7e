"""Personal details in free text (problem 10).

A linear-chain conditional random field over word-shape features finds them. It
is trained from the small labelled table in pii_table. Texts are cut into tokens
many at a time on arrays of code points; features belong to token types, so the
weights of all tokens come from one table look-up per position, and Viterbi runs
over many stretches of text at once in numpy. What the field finds is then
checked: places are fitted to the form of their kind.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .normalize import canonical
from .pii_table import FIRST, NOUNS, ORG_KINDS, PLACE_NOUNS, STARTERS, TEMPLATES, WORDS, labelled

KINDS = ("email", "phone", "identity", "address", "name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Positions around a token whose features count.
OFFSETS = (-4, -3, -2, -1, 0, 1, 2)
#: Passes over the table, rows learnt from together, step, and penalty on weights.
EPOCHS, BATCH, RATE, PENALTY = 8, 256, 0.2, 0.02
#: Runs of neighbouring tokens whose kinds count together.
RUNS = ((-1, 0), (0, 1), (-2, -1), (-1, 0, 1))
CLASSES = 26
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

# Words that name streets, titles, and what is called after people.
STREETS = frozenset("rue place quai boulevard avenue chemin allée impasse cours square passage route street road lane close drive way court terrace crescent gardens grove calle plaza paseo avenida camino travesía ronda via viale piazza corso largo vicolo rua praça travessa allee gasse weg platz ufer markt mühle straße strasse bd av ул улица".split())
STREET_ENDS = re.compile(r"\w+(?:straße|strasse|weg|gasse|allee|platz|ufer|damm|ring)$")
TITLES = frozenset("m mm mme mlle mr mrs ms miss dr dre dra me maître herr frau sr sra srta don doña sig sig.ra dott prof monsieur madame".split())
CALLED_AFTER = frozenset(
    "prix lycée école collège prize award medal school college high primary grammar academy premio instituto escuela colegio preis gymnasium prémio schule grundschule stiftung fondation foundation fundación fondazione fundação"
    " bibliothèque library biblioteca bücherei hôpital hospital krankenhaus ospedale stade stadium stadion estadio salle hall halle salón théâtre theatre theater teatro musée museum museo museu tour tower turm torre pont bridge brücke puente parc park parque jardin garden"
    " moulin mill molino mulino moinho gate quay fontaine hôtel hotel café restaurant gare station bahnhof estación port harbour hafen puerto phare lighthouse kiosque fontaine fountain marché market église church kirche iglesia chapelle chapel abbaye abbey couvent saint san santa sankt st bad".split()
)
ORGANISATIONS = frozenset(w.lower() for ws in ORG_KINDS.values() for w in ws) | frozenset("société entreprise firme compagnie company firm firma empresa ditta groupe banque bank association verein asociación laboratoire laboratory labor éditions verlag editorial".split())
FIRM_ENDS = frozenset("sa sarl sas gmbh ag kg ltd inc plc lda coop group industries frères cie söhne fils llc corp co bros".split())

# What a character is to the tokeniser.
SPACE, LETTER, DIGIT, SIGN, HAN, HIRAGANA, KATAKANA = range(7)


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x10000, SIGN, np.uint8)
    for o in range(0x10000):
        c = chr(o)
        if c.isspace():
            out[o] = SPACE
        elif unicodedata.category(c) == "Nd":
            out[o] = DIGIT
        elif 0x3040 <= o < 0x30A0:
            out[o] = HIRAGANA
        elif 0x30A0 <= o < 0x3100:
            out[o] = KATAKANA
        elif 0x3400 <= o < 0xA000 or o == 0x3005:
            out[o] = HAN
        elif c.isalpha() or unicodedata.category(c)[0] == "M":
            out[o] = LETTER
    return out


_AT = r"(?:\s?[@＠]\s?|\s?[\[({]\s?(?:at|arobase|arroba|chiocciola|klammeraffe|@)\s?[\])}]\s?|\s(?:arobase|arroba|chiocciola)\s|\sat\s(?=[\w-]+\s?(?:dot|[\[({]\s?(?:dot|point|punto|punkt|ponto))))"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|point|punto|punkt|ponto|\.)\s?[\])}]\s?|\s(?:dot|point|punkt|punto|ponto)\s)"
EMAIL = re.compile(rf"(?<![\w@＠])[\w](?:[\w.+'-]*[\w+])?{_AT}(?!www\b)[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)+", re.IGNORECASE)
#: What any address holds; texts without it aren't searched for one.
_HINTS = ("@", "＠", "(at", "[at", "{at", "( at", "[ at", "arobase", "arroba", "chiocciola", "klammeraffe")
NUMBER = re.compile(r"(?:\(\s?\+?|\+)?\d(?:(?:[ ./\-\u00a0\u202f]|\)[ ./\-]?|[ ./\-]?\()?\d)*")
CODE = re.compile(r"(?<!\w)(?=[A-Z0-9 .\-/]*\d)[A-Z0-9]+(?:[ .\-/]?[A-Z0-9]+)*(?!\w)")
_CODED = re.compile(r"[A-Z][ .\-/]?\d|\d[ .\-/]?[A-Z]")


def _shape(w: str) -> str:
    if w.isdigit():
        return f"d{min(len(w), 15)}"
    if len(w) == 1:
        return "X" if w.isupper() else ("x" if w.islower() else "oo") if w.isalpha() else w
    if w.isupper():
        return "XX" if len(w) > 2 else f"XX{len(w)}"
    if w[0].isupper():
        return "Xx" if w[1:].islower() else "XxX"
    if w.islower():
        return "xx"
    return "xX" if w.upper() != w.lower() else "oo"


@lru_cache(1)
def _vocabulary() -> frozenset[str]:
    """The fixed words of the table; what fills its slots is known by shape only."""
    words = set()
    for block in TEMPLATES.values():
        for m in re.finditer(r"[^\W\d_]+", re.sub(r"\{[^}]*\}", " ", block)):
            words.add(m.group().lower())
    extra = "flat apt unit suite appt bât étage piso interno cedex ter bis tel tél fax www http n nr no de da do dos del la von zu van der"
    words |= {w.lower() for block in (NOUNS, STARTERS, PLACE_NOUNS, *WORDS.values()) for w in block.split()}
    return frozenset(words | set(extra.split()) | STREETS | TITLES | CALLED_AFTER | ORGANISATIONS | FIRM_ENDS)


@lru_cache(1)
def _first_names() -> frozenset[str]:
    return frozenset(n.lower() for ns in FIRST.values() for n in ns.split())


#: A token type: the word, what stands before (nothing, space, line end), whether text follows at once, and the form it is part of.
Type = tuple[str, str, str, str]


def _attributes(word: str, before: str, after: str, form: str) -> list[str]:
    plain = canonical(word)
    low = plain.lower()
    sh = _shape(plain)
    out = [f"s={sh}", f"sf={sh}|{before}{after}"]
    if low in _vocabulary():
        out.append(f"w={low}")
    elif plain.isalpha():
        out.append("w=?")
        out.append(f"ws={sh}?")
    if plain.isalpha() and not plain.islower():
        if low in _first_names():
            out.append("first")
        if low in TITLES:
            out.append("title")
    if low in CALLED_AFTER:
        out.append("after")
    if low in ORGANISATIONS or low in FIRM_ENDS and not plain.islower():
        out.append("org")
    if plain.isalpha() and (low in STREETS or STREET_ENDS.match(low)):
        out.append("street")
    if form:
        out.append(f"f={form}")
        if "|" in form:
            out.append("f2=" + form.split("|")[0])
    return out


def _class(word: str, before: str, form: str) -> int:
    """The kind of a token, one of a few; 0 is what lies beyond a stretch."""
    if form:
        return {"n": 1, "c": 2, "e": 3}[form[1]]
    if word.isdigit():
        return 4 if len(word) < 4 else 5 if len(word) == 5 else 6
    c = word[0]
    if not c.isalpha():
        return 7 if c == "." else 8 if c == "," else 9 if c in "-'’" else 10 if c in "«“„\"()[]<>:;" else 11
    if c >= "\u3040":
        return 12 if c >= "\u3400" else 13
    low = canonical(word).lower()
    if low in STREETS or STREET_ENDS.match(low):
        return 14
    if low in CALLED_AFTER:
        return 18
    if low in ORGANISATIONS or low in FIRM_ENDS and not word.islower():
        return 19
    if word.islower():
        return 15 if low in _vocabulary() else 16
    if low in TITLES:
        return 17
    if len(word) == 1:
        return 20
    if low in _first_names():
        return 21
    if low in _vocabulary():
        return 22
    return 23 if word.isupper() else 25 if before == "n" else 24


def _runs(cls: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
    """For each of RUNS the number of the kinds around each token; `first` and `last` bound the token's stretch."""
    at = np.arange(len(cls))
    near = {}
    for o in range(-2, 2):
        j = at + o
        near[o] = np.where((j >= first) & (j <= last), cls[np.clip(j, 0, len(cls) - 1)], 0)
    for run in RUNS:
        out = np.zeros(len(cls), np.int64)
        for o in run:
            out = out * CLASSES + near[o]
        yield out


def marks_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, form) of the addresses, long numbers and codes of a text, apart from each other; what they may be is for the field to say."""
    low = text.lower()
    hinted = any(h in low for h in _HINTS) or " at " in low and "dot" in low
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)] if hinted else []
    if _CODED.search(text):
        for m in CODE.finditer(text):
            s = m.group()
            if sum(c.isdigit() for c in s) >= 5 and not s.replace(" ", "").isdigit() and any(c.isalpha() for c in s):
                bare = re.sub(r"[^A-Z0-9]", "", s)
                out.append((m.start(), m.end(), f"c{min(len(bare), 16)}|{re.sub('[A-Z]+', 'A', re.sub('[0-9]+', '9', bare))}"))
    for m in NUMBER.finditer(text):
        if m.end() - m.start() < 5:
            continue
        s = m.group()
        digits = sum(c.isdigit() for c in s)
        if digits >= 5 or s[0] == "+" or s[:2] == "(+":
            head = "+" if s[0] == "+" or s[:2] == "(+" else "(" if s[0] == "(" else "00" if s.startswith("00") else s[0] if s[0] in "012" else "9"
            seps = "".join(sorted(set(re.sub(r"\d", "", s).replace("\u00a0", " ").replace("\u202f", " "))))
            out.append((m.start(), m.end(), f"n{min(digits, 16)}{head}|{'-'.join(str(len(g)) for g in re.findall(r'[0-9]+', s)[:8])}{seps}"))
    if len(out) < 2:
        return out
    out.sort(key=lambda x: (x[2] != "email", x[2][0] != "c", x[0]))
    kept: list[tuple[int, int, str]] = []
    for x in out:
        if all(x[1] <= a or x[0] >= b for a, b, _ in kept):
            kept.append(x)
    return sorted(kept)


class Tokens:
    """The tokens of many texts: places, the text and stretch each is of, and its type.

    A stretch is a paragraph, whatever its length.
    """

    def __init__(self, texts: list[str]):
        self.marks = [marks_of(t) for t in texts]
        joined = "\n\n".join(texts)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(cps)
        sizes = np.array([len(t) for t in texts]) + 2
        bases = np.cumsum(sizes) - sizes
        cls = _classes()[np.minimum(cps, 0xFFFF)]
        fresh = np.ones(n, bool)
        fresh[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == SIGN)
        edges = np.flatnonzero(fresh)
        ends = np.append(edges[1:], n)
        real = cls[edges] != SPACE
        lo, hi = edges[real], ends[real]
        self.n = len(lo)
        self.text = np.searchsorted(bases, lo, "right") - 1
        self.lo, self.hi = lo - bases[self.text], hi - bases[self.text]
        if not self.n:
            self.first, self.types, self.ids = np.zeros(0, bool), [], np.zeros(0, np.int64)
            return
        lines = np.cumsum(cps == 10)
        gap = np.append(0, lo[1:] - hi[:-1])
        ended = np.append(2, lines[lo[1:]] - lines[hi[:-1] - 1])
        self.first = ended >= 2
        before = np.where(ended > 0, 2, np.minimum(gap, 1))
        after = np.append(np.where(gap[1:] == 0, 1, 0), 0)
        starts, stops, forms, names = [], [], [], {"": 0}
        for base, ms in zip(bases.tolist(), self.marks, strict=True):
            for a, b, form in ms:
                starts.append(base + a)
                stops.append(base + b)
                forms.append(names.setdefault(form, len(names)))
        form = np.zeros(self.n, np.int64)
        if starts:
            at = np.searchsorted(starts, lo, "right") - 1
            inside = (at >= 0) & (lo < np.array(stops)[at])
            begins = inside & np.append(True, at[1:] != at[:-1])
            form = np.where(inside, 2 * np.array(forms)[at] + begins, 0)
        # a hash of each word's code points, then of the whole type
        length = hi - lo
        pos = np.arange(n) - np.repeat(edges, ends - edges)
        power = np.cumprod(np.full(int(length.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        kept = np.repeat(real, ends - edges)
        prod = (cps[kept].astype(np.uint64) + np.uint64(1)) * power[np.minimum(pos[kept], len(power) - 1)]
        key = np.add.reduceat(prod, np.cumsum(length) - length)
        key = key * np.uint64(0xD6E8FEB86659FD93) + (form * 8 + before * 2 + after).astype(np.uint64)
        _, where, self.ids = np.unique(key, return_index=True, return_inverse=True)
        back = {v: k for k, v in names.items()}
        self.types: list[Type] = []
        for i, a, b, x, y, f in zip(where.tolist(), lo[where].tolist(), hi[where].tolist(), before[where].tolist(), after[where].tolist(), form[where].tolist(), strict=True):
            self.types.append((joined[a:b], "0_n"[x], "_1"[y], ("B" if f % 2 else "I") + back[f // 2] if f else ""))


class Field:
    """The trained field: feature weights by offset, and transition weights."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, runs: list[np.ndarray], moves: np.ndarray, start: np.ndarray):
        self.features, self.weights, self.runs, self.moves, self.start = features, weights, runs, moves, start
        self.rows: dict[Type, int] = {}
        self.table = np.zeros((0, len(OFFSETS), len(LABELS)), np.float32)
        self.classes = np.zeros(0, np.int64)

    def trim(self, most: int = 300_000) -> None:
        """Forgets the token types seen so far once there are too many; between batches only."""
        if len(self.rows) > most:
            self.rows.clear()
            self.table, self.classes = self.table[:0], self.classes[:0]

    def known(self, types: list[Type]) -> np.ndarray:
        """Row numbers of token types in the table of their weights; new types are added to it."""
        rows, fresh = self.rows, []
        out = np.empty(len(types), np.int64)
        for i, t in enumerate(types):
            r = rows.get(t)
            if r is None:
                r = rows[t] = len(rows)
                fresh.append(t)
            out[i] = r
        if fresh:
            self.classes = np.concatenate([self.classes, [_class(t[0], t[1], t[3]) for t in fresh]])
            got = [[self.features[a] for a in _attributes(*t) if a in self.features] or [self.features["none"]] for t in fresh]
            firsts = np.cumsum([0, *map(len, got[:-1])])
            for lo in range(0, len(fresh), 20_000):  # bounds the memory of the gathered weights
                hi = min(lo + 20_000, len(fresh))
                flat = np.array([x for g in got[lo:hi] for x in g])
                part = np.add.reduceat(self.weights[:, flat], firsts[lo:hi] - firsts[lo], axis=1)
                self.table = np.concatenate([self.table, part.transpose(1, 0, 2).astype(np.float32)])
        return out

    def emissions(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Label weights of every token of the concatenated stretches."""
        edge = self.weights[:, self.features["edge"]]
        n = len(ids)
        ends = np.cumsum(lens)
        first = np.repeat(ends - lens, lens)
        last = np.repeat(ends - 1, lens)
        at = np.arange(n)
        out = np.zeros((n, len(LABELS)), np.float32)
        for k, o in enumerate(OFFSETS):
            j = at + o
            part = self.table[ids[np.clip(j, 0, n - 1)], k]
            outside = (j < first) | (j > last)
            part[outside] = edge[k]
            out += part
        for w, run in zip(self.runs, _runs(self.classes[ids], first, last), strict=True):
            out += w[run]
        return out

    def viterbi(self, emit: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Best labels of all stretches; stretches of like length are decoded together."""
        out = np.zeros(len(emit), np.int8)
        starts = np.cumsum(lens) - lens
        order = np.argsort(lens, kind="stable")
        for lo in range(0, len(order), 1024):
            part = order[lo : lo + 1024]
            ls, ss = lens[part], starts[part]
            top = int(ls.max())
            score = emit[ss] + self.start
            back = np.zeros((top, len(part), len(LABELS)), np.int8)
            finals = np.where((ls == 1)[:, None], score, 0)
            for t in range(1, top):
                live = ls > t
                cand = score[:, :, None] + self.moves
                back[t] = cand.argmax(axis=1)
                score = cand.max(axis=1) + emit[np.where(live, ss + t, ss)]
                finals = np.where((ls == t + 1)[:, None], score, finals)
            lab = finals.argmax(axis=1)
            for t in range(top - 1, -1, -1):
                live = ls > t
                out[(ss + t)[live]] = lab[live]
                if t:
                    prev = back[t][np.arange(len(part)), lab]
                    lab = np.where(live, prev, lab)
        return out


def _forbidden() -> np.ndarray:
    """Moves that no labelling holds: into the inside of what hasn't begun."""
    m = np.zeros((len(LABELS), len(LABELS)), np.float32)
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            if b[0] == "I" and a[2:] != b[2:]:
                m[i, j] = -1e4
    return m


def _gathered(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of the rows of `values` that have them)."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    return keys[order][first], np.add.reduceat(values[order], first, axis=0)


class _Batch:
    """Rows of the table that are learnt from together, as arrays; the longest come first."""

    def __init__(self, seqs: list[np.ndarray], gold: list[np.ndarray], incidence: list[list[int]], classes: np.ndarray):
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        seqs, gold = [seqs[i] for i in order], [gold[i] for i in order]
        self.lens = np.array([len(x) for x in seqs])
        self.top = int(self.lens.max())
        flat, self.y = np.concatenate(seqs), np.concatenate(gold)
        ends = np.cumsum(self.lens)
        first, last = np.repeat(ends - self.lens, self.lens), np.repeat(ends - 1, self.lens)
        self.first = ends - self.lens
        self.live = np.arange(self.top)[None, :] < self.lens[:, None]
        self.alive = self.live.sum(axis=0)
        # the types of the batch, the last stands for what lies beyond a stretch
        used, local = np.unique(flat, return_inverse=True)
        rows = [*(incidence[t] for t in used), [0]]
        self.nt = len(rows)
        self.ti = np.repeat(np.arange(self.nt), [len(r) for r in rows])
        self.t_first = np.flatnonzero(np.r_[True, self.ti[1:] != self.ti[:-1]])
        self.fi = np.array([f for r in rows for f in r])
        at = np.arange(len(flat))
        self.near = []
        for o in OFFSETS:
            j = at + o
            self.near.append(np.where((j >= first) & (j <= last), local[np.clip(j, 0, len(flat) - 1)], self.nt - 1))
        self.runs = list(_runs(classes[flat], first, last))
        self.gold = np.eye(len(LABELS), dtype=np.float32)[self.y]
        same = np.append(first[1:] == first[:-1], False)
        self.pairs = np.zeros((len(LABELS), len(LABELS)), np.float32)
        np.add.at(self.pairs, (self.y[:-1][same[:-1]], self.y[1:][same[:-1]]), 1)

    def marginals(self, emit: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label probabilities of each token, expected moves), by forward-backward on scaled probabilities."""
        n, nl = len(self.lens), len(LABELS)
        full = np.zeros((n, self.top, nl), np.float32)
        full[self.live] = emit
        ee, em = np.exp(full - full.max(axis=2, keepdims=True)), np.exp(moves)
        alpha, scale = np.zeros((n, self.top, nl), np.float32), np.ones((n, self.top, 1), np.float32)
        for t in range(self.top):
            k = self.alive[t]
            v = (alpha[:k, t - 1] @ em) * ee[:k, t] if t else ee[:, 0] * np.exp(start)
            scale[:k, t] = v.sum(axis=1, keepdims=True) + 1e-30
            alpha[:k, t] = v / scale[:k, t]
        beta, expected = np.ones((n, self.top, nl), np.float32), np.zeros((nl, nl), np.float32)
        for t in range(self.top - 2, -1, -1):
            k = self.alive[t + 1]
            v = ee[:k, t + 1] * beta[:k, t + 1] / scale[:k, t + 1]
            expected += em * (alpha[:k, t].T @ v)
            beta[:k, t] = v @ em.T
        marg = (alpha * beta)[self.live]
        return marg / np.maximum(marg.sum(axis=1, keepdims=True), 1e-30), expected


@lru_cache(2)
def trained(seed: int = 7, copies: int = 4, epochs: int = EPOCHS, part: int | None = None) -> Field:
    """The field fitted to the labelled table by likelihood: forward-backward over batches of rows, steps scaled weight by weight (AdaGrad)."""
    rows = labelled(seed, copies, part)
    toks = Tokens([t for t, _ in rows])
    every = np.zeros(toks.n, np.int64)
    bounds = np.searchsorted(toks.text, np.arange(len(rows) + 1))
    for (_, spans), a, z in zip(rows, bounds, bounds[1:], strict=False):
        for kind, s, e in spans:
            inside = np.flatnonzero((toks.lo[a:z] >= s) & (toks.hi[a:z] <= e)) + a
            every[inside] = LABELS.index(f"I-{kind}")
            every[inside[:1]] = LABELS.index(f"B-{kind}")
    seqs = [(toks.ids[a:z], every[a:z]) for a, z in zip(bounds, bounds[1:], strict=False) if z > a]
    attrs = [_attributes(*t) for t in toks.types]
    counts: dict[str, int] = {}
    for x in (x for a in attrs for x in a):
        counts[x] = counts.get(x, 0) + 1
    features = {"edge": 0, "none": 1}
    for x, c in sorted(counts.items()):
        if c >= 2 or not x.startswith("f="):
            features[x] = len(features)
    incidence = [[features[x] for x in a if x in features] or [1] for a in attrs]
    classes = np.array([_class(t[0], t[1], t[3]) for t in toks.types])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(seqs))
    batches = [_Batch([seqs[i][0] for i in order[lo : lo + BATCH]], [seqs[i][1] for i in order[lo : lo + BATCH]], incidence, classes) for lo in range(0, len(order), BATCH)]
    nl = len(LABELS)
    block, block0 = _forbidden(), np.array([-1e4 if x[0] == "I" else 0 for x in LABELS], np.float32)
    shapes = [(len(OFFSETS), len(features), nl), *((CLASSES ** len(r), nl) for r in RUNS), (nl, nl), (nl,)]
    weights = [np.zeros(x, np.float32) for x in shapes]
    seen = [np.full(x, 1e-3, np.float32) for x in shapes]

    def step(k: int, at, g: np.ndarray) -> None:
        g = g - PENALTY * weights[k][at]
        seen[k][at] += g * g
        weights[k][at] += RATE * g / np.sqrt(seen[k][at])

    for _ in range(epochs):
        for q in rng.permutation(len(batches)):
            b = batches[q]
            typed = np.add.reduceat(weights[0][:, b.fi], b.t_first, axis=1)
            emit = sum(typed[k, near] for k, near in enumerate(b.near)) + sum(w[run] for w, run in zip(weights[1:], b.runs, strict=False))
            marg, expected = b.marginals(emit, weights[-2] + block, weights[-1] + block0)
            diff = b.gold - marg
            for k, near in enumerate(b.near):
                who, g = _gathered(diff, near)
                by_type = np.zeros((b.nt, nl), np.float32)
                by_type[who] = g
                fs, g = _gathered(by_type[b.ti], b.fi)
                step(0, (k, fs), g)
            for k, run in enumerate(b.runs, 1):
                step(k, *_gathered(diff, run))
            step(-2, slice(None), b.pairs - expected)
            step(-1, slice(None), diff[b.first].sum(axis=0))
    return Field(features, weights[0], weights[1:-2], weights[-2] + block, weights[-1] + block0)


Marks = list[tuple[int, int, str]]


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _fit_phone(text: str, s: int, e: int, marks: Marks) -> tuple[int, int] | None:
    """The number that a found place touches, from its plus sign, bracket or first digit."""
    touched = [(a, b) for a, b, form in marks if form[0] == "n" and a < e and b > s]
    if not touched:
        return None
    a, b = max(touched, key=lambda x: (x[1] - x[0], -x[0]))
    if text[a] == "(" and ")" not in text[a:b]:
        a += 1
    return (a, b) if _digits(text[a:b]) >= 7 else None


_WORDS_BEFORE = re.compile(r"(?:[A-Z]{2,}[ .\-])+(?=[A-Z]?\d)")
_CHECK_LETTER = re.compile(r"-?[A-Z](?!\w)")


def _fit_identity(text: str, s: int, e: int, marks: Marks) -> tuple[int, int] | None:
    """The whole number or code that a found place touches, with a check letter after it."""
    for a, b, form in marks:
        if form != "email" and a < e and b > s and _digits(text[a:b]) >= 5:
            if form[0] == "c" and a < s:  # the word before a number isn't part of it
                word = _WORDS_BEFORE.match(text, a, b)
                a = min(s, word.end()) if word else a
            s, e = min(s, a), max(e, b)
    if text[e - 1].isdigit() and (m := _CHECK_LETTER.match(text, e)):
        e = m.end()
    while s < e and not text[s].isalnum():
        s += 1
    while e > s and not text[e - 1].isalnum():
        e -= 1
    return (s, e) if _digits(text[s:e]) >= 5 and "\n" not in text[s:e] else None


_CALLS = re.compile(r"[\s,;.]+(?:tél|tel|téléphone|phone|telefon|teléfono|fax|mobile|portable)$", re.IGNORECASE)
_CEDEX = re.compile(r"[\s,]+Cedex(?:\s\d{1,2}\b)?|(?<=Cedex)\s\d{1,2}\b")


def _fit_address(text: str, s: int, e: int, marks: Marks) -> tuple[int, int] | None:
    while s < e and not (text[s].isalnum()):
        s += 1
    while e > s and not (text[e - 1].isalnum()):
        e -= 1
    if m := _CALLS.search(text[s:e]):
        e = s + m.start()
    if m := _CEDEX.match(text, e):
        e = m.end()
    got = text[s:e]
    return (s, e) if re.search(r"\d", got) and re.search(r"[^\W\d_]{3}", got) else None


_TITLE = re.compile(r"(?:Mme|Mlle|Mr|Mrs|Ms|Miss|Dr|Dra|Prof|Sr|Sra|Herr|Frau|Sig|Dott|Monsieur|Madame)\.?\s+")


def _fit_name(text: str, s: int, e: int, marks: Marks) -> tuple[int, int] | None:
    while s < e and not text[s].isalpha():
        s += 1
    while e > s and not (text[e - 1].isalpha() or text[e - 1] in "̧̀́̂̃̈"):
        e -= 1
    m = _TITLE.match(text, s, e)
    if m and m.end() < e:
        s = m.end()
    if e <= s or not any(c.isupper() or c >= "\u2e80" for c in text[s:e]):
        return None
    if text[s] >= "\u2e80":  # without spaces the run itself is the name
        return (s, e) if e - s <= 6 else None
    # a whole word or none: a place never ends inside one
    while s and (text[s - 1].isalpha() or text[s - 1] in "'’-" and s > 1 and text[s - 2].isalpha() and text[s - 1] == "-"):
        s -= 1
    while e < len(text) and text[e].isalpha():
        e += 1
    return (s, e)


_APART = re.compile(r"\s+(?:Mme|Mlle|Mr|Mrs|Ms|Herr|Frau|Sra?|Dra?)\.?\s+|[^\S\n]*\n\s*|(?<=\w\w)\.\s+|\s*[;,:]\s*")
_FIT = {"phone": _fit_phone, "identity": _fit_identity, "address": _fit_address, "name": _fit_name}


def _checked(text: str, found: list[tuple[str, int, int]], marks: Marks) -> list[tuple[str, int, int]]:
    """The places found, fitted to the form of their kind; places of addresses that hold no address fall out."""
    mails = [(a, b) for a, b, form in marks if form == "email"]
    out: dict[tuple[int, int], str] = {}
    work = list(found)
    for kind, s, e in work:
        if kind == "name" and (cuts := [m.span() for m in _APART.finditer(text, s, e)]):
            ends = [s, *(x for c in cuts for x in c), e]
            work += [("name", a, b) for a, b in zip(ends[::2], ends[1::2], strict=True) if b > a]
            continue
        if kind == "email":
            fit = next(((a, b) for a, b in mails if a < e and b > s), None)
        else:
            fit = _FIT[kind](text, s, e, marks)
            if fit and kind == "name" and any(a < fit[1] and b > fit[0] for a, b in mails):
                fit = None
        if fit and fit not in out:
            out[fit] = kind
    rank = {"email": 0, "phone": 1, "identity": 2, "address": 3, "name": 4}
    taken: list[tuple[str, int, int]] = []
    for (s, e), kind in sorted(out.items(), key=lambda x: (rank[x[1]], x[0])):
        if all(e <= a or s >= b for _, a, b in taken):
            taken.append((kind, s, e))
    return sorted(taken, key=lambda x: x[1])


#: Characters looked at together; bounds what a worker holds of weights and paths.
TOGETHER = 3_000_000


def find(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int]]]:
    """[(kind, start, length)] of each text."""
    out: list[list[tuple[str, int, int]]] = []
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t or "")
        size += len(t or "")
        if size >= TOGETHER:
            out += _find(part, field)
            part, size = [], 0
    return out + (_find(part, field) if part else [])


def _find(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    field.trim()
    toks = Tokens(texts)
    if not toks.n:
        return out
    lens = np.diff(np.append(np.flatnonzero(toks.first), toks.n))
    labels = field.viterbi(field.emissions(field.known(toks.types)[toks.ids], lens), lens)
    raw: dict[int, list[tuple[str, int, int]]] = {}
    hit = np.flatnonzero(labels)
    open_: list | None = None
    for q, lab, i, lo, hi in zip(hit.tolist(), labels[hit].tolist(), toks.text[hit].tolist(), toks.lo[hit].tolist(), toks.hi[hit].tolist(), strict=True):
        name = LABELS[lab]
        if open_ and name[0] == "I" and name[2:] == open_[0] and q == open_[3] + 1:
            open_[2], open_[3] = hi, q
            continue
        open_ = [name[2:], lo, hi, q]
        raw.setdefault(i, []).append(open_)
    for i, found in raw.items():
        out[i] = [(k, s, e - s) for k, s, e in _checked(texts[i], [(k, s, e) for k, s, e, _ in found], toks.marks[i])]
    return out


def masked(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    if not found:
        return text
    out, at = [], 0
    for kind, s, n in found:
        out += text[at:s], PLACEHOLDERS[kind]
        at = s + n
    return "".join([*out, text[at:]])


def _frozen(field: Field) -> tuple:
    return field.features, field.weights, field.runs, field.moves, field.start


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("l", pa.int32())]))


def _run(parts: tuple, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field(*parts)
        for b in batches:
            texts = b.column(2).to_pylist()
            found = find(texts, f)
            got = pa.array([masked(t, x) for t, x in zip(texts, found, strict=True)], pa.string()) if redact else pa.array([[{"kind": k, "s": s, "l": n} for k, s, n in x] for x in found], _FOUND)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), got], names=["doc_id", "_h", "got"])

    return run


def _searched(docs: DataFrame, doc: str, text: str, field: Field | None, redact: bool) -> DataFrame:
    """(doc_id, got): what was found in, or the masked form of, each document, once."""
    parts = _frozen(field or trained())
    picked = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("_h"), F.col(text).cast("string").alias("_t")).where("doc_id is not null")
    kind = picked.schema[0].dataType.simpleString()
    rows = spread(picked).mapInArrow(_run(parts, redact), f"doc_id {kind}, _h bigint, got {'string' if redact else 'array<struct<kind:string,s:int,l:int>>'}")
    return rows.groupBy("doc_id").agg(F.max(F.struct("_h", "got")).alias("_r")).select("doc_id", F.col("_r.got").alias("got"))


def places(docs: DataFrame, doc: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """(doc_id, kind, s, l) of every personal detail, offsets in code points.

    Kinds: email, phone, identity, address, name. Null and empty texts have
    none; rows without a document are left out. Rows sent twice count once, of
    different texts under one id the one with the greatest hash. Whole texts are
    read, each where it is; only what was found is shuffled. Only the weights
    travel with the tasks, their size set by the labelled table.
    """
    found = _searched(docs, doc, text, field, False)
    return found.select("doc_id", F.explode("got").alias("x")).select("doc_id", "x.kind", "x.s", "x.l")


def redacted(docs: DataFrame, doc: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """(doc_id, text) with typed placeholders in place of personal details; texts without any unchanged. Repeated ids as in `places`."""
    return _searched(docs, doc, text, field, True).withColumnRenamed("got", "text")
