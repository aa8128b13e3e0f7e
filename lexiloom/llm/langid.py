"""Language of documents and of their mixed-language segments (problem 5).

Prediction by partial matching: for each language a context tree over bytes,
its statistics frozen after training on the sample table, gives the exact code
length of a text, order by order with escape probabilities. A unit belongs to
the language that codes it shortest; a shortest path over a document's units,
in which a change of language costs bits, gives its runs. Headings are short:
once the sentences are settled they are judged again, with a smaller cost and
with the common words of the samples as further evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import spread
from .mojibake import Repairer
from .normalize import canonical
from .sentences import TERMINATORS, restored_units

#: Longest context in bytes, bits a change of language costs, sample rows a language used at most.
ORDER, SWITCH_BITS, SAMPLE_ROWS = 4, 50.0, 400
#: Bits a change of language costs beside a heading, length up to which a line is one.
HEADING_BITS, HEADING_CHARS = 20.0, 100
#: Times a word occurs in the samples of a language to be common there, bits it speaks against a language whose samples lack it.
COMMON, LACKING_BITS = 8, 30.0
#: Bytes scored at once.
CHUNK = 400_000

# Names of the languages in labels, lower case.
NAMES = {
    "fr": "fr fra fre french français francais französisch francés",
    "en": "en eng english anglais englisch inglés",
    "de": "de deu ger german deutsch allemand",
    "es": "es spa spanish español espanol castellano espagnol",
    "it": "it ita italian italiano italien",
    "pt": "pt por portuguese português portugues portugais",
    "ru": "ru rus russian русский russe",
    "ja": "ja jpn japanese 日本語 japonais",
    "zh": "zh zho chi chinese 中文 汉语 漢語 chinois cmn",
    "th": "th tha thai ไทย ภาษาไทย thaï",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "ar": "ar ara arabic العربية arabe",
}
_BY_NAME = {n: code for code, ns in NAMES.items() for n in ns.split()}


def label_code(label: str | None) -> str | None:
    """The two-letter code a label stands for in any notation, or None."""
    if label is None:
        return None
    x = label.strip().lower()
    return _BY_NAME.get(x) or _BY_NAME.get(re.split(r"[-_ ]", x)[0] if x else "")


_WORD = re.compile(r"\w+")


class Trees:
    """The frozen context trees of all languages, as sorted key tables with one column a language."""

    def __init__(self, samples: tuple[tuple[str, str], ...], order: int = ORDER):
        self.order = order
        self.langs = sorted({c for c, _ in samples})
        k = len(self.langs)
        per = [np.frombuffer(b"".join(b"\n" * order + canonical(t).lower().encode() + b"\n" for c, t in samples if c == lang), np.uint8).astype(np.uint64) for lang in self.langs]
        counts = [Counter(_WORD.findall("\n".join(canonical(t).lower() for c, t in samples if c == lang))) for lang in self.langs]
        self.lacking = {w: np.array([w not in c for c in counts]) for w in {w for c in counts for w, n in c.items() if n >= COMMON}}
        self.sym_keys, self.sym_bits, self.ctx_keys, self.esc_bits = [], [], [], []
        for o in range(order + 1):
            syms, ctxs = [], []
            for data in per:
                at = np.arange(order, len(data))
                key = np.zeros(len(at), np.uint64)
                for j in range(o, -1, -1):
                    key = (key << np.uint64(8)) | data[at - j]
                syms.append(np.unique(key, return_counts=True))
            allsym = np.unique(np.concatenate([s for s, _ in syms]))
            allctx = np.unique(allsym >> np.uint64(8))
            bits, esc = np.full((len(allsym), k), np.nan, np.float32), np.zeros((len(allctx), k), np.float32)
            for i, (s, n) in enumerate(syms):
                ctx, first = np.unique(s >> np.uint64(8), return_index=True)
                total, distinct = np.add.reduceat(n, first), np.diff(np.append(first, len(s)))
                ctxs.append(ctx)
                whole = np.repeat(total + distinct, distinct)
                bits[np.searchsorted(allsym, s), i] = -np.log2(n / whole)
                esc[np.searchsorted(allctx, ctx), i] = -np.log2(distinct / (total + distinct))
            self.sym_keys.append(allsym)
            self.sym_bits.append(bits)
            self.ctx_keys.append(allctx)
            self.esc_bits.append(esc)

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits each language needs for each text, one row a text."""
        out = np.zeros((len(texts), len(self.langs)))
        lo, size, part = 0, 0, []
        for i, t in enumerate(texts):
            part.append(t.lower().encode("utf-8", "replace"))
            size += len(part[-1]) + self.order + 1
            if size >= CHUNK or i + 1 == len(texts):
                out[lo : i + 1] = self._score(part)
                lo, size, part = i + 1, 0, []
        return out

    def lacks(self, text: str) -> np.ndarray:
        """Bits that the common words of other languages' samples speak against each language."""
        return LACKING_BITS * sum((self.lacking[w] for w in _WORD.findall(text.lower()) if w in self.lacking), np.zeros(len(self.langs)))

    def _score(self, parts: list[bytes]) -> np.ndarray:
        pad = b"\n" * self.order
        data = np.frombuffer(b"".join(pad + p + b"\n" for p in parts), np.uint8).astype(np.uint64)
        lens = np.array([len(p) + 1 for p in parts])
        starts = np.concatenate([[0], np.cumsum(lens + self.order)[:-1]]) + self.order
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        key = np.zeros(len(at), np.uint64)
        for j in range(self.order, -1, -1):
            key = (key << np.uint64(8)) | data[at - j]
        uniq, back = np.unique(key, return_inverse=True)
        bits = np.zeros((len(uniq), len(self.langs)), np.float32)
        open_ = np.ones(bits.shape, bool)
        for o in range(self.order, -1, -1):
            k = uniq & np.uint64((1 << (8 * (o + 1))) - 1)
            pos = np.minimum(np.searchsorted(self.sym_keys[o], k), len(self.sym_keys[o]) - 1)
            here = np.where((self.sym_keys[o][pos] == k)[:, None], self.sym_bits[o][pos], np.float32(np.nan))
            c = k >> np.uint64(8)
            cpos = np.minimum(np.searchsorted(self.ctx_keys[o], c), len(self.ctx_keys[o]) - 1)
            esc = np.where((self.ctx_keys[o][cpos] == c)[:, None], self.esc_bits[o][cpos], np.float32(0))
            seen = ~np.isnan(here)
            bits += np.where(open_, np.where(seen, np.nan_to_num(here), esc), 0)
            open_ &= ~seen
        bits += np.where(open_, np.float32(8), 0)
        return np.add.reduceat(bits[back], np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64), axis=0)


@lru_cache(4)
def trees_of(samples: tuple[tuple[str, str], ...]) -> Trees:
    return Trees(samples)


def samples_of(df: DataFrame, lang: str = "lang", text: str = "text", limit: int = SAMPLE_ROWS) -> tuple[tuple[str, str], ...]:
    """At most `limit` labelled sample texts of each language, chosen by their hash: the training data, in a fixed order."""
    by = W.Window.partitionBy("c").orderBy(F.xxhash64("t"), "t")
    rows = df.select(F.col(lang).alias("c"), F.col(text).alias("t")).where("c is not null and t is not null").withColumn("r", F.row_number().over(by)).where(F.col("r") <= limit).orderBy("c", "t").collect()
    return tuple((r["c"], r["t"]) for r in rows)


def runs_of(bits: np.ndarray, switch: float = SWITCH_BITS) -> list[int]:
    """The language of each unit on the cheapest path through a document."""
    n, k = bits.shape
    cost, back = bits[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        best = int(cost.argmin())
        stay = cost <= cost[best] + switch
        back[i] = np.where(stay, np.arange(k), best)
        cost = np.where(stay, cost, cost[best] + switch) + bits[i]
    out = [int(cost.argmin())]
    for i in range(n - 1, 0, -1):
        out.append(int(back[i, out[-1]]))
    return out[::-1]


def settled(bits: np.ndarray, heading: np.ndarray, lacks: np.ndarray) -> list[int]:
    """The language of each unit: a path through all, then the headings anew beside sentences that stay as they are."""
    path = np.array(runs_of(bits))
    if not heading.any() or heading.all():
        return path.tolist()
    fixed = np.where(np.arange(bits.shape[1]) == path[:, None], 0.0, np.inf)
    return runs_of(np.where(heading[:, None], bits + lacks, fixed), HEADING_BITS)


def confidence(bits: np.ndarray, lang: int) -> float:
    """Share of the language among all, by code lengths damped to the evidence of independent words."""
    w = np.exp2(-(bits - bits.min()) / 4)
    return float(w[lang] / w.sum())


_ITEM = re.compile(r"(?:[-–—*•◦▪·]|\(?\d{1,3}[.)])\s")


def _letters(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _heading(text: str, s: int, n: int) -> bool:
    """Whether the unit is a short line of its own that isn't a sentence."""
    lo, hi = s, s + n
    while lo and text[lo - 1] in " \t\u00a0\u3000":
        lo -= 1
    while hi < len(text) and text[hi] in " \t\u00a0\u3000":
        hi += 1
    return n <= HEADING_CHARS and text[lo - 1 : lo] in ("", "\n", "\r") and text[hi : hi + 1] in ("", "\n", "\r") and text[s + n - 1] not in TERMINATORS + ":："


def segments(docs: DataFrame, samples: tuple[tuple[str, str], ...], doc: str = "doc_id", text: str = "content", lang: str = "lang", order: str | None = None) -> DataFrame:
    """(doc_id, label, n_runs, s, l, lang, confidence): each document's runs of units in one language.

    Units in the wrong encoding or in look-alike letters are read in their
    restored form. Units without letters join the run before them. Null, empty
    and letterless texts give one row with null `lang` and confidence 0. Of a
    document sent several times the row last by `order` counts. Texts are read
    where they are: only the runs are shuffled. The sample texts that travel with
    the tasks are bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = trees_of(samples)
        repair = Repairer(tuple(t for _, t in samples))
        for b in batches:
            texts = b.column(3).to_pylist()
            spans = [restored_units(t, repair) for t in texts]
            flat = [canonical(shown) for u in spans for _, _, shown in u]
            worth = [_letters(t) for t in flat]
            seen = {t: i for i, t in enumerate(dict.fromkeys(t for t, w in zip(flat, worth, strict=True) if w))}
            scores = trees.code_lengths(list(seen)) if seen else np.zeros((0, len(trees.langs)))
            rows, i = [[] for _ in texts], 0
            for row, (t, u) in enumerate(zip(texts, spans, strict=True)):
                ids = range(i, i + len(u))
                i += len(u)
                real = [(j, x) for j, x in zip(ids, u, strict=True) if worth[j]]
                if not real:
                    rows[row].append({"n_runs": 1, "s": 0, "l": len(t or ""), "lang": None, "confidence": 0.0})
                    continue
                bits = scores[[seen[flat[j]] for j, _ in real]]
                # the items of a list share the language of the line that introduces it
                lead = np.cumsum([q == 0 or not _ITEM.match(flat[j]) for q, (j, _) in enumerate(real)]) - 1
                whole = np.zeros((lead[-1] + 1, bits.shape[1]))
                np.add.at(whole, lead, bits)
                alone = np.bincount(lead) == 1
                heads = [q for q, (_, (s, n, _)) in enumerate(real) if alone[lead[q]] and _heading(t, s, n)]
                heading, lacks = np.zeros(len(whole), bool), np.zeros(whole.shape)
                for q in heads:
                    heading[lead[q]], lacks[lead[q]] = True, trees.lacks(flat[real[q][0]])
                path = np.array(settled(whole, heading, lacks))[lead].tolist()
                cuts = [0, *(q for q in range(1, len(path)) if path[q] != path[q - 1]), len(path)]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    s = 0 if a == 0 else real[a][1][0]
                    end = real[z][1][0] if z < len(path) else len(t)
                    rows[row].append({"n_runs": len(cuts) - 1, "s": s, "l": end - s, "lang": trees.langs[path[a]], "confidence": confidence(bits[a:z].sum(axis=0), path[a])})
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rows, runs)], names=["doc_id", "_o", "label", "runs"])

    picked = docs.select(F.col(doc).alias("doc_id"), (F.col(order) if order else F.lit(0)).alias("_o"), F.col(lang).cast("string").alias("label"), F.col(text).cast("string").alias("_t")).where("doc_id is not null")
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    runs = pa.list_(pa.struct([("n_runs", pa.int32()), ("s", pa.int32()), ("l", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
    found = spread(picked).mapInArrow(run, f"doc_id {kinds['doc_id']}, _o {kinds['_o']}, label string, runs array<struct<n_runs:int,s:int,l:int,lang:string,confidence:double>>")
    last = found.groupBy("doc_id").agg(F.max(F.struct("_o", "label", "runs")).alias("_r")).select("doc_id", "_r.label", F.explode("_r.runs").alias("x"))
    return last.select("doc_id", "label", "x.*")


def label_column(label: str):
    """`label_code` as a column expression."""
    x = F.lower(F.trim(F.col(label)))
    names = F.create_map(*[F.lit(v) for pair in sorted(_BY_NAME.items()) for v in pair])
    return F.coalesce(F.try_element_at(names, x), F.try_element_at(names, F.split(x, "[-_ ]")[0]))


def mislabelled(found: DataFrame) -> DataFrame:
    """The segments of documents without a right label or in several languages."""
    known = found.select("*", label_column("label").alias("_code")).where("lang is not null")
    return known.where("n_runs > 1 or _code is null or _code <> lang").drop("_code")
