"""Pipeline modules on one document at a time: tokens, tags and payload are made where the document lies, so nothing but documents is moved.

Each function does for one document what the module of its name does by joins
over tables; `plans.pipeline` runs a chain of them in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import segment
from ..operators.dictionary import SEP
from ..sources import sinks

#: Entries of a lexicon that every worker holds; larger ones are joined with the tokens.
ENTRIES = 100_000

Tag = tuple[int, int, "str | None"]


@dataclass
class Doc:
    """Columns of a document's tokens, where its sentences begin and end among them, and labels by field."""

    columns: dict[str, list]
    sentences: list[tuple[int, int]]
    fields: dict[str, list[str]] = field(default_factory=dict)

    def words(self) -> list[list[str]]:
        return [self.columns["word"][a:z] for a, z in self.sentences]


Step = Callable[[Doc], None]

_ENDS = re.compile(r"[?!]+|…|\.\.+.*")


def segmented(text: str, cut: Callable[[str], list[tuple[int, int]]], variant: str) -> Doc:
    """As `segment.tokenise`, `sentence_ids` and `paragraph_ids`."""
    opens, closes = (frozenset(x) for x in segment.NESTING.get(variant, ((), ())))
    out: dict[str, list] = {k: [] for k in ("tok", "par", "sent", "pos", "lb", "ub", "word")}
    tok, pars, sents, pos, lb, ub, words = out.values()
    spans, sentences = cut(text) if text else [], []
    sent, now, first, par, depth, before = 0, -1, 0, 0, 0, None
    for k, (a, z) in enumerate(spans):
        w = text[a:z]
        if variant == "default" and w in ("\r", "\n", "\r\n"):
            sent += 1
            continue
        if sent != now:
            if sentences:
                sentences[-1] = (sentences[-1][0], len(tok))
            sentences.append((len(tok), len(tok)))
            par += before is not None and text.count("\n", before, a) > 1
            now, first = sent, k
        tok.append(k)
        pars.append(par)
        sents.append(sent)
        pos.append(k - first)
        lb.append(a)
        ub.append(z)
        words.append(w)
        before = z
        if variant == "default":
            continue
        depth += 1 if w in opens else -1 if w in closes else 0
        if w == ".":
            sent += depth == 0
        elif w[:1] in "?!…." and _ENDS.fullmatch(w) or variant == "fr" and k + 1 < len(spans) and text.count("\n", z, spans[k + 1][0]) > 1:
            sent += 1
    if sentences:
        sentences[-1] = (sentences[-1][0], len(tok))
    return Doc(out, sentences)


def decoded(labels: list[str]) -> list[Tag]:
    """As `spans.decode_chunks`, of a column that `encoded` made."""
    out: list[Tag] = []
    at = None
    for i, x in enumerate([*labels, "O"]):
        if x[:2] == "I-" and at is not None:
            continue
        if at is not None:
            out.append((at, i, labels[at][2:]))
        at = i if x[:2] == "B-" else None
    return out


def encoded(tags: list[Tag], n: int) -> list[str]:
    """As `spans.encode_chunks`: where tags meet, the one that is nearer to its beginning, of equals the least value."""
    cells: dict[int, tuple] = {}
    for lb, ub, value in tags:
        for i in range(lb, ub):
            c = (i - lb, value is not None, value)
            if i not in cells or c < cells[i]:
                cells[i] = c
    out = ["O"] * n
    for i, (k, _, value) in cells.items():
        out[i] = ("I-" if k else "B-") + (value or "")
    return out


def indexed(entries: list[tuple[str, int, str | None]]) -> dict[str, list[tuple[int, str, str | None]]]:
    """Entries (key, n, value) by their first word, longest first."""
    index: dict[str, list] = {}
    for key, n, value in entries:
        index.setdefault(key.split(SEP)[0], []).append((n, key, value))
    for x in index.values():
        x.sort(key=lambda e: -e[0])
    return index


def matches(words: list[str], index: dict[str, list[tuple[int, str, str | None]]]) -> list[Tag]:
    """As `dictionary.longest_matches`."""
    out: list[Tag] = []
    end, last = 0, len(words) - 1
    for p, w in enumerate(words):
        found = [(n, v) for n, key, v in index.get(w, ()) if p + n <= len(words) and (w == key if n == 1 else SEP.join(words[p : p + n]) == key)]
        if not found or p < last and p < end:
            continue
        n, value = found[0]
        if p == last:  # nothing longer than a word fits here
            value = value or None
        out.append((p, p + n, value))
        end = p + n
    return out


def lexicon(index: dict[str, list[tuple[int, str, str | None]]], name: str) -> Step:
    def step(d: Doc) -> None:
        d.fields[name] = [x for words in d.words() for x in encoded(matches(words, index), len(words))]

    return step


def _places(words: list[str], known: dict[str, list[tuple[int, str, list[str]]]]) -> list[Tag]:
    """As `consistency._places` in one sentence."""
    out: list[Tag] = []
    end = 0
    for p, w in enumerate(words):
        if p >= end and w in known:
            hits = [(n, value) for n, value, parts in known[w] if p + n <= len(words) and words[p + 1 : p + n] == parts[1:n]]
            if hits:
                n, value = max(hits)
                out.append((p, p + n, value))
                end = p + n
    return out


def label_consistency(name: str, overriding: bool) -> Step:
    """As `consistency.spread`."""

    def step(d: Doc) -> None:
        words = d.words()
        gold = [decoded(d.fields[name][a:z]) for a, z in d.sentences]
        seen: dict[tuple[str, int], dict[str, list]] = {}
        for s, (ws, tags) in enumerate(zip(words, gold, strict=True)):
            for lb, ub, value in tags:
                seen.setdefault((SEP.join(ws[lb:ub]), ub - lb), {}).setdefault(value, [0, (s, lb)])[0] -= 1
        if not seen:
            return
        known: dict[str, list] = {}
        for (key, n), values in seen.items():
            parts = key.split(SEP)
            known.setdefault(parts[0], []).append((n, min((*x, value) for value, x in values.items())[2], parts))
        labels: list[str] = []
        for ws, tags in zip(words, gold, strict=True):
            found = _places(ws, known)
            if overriding:
                there = {t[:2] for t in tags}
                fresh = [f for f in found if f[:2] not in there]
                tags = [t for t in tags if not any(f[0] <= t[0] and t[1] <= f[1] for f in fresh)]
            else:
                fresh = [f for f in found if not any(t[0] < f[1] and f[0] < t[1] for t in tags)]
            labels += encoded([*tags, *fresh], len(ws))
        d.fields[name] = labels

    return step


def bundled(d: Doc, fields: dict, layers: dict[str, str]) -> sinks._Document:
    """The document as `sinks.bundle` has it, with the tags of `layers` (layer: field)."""
    tok, lb, ub = (d.columns[k] for k in ("tok", "lb", "ub"))
    tags = []
    for layer, name in layers.items():
        for a, z in d.sentences:
            tags += [(lb[a + x], -ub[a + y - 1], value, layer, ub[a + y - 1], tok[a + x], tok[a + y - 1] + 1) for x, y, value in decoded(d.fields[name][a:z])]
    names = ("lb", "nub", "value", "layer", "ub", "tlb", "tub")
    columns = dict(zip(names, map(list, zip(*sorted(tags), strict=True)), strict=True)) if tags else {k: [] for k in names}
    return sinks._Document(fields, tokens=(d.columns, 0, len(tok)), tags=(columns, 0, len(tags)))


def exported(docs: DataFrame, tokeniser: str, variant: str, html: bool, steps: list[Step], layers: dict[str, str], fmt: str) -> DataFrame:
    """(doc_id, name, payload) of documents (doc_id, name, content), each named once.

    A document without an id has no tokens, as no join finds it.
    """
    cut, render = segment.get_tokeniser(tokeniser), sinks.get_exporter(fmt)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def payload(name: str, content: str, has_id: bool) -> str:
        text = segment.blanked(content) if html else content
        d = segmented(text if has_id else "", cut, variant)
        for step in steps:
            step(d)
        return render(bundled(d, {"name": name, "content": content}, layers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, contents = (b.column(c) for c in ("doc_id", "name", "content"))
            at, payloads, held = 0, [], 0
            for i in range(b.num_rows):
                payloads.append(payload(names[i].as_py(), contents[i].as_py(), ids[i].is_valid))
                held += len(payloads[-1])
                if held > sinks.HELD or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, i + 1 - at), names.slice(at, i + 1 - at), pa.array(payloads, pa.string())], names=["doc_id", "name", "payload"])
                    at, payloads, held = i + 1, [], 0

    text = F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content")
    return docs.select("doc_id", F.coalesce("name", F.col("doc_id").cast("string")).alias("name"), text).mapInArrow(run, f"doc_id {kind}, name string, payload string")
