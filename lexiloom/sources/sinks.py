"""Exporters: a DataFrame of documents with layers to (doc_id, payload) rows in a named format.

`bundle` puts a document's text, tokens and tags into one row: a file is written
from exactly that. Formats are functions of such a row, looked up by name.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html import escape
from xml.sax.saxutils import escape as xesc
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of payloads that a worker holds before it sends them on.
HELD = 4_000_000


def bundle(docs: DataFrame, tokens: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, name, content, tokens, tags).

    `docs`: doc_id, name, content; `tokens`: doc_id, par, sent, pos, tok, lb, ub,
    word; `tags`: doc_id, layer (pos, chunk, ner), value, lb, ub in characters
    and tlb, tub in document tokens. Documents without either get empty lists.
    """
    t = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok", "par", "sent", "pos", "lb", "ub", F.coalesce("word", F.lit("")).alias("word")))).alias("tokens"))
    a = tags.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("lb", (-F.col("ub")).alias("nub"), F.coalesce("value", F.lit("")).alias("value"), "layer", "ub", "tlb", "tub"))).alias("tags"))
    b = docs.select("doc_id", F.coalesce("name", F.col("doc_id").cast("string")).alias("name"), F.coalesce("content", F.lit("")).alias("content")).join(t, "doc_id", "left").join(a, "doc_id", "left")
    empty = "cast(array() as array<struct<tok:int,par:int,sent:int,pos:int,lb:int,ub:int,word:string>>)"
    none = "cast(array() as array<struct<lb:int,nub:int,value:string,layer:string,ub:int,tlb:int,tub:int>>)"
    return b.withColumn("tokens", F.coalesce("tokens", F.expr(empty))).withColumn("tags", F.coalesce("tags", F.expr(none)))


def _adjacent(cols: list[pa.Array]) -> np.ndarray:
    """Where a row's values differ from those of the row before; nulls are one value."""
    n = len(cols[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in cols:
        x, y = c.slice(1), c.slice(0, n - 1)
        out[1:] |= pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False) | (x.is_null().to_numpy(zero_copy_only=False) != y.is_null().to_numpy(zero_copy_only=False))
    return out


def _number(c: pa.Array) -> np.ndarray:
    """Integers to sort by, nulls first."""
    return pc.fill_null(c.cast(pa.int64()), -(2**63)).to_numpy(zero_copy_only=False)


def _rank(c: pa.Array) -> np.ndarray:
    """Strings as numbers to sort by."""
    d = c.dictionary_encode()
    words = d.dictionary.to_pylist()
    rank = np.zeros(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    return rank[d.indices.to_numpy(zero_copy_only=False)]


def _last_loaded(rows: pa.RecordBatch, new: np.ndarray, cols: list[str]) -> np.ndarray:
    """Of rows with equal keys, which begin at `new`, the place of the greatest one by `cols` as in `runtime.latest`."""
    starts = np.flatnonzero(new)
    out, ends = starts.copy(), np.r_[starts[1:], len(new)]
    several = np.flatnonzero(ends - starts > 1)
    if len(several):
        at = np.concatenate([np.arange(starts[i], ends[i]) for i in several])
        cells = zip(*(rows[c].take(pa.array(at)).to_pylist() for c in cols), strict=True)
        keys = dict(zip(at.tolist(), (tuple((x is not None, x) if x is not None else (False,) for x in r) for r in cells), strict=True))
        for i in several:
            out[i] = max(range(starts[i], ends[i]), key=keys.__getitem__)
    return out


_CHUNK = re.compile("[BIULSE]-")


def _tags(t: dict[str, pa.Array], fresh: np.ndarray, col: str, kind: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(first tokens, last tokens, values) of a column's tags, over tokens in the order of their sentences, which begin at `fresh`; as `spans.tags_at_ends`."""
    d = t[col].dictionary_encode()
    words = d.dictionary.to_pylist()
    codes = pc.fill_null(d.indices, len(words)).to_numpy(zero_copy_only=False)
    of = lambda f: np.array([*map(f, words), False], bool)
    if kind == "chunk":
        here = np.arange(len(codes))
        inside = of(lambda w: bool(_CHUNK.match(w)) and w[0] in "ILE")[codes]
        shut = np.r_[True, of(lambda w: not _CHUNK.match(w) or w[0] in "USLE")[codes][:-1] | (codes[:-1] == len(words))] | fresh
        new, begins = ~inside | shut, of(lambda w: bool(_CHUNK.match(w)) and w[0] in "BUS")[codes]
        named = [w[2:] for w in words]
    else:
        here = np.flatnonzero(codes < len(words))
        codes = codes[here]
        sent = np.cumsum(fresh)[here]
        fresh = np.r_[True, sent[1:] != sent[:-1]][: len(here)]
        new, begins = ~of(lambda w: w.startswith("_"))[codes] | fresh, np.ones(len(codes), bool)
        named = [w.removeprefix("_") for w in words]
    at = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    ends = np.flatnonzero(np.r_[new[1:] | fresh[1:], True][: len(new)] & begins[at])
    value = at[ends] if kind == "chunk" else ends
    return here[at[ends]], here[ends], [named[i] for i in codes[value].tolist()]


def _bundled(rows: pa.RecordBatch, layers: dict[str, tuple[str, str]], order: str, how: str) -> Iterator[_Document]:
    """The documents of rows that hold each one's tokens and document rows together; names, texts, tokens and tags as in `bundle`."""
    doc = rows["doc_id"]
    group = np.cumsum(_adjacent([doc])) - 1
    is_doc = rows["doc"].is_valid().to_numpy(zero_copy_only=False)
    places, n = np.flatnonzero(is_doc), int(group[-1]) + 1
    held = pa.record_batch([rows[order].take(pa.array(places)), *(c.take(pa.array(places)) for c in rows["doc"].flatten())], names=[order, *(f.name for f in rows["doc"].type)])
    of = group[places]
    chosen = _last_loaded(held, np.r_[True, of[1:] != of[:-1]][: len(of)], held.schema.names)
    named = dict(zip(of[chosen].tolist(), chosen.tolist(), strict=True))

    toks = np.flatnonzero(~is_doc)
    toks = toks[np.lexsort((_number(rows["tok"])[toks], group[toks]))]
    t = rows.take(pa.array(toks))
    rest = [c for c in rows.schema.names if c not in ("doc_id", "doc", "tok", order)]
    kept = _last_loaded(t, _adjacent([pa.array(group[toks]), t["tok"]]), [order, *rest]) if len(toks) else toks
    t, g = t.take(pa.array(kept)), group[toks[kept]]
    first = np.searchsorted(g, np.arange(n + 1))
    tokens = {c: t[c] for c in ("tok", "par", "sent", "pos", "lb", "ub")} | {"word": pc.fill_null(t["word"], "")}

    w = np.lexsort((_number(t["pos"]), _number(t["sent"]), g))
    s = {c: t[c].take(pa.array(w)) for c in t.schema.names if c not in ("doc_id", "doc")}
    g = g[w]
    fresh = _adjacent([pa.array(g), s["sent"]]) if len(g) else np.zeros(0, bool)
    found = {k: _tags(s, fresh, *x) for k, x in layers.items()} if len(g) else {}
    at, end = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found.values())]) for i in (0, 1))
    a, e, i32 = pa.array(at), pa.array(end), pa.int32()
    tags = {
        "lb": s["lb"].take(a).cast(i32), "value": pa.array([v for x in found.values() for v in x[2]], pa.string()),
        "layer": pa.array(np.repeat(np.array(list(found), object), [len(x[0]) for x in found.values()]), pa.string()), "ub": s["ub"].take(e).cast(i32), "tlb": s["tok"].take(a).cast(i32),
        "tub": pc.add(pc.subtract(pc.add(s["tok"].take(a), s["pos"].take(e)), s["pos"].take(a)), pa.scalar(1, i32)).cast(i32),
    }
    tags["nub"] = pc.negate(tags["ub"])
    o = np.lexsort((_number(tags["tub"]), _number(tags["tlb"]), _number(tags["ub"]), _rank(tags["layer"]), _rank(tags["value"]), _number(tags["nub"]), _number(tags["lb"]), g[at]))
    tags = {k: c.take(pa.array(o)) for k, c in tags.items()}
    tagged = np.searchsorted(g[at][o], np.arange(n + 1))

    tokens, tags = _lists(tokens), _lists(tags)
    names, texts = held["name"], held["content"]
    ids = doc.take(pa.array(np.flatnonzero(np.r_[True, group[1:] != group[:-1]])))
    for k, i in named.items():
        if how == "inner" and first[k] == first[k + 1]:
            continue
        name = names[i].as_py()
        fields = {"doc_id": ids[k], "name": str(ids[k].as_py()) if name is None else name, "content": texts[i].as_py() or ""}
        yield _Document(fields, tokens=(tokens, first[k], first[k + 1]), tags=(tags, tagged[k], tagged[k + 1]))


def _together(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of whole runs of rows of one key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cut = int(np.flatnonzero(_adjacent([b.column(key)]))[-1])
        if held and not cut and not held[-1].column(key)[-1].equals(b.column(key)[0]):
            yield pa.concat_batches(held)
            held = []
        if cut:
            yield pa.concat_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.concat_batches(held)


def loaded(docs: DataFrame, tokens: DataFrame, layers: dict[str, tuple[str, str]], order: str) -> DataFrame:
    """Document and token rows as they were loaded, in one table whose rows of one document lie together.

    `docs`: doc_id, name, source, content and `order`; `tokens`: doc_id, source,
    par, sent, pos, tok, lb, ub, word, the columns of the layers and `order`.
    All move once, and nothing but their document is sorted by. Of equal `order`
    the greatest row counts, by the columns as named here, labels as in `tokens`.
    """
    cols = ["source", "par", "sent", "pos", "tok", "lb", "ub", "word", *[c for c in tokens.columns if c in {x for x, _ in layers.values()}]]
    d = docs.select("doc_id", order, F.struct("name", "source", "content").alias("doc"))
    rows = d.unionByName(tokens.select("doc_id", order, *cols), allowMissingColumns=True)
    return rows.where("doc_id is not null").repartition("doc_id").sortWithinPartitions("doc_id")


def export_loaded(rows: DataFrame, layers: dict[str, tuple[str, str]], fmt: str, order: str, how: str = "left") -> DataFrame:
    """`export` of `loaded` rows: of a row sent again the last one counts, as in `runtime.latest`, tags are those of `spans.tags_at_ends`.

    With `how` inner, documents without tokens fall out.
    """
    render = get_exporter(fmt)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _together(batches, "doc_id"):
            ids, names, payloads, held = [], [], [], 0
            for x in _bundled(t, layers, order, how):
                ids.append(x["doc_id"].as_py())
                names.append(x["name"])
                payloads.append(render(x))
                held += len(payloads[-1])
                if held > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, t.schema.field("doc_id").type), pa.array(names, pa.string()), pa.array(payloads, pa.string())], names=["doc_id", "name", "payload"])
                    ids, names, payloads, held = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, t.schema.field("doc_id").type), pa.array(names, pa.string()), pa.array(payloads, pa.string())], names=["doc_id", "name", "payload"])

    return rows.mapInArrow(run, f"doc_id {kind}, name string, payload string")


def brat(tags: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, payload): one T line a tag in the order (lb, -ub, value); natively."""
    w = Window.partitionBy("doc_id").orderBy("lb", F.desc("ub"), "value")
    j = tags.join(docs.select("doc_id", "content"), "doc_id")
    text = F.regexp_replace(F.expr("substring(content, lb + 1, ub - lb)"), "\n", " ")
    line = F.concat(F.lit("T"), F.col("_n"), F.lit("\t"), F.col("value"), F.lit(" "), F.col("lb"), F.lit(" "), F.col("ub"), F.lit("\t"), text)
    j = j.where("value is not null").withColumn("_n", F.row_number().over(w)).select("doc_id", "_n", line.alias("line"))
    return j.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n").alias("payload"))


def conll(tokens: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, payload): a line a token, tab-separated, a blank line after each sentence; natively."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    s = tokens.select("doc_id", "sent", "pos", line.alias("line")).groupBy("doc_id", "sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("block"))
    return s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent", "block"))), lambda x: x["block"]), "\n\n").alias("payload"))


def _layer(row, name: str) -> list:
    return [t for t in row["tags"] if t["layer"] == name]


def _columns(row, key: str, *names: str) -> list[list]:
    """Fields of a row's tokens or tags, each as a list."""
    if isinstance(row, _Document) and key not in row:
        return [row.column(key, n) for n in names]
    return [[t[n] for t in row[key]] for n in names]


def _segmentations(row) -> dict[str, tuple[str, list[tuple[int, int]]]]:
    """(what its places count, (place, length) of all spans) of a bundled document's segmentations."""
    lb, ub, tok, sent, par = _columns(row, "tokens", "lb", "ub", "tok", "sent", "par")
    sents: dict[int, list[int]] = {}
    pars: dict[int, list[int]] = {}
    for k, s, p in zip(tok, sent, par, strict=True):
        if s in sents:
            sents[s][1] += 1
        else:
            sents[s] = [k, 1]
        if p in pars:
            pars[p][1] = s
        else:
            pars[p] = [s, s]
    return {
        "tokens": ("", [(x, y - x) for x, y in zip(lb, ub, strict=True)]),
        "sentences": ("tokens", [tuple(x) for _, x in sorted(sents.items())]),
        "paragraphs": ("sentences", [(x, y - x + 1) for _, (x, y) in sorted(pars.items())]),
    }


def _annotations(row, entry: Callable[[str], str]) -> dict[str, list[str]]:
    """The tags of each layer as they are written: `entry` of a value, with place and length put in."""
    out: dict[str, list[str]] = {}
    forms: dict[str, str] = {}
    for k, v, lb, ub in zip(*_columns(row, "tags", "layer", "value", "lb", "ub"), strict=True):
        if v not in forms:
            forms[v] = entry(v)
        out.setdefault(k, []).append(forms[v] % (lb, ub - lb))
    return out


def as_json(row) -> str:
    text = lambda x: json.dumps(x, ensure_ascii=False)
    segs = (f'{text(n)}: {{{f'"reference": {text(r)}, ' if r else ''}"spans": [{', '.join(['{"s": %d, "l": %d}' % x for x in spans])}]}}' for n, (r, spans) in _segmentations(row).items())
    anns = (f'{text(n)}: {{"annotations": [{', '.join(x)}]}}' for n, x in _annotations(row, lambda v: f'{{"v": {text(v).replace('%', '%%')}, "s": %d, "l": %d}}').items())
    return f'{{"name": {text(row["name"])}, "content": {text(row["content"])}, "metadatas": {{}}, "segmentations": {{{", ".join(segs)}}}, "annotations": {{{", ".join(anns)}}}}}'


def as_xml(row) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f"<document name={quoteattr(row['name'])}>", "  <metadata />", f"  <content>{xesc(row['content'])}</content>", "  <segmentations>"]
    for name, (reference, spans) in _segmentations(row).items():
        ref = f" reference={quoteattr(reference)}" if reference else ""
        out.append(f"    <segmentation name={quoteattr(name)}{ref}>")
        sp = ['<s s="%d" l="%d" />' % x for x in spans]
        out += ["      " + "".join(sp[i : i + 5]) for i in range(0, len(sp), 5)]
        out.append("    </segmentation>")
    out += ["  </segmentations>", "  <annotations>"]
    for name, tags in _annotations(row, lambda v: f'      <tag v={quoteattr(v).replace("%", "%%")} s="%d" l="%d" />').items():
        out.append(f"    <annotation name={quoteattr(name)}>")
        out += tags
        out.append("    </annotation>")
    return "\n".join([*out, "  </annotations>", "</document>"])


def as_gate(row) -> str:
    ner, text = _layer(row, "ner"), row["content"]
    places = sorted({p for t in ner for p in (t["lb"], t["ub"])} | {0, len(text)})
    node = {p: i for i, p in enumerate(places)}
    body = "".join(f'<Node id="{node[p]}"/>{xesc(text[p:q])}' for p, q in zip(places, [*places[1:], len(text)], strict=True))
    anns = "".join(f'<Annotation Id="{i}" Type={quoteattr(t["value"])} StartNode="{node[t["lb"]]}" EndNode="{node[t["ub"]]}"></Annotation>' for i, t in enumerate(ner))
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<GateDocument version="3"><TextWithNodes>{body}</TextWithNodes><AnnotationSet Name="NER">{anns}</AnnotationSet></GateDocument>'


def _marked(text: str, tags: list, lo: int, hi: int, enc: Callable[[str], str], begin: Callable[[dict], str], end: Callable[[dict], str]) -> str:
    """Text with marks around all tags that touch lo:hi.

    Tags within tags are nested, longer ones outside. Where tags cross, the one
    that goes on is closed with the other and opened again after it, so that
    every tag covers its whole text and the marks stay well formed.
    """
    inside = sorted((t for t in tags if t["lb"] < hi and t["ub"] > lo and t["lb"] < t["ub"]), key=lambda t: (t["lb"], -t["ub"], t["value"]))
    starts: dict[int, list[dict]] = {}
    for t in inside:
        starts.setdefault(max(t["lb"], lo), []).append(t)
    places = sorted({*starts, *(min(t["ub"], hi) for t in inside), hi})
    out, at, stack = [], lo, []
    for p in places:
        out.append(enc(text[at:p]))
        at = p
        while stack and min(stack[-1]["ub"], hi) == p:
            out.append(end(stack.pop()))
        done = [t for t in stack if min(t["ub"], hi) == p]
        again = []
        while done and any(t in stack for t in done):
            t = stack.pop()
            out.append(end(t))
            if min(t["ub"], hi) > p:
                again.append(t)
            else:
                done.remove(t)
        for t in [*reversed(again), *starts.get(p, ())]:
            out.append(begin(t))
            stack.append(t)
    return "".join(out)


def _spans_in(text: str, tags: list, lo: int, hi: int, enc: Callable[[str], str]) -> str:
    begin = {v: f'<span id="{escape(v)}" title="{escape(v)}">' for v in {t["value"] for t in tags}}
    return _marked(text, tags, lo, hi, enc, lambda t: begin[t["value"]], lambda t: "</span>")


def as_html(row) -> str:
    def enc(s: str) -> str:
        return escape(s).replace("\n", "<br />\n")

    tabs = "".join(f"<div class=\"tab\"><h2>{title}</h2>{_spans_in(row['content'], tags, 0, len(row['content']), enc)}</div>" for layer, title in (("pos", "Part-of-speech"), ("chunk", "Chunking"), ("ner", "Named entities")) if (tags := _layer(row, layer)))
    return f"<!DOCTYPE html><html><head><meta charset=\"UTF-8\" /><title>{escape(row['name'])}</title></head><body>{tabs}</body></html>"


def as_html_inline(row) -> str:
    """The source with spans put in as it stands: of named entities, else chunks, else parts of speech."""
    tags = _layer(row, "ner") or _layer(row, "chunk") or _layer(row, "pos")
    return _spans_in(row["content"], tags, 0, len(row["content"]), lambda s: s)


def as_text(row) -> str:
    """tok/POS, parts of one tag joined by _, chunks as (TYPE ...), a line a sentence."""
    pos = {t["tlb"]: t for t in _layer(row, "pos")}
    starts = {t["tlb"]: t for t in _layer(row, "chunk") or _layer(row, "ner")}
    ends = {t["tub"] for t in starts.values()}
    lines: dict[int, list[str]] = {}
    skip, toks = -1, [x["tok"] for x in row["tokens"]]
    for t in row["tokens"]:
        line = lines.setdefault(t["sent"], [])
        k = t["tok"]
        if k in starts:
            line.append(f"({starts[k]['value']}")
        if k > skip:
            p = pos.get(k)
            if p:
                skip = p["tub"] - 1
                line.append("_".join(x["word"] for x in row["tokens"][bisect_left(toks, p["tlb"]) : bisect_left(toks, p["tub"])]) + "/" + p["value"])
            else:
                line.append(t["word"])
        if k + 1 in ends:
            line.append(")")
    return "\n".join(" ".join(x) for _, x in sorted(lines.items()))


def _paragraphs(row) -> list[tuple[int, int]]:
    out: dict[int, list[int]] = {}
    for t in row["tokens"]:
        p = out.setdefault(t["par"], [t["lb"], t["ub"]])
        p[1] = t["ub"]
    return [tuple(p) for _, p in sorted(out.items())] or [(0, len(row["content"]))]


def _tei(body: str, back: str = "") -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>{body}</body>{back}</text></TEI>'


def _anchored(row, tags: list) -> tuple[str, list[tuple[str, str]]]:
    """Paragraphs with anchors at both ends of each tag, numbered by value, and the tags' (value, name)."""
    count: dict[str, int] = {}
    spots, names = [], []
    for t in tags:
        n = count[t["value"]] = count.get(t["value"], 0) + 1
        name = f"u-{t['value']}-{n}"
        spots += [(t["lb"], 1, -t["ub"], name, "Start"), (t["ub"], 0, -t["lb"], name, "End")]
        names.append((t["value"], name))
    spots.sort()
    out = []
    for lo, hi in _paragraphs(row):
        at, piece = lo, []
        for p, _, _, name, side in spots:
            if lo <= p <= hi and not (p == hi and side == "Start") and not (p == lo and side == "End"):
                piece += [xesc(row["content"][at:p]), f'<anchor xml:id={quoteattr(f"{name}-{side.lower()}")} type="AnalecDelimiter" subtype="Unit{side}" />']
                at = p
        out.append(f"<p>{''.join(piece)}{xesc(row['content'][at:hi])}</p>")
    return "".join(out), names


def _units(names: list[tuple[str, str]], features: list[dict[str, str]]) -> str:
    """The group of spans of each value, and the features of every span."""
    groups: dict[str, list[str]] = {}
    for v, n in names:
        groups.setdefault(v, []).append(f'<span xml:id={quoteattr(n)} from={quoteattr(f"#{n}-start")} to={quoteattr(f"#{n}-end")} ana={quoteattr(f"#{n}-fs")} />')
    spans = "".join(f'<spanGrp type="AnalecUnit" n={quoteattr(v)}>' + "".join(x) + "</spanGrp>" for v, x in sorted(groups.items()))
    sets = "".join(f'<fs xml:id={quoteattr(f"{n}-fs")}>' + "".join(f"<f name={quoteattr(k)}><string>{xesc(x)}</string></f>" for k, x in f.items()) + "</fs>" for (_, n), f in zip(names, features, strict=True))
    return f'<back>{spans}<fvLib n="AnalecElementProperties">{sets}</fvLib></back>'


def as_tei_analec(row) -> str:
    body, names = _anchored(row, _layer(row, "ner"))
    return _tei(body, _units(names, [{"type": v} for v, _ in names]))


# Categories of noun phrases by the part of speech they begin with; any other is GN.
NP_KINDS = {"CL": "PR_CL", "CLO": "PR_CL_O", "CLR": "PR_CL_R", "CLS": "PR_CL_S", "PRO": "PR_PRO", "PROREL": "PR_REL", "PROWH": "PR_WH", "P+PRO": "PR_PP"}


def as_tei_np(row) -> str:
    """Noun phrases as mentions; their category by the first part of speech in them."""
    pos, nps = _layer(row, "pos"), [t for t in _layer(row, "chunk") if t["value"] == "NP"]
    starts = sorted((t["lb"], t["ub"], t["value"]) for t in pos)
    kinds = []
    for t in nps:
        k = bisect_left(starts, (t["lb"],))
        first = starts[k][2] if k < len(starts) and starts[k][1] <= t["ub"] else ""
        kinds.append(NP_KINDS.get(first, "GN"))
    body, names = _anchored(row, [{**t, "value": "MENTION"} for t in nps])
    return _tei(body, _units(names, [{"REF": "", "CODE_SEM": k, "CATEGORIE": k} for k in kinds]))


def as_tei_reden(row) -> str:
    """Named entities as elements named after their type."""
    name = lambda t: "".join(c if c.isalnum() else "_" for c in t["value"]) or "name"
    ner = _layer(row, "ner")
    return _tei("".join(f"<p>{_marked(row['content'], ner, lo, hi, xesc, lambda t: f'<{name(t)}>', lambda t: f'</{name(t)}>')}</p>" for lo, hi in _paragraphs(row)))


#: Exporters of bundled rows by name; add to it to extend.
EXPORTERS: dict[str, Callable] = {"json": as_json, "xml": as_xml, "gate": as_gate, "html": as_html, "html_inline": as_html_inline, "text": as_text, "tei_analec": as_tei_analec, "tei_np": as_tei_np, "tei_reden": as_tei_reden}
EXTENSIONS = {"brat": "ann", "conll": "conll", "gate": "gate.xml", "html": "html", "html_inline": "html", "json": "json", "xml": "layers.xml", "text": "txt", "tei_analec": "analec.tei.xml", "tei_np": "tei.xml", "tei_reden": "reden.tei.xml"}


def get_exporter(name: str) -> Callable:
    try:
        return EXPORTERS[name]
    except KeyError:
        raise ValueError(f"no exporter {name!r}; there are {', '.join(sorted(EXPORTERS))}") from None


def export(bundled: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, name, payload) of every document in a format; a worker holds the rows of one document and few payloads at a time."""
    render = get_exporter(fmt)
    kind = bundled.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, tokens, tags = (b.column(c) for c in ("name", "tokens", "tags"))
            at, payloads, held = 0, [], 0
            for i in range(b.num_rows):
                lists = {k: (_lists(dict(zip((f.name for f in x.type), x.flatten(), strict=True))), 0, len(x)) for k, x in (("tokens", tokens[i].values), ("tags", tags[i].values))}
                payloads.append(render(_Document({"name": names[i].as_py(), "content": b.column("content")[i].as_py()}, **lists)))
                held += len(payloads[-1])
                if held > HELD or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, i + 1 - at), names.slice(at, i + 1 - at), pa.array(payloads, pa.string())], names=["doc_id", "name", "payload"])
                    at, payloads, held = i + 1, [], 0

    return bundled.select("doc_id", "name", "content", "tokens", "tags").mapInArrow(run, f"doc_id {kind}, name string, payload string")


class _Document(dict):
    """A bundled row; lists of structs, given as columns and the rows that are the document's, become dicts once a format asks for them."""

    def __init__(self, fields: dict, **lists: tuple[dict[str, list], int, int]):
        super().__init__(fields)
        self.lists = lists

    def column(self, key: str, name: str) -> list:
        items, lo, hi = self.lists[key]
        return items[name][lo:hi]

    def __missing__(self, key: str) -> list[dict]:
        names = list(self.lists[key][0])
        self[key] = [dict(zip(names, r)) for r in zip(*(self.column(key, n) for n in names))]  # noqa: B905
        return self[key]


def _lists(columns: dict[str, pa.Array]) -> dict[str, list]:
    plain = lambda c: c.to_pylist() if c.null_count and not pa.types.is_string(c.type) else c.to_numpy(zero_copy_only=False).tolist()
    return {k: plain(c) for k, c in columns.items()}


def corpus_page(exported: DataFrame, extension: str = "html") -> DataFrame:
    """(payload): one page with a link to each exported document, in the order of their names; lines are joined where the page is written."""
    line = F.concat(F.lit('<li><a href="'), F.col("doc_id").cast("string"), F.lit(f'.{extension}">'), F.replace(F.replace(F.col("name"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</a></li>"))
    return exported.orderBy("name", "doc_id").select(line.alias("payload"))


def write(exported: DataFrame, path: str) -> None:
    """Payloads as a text table, a row a document, written by the tasks that made them."""
    exported.write.mode("overwrite").json(path)


def combined(*corpora: DataFrame, with_tags: DataFrame | None = None) -> DataFrame:
    """Corpora for training appended: of documents of one name the first corpus' one, on demand only those with tags."""
    out = None
    for i, c in enumerate(corpora):
        c = c.withColumn("_c", F.lit(i))
        out = c if out is None else out.unionByName(c)
    out = out.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("_c", "doc_id"))).where("_r = 1").drop("_r", "_c")
    return out if with_tags is None else out.join(with_tags.select("doc_id").distinct(), "doc_id", "left_semi")
