"""Readers: text, CoNLL, BRAT, GATE XML, annotation XML and JSON, markup, lists of documents.

Every reader takes a DataFrame of whole files (name, payload) or of lines, so
that it works the same on files, tables and streams; `files` makes one from paths.
"""

from __future__ import annotations

import glob
import os
import re
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, payload) of whole text files, carriage returns taken out."""
    df = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.replace("value", F.lit("\r"), F.lit("")).alias("payload"))
    return df


def text_documents(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """Whole texts without carriage returns; null stays null."""
    return docs.withColumn(payload, F.replace(F.col(payload), F.lit("\r"), F.lit("")))


def distinct_by_name(docs: DataFrame, name: str = "name", order: list[str] | None = None) -> DataFrame:
    """The first document of each name in the given order; nameless documents all stay."""
    w = Window.partitionBy(name).orderBy(*(order or [F.monotonically_increasing_id()]))
    named = docs.where(F.col(name).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return named.unionByName(docs.where(F.col(name).isNull()))


def documents_from_list(spark: SparkSession, patterns: list[str], file_format: str = "guess", **options) -> DataFrame:
    """Documents of all files that the patterns stand for, one per base name: the first."""
    seen: dict[str, str] = {}
    for p in patterns:
        for f in sorted(glob.glob(p)) or ([p] if os.path.exists(p) else []):
            seen.setdefault(os.path.basename(f), f)
    if not seen:
        raise ValueError("no such files: " + ", ".join(patterns))
    kind = sniff(next(iter(seen.values())), **options) if file_format == "guess" else file_format
    return load(spark, list(seen.values()), kind, **options)


def sniff(path: str, fields: list[str] | None = None, word_field: str | None = None, **_) -> str:
    """The format of a file by its name, its first element and what the caller says of it."""
    if re.match(r"https?://", path):
        raise ValueError("no network here: fetch the page and pass its text to html_documents")
    base, ext = os.path.splitext(path)
    if ext == ".xml":
        with open(path, encoding="utf-8", errors="replace") as f:
            m = re.search(r"<(sem|document|GateDocument)\b", f.read(4096))
        return {"sem": "xml", "document": "xml", "GateDocument": "gate"}[m.group(1)] if m else "text"
    if ext == ".json":
        return "json"
    if ext == ".ann" or ext == ".txt" and os.path.exists(base + ".ann"):
        return "brat"
    return "conll" if fields and word_field else "text"


def load(spark: SparkSession, paths: str | list[str], kind: str | None = None, **options) -> DataFrame:
    """Documents or rows of files, by the reader their format asks for."""
    first = paths if isinstance(paths, str) else paths[0]
    kind = kind or sniff(first, **options)
    df = files(spark, paths)
    if kind == "text":
        return df.select("name", F.col("payload").alias("content"))
    if kind == "html":
        return html_documents(df)
    if kind == "conll":
        lines = df.select(F.col("name").alias("doc_id"), F.posexplode(F.split("payload", "\n")).alias("line_no", "raw"))
        return conll_tokens(lines, options["fields"], options["word_field"])
    if kind == "brat":
        return brat_tags(df.select(F.col("name").alias("doc_id"), F.explode(F.split("payload", "\n")).alias("line")))
    if kind in ("xml", "gate", "json"):
        return {"xml": xml_documents, "gate": gate_documents, "json": json_documents}[kind](df)
    raise ValueError(f"no reader for {kind!r}")


def conll_tokens(lines: DataFrame, fields: list[str], word_field: str) -> DataFrame:
    """(doc_id, sent, pos, tok, lb, ub, fields...) of lines (doc_id, line_no, raw).

    Blank lines end sentences; words are one space apart and sentences one line
    end, so offsets are running lengths. Short lines give null for what they lack.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    blank = F.coalesce(F.trim("raw") == "", F.lit(True))
    t = lines.withColumn("_s", F.sum(blank.cast("int")).over(w)).where(~blank)
    cells = F.split("raw", "\t", -1)
    t = t.select("doc_id", "line_no", "_s", *[F.try_element_at(cells, F.lit(i + 1)).alias(f) for i, f in enumerate(fields)])
    t = t.withColumn("sent", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_s")) - 1).cast("int"))
    t = t.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id", "sent").orderBy("line_no")) - 1).cast("int"))
    n = F.length(F.coalesce(F.col(word_field), F.lit("")))
    t = t.withColumn("tok", (F.row_number().over(w) - 1).cast("int"))
    t = t.withColumn("lb", (F.sum(n + 1).over(w) - n - 1).cast("int")).withColumn("ub", (F.col("lb") + n).cast("int"))
    return t.select("doc_id", "sent", "pos", "tok", "lb", "ub", *fields)


def conll_content(tokens: DataFrame, word: str = "word") -> DataFrame:
    """(doc_id, content): words joined by a space, sentences by a line end."""
    s = tokens.groupBy("doc_id", "sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.col(word), F.lit("")).alias("x")))), lambda x: x["x"]), " ").alias("line"))
    return s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent", "line"))), lambda x: x["line"]), "\n").alias("content"))


def keyed_rows(lines: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Rows of tab-separated lines under given keys; what short rows lack is null, or an error if strict."""
    cells = F.split("raw", "\t", -1)
    if strict:
        cells = F.when(F.size(cells) == len(keys), cells).otherwise(F.raise_error(F.concat(F.lit("not as many columns as keys: "), F.col("raw"))))
    return lines.select("doc_id", "line_no", *[F.try_element_at(cells, F.lit(i + 1)).alias(k) for i, k in enumerate(keys)])


def brat_tags(lines: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, id, value, lb, ub, text) of the T lines of annotation files (doc_id, line).

    Each fragment of a discontinuous tag is a tag, or with `whole` one tag covers all.
    """
    parts = F.split("line", "\t")
    head = F.split(F.get(parts, F.lit(1)), " ", 2)
    t = lines.where(F.col("line").startswith("T")).select("doc_id", F.get(parts, F.lit(0)).alias("id"), F.get(head, F.lit(0)).alias("value"), F.split(F.get(head, F.lit(1)), ";").alias("_f"), F.get(parts, F.lit(2)).alias("text"))
    places = F.transform("_f", lambda x: F.struct(F.get(F.split(x, " "), F.lit(0)).try_cast("int").alias("lb"), F.get(F.split(x, " "), F.lit(1)).try_cast("int").alias("ub")))
    t = t.withColumn("_p", places)
    if whole:
        return t.select("doc_id", "id", "value", F.array_min(F.transform("_p", lambda p: p["lb"])).alias("lb"), F.array_max(F.transform("_p", lambda p: p["ub"])).alias("ub"), "text")
    return t.select("doc_id", "id", "value", F.explode("_p").alias("p"), "text").select("doc_id", "id", "value", "p.lb", "p.ub", "text")


def tagset(lines: DataFrame, col: str = "value") -> DataFrame:
    """(tag): one per line, comments from # on and blank lines taken out."""
    c = F.trim(F.get(F.split(F.col(col), "#"), F.lit(0)))
    return lines.select(c.alias("tag")).where("tag <> ''").distinct()


# --- documents with layers: one schema for XML, GATE and JSON ---

#: Characters of files whose parsed rows a worker holds before it sends them on.
HELD = 1_000_000

LAYERED = "name string, content string, metadata map<string,string>, segmentations array<struct<name:string,reference:string,spans:array<struct<s:int,l:int>>>>, annotations array<struct<name:string,reference:string,tags:array<struct<v:string,s:int,l:int>>>>"
_SPAN = pa.list_(pa.struct([("s", pa.int32()), ("l", pa.int32())]))
_TAG = pa.list_(pa.struct([("v", pa.string()), ("s", pa.int32()), ("l", pa.int32())]))
_ARROW = pa.schema([
    ("name", pa.string()), ("content", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())),
    ("segmentations", pa.list_(pa.struct([("name", pa.string()), ("reference", pa.string()), ("spans", _SPAN)]))),
    ("annotations", pa.list_(pa.struct([("name", pa.string()), ("reference", pa.string()), ("tags", _TAG)]))),
])


def _parsed(df: DataFrame, parse) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for n, p in zip(b.column(0), b.column(1), strict=True):
                if text := p.as_py():
                    rows += parse(n.as_py(), text)
                    held += len(text)
                if held > HELD:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return df.select("name", "payload").mapInArrow(run, LAYERED)


def parse_xml(name: str, text: str, subtypes: bool = True) -> list[dict]:
    """The documents of an annotation XML file; without subtypes tags keep their first level only."""
    root = ET.fromstring(text)
    out = []
    for doc in [root] if root.tag == "document" else root.iter("document"):
        meta = doc.find("metadata")
        segs = [{"name": s.get("name"), "reference": s.get("reference"), "spans": [{"s": int(x.get("s", x.get("start", 0))), "l": int(x.get("l", x.get("length", 0)))} for x in s]} for s in doc.iterfind("segmentations/segmentation")]
        anns = [{"name": a.get("name"), "reference": a.get("reference"), "tags": [{"v": (x.get("v", x.get("value")) or "").split(".")[0] if not subtypes else x.get("v", x.get("value")), "s": int(x.get("s", x.get("start", 0))), "l": int(x.get("l", x.get("length", 0)))} for x in a]} for a in doc.iterfind("annotations/annotation")]
        out.append({"name": doc.get("name") or name, "content": (doc.findtext("content") or ""), "metadata": dict(meta.attrib) if meta is not None else {}, "segmentations": segs, "annotations": anns})
    return out


def xml_documents(df: DataFrame, subtypes: bool = True) -> DataFrame:
    """Layered documents of annotation XML files (name, payload)."""
    return _parsed(df, lambda n, p: parse_xml(n, p, subtypes))


def parse_gate(name: str, text: str) -> list[dict]:
    """A GATE document: node places by the text before them, a layer per annotation set."""
    root = ET.fromstring(text)
    body = root.find("TextWithNodes")
    content, place = body.text or "", {}
    for node in body:
        place[node.get("id")] = len(content)
        content += node.tail or ""
    anns = []
    for s in root.iterfind("AnnotationSet"):
        tags = [{"v": a.get("Type"), "s": place[a.get("StartNode")], "l": place[a.get("EndNode")] - place[a.get("StartNode")]} for a in s if a.get("StartNode") in place and a.get("EndNode") in place]
        anns.append({"name": s.get("Name") or "", "reference": None, "tags": sorted(tags, key=lambda t: (t["s"], -t["l"], t["v"]))})
    return [{"name": name, "content": content, "metadata": {}, "segmentations": [], "annotations": anns}]


def gate_documents(df: DataFrame) -> DataFrame:
    return _parsed(df, parse_gate)


def parse_json(name: str, text: str) -> list[dict]:
    import json

    from ..operators.nested import READERS, Automaton, documents_of, layers_of

    root = json.loads(text)
    a = Automaton(root)

    def rows(items: list) -> list[dict]:
        kinds = [a.of(x) for x in items]
        if kinds and kinds.count(kinds[0]) == len(kinds):  # what is written as it is read
            if kinds[0] == "extent_object":
                return items
            if kinds[0] == "tag" and all(type(x["v"]) is str for x in items):
                return items
        return [{"v": v, "s": s, "l": k} for i, (x, kind) in enumerate(zip(items, kinds, strict=True)) if kind in READERS for _, _, v, s, k in READERS[kind](i, x, a)]

    out = []
    for doc in documents_of(root, a):
        segs = [{"name": n, "reference": r or None, "spans": rows(items)} for n, r, items, _ in layers_of(doc.get("segmentations"), a)]
        anns = [{"name": n, "reference": r or None, "tags": rows(items)} for n, r, items, _ in layers_of(doc.get("annotations"), a)]
        meta = doc.get("metadatas") or doc.get("metadata") or {}
        out.append({"name": doc.get("name") or name, "content": doc.get("content"), "metadata": {k: v for k, v in meta.items() if isinstance(v, str)}, "segmentations": segs, "annotations": anns})
    return out


def json_documents(df: DataFrame) -> DataFrame:
    """Layered documents of annotation JSON files (name, payload)."""
    return _parsed(df, parse_json)


def span_rows(layered: DataFrame) -> DataFrame:
    """(name, layer, reference, idx, lb, ub) of the segmentations of layered documents."""
    s = layered.select("name", F.explode("segmentations").alias("g")).select("name", F.col("g.name").alias("layer"), "g.reference", F.posexplode("g.spans").alias("idx", "x"))
    return s.select("name", "layer", "reference", "idx", F.col("x.s").alias("lb"), (F.col("x.s") + F.col("x.l")).alias("ub"))


def tag_rows(layered: DataFrame) -> DataFrame:
    """(name, layer, reference, idx, value, lb, ub) of the annotations of layered documents."""
    s = layered.select("name", F.explode("annotations").alias("g")).select("name", F.col("g.name").alias("layer"), "g.reference", F.posexplode("g.tags").alias("idx", "x"))
    return s.select("name", "layer", "reference", "idx", F.col("x.v").alias("value"), F.col("x.s").alias("lb"), (F.col("x.s") + F.col("x.l")).alias("ub"))


def layer_rows(layered: DataFrame) -> DataFrame:
    """(name, layer, value, lb, ub): the annotations, the spans of tokens and, as layer `content`, the whole text of layered documents, each read once."""
    tags = F.flatten(F.transform("annotations", lambda g: F.transform(g["tags"], lambda x: F.struct(F.lower(g["name"]).alias("layer"), x["v"].alias("value"), x["s"].alias("lb"), (x["s"] + x["l"]).alias("ub")))))
    of = lambda layer, value, lb, ub: F.struct(F.lit(layer).alias("layer"), value.cast("string").alias("value"), lb.alias("lb"), ub.alias("ub"))
    toks = F.flatten(F.transform(F.filter("segmentations", lambda g: g["name"] == "tokens"), lambda g: F.transform(g["spans"], lambda x: of("tokens", F.lit(None), x["s"], x["s"] + x["l"]))))
    whole = F.array(of("content", F.lit(None), F.lit(0), F.length("content")))
    some = lambda c: F.coalesce(c, F.expr("cast(array() as array<struct<layer:string,value:string,lb:int,ub:int>>)"))
    return layered.select("name", F.explode(F.concat(some(tags), some(toks), whole)).alias("r")).select("name", "r.*")


# --- markup and archives ---


def page_text(html: str, news: bool = False, strip: bool = True):
    """A page's text as a Column: paragraphs two line ends apart, entities decoded, spaces brought in order.

    With `news` the page ends at its first second-level heading.
    """
    c = F.regexp_replace(F.col(html), "(?i)</p>", "</p>\n\n")
    if news:
        c = F.regexp_replace(c, "(?is)<h2.*$", "")
    if strip:
        c = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for entity, ch in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(ch))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(c, r" ?\n ?(?: ?\n ?)+", "\n\n"))


def html_documents(df: DataFrame, news: bool = False, strip: bool = True) -> DataFrame:
    return df.select("name", page_text("payload", news, strip).alias("content"), F.lit("text/html").alias("mime"))


def ensure_model(path: str) -> str:
    """The path of a model; unpacked from an archive beside it where only that is there, never outside its folder."""
    if not os.path.exists(path) and os.path.exists(path + ".tar.gz"):
        with tarfile.open(path + ".tar.gz") as t:
            t.extractall(os.path.dirname(path) or ".", filter="data")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path
