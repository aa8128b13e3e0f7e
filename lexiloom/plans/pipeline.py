"""Pipelines of named modules over a corpus, from Python or from a master file."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compile_xml
from ..operators import consistency, crf, dictionary, segment, spans
from ..sources import sinks
from . import by_document


@dataclass(frozen=True)
class Corpus:
    """Lazy tables of a corpus: documents (doc_id, name, content), tokens, tags, and which token columns are shown."""

    documents: DataFrame
    tokens: DataFrame | None = None
    tags: DataFrame | None = None
    visible: tuple[str, ...] = ("word",)


Module = Callable[..., Corpus]
MODULES: dict[str, Module] = {}


def module(name: str):
    """Registers a pipeline module: corpus and options in, corpus out."""

    def add(f: Module) -> Module:
        MODULES[name] = f
        return f

    return add


def get_module(name: str) -> Module:
    if name not in MODULES:
        raise ValueError(f"no module {name!r}; there are {', '.join(sorted(MODULES))}")
    return MODULES[name]


def truth(text: str | bool | None) -> bool:
    if isinstance(text, bool):
        return text
    t = (text or "").strip().lower()
    if t in ("true", "yes", "y", "1", "on"):
        return True
    if t in ("", "false", "no", "n", "0", "off"):
        return False
    raise ValueError(f"neither true nor false: {text!r}")


#: Rules of sentences by tokeniser; `default` for any other.
VARIANTS = {"fr": "fr", "fr_bounds": "fr", "en": "en"}


@module("segmentation")
def segmentation(c: Corpus, tokeniser: str = "default", html: str | bool = False, **_) -> Corpus:
    """Tokens with sentences and paragraphs; a corpus that has tokens keeps them.

    With `html` the contents are pages: markup is blanked, so that offsets are
    places in the page. Sentences end by the rules of the tokeniser's language.
    """
    if c.tokens is not None:
        return c
    docs = c.documents
    if truth(html):
        docs = docs.drop("content").join(segment.blank_markup(docs, html="content"), "doc_id")
    variant = VARIANTS.get(tokeniser, "default")
    t = segment.sentence_ids(segment.tokenise(docs, tokeniser, gaps=True), variant).drop("gap_newlines").where("sent is not null")
    first = t.groupBy("doc_id", "sent").agg(F.min("lb").alias("lb"), F.max("ub").alias("ub"), F.min("tok").alias("_f"))
    par = segment.paragraph_ids(first, docs).select("doc_id", "sent", "par", "_f")
    t = t.join(par, ["doc_id", "sent"]).withColumn("pos", (F.col("tok") - F.col("_f")).cast("int")).drop("_f")
    return replace(c, tokens=t)


@module("enrich")
def enrich(c: Corpus, path: str = "", mode: str = "label", **_) -> Corpus:
    e = compile_xml.read_enrichment(path)
    return replace(c, tokens=compile_xml.enrich(c.tokens, e, mode), visible=tuple(e.visible(mode)))


@module("clean")
def clean(c: Corpus, **options) -> Corpus:
    names = [n.strip() for n in options.get("to-keep", options.get("to_keep", "")).split(",") if n.strip()]
    keys = [k for k in ("doc_id", "par", "sent", "pos", "tok", "lb", "ub") if k in c.tokens.columns]
    return replace(c, tokens=spans.keep_columns(c.tokens, [*keys, *[n for n in names if n not in keys]]), visible=tuple(names))


@module("wapiti_label")
@module("label")
def label(c: Corpus, model: str = "", field: str = "label", **_) -> Corpus:
    """Labels by a stored linear-chain model; a column that is there already is kept."""
    if field in c.tokens.columns:
        return c
    with open(model, encoding="utf-8") as f:
        m = crf.read_model(f.read())
    obs = crf.observations(c.tokens, list(m.templates), list(c.visible))
    y = crf.label(obs, m, field).drop("score")
    return replace(c, tokens=c.tokens.join(y, ["doc_id", "sent", "pos"]), visible=(*c.visible, field))


@module("annotate")
def annotate(c: Corpus, annotator: str = "lexicon", **options) -> Corpus:
    return get_module({"lexicon": "lexicon", "wapiti": "label"}.get(annotator, annotator))(c, **options)


def _entries(lexicon: DataFrame) -> DataFrame:
    """(key, n, mapped): the value of each entry in the dictionary that goes first."""
    return dictionary.keyed(lexicon).groupBy("key", "n").agg(F.min_by("mapped", F.struct(F.coalesce("priority", F.lit(2**31 - 1)), F.col("dict"))).alias("mapped"))


@module("lexicon")
def lexicon(c: Corpus, lexicon: DataFrame | None = None, field: str = "ner", token: str = "word", **_) -> Corpus:
    found = dictionary.longest_matches(c.tokens, _entries(lexicon), token, value="mapped")
    if field in c.tokens.columns:
        found = dictionary.merge_with_gold(found, spans.decode_chunks(c.tokens, field))
    t = spans.encode_chunks(c.tokens.drop(field), found, field)
    return replace(c, tokens=t, visible=(*[v for v in c.visible if v != field], field))


@module("label_consistency")
def label_consistency(c: Corpus, field: str = "ner", label_consistency: str = "overriding", **_) -> Corpus:
    t = consistency.spread(c.tokens, field, "_spread", label_consistency != "non-overriding")
    return replace(c, tokens=t.drop(field).withColumnRenamed("_spread", field))


@module("map_annotations")
def map_annotations(c: Corpus, mapping: DataFrame | None = None, **_) -> Corpus:
    return replace(c, tags=spans.relabelled(c.tags, mapping))


@module("export")
def export(c: Corpus, format: str = "json", ner: str = "ner", pos: str = "", chunking: str = "", **_) -> DataFrame:
    """(doc_id, name, payload) of all documents; layers are named token columns."""
    tags = None
    for layer, col, decode in (("ner", ner, spans.decode_chunks), ("chunk", chunking, spans.decode_chunks), ("pos", pos, spans.decode_pos)):
        if col and col in c.tokens.columns:
            x = layer_tags(c.tokens, decode(c.tokens, col), layer)
            tags = x if tags is None else tags.unionByName(x)
    if tags is None:
        tags = c.tokens.sparkSession.createDataFrame([], f"doc_id {c.tokens.schema['doc_id'].dataType.simpleString()}, layer string, value string, lb int, ub int, tlb int, tub int")
    return sinks.export(sinks.bundle(c.documents, c.tokens, tags), format)


def layer_tags(tokens: DataFrame, tags: DataFrame, layer: str) -> DataFrame:
    """Sentence tags with the characters and document tokens they cover, as exporters take them."""
    a = tokens.select("doc_id", "sent", F.col("pos").alias("lb"), F.col("lb").alias("clb"), F.col("tok").alias("tlb"))
    b = tokens.select("doc_id", "sent", (F.col("pos") + 1).alias("ub"), F.col("ub").alias("cub"), (F.col("tok") + 1).alias("tub"))
    j = tags.join(a, ["doc_id", "sent", "lb"]).join(b, ["doc_id", "sent", "ub"])
    return j.select("doc_id", F.lit(layer).alias("layer"), "value", F.col("clb").cast("int").alias("lb"), F.col("cub").cast("int").alias("ub"), F.col("tlb").cast("int").alias("tlb"), F.col("tub").cast("int").alias("tub"))


def _in_one_pass(c: Corpus, steps: list[tuple[Module, dict]]) -> DataFrame | None:
    """The export of a chain that looks at one document at a time, without tables of tokens between its modules; None if the chain is another.

    Such a chain segments documents, labels tokens by lexica that `by_document.ENTRIES`
    allows and by consistency in fields of its own, and exports. As a plan of joins
    it would hold every module as often as later ones look at the tokens.
    """
    steps = [(get_module({"wapiti": "label"}.get(a := o.get("annotator", "lexicon"), a)), {k: v for k, v in o.items() if k != "annotator"}) if f is annotate else (f, o) for f, o in steps]
    if c.tokens is not None or len(steps) < 2 or steps[0][0] is not segmentation or steps[-1][0] is not export:
        return None
    (_, first), *middle, (_, last) = steps
    own, todo = {"doc_id", "par", "sent", "pos", "tok", "lb", "ub", "word"}, []
    fields: set[str] = set()
    for f, o in middle:
        name = o.get("field", "ner")
        if f is lexicon and isinstance(o.get("lexicon"), DataFrame) and o.get("token", "word") == "word" and name not in own | fields:
            rows = _entries(o["lexicon"]).select("key", "n", F.col("mapped").cast("string")).limit(by_document.ENTRIES + 1).collect()
            if len(rows) > by_document.ENTRIES:
                return None
            todo.append(by_document.lexicon(by_document.indexed([tuple(r) for r in rows]), name))
            fields.add(name)
        elif f is label_consistency and name in fields:
            todo.append(by_document.label_consistency(name, o.get("label_consistency", "overriding") != "non-overriding"))
        else:
            return None
    layers = {"ner": last.get("ner", "ner"), "chunk": last.get("chunking", ""), "pos": last.get("pos", "")}
    layers = {k: v for k, v in layers.items() if v in own | fields}
    if "pos" in layers or not fields.issuperset(layers.values()):
        return None
    tokeniser = first.get("tokeniser", "default")
    return by_document.exported(c.documents, tokeniser, VARIANTS.get(tokeniser, "default"), truth(first.get("html", False)), todo, layers, last.get("format", "json"))


@dataclass
class Pipeline:
    """Steps (module name, options, mode); a step runs if its mode is `all` or the pipeline's."""

    steps: list[tuple[str, dict, str]] = field(default_factory=list)
    mode: str = "all"

    def append(self, name: str, mode: str = "all", **options) -> Pipeline:
        get_module(name)
        self.steps.append((name, options, mode))
        return self

    def remove(self, name: str) -> Pipeline:
        self.steps = [s for s in self.steps if s[0] != name]
        return self

    def __iter__(self):
        return iter(self.steps)

    def __call__(self, c: Corpus):
        steps = [(get_module(name), options) for name, options, mode in self.steps if mode == "all" or self.mode in ("all", mode)]
        if (whole := _in_one_pass(c, steps)) is not None:
            return whole
        for f, options in steps:
            c = f(c, **options)
        return c


def load_master(path: str, mode: str = "all") -> tuple[Pipeline, dict]:
    """(pipeline, options) of a master file; paths in it are relative to its folder."""
    root = ET.parse(path).getroot()
    base = os.path.dirname(path) or "."
    options: dict[str, dict] = {x.tag: dict(x.attrib) for x in root.find("options")} if root.find("options") is not None else {}
    p = Pipeline(mode=mode)
    for x in root.find("pipeline"):
        attrs = {k: (os.path.join(base, v) if k in ("path", "model", "config", "information") and not os.path.isabs(v) else v) for k, v in x.attrib.items()}
        if "config" in attrs:
            attrs.setdefault("path", attrs.pop("config"))
        m = attrs.pop("mode", "all")
        p.append(x.tag, m, **attrs)
    if "export" in options and all(s[0] != "export" for s in p.steps):
        p.append("export", **{k: v for k, v in options["export"].items() if k in ("format", "ner", "pos", "chunking")})
    return p, options
