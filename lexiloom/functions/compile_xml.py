"""Feature descriptions in XML compiled to columns over the token table.

Compilation happens on the driver; the result is a list of steps. Steps that are
plain expressions are put into one select per dependency level; sequence
features (multiword dictionaries, directories, rules) are operators of their own.
"""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dictionary, rules
from . import features as X

TRAIN, LABEL = {"train", "eval", "evaluate", "evaluation"}, {"label", "annotate", "annotation"}


def mode_of(text: str | None) -> str:
    t = (text or "label").lower()
    if t in TRAIN:
        return "train"
    if t in LABEL:
        return "label"
    raise ValueError(f"no such mode: {text!r}")


@dataclass
class Compiled:
    """A feature: its kind (boolean, string or sequence), and how it is got."""

    kind: str
    column: Callable[[Column], Column] | None = None  # of the entry's column
    apply: Callable[[DataFrame, str], DataFrame] | None = None  # sequence features: adds a B/I/O column
    entry: str = "word"
    helpers: list[Compiled] = field(default_factory=list)


class Compiler:
    """Compiles feature elements for given columns; `base` is the folder that paths are relative to."""

    def __init__(self, spark: SparkSession, entries: list[str], base: str = ".", train_only: frozenset[str] = frozenset()):
        self.spark, self.entries, self.base, self.train_only = spark, list(entries), base, train_only
        self.default = "word" if "word" in entries else entries[0]
        self.tags: dict[str, Callable] = {n[4:]: getattr(self, n) for n in dir(self) if n.startswith("tag_")}

    def check_entry(self, name: str) -> str:
        if name not in self.entries or name in self.train_only:
            raise ValueError(f"column {name!r} isn't there" + (" outside training" if name in self.train_only else ""))
        return name

    def parse(self, e: ET.Element) -> Compiled:
        if e.tag not in self.tags:
            raise ValueError(f"no such feature: {e.tag}")
        got = self.tags[e.tag](e)
        shifted = "shift" in e.attrib or "x" in e.attrib
        if got.column is None and shifted:
            raise ValueError(f"{e.tag} {e.get('action', '')}: labels of whole sentences can't be shifted")
        return self._moved(e, got) if got.column is not None and (shifted or "entry" in e.attrib) else got

    def _moved(self, e: ET.Element, c: Compiled) -> Compiled:
        """The feature of another column, or of the token some places on."""
        name = self.check_entry(e.get("entry", self.default))
        shift = int(e.get("shift", e.get("x", "0")))
        inner = c.column

        def column(_: Column) -> Column:
            return inner(X.shifted(F.col(name), shift, X.sentence_window()) if shift else F.col(name))

        return Compiled(c.kind, column, c.apply, name, c.helpers)

    def of(self, c: Compiled) -> Column:
        return c.column(F.col(c.entry if c.entry in self.entries else self.default))

    def _children(self, e: ET.Element, kind: str | None = None, n: int | None = None) -> list[Compiled]:
        out = [self.parse(x) for x in e]
        if n is not None and len(out) != n:
            raise ValueError(f"{e.tag} {e.get('action', '')}: {n} parts, not {len(out)}")
        if kind and any(c.kind != kind for c in out):
            raise ValueError(f"{e.tag} {e.get('action', '')}: parts must be {kind}")
        return out

    def _action(self, e: ET.Element, *known: str, exact: bool = False) -> str:
        a = e.get("action", "")
        a = a if exact else a.lower()
        if a not in known:
            raise ValueError(f"{e.tag}: no action {a!r}")
        return a

    # --- one method a tag ---

    def tag_boolean(self, e):
        a = self._action(e, "and", "or", "not", exact=True)
        cs = self._children(e, "boolean", 1 if a == "not" else 2)
        f = {"and": X.both, "or": X.either, "not": X.negated}[a]
        return Compiled("boolean", lambda c: f(*[x.column(c) for x in cs]))

    def tag_list(self, e):
        f = {"some": X.some, "all": X.every, "none": X.none}[self._action(e, "some", "all", "none")]
        cs = self._children(e, "boolean")
        return Compiled("boolean", lambda c: f(*[x.column(c) for x in cs]))

    def tag_nullary(self, e):
        a = self._action(e, "bos", "eos", "lower", "substring")
        if a == "bos":
            return Compiled("boolean", lambda c: X.bos(F.col("pos")))
        if a == "eos":
            return Compiled("boolean", lambda c: X.eos(X.sentence_window()))
        if a == "lower":
            return Compiled("string", X.lower)
        lo, hi = int(e.get("from_index", e.get("from", "0"))), e.get("to_index", e.get("to"))
        hi = 2**31 - 1 if hi is None or "to_index" not in e.attrib and hi == "0" else int(hi)
        return Compiled("string", lambda c: X.sliced(c, lo, hi, e.get("default", X.EMPTY)))

    def tag_unary(self, e):
        self._action(e, "isupper")
        return Compiled("boolean", lambda c: X.is_upper(c, int(e.text.strip())))

    def tag_binary(self, e):
        self._action(e, "substitute")
        p, r = e.findtext("pattern"), e.findtext("replace", e.findtext("replacement", ""))
        return Compiled("string", lambda c: X.substitute(c, p, r or ""))

    def tag_nary(self, e):
        self._action(e, "sequencer")
        cs = self._children(e)
        if not cs:
            raise ValueError("sequencer: no parts")
        return Compiled(cs[-1].kind, lambda c: X.sequence(c, *[x.column for x in cs]))

    def tag_regexp(self, e):
        a = self._action(e, "check", "subsequence", "token")
        nocase = e.get("casing", "s").lower() in ("i", "insensitive")
        p, default = e.text or "", e.get("default", X.MISSING)
        if a == "check":
            return Compiled("boolean", lambda c: X.matches(c, p, nocase))
        f = X.matched_part if a == "subsequence" else X.matched_token
        return Compiled("string", lambda c: f(c, p, default, nocase))

    def tag_string(self, e):
        self._action(e, "equal")
        nocase = e.get("casing", "s").lower() in ("i", "insensitive")
        return Compiled("boolean", lambda c: X.equals(c, e.text or "", nocase))

    def tag_find(self, e):
        f = X.find_forward if self._action(e, "forward", "backward") == "forward" else X.find_backward
        (m,) = self._children(e, "boolean", 1)
        ret = self.check_entry(e.get("return_entry", self.default))
        return Compiled("string", lambda c: f(m.column(c), F.col(ret), X.sentence_window()))

    def _lines(self, e: ET.Element) -> list[str]:
        if e.get("path"):
            with open(os.path.join(self.base, e.get("path")), encoding="utf-8") as f:
                text = f.read()
        else:
            text = e.text or ""
        return [x.rstrip("\n") for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]

    def tag_dictionary(self, e):
        a = self._action(e, "token", "multiword", "map")
        entry = self.check_entry(e.get("entry", self.default))
        rows = self._lines(e)
        if a == "map":
            pairs = dict((x.split("\t") + [""])[:2] for x in rows)
            names = [v for kv in pairs.items() for v in kv]
            m = F.create_map(*[F.lit(x) for x in names]) if len(pairs) <= 200 else None
            default = e.get("default", X.UNMATCHED)
            if m is not None:
                return Compiled("string", lambda c: F.coalesce(F.try_element_at(m, c), F.lit(default)), entry=entry)
            table = self.spark.createDataFrame([(k, v) for k, v in pairs.items()], "entry string, mapped string")
            return Compiled("string", None, lambda df, out: dictionary.mapped(df, table, out, entry, default=default), entry)
        if a == "token":
            words = sorted({x.strip() for x in rows})
            if len(words) <= 200:
                return Compiled("boolean", lambda c: F.coalesce(c.isin(words), F.lit(False)), entry=entry)
            table = self.spark.createDataFrame([(x,) for x in words], "entry string")
            return Compiled("boolean", None, lambda df, out: dictionary.token_flag(df, table, out, entry), entry)
        table = dictionary.compiled(self.spark.createDataFrame([(x,) for x in rows], "value string"))
        return Compiled("sequence", None, lambda df, out: dictionary.multiword(df, table, out, e.get("appendice", ""), entry), entry)

    def tag_directory(self, e):
        folder = os.path.join(self.base, e.get("path"))
        order = os.path.join(folder, e.get("order", ".order"))
        names = [n for n in sorted(os.listdir(folder)) if not n.startswith(".")]
        if os.path.exists(order):
            with open(order, encoding="utf-8") as f:
                first = [x.strip() for x in f if x.strip()]
            names = [n for n in first if n in names] + [n for n in names if n not in first]
        rows = []
        for i, n in enumerate(names):
            root = ET.parse(os.path.join(folder, n)).getroot()
            if root.tag == "dictionary":
                rows += [(n, i, x.strip()) for x in self._lines(root)]
        lex = dictionary.keyed(self.spark.createDataFrame(rows, "dict string, priority int, entry string"))
        entry = self.check_entry(e.get("entry", self.default))
        ambiguous = e.get("ambiguous", "").lower() in ("true", "yes", "1")

        def apply(df: DataFrame, out: str) -> DataFrame:
            from ..operators.spans import encode_chunks

            return encode_chunks(df, dictionary.directory(df, lex, entry, nocase=False, ambiguous=ambiguous), out)

        return Compiled("sequence", None, apply, entry)

    def tag_fill(self, e):
        (cond,) = self._children(e, "boolean", 1)
        a, b = self.check_entry(e.get("entry", self.default)), self.check_entry(e.get("filler-entry"))
        return Compiled("string", lambda c: X.filled(cond.column(F.col(a)), F.col(a), F.col(b)))

    def tag_trigger(self, e):
        t, op = self._children(e, None, 2)
        if op.kind == "boolean":
            return Compiled("boolean", lambda c: X.both(t.column(c), op.column(c)))
        return Compiled("string", lambda c: X.triggered(t.column(c), op.column(c), e.get("default", X.UNTRIGGERED)))

    def tag_rule(self, e):
        names: dict[str, Column] = {}
        sequences: list[tuple[str, Compiled]] = []

        def steps(el: ET.Element) -> tuple[rules.Step, ...]:
            out = []
            for x in el:
                card = x.get("card", "1")
                rules.cardinality(card)
                if x.tag == "orrule":
                    out.append(rules.Step(card=card, either=tuple(steps(y) if y.tag == "rule" else (one(y),) for y in x)))
                else:
                    out.append(one(x, card))
            return tuple(out)

        def one(x: ET.Element, card: str = "1") -> rules.Step:
            c = self.parse(x)
            name = f"_p{len(names) + len(sequences)}"
            if c.kind == "sequence":
                sequences.append((name, c))
            else:
                names[name] = self.of(c)
            return rules.Step(name, card)

        got = steps(e)
        label = e.get("name", "rule")

        def apply(df: DataFrame, out: str) -> DataFrame:
            predicates = dict(names)
            for name, c in sequences:
                # how many tokens the sequence feature takes from a token on
                df = c.apply(df, name + "_bio")
                w = X.sentence_window()
                run = F.coalesce(F.first(F.when(~F.col(name + "_bio").startswith("I"), F.col("pos")), ignorenulls=True).over(w.rowsBetween(1, 2**31 - 1)), F.max("pos").over(w.rowsBetween(0, 2**31 - 1)) + 1)
                df = df.withColumn(name, F.when(F.col(name + "_bio").startswith("B"), run - F.col("pos")).otherwise(0))
                predicates[name] = F.col(name)
            return rules.rule(df, got, predicates, label, out).drop(*[n + s for n, _ in sequences for s in ("", "_bio")])

        return Compiled("sequence", None, apply)

    def tag_orrule(self, e):
        whole = ET.Element("rule", {"name": e.get("name", "rule")})
        whole.append(e)
        return self.tag_rule(whole)


@dataclass
class Enrichment:
    """A feature file: which columns must be there, and the features in order."""

    before: list[tuple[str, str]]
    after: list[tuple[str, str]]
    elements: list[ET.Element]
    base: str

    def visible(self, mode: str = "label") -> list[str]:
        ok = lambda m: m == "label" or mode == "train"
        return [n for n, m in self.before if ok(m)] + [e.get("name") for e in self.elements if e.get("display", "yes").lower() != "no"] + [n for n, m in self.after if ok(m)]


def read_enrichment(source: str) -> Enrichment:
    """An enrichment from a path or from XML text."""
    text_given = source.lstrip().startswith("<")
    root = ET.fromstring(source) if text_given else ET.parse(source).getroot()
    parts = [x.tag for x in root]
    if sorted(parts) != ["entries", "features"]:
        raise ValueError(f"an enrichment holds entries and features, not {parts}")
    ent = root.find("entries")
    read = lambda tag: [(x.get("name"), mode_of(x.get("mode"))) for part in ent.findall(tag) for x in part]
    elements = list(root.find("features"))
    names = [n for n, _ in read("before")] + [e.get("name") for e in elements] + [n for n, _ in read("after")]
    if None in names:
        raise ValueError("every feature has a name")
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"names used twice: {', '.join(sorted(twice))}")
    return Enrichment(read("before"), read("after"), elements, "." if text_given else os.path.dirname(source) or ".")


def enrich(tokens: DataFrame, source: str | Enrichment, mode: str = "label") -> DataFrame:
    """`tokens` with every feature of an enrichment; later features see earlier ones, hidden ones too."""
    e = source if isinstance(source, Enrichment) else read_enrichment(source)
    mode = mode_of(mode)
    wanted = [n for n, m in e.before + e.after if m == "label" or mode == "train"]
    missing = [n for n in wanted if n not in tokens.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    df, batch, names = tokens, {}, list(wanted)
    made: set[str] = set()
    train_only = frozenset(n for n, m in e.before + e.after if m == "train") if mode != "train" else frozenset()

    def flush() -> None:
        nonlocal df, batch
        if batch:
            df, batch = df.withColumns(batch), {}

    for el in e.elements:
        name = el.get("name")
        used = {x.get(a) for x in el.iter() for a in ("entry", "return_entry", "filler-entry")}
        c = Compiler(tokens.sparkSession, names, e.base, train_only)
        got = c.parse(el)
        if got.apply is not None or used & (made & set(batch)):
            flush()
        if got.apply is not None:
            df = got.apply(df, name)
            df = df.withColumn(name, X.materialised(F.col(name), got.kind))
        else:
            batch[name] = X.materialised(c.of(got), got.kind)
        made.add(name)
        names.append(name)
    flush()
    return df


def visible(df: DataFrame, e: Enrichment, mode: str = "label") -> DataFrame:
    keys = [c for c in ("doc_id", "sent", "pos", "tok") if c in df.columns]
    return df.select(*keys, *[c for c in e.visible(mode_of(mode)) if c not in keys])
