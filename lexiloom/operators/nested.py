"""Nested annotation records turned into related flat tables (problem 3).

A bottom-up tree automaton classifies every JSON node: its state follows from its
own kind, the names of its members and the states of its children. The states
name the structural variants. Each variant is routed to a reader of its own that
fills a typed subtype table; the supertype tables (documents, layers, items) are
unions of those over the common keys, which are the places of the parents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KINDS = {"segmentations": "segmentation", "annotations": "annotation"}
_SCALARS = {int: "int", float: "number", str: "text", bool: "flag", type(None): "none"}
EXTENTS = ("extent_pair", "extent_object")
#: Item variants and the typed columns of their subtype tables beside the keys.
ITEMS = {"extent_pair": ("s", "l"), "extent_object": ("s", "l"), "tag": ("value", "s", "l"), "tag_fragmented": ("frag_idx", "value", "s", "l")}


def unwrapped(x):
    """A container that was itself written as JSON text, however often."""
    while isinstance(x, str):
        try:
            x = json.loads(x)
        except (ValueError, RecursionError):
            return None
    return x


def _join(states) -> str:
    return f"list({','.join(sorted(set(states)))})"


class Automaton:
    """The states of the nodes of one record, children before parents.

    extent_pair, extent_object: a place; tag, tag_fragmented: a value with one or
    several places; layer_spans(x), layer_tags(x): an object that holds items in
    state x; document(x,y): an object with segmentations in state x, annotations
    in state y; map(x) and list(x): what holds children in states x; else the
    JSON kind.
    """

    def __init__(self, root):
        self.states: dict[int, str] = {}
        work = [(root, "", False)]
        while work:
            v, role, below = work.pop()
            if not below and (inner := self._inner(v, role)):
                work.append((v, role, True))
                work += [(x, r, False) for x, r in inner]
            elif isinstance(v, (dict, list)):
                self.states[id(v)] = self._object(v, role) if isinstance(v, dict) else self._list(v)

    def of(self, v) -> str:
        return _SCALARS.get(type(v)) or self.states[id(v)]

    def _inner(self, v, role: str) -> list[tuple]:
        """The children that have children, with the role their place gives them; text that holds a container is replaced by it."""
        if isinstance(v, dict):
            for k, x in v.items():
                if isinstance(x, str) and (role == "container" or k in _KINDS or role == "layer" and k == "spans"):
                    v[k] = unwrapped(x)
            place = lambda k: "layer" if role == "container" else "items" if role == "layer" and k in ("spans", "annotations") else "container" if k in _KINDS else ""
            return [(x, place(k)) for k, x in v.items() if isinstance(x, (dict, list))]
        if not isinstance(v, list):
            return []
        if role == "container":
            v[:] = [unwrapped(x) if isinstance(x, str) else x for x in v]
        out, below = [], "layer" if role == "container" else ""
        for x in v:
            if isinstance(x, list):
                if len(x) == 2 and type(x[0]) is int and type(x[1]) is int:
                    self.states[id(x)] = "extent_pair"
                else:
                    out.append((x, below))
            elif isinstance(x, dict):
                if len(x) <= 3 and type(x.get("s")) is int and type(x.get("l")) is int and (len(x) == 2 or type(x.get("v")) is str):
                    self.states[id(x)] = "extent_object" if len(x) == 2 else "tag"
                else:
                    out.append((x, below))
        return out

    def _list(self, v: list) -> str:
        if len(v) == 2 and type(v[0]) is int and type(v[1]) is int:
            return "extent_pair"
        return _join(map(self.of, v))

    def _object(self, v: dict, role: str) -> str:
        if role == "container":
            return f"map({','.join(sorted({self.of(x) for x in v.values()}))})"
        if "fragments" in v:
            return "tag_fragmented" if self.of(v["fragments"]).startswith(("list", "extent_pair")) else "tag_broken"
        if "v" in v and ("s" in v or "l" in v):
            return "tag"
        if "s" in v and "l" in v:
            return "extent_object"
        if "spans" in v:
            return f"layer_spans({self.of(v['spans'])})"
        tags = self.of(v.get("annotations"))
        if "annotations" in v and "segmentations" not in v and "content" not in v and "layer_" not in tags and not tags.startswith("map"):
            return f"layer_tags({tags})"
        if "content" in v or "segmentations" in v or "annotations" in v:
            return f"document({self.of(v.get('segmentations'))},{tags})"
        return "object"


def documents_of(root, a: Automaton) -> Iterator[dict]:
    """The documents of a record in reading order, however they are wrapped."""
    work = [root]
    while work:
        x = work.pop()
        if isinstance(x, dict):
            inner = x.items()
            if a.of(x).startswith("document"):
                yield x
                inner = [(k, y) for k, y in inner if k not in (*_KINDS, "metadatas")]
            work.extend(y for _, y in reversed(list(inner)) if isinstance(y, (dict, list)))
        elif isinstance(x, list):
            work.extend(y for y in reversed(x) if isinstance(y, (dict, list)))


def _name_of(ref) -> str:
    if isinstance(ref, dict):
        ref = ref.get("name")
    return ref if isinstance(ref, str) else ""


def layers_of(container, a: Automaton) -> Iterator[tuple[str, str, list, str]]:
    """(name, reference, items, variant) of each layer of a document's container."""
    if isinstance(container, dict):
        pairs, by = container.items(), "map"
    elif isinstance(container, list):
        pairs, by = ((_name_of(x) if isinstance(x, dict) else "", x) for x in container), "list"
    else:
        return
    for name, layer in pairs:
        if isinstance(layer, list):  # the items without a wrapper
            yield name or "", "", layer, f"{by}/bare({a.of(layer)})"
        elif isinstance(layer, dict):
            items = layer.get("spans", layer.get("annotations"))
            ref = layer.get("reference")
            yield name or "", _name_of(ref), items if isinstance(items, list) else [], f"{by}/{a.of(layer)}/{_SCALARS.get(type(ref), 'object')}"


def _places(parts: list, a: Automaton) -> list[tuple]:
    """The extents of a fragmented tag, in order, those of tags in it too."""
    out: list[tuple] = []
    work = list(reversed(parts))
    while work:
        p = work.pop()
        kind = a.of(p)
        if kind == "extent_pair":
            out.append((p[0], p[1]))
        elif kind in ("extent_object", "tag"):
            out.append((p.get("s"), p.get("l")))
        elif kind == "tag_fragmented":
            work += reversed(p["fragments"])
    return out


def _text(x) -> str | None:
    return x if isinstance(x, str) else None


# The readers of the item variants: (place in the layer, the item) to rows of the subtype's columns.
def _read_pair(i: int, x: list, a: Automaton) -> Iterator[tuple]:
    yield i, 0, None, x[0], x[1]


def _read_object(i: int, x: dict, a: Automaton) -> Iterator[tuple]:
    yield i, 0, None, x["s"], x["l"]


def _read_tag(i: int, x: dict, a: Automaton) -> Iterator[tuple]:
    yield i, 0, _text(x["v"]), x.get("s"), x.get("l")


def _read_fragmented(i: int, x: dict, a: Automaton) -> Iterator[tuple]:
    value = _text(x.get("v"))
    parts = x["fragments"]
    for f, (s, n) in enumerate(_places([parts] if a.of(parts) == "extent_pair" else parts, a)):
        yield i, f, value, s, n


READERS = {"extent_pair": _read_pair, "extent_object": _read_object, "tag": _read_tag, "tag_fragmented": _read_fragmented}

_KEYS = ("record_id", "doc_idx", "kind", "layer", "reference", "item_idx")
_TABLES = {
    "document": ("record_id", "doc_idx", "name", "content", "variant"),
    "layer": ("record_id", "doc_idx", "kind", "layer", "reference", "items", "variant"),
    "item": (*_KEYS, "frag_idx", "variant", "value", "s", "l", "beyond"),
    **{v: (*_KEYS, *cols, "beyond") for v, cols in ITEMS.items()},
}
_TYPES = {"doc_idx": pa.int32(), "items": pa.int32(), "item_idx": pa.int32(), "frag_idx": pa.int32(), "s": pa.int64(), "l": pa.int64()}
_SQL = {pa.int32(): "int", pa.int64(): "bigint"}


class Routed:
    """The subtype tables of some records, column by column."""

    def __init__(self, ids: pa.DataType):
        self.ids, self.rows = ids, 0
        self.parts: dict[str, list[list]] = {}

    def layer(self, key: tuple, items: list, a: Automaton, wanted: tuple[str, ...]) -> None:
        """Routes the items of a layer to the tables of their variants."""
        kinds = [a.of(x) for x in items]
        for kind in wanted:
            read = READERS[kind]
            cols = self.parts.setdefault(kind, [[] for _ in range(10)])
            for row in (r for i, k in enumerate(kinds) if k == kind for r in read(i, items[i], a)):
                for c, x in zip(cols, (*key, *row), strict=True):
                    c.append(x)
                self.rows += 1

    def batches(self, which: str) -> Iterator[pa.RecordBatch]:
        for kind, cols in self.parts.items():
            if not cols[0]:
                continue
            named = dict(zip((*_KEYS, "frag_idx", "value", "s", "l"), cols, strict=True))
            beyond: list[str | None] = [None] * len(cols[0])
            for n in ("s", "l"):
                for q, x in enumerate(named[n]):
                    if type(x) is not int or not -(2**63) <= x < 2**63:
                        if type(x) is int:  # no column of 64 bits holds it
                            beyond[q] = json.dumps({**json.loads(beyond[q] or "{}"), n: x})
                        named[n][q] = None
            named |= {"beyond": beyond, "variant": [kind] * len(beyond)}
            yield _batch(which, named, self.ids)
        self.parts, self.rows = {}, 0


def _batch(which: str, cols: dict[str, list], ids: pa.DataType) -> pa.RecordBatch:
    names = _TABLES[which]
    return pa.RecordBatch.from_arrays([pa.array(cols[n], _TYPES.get(n, ids if n == "record_id" else pa.string())) for n in names], names=list(names))


def _shredder(which: str, id_type: str):
    wanted = tuple(ITEMS) if which == "item" else (which,) if which in ITEMS else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.schema.field(0).type
            routed, rows = Routed(ids), []
            for rid, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if payload is None:
                    continue
                try:
                    root = json.loads(payload)
                except (ValueError, RecursionError):
                    continue
                a = Automaton(root)
                for d, doc in enumerate(documents_of(root, a)):
                    if which == "document":
                        rows.append((rid, d, _text(doc.get("name")), _text(doc.get("content")), a.of(doc)))
                        continue
                    for key, kind in _KINDS.items():
                        for name, ref, items, variant in layers_of(doc.get(key), a):
                            if which == "layer":
                                rows.append((rid, d, kind, name, ref, len(items), variant))
                            else:
                                routed.layer((rid, d, kind, name, ref), items, a, wanted)
                if routed.rows >= 20_000:
                    yield from routed.batches(which)
            yield from routed.batches(which)
            if rows:
                yield _batch(which, dict(zip(_TABLES[which], zip(*rows, strict=True), strict=True)), ids)

    return run, ", ".join(f"{n} {id_type if n == 'record_id' else _SQL.get(_TYPES.get(n), 'string')}" for n in _TABLES[which])


def flatten(rows: DataFrame, which: str, id_col: str = "record_id", payload: str = "payload", order: str | None = None) -> DataFrame:
    """One of the flat tables of a table of JSON records, from one reading of each record.

    Supertypes: `document`, `layer`, `item`; subtypes of `item`, one for each
    structural variant, with their own columns: `extent_pair`, `extent_object`,
    `tag`, `tag_fragmented`. `item` is the union of them with the common keys and
    the variant. Keys: a document is (record_id, doc_idx), a layer adds (kind,
    layer), an item adds item_idx and, where a tag has several extents, frag_idx.
    Containers written as JSON text are read however often they are wrapped.
    Missing references are the empty string. A number that 64 bits don't hold is
    null, its digits are in the JSON object `beyond`. Records sent twice count
    once, the last by `order`. Null and unreadable payloads, empty lists and
    layers without items give no item rows; an item of unknown shape gives none
    but keeps its place. Records are independent, so nothing but the removal of
    repeats is shuffled.
    """
    picked = rows.select(F.col(id_col).alias("record_id"), F.col(payload).cast("string").alias("_p"), (F.col(order) if order else F.lit(0)).alias("_o"))
    once = picked.groupBy("record_id").agg(F.max(F.struct("_o", "_p")).alias("_r")).select("record_id", F.col("_r._p").alias("_p"))
    run, schema = _shredder(which, picked.schema["record_id"].dataType.simpleString())
    return once.mapInArrow(run, schema)
