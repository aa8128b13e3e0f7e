"""Modules that work on tables outside a corpus' pipeline: evaluation from files, lexica to entries and back, filters by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dictionary, evaluate, spans
from ..sources import readers

#: Tags of a file format as (doc_id, lb, ub, value), by name; add to it to extend.
TAG_READERS: dict[str, Callable[..., DataFrame]] = {}


def tag_reader(name: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TAG_READERS[name] = f
        return f

    return add


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, raw) of text files, a document each, lines in their order."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)*$", 1).alias("doc_id"), F.split(F.regexp_replace("value", "\r\n", "\n"), "\n").alias("ls"))
    return files.select("doc_id", F.posexplode("ls").alias("line_no", "raw"))


@tag_reader("conll")
def conll_tags(spark: SparkSession, path: str, column: int = -1, fields: int = 2, **_) -> DataFrame:
    """Chunks of a column of CoNLL files, in tokens of the document."""
    names = [f"f{i}" for i in range(fields)]
    t = readers.conll_tokens(_lines(spark, path), names, names[0])
    chunks = spans.decode_chunks(t, names[column])
    first = t.select("doc_id", "sent", F.col("pos").alias("lb"), "tok")
    return chunks.join(first, ["doc_id", "sent", "lb"]).select("doc_id", F.col("tok").alias("lb"), (F.col("tok") + F.col("ub") - F.col("lb")).alias("ub"), "value")


@tag_reader("brat")
def brat_tags(spark: SparkSession, path: str, **_) -> DataFrame:
    return readers.brat_tags(_lines(spark, path).withColumnRenamed("raw", "line")).select("doc_id", "lb", "ub", "value")


def _layered_tags(reader: Callable[[DataFrame], DataFrame]):
    def read(spark: SparkSession, path: str, layer: str = "NER", **_) -> DataFrame:
        files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)*$", 1).alias("name"), F.col("value").alias("payload"))
        tags = readers.tag_rows(reader(files))
        return tags.where(F.lower("layer") == layer.lower()).select(F.col("name").alias("doc_id"), "lb", "ub", "value")

    return read


TAG_READERS |= {"xml": _layered_tags(readers.xml_documents), "json": _layered_tags(readers.json_documents), "gate": _layered_tags(readers.gate_documents)}


def evaluated(spark: SparkSession, gold: str, guess: str, fmt: str = "conll", guess_fmt: str | None = None, **options) -> DataFrame:
    """(entity, precision, recall, f, ...) of the tags in two folders of files; documents are told by their file's name without extensions."""
    for name in (fmt, guess_fmt or fmt):
        if name not in TAG_READERS:
            raise ValueError(f"no reader of tags {name!r}; there are {', '.join(sorted(TAG_READERS))}")
    pairs = evaluate.pairs(TAG_READERS[fmt](spark, gold, **options), TAG_READERS[guess_fmt or fmt](spark, guess, **options))
    return evaluate.metrics(evaluate.counts(pairs))


def compiled(entries: DataFrame, kind: str = "token", entry: str = "entry", nocase: bool = False) -> DataFrame:
    """A lexicon ready to be joined: (key, n), or (key, n, mapped) of `kind` map. Blank and repeated entries fall out."""
    keyed = dictionary.keyed(entries.select(F.col(entry).alias("entry"), *(["mapped"] if kind == "map" else [])), nocase=nocase)
    if kind == "map":
        return keyed.groupBy("key", "n").agg(F.min(F.coalesce("mapped", F.lit(""))).alias("mapped"))
    if kind not in ("token", "multiword"):
        raise ValueError(f"no kind of lexicon {kind!r}; there are map, multiword, token")
    return keyed.select("key", "n").distinct()


def decompiled(lexicon: DataFrame) -> DataFrame:
    """(entry) or (entry, mapped): the entries of a compiled lexicon, words one space apart."""
    return lexicon.select(F.replace("key", F.lit(dictionary.SEP), F.lit(" ")).alias("entry"), *(["mapped"] if "mapped" in lexicon.columns else []))


#: Filters of documents and of tags by name: (documents, tags) to documents, tags to tags; add to them to extend.
DOCUMENT_FILTERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"all": lambda d, t: d, "with annotations": spans.with_annotations, "without annotations": lambda d, t: d.join(t.select("doc_id").distinct(), "doc_id", "left_anti")}
TAG_FILTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"all": lambda t: t, "top level": lambda t: spans.top_level(t, ["doc_id"]), "bottom level": lambda t: spans.bottom_level(t, ["doc_id"])}


def filter_named(table: dict[str, Callable], name: str) -> Callable:
    try:
        return table[name]
    except KeyError:
        raise ValueError(f"no filter {name!r}; there are {', '.join(sorted(table))}") from None
