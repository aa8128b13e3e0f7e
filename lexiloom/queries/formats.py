"""Queries of readers, exporters, enrichment, pipelines and streams."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import compile_xml
from ..operators import spans
from ..plans.pipeline import Corpus, Pipeline
from ..runtime import latest, shared_dir, table
from ..sources import readers, sinks
from ..streaming import stream
from .ops import D, T, A, W, _ISLANDS, annotations, documents, documents_spread, tokens

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"with {D} select doc_id, replace(content, chr(13), '') as payload from d")
def read_text(spark, d):
    return readers.text_documents(documents(spark, d).select("doc_id", F.col("content").alias("payload")))


@query(f"with {D}, r as (select *, row_number() over (partition by name order by loaded_at, doc_id) as r from d) select doc_id, name from r where name is null or r = 1")
def read_distinct_names(spark, d):
    return readers.distinct_by_name(documents(spark, d), "name", ["loaded_at", "doc_id"]).select("doc_id", "name")


_LINES = """o as (select * from conll_lines qualify row_number() over (partition by file, line_no order by received_at desc nulls last, line_id desc, raw desc nulls last) = 1), l as (select line_id, file as doc_id, line_no, raw from o where not starts_with(raw, '#')),
s as (select *, sum(cast(trim(raw) = '' as int)) over (partition by doc_id order by line_no, line_id) as g from l),
c as (select doc_id, line_no, line_id, g, string_split(raw, chr(9)) as f from s where trim(raw) <> ''),
p as (select *, cast(dense_rank() over (partition by doc_id order by g) - 1 as integer) as sent, f[3] as word, f[6] as ner, length(coalesce(f[3], '')) as n from c)"""


@query(f"""with {_LINES} select doc_id, sent, cast(row_number() over (partition by doc_id, sent order by line_no, line_id) - 1 as integer) as pos, cast(row_number() over (partition by doc_id order by line_no, line_id) - 1 as integer) as tok,
cast(sum(n + 1) over (partition by doc_id order by line_no, line_id) - n - 1 as integer) as lb, cast(sum(n + 1) over (partition by doc_id order by line_no, line_id) - 1 as integer) as ub, word, ner from p""")
def read_conll(spark, d):
    last = latest(table(spark, d, "conll_lines"), ["file", "line_no"], "received_at", ["file", "line_no", "line_id", "raw"])
    lines = last.where("not startswith(raw, '#')").select(F.col("file").alias("doc_id"), F.struct("line_no", "line_id").alias("line_no"), "raw")
    return readers.conll_tokens(lines, ["f1", "f2", "word", "f4", "f5", "ner"], "word").drop("f1", "f2", "f4", "f5")


@query(f"""with {T}, s as (select doc_id, sent, string_agg(coalesce(word, ''), ' ' order by pos) as line from t group by all)
select doc_id, string_agg(line, chr(10) order by sent) as content from s group by doc_id""")
def conll_rebuild(spark, d):
    return readers.conll_content(tokens(spark, d))


def _char_tags(spark, d):
    a = annotations(spark, d).where("reference = 'tokens' and value is not null").select("doc_id", "lb", "ub", "value").distinct()
    return spans.to_characters(a, tokens(spark, d)).select("doc_id", F.col("clb").alias("lb"), F.col("cub").alias("ub"), "value")


_CHARS = """ch as (select distinct a.doc_id, b.lb, e.ub, a.value from a join t b on b.doc_id = a.doc_id and b.tok = a.lb join t e on e.doc_id = a.doc_id and e.tok + 1 = a.ub where a.reference = 'tokens' and a.value is not null)"""
_BRAT = f"""br as (select ch.doc_id, row_number() over (partition by ch.doc_id order by ch.lb, ch.ub desc, value) as n, value, ch.lb, ch.ub, replace(substring(content, ch.lb + 1, ch.ub - ch.lb), chr(10), ' ') as text from ch join d using (doc_id) where content is not null)"""


@query(f"with {T}, {D}, {A}, {_CHARS}, {_BRAT} select doc_id, string_agg('T' || n || chr(9) || value || ' ' || lb || ' ' || ub || chr(9) || text, chr(10) order by n) as payload from br group by doc_id")
def export_brat(spark, d):
    return sinks.brat(_char_tags(spark, d), documents(spark, d).where("content is not null"))


@query(f"with {T}, {D}, {A}, {_CHARS}, {_BRAT} select doc_id, 'T' || n as id, value, lb, ub, text from br")
def read_brat(spark, d):
    return readers.brat_tags(export_brat(spark, d).select("doc_id", F.explode(F.split("payload", "\n")).alias("line")))


@query(f"""with {T}, s as (select doc_id, sent, string_agg(coalesce(word, '') || chr(9) || coalesce(pos_tag, '') || chr(9) || coalesce(chunk, '') || chr(9) || coalesce(ner, ''), chr(10) order by pos) as block from t group by all)
select doc_id, string_agg(block, chr(10) || chr(10) order by sent) as payload from s group by doc_id""")
def export_conll(spark, d):
    return sinks.conll(tokens(spark, d), ["word", "pos_tag", "chunk", "ner"])


_LAYERS = {"ner": ("ner", "chunk"), "chunk": ("chunk", "chunk"), "pos": ("pos_tag", "pos")}


def _exported(spark: SparkSession, d: str, fmt: str):
    rows = sinks.loaded(table(spark, d, "sem_documents"), table(spark, d, "sem_tokens"), _LAYERS, "loaded_at")
    return sinks.export_loaded(rows, _LAYERS, fmt, "loaded_at", "inner")


def _export(fmt: str):
    def f(spark: SparkSession, d: str):
        return _exported(spark, d, fmt)

    f.__name__ = f"export_{fmt}"
    return f


for _fmt in sinks.EXPORTERS:
    QUERIES[f"export_{_fmt}"] = _export(_fmt)


def _back(fmt: str, reader):
    """All tags of all layers, and the spans of tokens, as a reader gives them back from an exported document."""

    def f(spark: SparkSession, d: str):
        docs = _exported(spark, d, fmt).select(F.col("doc_id").cast("string").alias("name"), "payload")
        layered = reader(docs)
        return readers.layer_rows(layered).withColumns({c: F.col(c).cast("bigint") for c in ("lb", "ub")})

    f.__name__ = f"read_{fmt}"
    return f


def _char(select_from: str) -> str:
    return f"select cast(x.doc_id as varchar) as name, b.lb, e.ub, x.value, x.layer from ({select_from}) x join t b on b.doc_id = x.doc_id and b.sent = x.sent and b.pos = x.lb join t e on e.doc_id = x.doc_id and e.sent = x.sent and e.pos + 1 = x.ub where x.doc_id in (select doc_id from d)"


_CHUNKED = _ISLANDS.replace("ner", "chunk").replace("chunks as", "h5 as").replace("k3", "h3").replace("k2", "h2").replace("k as (", "h1 as (").replace("from k ", "from h1 ").replace("\nc as (", "\nh4 as (").replace("from c where", "from h4 where")
_POSES = f"""z1 as (select *, case when pos_tag is null then null else cast(not starts_with(pos_tag, '_') as int) end as fresh from t where pos_tag is not null), z2 as (select *, sum(fresh) over w as g from z1 {W}),
z3 as (select doc_id, sent, min(pos) as lb, max(pos) + 1 as ub, arg_max(ltrim(pos_tag, '_'), pos) as value from z2 group by doc_id, sent, g)"""
_ALL = f"""with {T}, {D}, {_ISLANDS}, {_CHUNKED}, {_POSES}, y as ({_char("select doc_id, sent, lb, ub, value, 'ner' as layer from chunks union all select doc_id, sent, lb, ub, value, 'chunk' from h5 union all select doc_id, sent, lb, ub, value, 'pos' from z3")}),
hold as (select doc_id, content from d where doc_id in (select doc_id from t))"""
_TOKENS = "select cast(t.doc_id as varchar) as name, 'tokens' as layer, null as value, cast(lb as bigint) as lb, cast(ub as bigint) as ub from t where doc_id in (select doc_id from d)"
_WHOLE = "select cast(hold.doc_id as varchar), 'content', null, 0, cast(coalesce(length(content), 0) as bigint) from hold"
for _fmt, _reader in (("json", readers.json_documents), ("xml", readers.xml_documents), ("gate", readers.gate_documents)):
    QUERIES[f"read_{_fmt}"] = _back(_fmt, _reader)
    _own = "select name, layer, value, cast(lb as bigint) as lb, cast(ub as bigint) as ub from y" + (" where layer = 'ner'" if _fmt == "gate" else "")
    _sql = f"{_ALL} {_own}" + ("" if _fmt == "gate" else f" union all {_TOKENS}") + f" union all {_WHOLE}"
    if _fmt != "gate":  # these formats hold the document's own name
        for _x in ("x.", "t.", "hold."):
            _sql = _sql.replace(f"cast({_x}doc_id as varchar)", f"(select coalesce(d.name, cast(d.doc_id as varchar)) from d where d.doc_id = {_x}doc_id)")
    ORACLE[f"read_{_fmt}"] = _sql


@query("select distinct tag from sem_tag_map where tag is not null and tag <> ''")
def read_tagset(spark, d):
    lines = table(spark, d, "sem_tag_map").select(F.concat(F.lit("  "), "tag", F.lit(" # "), F.coalesce("mapped", F.lit(""))).alias("value"))
    return readers.tagset(lines.unionByName(spark.createDataFrame([("# only a comment",), ("  ",)], "value string")))


@query()
def read_page(spark, d):
    html = F.concat(F.lit("<html><p>"), F.coalesce("content", F.lit("")), F.lit("</p><p>a&nbsp;b &amp; c</p><h2>more</h2>x</html>"))
    return documents(spark, d).select("doc_id", html.alias("html")).select("doc_id", readers.page_text("html", news=True).alias("content"))


_FEATURES = """<information><entries><before><entry name="word"/></before><after><entry name="ner" mode="train"/></after></entries><features>
<nullary name="bos" action="BOS"/><nullary name="eos" action="eos"/><nullary name="lower" action="lower"/>
<nullary name="prev" action="lower" shift="-1"/>
<boolean name="capInside" action="and"><regexp action="check">^[A-Z]</regexp><boolean action="not"><nullary action="bos"/></boolean></boolean>
<nary name="shape" action="sequencer"><binary action="substitute"><pattern>[A-Z]</pattern><replace>A</replace></binary><binary action="substitute"><pattern>[a-z]</pattern><replace>a</replace></binary></nary>
<dictionary name="article" action="token">la
le
les</dictionary>
<regexp name="digits" action="subsequence">[0-9]+</regexp>
</features></information>"""


@query(f"""with {T} select doc_id, tok, cast(pos = 0 as int) as bos, cast(lead(pos) over w is null as int) as eos, coalesce(lower(word), '#') as lower, coalesce(lower(lag(word) over w), '#') as prev,
cast(coalesce(regexp_matches(word, '^[A-Z]'), false) and pos <> 0 as int) as "capInside", coalesce(regexp_replace(regexp_replace(word, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '#') as shape,
cast(coalesce(word in ('la', 'le', 'les'), false) as int) as article, case when coalesce(regexp_matches(word, '[0-9]+'), false) then regexp_extract(word, '[0-9]+', 0) else '#' end as digits from t {W}""")
def enrich_xml(spark, d):
    e = compile_xml.enrich(tokens(spark, d), _FEATURES)
    return e.select("doc_id", "tok", "bos", "eos", "lower", "prev", "capInside", "shape", "article", "digits")


@query()
def pipeline_run(spark, d):
    """Segmentation, lexicon and consistency, then text export."""
    lex = table(spark, d, "sem_lexicon").where("mapped is not null")
    p = Pipeline().append("segmentation", tokeniser="fr").append("lexicon", lexicon=lex, field="ner").append("label_consistency", field="ner").append("export", format="text")
    return p(Corpus(documents_spread(spark, d).where("content is not null").select("doc_id", "name", "content")))


@query(f"with {D}, {A} select doc_id, name from (select *, row_number() over (partition by name order by coalesce(length(content), 0) < 1000, doc_id) as r from d) where r = 1 and doc_id in (select doc_id from a)")
def corpora_combined(spark, d):
    """Two corpora, the longer documents first; of a name both have, the first corpus' document."""
    docs = documents(spark, d).select("doc_id", "name", (F.coalesce(F.length("content"), F.lit(0)) >= 1000).alias("long"))
    return sinks.combined(docs.where("long").drop("long"), docs.where("not long").drop("long"), with_tags=annotations(spark, d))


@query(f"with {D} select source, count(*) as documents, cast(sum(length(content)) as bigint) as characters from d group by source")
def stream_counts(spark, d):
    """Documents and characters per source, read as a stream of files through micro-batches; of a document sent twice the last counts."""
    import uuid

    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    src = stream.documents(spark, f"{d}/sem_documents.parquet*", table(spark, d, "sem_documents").schema)
    last = F.max(F.struct("loaded_at", "source", F.length("content").alias("n"))).alias("r")
    q = stream.run(src, lambda df: df.groupBy("doc_id").agg(last), f"{out}/rows", f"{out}/state")
    q.awaitTermination()
    once = spark.read.parquet(f"{out}/rows").groupBy("doc_id").agg(F.max("r").alias("r"))
    return once.groupBy("r.source").agg(F.count("*").alias("documents"), F.sum("r.n").alias("characters"))


@query("select source, cast(date_trunc('day', loaded_at) as timestamp) as day, count(*) as documents, cast(sum(length(content)) as bigint) as characters from sem_documents where loaded_at is not null group by all")
def stream_windows(spark, d):
    """Rows and characters per source and day of loading, by a windowed aggregation with a watermark over the stream; windows are written once they are closed."""
    import uuid

    out = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    src = stream.documents(spark, f"{d}/sem_documents.parquet*", table(spark, d, "sem_documents").schema)
    stream.aggregated(stream.counts(src.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))), f"{out}/rows", f"{out}/state").awaitTermination()
    last = spark.read.parquet(f"{out}/rows").groupBy("source", "window").agg(F.max(F.struct("epoch", "documents", "characters")).alias("r"))
    return last.select("source", F.col("window.start").cast("timestamp_ntz").alias("day"), "r.documents", "r.characters")
