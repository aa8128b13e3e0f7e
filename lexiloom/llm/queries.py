"""Queries of the text problems (1, 2, 4, 5, 7, 8, 9, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import frequency, langid, leakage, mojibake, normalize, packing, pii, sentences


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    words = normalize.variant_words(table(spark, d, "sem_tokens"), order="loaded_at").selectExpr("'word' as unit", "doc_id as key_a", "cast(tok as bigint) as key_b")
    return words.unionByName(normalize.look_pairs(table(spark, d, "sem_documents")).select(F.lit("content").alias("unit"), "key_a", "key_b"))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "sem_tokens").select("word").where("word is not null").distinct()
    return normalize.normalized(words, "word", "form").groupBy("form").agg(F.count("*").alias("spellings"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return normalize.look_classes(table(spark, d, "sem_documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    samples = mojibake.samples_of(table(spark, d, "lang_samples"))
    return sentences.sentence_units(table(spark, d, "sem_documents"), order="loaded_at", only=table(spark, d, "sem_segmentations"), samples=samples)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequency(table(spark, d, "sem_tokens"), "doc_id", "tok", "word", "loaded_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").selectExpr("term as word", "mark")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).selectExpr("term as word", "occurrences", "documents", "coalesce(mark, '') as mark")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    samples = langid.samples_of(table(spark, d, "lang_samples"))
    return langid.segments(table(spark, d, "sem_documents"), samples, order="loaded_at").where("l > 0")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(_segments(spark, d)).select("doc_id", "s", "lang")


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("doc_id", "s", "l", "lang", F.round("confidence", 6).alias("confidence"))


def _restored(spark: SparkSession, d: str) -> DataFrame:
    samples = mojibake.samples_of(table(spark, d, "lang_samples"))
    return mojibake.restored(table(spark, d, "sem_documents"), samples, order="loaded_at")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d).where("garbled").select("doc_id")


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d).where("garbled").select("doc_id", "restored")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).withColumns({c: F.round(c, 6) for c in ("question", "answer")})


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.places(table(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_canonical, p1_classes, p2_found, p4_found, p4_counts, p5_found, p5_segments, p7_found, p7_restored, p8_containers, p9_found, p9_overlap, p10_found, p10_redacted)}
_P4 = """
select word, count(*) as occurrences, count(distinct doc_id) as documents,
  case when count(distinct doc_id) < 3 then 'rare'
       when count(distinct doc_id) * 5 > (select count(distinct doc_id) from sem_tokens) then 'common' else '' end as mark
from (select distinct doc_id, tok, word from sem_tokens) where word is not null group by word"""

_WS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_RUNS = "select distinct {0}, array_to_string(ws[i:i + 11], ' ') as run from (select {0}, ws, unnest(range(1, len(ws) - 10)) as i from (select {0}, " + _WS.replace("{", "{{").replace("}", "}}") + " as ws from {1} where text is not null) where len(ws) >= 12)"

ORACLE: dict[str, str] = {
    "p9_found": f"select distinct doc_id, item_id from ({_RUNS.format('doc_id', 'documents')}) join ({_RUNS.format('item_id', 'eval_items')}) using (run)",
    "p4_counts": _P4,
    "p4_found": f"select word, mark from ({_P4}) where mark <> ''",
}
