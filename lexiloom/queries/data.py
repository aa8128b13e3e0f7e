"""Queries of the general training-data problems (3, 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import badrows, nested
from ..runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    items = nested.flatten(table(spark, d, "sem_json"), "item", order="received_at")
    return items.select("record_id", "doc_idx", "kind", "layer", "reference", "item_idx", "frag_idx")


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(table(spark, d, "sem_json"), "document", order="received_at")


def p3_layers(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(table(spark, d, "sem_json"), "layer", order="received_at")


def p3_fragments(spark: SparkSession, d: str) -> DataFrame:
    """The subtype table of tags with several extents."""
    return nested.flatten(table(spark, d, "sem_json"), "tag_fragmented", order="received_at")


def _tags(spark: SparkSession, d: str) -> list[str]:
    # the tag table is fixed: seven rows
    return [r["tag"] for r in table(spark, d, "sem_tag_map").select("tag").distinct().collect()]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return badrows.parse_lines(table(spark, d, "conll_lines"), "line_id", "raw", _tags(spark, d), "received_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where("reason is not null").select("line_id", "reason")


def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where("reason is null").drop("reason")


QUERIES = {f.__name__: f for f in (p3_found, p3_documents, p3_layers, p3_fragments, p6_found, p6_rows)}

# One field, the characters without ink, and a line taken apart; of a line sent twice the last counts.
_F = r'(?:"(?:[^"]|"")*"|[^"\t]*)'
_BLANK = r"[\s\p{Z}\p{Cc}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{2800}\x{3164}\x{FEFF}\x{FFA0}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}]*"
_GROUPS = "".join(f"{chr(92) + 't' if i else ''}({_F})" for i in range(6))
_PARTS = ", ".join(f"regexp_extract(raw, '^{_GROUPS}$', {i})" for i in range(1, 7))
_FIELDS = ", ".join(f"case when f[{i}][1:1] = '\"' then replace(f[{i}][2:-2], '\"\"', '\"') else f[{i}] end as f{i}" for i in range(1, 7))
_LINES = f"""l as (select line_id, arg_max(raw, received_at) as raw from conll_lines group by line_id), n as (select * from l where raw is null or (raw <> '' and not starts_with(raw, '#'))),
s as (select line_id, raw, regexp_full_match(raw, '{_F}(?:\t{_F})*') as sound, regexp_full_match(raw, '{_F}(?:\t{_F}){{5}}') as six, [{_PARTS}] as f from n),
v as (select line_id, raw, sound, six, {_FIELDS} from s),
d as (select *, six and regexp_full_match(f1, '[0-9]+') and regexp_full_match(f2, '[0-9]+') and regexp_full_match(f4, '[0-9]+') and regexp_full_match(f5, '[0-9]+') and not regexp_full_match(f3, '{_BLANK}')
  and (f6 = 'O' or (f6[1:2] in ('B-', 'I-') and f6[3:] in (select tag from sem_tag_map where tag is not null and tag <> ''))) as fair from v),
r as (select line_id, case when raw is null then 'columns' when not sound then 'quoting' when not six then 'columns' when not fair then 'value' when try_cast(f5 as hugeint) - try_cast(f4 as hugeint) <> length(f3) then 'value' end as reason, f1, f2, f3, f4, f5, f6 from d)"""

ORACLE: dict[str, str] = {
    "p6_found": f"with {_LINES} select line_id, reason from r where reason is not null",
    "p6_rows": f"with {_LINES} select line_id, cast(f1 as bigint) as sent, cast(f2 as bigint) as pos, f3 as word, cast(f4 as bigint) as lb, cast(f5 as bigint) as ub, f6 as ner, cast(null as varchar) as beyond from r where reason is null",
}
