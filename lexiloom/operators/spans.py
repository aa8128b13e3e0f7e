"""Tags over tokens and characters: schemes, alignment, levels, filters.

Token tags live in tables (doc_id, sent, lb, ub, value) with positions in the
sentence, layers in tables (doc_id, ..., lb, ub, value) with whatever unit the
layer counts in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def decode_chunks(tokens: DataFrame, col: str) -> DataFrame:
    """(doc_id, sent, lb, ub, value): chunks of a BIO, BILOU or BIOES column.

    B, U and S begin a chunk, I, L and E continue the open one whatever their
    label, everything else ends it. A continuation with nothing open is dropped.
    Gaps and islands: a running count of beginnings over the sentence window.
    """
    w = Window.partitionBy("doc_id", "sent").orderBy("pos")
    flag = F.coalesce(F.substring(F.col(col), 1, 1), F.lit("O"))
    shaped = F.coalesce(F.col(col).rlike("^[BIULSE]-"), F.lit(False))
    kind = F.when(shaped & flag.isin("B", "U", "S"), "b").when(shaped & flag.isin("I", "L", "E"), "i").otherwise("o")
    single = shaped & flag.isin("U", "S", "L", "E")
    t = tokens.select("doc_id", "sent", "pos", kind.alias("_k"), single.alias("_last"), F.expr(f"substring({col}, 3)").alias("value"))
    # a chunk is closed by a single, a last or an outside token before this one
    shut = F.coalesce(F.lag(F.col("_last") | (F.col("_k") == "o")).over(w), F.lit(True))
    t = t.withColumn("_new", (F.col("_k") != "i") | shut)
    t = t.withColumn("_g", F.sum(F.col("_new").cast("int")).over(w))
    g = t.groupBy("doc_id", "sent", "_g").agg(F.min("pos").alias("lb"), (F.max("pos") + 1).alias("ub"), F.min_by("value", "pos").alias("value"), F.min_by("_k", "pos").alias("_first"))
    return g.where("_first = 'b'").select("doc_id", "sent", "lb", "ub", "value")


def tags_at_ends(tokens: DataFrame, layers: dict[str, tuple[str, str]]) -> DataFrame:
    """`tokens` with a column for each layer: at the last token of a tag, the tag (value, lb, ub, tlb, tub); elsewhere null.

    `layers`: by name the token column and its kind, `chunk` as for
    `decode_chunks` or `pos` as for `decode_pos`; places are in characters and in
    document tokens. All layers share one window over (document, sentence): each
    token knows the beginning of the tag it is in, so nothing is joined.
    """
    w = Window.partitionBy("doc_id", "sent").orderBy("pos")
    over = "over (partition by doc_id, sent order by pos)"
    first, second, third = {}, {}, {}
    for name, (col, kind) in layers.items():
        if kind == "chunk":
            flag = F.coalesce(F.substring(F.col(col), 1, 1), F.lit("O"))
            shaped = F.coalesce(F.col(col).rlike("^[BIULSE]-"), F.lit(False))
            inside = shaped & flag.isin("I", "L", "E")
            shut = F.coalesce(F.lag((shaped & flag.isin("U", "S", "L", "E")) | ~shaped).over(w), F.lit(True))
            first[f"_{name}_new"] = ~inside | shut
            first[f"_{name}_in"] = F.lit(True)
            begins, value = shaped & flag.isin("B", "U", "S"), F.expr(f"substring({col}, 3)")
        else:
            there = F.col(col).isNotNull()
            first[f"_{name}_new"] = F.when(there, ~F.coalesce(F.col(col).startswith("_"), F.lit(False)) | (F.count(col).over(w) == 1))
            first[f"_{name}_in"] = there
            begins, value = F.lit(True), F.regexp_replace(col, "^_", "")
        second[f"_{name}_at"] = F.last(F.when(F.col(f"_{name}_new"), F.struct(begins.alias("tag"), value.alias("value"), "lb", "pos", "tok")), True).over(w)
        # the next token that counts begins another tag, or there is none
        second[f"_{name}_end"] = F.coalesce(F.expr(f"lead(_{name}_new) ignore nulls {over}"), F.lit(True)) & F.col(f"_{name}_in")
        at = F.col(f"_{name}_at")
        last = at["value"] if kind == "chunk" else value
        third[name] = F.when(F.col(f"_{name}_end") & at["tag"], F.struct(last.alias("value"), at["lb"].alias("lb"), "ub", at["tok"].alias("tlb"), (at["tok"] + F.col("pos") - at["pos"] + 1).alias("tub")))
    return tokens.withColumns(first).withColumns(second).withColumns(third).drop(*first, *second)


def encode_chunks(tokens: DataFrame, tags: DataFrame, out: str) -> DataFrame:
    """`tokens` with a BIO column of tags (doc_id, sent, lb, ub, value) that don't overlap."""
    cells = tags.select("doc_id", "sent", "value", F.posexplode(F.expr("sequence(lb, ub - 1)")).alias("_i", "pos"))
    cells = cells.groupBy("doc_id", "sent", "pos").agg(F.min(F.struct("_i", "value")).alias("_c"))
    label = F.when(F.col("_c").isNull(), "O").otherwise(F.concat(F.when(F.col("_c._i") == 0, "B-").otherwise("I-"), F.coalesce("_c.value", F.lit(""))))
    return tokens.join(cells, ["doc_id", "sent", "pos"], "left").withColumn(out, label).drop("_c")


def decode_pos(tokens: DataFrame, col: str) -> DataFrame:
    """(doc_id, sent, lb, ub, value): tags of a column in which a leading _ continues the tag before; the last part names it."""
    w = Window.partitionBy("doc_id", "sent").orderBy("pos")
    goes_on = F.coalesce(F.col(col).startswith("_"), F.lit(False))
    t = tokens.select("doc_id", "sent", "pos", F.col(col).alias("_v"), (~goes_on).cast("int").alias("_new")).where("_v is not null")
    t = t.withColumn("_g", F.sum("_new").over(w))
    return t.groupBy("doc_id", "sent", "_g").agg(F.min("pos").alias("lb"), (F.max("pos") + 1).alias("ub"), F.max_by(F.regexp_replace("_v", "^_", ""), "pos").alias("value")).drop("_g")


def repaired_pos(tokens: DataFrame, col: str, out: str) -> DataFrame:
    """`tokens` with a column in which every member of a _ group agrees with the group's last."""
    w = Window.partitionBy("doc_id", "sent").orderBy("pos")
    goes_on = F.coalesce(F.col(col).startswith("_"), F.lit(False))
    t = tokens.withColumn("_g", F.sum((~goes_on).cast("int")).over(w))
    whole = Window.partitionBy("doc_id", "sent", "_g").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.regexp_replace(F.last(col).over(whole), "^_", "")
    return t.withColumn(out, F.when(goes_on, F.concat(F.lit("_"), last)).otherwise(last)).drop("_g")


def scheme(tokens: DataFrame, col: str) -> DataFrame:
    """(doc_id, scheme): `bio` if every tag of the document's first sentence begins with B, I or O, else `pos`."""
    first = tokens.withColumn("_m", F.min("sent").over(Window.partitionBy("doc_id"))).where("sent = _m")
    ok = F.min(F.coalesce(F.col(col).rlike("^[BIO]"), F.lit(False)).cast("int"))
    return first.groupBy("doc_id").agg(F.when(ok == 1, "bio").otherwise("pos").alias("scheme"))


def to_characters(tags: DataFrame, tokens: DataFrame) -> DataFrame:
    """Document-token tags (doc_id, lb, ub, value) with the characters they cover: equi joins on both end tokens.

    Tags that run beyond the tokens there are fall out.
    """
    a = tokens.select("doc_id", F.col("tok").alias("lb"), F.col("lb").alias("clb"))
    b = tokens.select("doc_id", (F.col("tok") + 1).alias("ub"), F.col("ub").alias("cub"))
    return tags.join(a, ["doc_id", "lb"]).join(b, ["doc_id", "ub"]).select(*tags.columns, "clb", "cub")


def characters_by_document(tags: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, lb, ub, value): `to_characters` of document-token tags (doc_id, lb, ub, value), a document at a time.

    Tags and tokens meet by document, so tokens that lie by document don't move.
    """
    t = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok", "lb", "ub"))).alias("t"))
    g = tags.groupBy("doc_id").agg(F.collect_list(F.struct("lb", "ub", "value")).alias("g"))
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, rows = [], []
            for i in range(b.num_rows):
                toks, begun = b.column("t")[i].values, len(rows)
                tok, lb, ub = (c.to_pylist() for c in toks.flatten())
                first, last = dict(zip(tok, lb, strict=True)), dict(zip(tok, ub, strict=True))
                rows += [(first[x["lb"]], last[x["ub"] - 1], x["value"]) for x in b.column("g")[i].as_py() if x["lb"] in first and x["ub"] is not None and x["ub"] - 1 in last]
                of += [i] * (len(rows) - begun)
            cells = zip(*rows, strict=True) if rows else [[]] * 3
            kind = b.column("t").type.value_type
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of, pa.int32())), *[pa.array(c, x) for c, x in zip(cells, (kind.field("lb").type, kind.field("ub").type, pa.string()), strict=True)]], names=["doc_id", "lb", "ub", "value"])

    return g.join(t, "doc_id").mapInArrow(run, f"doc_id {kinds['doc_id']}, lb {kinds['lb']}, ub {kinds['ub']}, value string")


def to_tokens(tags: DataFrame, tokens: DataFrame) -> DataFrame:
    """Character tags (doc_id, lb, ub, value) as (doc_id, sent, lb, ub, value) in sentence positions.

    Begin: the token that holds the first character; end: the first token that
    ends at or after the last. Tags that begin in no token, end after the last
    or cross a sentence's end fall out. An interval join on the document.
    """
    t = tags.withColumn("_id", F.monotonically_increasing_id())
    a = tokens.select("doc_id", F.col("lb").alias("_a"), F.col("ub").alias("_b"), F.col("sent").alias("_s"), F.col("pos").alias("_p"))
    begin = t.join(a, "doc_id").where("_a <= lb and lb < _b").select("_id", "doc_id", "lb", "ub", "value", F.col("_s").alias("s1"), F.col("_p").alias("p1"))
    end = begin.join(a, "doc_id").where("_b >= ub and _a < ub").groupBy("_id", "doc_id", "value", "s1", "p1").agg(F.min(F.struct("_b", "_s", "_p")).alias("_e"))
    return end.where("s1 = _e._s").select("doc_id", F.col("s1").alias("sent"), F.col("p1").alias("lb"), (F.col("_e._p") + 1).alias("ub"), "value")


def ordered(tags: DataFrame, by: list[str]) -> DataFrame:
    """`tags` with `idx` in the order (lb, -ub, value) within `by`."""
    return tags.withColumn("idx", F.row_number().over(Window.partitionBy(*by).orderBy("lb", F.desc("ub"), "value")) - 1)


def top_level(tags: DataFrame, by: list[str]) -> DataFrame:
    """Tags that don't begin inside the one kept before, in the order (lb, -ub, value)."""
    c = tags.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lb", (-F.col("ub")).alias("nub"), "value"))).alias("c"))
    kept = F.expr("aggregate(c, cast(array() as array<struct<lb:int,ub:int,value:string>>), (a, x) -> case when x.lb >= coalesce(try_element_at(a, -1).ub, x.lb) then a || array(struct(x.lb as lb, -x.nub as ub, x.value as value)) else a end)")
    return c.select(*by, F.explode(kept).alias("m")).select(*by, "m.*")


def bottom_level(tags: DataFrame, by: list[str]) -> DataFrame:
    """Tags whose next one, in the order (lb, -ub, value), begins after their end."""
    w = Window.partitionBy(*by).orderBy("lb", F.desc("ub"), "value")
    return tags.withColumn("_n", F.lead("lb").over(w)).where("_n is null or _n > ub").drop("_n")


def level(value: Column | str, n: int) -> Column:
    """The n-th part of a dotted tag, null beyond the last."""
    c = F.col(value) if isinstance(value, str) else value
    return F.get(F.split(c, r"\."), F.lit(n))


def up_to_level(value: Column | str, n: int) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.slice(F.split(c, r"\."), 1, n + 1), ".")


def relabelled(tags: DataFrame, mapping: DataFrame, value: str = "value", key: str = "tag", to: str = "mapped") -> DataFrame:
    """`tags` under a mapping: unmapped values stay, values mapped to nothing fall out; null values stay null."""
    m = mapping.select(F.col(key).alias("_k"), F.coalesce(F.col(to), F.lit("")).alias("_t")).groupBy("_k").agg(F.min("_t").alias("_t"))
    out = tags.join(m, tags[value] == m["_k"], "left").withColumn(value, F.coalesce("_t", F.col(value))).where(F.col(value).isNull() | (F.col(value) != ""))
    return out.drop("_k", "_t")


def replaced_layer(tags: DataFrame, fresh: DataFrame, layer: str) -> DataFrame:
    """`tags` with one layer of the documents in `fresh` replaced by theirs."""
    docs = fresh.select("doc_id").distinct().withColumn("_l", F.lit(layer))
    kept = tags.join(docs, (tags["doc_id"] == docs["doc_id"]) & (tags["layer"] == docs["_l"]), "left_anti")
    return kept.unionByName(fresh.withColumn("layer", F.lit(layer)), allowMissingColumns=True)


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.select(*names)


def ranges(text: str, n: int, with_zero: bool = True) -> list[int]:
    """Places named by `lo:hi` (both ends taken) and single numbers, parted by commas; negative ones count from the end."""
    out = {0} if with_zero else set()
    for part in text.split(","):
        a, _, b = part.strip().partition(":")
        lo, hi = int(a), int(b or a)
        lo, hi = lo + n if lo < 0 else lo, hi + n if hi < 0 else hi
        out.update(range(lo, hi + 1))
    return sorted(i for i in out if 0 <= i < n)


def keep_ranges(df: DataFrame, text: str) -> DataFrame:
    return df.select(*[df.columns[i] for i in ranges(text, len(df.columns))])


def with_annotations(docs: DataFrame, tags: DataFrame, value: str = "value") -> DataFrame:
    """The documents that have tags."""
    return docs.join(tags.select("doc_id").distinct(), "doc_id", "left_semi")


def in_tagset(tags: DataFrame, tagset: list[str], value: str = "value") -> DataFrame:
    """Tags whose value is in the tagset or under one of its tags."""
    ok = F.lit(False)
    for t in tagset:
        ok = ok | (F.col(value) == t) | F.col(value).startswith(t + ".")
    return tags.where(ok)
