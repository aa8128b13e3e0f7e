"""Document-wide label consistency and abbreviations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dictionary import SEP
from .spans import decode_chunks, encode_chunks


def forms(tokens: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, key, n, sent, lb, ub, value): tags with the words they cover."""
    cells = tags.select("doc_id", "sent", "lb", "ub", "value", F.explode(F.expr("sequence(lb, ub - 1)")).alias("pos"))
    joined = cells.join(tokens.select("doc_id", "sent", "pos", "word"), ["doc_id", "sent", "pos"])
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word", F.lit("")).alias("word")))), lambda x: x["word"])
    return joined.groupBy("doc_id", "sent", "lb", "ub", "value").agg(F.array_join(words, SEP).alias("key")).withColumn("n", (F.col("ub") - F.col("lb")).cast("int"))


def majority(found: DataFrame) -> DataFrame:
    """(doc_id, key, n, value): the label a form mostly has in its document; of equals the one seen first."""
    c = found.groupBy("doc_id", "key", "n", "value").agg(F.count("*").alias("c"), F.min(F.struct("sent", "lb")).alias("_first"))
    best = c.groupBy("doc_id", "key", "n").agg(F.min(F.struct((-F.col("c")).alias("c"), "_first", "value")).alias("_b"))
    return best.select("doc_id", "key", "n", "_b.value")


def _places(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """Greedy leftmost-longest places of a document's own forms.

    A form's first word finds its possible places; only there are its other
    words looked for, so the plan is the same however long forms are.
    """
    parts = F.split("key", SEP)
    forms_ = known.select("doc_id", "n", "value", "key", parts.alias("_ks"), F.element_at(parts, 1).alias("word"))
    t = tokens.select("doc_id", "sent", "pos", "word").where("word is not null")
    starts = t.join(forms_, ["doc_id", "word"]).select("doc_id", "sent", F.col("pos").alias("_p"), "n", "value", "key", "_ks")
    more = starts.where("n > 1").select("doc_id", "sent", "_p", "n", "value", "key", F.posexplode(F.expr("slice(_ks, 2, n - 1)")).alias("_i", "word"))
    there = more.withColumn("pos", F.col("_p") + 1 + F.col("_i")).join(t, ["doc_id", "sent", "pos", "word"])
    whole = there.groupBy("doc_id", "sent", "_p", "n", "value", "key").agg(F.count("*").alias("_c")).where("_c = n - 1").drop("_c", "key")
    hits = starts.where("n = 1").select("doc_id", "sent", "_p", "n", "value").unionByName(whole).groupBy("doc_id", "sent", F.col("_p").alias("pos")).agg(F.max(F.struct("n", "value")).alias("_b"))
    per = hits.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("pos", "_b.n", "_b.value"))).alias("c"))
    chosen = F.expr("aggregate(c, cast(array() as array<struct<lb:int,ub:int,value:string>>), (a, x) -> case when x.pos >= coalesce(try_element_at(a, -1).ub, 0) then a || array(struct(x.pos as lb, x.pos + x.n as ub, x.value as value)) else a end)")
    return per.select("doc_id", "sent", F.explode(chosen).alias("m")).select("doc_id", "sent", "m.*")


def spread(tokens: DataFrame, col: str, out: str, overriding: bool = True) -> DataFrame:
    """`tokens` with the labels of each document's known forms given to all their occurrences in it.

    Overriding: a match replaces the tags that lie in it, and stands beside
    others. Otherwise matches only fill runs of tokens without a tag.
    """
    gold = decode_chunks(tokens, col)
    known = majority(forms(tokens, gold))
    found = _places(tokens, known)
    g = gold.select(F.col("doc_id").alias("_d"), F.col("sent").alias("_s"), F.col("lb").alias("glb"), F.col("ub").alias("gub"))
    same = (F.col("doc_id") == F.col("_d")) & (F.col("sent") == F.col("_s"))
    if overriding:
        fresh = found.join(g, same & (F.col("glb") == F.col("lb")) & (F.col("gub") == F.col("ub")), "left_anti")
        f = fresh.select(F.col("doc_id").alias("_d"), F.col("sent").alias("_s"), F.col("lb").alias("flb"), F.col("ub").alias("fub"))
        gold = gold.join(f, (F.col("doc_id") == F.col("_d")) & (F.col("sent") == F.col("_s")) & (F.col("flb") <= F.col("lb")) & (F.col("ub") <= F.col("fub")), "left_anti")
    else:
        fresh = found.join(g, same & (F.col("glb") < F.col("ub")) & (F.col("lb") < F.col("gub")), "left_anti")
    return encode_chunks(tokens, gold.unionByName(fresh), out)


#: Words a long form may have: so many for each letter of the short one, and so many more.
PER_LETTER, MORE = 2, 3


def _long_forms(words: list[str]) -> Iterator[tuple[int, int, int]]:
    """(place of an upper-case word, begin and end of the run of words on its left, from its first to its last letter)."""
    initials = [w[0].upper() if w and w[0].isalpha() else "" for w in words]
    for i, w in enumerate(words):
        if not (len(w) > 1 and w.isupper() and w.isalpha()):
            continue
        # the initials to the left are matched from the last letter on; the run ends where the first one is
        k, ub = len(w) - 1, i
        for lb in range(i - 1, max(-1, i - 1 - PER_LETTER * len(w) - MORE), -1):
            if initials[lb] == w[k]:
                ub = lb + 1 if k == len(w) - 1 else ub
                k -= 1
                if k < 0:
                    yield i, lb, ub
                    break


def abbreviations(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent, pos, short, lb, ub): upper-case tokens with the words on their left whose initials spell them.

    The long form is the shortest run of words up to the token, in the sentence,
    in which words stand in order that begin with its letters, of no more words
    than `PER_LETTER` and `MORE` allow: farther words are no expansion. Sentences without
    an upper-case token aren't gathered; the others are, many in a batch.
    """
    short = F.col("word").rlike(r"^\p{Lu}{2,}$")
    has = tokens.where(short).select("doc_id", "sent").distinct()
    some = tokens.join(has, ["doc_id", "sent"], "left_semi").groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word", F.lit("")).alias("word")))).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, sent, t in zip(pdf["doc_id"], pdf["sent"], pdf["t"], strict=True):
                for i, lb, ub in _long_forms([x["word"] for x in t]):
                    out.append((d, sent, t[i]["pos"], t[i]["word"], t[lb]["pos"], t[ub - 1]["pos"] + 1))
            yield pd.DataFrame(out, columns=["doc_id", "sent", "pos", "short", "lb", "ub"])

    kind = {f.name: f.dataType.simpleString() for f in tokens.schema}
    return some.mapInPandas(run, f"doc_id {kind['doc_id']}, sent {kind['sent']}, pos int, short string, lb int, ub int")


def spread_along(tokens: DataFrame, found: DataFrame, col: str, out: str) -> DataFrame:
    """`tokens` with labels carried between abbreviations and their long forms.

    Where a long form of `found` carries one label, all places of its short form
    in the document get it; where a short form does, the long form gets it. A
    token that has a label keeps it.
    """
    gold = decode_chunks(tokens, col)
    longs = found.join(gold.select("doc_id", "sent", "lb", "ub", "value"), ["doc_id", "sent", "lb", "ub"])
    by_short = longs.groupBy("doc_id", "short").agg(F.min("value").alias("value"))
    places = tokens.where("word is not null").select("doc_id", "sent", "pos", F.col("word").alias("short"))
    a = places.join(by_short, ["doc_id", "short"]).select("doc_id", "sent", F.col("pos").alias("lb"), (F.col("pos") + 1).alias("ub"), "value")
    shorts = gold.where("ub = lb + 1").select("doc_id", "sent", F.col("lb").alias("pos"), "value")
    b = found.join(shorts, ["doc_id", "sent", "pos"]).select("doc_id", "sent", "lb", "ub", "value")
    fresh = a.unionByName(b).groupBy("doc_id", "sent", "lb", "ub").agg(F.min("value").alias("value"))
    g = gold.select(F.col("doc_id").alias("_d"), F.col("sent").alias("_s"), F.col("lb").alias("glb"), F.col("ub").alias("gub"))
    fresh = fresh.join(g, (F.col("doc_id") == F.col("_d")) & (F.col("sent") == F.col("_s")) & (F.col("glb") < F.col("ub")) & (F.col("lb") < F.col("gub")), "left_anti")
    return encode_chunks(tokens, gold.unionByName(fresh), out)
