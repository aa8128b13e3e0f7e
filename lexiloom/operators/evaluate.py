"""Reference against system tags: pairing, counts, metrics, differences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("correct", "type", "boundary", "type+boundary", "silence", "noise")


def _numbered(tags: DataFrame) -> DataFrame:
    return tags.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "lb", "ub", "value").orderBy(F.lit(0))))


def exact(gold: DataFrame, guess: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, gold left, guesses left) after equal tags found each other, one to one."""
    key = ["doc_id", "lb", "ub", "value", "_n"]
    g, s = _numbered(gold), _numbered(guess)
    return g.join(s, key, "left_semi"), g.join(s, key, "left_anti").drop("_n"), s.join(g, key, "left_anti").drop("_n")


def paired(gold: list[dict], guess: list[dict]) -> list[tuple]:
    """(kind, gold tag or None, guessed tag or None) of one document's tags without exact pairs.

    Three passes in the order (lb, -ub, value), each one to one: same place and
    another type; same type and one common end; another type and one common end.
    What is left is silence or noise; tags that only overlap are both. Guesses
    are looked up by their ends, so a document's time goes with its tags.
    """
    order = lambda d: sorted(d, key=lambda t: (t["lb"], -t["ub"], t["value"]))
    left, right, out = order(gold), order(guess), []
    at_lb: dict[int, list[int]] = {}
    at_ub: dict[int, list[int]] = {}
    for k, b in enumerate(right):
        at_lb.setdefault(b["lb"], []).append(k)
        at_ub.setdefault(b["ub"], []).append(k)
    free = [True] * len(right)

    def first(a, ok) -> int | None:
        near = (next((k for k in at.get(a[end], ()) if free[k] and ok(a, right[k])), None) for at, end in ((at_lb, "lb"), (at_ub, "ub")))
        return min((k for k in near if k is not None), default=None)

    def one_end(a, b):
        return (a["lb"] == b["lb"]) != (a["ub"] == b["ub"])

    for kind, ok in (
        ("type", lambda a, b: a["lb"] == b["lb"] and a["ub"] == b["ub"]),
        ("boundary", lambda a, b: a["value"] == b["value"] and one_end(a, b)),
        ("type+boundary", lambda a, b: a["value"] != b["value"] and one_end(a, b)),
    ):
        rest = []
        for a in left:
            hit = first(a, ok)
            if hit is None:
                rest.append(a)
            else:
                free[hit] = False
                out.append((kind, a, right[hit]))
        left = rest
    return out + [("silence", a, None) for a in left] + [("noise", None, b) for k, b in enumerate(right) if free[k]]


def pairs(gold: DataFrame, guess: DataFrame) -> DataFrame:
    """(doc_id, kind, gold_lb, gold_ub, gold_value, guess_lb, guess_ub, guess_value).

    Both sides are counted together by place and value, so that all tags move once,
    by document. Equal tags are pairs; only what differs goes to the sequential
    passes, a document's leftovers at a time. Null values compare as ''.
    """
    cols = [F.col("lb").cast("int").alias("lb"), F.col("ub").cast("int").alias("ub"), F.coalesce("value", F.lit("")).alias("value")]
    every = gold.select("doc_id", *cols, F.lit(1).alias("g"), F.lit(0).alias("s")).unionByName(guess.select("doc_id", *cols, F.lit(0).alias("g"), F.lit(1).alias("s")))
    n = every.repartition("doc_id").groupBy("doc_id", "lb", "ub", "value").agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    docs = n.groupBy("doc_id").agg(F.collect_list(F.struct("lb", "ub", "value", "g", "s")).alias("tags"))
    kind = gold.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "kind", "gold_lb", "gold_ub", "gold_value", "guess_lb", "guess_ub", "guess_value"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for b in it:
            of, rows = [], []
            for i in range(b.num_rows):
                left, right, begun = [], [], len(rows)
                for t in b.column(1)[i].as_py():
                    both, place = min(t["g"], t["s"]), (t["lb"], t["ub"], t["value"])
                    rows += [("correct", *place, *place)] * both
                    left += [t] * (t["g"] - both)
                    right += [t] * (t["s"] - both)
                for k, x, y in paired(left, right):
                    rows.append((k, *((x["lb"], x["ub"], x["value"]) if x else (None,) * 3), *((y["lb"], y["ub"], y["value"]) if y else (None,) * 3)))
                of += [i] * (len(rows) - begun)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int32())), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)]], names=names)

    return docs.mapInArrow(run, f"doc_id {kind}, kind string, gold_lb int, gold_ub int, gold_value string, guess_lb int, guess_ub int, guess_value string")


def counts(paired_: DataFrame) -> DataFrame:
    """(entity, kind, n) per tag value, and for `global`; a pair counts under its gold and its guessed value."""
    own = F.array_distinct(F.array_compact(F.array("gold_value", "guess_value")))
    return paired_.select("kind", F.explode(F.array_append(own, F.lit("global"))).alias("entity")).groupBy("entity", "kind").agg(F.count("*").alias("n"))


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def metrics(counted: DataFrame, beta: float = 1.0) -> DataFrame:
    """(entity, precision, recall, f, under, over, substitution); 0/0 is 0."""
    n = {k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) for k in KINDS}
    t = counted.groupBy("entity").agg(*[v.alias(k) for k, v in n.items()])
    c, subst = F.col("correct"), F.col("type") + F.col("boundary") + F.col("`type+boundary`")
    made, wanted = c + subst + F.col("noise"), c + subst + F.col("silence")
    t = t.select("entity", _share(c, made).alias("precision"), _share(c, wanted).alias("recall"), _share(F.col("silence"), wanted).alias("under"), _share(F.col("noise"), made).alias("over"), _share(subst, c + subst).alias("substitution"))
    b2 = beta * beta
    return t.withColumn("f", _share((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall")))


def macro(metric: DataFrame) -> DataFrame:
    """Means over the entities, 0 without any."""
    return metric.where("entity <> 'global'").agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f")])


def differences(paired_: DataFrame, docs: DataFrame, context: int = 30, text: str = "content") -> DataFrame:
    """(doc_id, kind, shown): each wrong pair in its context, the gold in {}, the guess in []."""
    lb, ub = F.least("gold_lb", "guess_lb"), F.greatest("gold_ub", "guess_ub")
    p = paired_.where("kind <> 'correct'").withColumn("_a", lb).withColumn("_b", ub)
    j = p.join(docs.select("doc_id", F.col(text).alias("_t")), "doc_id")
    before = F.expr(f"substring(_t, greatest(_a - {context}, 0) + 1, _a - greatest(_a - {context}, 0))")
    inside, after = F.expr("substring(_t, _a + 1, _b - _a)"), F.expr(f"substring(_t, _b + 1, {context})")
    mark = F.when(F.col("kind") == "silence", F.concat(F.lit("{"), F.col("gold_value"), F.lit(": "), inside, F.lit("}"))).when(F.col("kind") == "noise", F.concat(F.lit("["), F.col("guess_value"), F.lit(": "), inside, F.lit("]"))).otherwise(F.concat(F.lit("{"), F.col("gold_value"), F.lit("|"), F.col("guess_value"), F.lit(": "), inside, F.lit("}")))
    return j.select("doc_id", "kind", F.concat(F.regexp_replace(before, "\n", " "), mark, F.regexp_replace(after, "\n", " ")).alias("shown"))
