"""Pattern rules over sentences: sequences of predicates with cardinalities, matched greedily without backtracking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANY = 2**30


def cardinality(text: str | None) -> tuple[int, int]:
    """(least, most) of `?`, `*`, `+`, `n` or `min,max`; one without."""
    text = (text or "1").strip()
    least, most = {"?": (0, 1), "*": (0, MANY), "+": (1, MANY)}.get(text) or (tuple(map(int, text.split(","))) if "," in text else (int(text),) * 2)
    if most <= 0 or least < 0 or least > most:
        raise ValueError(f"no cardinality: {text!r}")
    return least, most


@dataclass(frozen=True)
class Step:
    """A column of the sentence view, or alternatives, with how often it may come.

    A boolean column matches one token; an integer column says how many tokens
    its sequence feature matches from there (0: none).
    """

    column: str = ""
    card: str = "1"
    either: tuple[tuple[Step, ...], ...] = field(default=())


def step_length(step: Step, row: dict[str, list], i: int, n: int) -> int:
    """Tokens one occurrence of the step takes at i, 0 for no match."""
    if i >= n:
        return 0
    if step.either:
        return max((rule_length(alt, row, i, n) for alt in step.either), default=0)
    return int(row[step.column][i] or 0)


def rule_length(steps: tuple[Step, ...], row: dict[str, list], i: int, n: int) -> int:
    """Tokens a rule takes from i on, 0 for no match."""
    at = i
    for s in steps:
        least, most = cardinality(s.card)
        times = 0
        while times < most and (k := step_length(s, row, at, n)):
            at += k
            times += 1
        if times < least:
            return 0
    return at - i


def rule_tags(steps: tuple[Step, ...], row: dict[str, list], n: int, strict: bool = False) -> list[tuple[int, int]]:
    """[(lb, ub)] in one sentence of n tokens, left to right without overlap.

    `strict` keeps two limits of the classic matcher: no match begins at the
    last token, and none that is still open at the end is given.
    """
    out, i = [], 0
    while i < n - (1 if strict else 0):
        k = rule_length(steps, row, i, n)
        if k and not (strict and i + k == n and cardinality(steps[-1].card)[1] > 1):
            out.append((i, i + k))
            i += k
        else:
            i += 1
    return out


def _columns(steps: tuple[Step, ...]) -> set[str]:
    return {c for s in steps for c in ({s.column} if not s.either else {x for alt in s.either for x in _columns(alt)})}


def rule(tokens: DataFrame, steps: tuple[Step, ...], predicates: dict[str, Column], name: str, out: str, strict: bool = False) -> DataFrame:
    """`tokens` with B-name/I-name/O of a rule over predicates evaluated natively.

    Sentences without a token that the rule can begin with aren't gathered.
    """
    t = tokens.select("doc_id", "sent", "pos", *[F.coalesce(c.cast("int"), F.lit(0)).alias(k) for k, c in predicates.items()])
    used = sorted(_columns(steps))
    any_ = F.greatest(*[F.max(c) for c in used]) if len(used) > 1 else F.max(used[0])
    s = t.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("pos", *used))).alias("t"), any_.alias("_any")).where("_any > 0")
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for d, sent, toks in zip(pdf["doc_id"], pdf["sent"], pdf["t"], strict=True):
                row = {c: [x[c] for x in toks] for c in used}
                for lb, ub in rule_tags(steps, row, len(toks), strict):
                    rows += [(d, sent, toks[i]["pos"], i - lb) for i in range(lb, ub)]
            yield pd.DataFrame(rows, columns=["doc_id", "sent", "pos", "_i"])

    cells = s.select("doc_id", "sent", "t").mapInPandas(run, f"doc_id {kinds['doc_id']}, sent {kinds['sent']}, pos {kinds['pos']}, _i int")
    return tokens.join(cells, ["doc_id", "sent", "pos"], "left").withColumn(out, F.when(F.col("_i") == 0, f"B-{name}").when(F.col("_i") > 0, f"I-{name}").otherwise("O")).drop("_i")
