"""Texts of varying length in containers of fixed capacity (problem 8).

Linear grouping scheme. What the packing needs to know is how many pieces there
are of each length: a table of at most as many rows as the capacity, whatever
the number of texts. On it, large lengths are rounded up within groups of equal
cardinality, the best fillings of the few rounded sizes are chosen, and actual
lengths put in for rounded ones; small pieces then go where they fit best. The
plan says which ranks of a length go into which containers; the pieces look
that up where they are.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..runtime import checkpointed, spread

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces from this share of the capacity on are large; groups of large pieces; pieces a bucket holds in which ranks are counted.
LARGE, GROUPS, PER_BUCKET = 1 / 8, 48, 200_000
# Fixed value: how byte-level tokenizers of this family cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows, piece, start, size = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                n = len(enc.encode_ordinary(t))
                for k, s in enumerate(range(0, max(n, 1), capacity)):
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    size.append(min(capacity, n - s))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32())], names=["doc_id", "piece", "start", "tokens"])

    return run


def _fillings(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size fill the capacity best: a bounded knapsack over what is left, large sizes first."""
    reach = np.full(capacity + 1, -1, np.int64)  # last size used to reach a sum
    used = np.zeros(capacity + 1, np.int64)
    prev = np.full(capacity + 1, -1, np.int64)
    reach[0] = len(sizes)
    for k, size in enumerate(sizes):
        if not left[k]:
            continue
        count = np.full(capacity + 1, -1, np.int64)
        count[reach >= 0] = 0
        for s in range(size, capacity + 1):
            if reach[s] < 0 and count[s - size] >= 0 and count[s - size] < left[k]:
                count[s] = count[s - size] + 1
                reach[s], used[s], prev[s] = k, 1, s - size
    best = int(np.flatnonzero(reach >= 0).max())
    out = [0] * len(sizes)
    while best > 0:
        out[reach[best]] += 1
        best = int(prev[best])
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, containers) for counts by length.

    A run (length, first rank, end rank, first container, each) sends the ranks
    of a length to consecutive containers, `each` of them to one. Containers
    that get the same lengths are handled together, so the work depends on the
    number of different lengths and not on that of the texts.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    taken: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    made = 0
    if left.get(capacity):
        runs.append((capacity, 0, left[capacity], 0, 1))
        made = left.pop(capacity)
    large = sorted((n for n in left if n >= capacity * LARGE), reverse=True)
    total = sum(left[n] for n in large)
    # groups of equal cardinality, from the largest down; a group is the run of (length, count) in it
    per = max(1, -(-total // groups))
    members: list[list[list[int]]] = []
    room = 0
    for n in large:
        c = left[n]
        while c:
            if not room:
                members.append([])
                room = per
            k = min(c, room)
            members[-1].append([n, k])
            c -= k
            room -= k
    sizes = [g[0][0] for g in members]
    counts = [sum(c for _, c in g) for g in members]
    bins: list[list] = []  # [how many containers, room left, {length: pieces in each}]
    while any(counts):
        use = _fillings(sizes, counts, capacity)
        times = min(counts[k] // u for k, u in enumerate(use) if u)
        for k, u in enumerate(use):
            counts[k] -= u * times
        # actual pieces for rounded sizes: containers that get the same ones stay together
        parts = [[times, capacity, {}]]
        for k, u in enumerate(use):
            for _ in range(u):
                new = []
                for many, space, held in parts:
                    while many:
                        n, c = members[k][0]
                        m = min(many, c)
                        new.append([m, space - n, {**held, n: held.get(n, 0) + 1}])
                        many -= m
                        members[k][0][1] -= m
                        if not members[k][0][1]:
                            members[k].pop(0)
                parts = new
        bins += parts
    small = {n: c for n, c in left.items() if n < capacity * LARGE and n > 0}
    by_room: dict[int, list] = defaultdict(list)
    for b in bins:
        by_room[b[1]].append(b)
    done: list[list] = []
    # best fit: the largest small pieces first, each into the fullest container that takes it
    for n in sorted(small, reverse=True):
        c = small[n]
        while c:
            fit = min((r for r in by_room if r >= n and by_room[r]), default=None)
            if fit is None:
                whole, rest = divmod(c, capacity // n)
                if whole:
                    by_room[capacity - n * (capacity // n)].append([whole, capacity - n * (capacity // n), {n: capacity // n}])
                if rest:
                    by_room[capacity - n * rest].append([1, capacity - n * rest, {n: rest}])
                c = 0
                break
            many, space, held = by_room[fit].pop()
            if not by_room[fit]:
                del by_room[fit]
            each = min(space // n, max(1, c // many))
            m = min(many, c // each)
            by_room[space - each * n].append([m, space - each * n, {**held, n: held.get(n, 0) + each}])
            if many > m:
                by_room[space].append([many - m, space, held])
            c -= each * m
    for bs in by_room.values():
        done += bs
    for many, _, held in done:
        for n, each in sorted(held.items()):
            runs.append((n, taken[n], taken[n] + each * many, made, each))
            taken[n] += each * many
        made += many
    if left.get(0):
        runs.append((0, 0, left[0], 0, left[0]))
        made = max(made, 1)
    return runs, made


def pack(docs: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container, doc_id, piece, start, tokens): every text assigned to containers of `capacity` tokens.

    Only texts longer than a container are cut: into full containers and a rest
    that is packed like any other text. Empty texts need no room and go to
    container 0; null texts are no texts. Rows of one id that repeat a text
    count once, the greatest of different texts stands for the id.

    Counted: one pass over the texts, the pieces checkpointed. The plan's table
    has a few rows per distinct length; pieces of one length get their ranks in
    buckets, so a length that a third of all texts has is spread like any other.
    """
    kind = docs.select(doc).schema[0].dataType.simpleString()
    once = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("_t")).where("doc_id is not null and _t is not null")
    pieces = spread(once).mapInArrow(_counter(tokenizer, capacity), f"doc_id {kind}, piece int, start bigint, tokens int")
    pieces = checkpointed(pieces.groupBy("doc_id", "piece").agg(F.max(F.struct("tokens", "start")).alias("_r")).select("doc_id", "piece", "_r.start", "_r.tokens"))
    # ranks are counted in buckets of some hundred thousand pieces, however many have one length
    buckets = max(16, min(65_536, pieces.count() // PER_BUCKET + 1))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    spark = docs.sparkSession
    per = pieces.groupBy("tokens", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["tokens"]: r["n"] for r in per.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    runs, _ = plan(histogram, capacity)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "lo", "hi", "first", "each")])
    table = spark.createDataFrame([tuple(map(int, r)) for r in runs], schema).groupBy(F.col("length").cast("int").alias("tokens")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first", "each"))).alias("runs"))
    before = per.select("tokens", "bucket", (F.sum("n").over(W.Window.partitionBy("tokens").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("_k", F.row_number().over(W.Window.partitionBy("tokens", "bucket").orderBy("doc_id", "piece")) - 1)
    # the plan has one row a length and is broadcast; the offsets have one a length and bucket and are while that is bounded
    ranked = ranked.join(F.broadcast(before) if (capacity + 1) * buckets <= 500_000 else before, ["tokens", "bucket"]).withColumn("_rank", F.col("_k") + F.col("before"))
    placed = ranked.join(F.broadcast(table), "tokens").withColumn("_run", F.expr("filter(runs, r -> r.lo <= _rank and _rank < r.hi)[0]"))
    container = F.col("_run.first") + F.expr("(_rank - _run.lo) div _run.each")
    return placed.select(container.alias("container"), "doc_id", "piece", "start", "tokens")
