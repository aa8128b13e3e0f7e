"""Passages of test items in training documents (problem 9).

The test items make a BM25 inverted index; every window of every document is a
query against it. Scores are scaled by the least score that a window with the
required run of an item's words can have, so that 1 is an exact threshold: no
run scores below it. Block-max WAND finds all items at or above the threshold;
what it finds is verified word by word, in the question and in the answer.

A large item table is indexed part by part on the executors; the parts lie in
the shared folder, and the documents are read once, a stretch of them being
held against one part after the other.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_dir, spread

#: Words a passage shares with an item, at least, in the item's order.
RUN = 12
K1, B = 1.2, 0.75
#: Items and characters of one part of the index, items of one block of its lists.
ITEMS, ITEM_CHARS, BLOCK = 20_000, 20_000_000, 16
#: Characters of documents held against the parts of the index at once.
TOGETHER = 16_000_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return [w.casefold() for w in _WORD.findall(text)]


class Index:
    """BM25 posting lists with block maxima, weights in units of each item's threshold."""

    def __init__(self, items: tuple[tuple[int, str], ...], run: int = RUN):
        self.run = run
        texts = [(i, words(t)) for i, t in items]
        self.items = [(i, w) for i, w in texts if len(w) >= run]
        self.asked = [len(words(t[: t.rfind("?") + 1] if "?" in t else t)) or len(words(t)) for (_, t), (_, w) in zip(items, texts, strict=True) if len(w) >= run]
        n = len(self.items)
        df = Counter(t for _, w in self.items for t in set(w))
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        mean = sum(len(w) for _, w in self.items) / max(n, 1)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.grams: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            tf = Counter(w)
            weight = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            # a query counts a term once, so a window of the item scores at least its distinct terms' weights
            least = min(sum(weight[t] for t in set(w[s : s + run])) for s in range(len(w) - run + 1))
            for t, x in weight.items():
                postings[t].append((k, x / least))
            for s in range(len(w) - run + 1):
                self.grams[tuple(w[s : s + run])].append(k)
        self.terms = {t: j for j, t in enumerate(sorted(postings))}
        self.docs = [np.array([k for k, _ in postings[t]]) for t in self.terms]
        self.weights = [np.array([x for _, x in postings[t]]) for t in self.terms]
        self.most = np.array([w.max() for w in self.weights]) if self.terms else np.zeros(0)
        self.blocks = [{b: float(w[d // BLOCK == b].max()) for b in np.unique(d // BLOCK)} for d, w in zip(self.docs, self.weights, strict=True)]

    def wand(self, terms: list[int]) -> list[int]:
        """All items that score 1 or more for the distinct query terms."""
        eps = 1e-9
        found, at = [], {t: 0 for t in terms}
        while True:
            live = sorted((int(self.docs[t][at[t]]), t) for t in terms if at[t] < len(self.docs[t]))
            total, pivot = 0.0, None
            for k, (_, t) in enumerate(live):
                total += self.most[t]
                if total >= 1 - eps:
                    pivot = k
                    break
            if pivot is None:
                return found
            doc = live[pivot][0]
            block = doc // BLOCK
            here = [t for d, t in live if d <= doc]
            if sum(self.blocks[t].get(block, 0.0) for t in here) < 1 - eps:
                # no item of this block up to the next list's start can pass
                beyond = [d for d, _ in live if d > doc]
                nxt = min([(block + 1) * BLOCK, *beyond])
                for t in here:
                    at[t] = int(np.searchsorted(self.docs[t], nxt))
                continue
            if live[0][0] == doc:
                score = sum(float(self.weights[t][at[t]]) for t in here)
                if score >= 1 - eps:
                    found.append(doc)
                for t in here:
                    at[t] += 1
            else:
                for d, t in live[:pivot]:
                    if d < doc:
                        at[t] = int(np.searchsorted(self.docs[t], doc))

    def search(self, ws: list[str], ids: np.ndarray) -> set[int]:
        """Items of which a document (its words, and their term numbers or -1) holds a whole run."""
        n, run = len(ws), self.run
        if n < run or not self.items:
            return set()
        bound = np.concatenate([[0.0], np.cumsum(np.where(ids >= 0, self.most[ids], 0.0))])
        starts = np.arange(0, max(n - run, 0) + 1, run)
        ends = np.minimum(starts + 2 * run - 1, n)  # any run of the length lies in one of these windows
        out: set[int] = set()
        for s, e in zip(*(x[bound[ends] - bound[starts] >= 1 - 1e-9] for x in (starts, ends)), strict=True):
            terms = np.unique(ids[s:e])
            hits = self.wand([int(t) for t in terms if t >= 0])
            hits = [k for k in hits if k not in out]
            if hits:
                for p in range(s, e - run + 1):
                    got = self.grams.get(tuple(ws[p : p + run]))
                    if got:
                        out.update(k for k in got if k in hits)
        return out


    def overlap(self, ws: list[str], k: int) -> tuple[int, int, float, float | None]:
        """(words of the longest common run, words of the item in runs, shares of its question and its answer in them)."""
        w = self.items[k][1]
        asked = self.asked[k]
        held = {tuple(ws[p : p + self.run]) for p in range(len(ws) - self.run + 1)}
        inside = np.zeros(len(w), bool)
        longest = at = 0
        for p in range(len(w) - self.run + 1):
            if tuple(w[p : p + self.run]) in held:
                inside[p : p + self.run] = True
                at += 1
                longest = max(longest, at + self.run - 1)
            else:
                at = 0
        return longest, int(inside.sum()), float(inside[:asked].mean()), float(inside[asked:].mean()) if asked < len(w) else None


@lru_cache(4)
def index_of(items: tuple[tuple[int, str], ...], run: int) -> Index:
    return Index(items, run)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Documents of several batches together, up to a number of characters."""
    ids, texts, size = [], [], 0
    for b in batches:
        ids.append(b.column(0))
        texts += b.column(1).to_pylist()
        size += b.column(1).nbytes
        if size >= TOGETHER:
            yield pa.concat_arrays(ids), texts
            ids, texts, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), texts


def _matcher(parts: Callable[[], Iterator[Index]]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _stretches(batches):
            said = [words(t) if t else [] for t in texts]
            for index in parts():
                rows, hits, more = [], [], []
                get = index.terms.get
                for row, ws in enumerate(said):
                    if len(ws) < index.run:
                        continue
                    for k in index.search(ws, np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))):
                        rows.append(row)
                        hits.append(index.items[k][0])
                        more.append(index.overlap(ws, k))
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*more, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(hits, pa.int64()), *cols], names=["doc_id", "item_id", *_SHARES])

    return go


_SHARES = ("longest", "covered", "question", "answer")


def _indexed(run: int):
    def build(key: tuple, t: pa.Table) -> pa.Table:
        items = tuple(sorted(zip(t["i"].to_pylist(), t["t"].to_pylist(), strict=True)))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(Index(items, run))], pa.binary())})

    return build


def _stored(uri: str) -> Callable[[], Iterator[Index]]:
    """The parts of an index in the shared folder, one after the other."""

    def parts() -> Iterator[Index]:
        fs, path = pa_fs.FileSystem.from_uri(uri)
        for f in sorted(fs.get_file_info(pa_fs.FileSelector(path)), key=lambda x: x.path):
            if f.path.endswith(".parquet"):
                for group in pq.ParquetFile(fs.open_input_file(f.path)).iter_batches(batch_size=1):
                    for x in group.column("index"):
                        yield pickle.loads(x.as_py())

    return parts


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", run: int = RUN, part_items: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, longest, covered, question, answer): documents that hold `run` consecutive words of an item in its order.

    `longest` is the longest common run in words, `covered` how many of the
    item's words lie in common runs, `question` and `answer` the shares of its
    words up to its last question mark and after it that do; `answer` is null
    where nothing follows. Words are the longest runs of letters and digits,
    compared without case. Items shorter than that and null or empty texts match
    nothing; repeated rows and equal items count once per id, of several texts
    under one id the best covered. Every document is read whole and once, in
    place: nothing is shuffled but the few hits. An item table within the bounds
    of one part travels with the tasks; a larger one is indexed in parts on the
    executors and read from the shared folder.
    """
    rows = items.select(F.col(item).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    parts = max(-(-n // part_items), -(-chars // ITEM_CHARS), 1)
    if parts == 1:
        held = tuple(sorted((r["i"], r["t"]) for r in rows.collect()))  # at most part_items rows of ITEM_CHARS characters
        search = _matcher(lambda: iter((index_of(held, run),)))
    else:
        uri = f"{shared_dir(docs.sparkSession)}/leakage-{uuid.uuid4().hex}"
        keyed = rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(int(parts))).cast("int"))
        keyed.groupBy("part").applyInArrow(_indexed(run), "part int, index binary").write.parquet(uri)
        search = _matcher(_stored(uri))
    kind = docs.select(doc).schema[0].dataType.simpleString()
    texts = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("_t")).where("doc_id is not null and _t is not null")
    found = spread(texts).mapInArrow(search, f"doc_id {kind}, item_id bigint, longest int, covered int, question double, answer double")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "longest", "question", "answer")).alias("_r"))
    return best.select("doc_id", "item_id", *[f"_r.{c}" for c in _SHARES])
