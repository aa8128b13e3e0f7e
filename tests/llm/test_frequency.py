"""Term counts: brute force, nulls, repeats, hot keys, documents longer than a part."""

from collections import Counter, defaultdict

import pytest

from lexiloom.llm import frequency


def test_frequency_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/sem_tokens.parquet")
    got = {r["term"]: (r["occurrences"], r["documents"], r["mark"]) for r in frequency.term_frequency(rows, "doc_id", "tok", "word", heavy_limit=50).collect()}
    once = {(r["doc_id"], r["tok"]): r["word"] for r in rows.select("doc_id", "tok", "word").collect()}
    occ, docs = Counter(w for w in once.values() if w is not None), defaultdict(set)
    for (d, _), w in once.items():
        docs[w].add(d)
    n = len({d for d, _ in once})
    want = {w: (c, len(docs[w]), "rare" if len(docs[w]) < 3 else "common" if 5 * len(docs[w]) > n else None) for w, c in occ.items()}
    assert got == want


@pytest.mark.parametrize("heavy", [0, 1, 1000])
def test_frequency_cases(spark, heavy):
    rows = [(1, 0, "a"), (1, 0, "a"), (1, 1, "a"), (2, 0, None), (3, 0, ""), (4, 0, "A"), (None, 0, "a"), (5, None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, tok int, word string").selectExpr("*", "'x' as term", "1 as occurrences")
    got = {r["term"]: (r["occurrences"], r["documents"], r["total_documents"], r["mark"]) for r in frequency.term_frequency(df, "doc_id", "tok", "word", heavy_limit=heavy).collect()}
    assert got == {"a": (3, 2, 5, "rare"), "": (1, 1, 5, "rare"), "A": (1, 1, 5, "rare")}


def test_frequency_empty_and_hot(spark):
    empty = spark.createDataFrame([], "doc_id bigint, tok int, word string")
    assert frequency.term_frequency(empty, "doc_id", "tok", "word").count() == 0
    hot = spark.range(30_000).selectExpr("id % 7 as doc_id", "cast(id as int) as tok", "case when id % 3 = 0 then 'hot' else cast(id as string) end as word")
    got = frequency.term_frequency(hot, "doc_id", "tok", "word", heavy_limit=5).where("term = 'hot'").first()
    assert (got["occurrences"], got["documents"], got["mark"]) == (10_000, 7, "common")


def test_last_load_counts(spark):
    rows = [(1, 0, "old", 1), (1, 0, "new", 2), (1, 1, "x", 1), (1, 1, None, 3), (2, 0, "new", None), (2, 0, "old", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, tok int, word string, at int")
    got = {r["term"]: (r["occurrences"], r["documents"]) for r in frequency.term_frequency(df, "doc_id", "tok", "word", "at").collect()}
    assert got == {"new": (1, 1), "old": (1, 1)}


@pytest.mark.parametrize("heavy", [0, 3])
def test_long_documents_and_text_keys(spark, heavy):
    """Parts of a document count its terms once; a document sent many times is one document."""
    rows = [(f"d{d}", i, f"w{(i * (d + 3)) % 11}é" if (i + d) % 7 else None) for d in range(6) for i in range(40 if d % 2 else 5)]
    df = spark.createDataFrame(rows * 5, "doc_id string, tok int, word string").repartition(5)
    got = {r["term"]: (r["occurrences"], r["documents"]) for r in frequency.term_frequency(df, "doc_id", "tok", "word", heavy_limit=heavy, part=8).collect()}
    occ, docs = Counter(w for *_, w in rows if w), defaultdict(set)
    for d, _, w in rows:
        docs[w].add(d)
    assert got == {w: (c, len(docs[w])) for w, c in occ.items()}
