"""What is learnt for 2 and 7 comes from every labelled sentence."""

import pytest

from lexiloom.llm import mojibake, queries


def test_contexts_are_those_of_all_sentences(spark):
    texts = [f"n {chr(0x100 + i)}{chr(0x4E00 + i)} x" for i in range(900)] + ["", None, "abc", "E\u0301t\u00e9"]
    got = mojibake.samples_of(spark.createDataFrame([("xx", t) for t in texts], "lang string, text string"))
    assert set(got.all) == mojibake.contexts(filter(None, texts)) and len(got.all) > 1700
    a, b = mojibake.Plausibility(got), mojibake.Plausibility([t for t in texts if t])
    assert (a.uni, a.bi, a.tri) == (b.uni, b.bi, b.tri)


@pytest.mark.parametrize("name", ["p2_found", "p7_found"])
def test_queries_learn_from_all_sentences(spark, data, monkeypatch, name):
    seen, real = [], mojibake.samples_of
    monkeypatch.setattr(mojibake, "samples_of", lambda df, **k: seen.append((df.count(), k)) or real(df, **k))
    queries.QUERIES[name](spark, data)
    assert seen == [(spark.read.parquet(f"{data}/lang_samples.parquet").count(), {})]
