"""Plans that stay small: how often the tables are moved, and how much a worker holds."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexiloom.operators import crf, evaluate, spans
from lexiloom.plans import by_document
from lexiloom.plans.pipeline import Corpus, Pipeline, get_module
from lexiloom.runtime import latest
from lexiloom.sources import sinks

EXCHANGES = {
    "export_html": 2,
    "read_json": 2,
    "evaluate_metrics": 6,
    "export_tei_analec": 2,
    "export_xml": 2,
    "read_gate": 2,
    "export_tei_reden": 2,
    "export_gate": 2,
    "read_xml": 2,
    "export_text": 2,
    "export_tei_np": 2,
    "export_json": 2,
    "evaluate_diff": 8,
    "evaluate_macro": 7,
}


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", EXCHANGES)
def test_tables_are_moved_once(spark, data, name):
    assert exchanges(entry.queries()[name](spark, data)) <= EXCHANGES[name]


def test_tags_at_ends_are_those_of_the_decoders(spark):
    marks = [["O", "B-a", "I-b", None, "I-c", "S-d", "I-d", "B-e"], ["I-a", "B-a", "B-b", "L-b", "I-b", "x", "U-c", "E-c"], [None, None, None, None, None, None, None, None]]
    pos = [["_A", "B", None, "_C", "_D", None, None, None], [None, "A", "B", "_", "_B", None, "_C", "D"], ["A", "_B", "C", None, None, "_D", "_", "E"]]
    rows = [(1, s, p, 8 * s + p, 10 * (8 * s + p), 10 * (8 * s + p) + 9, m, q) for s, (ms, qs) in enumerate(zip(marks, pos)) for p, (m, q) in enumerate(zip(ms, qs))]
    t = spark.createDataFrame(rows, "doc_id int, sent int, pos int, tok int, lb int, ub int, c string, p string")
    both = spans.tags_at_ends(t, {"x": ("c", "chunk"), "y": ("p", "pos")})
    for name, want in (("x", spans.decode_chunks(t, "c")), ("y", spans.decode_pos(t, "p"))):
        got = sorted(tuple(r) for r in both.where(f"{name} is not null").select(f"{name}.value", f"{name}.tlb", f"{name}.tub", f"{name}.lb", f"{name}.ub").collect())
        assert got == sorted((r["value"], 8 * r["sent"] + r["lb"], 8 * r["sent"] + r["ub"], 10 * (8 * r["sent"] + r["lb"]), 10 * (8 * r["sent"] + r["ub"] - 1) + 9) for r in want.collect())


def test_equal_tags_are_counted_and_pairs_follow(spark):
    gold = spark.createDataFrame([(1, 0, 2, "a")] * 3 + [(1, 4, 6, None), (2, 0, 1, "b")], "doc_id int, lb int, ub int, value string")
    guess = spark.createDataFrame([(1, 0, 2, "a")] * 2 + [(1, 0, 2, "b"), (1, 4, 6, ""), (3, 0, 1, "b")], "doc_id int, lb int, ub int, value string")
    p = evaluate.pairs(gold, guess)
    assert exchanges(p) == 1
    got = sorted((r["doc_id"], r["kind"], r["gold_value"], r["guess_value"]) for r in p.collect())
    assert got == [(1, "correct", "", ""), (1, "correct", "a", "a"), (1, "correct", "a", "a"), (1, "type", "a", "b"), (2, "silence", "b", None), (3, "noise", None, "b")]


def test_characters_by_document_are_those_of_the_joins(spark):
    t = spark.createDataFrame([(d, i, 5 * i, 5 * i + 4) for d in (1, 2) for i in (0, 1, 2, 4)], "doc_id int, tok int, lb int, ub int")
    tags = spark.createDataFrame([(1, 0, 2, "a"), (1, 0, 2, "a"), (1, 3, 5, "b"), (1, 2, 4, "b"), (2, 4, 5, "c"), (3, 0, 1, "d"), (2, 1, 9, "e")], "doc_id int, lb int, ub int, value string")
    want = spans.to_characters(tags, t).select("doc_id", "clb", "cub", "value").collect()
    assert sorted(map(tuple, spans.characters_by_document(tags, t).collect())) == sorted(map(tuple, want))


LOADED = [n for n in EXCHANGES if n.startswith(("export_", "read_"))]


@pytest.mark.parametrize("name", LOADED)
def test_loaded_rows_move_once_and_nothing_is_gathered_in_the_plan(spark, data, name):
    df = entry.queries()[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert exchanges(df) == 1 and not any(x in plan for x in ("Window", "Aggregate", "collect_list"))


def test_loaded_rows_are_bundled_like_the_last_rows(spark):
    rng = random.Random(7)
    any_of = lambda *x: rng.choice(x)
    toks = [(d, any_of("a", None, "b"), 0, k // 4, k % 4, k, 5 * k, 5 * k + 4, any_of("é", "x", None), any_of("N", "_N", "V", None), any_of("B-NP", "I-NP", "O", None, "S-X"), any_of("B-é", "L-é", "O", "U-p", "B", ""), any_of(1, 2, None)) for d in (1, 2, 3, 5) for k in range(rng.choice((1, 9, 30))) for _ in range(any_of(1, 1, 3))]
    toks += [(None, *toks[0][1:]), (9, *toks[0][1:])]
    docs = [(d, any_of("n", None), any_of("s", None), any_of("text", None, "other") and "t" * 200 + str(k), any_of(1, 2, None)) for d in (None, 1, 2, 3, 4, 5) for k in range(3)]
    t = spark.createDataFrame(toks, "doc_id bigint, source string, par int, sent int, pos int, tok int, lb int, ub int, word string, pos_tag string, chunk string, ner string, loaded_at int")
    d = spark.createDataFrame(docs, "doc_id bigint, name string, source string, content string, loaded_at int")
    layers = {"ner": ("ner", "chunk"), "chunk": ("chunk", "chunk"), "pos": ("pos_tag", "pos")}
    last = latest(t, ["doc_id", "tok"], "loaded_at", [c for c in t.columns if c != "loaded_at"])
    at = spans.tags_at_ends(last, {f"_{k}": x for k, x in layers.items()})
    tags = None
    for k in layers:
        x = at.where(f"_{k} is not null").select("doc_id", F.lit(k).alias("layer"), f"_{k}.*")
        tags = x if tags is None else tags.unionByName(x)
    bundled = sinks.bundle(latest(d, ["doc_id"], "loaded_at", ["doc_id", "name", "source", "content"]), last, tags).persist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for fmt in ("json", "text"):
            want = {tuple(r) for r in sinks.export(bundled, fmt).where("doc_id is not null").collect()}
            got = sinks.export_loaded(sinks.loaded(d, t, layers, "loaded_at"), layers, fmt, "loaded_at").collect()
            assert len(got) == 5 and {tuple(r) for r in got} == want, fmt
            inner = sinks.export_loaded(sinks.loaded(d, t, layers, "loaded_at"), layers, fmt, "loaded_at", "inner").collect()
            assert {tuple(r) for r in inner} == {r for r in want if r[0] != 4}, fmt
    finally:
        bundled.unpersist()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_weights_never_come_to_the_driver(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("rows came to the driver")

    rows = [(1, s, p, [f"u:{s * p}", "u:all"], "A" if (s + p) % 3 else "B") for s in range(4) for p in range(3)]
    o = spark.createDataFrame(rows, "doc_id int, sent int, pos int, obs array<string>, g string")
    with monkeypatch.context() as m:
        m.setattr(type(o), "collect", refused)
        m.setattr(type(o), "toPandas", refused)
        m.setattr(crf, "WEIGHTS", 3)
        w = crf.train(o, "g", ["A", "B"], [], rounds=3)
    got = {(r["kind"], r["obs"], r["y_prev"], r["y"]): r["w"] for r in w.collect()}
    assert len(got) == 2 * 7 + 4 and got["u", "u:all", None, "A"] > 0 > got["u", "u:all", None, "B"]
    assert got["u", "u:all", None, "A"] == pytest.approx(-got["u", "u:all", None, "B"])


def test_labels_by_stored_weights_are_those_of_the_joins(spark):
    rows = [(1, s, p, [f"u:{s * p % 4}", "u:all", f"b:{p % 2}"]) for s in range(5) for p in range(s + 1)]
    o = spark.createDataFrame(rows, "doc_id int, sent int, pos int, obs array<string>")
    w = [("u", f"u:{i}", None, y, float((3 * i + len(y) * 5) % 7) / 4) for i in (0, 1, 3) for y in ("A", "BB", "other")] + [("b", "b:1", x, y, float(len(x + y) % 3) / 2) for x in ("A", "BB", "other") for y in ("A", "BB")]
    w = spark.createDataFrame(w, "kind string, obs string, y_prev string, y string, w double")
    got = crf.label_stored(o, w, ["A", "BB"])
    assert exchanges(got) == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, crf.label_scored(o, w, ["A", "BB"]).collect()))


def test_viterbi_moves_tokens_once_a_pass(spark, data):
    assert exchanges(entry.queries()["crf_viterbi"](spark, data)) == 1


def test_pipeline_moves_documents_once_and_no_tokens(spark, data):
    df = entry.queries()["pipeline_run"](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert exchanges(df) == 1 and plan.count("MapInArrow") <= 2 and not any(x in plan for x in ("Join", "Window", "Generate"))


LEXICON = [("a", 2, "Jean Dupont", "P"), ("a", 1, "Dupont", ""), ("b", None, "Jean  Dupont", "Q"), ("b", 1, "Paris", "L"), ("c", 1, "Paris", "M"), ("c", 3, "la Seine", "W"), ("c", 3, "Seine", "R"), ("a", 1, " ", "X"), (None, 1, None, "X"), ("d", 1, "à Paris sur", "S"), ("d", 1, "?", None), ("e", 1, "b\x01c", "Z"), ("e", 1, "rue de la", "V")]
TEXTS = [
    "Jean Dupont vit à Paris sur la Seine. Dupont et Jean Dupont ? Oui !\n\nParis\n\n\nla Seine la « Seine. Ah » (Paris. Non ) Dupont.. La rue de la Seine… Jean\u2028Dupont",
    "", None, " \n ", "Paris", "?!? ...x . . Dupont . ) . Paris", "b\x01c b\x01c Seine b c. Jean\n\n.\n\nDupont.\n\nParis", "<p>Jean Dupont</p><p>Paris &nbsp;Seine</p> Paris", "www.a.fr/Paris. Dupont's l’eau, -t-il vit-il 3km e.g. M. Dupont",
]


@pytest.mark.parametrize(("fmt", "how", "first"), [("text", "overriding", {"tokeniser": "fr"}), ("json", "non-overriding", {"tokeniser": "en"}), ("json", "overriding", {"html": "yes"}), ("xml", "overriding", {"tokeniser": "fr_bounds"})])
def test_one_pass_gives_what_the_modules_give(spark, monkeypatch, fmt, how, first):
    rng = random.Random(3)
    words = "Jean Dupont Paris la Seine à sur rue de . . ? … « » ( ) \n \n\n b\x01c b x".split(" ")
    texts = TEXTS + [rng.choice(("", " ")).join(x + rng.choice(("", " ")) for x in rng.choices(words, k=60)) for _ in range(30)]
    docs = spark.createDataFrame([(i if i else None, None if i % 3 else f"n{i}", t) for i, t in enumerate(texts)], "doc_id bigint, name string, content string")
    lex = spark.createDataFrame(LEXICON, "dict string, priority int, entry string, mapped string")
    steps = [("segmentation", first), ("lexicon", {"lexicon": lex, "field": "ner"}), ("label_consistency", {"field": "ner", "label_consistency": how})]
    c, p = Corpus(docs), Pipeline()
    for name, options in steps:
        p.append(name, **options)
        c = get_module(name)(c, **options)
        c = replace(c, tokens=spark.createDataFrame(c.tokens.collect(), c.tokens.schema).coalesce(1))  # else the plan grows with every module
    want = {tuple(r) for r in get_module("export")(c, format=fmt, chunking="ner").collect()}
    p.append("export", format=fmt, chunking="ner")
    df = p(Corpus(docs))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(texts) and set(got) == want
    monkeypatch.setattr(by_document, "ENTRIES", 3)
    assert "Join" in Pipeline().append(*steps[0][:1], **first).append("lexicon", lexicon=lex).append("export", format=fmt)(Corpus(docs))._jdf.queryExecution().executedPlan().toString()
