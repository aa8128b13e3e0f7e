"""Bad rows and nested records: nulls, repeats, ties, odd shapes, brute force."""

import json

import pytest

from lexiloom.operators import badrows, nested

TAGS = ["Person", "Location"]


RULES = badrows.LineRules(frozenset(TAGS))


@pytest.mark.parametrize(("line", "reason"), [
    ("0\t1\tLe\t0\t2\tO", None), ("", None), ("# x\ty", None), ('0\t1\t"Le"\t0\t2\tO', None), ('0\t1\t"a\tb"\t0\t3\tO', None), ('0\t1\t""""\t0\t1\tO', None),
    ('0\t1\t"Le\t0\t2\tO', "quoting"), ('0\t1\t"Le"x\t0\t2\tO', "quoting"), ('0\t1\t"Le" \t0\t2\tO', "quoting"), ('0\t1\tL"e\t0\t3\tO', "quoting"), ('0\t1\tLe\t0\t2\tO"', "quoting"), ('"', "quoting"),
    ("0\t1\tLe\t0\t2", "columns"), ("0\t1\tLe\t0\t2\tO\t", "columns"), ("0,1,Le,0,2,O", "columns"), (" ", "columns"), (None, "columns"), ("\t#", "columns"),
    ("x\t1\tLe\t0\t2\tO", "value"), ("-1\t1\tLe\t0\t2\tO", "value"), ("٣\t1\tLe\t0\t2\tO", "value"), ("\t1\tLe\t0\t2\tO", "value"), ("0\t1\t\t0\t0\tO", "value"), ("0\t1\t \t0\t1\tO", "value"), ("0\t1\t​\t0\t1\tO", "value"),
    ("0\t1\tLe\t0\t3\tO", "value"), ("0\t1\tLe\t2\t0\tO", "value"), ("0\t1\tLe\t0\t2\tB-Person", None), ("0\t1\tLe\t0\t2\tI-Location", None), ("0\t1\tLe\t0\t2\tB-person", "value"), ("0\t1\tLe\t0\t2\tPerson", "value"), ("0\t1\tLe\t0\t2\t", "value"),
    ("0\t1\t👩‍🌾\t0\t3\tO", None), (f"{'9' * 30}\t1\tLe\t0\t2\tO", None),
])
def test_diagnosis(line, reason):
    assert RULES.diagnose(line)[0] == reason


def test_numbers_of_any_length(spark):
    long = "7" * 6000
    lines = [f"{long}\t1\tLe\t{long}\t{long[:-1]}9\tO", f"0\t1\tLe\t{long}\t{long}\tO", f"{'0' * 5000}3\t1\tLe\t0\t2\tO", f"9223372036854775808\t1\tLe\t0\t2\tO"]
    got = {r["line_id"]: r for r in badrows.parse_lines(spark.createDataFrame(list(enumerate(lines)), "line_id bigint, raw string"), "line_id", "raw", []).collect()}
    assert [got[i]["reason"] for i in range(4)] == [None, "value", None, None]
    assert json.loads(got[0]["beyond"]) == {"sent": long, "lb": long, "ub": long[:-1] + "9"} and got[0]["sent"] is None and got[0]["pos"] == 1
    assert (got[2]["sent"], got[2]["beyond"]) == (3, None) and json.loads(got[3]["beyond"]) == {"sent": "9223372036854775808"}


def test_only_doubtful_lines_are_read_strictly(monkeypatch, data):
    import pyarrow as pa
    import pyarrow.parquet as pq

    raw = [x for x in pq.read_table(f"{data}/conll_lines.parquet", columns=["raw"])["raw"].to_pylist() if x and not x.startswith("#")]
    sound, t = badrows.fast_parse(pa.array(raw), pa.array(["O", *(p + x for x in TAGS for p in ("B-", "I-"))]))
    rules = badrows.LineRules(frozenset(TAGS))
    good = [rules.diagnose(x)[0] is None for x in raw]
    doubtful = badrows.isolate(sound)
    assert doubtful == [i for i, x in enumerate(sound) if not x] and t.num_rows == sum(sound)
    assert all(g for g, s in zip(good, sound, strict=True) if s)
    assert sum(good[i] for i in doubtful) < 0.02 * sum(good)


def test_bulk_path_agrees(spark, data):
    rows = spark.read.parquet(f"{data}/conll_lines.parquet")
    got = {r["line_id"]: r["reason"] for r in badrows.parse_lines(rows, "line_id", "raw", TAGS, "received_at").collect()}
    for r in rows.select("line_id", "raw").collect():
        reason, row = RULES.diagnose(r["raw"])
        assert got.get(r["line_id"], "skip") == (reason if reason or row else "skip"), r


def test_rows_cases(spark):
    rows = [(1, "0\t1\tLe\t0\t2\tO", 1), (1, "bad", 2), (2, None, 1), (3, "", 1), (4, '0\t1\t"x""y"\t0\t3\tO', None), (5, "a" * 100_000, 1)]
    df = spark.createDataFrame(rows, "line_id int, raw string, at int").selectExpr("*", "'z' as reason", "9 as word")
    valid, failed = badrows.split_rows(badrows.parse_lines(df, "line_id", "raw", TAGS, "at"))
    assert [(r["line_id"], r["word"], r["ub"]) for r in valid.collect()] == [(4, 'x"y', 3)]
    assert sorted((r["line_id"], r["reason"]) for r in failed.collect()) == [(1, "columns"), (2, "columns"), (5, "columns")]
    assert badrows.parse_lines(df.limit(0), "line_id", "raw", []).count() == 0


def tag(v, s, n):
    return {"v": v, "s": s, "l": n}


def test_nested_shapes(spark):
    doc = {"name": "a", "content": "x", "segmentations": {"tokens": {"spans": [{"s": 0, "l": 1}, [1, 2]]}, "sentences": {"reference": {"name": "tokens"}, "spans": [[0, 2]]}, "none": {"spans": None}},
           "annotations": [{"name": "NER", "reference": None, "annotations": [{"v": "P", "fragments": [{"s": 0, "l": 1}, {"s": 2, "l": 1}], "attributes": [{"k": "links", "v": [{"s": 1}]}]}, tag("L", 1, 1)]}]}
    coded = {**doc, "annotations": json.dumps({"NER": {"annotations": [tag("Q", 0, 1)]}})}
    rows = [(1, json.dumps(doc)), (2, json.dumps({"corpora": [{"name": "c", "documents": [doc, {"content": ""}]}, {"documents": [coded]}]})), (3, "{broken"), (4, None), (5, "[]"), (1, json.dumps(doc)), (6, json.dumps({"sem": {"version": 1, "documents": [coded]}}))]
    df = spark.createDataFrame(rows, "record_id bigint, payload string").selectExpr("*", "0 as doc_idx", "'k' as kind")
    got = [tuple(r) for r in nested.flatten(df, "item").select("record_id", "doc_idx", "kind", "layer", "reference", "item_idx", "frag_idx", "value", "s", "l").collect()]
    one = {("segmentation", "tokens", "", 0, 0, None, 0, 1), ("segmentation", "tokens", "", 1, 0, None, 1, 2), ("segmentation", "sentences", "tokens", 0, 0, None, 0, 2)}
    tags = {("annotation", "NER", "", 0, 0, "P", 0, 1), ("annotation", "NER", "", 0, 1, "P", 2, 1), ("annotation", "NER", "", 1, 0, "L", 1, 1)}
    assert {x[2:] for x in got if x[0] == 1} == one | tags
    assert len([x for x in got if x[0] == 1]) == 6
    assert {x[1] for x in got if x[0] == 2} == {0, 2}
    assert {x[2:] for x in got if x[0] == 6 and x[2] == "annotation"} == {("annotation", "NER", "", 0, 0, "Q", 0, 1)}
    assert {x[0] for x in got} == {1, 2, 6}
    docs = nested.flatten(df, "document").collect()
    assert len([r for r in docs if r["record_id"] == 2]) == 3
    layers = nested.flatten(df, "layer").where("record_id = 1").collect()
    assert {(r["layer"], r["items"]) for r in layers} == {("tokens", 2), ("sentences", 1), ("none", 0), ("NER", 2)}
    assert nested.flatten(df.limit(0), "item").count() == 0


def test_variants_depend_on_children():
    root = [{"spans": 5}, {"spans": [[1, 2]]}]
    a = nested.Automaton(root)
    assert [a.of(x) for x in root] == ["layer_spans(int)", "layer_spans(list(extent_pair))"]
    root = [{"annotations": [{"v": "P", "s": 0, "l": 1}]}, {"annotations": {"NER": {"annotations": []}}}, {"annotations": [{"name": "NER", "annotations": []}]}]
    a = nested.Automaton(root)
    assert [a.of(x).split("(")[0] for x in root] == ["layer_tags", "document", "document"]


def test_subtype_tables_text_in_text_and_big_numbers(spark):
    items = [[0, 1], {"s": 2, "l": 1}, {"v": "P", "s": 3, "l": 2**70}, {"v": "Q", "fragments": [[1, 1], {"s": 4, "l": 2}]}, "x", {"v": "R", "fragments": 5}]
    layer = {"reference": "tokens", "annotations": items}
    for _ in range(6):
        layer = json.dumps(layer)
    container = {"NER": layer}
    for _ in range(5):
        container = json.dumps(container)
    df = spark.createDataFrame([(1, json.dumps({"content": "c", "annotations": container}))], "record_id bigint, payload string")
    got = {r["variant"]: [] for r in nested.flatten(df, "item").collect()}
    for r in nested.flatten(df, "item").orderBy("item_idx", "frag_idx").collect():
        got[r["variant"]].append((r["item_idx"], r["frag_idx"], r["value"], r["s"], r["l"], r["beyond"]))
    assert got == {
        "extent_pair": [(0, 0, None, 0, 1, None)], "extent_object": [(1, 0, None, 2, 1, None)],
        "tag": [(2, 0, "P", 3, None, json.dumps({"l": 2**70}))], "tag_fragmented": [(3, 0, "Q", 1, 1, None), (3, 1, "Q", 4, 2, None)],
    }
    for variant, columns in nested.ITEMS.items():
        table = nested.flatten(df, variant)
        assert table.columns == ["record_id", "doc_idx", "kind", "layer", "reference", "item_idx", *columns, "beyond"] and table.count() == len(got[variant])


def test_multiword_entries_of_any_length_and_kind(spark, tmp_path):
    from lexiloom.queries import ops

    said = [("the old mill race inn is shut", "O B-Place I-Place I-Place I-Place O O"), ("at the Zap Pro now", "O O B-Product I-Product O"), ("no old mill race inn or Zap Pro", "O O O O O O O O")]
    rows = [(1, k, i, i + 10 * k, w, n) for k, (x, y) in enumerate(said) for i, (w, n) in enumerate(zip(x.split(), y.split(), strict=True))]
    t = spark.createDataFrame(rows, "doc_id bigint, sent int, pos int, tok int, word string, ner string")
    t.selectExpr("*", "'a' as source", "0 as par", "pos as lb", "pos + 1 as ub", "'N' as pos_tag", "'O' as chunk", "timestamp'2024-01-01' as loaded_at").write.parquet(f"{tmp_path}/sem_tokens.parquet")
    got = {r["tok"]: r["value"] for r in ops.dict_multiword_last(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(20, 28)] == ["O", "B-x", "I-x", "I-x", "I-x", "O", "B-x", "I-x"]


def test_words_of_hangul_fillers_are_blank_whatever_their_neighbours(spark):
    from lexiloom.operators import badrows

    words = ["mot"] * 30 + ["\u3164", "\u115f\u1160", "\uffa0", "\u3164가"] + ["mot"] * 30
    rows = [(i, f"0\t{i}\t{w}\t0\t{len(w)}\tO") for i, w in enumerate(words)]
    got = badrows.parse_lines(spark.createDataFrame(rows, "line_id bigint, raw string").coalesce(1), "line_id", "raw", ["Person"])
    assert sorted(map(tuple, got.where("reason is not null").select("line_id", "reason").collect())) == [(30, "value"), (31, "value"), (32, "value")]


def test_tokenisers_and_pipeline_run_on_all_documents(spark, data, tmp_path):
    import os

    from lexiloom.queries import formats, ops

    labels = ["fr", "FR", "fra", "français", "en", "xx", None]
    docs = spark.createDataFrame([(i, "Le canal est ouvert.", x) for i, x in enumerate(labels)], "doc_id bigint, content string, lang string")
    docs.selectExpr("*", "concat('d', doc_id) as name", "'a' as source", "'text/plain' as mime", "timestamp'2024-01-01' as loaded_at").write.parquet(f"{tmp_path}/sem_documents.parquet")
    os.symlink(f"{data}/sem_lexicon.parquet", f"{tmp_path}/sem_lexicon.parquet")
    for q in (ops.tok_fr, ops.tok_fr_bounds, ops.tok_en, formats.pipeline_run):
        assert {r["doc_id"] for r in q(spark, str(tmp_path)).select("doc_id").distinct().collect()} == set(range(len(labels))), q.__name__
