"""Command line, evaluation from files, lexica to tables and back, filters by name."""

import pytest

from lexiloom.__main__ import main, parser
from lexiloom.plans import modules


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_evaluation_from_files(spark, tmp_path):
    write(tmp_path / "gold/a.conll", "Ana\tB-P\nva\tO\nà\tO\nPau\tB-L\n\nUn\tO\nThé\tB-P\n")
    write(tmp_path / "guess/a.conll", "Ana\tB-P\nva\tO\nà\tO\nPau\tB-P\n\nUn\tO\nThé\tO\n")
    got = {r["entity"]: r for r in modules.evaluated(spark, f"{tmp_path}/gold", f"{tmp_path}/guess").collect()}
    assert (got["global"]["precision"], round(got["global"]["recall"], 4)) == (0.5, 0.3333)
    write(tmp_path / "bg/x.ann", "T1\tP 0 3\tAna\nT2\tL 9 12\tPau\n")
    write(tmp_path / "xg/x.xml", '<document name="x"><content>Ana va à Pau</content><annotations><annotation name="ner"><tag v="P" s="0" l="3"/><tag v="L" s="9" l="3"/></annotation></annotations></document>')
    got = {r["entity"]: r["f"] for r in modules.evaluated(spark, f"{tmp_path}/bg", f"{tmp_path}/xg", "brat", "xml").collect()}
    assert got == {"P": 1.0, "L": 1.0, "global": 1.0}
    with pytest.raises(ValueError):
        modules.evaluated(spark, "", "", "nope")


def test_lexica_there_and_back(spark):
    entries = spark.createDataFrame([("le  lac", "b"), ("le lac", "a"), (" ", "x"), (None, "y"), ("Pau", None)], "entry string, mapped string")
    for kind in ("token", "multiword"):
        assert sorted(r["entry"] for r in modules.decompiled(modules.compiled(entries, kind)).collect()) == ["Pau", "le lac"]
    assert sorted(map(tuple, modules.decompiled(modules.compiled(entries, "map", nocase=True)).collect())) == [("le lac", "a"), ("pau", "")]
    with pytest.raises(ValueError):
        modules.compiled(entries, "tree")


def test_filters_by_name(spark):
    docs, tags = spark.createDataFrame([(1,), (2,)], "doc_id int"), spark.createDataFrame([(1, 0, 4, "a"), (1, 1, 2, "b")], "doc_id int, lb int, ub int, value string")
    got = {n: sorted(r["doc_id"] for r in f(docs, tags).select("doc_id").collect()) for n, f in modules.DOCUMENT_FILTERS.items()}
    assert got == {"all": [1, 2], "with annotations": [1], "without annotations": [2]}
    assert [r["value"] for r in modules.filter_named(modules.TAG_FILTERS, "top level")(tags).collect()] == ["a"]
    with pytest.raises(ValueError):
        modules.filter_named(modules.TAG_FILTERS, "none")


def test_command_line(spark, tmp_path, capsys):
    assert main(["modules"]) == 0
    assert "segmentation" in capsys.readouterr().out
    write(tmp_path / "words.txt", "le lac\tmer\nPau\tville\n")
    assert main(["compile_dictionary", f"{tmp_path}/words.txt", f"{tmp_path}/lex", "-k", "map"]) == 0
    assert main(["decompile_dictionary", f"{tmp_path}/lex", f"{tmp_path}/back"]) == 0
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/back").collect()) == ["Pau\tville", "le lac\tmer"]
    write(tmp_path / "in/d.txt", "Le lac est calme. Pau dort !")
    write(tmp_path / "master.xml", '<master><pipeline><segmentation tokeniser="fr"/><export format="text"/></pipeline></master>')
    assert main(["tagger", f"{tmp_path}/master.xml", f"{tmp_path}/in", f"{tmp_path}/out"]) == 0
    assert [r["payload"] for r in spark.read.json(f"{tmp_path}/out").collect()] == ["Le lac est calme .\nPau dort !"]
    write(tmp_path / "c/d.conll", "Le\tO\nlac\tO\n")
    write(tmp_path / "e.xml", '<information><entries><before><entry name="word"/><entry name="ner"/></before><after/></entries><features><nullary name="low" action="lower"/></features></information>')
    assert main(["enrich", f"{tmp_path}/c", f"{tmp_path}/e.xml", f"{tmp_path}/eo", "--fields", "word,ner"]) == 0
    assert [r["payload"] for r in spark.read.json(f"{tmp_path}/eo").collect()] == ["Le\tO\tle\nlac\tO\tlac"]
    with pytest.raises(SystemExit):
        parser().parse_args(["nope"])
