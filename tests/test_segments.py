"""Tokenisers, tags, consistency, evaluation, readers and exporters on small inputs."""

import re

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import consistency, evaluate, search, segment, spans
from lexiloom.plans.pipeline import Corpus, Pipeline, truth
from lexiloom.sources import readers, sinks

FRENCH = """Le 3 juin, qu'a-t-il vu chez Mme. Orsel, au no 12bis ? Rien : 4,75 % de moins (cf. p. 8)...

Voyez https://halle.example/plan/quai.html, ou l'adresse greffe@ville.example. Celle-ci marche « très bien »

Le porte-clés est là
"""


def test_french_bounds():
    got = [FRENCH[a:b] for a, b in segment.fr_bounds(FRENCH)]
    first = ["Le", "3", "juin", ",", "qu'", "a", "-t-il", "vu", "chez", "Mme.", "Orsel", ",", "au", "no", "12", "bis", "?", "Rien", ":", "4,75", "%", "de", "moins", "(", "cf", ".", "p", ".", "8", ")", "..."]
    second = ["Voyez", "https://halle.example/plan/quai.html", ",", "ou", "l'", "adresse", "greffe@ville.example", ".", "Celle-ci", "marche", "«", "très", "bien", "»"]
    assert got == [*first, *second, "Le", "porte-clés", "est", "là"]


@pytest.mark.parametrize("name", sorted(segment.TOKENISERS))
def test_no_loss(name):
    cut = segment.get_tokeniser(name)
    for text in (FRENCH, "You'd  say the mill's 3.5 miles off,\n\nwouldn't you?", "", "   ", "a", "(a,b)", "x" * 5000):
        parts = cut(text)
        assert "".join(text[a:b] for a, b in parts) == re.sub(r"\s", "", text)
        assert all(a < b for a, b in parts) and all(x[1] <= y[0] for x, y in zip(parts, parts[1:]))


def test_pipeline_french_keeps_titles_whole():
    t = "Hier m. K. vit Ste-Anne, pense-t-elle"
    assert [t[a:b] for a, b in segment.fr_spans(t)] == ["Hier", "m.", "K.", "vit", "Ste-Anne", ",", "pense", "-t-elle"]


@pytest.mark.parametrize(("text", "parts"), [
    ("celle-ci prends-en homme-là", ["celle-ci", "prends-en", "homme-là"]), ("Mmes. Mlles. Mr. i.e. c-à-d", ["Mmes.", "Mlles.", "Mr.", "i.e.", "c-à-d"]),
    ("vient-il va-t-on", ["vient", "-il", "va", "-t-on"]), ("5km a=b 7,5 fin,", ["5", "km", "a", "=", "b", "7,5", "fin", ","]), ("l’ami", ["l’", "ami"]),
])
def test_french_chunks(text, parts):
    assert [text[a:b] for a, b in segment.fr_spans(text)] == parts


def sentences(spark, text, variant, cut):
    t = segment.tokenise(spark.createDataFrame([(1, text)], "doc_id bigint, content string"), cut, gaps=True)
    rows = segment.sentence_ids(t, variant).orderBy("tok").collect()
    return [" ".join(r["word"] for r in rows if r["sent"] == k) for k in sorted({r["sent"] for r in rows})]


def test_sentence_ends(spark):
    text = "Titre du jour\n\nIl part (à pied. Ou non). Fin\nde ligne ! Bien…\n\nSuite"
    assert sentences(spark, text, "fr", "fr_bounds") == ["Titre du jour", "Il part ( à pied . Ou non ) .", "Fin de ligne !", "Bien …", "Suite"]
    # without the rule of empty lines; what a bracket holds ends nothing
    assert sentences(spark, "A title\n\nHe left (on foot. Or not). Why?! So", "en", "en") == ["A title He left ( on foot . Or not ) .", "Why ?", "!", "So"]
    lines = spark.createDataFrame([(1, i, w) for i, w in enumerate(["a", "b", "\n", "\n", "c", None])], "doc_id int, tok int, word string")
    assert [r["sent"] for r in segment.sentence_ids(lines, "default").orderBy("tok").collect()] == [0, 0, None, None, 2, 2]
    with pytest.raises(ValueError):
        segment.sentence_ids(lines, "xx")


def test_unknown_names():
    for f in (segment.get_tokeniser, sinks.get_exporter):
        with pytest.raises(ValueError):
            f("none")


def test_whitespace_tokens(spark):
    d = spark.createDataFrame([(1, "a  👩‍🌾b\n"), (2, None), (3, ""), (4, " \t")], "doc_id bigint, content string")
    got = [tuple(r) for r in segment.whitespace_tokens(d).orderBy("doc_id", "tok").collect()]
    assert got == [(1, 0, 0, 1, "a"), (1, 1, 3, 7, "👩‍🌾b")]


def test_markup():
    html = "<html><head>t</head><h1>A</h1>x<p>b&nbsp;<b>c</b></p>y</html>"
    out = segment.blanked(html)
    assert len(out) == len(html) and out.split() == ["A", "b", "c"] and out.index("A") == html.index("A<")
    assert segment.blanked("<div>no</div>") == "" and segment.blanked(None) is None


def tokens(spark, cols, name="ner"):
    return spark.createDataFrame([(0, s, p, w, v) for s, p, w, v in cols], f"doc_id bigint, sent int, pos int, word string, {name} string")


@pytest.mark.parametrize(("tags", "want"), [
    ("B-X I-X O B-Y", [("X", 0, 2), ("Y", 3, 4)]), ("S-X B-Y I-Y E-Y", [("X", 0, 1), ("Y", 1, 4)]), ("U-X B-Y L-Y O", [("X", 0, 1), ("Y", 1, 3)]),
    ("O I-X", []), ("B-X I-Y", [("X", 0, 2)]), ("L-X B-X", [("X", 1, 2)]), ("B-X B-X", [("X", 0, 1), ("X", 1, 2)]), ("E-X I-X O", []),
])
def test_decode_chunks(spark, tags, want):
    t = tokens(spark, [(0, i, "w", v) for i, v in enumerate(tags.split())])
    got = [(r["value"], r["lb"], r["ub"]) for r in spans.decode_chunks(t, "ner").orderBy("lb").collect()]
    assert got == want


def test_round_trip(spark):
    t = tokens(spark, [(0, i, "w", v) for i, v in enumerate("B-X I-X O B-Y B-Y O".split())])
    back = spans.encode_chunks(t, spans.decode_chunks(t, "ner"), "x").orderBy("pos").collect()
    assert [r["x"] for r in back] == [r["ner"] for r in back]


def test_pos_tags(spark):
    t = tokens(spark, [(0, i, "w", v) for i, v in enumerate("N _N V A _B".split())])
    assert [(r["value"], r["lb"], r["ub"]) for r in spans.decode_pos(t, "ner").orderBy("lb").collect()] == [("N", 0, 2), ("V", 2, 3), ("B", 3, 5)]
    assert [r["x"] for r in spans.repaired_pos(t, "ner", "x").orderBy("pos").collect()] == ["N", "_N", "V", "B", "_B"]


def test_levels(spark):
    t = spark.createDataFrame([(0, a, b, "v") for a, b in ((0, 3), (1, 2), (2, 5), (5, 6))], "doc_id bigint, lb int, ub int, value string")
    assert sorted((r["lb"], r["ub"]) for r in spans.top_level(t, ["doc_id"]).collect()) == [(0, 3), (5, 6)]
    b = t.where("lb <> 2")
    assert sorted((r["lb"], r["ub"]) for r in spans.bottom_level(b, ["doc_id"]).collect()) == [(1, 2), (5, 6)]
    v = t.select(spans.level(F.lit("A.b.c"), 1).alias("x"), spans.level(F.lit("A"), 1).alias("y"), spans.up_to_level(F.lit("A.b.c"), 1).alias("z")).first()
    assert tuple(v) == ("b", None, "A.b")


def test_ranges():
    assert spans.ranges("1:2,-1", 5) == [0, 1, 2, 4]
    with pytest.raises(ValueError):
        truth("maybe")


def test_mapping(spark):
    tags = spark.createDataFrame([("Person",), ("Company",), ("Date",), (None,)], "value string")
    m = spark.createDataFrame([("Person", "persName"), ("Company", None)], "tag string, mapped string")
    assert sorted(str(r["value"]) for r in spans.relabelled(tags, m).collect()) == ["Date", "None", "persName"]


def test_consistency(spark):
    said = ["hier Brume a fermé", "on dit que Brume rouvre", "la brume tombe"]
    rows = [(s, p, w, "B-shop" if (s, w) == (0, "Brume") else "O") for s, text in enumerate(said) for p, w in enumerate(text.split())]
    t = tokens(spark, rows)
    for overriding in (True, False):
        got = consistency.spread(t, "ner", "x", overriding).where("x <> 'O'").collect()
        assert sorted((r["sent"], r["pos"], r["x"]) for r in got) == [(0, 1, "B-shop"), (1, 3, "B-shop")]


def test_evaluation(spark):
    s = "doc_id bigint, lb int, ub int, value string"
    gold = [(0, 0, 2, "A"), (0, 3, 5, "A"), (0, 6, 9, "B"), (0, 10, 12, "A"), (0, 20, 21, "A"), (0, 30, 33, "A"), (0, 30, 33, "A")]
    guess = [(0, 0, 2, "A"), (0, 3, 5, "B"), (0, 6, 8, "B"), (0, 10, 13, "B"), (0, 40, 41, "A"), (0, 30, 33, "A"), (0, 31, 34, "A")]
    p = evaluate.pairs(spark.createDataFrame(gold, s), spark.createDataFrame(guess, s))
    kinds = sorted(r["kind"] for r in p.collect())
    assert kinds == ["boundary", "correct", "correct", "noise", "noise", "silence", "silence", "type", "type+boundary"]
    c = spark.createDataFrame([("global", k, n) for k, n in (("correct", 2), ("type", 1), ("boundary", 1), ("noise", 1), ("silence", 1))], "entity string, kind string, n bigint")
    m = evaluate.metrics(c).first()
    assert [round(m[k], 6) for k in ("precision", "recall", "f", "under", "over", "substitution")] == [0.4, 0.4, 0.4, 0.2, 0.2, 0.5]
    assert evaluate.macro(evaluate.metrics(c)).first()["f"] == 0.0


def test_pairing_is_sequential():
    g, s = ([{"lb": 0, "ub": u, "value": "A"} for u in us] for us in ((2, 3), (4, 5)))
    assert [k for k, *_ in evaluate.paired(g, s)] == ["boundary", "boundary"]


def test_search(spark):
    d = spark.createDataFrame([(1, "la lala la."), (2, None), (3, "")], "doc_id bigint, content string")
    assert sorted(r["lb"] for r in search.occurrences(d, "la").collect()) == [0, 3, 5, 8]
    assert sorted(r["lb"] for r in search.occurrences(d, "la", whole_word=True).collect()) == [0, 8]
    assert search.occurrences(d, "").count() == 0
    got = spark.createDataFrame([("a-b-c",), ("a-b c",), ("ab",)], "s string").select(search.separator(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in got] == ["-", None, None]



def test_readers(spark):
    lines = spark.createDataFrame([(0, "T1\tPerson 0 4;6 9\tabcd fgh"), (0, "#1 note"), (0, "T2\tDate 3 x\tbad")], "doc_id bigint, line string")
    got = [(r["value"], r["lb"], r["ub"]) for r in readers.brat_tags(lines).orderBy("id", "lb").collect()]
    assert got == [("Person", 0, 4), ("Person", 6, 9), ("Date", 3, None)]
    assert readers.brat_tags(lines, whole=True).where("id = 'T1'").first()["ub"] == 9
    rows = spark.createDataFrame([(0, 0, "a\tX"), (0, 1, "b"), (0, 2, ""), (0, 3, "c\tY")], "doc_id bigint, line_no int, raw string")
    t = readers.conll_tokens(rows, ["word", "tag"], "word").orderBy("tok").collect()
    assert [(r["sent"], r["pos"], r["lb"], r["word"], r["tag"]) for r in t] == [(0, 0, 0, "a", "X"), (0, 1, 2, "b", None), (1, 0, 4, "c", "Y")]


def test_formats_round_trip(spark, tmp_path):
    text = "Élan & <Paris>\nfin"
    docs = spark.createDataFrame([(1, "n&1", text)], "doc_id bigint, name string, content string")
    c = Pipeline().append("segmentation")(Corpus(docs))
    tags = spark.createDataFrame([(1, "ner", "Loc", 7, 14, 2, 3)], "doc_id bigint, layer string, value string, lb int, ub int, tlb int, tub int")
    b = sinks.bundle(docs, c.tokens, tags)
    for fmt, read in (("json", readers.json_documents), ("xml", readers.xml_documents), ("gate", readers.gate_documents)):
        out = sinks.export(b, fmt).select("name", "payload")
        got = read(out)
        assert got.first()["content"] == text
        assert [(r["value"], r["lb"], r["ub"]) for r in readers.tag_rows(got).collect()] == [("Loc", 7, 14)]
    for fmt in sinks.EXPORTERS:
        assert sinks.export(b, fmt).first()["payload"]
    (tmp_path / "a.txt").write_text("un\r\ndeux", encoding="utf-8")
    got = readers.documents_from_list(spark, [str(tmp_path / "*.txt")]).first()
    assert (got["name"], got["content"]) == ("a.txt", "un\ndeux")


def test_master(spark, tmp_path):
    from lexiloom.plans.pipeline import load_master

    (tmp_path / "f.xml").write_text('<information><entries><before><entry name="word"/></before></entries><features><nullary name="low" action="lower"/></features></information>')
    (tmp_path / "m.xml").write_text('<master><pipeline><segmentation tokeniser="fr"/><enrich config="f.xml"/><clean to-keep="word,low"/></pipeline><options/></master>')
    p, _ = load_master(str(tmp_path / "m.xml"))
    c = p(Corpus(spark.createDataFrame([(1, "n", "Il vit. L'eau")], "doc_id bigint, name string, content string")))
    assert [r["low"] for r in c.tokens.orderBy("tok").collect()] == ["il", "vit", ".", "l'", "eau"]
    assert c.visible == ("word", "low")


def test_marks_nest_and_cross():
    text = "abcdefgh"
    tag = lambda a, b, v: {"lb": a, "ub": b, "value": v}
    mark = lambda tags, lo=0, hi=8: sinks._marked(text, tags, lo, hi, str.upper, lambda t: f"<{t['value']}>", lambda t: f"</{t['value']}>")
    assert mark([tag(0, 6, "x"), tag(1, 3, "y"), tag(3, 4, "z")]) == "<x>A<y>BC</y><z>D</z>EF</x>GH"
    assert mark([tag(0, 4, "x"), tag(2, 6, "y")]) == "<x>AB<y>CD</y></x><y>EF</y>GH"
    assert mark([tag(1, 3, "x"), tag(1, 3, "y")]) == "A<x><y>BC</y></x>DEFGH"
    assert mark([tag(0, 8, "x")], 2, 5) == "<x>CDE</x>" and mark([]) == "ABCDEFGH" and mark([tag(2, 2, "x")]) == "ABCDEFGH"


def test_noun_phrases_as_mentions():
    import xml.etree.ElementTree as ET

    words, pos = ["Il", "voit", "son", "vieux", "chat"], ["CLS", "V", "DET", "A", "N"]
    at, toks, tags = 0, [], []
    for k, (w, p) in enumerate(zip(words, pos, strict=True)):
        toks.append({"tok": k, "par": 0, "sent": 0, "pos": k, "lb": at, "ub": at + len(w), "word": w})
        tags.append({"layer": "pos", "value": p, "lb": at, "ub": at + len(w), "tlb": k, "tub": k + 1})
        at += len(w) + 1
    np = lambda a, b: {"layer": "chunk", "value": "NP", "lb": toks[a]["lb"], "ub": toks[b - 1]["ub"], "tlb": a, "tub": b}
    root = ET.fromstring(sinks.as_tei_np({"name": "n", "content": " ".join(words), "tokens": toks, "tags": [*tags, np(0, 1), np(2, 5)]}).encode())
    q = "{http://www.tei-c.org/ns/1.0}"
    assert "".join(root.find(f".//{q}body").itertext()) == " ".join(words)
    assert [a.get("subtype") for a in root.iter(f"{q}anchor")] == ["UnitStart", "UnitEnd"] * 2
    assert [f.findtext(f"{q}string") for f in root.iter(f"{q}f") if f.get("name") == "CATEGORIE"] == ["PR_CL_S", "GN"]
    assert [x.get("from") for x in root.iter(f"{q}span")] == ["#u-MENTION-1-start", "#u-MENTION-2-start"]


def test_abbreviations_carry_labels(spark):
    words = "la Société Nouvelle Velmar ( SNV ) ferme puis SNV rouvre OK".split()
    rows = [(1, 0, i, w, {1: "B-Firm", 2: "I-Firm", 3: "I-Firm"}.get(i, "O")) for i, w in enumerate(words)]
    t = spark.createDataFrame(rows, "doc_id bigint, sent int, pos int, word string, ner string")
    found = consistency.abbreviations(t)
    assert {(r["pos"], r["short"], r["lb"], r["ub"]) for r in found.collect()} == {(5, "SNV", 1, 4), (9, "SNV", 1, 4)}
    got = [r["x"] for r in consistency.spread_along(t, found, "ner", "x").orderBy("pos").collect()]
    assert got[5] == "B-Firm" and got[9] == "B-Firm" and got[1:4] == ["B-Firm", "I-Firm", "I-Firm"] and got[11] == "O"
