"""Token features, dictionaries, rules and models on one short sentence of six tokens."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import compile_xml
from lexiloom.functions import features as X
from lexiloom.operators import crf, dictionary, rules

WORDS = ["Lundi", "37", "OIES", "sauvages", "volent", "!"]


@pytest.fixture(scope="module")
def sentence(spark):
    return spark.createDataFrame([(7, 2, i, 40 + i, w, len(w)) for i, w in enumerate(WORDS)], "doc_id bigint, sent int, pos int, tok int, word string, size int")


def values(df, **cols):
    got = df.select("pos", *[c.alias(k) for k, c in cols.items()]).orderBy("pos").collect()
    return {k: [r[k] for r in got] for k in cols}


def test_neighbours(sentence):
    w = X.sentence_window()
    got = values(sentence, here=X.shifted(F.col("size"), 0, w), two_back=X.shifted(F.col("size"), -2, w), two_on=X.shifted(F.col("word"), 2, w))
    assert got == {"here": [5, 2, 4, 8, 6, 1], "two_back": [None, None, 5, 2, 4, 8], "two_on": ["OIES", "sauvages", "volent", "!", None, None]}


def test_edges(sentence):
    got = values(sentence, first=X.bos(F.col("pos")), last=X.eos(X.sentence_window()))
    assert [i for i, x in enumerate(got["first"]) if x] == [0]
    assert [i for i, x in enumerate(got["last"]) if x] == [5]


@pytest.mark.parametrize(("feature", "want"), [
    (lambda c: X.lower(c), ["lundi", "37", "oies", "sauvages", "volent", "!"]),
    (lambda c: X.sliced(c, 1, 4, "~"), ["und", "7", "IES", "auv", "ole", "~"]),
    (lambda c: X.is_upper(c), [True, False, True, False, False, False]),
    (lambda c: X.substitute(c, "[aeiou]", "-"), ["L-nd-", "37", "OIES", "s--v-g-s", "v-l-nt", "!"]),
    (lambda c: X.sequence(c, lambda x: X.substitute(x, "[0-9]+", "N"), lambda x: X.substitute(x, "[a-z]+", "m")), ["Lm", "N", "OIES", "m", "m", "!"]),
    (lambda c: X.matches(c, "v.l"), [False, False, False, False, True, False]),
    (lambda c: X.matched_part(c, "[A-Z]+"), ["L", "#", "OIES", "#", "#", "#"]),
    (lambda c: X.matched_token(c, "[0-9!]"), ["#", "37", "#", "#", "#", "!"]),
    (lambda c: X.some(X.matches(c, "^[0-9]"), X.matches(c, "^v")), [False, True, False, False, True, False]),
    (lambda c: X.every(X.matches(c, "s$"), X.matches(c, "^s")), [False, False, False, True, False, False]),
    (lambda c: X.none(X.matches(c, "[a-z]"), X.is_upper(c)), [False, True, False, False, False, True]),
], ids="lower sliced is_upper substitute sequence matches part token some every none".split())
def test_one_column_features(sentence, feature, want):
    assert values(sentence, x=feature(F.col("word")))["x"] == want


def lexicon(spark, *entries):
    return dictionary.keyed(spark.createDataFrame([(e,) for e in entries], "entry string"))


def column(df, name):
    return [r[name] for r in df.orderBy("pos").collect()]


def test_membership_and_map(spark, sentence):
    held = dictionary.token_flag(sentence, spark.createDataFrame([("volent",), ("37",), (None,), ("VOLENT",)], "entry string"), "x")
    assert column(held, "x") == [False, True, False, False, True, False]
    english = spark.createDataFrame([("Lundi", "Monday"), ("volent", "fly")], "entry string, mapped string")
    assert column(dictionary.mapped(sentence, english, "x"), "x") == ["Monday", "O", "O", "O", "fly", "O"]


def test_longest_entry_wins(spark, sentence):
    lex = lexicon(spark, "OIES", "OIES sauvages", "37 OIES sauvages volent haut", "sauvages volent")
    assert column(dictionary.multiword(sentence, lex, "x", "-bird"), "x") == ["O", "O", "B-bird", "I-bird", "O", "O"]
    assert column(dictionary.multiword(sentence, lexicon(spark, "volent !"), "x", "-end"), "x") == ["O"] * 4 + ["B-end", "I-end"]


def test_last_token_rule(spark, sentence):
    """A last token that is an entry itself begins anew even inside a longer match; the option turns that off."""
    lex = lexicon(spark, "sauvages volent !", "!")
    assert column(dictionary.multiword(sentence, lex, "x"), "x")[3:] == ["B", "I", "B"]
    assert column(dictionary.multiword(sentence, lex, "x", last_exception=False), "x")[3:] == ["B", "I", "I"]


def test_blank_and_null_entries(spark, sentence):
    lex = dictionary.keyed(spark.createDataFrame([("",), (None,), ("  ",), ("OIES",), ("OIES",)], "entry string"))
    assert column(dictionary.multiword(sentence, lex, "x"), "x") == ["O", "O", "B", "O", "O", "O"]
    none = dictionary.keyed(spark.createDataFrame([], "entry string"))
    assert column(dictionary.multiword(sentence, none, "x"), "x") == ["O"] * 6


def test_directory_priority(spark, sentence):
    lex = dictionary.keyed(spark.createDataFrame([("wild", 1, "OIES sauvages"), ("farm", 2, "OIES sauvages"), ("count", None, "37 OIES")], "dict string, priority int, entry string"))
    got = [(r["lb"], r["ub"], r["value"]) for r in dictionary.directory(sentence, lex, nocase=False).orderBy("lb").collect()]
    assert got == [(1, 3, "count")]
    both = dictionary.directory(sentence, lex.where("dict <> 'count'"), nocase=False, ambiguous=True).collect()
    assert [(r["lb"], r["value"]) for r in both] == [(2, "wild|farm")]


def test_merge_with_gold(spark):
    s = "doc_id bigint, sent int, lb int, ub int, value string"
    gold = spark.createDataFrame([(0, 0, 0, 3, "G"), (0, 0, 5, 6, "H"), (0, 0, 8, 9, "I")], s)
    found = spark.createDataFrame([(0, 0, 0, 2, "a"), (0, 0, 5, 6, "b"), (0, 0, 7, 10, "c"), (0, 0, 1, 2, "d")], s)
    got = sorted(r["value"] for r in dictionary.merge_with_gold(found, gold).collect())
    assert got == ["G", "H", "c", "d"]


def test_rules(sentence):
    c = F.col("word")
    tests = {"digits": X.matches(c, "^[0-9]+$"), "upper": X.matches(c, "^[A-Z]+$"), "small": X.matches(c, "^[a-z]+$")}
    steps = (rules.Step("digits", "?"), rules.Step("upper"), rules.Step("small", "*"))
    assert column(rules.rule(sentence, steps, tests, "flock", "x"), "x") == ["O", "B-flock", "I-flock", "I-flock", "I-flock", "O"]
    assert column(rules.rule(sentence, steps[1:2], tests, "flock", "x"), "x") == ["O", "O", "B-flock", "O", "O", "O"]
    greedy = (rules.Step("a", "+"), rules.Step("a"))
    assert rules.rule_tags(greedy, {"a": [1, 1, 1]}, 3) == []  # what one step took isn't given back
    assert rules.rule_tags((rules.Step("a", "+"),), {"a": [1, 0, 1]}, 3, strict=True) == [(0, 1)]
    either = rules.Step(either=((rules.Step("a"), rules.Step("b")), (rules.Step("b", "3"),)))
    assert rules.rule_tags((either,), {"a": [1, 0, 0, 0, 0], "b": [0, 1, 1, 1, 1]}, 5) == [(0, 2), (2, 5)]
    with pytest.raises(ValueError):
        rules.cardinality("0")


def model_text(tags, template, weights):
    """A model in the text format: `weights` maps a feature to its weight for each tag."""
    names = [f"{len(t)}:{t}," for t in (template, *tags, *weights)]
    lines = [f"#mdl#2#{len(weights) * len(tags)}", "#rdr#1/0/0", names[0], f"#qrk#{len(tags)}", *names[1 : 1 + len(tags)], f"#qrk#{len(weights)}", *names[1 + len(tags) :]]
    flat = [x for row in weights.values() for x in row]
    return "\n".join([*lines, *(f"{i}={float(x).hex()}" for i, x in enumerate(flat) if x), ""])


def test_model(spark, sentence):
    m = crf.read_model(model_text(["DAY", "REST"], "u:f=%x[0,0]", {"u:f=Lundi": (1.5, -2), "u:f=37": (0, 0.25), "u:f=OIES": (-1, 1), "u:f=volent": (0.5, 0)}))
    obs = crf.observations(sentence, ["u:f=%x[0,0]"], ["word"])
    assert [r["y"] for r in crf.label(obs, m).orderBy("pos").collect()] == ["DAY", "REST", "REST", "DAY", "DAY", "DAY"]  # unseen words take the first tag
    assert [r["y"] for r in crf.best_alone(obs, crf.dump(m, spark), list(m.tags)).orderBy("pos").collect()] == ["DAY", "REST", "REST", "DAY", "DAY", "DAY"]
    back = crf.model_of(crf.dump(m, spark), list(m.tags), list(m.templates))
    assert back.viterbi([["u:f=OIES"], ["u:f=Lundi"], ["u:f=?"]])[0] == [1, 0, 0]


def test_text_form_and_scores_by_joins(spark, sentence):
    import numpy as np

    rng = np.random.default_rng(3)
    obs = crf.observations(sentence, ["u:f=%x[0,0]", 'b:%t[0,0,"^\\u"]'], ["word"])
    m = crf.Model(("P", "Q", "R"), ("u:f=%x[0,0]",), {f"u:f={w}": rng.integers(-4, 5, 3) / 2 for w in WORDS[:5]}, {f"b:{b}": rng.integers(-4, 5, (3, 3)) / 2 for b in ("true", "false")})
    back = crf.read_model(crf.write_model(m))
    assert back.tags == m.tags and all((back.unigram[o] == w).all() for o, w in m.unigram.items()) and all((back.bigram[o] == w).all() for o, w in m.bigram.items())
    by_model = [(r["y"], r["score"]) for r in crf.label(obs, m).orderBy("pos").collect()]
    assert [(r["y"], r["score"]) for r in crf.label_scored(obs, crf.dump(m, spark), list(m.tags)).orderBy("pos").collect()] == by_model


def test_training_fits_and_generalises(spark, data):
    t = spark.read.parquet(f"{data}/sem_tokens.parquet").where("chunk is not null").dropDuplicates(["doc_id", "tok"])
    tpl = ["u:w=%x[0,0]", "u:p=%x[-1,0]", "u:t=%x[0,1]", "u:n=%x[1,1]"]
    o = crf.observations(t, tpl, ["word", "pos_tag"]).join(t.select("doc_id", "sent", "pos", F.col("chunk").alias("g")), ["doc_id", "sent", "pos"])
    held = F.pmod(F.xxhash64("doc_id", "sent"), F.lit(5)) == 0
    w = crf.train(o.where(~held), "g", ["O", "B-NP", "I-NP"], tpl, rounds=4)
    y = crf.label_scored(o.where(held), w, ["O", "B-NP", "I-NP"]).join(o.select("doc_id", "sent", "pos", "g"), ["doc_id", "sent", "pos"])
    assert y.agg(F.avg((F.col("y") == F.col("g")).cast("int"))).first()[0] > 0.85


def test_moves_outweigh_words():
    import numpy as np

    m = crf.Model(("P", "Q"), (), {"w": np.array([0.2, 0.0])}, {"m": np.array([[-3.0, 1.0], [1.0, -3.0]])})
    path, _ = m.viterbi([["w", "m"], ["w", "m"], ["w", "m"], ["w", "m"]])
    assert path in ([0, 1, 0, 1], [1, 0, 1, 0])
    assert m.viterbi([["w"], ["w"]])[0] == [0, 0]


@pytest.mark.parametrize(("template", "want"), [
    ("%x[-1,0]", ["_x-1", *WORDS[:5]]),
    ("u:%x[2,0]", ["u:OIES", "u:sauvages", "u:volent", "u:!", "u:_x+1", "u:_x+2"]),
    ("%x[-7,0]", ["_x-#", "_x-#", "_x-#", "_x-4", "_x-3", "_x-2"]),
    ("%x[9,0]", ["_x+4", "_x+#", "_x+#", "_x+#", "_x+#", "_x+#"]),
    ('%t[0,0,"\\d"]', ["false", "true", "false", "false", "false", "false"]),
    ('%m[0,0,"^\\a\\a\\a"]', ["Lun", "", "OIE", "sau", "vol", ""]),
])
def test_templates(sentence, template, want):
    assert values(sentence, x=crf.template(template, ["word"]))["x"] == want


XML = """<information><entries><before><entry name="word"/></before><after/></entries><features>{}</features></information>"""


def test_enrichment(sentence):
    x = XML.format('<nullary name="begin" action="BOS"/><nullary name="finish" action="eos"/><nullary name="small" action="lower" display="no"/>'
                   '<string name="geese" action="equal" entry="small">oies</string><dictionary name="birds" action="multiword" appendice="-a">OIES sauvages\n37</dictionary>'
                   '<trigger name="opening"><nullary action="bos"/><nullary action="lower"/></trigger>'
                   '<rule name="count"><regexp action="check">^[0-9]</regexp><regexp action="check" card="+">^[a-zA-Z]</regexp></rule>'
                   '<dictionary name="gloss" action="map" default="?">volent\tfly\nLundi</dictionary>'
                   '<find name="caps" action="backward" return_entry="word"><unary action="isupper">0</unary></find>')
    e = compile_xml.read_enrichment(x)
    got = compile_xml.enrich(sentence, e)
    want = {
        "begin": [1, 0, 0, 0, 0, 0], "finish": [0, 0, 0, 0, 0, 1], "geese": [0, 0, 1, 0, 0, 0], "birds": ["O", "B-a", "B-a", "I-a", "O", "O"],
        "opening": ["lundi"] + ["_untriggered_"] * 5, "count": ["O", "B-count", "I-count", "I-count", "I-count", "O"], "gloss": ["", "?", "?", "?", "fly", "?"], "caps": ["#", "Lundi", "Lundi", "OIES", "OIES", "OIES"],
    }
    assert e.visible() == ["word", *want]
    for name, cells in want.items():
        assert column(got, name) == cells, name
    assert "small" not in compile_xml.visible(got, e).columns


@pytest.mark.parametrize("action", ["map", "token"])
def test_small_and_large_dictionaries_agree(spark, action):
    """Short lists are literals in the plan, long ones tables; nulls and repeated keys come out alike."""
    df = spark.createDataFrame([(0, 0, i, i, w) for i, w in enumerate(["un", "OIES", None, "k7", ""])], "doc_id int, sent int, pos int, tok int, word string")
    entries = "un\tone\nOIES\tgeese\nun\tagain\nk7\n" if action == "map" else "un\nOIES\nun\nk7\n"
    got = []
    for more in ("", "\n".join(f"x{i}" for i in range(300))):
        e = compile_xml.read_enrichment(XML.format(f'<dictionary name="d" action="{action}" default="-">{entries}{more}</dictionary>'))
        got.append(column(compile_xml.enrich(df, e), "d"))
    assert got[0] == got[1] == (["again", "geese", "-", "", "-"] if action == "map" else [1, 1, 0, 1, 0])


@pytest.mark.parametrize("bad", ['<dictionary name="x" action="multiword" shift="1">a b</dictionary>','<nope name="x"/>', '<nullary name="x" action="bos"/><nullary name="x" action="eos"/>', '<boolean name="x" action="AND"><nullary action="bos"/><nullary action="eos"/></boolean>', '<nullary name="x" action="lower" entry="gone"/>'])
def test_enrichment_errors(sentence, bad):
    with pytest.raises(ValueError):
        compile_xml.enrich(sentence, XML.format(bad))
