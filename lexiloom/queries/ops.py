"""Queries of the annotation operators over the token, span and tag tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import features as X
from ..operators import consistency, crf, dictionary, evaluate, rules, search, segment, spans
from ..runtime import latest, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


TOKENS = ["doc_id", "source", "par", "sent", "pos", "tok", "lb", "ub", "word", "pos_tag", "chunk", "ner"]
DOCUMENTS = ["doc_id", "name", "source", "content", "lang", "mime", "loaded_at"]
T = "t as (select doc_id, source, par, sent, pos, tok, lb, ub, word, pos_tag, chunk, ner from sem_tokens group by all)"
D = "d as (select doc_id, name, source, content, lang, mime, max(loaded_at) as loaded_at from sem_documents group by all)"
W = "window w as (partition by doc_id, sent order by pos)"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """The token table, each (doc_id, tok) once."""
    return latest(table(spark, d, "sem_tokens"), ["doc_id", "tok"], "loaded_at", TOKENS)


def tokens_by_document(spark: SparkSession, d: str) -> DataFrame:
    """`tokens` moved once, by document: windows over sentences and whatever is gathered by document stay where they are."""
    return latest(table(spark, d, "sem_tokens").repartition("doc_id"), ["doc_id", "tok"], "loaded_at", TOKENS)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "sem_documents"), ["doc_id"], "loaded_at", DOCUMENTS)


def documents_spread(spark: SparkSession, d: str) -> DataFrame:
    """`documents` moved once, over enough partitions to keep every core busy with costly work on each text."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return latest(table(spark, d, "sem_documents").repartition(n, "doc_id"), ["doc_id"], "loaded_at", DOCUMENTS)


def _features(spark: SparkSession, d: str, **cols) -> DataFrame:
    return tokens(spark, d).select("doc_id", "tok", *[c.alias(k) for k, c in cols.items()])


def _tok(expr: str, more: str = "", window: bool = False) -> str:
    return f"with {T} select doc_id, tok, {expr} from t {more}{W if window else ''}"


def _w():
    return X.sentence_window()


# --- segmentation ---

_S = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query(f"""with {D}, p as (select doc_id, regexp_extract_all(content, '([{_S}]+|[^{_S}]+)') as ps from d where content is not null),
e as (select doc_id, unnest(ps) as word, generate_subscripts(ps, 1) as i from p),
o as (select doc_id, i, word, sum(length(word)) over (partition by doc_id order by i) - length(word) as lb from e)
select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as tok, cast(lb as integer) as lb, cast(lb + length(word) as integer) as ub, word
from o where not regexp_matches(word, '^[{_S}]')""")
def tok_whitespace(spark, d):
    return segment.whitespace_tokens(documents(spark, d))


@query()
def tok_fr(spark, d):
    return segment.tokenise(documents(spark, d), "fr")


@query()
def tok_fr_bounds(spark, d):
    return segment.tokenise(documents(spark, d), "fr_bounds")


@query()
def tok_en(spark, d):
    return segment.tokenise(documents(spark, d), "en")


_ENDS = "regexp_matches(word, '^([?!]+|…|\\.\\.+.*)$') or (word = '.' and depth = 0)"
_DEPTH = "sum(case when word in ({}) then 1 when word in ({}) then -1 else 0 end) over (partition by doc_id order by tok) as depth"


@query(f"""with {T}, {D}, n as (select t.*, lead(lb) over (partition by doc_id order by tok) as nx from t), x as (select n.*, substring(content, ub + 1, nx - ub) as gap from n left join d using (doc_id)),
a as (select *, {_DEPTH.format("'«', '(', '['", "'»', ')', ']'")}, coalesce(length(gap) - length(replace(gap, chr(10), '')), 0) as lines from x),
b as (select *, cast(coalesce({_ENDS}, false) or (lines > 1 and word is distinct from '.') as int) as e from a)
select doc_id, tok, cast(sum(e) over (partition by doc_id order by tok) - e as integer) as sent from b""")
def seg_sentences_fr(spark, d):
    return segment.sentence_ids(segment.newlines_after(tokens(spark, d).drop("sent"), documents(spark, d))).select("doc_id", "tok", "sent")


@query(f"""with {T}, a as (select *, {_DEPTH.format("'«', '(', '[', '``'", "'»', ')', ']', ")} from t), b as (select *, cast(coalesce({_ENDS}, false) as int) as e from a)
select doc_id, tok, cast(sum(e) over (partition by doc_id order by tok) - e as integer) as sent from b""")
def seg_sentences_en(spark, d):
    return segment.sentence_ids(tokens(spark, d).drop("sent"), "en").select("doc_id", "tok", "sent")


@query(f"""with {D}, p as (select doc_id, regexp_extract_all(content, '(\\r\\n|\\r|\\n|[^\\r\\n]+)') as ps from d where content is not null),
e as (select doc_id, unnest(ps) as word, generate_subscripts(ps, 1) - 1 as tok from p)
select doc_id, cast(tok as integer) as tok, case when word not in (chr(10), chr(13), chr(13) || chr(10)) then cast(count(*) filter (where word in (chr(10), chr(13), chr(13) || chr(10))) over (partition by doc_id order by tok) as integer) end as sent from e""")
def seg_sentences_lines(spark, d):
    """The default rule, over tokens that are lines and line ends."""
    lines = F.posexplode(F.regexp_extract_all("content", F.lit(r"(\r\n|\r|\n|[^\r\n]+)"), F.lit(1))).alias("tok", "word")
    return segment.sentence_ids(documents(spark, d).where("content is not null").select("doc_id", lines), "default").select("doc_id", "tok", "sent")


def _sentence_spans(spark, d):
    return tokens(spark, d).groupBy("doc_id", "sent").agg(F.min("lb").alias("lb"), F.max("ub").alias("ub"))


@query(f"""with {T}, {D}, s as (select doc_id, sent, min(lb) as lb, max(ub) as ub from t group by all),
g as (select s.*, lag(ub) over (partition by doc_id order by sent) as before from s),
n as (select g.doc_id, sent, case when length(x) - length(replace(x, chr(10), '')) > 1 then 1 else 0 end as fresh from (select g.*, substring(content, before + 1, lb - before) as x from g join d using (doc_id)) g)
select doc_id, sent, cast(sum(fresh) over (partition by doc_id order by sent) as integer) as par from n""")
def seg_paragraphs(spark, d):
    return segment.paragraph_ids(_sentence_spans(spark, d), documents(spark, d)).select("doc_id", "sent", "par")


@query(f"""with {T}, s as (select doc_id, sent, string_agg(coalesce(word, ''), ' ' order by pos) as line from t group by all)
select doc_id, string_agg(line, chr(10) order by sent) as text from s group by doc_id""")
def seg_lines(spark, d):
    return segment.lines(tokens(spark, d))


@query(f"""with {D} select doc_id, replace(replace(regexp_replace('<h1>' || coalesce(name, '') || '</h1><p class="a">' || coalesce(content, '') || '</p>', '<.+?>', '', 'gs'), '&nbsp;', ' '), '&#160;', ' ') as text from d""")
def html_strip_tags(spark, d):
    html = F.concat(F.lit("<h1>"), F.coalesce("name", F.lit("")), F.lit('</h1><p class="a">'), F.coalesce("content", F.lit("")), F.lit("</p>"))
    return documents(spark, d).select("doc_id", html.alias("html")).select("doc_id", segment.strip_tags().alias("text"))


@query()
def html_blanked(spark, d):
    html = F.concat(F.lit("<html><head><title>x</title></head><nav>n</nav><h1>"), F.coalesce("name", F.lit("")), F.lit("</h1><p>"), F.coalesce("content", F.lit("")), F.lit("</p></html>"))
    return segment.blank_markup(documents(spark, d).select("doc_id", html.alias("html")))


# --- token features ---


@query(_tok("word as value"))
def feat_identity(spark, d):
    return _features(spark, d, value=X.identity(F.col("word")))


@query(_tok("lag(word, 1) over w as before, lead(word, 2) over w as after", window=True))
def feat_shift(spark, d):
    return _features(spark, d, before=X.shifted(F.col("word"), -1, _w()), after=X.shifted(F.col("word"), 2, _w()))


@query(_tok("lag(pos_tag, 1) over w as value", window=True))
def feat_column_index(spark, d):
    t = tokens(spark, d)
    return t.select("doc_id", "tok", X.shifted(F.col(t.columns[TOKENS.index("pos_tag")]), -1, _w()).alias("value"))


@query(_tok("first(case when regexp_matches(word, '^[A-Z]') then word end ignore nulls) over (partition by doc_id, sent order by pos rows between 1 following and unbounded following) as value"))
def feat_find_forward(spark, d):
    return _features(spark, d, value=X.find_forward(X.matches(F.col("word"), "^[A-Z]"), F.col("word"), _w()))


@query(_tok("last(case when regexp_matches(word, '^[A-Z]') then pos_tag end ignore nulls) over (partition by doc_id, sent order by pos rows between unbounded preceding and 1 preceding) as value"))
def feat_find_backward(spark, d):
    return _features(spark, d, value=X.find_backward(X.matches(F.col("word"), "^[A-Z]"), F.col("pos_tag"), _w()))


@query(_tok("cast(pos = 0 as int) as bos, cast(lead(pos) over w is null as int) as eos", window=True))
def feat_bos_eos(spark, d):
    return _features(spark, d, bos=X.bos(F.col("pos")).cast("int"), eos=X.eos(_w()).cast("int"))


@query(_tok("lower(word) as value"))
def feat_lower(spark, d):
    return _features(spark, d, value=X.lower(F.col("word")))


@query(_tok("""case when word is null then null when substring(word, 1, 3) = '' then '#' else substring(word, 1, 3) end as head,
case when word is null then null when right(word, 3) = '' then '""' else right(word, 3) end as tail,
case when word is null then null when length(word) <= 2 then '""' else substring(word, 2, length(word) - 2) end as middle"""))
def feat_substring(spark, d):
    c = F.col("word")
    return _features(spark, d, head=X.sliced(c, 0, 3, "#"), tail=X.sliced(c, -3), middle=X.sliced(c, 1, -1))


@query(_tok("cast(coalesce(regexp_matches(substring(word, 1, 1), '^\\p{Lu}$'), false) as int) as first, cast(coalesce(length(word) > 1 and regexp_matches(substring(word, 2, 1), '^\\p{Lu}$'), false) as int) as second"))
def feat_is_upper(spark, d):
    return _features(spark, d, first=X.is_upper(F.col("word")).cast("int"), second=X.is_upper(F.col("word"), 1).cast("int"))


@query(_tok("regexp_replace(word, '([aeiou])([a-z])', '\\2\\1', 'g') as value"))
def feat_substitute(spark, d):
    return _features(spark, d, value=X.substitute(F.col("word"), "([aeiou])([a-z])", r"\2\1"))


@query(_tok("regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '0', 'g'), '[^Aa0]', 'x', 'g') as value"))
def feat_sequencer(spark, d):
    step = lambda p, r: lambda c: X.substitute(c, p, r)
    return _features(spark, d, value=X.sequence(F.col("word"), step("[A-Z]", "A"), step("[a-z]", "a"), step("[0-9]", "0"), step("[^Aa0]", "x")))


@query(_tok("""cast(coalesce(regexp_matches(word, '[0-9]$'), false) as int) as digit, cast(coalesce(regexp_matches(word, '^la', 'i'), false) as int) as la,
case when coalesce(regexp_matches(word, '[a-z]+'), false) then regexp_extract(word, '[a-z]+', 0) else '#' end as part,
case when coalesce(regexp_matches(word, '^[A-Z]'), false) then word else '#' end as whole"""))
def feat_regexp(spark, d):
    c = F.col("word")
    return _features(spark, d, digit=X.matches(c, "[0-9]$").cast("int"), la=X.matches(c, "^la", nocase=True).cast("int"), part=X.matched_part(c, "[a-z]+"), whole=X.matched_token(c, "^[A-Z]"))


@query(_tok("cast(coalesce(word = 'la', false) as int) as exact, cast(coalesce(lower(word) = 'la', false) as int) as nocase"))
def feat_equal(spark, d):
    return _features(spark, d, exact=X.equals(F.col("word"), "la").cast("int"), nocase=X.equals(F.col("word"), "La", nocase=True).cast("int"))


_CAP, _DIG, _BOS = "coalesce(regexp_matches(word, '^[A-Z]'), false)", "coalesce(regexp_matches(word, '[0-9]'), false)", "(pos = 0)"


@query(_tok(f"cast({_CAP} and not {_BOS} as int) as cap_inside, cast({_CAP} or {_DIG} as int) as cap_or_digit"))
def feat_boolean(spark, d):
    cap, dig = X.matches(F.col("word"), "^[A-Z]"), X.matches(F.col("word"), "[0-9]")
    return _features(spark, d, cap_inside=X.both(cap, X.negated(X.bos(F.col("pos")))).cast("int"), cap_or_digit=X.either(cap, dig).cast("int"))


@query(_tok(f"cast({_CAP} or {_DIG} or {_BOS} as int) as some_of, cast({_CAP} and {_DIG} and {_BOS} as int) as all_of, cast(not ({_CAP} or {_DIG} or {_BOS}) as int) as none_of"))
def feat_list(spark, d):
    cs = X.matches(F.col("word"), "^[A-Z]"), X.matches(F.col("word"), "[0-9]"), X.bos(F.col("pos"))
    return _features(spark, d, some_of=X.some(*cs).cast("int"), all_of=X.every(*cs).cast("int"), none_of=X.none(*cs).cast("int"))


@query(_tok(f"case when {_CAP} then lower(word) else '_untriggered_' end as value"))
def feat_trigger(spark, d):
    return _features(spark, d, value=X.triggered(X.matches(F.col("word"), "^[A-Z]"), X.lower(F.col("word"))))


@query(_tok(f"case when {_DIG} then pos_tag else word end as value"))
def feat_fill(spark, d):
    return _features(spark, d, value=X.filled(X.matches(F.col("word"), "[0-9]"), F.col("word"), F.col("pos_tag")))


# --- dictionaries ---

LEX = "lex as (select lower(entry) as entry, min(priority) as priority, min(dict) as dict from sem_lexicon where entry is not null group by lower(entry))"


def lexicon(spark, d) -> DataFrame:
    return table(spark, d, "sem_lexicon")


@query(_tok("cast(word in (select entry from sem_lexicon where entry is not null) and word is not null as int) as known"))
def dict_token(spark, d):
    return dictionary.token_flag(tokens(spark, d), lexicon(spark, d), "known").select("doc_id", "tok", F.col("known").cast("int").alias("known"))


@query(f"""with {T}, s as (select entry, string_agg(distinct dict, ',' order by dict) as dicts from sem_lexicon where entry is not null group by entry)
select doc_id, tok, coalesce(dicts, '') as dicts from t left join s on t.word = s.entry""")
def dict_many(spark, d):
    return dictionary.token_flags(tokens(spark, d), lexicon(spark, d)).select("doc_id", "tok", F.array_join("dicts", ",").alias("dicts"))


@query(f"""with {T}, m as (select entry, min(coalesce(mapped, '')) as v from sem_lexicon where entry is not null group by entry)
select doc_id, tok, coalesce(v, 'O') as value from t left join m on t.word = m.entry""")
def dict_map(spark, d):
    return dictionary.mapped(tokens(spark, d), lexicon(spark, d), "value").select("doc_id", "tok", "value")


@query("""select array_to_string(regexp_split_to_array(trim(lower(entry)), '\\s+'), chr(1)) as key, cast(len(regexp_split_to_array(trim(lower(entry)), '\\s+')) as integer) as n, count(*) as entries
from sem_lexicon where entry is not null and trim(entry) <> '' group by 1, 2""")
def dict_compile(spark, d):
    return dictionary.keyed(lexicon(spark, d), nocase=True).groupBy("key", "n").agg(F.count("*").alias("entries"))


def _pairs_lexicon(spark, d, which: str = "n <= 3 and value <> 'Product'") -> DataFrame:
    """Entries taken from the token table itself: names of more than one token; by default those that the SQL can follow."""
    t = tokens(spark, d)
    found = consistency.forms(t, spans.decode_chunks(t, "ner"))
    return found.where(which).groupBy("key", "n").agg(F.min("value").alias("mapped"))


_ISLANDS = f"""k as (select *, case when regexp_matches(ner, '^[BUS]-') then 'b' when regexp_matches(ner, '^[ILE]-') then 'i' else 'o' end as k from t),
k2 as (select *, k <> 'i' or coalesce(lag(k = 'o' or regexp_matches(coalesce(ner, 'O'), '^[USLE]-')) over w, true) as fresh from k {W}),
k3 as (select *, sum(cast(fresh as int)) over w as g from k2 {W}),
c as (select doc_id, sent, g, min(pos) as lb, max(pos) + 1 as ub, arg_min(substring(ner, 3), pos) as value, arg_min(k, pos) as first from k3 group by doc_id, sent, g),
chunks as (select doc_id, sent, lb, ub, value from c where first = 'b')"""
_FORMS = """f as (select c.doc_id, c.sent, c.lb, c.ub, c.value, string_agg(coalesce(t.word, ''), chr(1) order by t.pos) as key, c.ub - c.lb as n
  from chunks c join t on t.doc_id = c.doc_id and t.sent = c.sent and t.pos >= c.lb and t.pos < c.ub group by all)"""
_PAIRS = "lexi as (select key, n, min(value) as mapped from f where n <= 3 and value <> 'Product' group by key, n)"
_CAND = f"""g as (select doc_id, sent, pos, max(pos) over (partition by doc_id, sent) as last, word as w0, lead(word, 1) over w as w1, lead(word, 2) over w as w2 from t {W}),
gr as (select doc_id, sent, pos, last, 1 as n, w0 as key from g where w0 is not null union all
  select doc_id, sent, pos, last, 2, w0 || chr(1) || w1 from g where w0 is not null and w1 is not null union all
  select doc_id, sent, pos, last, 3, w0 || chr(1) || w1 || chr(1) || w2 from g where w0 is not null and w1 is not null and w2 is not null),
cand as (select gr.doc_id, gr.sent, gr.pos, max(gr.n) as n, arg_max(mapped, gr.n) as v, row_number() over (partition by gr.doc_id, gr.sent order by gr.pos) as i from gr join lexi on gr.n = lexi.n and gr.key = lexi.key group by gr.doc_id, gr.sent, gr.pos),
m as (select doc_id, sent, i, pos as lb, pos + n as ub, v, true as taken, pos + n as open from cand where i = 1 union all
  select c.doc_id, c.sent, c.i, c.pos, c.pos + c.n, c.v, c.pos >= m.open, case when c.pos >= m.open then c.pos + c.n else m.open end from m join cand c on c.doc_id = m.doc_id and c.sent = m.sent and c.i = m.i + 1)"""


@query(f"with recursive {T}, {_ISLANDS}, {_FORMS}, {_PAIRS}, {_CAND} select doc_id, sent, cast(lb as integer) as lb, cast(ub as integer) as ub, v as value from m where taken")
def lexicon_matches(spark, d):
    return dictionary.longest_matches(tokens(spark, d), _pairs_lexicon(spark, d), value="mapped", last_exception=False, lengths=[1, 2, 3])


@query(f"""with recursive {T}, {_ISLANDS}, {_FORMS}, {_PAIRS}, {_CAND}
select t.doc_id, t.tok, case when m.lb is null then 'O' when m.lb = t.pos then 'B-x' else 'I-x' end as value
from t left join (select * from m where taken) m on m.doc_id = t.doc_id and m.sent = t.sent and t.pos >= m.lb and t.pos < m.ub""")
def dict_multiword(spark, d):
    return dictionary.multiword(tokens(spark, d), _pairs_lexicon(spark, d), "value", "-x", last_exception=False, lengths=[1, 2, 3]).select("doc_id", "tok", "value")


_SENTS = "sw as (select doc_id, sent, list(coalesce(word, chr(2)) order by pos) as ws from t group by all)"
_LAST = f"""{_SENTS}, ls as (select doc_id, sent, max(pos) as last from t group by all), lexa as (select key, n, min(value) as mapped, string_split(key, chr(1)) as ks from f group by key, n),
lc as (select t.doc_id, t.sent, t.pos, max(b.n) as n from t join lexa b on t.word = b.ks[1] join sw on sw.doc_id = t.doc_id and sw.sent = t.sent where list_slice(ws, t.pos + 1, t.pos + b.n) = ks group by all),
ln as (select *, row_number() over (partition by doc_id, sent order by pos) as i from lc join ls using (doc_id, sent)),
lm as (select doc_id, sent, i, pos as lb, pos + n as ub, true as taken, pos + n as open from ln where i = 1 union all
  select c.doc_id, c.sent, c.i, c.pos, c.pos + c.n, c.pos >= m.open or c.pos = c.last, case when c.pos >= m.open then c.pos + c.n else m.open end from lm m join ln c on c.doc_id = m.doc_id and c.sent = m.sent and c.i = m.i + 1)"""


@query(f"""with recursive {T}, {_ISLANDS}, {_FORMS}, {_LAST}
select t.doc_id, t.tok, case when min(t.pos - m.lb) is null then 'O' when min(t.pos - m.lb) = 0 then 'B-x' else 'I-x' end as value
from t left join (select * from lm where taken) m on m.doc_id = t.doc_id and m.sent = t.sent and t.pos >= m.lb and t.pos < m.ub group by t.doc_id, t.tok""")
def dict_multiword_last(spark, d):
    """With all entries, however long and of whatever kind."""
    return dictionary.multiword(tokens(spark, d), _pairs_lexicon(spark, d, "true"), "value", "-x").select("doc_id", "tok", "value")


@query(f"""with {T}, l as (select lower(trim(entry)) as key, dict, min(coalesce(priority, 2147483647)) as prio from sem_lexicon where entry is not null and trim(entry) <> '' group by 1, 2),
b as (select t.doc_id, t.sent, t.pos, l.dict, l.prio, row_number() over (partition by t.doc_id, t.sent, t.pos order by l.prio, l.dict) as r from t join l on lower(t.word) = l.key)
select doc_id, sent, pos as lb, pos + 1 as ub, dict as value from b where r = 1""")
def dict_directory(spark, d):
    return dictionary.directory(tokens(spark, d), dictionary.keyed(lexicon(spark, d), nocase=True))


@query(f"""with recursive {T}, {_ISLANDS}, sw as (select doc_id, sent, list(coalesce(lower(word), chr(2)) order by pos) as ws from t group by all), ls as (select doc_id, sent, max(pos) as last from t group by all),
lx as (select regexp_split_to_array(trim(lower(entry)), '\\s+') as ks, first(mapped order by coalesce(priority, 2147483647), dict, mapped nulls first) as v from sem_lexicon where entry is not null and trim(entry) <> '' group by 1),
lc as (select t.doc_id, t.sent, t.pos, max(len(ks)) as n, arg_max(coalesce(v, chr(2)), len(ks)) as v from t join lx b on lower(t.word) = b.ks[1] join sw on sw.doc_id = t.doc_id and sw.sent = t.sent where list_slice(ws, t.pos + 1, t.pos + len(ks)) = ks group by all),
ln as (select *, row_number() over (partition by doc_id, sent order by pos) as i from lc join ls using (doc_id, sent)),
lm as (select doc_id, sent, i, pos as lb, pos + n as ub, v, true as taken, pos + n as open from ln where i = 1 union all
  select c.doc_id, c.sent, c.i, c.pos, c.pos + c.n, c.v, c.pos >= m.open or c.pos = c.last, case when c.pos >= m.open then c.pos + c.n else m.open end from lm m join ln c on c.doc_id = m.doc_id and c.sent = m.sent and c.i = m.i + 1),
fo as (select doc_id, sent, lb, ub, nullif(v, chr(2)) as value from lm where taken),
ke as (select * from fo where not exists (select 1 from chunks g where g.doc_id = fo.doc_id and g.sent = fo.sent and (g.lb = fo.lb and g.ub >= fo.ub or g.ub = fo.ub and g.lb <= fo.lb))),
st as (select * from chunks g where not exists (select 1 from ke where ke.doc_id = g.doc_id and ke.sent = g.sent and ke.lb <= g.lb and g.ub <= ke.ub))
select doc_id, sent, cast(lb as integer) as lb, cast(ub as integer) as ub, value from st union all select doc_id, sent, cast(lb as integer), cast(ub as integer), value from ke""")
def lexicon_annotate(spark, d):
    t = tokens(spark, d)
    lex = dictionary.keyed(lexicon(spark, d), nocase=True).groupBy("key", "n").agg(F.min(F.struct(F.coalesce("priority", F.lit(2**31 - 1)), "dict", "mapped")).alias("_m")).select("key", "n", "_m.mapped")
    found = dictionary.longest_matches(t, lex, nocase=True, value="mapped")
    return dictionary.merge_with_gold(found, spans.decode_chunks(t, "ner"))


# --- rules ---


@query(f"""with {T}, r as (select *, coalesce(regexp_matches(word, '^[A-Z]'), false) as cap, coalesce(regexp_matches(word, '^[A-Z]') or word = 'de', false) as member from t),
i as (select *, sum(cast(not member as int)) over w as g from r {W}), b as (select *, min(case when cap and member then pos end) over (partition by doc_id, sent, g) as start from i)
select doc_id, tok, case when not member or start is null or pos < start then 'O' when pos = start then 'B-caps' else 'I-caps' end as value from b""")
def rule_match(spark, d):
    """A capitalised word, then any number of capitalised words or 'de'."""
    c = F.col("word")
    steps = (rules.Step("cap"), rules.Step("more", "*"))
    return rules.rule(tokens(spark, d), steps, {"cap": X.matches(c, "^[A-Z]"), "more": X.either(X.matches(c, "^[A-Z]"), X.equals(c, "de"))}, "caps", "value").select("doc_id", "tok", "value")


# --- models ---

_TPL = ["u:word=%x[0,8]", "u:prev=%x[-1,8]", "u:shape=%t[0,8,\"^[A-Z]\"]"]
_TPL_B = [*_TPL, "b:%t[0,8,\"^[a-z]\"]"]


def _obs(spark, d):
    return crf.observations(tokens(spark, d), _TPL, TOKENS)


_OBS = f"""o as (select doc_id, sent, pos, 'u:word=' || coalesce(word, '') as a,
  'u:prev=' || case when row_number() over w = 1 then '_x-1' else coalesce(lag(word) over w, '') end as b,
  'u:shape=' || case when coalesce(regexp_matches(word, '^[A-Z]'), false) then 'true' else 'false' end as c from t {W}),
e as (select doc_id, sent, pos, unnest([a, b, c]) as obs from o)"""


@query(f"with {T}, {_OBS} select obs, count(*) as n from e group by obs")
def crf_templates(spark, d):
    return _obs(spark, d).select(F.explode("obs").alias("obs")).groupBy("obs").agg(F.count("*").alias("n"))


def _weights(spark, d):
    """A weight table from counts: how often an observation comes with a label."""
    o = _obs(spark, d).join(tokens(spark, d).select("doc_id", "sent", "pos", F.coalesce("chunk", F.lit("O")).alias("y")), ["doc_id", "sent", "pos"])
    return o.select(F.explode("obs").alias("obs"), "y").groupBy("obs", "y").agg(F.count("*").alias("c")).select(F.lit("u").alias("kind"), "obs", F.lit(None).cast("string").alias("y_prev"), "y", (F.pmod(F.col("c") * 7, F.lit(31)) / 4.0).alias("w"))


_WTS = "wt as (select e.obs, coalesce(t.chunk, 'O') as y, cast((count(*) * 7) % 31 as double) / 4 as w from e join t using (doc_id, sent, pos) group by all)"


@query(f"with {T}, {_OBS}, {_WTS} select doc_id, sent, pos, y, sum(w) as score from e join wt using (obs) group by all")
def crf_emission(spark, d):
    return crf.emissions(_obs(spark, d), _weights(spark, d))


@query(f"""with {T}, {_OBS}, {_WTS}, tg as (select * from (values (0, 'B-NP'), (1, 'I-NP'), (2, 'O')) v(i, y)),
em as (select doc_id, sent, pos, y, sum(w) as score from e join wt using (obs) group by all),
a as (select t.doc_id, t.sent, t.pos, tg.i, tg.y, coalesce(em.score, 0) as score from t cross join tg left join em on em.doc_id = t.doc_id and em.sent = t.sent and em.pos = t.pos and em.y = tg.y)
select doc_id, sent, pos, y from a qualify row_number() over (partition by doc_id, sent, pos order by score desc, i) = 1""")
def crf_argmax(spark, d):
    return crf.best_alone(_obs(spark, d), _weights(spark, d), ["B-NP", "I-NP", "O"])


def _paired_obs(spark, d):
    return crf.observations(tokens(spark, d), _TPL_B, TOKENS)


def _paired_weights(spark, d):
    """The weights by counts, and for pairs of labels the like."""
    t = tokens(spark, d)
    y = t.select("doc_id", "sent", "pos", F.coalesce("chunk", F.lit("O")).alias("y"), F.coalesce(X.shifted(F.coalesce("chunk", F.lit("O")), -1, _w()), F.lit("-")).alias("y_prev"))
    o = _paired_obs(spark, d).select("doc_id", "sent", "pos", F.element_at("obs", -1).alias("obs")).join(y, ["doc_id", "sent", "pos"]).where("y_prev <> '-'")
    b = o.groupBy("obs", "y_prev", "y").agg(F.count("*").alias("c")).select(F.lit("b").alias("kind"), "obs", "y_prev", "y", (F.pmod(F.col("c") * 5, F.lit(29)) / 4.0).alias("w"))
    return _weights(spark, d).unionByName(b)


_BOBS = f"""bo as (select doc_id, sent, pos, 'b:' || case when coalesce(regexp_matches(word, '^[a-z]'), false) then 'true' else 'false' end as obs, coalesce(chunk, 'O') as y, lag(coalesce(chunk, 'O')) over w as y_prev from t {W}),
bw as (select obs, y_prev, y, cast((count(*) * 5) % 29 as double) / 4 as w from bo where y_prev is not null group by all)"""


@query(f"with {T}, {_BOBS} select doc_id, sent, pos, bw.y_prev, bw.y, bw.w as score from bo join bw using (obs)")
def crf_transitions(spark, d):
    return crf.transitions(_paired_obs(spark, d), _paired_weights(spark, d))


_MOVE = ", ".join(f"sum(case when y_prev = '{a}' and y = '{b}' then w else 0 end) as m{i}{j}" for i, a in enumerate(("B-NP", "I-NP", "O")) for j, b in enumerate(("B-NP", "I-NP", "O")))
_STEP = ", ".join(f"greatest(s0 + m0{j}, s1 + m1{j}, s2 + m2{j}) + e{j}" for j in range(3))
_TRACE = ", ".join(f"case when s0 + m0{j} >= s1 + m1{j} and s0 + m0{j} >= s2 + m2{j} then list_append(p0, {j}) when s1 + m1{j} >= s2 + m2{j} then list_append(p1, {j}) else list_append(p2, {j}) end" for j in range(3))


@query(f"""with recursive {T}, {_OBS}, {_WTS}, {_BOBS}, mv as (select obs, {_MOVE} from bw group by obs),
em as (select doc_id, sent, pos, sum(case y when 'B-NP' then w else 0 end) as e0, sum(case y when 'I-NP' then w else 0 end) as e1, sum(case y when 'O' then w else 0 end) as e2 from e join wt using (obs) group by all),
tk as (select *, row_number() over (partition by doc_id, sent order by pos) as k from (select * from bo join mv using (obs)) b join em using (doc_id, sent, pos)),
v as (select doc_id, sent, k, e0 as s0, e1 as s1, e2 as s2, [0] as p0, [1] as p1, [2] as p2 from tk where k = 1 union all select tk.doc_id, tk.sent, tk.k, {_STEP}, {_TRACE} from v join tk on tk.doc_id = v.doc_id and tk.sent = v.sent and tk.k = v.k + 1),
en as (select doc_id, sent, greatest(s0, s1, s2) as score, case when s0 >= s1 and s0 >= s2 then p0 when s1 >= s2 then p1 else p2 end as path from v qualify row_number() over (partition by doc_id, sent order by k desc) = 1)
select tk.doc_id, tk.sent, tk.pos, ['B-NP', 'I-NP', 'O'][path[k] + 1] as y, score from tk join en using (doc_id, sent)""")
def crf_viterbi(spark, d):
    t = tokens_by_document(spark, d)
    o = crf.observations(t, _TPL_B, TOKENS).where("doc_id is not null and sent is not null and pos is not null")
    return crf.label_stored(o, _weights_by_document(t), ["B-NP", "I-NP", "O"])


def _weights_by_document(t: DataFrame) -> DataFrame:
    """`_paired_weights` of tokens that lie by document, which don't move for it: the labels at a place come from a window."""
    y = F.coalesce("chunk", F.lit("O"))
    o = crf.observations(t, _TPL_B, TOKENS, y=y, y_prev=X.shifted(y, -1, _w()))
    # not as a filter, which would be pushed below the exchange, so that this and `b` couldn't share it
    keyed = F.col("doc_id").isNotNull() & F.col("sent").isNotNull() & F.col("pos").isNotNull()
    u = o.select(F.slice("obs", 1, len(_TPL)).alias("obs"), F.when(keyed, F.collect_list("y").over(Window.partitionBy("doc_id", "sent", "pos"))).alias("ys"))
    u = u.select(F.explode("obs").alias("obs"), "ys").select("obs", F.explode("ys").alias("y")).groupBy("obs", "y").agg(F.count("*").alias("c"))
    b = o.where("y_prev is not null").groupBy(F.element_at("obs", -1).alias("obs"), "y_prev", "y").agg(F.count("*").alias("c"))
    u = u.select(F.lit("u").alias("kind"), "obs", F.lit(None).cast("string").alias("y_prev"), "y", (F.pmod(F.col("c") * 7, F.lit(31)) / 4.0).alias("w"))
    return u.unionByName(b.select(F.lit("b").alias("kind"), "obs", "y_prev", "y", (F.pmod(F.col("c") * 5, F.lit(29)) / 4.0).alias("w")))


@query(f"with {T}, {_OBS}, {_WTS}, {_BOBS} select 'u' as kind, obs, null as y_prev, y, w from wt where w <> 0 union all select 'b', obs, y_prev, y, w from bw where w <> 0")
def crf_dump(spark, d):
    """Written as text and read again."""
    model = crf.read_model(crf.write_model(crf.model_of(_paired_weights(spark, d), ["B-NP", "I-NP", "O"], _TPL_B)))
    return crf.dump(model, spark)


@query()
def crf_train(spark, d):
    t = tokens_by_document(spark, d).where("chunk is not null")
    o = crf.observations(t, _TPL, TOKENS, g=F.col("chunk")).where("doc_id is not null and sent is not null and pos is not null")
    return crf.train(o, "g", ["B-NP", "I-NP", "O"], _TPL, rounds=2)


# --- tags ---


@query(_tok("word, ner"))
def clean_columns(spark, d):
    return spans.keep_columns(tokens(spark, d), ["doc_id", "tok", "word", "ner"])


@query(f"with {T} select doc_id, source, par, chunk, ner from t")
def clean_ranges(spark, d):
    return spans.keep_ranges(tokens(spark, d).select(*TOKENS), "1:2,-2:-1")


@query(f"with {T}, {_ISLANDS} select doc_id, sent, cast(lb as integer) as lb, cast(ub as integer) as ub, value from chunks")
def bio_decode(spark, d):
    return spans.decode_chunks(tokens(spark, d), "ner")


@query(f"""with {T}, {_ISLANDS} select t.doc_id, t.tok, case when c.lb is null then 'O' when c.lb = t.pos then 'B-' || c.value else 'I-' || c.value end as value
from t left join chunks c on c.doc_id = t.doc_id and c.sent = t.sent and t.pos >= c.lb and t.pos < c.ub""")
def bio_encode(spark, d):
    t = tokens(spark, d)
    return spans.encode_chunks(t, spans.decode_chunks(t, "ner"), "value").select("doc_id", "tok", "value")


_UNDER = "u as (select doc_id, sent, pos, tok, case when pos_tag is null then null when lag(pos_tag) over w = pos_tag then '_' || pos_tag else pos_tag end as v from t window w as (partition by doc_id, sent order by pos))"


def _underscored(spark, d):
    t = tokens(spark, d)
    return t.withColumn("v", F.when(F.col("pos_tag").isNotNull(), F.when(X.shifted(F.col("pos_tag"), -1, _w()) == F.col("pos_tag"), F.concat(F.lit("_"), "pos_tag")).otherwise(F.col("pos_tag"))))


@query(f"""with {T}, {_UNDER}, n as (select *, sum(cast(v not like '\\_%' escape '\\' as int)) over w as g from u where v is not null {W})
select doc_id, sent, cast(min(pos) as integer) as lb, cast(max(pos) + 1 as integer) as ub, arg_max(ltrim(v, '_'), pos) as value from n group by doc_id, sent, g""")
def pos_decode(spark, d):
    return spans.decode_pos(_underscored(spark, d), "v")


@query(f"""with {T}, {_UNDER}, n as (select *, sum(cast(coalesce(v not like '\\_%' escape '\\', true) as int)) over w as g from u {W}),
l as (select *, ltrim(last(v) over (partition by doc_id, sent, g order by pos rows between unbounded preceding and unbounded following), '_') as z from n)
select doc_id, tok, case when v like '\\_%' escape '\\' then '_' || z else z end as value from l""")
def pos_repair(spark, d):
    return spans.repaired_pos(_underscored(spark, d), "v", "value").select("doc_id", "tok", "value")


@query(f"""with {T} select doc_id, case when min(cast(coalesce(regexp_matches(pos_tag, '^[BIO]'), false) as int)) = 1 then 'bio' else 'pos' end as pos_scheme,
case when min(cast(coalesce(regexp_matches(ner, '^[BIO]'), false) as int)) = 1 then 'bio' else 'pos' end as ner_scheme
from (select *, min(sent) over (partition by doc_id) as m from t) where sent = m group by doc_id""")
def scheme_detect(spark, d):
    t = tokens(spark, d)
    return spans.scheme(t, "pos_tag").withColumnRenamed("scheme", "pos_scheme").join(spans.scheme(t, "ner").withColumnRenamed("scheme", "ner_scheme"), "doc_id")


A = "a as (select doc_id, lower(trim(name)) as layer, reference, idx, v as value, s as lb, s + l as ub from sem_annotations group by all)"


def annotations(spark, d) -> DataFrame:
    """Tags, each once; layer names are trimmed and in lower case."""
    return table(spark, d, "sem_annotations").select("doc_id", F.lower(F.trim("name")).alias("layer"), "reference", "idx", F.col("v").alias("value"), F.col("s").alias("lb"), (F.col("s") + F.col("l")).alias("ub")).distinct()


@query(f"""with {T}, {A} select a.doc_id, a.layer, a.idx, a.value, a.lb, a.ub, b.lb as clb, e.ub as cub from a
join t b on b.doc_id = a.doc_id and b.tok = a.lb join t e on e.doc_id = a.doc_id and e.tok + 1 = a.ub where a.reference = 'tokens'""")
def tags_to_characters(spark, d):
    tags = annotations(spark, d).where("reference = 'tokens'").select("doc_id", "layer", "idx", "value", "lb", "ub")
    return spans.to_characters(tags, tokens(spark, d))


@query(f"""with {T}, {A}, c as (select row_number() over () as id, * from a where reference is null),
b as (select c.*, t.sent as s1, t.pos as p1 from c join t on t.doc_id = c.doc_id and t.lb <= c.lb and c.lb < t.ub),
e as (select b.id, b.doc_id, b.value, s1, p1, arg_min(t.sent, t.ub) as s2, arg_min(t.pos, t.ub) as p2 from b join t on t.doc_id = b.doc_id and t.ub >= b.ub and t.lb < b.ub group by all)
select doc_id, s1 as sent, p1 as lb, p2 + 1 as ub, value from e where s1 = s2""")
def tags_align(spark, d):
    return spans.to_tokens(annotations(spark, d).where("reference is null").select("doc_id", "lb", "ub", "value"), tokens(spark, d))


@query(f"with {A} select doc_id, layer, lb, ub, value, cast(row_number() over (partition by doc_id, layer, reference order by lb, ub desc, value nulls first) - 1 as integer) as idx from a")
def tags_sort(spark, d):
    return spans.ordered(annotations(spark, d).select("doc_id", "layer", "reference", "lb", "ub", "value"), ["doc_id", "layer", "reference"]).drop("reference")


_LAYERS = """x as (select doc_id, lb, ub, value from a where reference = 'tokens' and value is not null union all select doc_id, lb + 1, ub + 2, value || '.wide' from a where reference = 'tokens' and value is not null and idx % 3 = 0)"""


def _layered(spark, d):
    a = annotations(spark, d).where("reference = 'tokens' and value is not null")
    return a.select("doc_id", "lb", "ub", "value").unionByName(a.where("idx % 3 = 0").selectExpr("doc_id", "lb + 1 as lb", "ub + 2 as ub", "value || '.wide' as value"))


@query(f"""with recursive {A}, {_LAYERS}, r as (select *, row_number() over (partition by doc_id order by lb, ub desc, value) as i from x),
k as (select doc_id, lb, ub, value, i, true as taken, ub as open from r where i = 1 union all
  select r.doc_id, r.lb, r.ub, r.value, r.i, r.lb >= k.open, case when r.lb >= k.open then r.ub else k.open end from k join r on r.doc_id = k.doc_id and r.i = k.i + 1)
select doc_id, lb, ub, value from k where taken""")
def tags_top_level(spark, d):
    return spans.top_level(_layered(spark, d), ["doc_id"])


@query(f"with {A}, {_LAYERS}, n as (select *, lead(lb) over (partition by doc_id order by lb, ub desc, value) as nx from x) select doc_id, lb, ub, value from n where nx is null or nx > ub")
def tags_bottom_level(spark, d):
    return spans.bottom_level(_layered(spark, d), ["doc_id"])


@query(f"""with {A} select doc_id, layer, idx, lb, ub, coalesce(m.mapped, value) as value from a left join (select tag, min(coalesce(mapped, '')) as mapped from sem_tag_map group by tag) m on a.value = m.tag
where coalesce(m.mapped, value) is null or coalesce(m.mapped, value) <> ''""")
def tags_map(spark, d):
    return spans.relabelled(annotations(spark, d).select("doc_id", "layer", "idx", "lb", "ub", "value"), table(spark, d, "sem_tag_map"))


@query(f"with {A}, {D} select doc_id, name from d where doc_id in (select doc_id from a)")
def docs_with_annotations(spark, d):
    return spans.with_annotations(documents(spark, d), annotations(spark, d)).select("doc_id", "name")


@query(f"""with {A} select nullif(split_part(value, '.', 1), '') as level0, nullif(split_part(value, '.', 2), '') as level1, count(*) as n from a where value is not null group by rollup (1, 2)""")
def tags_levels_rollup(spark, d):
    a = annotations(spark, d).where("value is not null")
    return a.select(spans.level("value", 0).alias("level0"), spans.level("value", 1).alias("level1")).rollup("level0", "level1").agg(F.count("*").alias("n"))


@query(f"with {A} select doc_id, layer, idx, lb, ub, value from a where value = 'Person' or value like 'Person.%' or value = 'Location.local' or value like 'Location.local.%'")
def tags_in_tagset(spark, d):
    return spans.in_tagset(annotations(spark, d).select("doc_id", "layer", "idx", "lb", "ub", "value"), ["Person", "Location.local"])


@query(f"""with {A}, f as (select doc_id, lb, ub, lower(value) as value from a where layer = 'ner' and value is not null and doc_id % 2 = 0)
select doc_id, layer, lb, ub, value from a where not (layer = 'ner' and doc_id in (select doc_id from f)) union all select doc_id, 'ner', lb, ub, value from f""")
def tags_replace_layer(spark, d):
    a = annotations(spark, d).select("doc_id", "layer", "lb", "ub", "value")
    fresh = a.where("layer = 'ner' and value is not null and doc_id % 2 = 0").select("doc_id", "lb", "ub", F.lower("value").alias("value"))
    return spans.replaced_layer(a, fresh, "ner")


# --- consistency ---

_MAJ = """mj as (select doc_id, key, n, value, count(*) as c, min(sent * 1000000 + lb) as first from f group by all),
best as (select doc_id, key, n, value from mj qualify row_number() over (partition by doc_id, key, n order by c desc, first, value) = 1)"""


@query(f"with {T}, {_ISLANDS}, {_FORMS}, {_MAJ} select doc_id, key, cast(n as integer) as n, value from best")
def label_consistency(spark, d):
    t = tokens(spark, d)
    return consistency.majority(consistency.forms(t, spans.decode_chunks(t, "ner")))


_PLACED = f"""{_SENTS}, bw as (select doc_id, n, value, string_split(key, chr(1)) as ks from best),
pc as (select t.doc_id, t.sent, t.pos, max(b.n) as n, arg_max(b.value, b.n) as value from t join bw b on b.doc_id = t.doc_id and t.word = b.ks[1] join sw on sw.doc_id = t.doc_id and sw.sent = t.sent where list_slice(ws, t.pos + 1, t.pos + b.n) = ks group by all),
pn as (select *, row_number() over (partition by doc_id, sent order by pos) as i from pc),
pm as (select doc_id, sent, i, pos as lb, pos + n as ub, value, true as taken, pos + n as open from pn where i = 1 union all
  select c.doc_id, c.sent, c.i, c.pos, c.pos + c.n, c.value, c.pos >= m.open, case when c.pos >= m.open then c.pos + c.n else m.open end from pm m join pn c on c.doc_id = m.doc_id and c.sent = m.sent and c.i = m.i + 1),
found as (select doc_id, sent, lb, ub, value from pm where taken)"""
_SPREAD = """select t.doc_id, t.tok, case when al.lb is null then 'O' when al.lb = t.pos then 'B-' || al.value else 'I-' || al.value end as value from t left join al on al.doc_id = t.doc_id and al.sent = t.sent and t.pos >= al.lb and t.pos < al.ub
qualify row_number() over (partition by t.doc_id, t.tok order by t.pos - al.lb, al.value) = 1"""


@query(f"""with recursive {T}, {_ISLANDS}, {_FORMS}, {_MAJ}, {_PLACED},
fr as (select * from found f where not exists (select 1 from chunks c where c.doc_id = f.doc_id and c.sent = f.sent and c.lb = f.lb and c.ub = f.ub)),
kept as (select * from chunks c where not exists (select 1 from fr f where c.doc_id = f.doc_id and c.sent = f.sent and f.lb <= c.lb and c.ub <= f.ub)),
al as (select * from kept union all select * from fr) {_SPREAD}""")
def consistency_overriding(spark, d):
    return consistency.spread(tokens(spark, d), "ner", "value").select("doc_id", "tok", "value")


@query(f"""with recursive {T}, {_ISLANDS}, {_FORMS}, {_MAJ}, {_PLACED},
fr as (select * from found f where not exists (select 1 from chunks c where c.doc_id = f.doc_id and c.sent = f.sent and c.lb < f.ub and f.lb < c.ub)),
al as (select * from chunks union all select * from fr) {_SPREAD}""")
def consistency_filling(spark, d):
    return consistency.spread(tokens(spark, d), "ner", "value", overriding=False).select("doc_id", "tok", "value")


@query()
def abbreviations(spark, d):
    return consistency.abbreviations(tokens(spark, d))


@query()
def abbreviations_spread(spark, d):
    t = tokens(spark, d)
    return consistency.spread_along(t, consistency.abbreviations(t), "ner", "value").select("doc_id", "tok", "value")


# --- evaluation: the NER layers of the tag table against the column of the token table ---


def _gold(toks: DataFrame, lb: str = "tlb", ub: str = "tub") -> DataFrame:
    t = spans.tags_at_ends(toks, {"g": ("ner", "chunk")}).where("g is not null")
    return t.select("doc_id", F.col(f"g.{lb}").alias("lb"), F.col(f"g.{ub}").alias("ub"), "g.value")


def _gold_guess(spark, d):
    guess = annotations(spark, d).where("reference = 'tokens' and value is not null").select("doc_id", "lb", "ub", spans.level("value", 0).alias("value"))
    return _gold(tokens_by_document(spark, d)), guess.join(table(spark, d, "sem_tokens").select("doc_id").distinct(), "doc_id", "left_semi")


_GG = f"""gold as (select c.doc_id, t.tok as lb, t.tok + c.ub - c.lb as ub, c.value from chunks c join t on t.doc_id = c.doc_id and t.sent = c.sent and t.pos = c.lb),
guess as (select doc_id, lb, ub, split_part(value, '.', 1) as value from a where reference = 'tokens' and value is not null and doc_id in (select doc_id from t)),
g1 as (select *, row_number() over (partition by doc_id, lb, ub, value) as n from gold), s1 as (select *, row_number() over (partition by doc_id, lb, ub, value) as n from guess)"""


@query(f"with {T}, {_ISLANDS}, {A}, {_GG} select doc_id, lb, ub, value from g1 join s1 using (doc_id, lb, ub, value, n)")
def evaluate_exact(spark, d):
    return evaluate.exact(*_gold_guess(spark, d))[0].select("doc_id", "lb", "ub", "value")


def _pass(k: int, g: str, s: str, same: str) -> str:
    """One pass over what is left: each reference tag in order takes the first free guess."""
    return f"""c{k} as (select g.doc_id, g.i, list(s.i order by s.i) as c, row_number() over (partition by g.doc_id order by g.i) as k from {g} g join {s} s on g.doc_id = s.doc_id and g.value {same} s.value and (g.lb = s.lb) <> (g.ub = s.ub) group by g.doc_id, g.i),
r{k} as (select doc_id, k, i, c[1] as pick, [c[1]] as used from c{k} where k = 1 union all
  select doc_id, k, i, pick, case when pick is null then used else list_append(used, pick) end from (select c.doc_id, c.k, c.i, r.used, list_filter(c.c, lambda x: not list_contains(r.used, x))[1] as pick from r{k} r join c{k} c on c.doc_id = r.doc_id and c.k = r.k + 1)),
p{k} as (select doc_id, i as gi, pick as si from r{k} where pick is not null)"""


def _pairing(gold: str = "g1", guess: str = "s1") -> str:
    rest = lambda x, side, done: f"(select * from {x} anti join (" + " union all ".join(f"select doc_id, {side} as i from {p}" for p in done) + ") using (doc_id, i))"
    order = "row_number() over (partition by doc_id order by lb, ub desc, value, n) as i"
    return f"""gl as (select *, {order} from {gold} anti join {guess} using (doc_id, lb, ub, value, n)), sl as (select *, {order} from {guess} anti join {gold} using (doc_id, lb, ub, value, n)),
gn as (select *, row_number() over (partition by doc_id, lb, ub order by i) as m from gl), sn as (select *, row_number() over (partition by doc_id, lb, ub order by i) as m from sl),
pt as (select g.doc_id, g.i as gi, s.i as si from gn g join sn s using (doc_id, lb, ub, m)),
{_pass(2, rest("gl", "gi", ["pt"]), rest("sl", "si", ["pt"]), "=")},
{_pass(3, rest("gl", "gi", ["pt", "p2"]), rest("sl", "si", ["pt", "p2"]), "<>")},
hit as (select *, 'type' as kind from pt union all select *, 'boundary' from p2 union all select *, 'type+boundary' from p3),
pr as (select doc_id, 'correct' as kind, lb as gold_lb, ub as gold_ub, value as gold_value, lb as guess_lb, ub as guess_ub, value as guess_value from {gold} join {guess} using (doc_id, lb, ub, value, n) union all
  select h.doc_id, kind, g.lb, g.ub, g.value, s.lb, s.ub, s.value from hit h join gl g on g.doc_id = h.doc_id and g.i = h.gi join sl s on s.doc_id = h.doc_id and s.i = h.si union all
  select doc_id, 'silence', lb, ub, value, null, null, null from {rest("gl", "gi", ["hit"])} union all select doc_id, 'noise', null, null, null, lb, ub, value from {rest("sl", "si", ["hit"])})"""


_PAIRED = f"with recursive {T}, {_ISLANDS}, {A}, {_GG}, {_pairing()}"
_COUNTED = f"""{_PAIRED}, en as (select kind, unnest(list_distinct([x for x in [gold_value, guess_value, 'global'] if x is not null])) as entity from pr), ct as (select entity, kind, count(*) as n from en group by all)"""
_METRIC = f"""{_COUNTED}, sm as (select entity, sum(case kind when 'correct' then n else 0 end) as c, sum(case when kind in ('type', 'boundary', 'type+boundary') then n else 0 end) as s, sum(case kind when 'noise' then n else 0 end) as o, sum(case kind when 'silence' then n else 0 end) as u from ct group by entity),
mt as (select entity, coalesce(c / nullif(c + s + o, 0), 0) as precision, coalesce(c / nullif(c + s + u, 0), 0) as recall, coalesce(u / nullif(c + s + u, 0), 0) as under, coalesce(o / nullif(c + s + o, 0), 0) as over, coalesce(s / nullif(c + s, 0), 0) as substitution from sm),
mf as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f from mt)"""


@query(f"{_PAIRED} select doc_id, kind, cast(gold_lb as integer) as gold_lb, cast(gold_ub as integer) as gold_ub, gold_value, cast(guess_lb as integer) as guess_lb, cast(guess_ub as integer) as guess_ub, guess_value from pr")
def evaluate_pairs(spark, d):
    return evaluate.pairs(*_gold_guess(spark, d))


@query(f"{_COUNTED} select entity, kind, n from ct")
def evaluate_counts(spark, d):
    return evaluate.counts(evaluate.pairs(*_gold_guess(spark, d)))


@query(f"{_METRIC} select entity, round(precision, 6) as precision, round(recall, 6) as recall, round(f, 6) as f, round(under, 6) as under, round(over, 6) as over, round(substitution, 6) as substitution from mf")
def evaluate_metrics(spark, d):
    m = evaluate.metrics(evaluate.counts(evaluate.pairs(*_gold_guess(spark, d))))
    return m.select("entity", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f", "under", "over", "substitution")])


@query(f"{_METRIC} select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f), 6) as f from mf where entity <> 'global'")
def evaluate_macro(spark, d):
    m = evaluate.macro(evaluate.metrics(evaluate.counts(evaluate.pairs(*_gold_guess(spark, d)))))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


_NTH = "row_number() over (partition by doc_id, lb, ub, value) as n"
_AT = "join t b on b.doc_id = x.doc_id and b.tok = x.lb join t e on e.doc_id = x.doc_id and e.tok + 1 = x.ub"


@query(f"""with recursive {T}, {D}, {_ISLANDS}, {A}, {_GG}, gc as (select *, {_NTH} from (select x.doc_id, b.lb, e.ub, x.value from gold x {_AT})), sc as (select *, {_NTH} from (select x.doc_id, b.lb, e.ub, x.value from guess x {_AT})), {_pairing("gc", "sc")},
w as (select pr.*, content, least(gold_lb, guess_lb) as a, greatest(gold_ub, guess_ub) as z from pr join d using (doc_id) where kind <> 'correct' and content is not null)
select doc_id, kind, replace(substring(content, greatest(a - 30, 0) + 1, a - greatest(a - 30, 0)), chr(10), ' ') || case kind when 'silence' then '{{' || gold_value || ': ' || substring(content, a + 1, z - a) || '}}' when 'noise' then '[' || guess_value || ': ' || substring(content, a + 1, z - a) || ']'
else '{{' || gold_value || '|' || guess_value || ': ' || substring(content, a + 1, z - a) || '}}' end || replace(substring(content, z + 1, 30), chr(10), ' ') as shown from w""")
def evaluate_diff(spark, d):
    t = tokens_by_document(spark, d).where("doc_id is not null")  # as the join with tags asks; so both readers of the tokens share one exchange
    guess = spans.characters_by_document(_gold_guess(spark, d)[1], t)
    return evaluate.differences(evaluate.pairs(_gold(t, "lb", "ub"), guess), documents(spark, d).where("content is not null"))


# --- search ---

_HITS = "h as (select doc_id, content, unnest(range(1, len(string_split(content, 'la ')))) as i, string_split(content, 'la ') as p from d where content like '%la %')"


@query(f"with {D}, {_HITS} select doc_id, cast(length(array_to_string(p[1:i], 'la ')) as integer) as lb, cast(length(array_to_string(p[1:i], 'la ')) + 3 as integer) as ub from h")
def find_occurrences(spark, d):
    return search.occurrences(documents(spark, d), "la ")


@query()
def find_whole_words(spark, d):
    return search.occurrences(documents(spark, d), "la", whole_word=True)


@query(f"with {D} select doc_id, cast(sum(len(regexp_extract_all(content, '[0-9]+'))) as bigint) as hits from d where content is not null group by doc_id having sum(len(regexp_extract_all(content, '[0-9]+'))) > 0")
def search_pattern(spark, d):
    return search.pattern_hits(documents(spark, d), "[0-9]+").groupBy("doc_id").agg(F.count("*").alias("hits"))


@query(f"with {T} select distinct word, case when len(list_distinct(regexp_extract_all(word, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}]+'))) = 1 then regexp_extract(word, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}]+', 0) end as sep from t where word is not null")
def word_separator(spark, d):
    return tokens(spark, d).where("word is not null").select("word").distinct().select("word", search.separator(F.col("word")).alias("sep"))


@query("select source, publisher from sem_sources where coalesce(contains(source, 'forum') or contains('forum', source), false)")
def suggestions(spark, d):
    return table(spark, d, "sem_sources").where(search.suggests(F.col("source"), F.lit("forum"))).select("source", "publisher")


@query(f"with {T} select distinct word, cast(case when contains(word, 'e') then length(word) - length(list_reduce(list_prepend('', string_split(word, 'e')[2:]), lambda a, b: b)) - 1 else -1 end as integer) as at from t where word is not null")
def last_index(spark, d):
    return tokens(spark, d).where("word is not null").select("word").distinct().select("word", search.last_index(F.col("word"), F.lit("e")).cast("int").alias("at"))


@query()
def tag_occurrences(spark, d):
    tags = annotations(spark, d).where("reference is null and value is not null").select("doc_id", "lb", "ub", "value")
    return search.spread_tag(tags, documents(spark, d), "Durcourt", "Location")
