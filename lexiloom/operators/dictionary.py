"""Dictionaries as lexicon tables: membership, maps, multiword entries, directories.

A lexicon has one row per entry: (dict, priority, entry, mapped). Token look-ups
are joins on the word; multiword look-ups are joins on n-grams, built with lead()
over the sentence window, so that no sentence is gathered. Join strategies are
left to the optimizer and its size estimates; nothing is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEP = "\x01"


def compiled(lines: DataFrame, col: str = "value") -> DataFrame:
    """(key, n): distinct entries of a text lexicon, words joined by U+0001; blank lines and # comments fall out."""
    c = F.trim(F.regexp_replace(F.col(col), "#.*$", ""))
    words = F.split(c, r"\s+")
    return lines.select(c.alias("_c"), words.alias("_w")).where("_c <> ''").select(F.array_join("_w", SEP).alias("key"), F.size("_w").alias("n")).distinct()


def keyed(lexicon: DataFrame, entry: str = "entry", nocase: bool = False) -> DataFrame:
    """The lexicon with `key` (entry words joined by U+0001) and `n`; null and blank entries fall out."""
    c = F.trim(F.col(entry))
    c = F.lower(c) if nocase else c
    words = F.split(c, r"\s+")
    return lexicon.where(F.col(entry).isNotNull() & (c != "")).withColumn("key", F.array_join(words, SEP)).withColumn("n", F.size(words))


def contains(lexicon: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys that are entries."""
    return keys.join(lexicon.select("key").distinct(), "key", "left_semi")


def remove(lexicon: DataFrame, keys: DataFrame) -> DataFrame:
    return lexicon.join(keys.select("key").distinct(), "key", "left_anti")


def insert(lexicon: DataFrame, entries: DataFrame) -> DataFrame:
    return lexicon.unionByName(entries).dropDuplicates(["key"])


def under(lexicon: DataFrame, prefix: str) -> DataFrame:
    """Entries that begin with the words of `prefix`."""
    p = SEP.join(prefix.split())
    return lexicon.where((F.col("key") == p) | F.col("key").startswith(p + SEP))


def token_flag(tokens: DataFrame, entries: DataFrame, out: str, word: str = "word", entry: str = "entry") -> DataFrame:
    """`tokens` with a boolean: whether the word is an entry. Null words aren't."""
    known = entries.select(F.col(entry).alias("_k")).where("_k is not null").distinct().withColumn("_hit", F.lit(True))
    return tokens.join(known, tokens[word] == known["_k"], "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def token_flags(tokens: DataFrame, lexicon: DataFrame, word: str = "word", entry: str = "entry", name: str = "dict") -> DataFrame:
    """`tokens` with `dicts`, the sorted names of all dictionaries that hold the word: one join for any number of them."""
    sets = lexicon.where(F.col(entry).isNotNull()).groupBy(F.col(entry).alias("_k")).agg(F.array_sort(F.collect_set(name)).alias("dicts"))
    return tokens.join(sets, tokens[word] == sets["_k"], "left").drop("_k").withColumn("dicts", F.coalesce("dicts", F.array().cast("array<string>")))


def mapped(tokens: DataFrame, mapping: DataFrame, out: str, word: str = "word", key: str = "entry", value: str = "mapped", default: str = "O") -> DataFrame:
    """`tokens` with the value of the word in a map dictionary, else the default; repeated keys take the least value, a missing value is empty."""
    m = mapping.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(F.coalesce(F.col(value), F.lit(""))).alias("_v"))
    return tokens.join(m, tokens[word] == m["_k"], "left").withColumn(out, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def candidates(tokens: DataFrame, lexicon: DataFrame, word: str = "word", nocase: bool = False, lengths: list[int] | None = None) -> DataFrame:
    """(doc_id, sent, pos, last, n, key and the lexicon's columns): every place at which an entry stands.

    The lengths that occur in the lexicon are looked up first (a handful of
    numbers) unless given; each gives one lead() per further word over one shared window.
    """
    lengths = sorted(lengths) if lengths is not None else sorted(r["n"] for r in lexicon.select("n").distinct().collect())
    w = Window.partitionBy("doc_id", "sent").orderBy("pos")
    c = F.lower(F.col(word)) if nocase else F.col(word)
    t = tokens.select("doc_id", "sent", "pos", c.alias("_w"), F.max("pos").over(Window.partitionBy("doc_id", "sent")).alias("last"))
    most = max(lengths, default=1)
    t = t.select("doc_id", "sent", "pos", "last", *[(F.lead("_w", i).over(w) if i else F.col("_w")).alias(f"_w{i}") for i in range(most)])

    # only where an entry begins are longer runs of words put together
    first = lexicon.select(F.element_at(F.split("key", SEP), 1).alias("_first")).distinct()
    t = t.join(first, t["_w0"] == first["_first"], "left_semi")

    def gram(n: int) -> Column:
        parts = [F.col(f"_w{i}") for i in range(n)]
        whole = parts[0].isNotNull()
        for p in parts[1:]:
            whole = whole & p.isNotNull()
        return F.when(whole, F.struct(F.lit(n).alias("n"), F.concat_ws(SEP, *parts).alias("key")))

    grams = t.select("doc_id", "sent", "pos", "last", F.explode(F.array_compact(F.array(*[gram(n) for n in lengths]))).alias("_g")) if lengths else t.select("doc_id", "sent", "pos", "last", F.explode(F.expr("cast(array() as array<struct<n:int,key:string>>)")).alias("_g"))
    grams = grams.select("doc_id", "sent", "pos", "last", "_g.n", "_g.key")
    return grams.join(lexicon, ["n", "key"])


def longest_matches(tokens: DataFrame, lexicon: DataFrame, word: str = "word", nocase: bool = False, value: str | None = None, last_exception: bool = True, lengths: list[int] | None = None) -> DataFrame:
    """(doc_id, sent, lb, ub, value): greedy leftmost-longest matches that don't overlap, in token positions.

    With `last_exception`, a sentence's last token that is an entry by itself is
    a match even inside a longer one. Only sentences with candidates are
    gathered, and of those the candidates alone.
    """
    c = candidates(tokens, lexicon, word, nocase, lengths)
    c = c.withColumn("_v", F.col(value).cast("string") if value else F.lit(None).cast("string"))
    best = c.groupBy("doc_id", "sent", "pos", "last").agg(F.max("n").alias("n"), F.min_by("_v", F.struct(-F.col("n"), F.col("_v"))).alias("_v"), F.min(F.when(F.col("n") == 1, F.coalesce("_v", F.lit("")))).alias("_one"))
    per = best.groupBy("doc_id", "sent", "last").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "_v", "_one"))).alias("c"))
    start = "cast(array() as array<struct<lb:int,ub:int,value:string>>)"
    single = "x.pos = last and x._one is not null" if last_exception else "false"
    chosen = F.expr(f"""aggregate(c, {start}, (a, x) ->
        case when {single} then a || array(struct(x.pos as lb, x.pos + 1 as ub, nullif(x._one, '') as value))
             when x.pos >= coalesce(try_element_at(a, -1).ub, 0) {"and x.pos < last" if last_exception else ""} then a || array(struct(x.pos as lb, x.pos + x.n as ub, x._v as value))
             else a end)""")
    return per.select("doc_id", "sent", F.explode(chosen).alias("m")).select("doc_id", "sent", "m.lb", "m.ub", "m.value")


def multiword(tokens: DataFrame, lexicon: DataFrame, out: str, suffix: str = "", word: str = "word", nocase: bool = False, last_exception: bool = True, lengths: list[int] | None = None) -> DataFrame:
    """`tokens` with B/I/O of the greedy leftmost-longest matches of a multiword dictionary."""
    m = longest_matches(tokens, lexicon, word, nocase, None, last_exception, lengths)
    cells = m.select("doc_id", "sent", F.posexplode(F.expr("sequence(lb, ub - 1)")).alias("_i", "pos"))
    # a later match overwrites an earlier one's tail, which only the last-token rule brings about
    cells = cells.groupBy("doc_id", "sent", "pos").agg(F.min("_i").alias("_i"))
    return tokens.join(cells, ["doc_id", "sent", "pos"], "left").withColumn(out, F.when(F.col("_i") == 0, "B" + suffix).when(F.col("_i") > 0, "I" + suffix).otherwise("O")).drop("_i")


def directory(tokens: DataFrame, lexicon: DataFrame, word: str = "word", nocase: bool = True, name: str = "dict", ambiguous: bool = False) -> DataFrame:
    """(doc_id, sent, lb, ub, value): matches of many lexica at once, one label per place.

    Each lexicon is matched greedily by itself; of overlapping matches the
    earlier, then the longer, then the one of the lexicon with the least
    priority stays (null priorities come last, equal ones go by name). With
    `ambiguous`, equal places keep all their labels, joined by |.
    """
    c = candidates(tokens, lexicon, word, nocase)
    best = c.groupBy("doc_id", "sent", name, "pos").agg(F.max("n").alias("n"), F.min(F.coalesce("priority", F.lit(2**31 - 1))).alias("prio"))
    per = best.groupBy("doc_id", "sent", name).agg(F.array_sort(F.collect_list(F.struct("pos", "n", "prio"))).alias("c"))
    own = per.select("doc_id", "sent", name, F.explode(F.expr("aggregate(c, cast(array() as array<struct<lb:int,ub:int,prio:int>>), (a, x) -> case when x.pos >= coalesce(try_element_at(a, -1).ub, 0) then a || array(struct(x.pos as lb, x.pos + x.n as ub, cast(x.prio as int) as prio)) else a end)")).alias("m"))
    own = own.select("doc_id", "sent", F.col(name).alias("label"), "m.*")
    if ambiguous:
        own = own.groupBy("doc_id", "sent", "lb", "ub").agg(F.min("prio").alias("prio"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("prio", "label"))), lambda x: x["label"]), "|").alias("label"))
    every = own.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("lb", (-F.col("ub")).alias("nub"), "prio", "label"))).alias("c"))
    kept = F.expr("aggregate(c, cast(array() as array<struct<lb:int,ub:int,value:string>>), (a, x) -> case when x.lb >= coalesce(try_element_at(a, -1).ub, 0) then a || array(struct(x.lb as lb, -x.nub as ub, x.label as value)) else a end)")
    return every.select("doc_id", "sent", F.explode(kept).alias("m")).select("doc_id", "sent", "m.*")


def merge_with_gold(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold and found tags (doc_id, sent, lb, ub, value) together.

    A found tag falls out where a gold tag has its place, or a longer gold tag
    shares one end with it; gold tags strictly inside a found one that stays fall out.
    """
    g = gold.select("doc_id", "sent", F.col("lb").alias("glb"), F.col("ub").alias("gub"))
    clash = (F.col("glb") == F.col("lb")) & (F.col("gub") >= F.col("ub")) | (F.col("gub") == F.col("ub")) & (F.col("glb") <= F.col("lb"))
    keep = found.join(g.withColumnRenamed("doc_id", "_d").withColumnRenamed("sent", "_s"), (F.col("doc_id") == F.col("_d")) & (F.col("sent") == F.col("_s")) & clash, "left_anti")
    f = keep.select(F.col("doc_id").alias("_d"), F.col("sent").alias("_s"), F.col("lb").alias("flb"), F.col("ub").alias("fub"))
    inside = (F.col("flb") <= F.col("lb")) & (F.col("ub") <= F.col("fub"))
    stay = gold.join(f, (F.col("doc_id") == F.col("_d")) & (F.col("sent") == F.col("_s")) & inside, "left_anti")
    return stay.unionByName(keep)
