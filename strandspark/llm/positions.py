"""Benchmark decontamination with a distributed positional inverted index.

The index holds postings (term, row, position) of the documents' words. It is
partitioned by document: every task writes a segment of its own, sorted by term, so
building it moves no text and no posting between machines. A document ends with a
posting of its own (term ``END``) that carries its id and its number of words; the
documents are therefore read once only. A dictionary gives the words their numbers;
with the dictionary of the test texts, postings that no test text asks for are left
out of the segments.

A phrase is looked up from its rarest words. Their lists, each shifted by the word's
offset in the phrase, are intersected (a shuffle of as many rows as the rare lists
have); what survives expects its other words at known places and is intersected with
their lists by an equi-join on (row, position, term). Equal phrases of different
items are looked up once. Proximity asks for all words of a phrase inside a stretch
of ``span`` words, from the same lists.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.
Broadcast are the dictionary and the list of candidate rows while they are smaller than
the bounds below, which are checked; beyond them the same joins shuffle. DataFrame
functions only.

Defined results: null and empty texts have no words and are never hit; rows with equal
or null ids are documents of their own; very long texts are indexed whole; items with
one id are one item, those without an id together one with the empty text as its name; an item
shorter than a window is one window, one without words is none; empty tables give empty
(no documents) or unhit (no items) results; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.runtime import fewer, written

WINDOW = 10
#: Term of the posting at a document's end.
END = -1
#: Lists that are intersected before the candidates are looked at word by word.
RAREST = 2
#: Words of a dictionary, phrases' rare words, and candidate rows up to which they are broadcast.
MAX_BROADCAST_TERMS = 500_000
MAX_BROADCAST_ROWS = 1_000_000
#: All that stands between words; upper-case letters belong to words that are lower-cased afterwards.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a document's end among its words; never a word itself.
_END_MARK = " "


def lowered(word: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The words of a text, as an array."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")
    return F.transform(parts, lowered)


def dictionary(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, term): every word of the texts and its number."""
    every = texts.select(F.explode(words(F.col(text_col))).alias("word")).distinct()
    return written(every.withColumn("term", F.monotonically_increasing_id()), "dictionary")


def _small(df: DataFrame, bound: int) -> DataFrame:
    """``df`` to be broadcast, if its rows are ``bound`` at most."""
    return F.broadcast(df) if df.count() <= bound else df


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, row, pos, id) of the words in ``terms``; ``id`` in a document's last one only."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), BETWEEN).alias("parts")).withColumn("row", F.monotonically_increasing_id())
    # a text that begins (ends) between words has an empty first (last) part
    head = (F.get("parts", F.lit(0)) == "").cast("int")
    tail = ((F.size("parts") > 1) & (F.element_at("parts", -1) == "")).cast("int")
    d = d.select("id", "row", head.alias("head"), tail.alias("tail"), F.posexplode(F.concat("parts", F.array(F.lit(_END_MARK)))).alias("pos", "part"))
    last = F.col("part") == _END_MARK
    d = d.where("part <> ''").select("id", "row", (F.col("pos") - F.col("head") - F.when(last, F.col("tail")).otherwise(0)).alias("pos"), lowered(F.col("part")).alias("word"))
    ends = terms.sparkSession.createDataFrame([(_END_MARK, END)], "word string, term long")
    postings = d.join(_small(terms.select("word", "term").unionByName(ends), MAX_BROADCAST_TERMS), "word")
    postings = postings.select("term", "row", "pos", F.when(F.col("term") == END, F.col("id")).alias("id"))
    return written(postings.sortWithinPartitions("term"), "postings")


def documents_of(index: DataFrame) -> DataFrame:
    """(row, id, n_words) of every document."""
    return index.where(F.col("term") == END).select("row", "id", F.col("pos").cast("long").alias("n_words"))


def phrases(items: DataFrame, length: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrase, words) of every different window of the items, and (phrase, item) links."""
    own = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), words(F.col(f"`{text_col}`")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - length + 1, F.lit(1)))
    cut = written(own.select("item", "all", F.explode(starts).alias("at")).select("item", F.slice("all", F.col("at"), length).alias("words")).distinct(), "windows")
    different = written(cut.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    return different.select("phrase", "words"), cut.join(different, "words").select("phrase", "item").distinct()


def _ordered(index: DataFrame, phrases_: DataFrame, terms: DataFrame) -> DataFrame:
    """(phrase, size, list) of the phrases whose words all occur: structs (n, offset, term), rarest first."""
    n = written(index.where(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "term-counts")
    parts = phrases_.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word"))
    known = parts.join(terms.join(n, "term"), "word")
    own = known.groupBy("phrase", "size").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("list"))  # a window's words
    own = own.where(F.size("list") == F.col("size"))
    return written(fewer(own, own.count()), "probes")


def _lists(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(row, phrase, pos, offset, term): postings of the terms that ``probes`` (phrase, offset, term) asks for."""
    return index.where(F.col("term") != END).select("term", "row", "pos").join(_small(probes, MAX_BROADCAST_ROWS), "term")


def exact_matches(index: DataFrame, phrases_: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, phrase, start, size): every place of a document where a phrase's words follow each other."""
    probes = _ordered(index, phrases_, terms)
    rare = probes.select("phrase", F.least("size", F.lit(RAREST)).alias("need"), F.explode(F.slice("list", 1, RAREST)).alias("x")).select("phrase", "need", "x.offset", "x.term")
    shifted = _lists(index, rare).withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    met = shifted.groupBy("row", "phrase", "start").agg(F.count(F.lit(1)).alias("lists"), F.first("need").alias("need")).where("lists = need").select("row", "phrase", "start")
    met = written(met, "candidates")
    short = met.join(probes.where(F.col("size") <= RAREST).select("phrase", "size"), "phrase").select("row", "phrase", "start", "size")
    rest = probes.where(F.col("size") > RAREST).select("phrase", "size", F.explode(F.slice("list", RAREST + 1, F.col("size"))).alias("x"))
    expected = met.join(rest, "phrase").select("row", "phrase", "start", "size", (F.col("start") + F.col("x.offset")).alias("pos"), F.col("x.term").alias("term"))
    rows = _small(met.select("row").distinct(), MAX_BROADCAST_ROWS)
    near = index.where(F.col("term") != END).select("term", "row", "pos").join(rows, "row", "left_semi")
    whole = expected.join(near, ["row", "pos", "term"]).groupBy("row", "phrase", "start", "size").agg(F.count(F.lit(1)).alias("found"))
    return short.unionByName(whole.where(F.col("found") == F.col("size") - RAREST).select("row", "phrase", "start", "size"))


def near_matches(index: DataFrame, phrases_: DataFrame, terms: DataFrame, span: int) -> DataFrame:
    """(row, phrase, start): places where one of a phrase's words stands and all its different
    words stand within ``span`` words from there, in any order.

    Only postings in the neighbourhood of the phrase's rarest word are looked at, in
    stretches of ``span`` words, so a place meets at most ``2 * span`` others.
    """
    probes = _ordered(index, phrases_, terms)
    distinct = probes.select("phrase", "list", F.size(F.array_distinct(F.transform("list", lambda x: x["term"]))).alias("need"))
    around = lambda c: (F.floor(c / span)).cast("long")
    first = _lists(index, distinct.select("phrase", F.col("list")[0]["term"].alias("term")))
    near = written(first.select("row", "phrase", F.explode(F.sequence(around(F.col("pos")) - 1, around(F.col("pos")) + 1)).alias("stretch")).distinct(), "neighbourhoods")
    every = distinct.select("phrase", "need", F.explode(F.array_distinct(F.transform("list", lambda x: x["term"]))).alias("term"))
    lists = index.where(F.col("term") != END).select("term", "row", "pos").join(_small(near.select("row").distinct(), MAX_BROADCAST_ROWS), "row", "left_semi")
    own = lists.join(_small(every, MAX_BROADCAST_ROWS), "term").withColumn("stretch", around(F.col("pos")))
    own = written(own.join(near, ["row", "phrase", "stretch"], "left_semi"), "near-postings")
    other = own.select("row", "phrase", F.explode(F.array(F.col("stretch") - 1, F.col("stretch"))).alias("stretch"), F.col("term").alias("other"), F.col("pos").alias("at"))
    pairs = own.join(other, ["row", "phrase", "stretch"]).where((F.col("at") >= F.col("pos")) & (F.col("at") < F.col("pos") + span))
    full = pairs.select("row", "phrase", "need", "pos", "other").distinct().groupBy("row", "phrase", "need", "pos").agg(F.count(F.lit(1)).alias("have"))
    return full.where("have = need").select("row", "phrase", F.col("pos").alias("start"))


def contamination(docs: DataFrame, items: DataFrame, length: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document:
    its words inside occurrences of the items' windows, and the items these belong to."""
    terms = dictionary(items, item_text_col)
    windows, links = phrases(items, length, item_col, item_text_col)
    index = build_index(docs, terms, id_col, text_col)
    found = written(exact_matches(index, windows, terms), "matches")
    hit = found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    own = found.select("row", "phrase").distinct().join(links, "phrase").select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))  # a document's items
    out = documents_of(index).join(hit, "row", "left").join(own, "row", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    hits = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("id").alias("doc_id"), "n_words", hits.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))
