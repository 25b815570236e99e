"""Benchmark decontamination over a distributed positional inverted index.

The index holds a posting (term, doc, position) for every word of the corpus that some test item uses. It is built
without a shuffle: each task writes one segment for its share of the documents, sorted by term and then by place, so
that a reader of a few terms skips most row groups and the lists are delta-coded; one record a document with term
LENGTH holds its word count. Document frequencies are counted over the whole index.

A phrase search takes the two rarest terms of each distinct phrase. Their lists, moved by the distance between the
terms, are intersected: equal (doc, pair of terms, place). Phrases that share the pair share the list work. Only blocks
of BLOCK words around such a meeting are read again, and their words are compared with the phrase word by word, which
makes every match exact. Every row on the way is bounded: a meeting is a row of its own, whatever a text repeats,
and no row holds more than a block beside it. Nothing here is Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lower_ascii, number_rows, semi_rows, small

WINDOW = 13
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LENGTH = -1
BLOCK = 128
# Ascending columns of a segment are written as deltas.
SEGMENT = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#pos": "false", "parquet.enable.dictionary#doc": "false"}


def words(text: Column) -> Column:
    """Runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F], A-Z lower-cased; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


class PositionalIndex:
    """Postings (term, doc, pos) of the words that test items use, and each document's length."""

    def __init__(self, postings: DataFrame, n_terms: int, scratch: Scratch):
        self.postings, self.n_terms, self.scratch = postings, n_terms, scratch

    @classmethod
    def build(cls, spark: SparkSession, docs: DataFrame, test_words: DataFrame, id_col: str, text_col: str) -> PositionalIndex:
        """Index every document's words that are in test_words (column `word`, distinct)."""
        scratch = Scratch(spark, "positional-index")
        vocabulary = scratch.keep(test_words.select("word", term_of(F.col("word")).alias("term")), "vocabulary")
        n_terms = vocabulary.count()
        w = docs.select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("words"))
        # The last element is the document's length record.
        each = w.select("doc", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
        ends = vocabulary.unionByName(spark.range(1).select(F.lit("").alias("word"), F.lit(LENGTH).cast("bigint").alias("term")))
        # The sort by one number is stable: documents and places stay in order within a term.
        postings = each.join(small(ends, n_terms), "word").select("term", "doc", "pos").sortWithinPartitions("term")
        return cls(scratch.keep(postings, "postings", **SEGMENT), n_terms, scratch)

    def lengths(self) -> DataFrame:
        return self.postings.where(F.col("term") == LENGTH).select("doc", F.col("pos").cast("bigint").alias("n_words"))

    def frequencies(self) -> DataFrame:
        """(term, df): postings of each term over the whole corpus."""
        return self.postings.where(F.col("term") != LENGTH).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_of(word: Column) -> Column:
    """A word's number. From a hash: no sort and no single task; equal hashes share a list, and the exact check parts them."""
    return F.shiftrightunsigned(F.xxhash64(word), 2)


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words) of items that have words."""
    return items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)


def phrases_of(items: DataFrame, window: int) -> DataFrame:
    """(item, wid, gram): every window of every item's words; equal windows have one wid, and a word is no separator."""
    size = F.least(F.lit(window), F.size("words"))
    starts = F.sequence(F.lit(0), F.size("words") - size)
    each = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s + 1, size))).alias("gram"))
    return each.select("item", F.unhex(F.md5(F.array_join("gram", " "))).alias("wid"), "gram").distinct()


def _number(gram: Column) -> Column:
    """What candidates carry in place of a gram. Grams of one number are told apart when words are compared."""
    return F.xxhash64(gram)


def _anchors(index: PositionalIndex, grams: DataFrame) -> DataFrame:
    """(wid, gram, pair, term_a, term_b, off_a, delta): the two rarest terms of each gram, b being another term than a
    where it has one, and the hash `pair` of what two lists are intersected on."""
    at = grams.select("wid", "gram", F.posexplode("gram").alias("offset", "word")).withColumn("term", term_of(F.col("word")))
    sized = at.join(small(index.frequencies(), index.n_terms), "term", "left").select("wid", "gram", F.struct(
        F.coalesce("df", F.lit(0)).alias("df"), "term", "offset").alias("t"))
    best = sized.groupBy("wid").agg(F.first("gram").alias("gram"), F.array_sort(F.collect_list("t")).alias("by_rarity"))
    two = best.select("wid", "gram", F.col("by_rarity")[0].alias("a"), F.get(F.filter(
        "by_rarity", lambda x: x["term"] != F.col("by_rarity")[0]["term"]), F.lit(0)).alias("b"))
    full = two.where("a.df > 0").select(
        "wid", "gram", F.col("a.term").alias("term_a"), F.coalesce("b.term", "a.term").alias("term_b"), F.col("a.offset").alias("off_a"),
        (F.coalesce("b.offset", "a.offset") - F.col("a.offset")).alias("delta"))
    return full.withColumn("pair", F.xxhash64("term_a", "term_b", "delta"))


def candidates(index: PositionalIndex, grams: DataFrame) -> DataFrame:
    """(doc, start, gram_no): places where the lists of a gram's two rarest terms meet."""
    anchors = index.scratch.keep(_anchors(index, grams), "anchors")
    n = anchors.count()
    one = F.col("term_a") == F.col("term_b")
    pairs = anchors.select("pair", "term_a", "term_b", "delta").distinct()
    sides = pairs.select("pair", F.explode(F.filter(F.array(
        F.struct(F.col("term_a").alias("term"), F.lit(0).alias("shift"), F.when(one, 3).otherwise(1).alias("side")),
        F.struct(F.col("term_b").alias("term"), F.col("delta").alias("shift"), F.when(one, 0).otherwise(2).alias("side"))),
        lambda x: x["side"] > 0)).alias("s")).select("pair", "s.*")
    lists = index.postings.join(small(sides, 2 * n), "term").select("doc", "pair", (F.col("pos") - F.col("shift")).alias("at"), "side")
    met = lists.groupBy("doc", "pair", "at").agg(F.bit_or("side").alias("sides")).where("sides = 3")
    return met.join(small(anchors.select("pair", _number(F.col("gram")).alias("gram_no"), "off_a"), n), "pair").select(
        "doc", (F.col("at") - F.col("off_a")).alias("start"), "gram_no").where("start >= 0")


def confirmed(docs: DataFrame, cand: DataFrame, grams: DataFrame, scratch: Scratch, id_col: str, text_col: str, window: int) -> DataFrame:
    """Matches (doc, start, wid, n): the candidates whose words are those of a gram (wid, gram), n words long."""
    placed = scratch.keep(cand.withColumn("block", F.floor(F.col("start") / BLOCK)), "candidates")
    # A document needs no more blocks than it has.
    need = scratch.keep(placed.groupBy("doc").agg(F.collect_set("block").alias("blocks")), "blocks")
    m, n = need.count(), placed.count()
    text = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    read = semi_rows(text, "doc", need, m).join(small(need, m), "doc").select("doc", "blocks", words(F.col("text")).alias("words"))
    cut = read.select("doc", F.explode(F.transform("blocks", lambda b: F.struct(
        b.alias("block"), F.slice("words", (b * BLOCK + 1).cast("int"), F.lit(BLOCK + window - 1)).alias("words")))).alias("b")).select("doc", "b.*")
    numbered = grams.select("wid", "gram", _number(F.col("gram")).alias("gram_no"))
    met = cut.join(small(placed, n), ["doc", "block"]).join(small(numbered, numbered.count()), "gram_no")
    first = (F.col("start") - F.col("block") * BLOCK + 1).cast("int")
    return met.where(F.slice("words", first, F.size("gram")) == F.col("gram")).select("doc", "start", "wid", F.size("gram").alias("n"))


def covered(found: DataFrame) -> DataFrame:
    """(doc, n_hit, spans) of matches (doc, start, n): the covered word ranges [from, to), sorted, overlapping and
    touching ones joined. One pass over a document's distinct starts in order."""
    longest = found.groupBy("doc", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    order = Window.partitionBy("doc").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = longest.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int"))
    ranges = apart.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc", "island").agg(
        F.min("start").alias("from"), F.max("end").alias("to"))
    return ranges.groupBy("doc").agg(
        F.sum(F.col("to") - F.col("from")).cast("bigint").alias("n_hit"), F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"))


def phrase_matches(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW,
                   id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lengths, matches).

    lengths: (doc, n_words) for each row of docs. matches: (doc, n_hit, spans, items) of the documents that hold a
    window of some item: spans lists the covered word ranges [from, to), sorted and merged, n_hit is their length in
    all, items the distinct items, sorted. A window is `window` consecutive words of an item, or all words of a shorter one.
    Null texts have no words, and neither do items without any; equal items each count. Texts of any length and with
    any number of matches are searched whole. Ids of documents must be unique and not null: decontaminate() numbers
    rows first. A null item id hits words but is not listed. Empty tables give no matches. Other columns are ignored.
    """
    own = item_words(items, item_col, item_text_col)
    index = PositionalIndex.build(spark, docs, own.select(F.explode("words").alias("word")).distinct(), id_col, text_col)
    scratch = index.scratch
    phrases = scratch.keep(phrases_of(own, window), "phrases")
    grams = scratch.keep(phrases.select("wid", "gram").dropDuplicates(["wid"]), "grams")
    cand = candidates(index, grams)
    found = scratch.keep(confirmed(docs, cand, grams, scratch, id_col, text_col, window), "matches")
    lengths = scratch.keep(index.lengths(), "lengths")
    scratch.drop(index.postings)
    of = phrases.select("item", "wid")
    held = found.select("doc", "wid").distinct().join(small(of, of.count()), "wid").groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return lengths, covered(found).join(held, "doc", "left").select("doc", "n_hit", "spans", F.coalesce("items", F.array().cast(dict(held.dtypes)["items"])).alias("items"))


def proximity_matches(index: PositionalIndex, phrases: DataFrame, slop: int) -> DataFrame:
    """(doc, phrase, start): places where every word of a phrase (columns phrase, words) lies within `slop` places
    of where it would stand if the phrase began at start, in any order. slop 0 finds exact phrases.

    Postings decide, no text is read again. Documents without the phrase's rarest word are put aside; in the others
    every word's list is moved to the starts that it allows, and a start that all offsets allow is a match. Null and
    empty phrases match nothing.
    """
    at = phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word"))
    known = at.withColumn("term", term_of(F.col("word"))).join(small(index.frequencies(), index.n_terms), "term", "left")
    terms = index.scratch.keep(known.select("phrase", "n", "offset", "term", F.coalesce("df", F.lit(0)).alias("df")), "proximity-terms")
    n = terms.count()
    rarest = terms.groupBy("phrase").agg(F.min(F.struct("df", "term"))["term"].alias("term"), F.min("df").alias("df")).where("df > 0")
    held = index.scratch.keep(index.postings.join(small(rarest.select("phrase", "term"), n), "term").select("doc", "phrase").distinct(), "proximity-docs")
    m = held.count()
    lists = semi_rows(index.postings, "doc", held.select("doc"), m).join(small(terms.drop("df"), n), "term").join(small(held, m), ["doc", "phrase"])
    near = lists.select("doc", "phrase", "n", "offset", F.explode(F.sequence(
        F.col("pos") - F.col("offset") - slop, F.col("pos") - F.col("offset") + slop)).alias("start"))
    return near.groupBy("doc", "phrase", "start", "n").agg(F.count_distinct("offset").alias("found")).where("found = n").select("doc", "phrase", "start")


def judge(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """decontaminate() for ids that are unique and not null."""
    lengths, found = phrase_matches(spark, docs, items, WINDOW, id_col, text_col, item_col, item_text_col)
    out = lengths.join(found.select("doc", "n_hit", "items"), "doc", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        F.col("doc").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        "items", ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items (array), contaminated.

    A word inside any occurrence of an item's window is hit; contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    Every row is judged by its own text, whether its id is null or repeated: rows are numbered first.
    Documents without words, empty tables and items without words give no hits. Texts of any length are judged whole.
    """
    rows = number_rows(spark, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "row")
    judged = judge(spark, rows, items, "row", "text", item_col, item_text_col)
    return judged.join(rows.select("row", F.col("id").alias("of")), "row").select(
        F.col("of").alias(id_col), "n_words", "n_hit", "n_items", "items", "contaminated")
