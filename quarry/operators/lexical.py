"""Task-to-symbol ranking: weighted fields, BM25, an adaptive cut and the router."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import keep
from ..functions.text import STOPWORDS, is_camel, is_snake, lower_ascii, query_terms, query_words, subtokens
from .ordering import number_rows, with_previous

K1, B = 1.5, 0.75
W_NAME, W_CALLEE, W_BODY = 3, 1, 1
FLOOR, CEILING, CLIFF = 5, 40, 0.20


def symbol_fields(symbols: DataFrame, edges: DataFrame, bodies: DataFrame) -> DataFrame:
    """(sym_id, text, w): names weigh 3, names of callees 1, bodies(sym_id, text) 1."""
    names = symbols.select("sym_id", F.col("name").alias("text"), F.lit(W_NAME).alias("w"))
    callee = symbols.select(F.col("sym_id").alias("dst"), "name")
    calls = edges.join(callee, "dst").select(F.col("src").alias("sym_id"), F.col("name").alias("text"), F.lit(W_CALLEE).alias("w"))
    return names.unionByName(calls).unionByName(bodies.select("sym_id", "text", F.lit(W_BODY).alias("w")))


def terms_of(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]


def _equals(term: str):
    return lambda x: x == term


def bm25_many(fields: DataFrame, queries: dict[str, list[str]], id_col: str = "sym_id") -> DataFrame:
    """(query, id, score) of every id in fields(id, text, w), for each named list of terms.

    The queries' terms are few, so each becomes a column: one aggregation by id gives lengths and frequencies, and a
    second one, of one row, document frequencies and the mean length. Texts are read and split once for all queries,
    and no token list is ever exploded.
    """
    terms = list(dict.fromkeys(t for ts in queries.values() for t in ts))
    toks = fields.select(id_col, "w", subtokens(F.coalesce("text", F.lit(""))).alias("toks"))
    w = F.col("w")
    tf = [F.sum(w * F.size(F.filter("toks", _equals(t)))).cast("double").alias(f"tf{i}") for i, t in enumerate(terms)]
    docs = keep(toks.groupBy(id_col).agg(F.sum(w * F.size("toks")).cast("double").alias("dl"), *tf), "bm25")
    seen = docs.agg(F.count(F.lit(1)).alias("s"), F.avg("dl").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(terms))]).first()

    def score_of(wanted: list[str]) -> Column:
        score: Column = F.lit(0.0)
        for i in map(terms.index, wanted):
            f, idf = F.col(f"tf{i}"), math.log((seen["s"] - seen[f"n{i}"] + 0.5) / (seen[f"n{i}"] + 0.5) + 1.0)
            norm = f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(seen["mean"] or 1.0))
            score = score + F.when(f > 0, F.lit(idf) * f * F.lit(K1 + 1) / norm).otherwise(0.0)
        return score

    each = F.array(*[F.struct(F.lit(name).alias("query"), score_of(ts).alias("score")) for name, ts in queries.items()])
    return docs.select(id_col, F.explode(each).alias("q")).select("q.query", id_col, "q.score")


def bm25(fields: DataFrame, terms: list[str], id_col: str = "sym_id") -> DataFrame:
    """(id, score) of every id in fields(id, text, w)."""
    return bm25_many(fields, {"": terms}, id_col).select(id_col, "score")


def ranked(scores: DataFrame, id_col: str = "sym_id") -> DataFrame:
    """Positive scores with r, 1 for the best; ties by id."""
    return number_rows(scores.where("score > 0"), [F.desc("score"), F.col(id_col)], "r").withColumn("r", F.col("r") + 1)


def cut_summaries(scores: DataFrame, queries: DataFrame, id_col: str = "sym_id", floor: int = FLOOR, ceiling: int = CEILING, cliff: float = CLIFF) -> DataFrame:
    """A row for each of queries(query): positives, kept, hit_ceiling, margin_pct, confidence, from scores(query, id, score).

    Drops between neighbours in descending order are taken relative to the upper one. The first largest drop
    below the ceiling cuts if it is a cliff, but at least `floor` are kept; else the ceiling does. All queries' scores
    are put in one order.
    """
    places = number_rows(scores.where("score > 0").select("query", id_col, "score"), ["query", F.desc("score"), F.col(id_col)], "place")
    starts = places.groupBy("query").agg(F.min("place").alias("start"))
    own = places.withColumn("own", F.struct("query", "score"))
    near = with_previous(own, "place", "own", "before").join(F.broadcast(starts), "query")
    drop = F.when(F.col("before.query") == F.col("query"), (F.col("before.score") - F.col("score")) / F.col("before.score"))
    drops = near.select("query", (F.col("place") - F.col("start")).alias("i"), drop.alias("d"))
    top = F.max(F.when(F.col("d").isNotNull() & (F.col("i") < ceiling), F.struct("d", (-F.col("i")).alias("i"))))
    met = drops.groupBy("query").agg(F.count(F.lit(1)).alias("positives"), F.max("d").alias("any"), top.alias("top"))
    a = queries.select("query").join(met, "query", "left").withColumn("positives", F.coalesce("positives", F.lit(0).cast("bigint")))
    least = F.least(F.lit(floor), F.col("positives"))
    most = F.greatest(F.least(F.lit(ceiling), F.col("positives")), least)
    cut = F.coalesce(F.col("top.d"), F.lit(0.0)) >= F.lit(cliff)
    pct = lambda d: F.floor(F.lit(100.0) * d + F.lit(0.5)).cast("int")
    kept = F.when(F.col("positives") == 0, F.lit(floor)).when(cut, F.greatest(-F.col("top.i"), least)).otherwise(most)
    margin = F.when(cut, pct(F.col("top.d"))).when(F.coalesce("any", F.lit(0.0)) >= F.lit(cliff), pct(F.col("any"))).otherwise(F.lit(0))
    out = a.select("query", "positives", kept.cast("bigint").alias("kept"), (~cut).alias("hit_ceiling"), margin.alias("margin_pct"), cut.alias("cut"))
    sure = F.col("cut") | ((F.col("positives") > 0) & (F.col("positives") <= F.col("kept")))
    return out.select("query", "positives", "kept", "hit_ceiling", "margin_pct", F.when(sure, "high").otherwise("low").alias("confidence"))


def cut_summary(scores: DataFrame, id_col: str = "sym_id", floor: int = FLOOR, ceiling: int = CEILING, cliff: float = CLIFF) -> DataFrame:
    """One row of cut_summaries for scores(id, score)."""
    one = scores.sparkSession.range(1).select(F.lit("").alias("query"))
    return cut_summaries(scores.withColumn("query", F.lit("")), one, id_col, floor, ceiling, cliff).drop("query")


def route(names: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(query) with name_exact, reason and the first word that hit: whether a query reads like a name.

    Of the words that are no stopwords, camelCase and snake_case ones count as hits, and so do those that equal some
    name whatever the case. A query is name-exact if it has a camel or snake word and at most two words, or if all
    its words hit.
    """
    word = F.posexplode_outer(F.filter(query_words(F.col("query")), lambda w: ~lower_ascii(w).isin(*STOPWORDS)))
    words = queries.select("query", word.alias("pos", "word"))
    known = names.select(lower_ascii(F.col("name")).alias("low")).distinct().withColumn("known", F.lit(True))
    shaped = F.coalesce(is_camel(F.col("word")) | is_snake(F.col("word")), F.lit(False))
    met = words.withColumn("low", lower_ascii(F.col("word"))).join(known, "low", "left")
    hit = shaped | F.coalesce("known", F.lit(False))
    per = met.groupBy("query").agg(
        F.count("word").alias("n"), F.bool_or(shaped).alias("shaped"), F.count_if(hit).alias("hits"),
        F.min(F.when(hit, F.struct("pos", "word")))["word"].alias("named"))
    exact = (F.col("shaped") & (F.col("n") <= 2)) | ((F.col("n") > 0) & (F.col("hits") == F.col("n")))
    reason = F.when(exact, "name-exact").when(F.col("n") >= 3, "conceptual").otherwise("broad")
    return per.select("query", exact.alias("name_exact"), reason.alias("reason"), F.when(exact, F.col("named")).alias("named"), "n", "hits")
