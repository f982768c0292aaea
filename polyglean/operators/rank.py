"""Weighted TF-IDF ranking of many queries in one job.

Scores are sums of tf * idf * weight over the query terms (repeated terms count repeatedly), with
idf = ln(N / (1 + df)) + 1. The language filter acts on ranked rows: N, df and the best score stay global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from polyglean.operators.best import candidates
from polyglean.operators.index import Index, idf
from polyglean.runtime import BROADCAST_ROWS, materialize, small
from polyglean.sources.tables import numeric_order

# Ranking weights of meaning terms by path cost, and of curated synonyms.
MEANING_WEIGHT = {0: 0.95, 1: 0.80, 2: 0.65}
SYNONYM_WEIGHT = 0.85

#: Matches of queries and postings a partition is made for, if they are aggregated and if they are passed on.
MATCHES = 1_000_000
STREAMED = 20_000_000
#: Rows of a part of a term's uses or postings.
PART = 8_192


def meaning_weight(cost: Column) -> Column:
    return F.when(cost == 0, MEANING_WEIGHT[0]).when(cost == 1, MEANING_WEIGHT[1]).otherwise(MEANING_WEIGHT[2])


def term_weights(resolved: DataFrame, vocab: DataFrame, meaning: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """(query_id, qpos, term, weight, via): query terms, then indexed meaning terms, then indexed synonyms; first wins.

    ``resolved``: (query_id, qpos, term). ``meaning``: (query_id, term, cost). ``synonyms``: (query_id, term). Query
    terms keep their repetitions.
    """
    exact = resolved.select("query_id", "qpos", "term", F.lit(1.0).alias("weight"), F.lit("exact").alias("via"))
    more = []
    if meaning is not None:
        cheap = meaning.groupBy("query_id", "term").agg(F.min("cost").alias("cost"))
        more.append(cheap.select("query_id", "term", F.lit(1).alias("rank"), meaning_weight(F.col("cost")).alias("weight"), F.lit("meaning").alias("via")))
    if synonyms is not None:
        more.append(synonyms.select("query_id", "term").distinct().select("query_id", "term", F.lit(2).alias("rank"), F.lit(SYNONYM_WEIGHT).alias("weight"), F.lit("synonym").alias("via")))
    if not more:
        return exact
    extra = more[0]
    for m in more[1:]:
        extra = extra.unionByName(m)
    extra = extra.join(resolved.select("query_id", "term"), ["query_id", "term"], "left_anti")
    extra = extra.groupBy("query_id", "term").agg(F.min(F.struct("rank", "weight", "via")).alias("r"))
    extra = extra.join(vocab.select("term"), "term", "left_semi").select("query_id", "term", "r.*")
    place = F.lit(1_000_000) + F.row_number().over(W.partitionBy("query_id").orderBy("rank", F.col("weight").desc(), "term"))
    return exact.unionByName(extra.select("query_id", place.alias("qpos"), "term", "weight", "via"))


def summed_weights(resolved: DataFrame, meaning: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """(query_id, term, weight) of ``term_weights``, without order and with terms not indexed: one row a query and term.

    The weights of repeated query terms are added up.
    """
    none = F.lit(None).cast("double")
    row = lambda df, *w: df.select("query_id", "term", *[x.alias(n) for x, n in zip(w, ("own", "meant", "near"))])
    rows = row(resolved, F.lit(1.0), none, none)
    if meaning is not None:
        rows = rows.unionByName(row(meaning, none, meaning_weight(F.col("cost")), none))
    if synonyms is not None:
        rows = rows.unionByName(row(synonyms.distinct(), none, none, F.lit(SYNONYM_WEIGHT)))
    first = F.coalesce(F.sum("own"), F.max("meant"), F.max("near"))  # the cheapest meaning weighs most
    return rows.groupBy("query_id", "term").agg(first.alias("weight"))


def term_stats(weighted: DataFrame, index: Index) -> DataFrame:
    """(query_id, qpos, term, df, postings_count, idf, weight): terms not indexed have df 0, idf 0 and weight 1."""
    df = F.coalesce(F.col("df"), F.lit(0))
    out = weighted.join(index.vocab.select("term", "df"), "term", "left")
    return out.select("query_id", "qpos", "term", df.alias("df"), df.alias("postings_count"), F.round(idf(df, F.lit(float(index.total))), 4).alias("idf"), F.when(df > 0, F.col("weight")).otherwise(1.0).alias("weight"))


def _matches(weighted: DataFrame, index: Index) -> DataFrame:
    """(query_id, qpos, term, via, doc_id, tf, idf, weight).

    A query side counted to be small is broadcast, after the postings of its terms have been put together by document:
    what is shuffled is a posting, not a match of each query with it, all matches of a query and a document then lie in
    one partition, and the best rows of a query are cut there before they are shuffled. The partitions are as many as
    the number of matches, known from the vocabulary, asks for.
    """
    value = idf(F.col("df"), F.lit(float(index.total)))
    uses = weighted.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    vocab = index.vocab.select("term", "df")
    rows, matches = uses.join(vocab, "term", "left").agg(F.sum("n"), F.sum(F.col("df") * F.col("n"))).first()
    few = (rows or 0) <= BROADCAST_ROWS  # of the query side, and so of its terms
    side = F.broadcast if few else lambda df: df
    known = vocab.join(side(weighted.select("term").distinct()), "term", "left_semi")
    hits = index.postings.select("term", "doc_id", "tf").join(side(known), "term").withColumn("idf", value)
    if few:
        cores = hits.sparkSession.sparkContext.defaultParallelism
        hits = hits.repartition(max(cores, -(-(matches or 0) // MATCHES)), "doc_id")
    return hits.join(side(weighted), "term")


def scores(weighted: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, score), unordered; partial sums are built before the shuffle."""
    m = _matches(weighted, index)
    return m.groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("score"))


def scores_with_breakdown(weighted: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, score, breakdown): breakdown in query order; one entry per matched query term."""
    c = F.col("tf") * F.col("idf") * F.col("weight")
    part = F.struct("qpos", "term", "tf", F.round("idf", 4).alias("idf"), F.round("weight", 2).alias("weight"), F.round(c, 4).alias("contribution"), "via")
    return _matches(weighted, index).groupBy("query_id", "doc_id").agg(
        F.sum(c).alias("score"), F.array_sort(F.collect_list(part)).alias("breakdown")
    )


def contributions(weighted: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, term, tf, idf, weight, contribution), rounded: a row for each query term and document with it.

    Matches are neither shuffled nor collected. The uses and the postings of a term are cut into parts of about ``PART``
    rows, and each part of one meets each of the other, so that no task gets all matches of a common term.
    """
    value = idf(F.col("df"), F.lit(float(index.total)))
    parts = lambda n: F.ceil(F.col(n) / PART).cast("int")
    uses = weighted.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    known = uses.join(index.vocab.select("term", "df"), "term").select("term", value.alias("idf"), parts("n").alias("qs"), parts("df").alias("ps"), (F.col("n") * F.col("df")).alias("matches"))
    known = materialize(known, "known")
    matches = known.agg(F.sum("matches")).first()[0] or 0
    n = max(weighted.sparkSession.sparkContext.defaultParallelism, -(-matches // STREAMED))
    side, keys = small(known.drop("matches")), ["term", "qp", "pp"]
    part = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = F.col("tf") * F.col("idf")
    asked = weighted.select("query_id", "qpos", "term", "weight").join(side, "term")
    asked = asked.select("query_id", "weight", "term", part("qs", "query_id", "qpos").alias("qp"), every("ps").alias("pp")).repartition(n, *keys)
    hits = index.postings.select("term", "doc_id", "tf").join(side, "term")
    hits = hits.select("doc_id", "tf", F.round("idf", 4).alias("idf"), one.alias("c"), F.round(one, 4).alias("c1"), "term", part("ps", "doc_id").alias("pp"), every("qs").alias("qp")).repartition(n, *keys)
    c = F.when(F.col("weight") == 1, F.col("c1")).otherwise(F.round(F.col("c") * F.col("weight"), 4))  # rounding a row costs more than the join
    return asked.join(hits, keys).select("query_id", "doc_id", "term", "tf", "idf", F.round("weight", 2).alias("weight"), c.alias("contribution"))


def document_order() -> list[Column]:
    return [-F.round("score", 9), *numeric_order(F.col("doc_id"))]


def ranked(scored: DataFrame, documents: DataFrame, lang: str = "all", limit: int = 15) -> DataFrame:
    """The first ``max(limit, 1)`` rows of each query after the language filter, with rank and relative score.

    The best score of a query is an aggregate over all languages, taken before the filter.
    """
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*document_order()))
    cut = F.col("rank") <= max(limit, 1)
    if lang == "all":  # the first row has the best score: nothing but the rows that stay is joined
        rows = scored.withColumn("rank", rank).where(cut)
        rows = rows.withColumn("best", F.max("score").over(W.partitionBy("query_id")))
        top = rows.join(documents.select("doc_id", "lang"), "doc_id")
    else:
        scored = materialize(scored, "scored")  # read for the best score and for the rows
        best = scored.groupBy("query_id").agg(F.max("score").alias("best"))
        rows = scored.join(documents.where(F.col("lang") == lang).select("doc_id", "lang"), "doc_id")
        top = rows.withColumn("rank", rank).where(cut).join(small(best), "query_id")
    return _relative(top)


def _relative(top: DataFrame) -> DataFrame:
    pct = F.round(100 * F.col("score") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0), 1)
    return top.withColumn("relative_score_pct", pct).drop("best")


def best(weighted: DataFrame, index: Index, lang: str = "all", limit: int = 15, summed: bool = False) -> DataFrame:
    """The rows of ``ranked(scores(weighted, index), ...)`` for positive weights, for many queries: no match becomes a row.

    ``summed``: ``weighted`` has each term of a query once.
    """
    uses = weighted if summed else weighted.groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))
    rows = candidates(uses, index, lang, max(limit, 1)).withColumn("best", F.max("best").over(W.partitionBy("query_id")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*document_order()))
    rows = rows.where("doc_id IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= max(limit, 1))
    if lang != "all":
        return _relative(rows.withColumn("lang", F.lit(lang)))
    source = index.documents if index.tokens is None else index.tokens
    return _relative(rows.join(source.select("doc_id", "lang"), "doc_id"))


def attribution(breakdown: Column, via: str) -> Column:
    """Matched terms of one kind (exact, meaning or synonym), in query order."""
    return F.transform(F.filter(breakdown, lambda b: b["via"] == via), lambda b: b["term"])
