"""Inverted index as tables: documents, postings (term, doc_id, tf) and vocabulary (term, df, first)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from polyglean.functions.text import full_content, snippet, tokenize
from polyglean.runtime import materialize
from polyglean.sources.tables import numeric_order

@dataclass(frozen=True)
class Index:
    documents: DataFrame  # doc_id, title, lang, text, doc_length
    postings: DataFrame  # term, doc_id, tf
    vocab: DataFrame  # term, df, first (place of the first use in load order: breaks ties)
    total: int
    tokens: DataFrame | None = None  # doc_id, lang, tokens: written, if whole batches of queries are to be searched


def tokenized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tokens", tokenize(full_content(F.col("title"), F.col("text"))))


def with_length(docs: DataFrame) -> DataFrame:
    return tokenized(docs).withColumn("doc_length", F.size("tokens")).drop("tokens")


def occurrences(docs: DataFrame) -> DataFrame:
    """(term, doc_id, pos) of every use."""
    return tokenized(docs).select("doc_id", F.posexplode("tokens").alias("pos", "term")).select("term", "doc_id", "pos")


def build_postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, pos): uses per document and the first place; aggregated map-side before the shuffle."""
    return _count(occurrences(docs))


def _count(places: DataFrame) -> DataFrame:
    return places.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("pos"))


def build_vocab(postings: DataFrame) -> DataFrame:
    """(term, df, first); first is (not numeric, number, id, pos), in the order documents are loaded."""
    keys = numeric_order(F.col("doc_id"))
    first = F.min(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], "pos"))
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), first.alias("first"))


def build(docs: DataFrame) -> Index:
    """``docs``: (doc_id, title, lang, text), one row per id."""
    postings = build_postings(docs)
    return Index(with_length(docs), postings, build_vocab(postings), docs.count())


def save(index: Index, path: str) -> None:
    """Postings and vocabulary sorted by term, so that a term lookup prunes by file and row-group statistics."""
    index.documents.write.mode("overwrite").parquet(f"{path}/documents")
    for name in ("postings", "vocab"):
        df: DataFrame = getattr(index, name)
        df.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark, path: str) -> Index:
    docs, postings, vocab = (spark.read.parquet(f"{path}/{n}") for n in ("documents", "postings", "vocab"))
    return Index(docs, postings, vocab, docs.count())


def written(docs: DataFrame) -> Index:
    """The index of ``docs`` as tables in the shared folder, for use in several steps: texts are tokenized once.

    For lookups of single terms over a large collection ``save`` also sorts by term.
    """
    tokens = materialize(tokenized(docs), "tokens")
    places = tokens.select("doc_id", F.posexplode("tokens").alias("pos", "term"))
    postings = materialize(_count(places), "postings")
    documents = tokens.withColumn("doc_length", F.size("tokens")).drop("tokens")
    return Index(documents, postings, materialize(build_vocab(postings), "vocab"), tokens.count())


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vocabulary of each batch of (doc_id, number, tokens)."""
    for batch in batches:
        keys = pa.table({"number": batch["number"], "named": pc.is_valid(batch["doc_id"]), "doc_id": batch["doc_id"]})
        rows = batch.take(pc.sort_indices(keys, [(k, "ascending") for k in keys.column_names]))  # no number: last
        length = pc.list_value_length(rows["tokens"]).to_numpy(zero_copy_only=False)
        coded = rows["tokens"].flatten().dictionary_encode()
        code, terms = coded.indices.to_numpy(), len(coded.dictionary)
        doc, at = np.repeat(np.arange(len(rows)), length), np.arange(len(code))
        df = np.bincount(np.unique(doc * terms + code) % max(terms, 1), minlength=terms)
        use = np.zeros(terms, np.int64)
        use[code[::-1]] = at[::-1]  # the first one is set last
        of = pa.array(doc[use])
        number, pos = rows["number"].take(of), use - (np.cumsum(length) - length)[doc[use]]
        first = pa.StructArray.from_arrays([pc.is_null(number), number, rows["doc_id"].take(of), pa.array(pos.astype(np.int32))], ["k0", "k1", "k2", "pos"])
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df.astype(np.int64)), first], ["term", "df", "first"])


def for_batches(docs: DataFrame) -> Index:
    """The index of ``docs`` for whole batches of queries: tokens and vocabulary are written, postings only planned.

    A document lies whole in one row, so its terms are counted there without a shuffle of postings.
    """
    tokens = materialize(tokenized(docs).select("doc_id", "lang", "tokens"), "tokens")
    rows = tokens.select("doc_id", F.col("doc_id").try_cast("bigint").alias("number"), "tokens")
    parts = rows.mapInArrow(_vocabulary, "term STRING, df BIGINT, first STRUCT<k0: BOOLEAN, k1: BIGINT, k2: STRING, pos: INT>")
    vocab = materialize(parts.groupBy("term").agg(F.sum("df").alias("df"), F.min("first").alias("first")), "vocab")
    places = tokens.select("doc_id", F.posexplode("tokens").alias("pos", "term"))
    return Index(with_length(docs), _count(places), vocab, tokens.count(), tokens)


def add_documents(docs: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: a document replaces the one of the same id."""
    return docs.join(new, "doc_id", "left_anti").unionByName(new.select(*docs.columns))


def delete_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids, "doc_id", "left_anti")


def next_id(docs: DataFrame) -> DataFrame:
    n = F.coalesce(F.max(F.col("doc_id").try_cast("bigint")), F.lit(0)) + 1
    return docs.agg(n.alias("next_id"))


def idf(df, total):
    return F.when(df > 0, F.log(total / (1.0 + df)) + 1.0).otherwise(0.0)


def index_stats(index: Index) -> DataFrame:
    d = index.documents.agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.round(F.avg("doc_length"), 1).alias("avg_doc_length"),
        F.count_distinct("lang").alias("languages_count"),
    )
    v = index.vocab.agg(F.count(F.lit(1)).alias("vocab_size"), F.sum("df").alias("total_postings"))
    return d.withColumn("k", F.lit(1)).join(F.broadcast(v.withColumn("k", F.lit(1))), "k").drop("k")  # one row each


def lang_distribution(docs: DataFrame) -> DataFrame:
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))


def term_details(index: Index, terms: list[str]) -> DataFrame:
    """(term, doc_freq, doc_id, tf, title, lang, snippet) of the given terms; filters reach the posting scan."""
    wanted = [t.lower() for t in terms]
    hits = index.postings.where(F.col("term").isin(wanted)).select("term", "doc_id", "tf")
    df = F.broadcast(index.vocab.where(F.col("term").isin(wanted)).select("term", F.col("df").alias("doc_freq")))
    docs = index.documents.select("doc_id", "title", "lang", snippet(F.col("text"), 140).alias("snippet"))
    return hits.join(df, "term").join(docs, "doc_id")


def naive_scan(docs: DataFrame, query: list[str], with_title: bool = True) -> DataFrame:
    """(doc_id, score): how many query terms each document holds, by scanning every text; the baseline of the index."""
    text = full_content(F.col("title"), F.col("text")) if with_title else F.col("text")
    toks = tokenize(text)
    score = F.size(F.filter(F.array(*[F.lit(t) for t in query]), lambda t: F.array_contains(F.col("tokens"), t)))
    return docs.select("doc_id", toks.alias("tokens")).select("doc_id", score.alias("score")).where("score > 0")


def catalog(docs: DataFrame) -> DataFrame:
    """(doc_id, title, lang, text, word_count, snippet, total), by id, numeric ids first.

    The words are the indexed tokens of title and text; total is the number of all documents.
    """
    cut = snippet(F.col("text"), 160).alias("snippet")
    out = tokenized(docs).select("doc_id", "title", "lang", "text", F.size("tokens").alias("word_count"), cut)
    return out.withColumn("total", F.lit(docs.count())).orderBy(*numeric_order(F.col("doc_id")))


def substring_filter(docs: DataFrame, text: str, lang: str = "all") -> DataFrame:
    needle = text.lower()
    hit = F.lower("title").contains(needle) | F.lower("text").contains(needle)
    out = docs.where(hit)
    return out if lang == "all" else out.where(F.col("lang") == lang)
