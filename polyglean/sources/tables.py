"""Document sources and sinks: corpus tables, JSON corpora, versioned link stores, dictionary tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from polyglean.runtime import files

CORPUS_SCHEMA = "id STRING, title STRING, lang STRING, text STRING"
LINK_SCHEMA = "a STRING, b STRING, cost INT, hub STRING"
DICTIONARY_SCHEMA = (
    "term STRING, found BOOLEAN, complete BOOLEAN, summary STRING, url STRING, direct_glosses ARRAY<STRING>, "
    "inflection_roots ARRAY<STRING>, thesaurus_synonyms ARRAY<STRING>, "
    "links ARRAY<STRUCT<term: STRING, cost: INT, hub_side: STRING>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numeric_order(doc_id: Column) -> list[Column]:
    """Sort keys: numeric ids by value, then all others as text."""
    number = doc_id.try_cast("bigint")
    return [number.isNull(), number, doc_id]


def documents(corpus: DataFrame) -> DataFrame:
    """(doc_id, title, lang, text): the last delivery of each id; a missing title or text is empty, a missing lang 'en'."""
    last = corpus.groupBy(F.col("id").alias("doc_id")).agg(F.max(F.struct("loaded_at", "title", "lang", "text")).alias("r"))
    e = lambda c, d: F.coalesce(F.col(f"r.{c}"), F.lit(d)).alias(c)
    return last.select("doc_id", e("title", ""), e("lang", "en"), e("text", ""))


def read_json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus kept as one JSON array; a missing file is an empty corpus."""
    try:
        df = spark.read.schema(CORPUS_SCHEMA).option("multiLine", True).json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        df = spark.createDataFrame([], CORPUS_SCHEMA)
    return df.withColumnRenamed("id", "doc_id").withColumns(
        {"title": F.coalesce("title", F.lit("")), "lang": F.coalesce("lang", F.lit("en")), "text": F.coalesce("text", F.lit(""))}
    )


def write_corpus(docs: DataFrame, path: str, fmt: str = "json") -> None:
    """Whole corpus, ordered by id (numeric ids first)."""
    ordered = docs.orderBy(*numeric_order(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "title", "lang", "text")
    ordered.write.mode("overwrite").format(fmt).save(path)


def require_valid(docs: DataFrame) -> DataFrame:
    """Rows that may be added: title and text not blank; a missing lang is 'en'."""
    trimmed = docs.withColumns({c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")) for c in ("title", "text")})
    return trimmed.where("title <> '' AND text <> ''").withColumn("lang", F.coalesce("lang", F.lit("en")))


class LinkStore:
    """Link table under a versioned path; a new version becomes valid by replacing one small pointer file in one step."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = files(spark, self.path)

    def load(self) -> DataFrame:
        """The links; a missing store, or one whose tables are gone, is empty."""
        version = (self.files.read("CURRENT") or "").strip()
        if not version or not self.files.names(version):
            return self.spark.createDataFrame([], LINK_SCHEMA)
        return self.spark.read.schema(LINK_SCHEMA).parquet(f"{self.path}/{version}")

    def save(self, links: DataFrame) -> None:
        """Write a new version; the one before stays for readers that still use it, older ones go."""
        old, version = (self.files.read("CURRENT") or "").strip(), f"v-{uuid.uuid4().hex}"
        links.select("a", "b", "cost", "hub").where("a < b").write.parquet(f"{self.path}/{version}")
        self.files.put("CURRENT", version)
        for name in self.files.names():
            if name.startswith("v-") and name not in (old, version):
                self.files.delete(name)


def latest_lookups(dictionary: DataFrame) -> DataFrame:
    """One row per term: a complete lookup before a failed one, then one that found the term; the greatest content last."""
    first = F.max(F.struct("complete", "found", "summary", "url", "direct_glosses", "inflection_roots", "thesaurus_synonyms", "links"))
    return dictionary.groupBy("term").agg(first.alias("r")).select("term", "r.*")
