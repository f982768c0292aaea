"""Registered queries of the training-data operators. TESTDATA.md defines the pN_found results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from polyglean.llm.copy_ledger import ledger_of
from polyglean.llm.language import detect, label_cases
from polyglean.llm.leaks import leaks
from polyglean.llm.mixture import Mixture
from polyglean.llm.oracle import SQL
from polyglean.llm.personal import distinct_pieces, personal, redact
from polyglean.llm.plain_form import look_alike_pairs, plain_form
from polyglean.llm.tables import read, records
from polyglean.llm.terms import distinctive_terms, term_bitmaps, term_frequencies, top_terms


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return look_alike_pairs(records(read(spark, sf, "corpus")))


def p1_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Every record in plain form."""
    out = plain_form(records(read(spark, sf, "corpus")), "id", "title", "text")
    return out.select("id", "plain_title", "plain_text")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    best = top_terms(distinctive_terms(records(read(spark, sf, "corpus"))))
    return best.where("k >= 3 AND n BETWEEN 2 AND 20").select("id", "term")


def p2_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of every record with its counts, log-likelihood ratio and score."""
    out = distinctive_terms(records(read(spark, sf, "corpus")))
    short = lambda c, d: (F.round(c, d) + 0.0).alias(c)
    return out.select("id", "term", "k", "n", short("llr", 3), short("score", 6))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return label_cases(detect(records(read(spark, sf, "corpus"), "lang", "text")))


def p3_stretches(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch of every record with its language, confidence and place."""
    return detect(records(read(spark, sf, "corpus"), "lang", "text"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return ledger_of(read(spark, sf, "corpus")).copies()


def p4_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """One row per group of copies: the kept record and the number of copies it had."""
    return ledger_of(read(spark, sf, "corpus")).entries().select("key", "id_kept", "copies")


def _frequencies(spark: SparkSession, sf: str) -> DataFrame:
    recs = records(read(spark, sf, "corpus"), "text")
    return term_frequencies(term_bitmaps(recs, "text"), recs.select("id").count())


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _frequencies(spark, sf).where("mark IS NOT NULL AND NOT term RLIKE '[\\u4e00-\\u9fff]'").select("term", "mark")


def p5_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Every term with its uses, records and mark."""
    return _frequencies(spark, sf)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark")).select("doc_id", "item_id")


def _mixture(spark: SparkSession, sf: str) -> Mixture:
    return Mixture(read(spark, sf, "documents"), read(spark, sf, "mix_target"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).shares()


def p7_quotas(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).quota_table()


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture itself: one row per use of a document."""
    return _mixture(spark, sf).rows()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_pieces(personal(read(spark, sf, "documents")))


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with placeholders for its pieces."""
    return redact(read(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_plain, p2_found, p2_scores, p3_found, p3_stretches, p4_found, p4_ledger, p5_found, p5_frequencies, p6_found,
        p7_shares, p7_quotas, p7_mixture, p8_found, p8_redacted,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
