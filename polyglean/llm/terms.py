"""Problems 2 and 5: term statistics over the plain form of records.

Terms are those of the project's tokenizer. NULL texts count as empty: such records have no term but count as records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from polyglean.functions.text import tokenize
from polyglean.llm.plain_form import plain_form
from polyglean.runtime import materialize, split_join

#: Record ids of one bitmap container.
SPAN = 1 << 16
#: Ids from which a container is a plain bitmap; below, it is the sorted list of 16-bit offsets.
DENSE = 4096
#: Uses of terms a task holds before it writes the bitmaps it has; more bitmaps of one term are united behind it.
HELD = 1 << 20


def record_tokens(records: DataFrame, *cols: str) -> DataFrame:
    """(id, tokens) of the plain form of ``cols``."""
    plain = plain_form(records.select("id", *cols), "id", *cols)
    return plain.select("id", F.concat(*[tokenize(F.col(f"plain_{c}")) for c in cols]).alias("tokens"))


def _flat(tokens: pa.ListArray) -> tuple[np.ndarray, pa.StringArray]:
    """Tokens of each row, and the tokens of all rows."""
    at = tokens.offsets.to_numpy()
    return np.diff(at), tokens.values.slice(at[0], at[-1] - at[0])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Uses of each term in each record, counted for a whole batch at once."""
    for b in batches:
        n, flat = _flat(b.column(1))
        coded = flat.dictionary_encode()
        v = max(1, len(coded.dictionary))
        pair, k = np.unique(np.repeat(np.arange(len(n)), n) * v + coded.indices.to_numpy(), return_counts=True)
        row = pair // v
        cols = [b.column(0).take(pa.array(row)), coded.dictionary.take(pa.array(pair % v)), pa.array(n[row].astype(np.int32)), pa.array(k)]
        yield pa.RecordBatch.from_arrays(cols, ["id", "term", "length", "k"])


def record_terms(records: DataFrame, *cols: str) -> DataFrame:
    """(id, term, length, k): uses of each term in the plain form of ``cols`` and the number of terms of the record.

    A record lies whole in one Arrow batch, so its terms are counted there without a shuffle.
    """
    return record_tokens(records, *cols).mapInArrow(_count, "id BIGINT, term STRING, length INT, k BIGINT")


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def log_likelihood(k11: Column, k12: Column, k21: Column, k22: Column) -> Column:
    """Signed log-likelihood ratio of a two-by-two table: negative if the term is rarer here than elsewhere."""
    rows = _xlogx(k11 + k12) + _xlogx(k21 + k22)
    cols = _xlogx(k11 + k21) + _xlogx(k12 + k22)
    cells = _xlogx(k11) + _xlogx(k12) + _xlogx(k21) + _xlogx(k22)
    g = F.greatest(2.0 * (cells - rows - cols + _xlogx(k11 + k12 + k21 + k22)), F.lit(0.0))
    return F.when(k11 * (k21 + k22) < k21 * (k11 + k12), -g).otherwise(g)


def distinctive_terms(records: DataFrame) -> DataFrame:
    """(id, term, k, n, llr, score): how characteristic each term of title and text is of its record.

    llr is the signed log-likelihood ratio of the table of term and other uses in this record against the remaining
    collection; score is k * ln(N / n) with n of N records holding the term. Vocabulary counts are pre-aggregated;
    terms in at least a thousandth of all records are joined back by broadcast (a record of d terms can hold at most
    d of them, so there are at most 1000 times the mean number of terms per record), all others by shuffle.
    Empty input gives no rows.
    """
    uses = materialize(record_terms(records, "title", "text"), "uses")
    total = records.select("id").count()
    vocab = materialize(uses.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("cf")), "vocab")
    tokens = vocab.agg(F.sum("cf")).first()[0] or 0
    joined = split_join(uses, vocab, ["term"], f"n * 1000 >= {max(total, 1)}")
    k, cf, length = (F.col(c).cast("double") for c in ("k", "cf", "length"))
    return joined.select(
        "id", "term", "k", "n",
        log_likelihood(k, length - k, cf - k, F.lit(float(tokens)) - cf - length + k).alias("llr"),
        (k * F.log(F.lit(float(total)) / F.col("n"))).alias("score"),
    )


def top_terms(scored: DataFrame) -> DataFrame:
    """(id, term, k, n, llr): the term of highest score (9 decimals) of each record, ties to the first in code point order.

    It is sought among the terms that are characteristic of their record, those of positive log-likelihood ratio. If a
    term outside of them scores higher it is the one: ordinary words of a long record, or a rare term that another
    record uses still more densely.
    """
    row = F.struct((-F.round("score", 9)).alias("s"), "term", "k", "n", "llr")
    own, every = F.min(F.when(F.col("llr") > 0, row)).alias("own"), F.min(row).alias("every")
    best = F.when(F.col("own") <= F.col("every"), F.col("own")).otherwise(F.col("every")).alias("b")
    return scored.groupBy("id").agg(own, every).select("id", best).select("id", "b.term", "b.k", "b.n", "b.llr")


def pack(offsets) -> bytes:
    """Container of sorted distinct 16-bit offsets: b's' and the offsets, or b'd' and 8 KB of bits."""
    return packed(np.unique(np.asarray(offsets, dtype=np.uint16)))


def packed(a: np.ndarray) -> bytes:
    if len(a) < DENSE:
        return b"s" + a.tobytes()
    bits = np.zeros(SPAN, dtype=np.uint8)
    bits[a] = 1
    return b"d" + np.packbits(bits).tobytes()


def unpack(c: bytes) -> np.ndarray:
    if c[:1] == b"s":
        return np.frombuffer(c, dtype=np.uint16, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(c, dtype=np.uint8, offset=1))).astype(np.uint16)


@F.pandas_udf(T.BinaryType())
def _union(containers: pd.Series) -> pd.Series:
    return containers.map(lambda cs: cs[0] if len(cs) == 1 else pack(np.concatenate([unpack(c) for c in cs])))


@F.pandas_udf(T.LongType())
def _cardinality(c: pd.Series) -> pd.Series:
    ones = np.array([bin(x).count("1") for x in range(256)])
    return c.map(lambda b: (len(b) - 1) // 2 if b[:1] == b"s" else int(ones[np.frombuffer(b, np.uint8, offset=1)].sum()))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the records of one task, a container per term and span, with the uses beside it."""

    def built(ids: list[np.ndarray], terms: list[pa.StringArray]) -> pa.RecordBatch:
        rid, coded = np.concatenate(ids), pa.concat_arrays(terms).dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.lexsort((rid, code))
        rid, code = rid[order], code[order]
        first = np.ones(len(rid), bool)  # of a record's uses of a term
        first[1:] = (code[1:] != code[:-1]) | (rid[1:] != rid[:-1])
        at = np.flatnonzero(first)
        uses = np.diff(np.append(at, len(rid)))
        rid, code = rid[at], code[at]
        span, low = rid >> 16, (rid & (SPAN - 1)).astype(np.uint16)
        new = np.ones(len(rid), bool)
        new[1:] = (code[1:] != code[:-1]) | (span[1:] != span[:-1])
        cut = np.flatnonzero(new)
        ids_ = [packed(low[a:b]) for a, b in zip(cut, np.append(cut[1:], len(rid)))]
        total = np.add.reduceat(uses, cut) if len(cut) else uses
        cols = [coded.dictionary.take(pa.array(code[cut])), pa.array(span[cut]), pa.array(ids_, pa.binary()), pa.array(total)]
        return pa.RecordBatch.from_arrays(cols, ["term", "span", "ids", "uses"])

    ids, terms, held = [], [], 0
    for b in batches:
        n, flat = _flat(b.column(1))
        ids.append(np.repeat(b.column(0).fill_null(-1).to_numpy(), n))
        terms.append(flat)
        held += len(flat)
        if held >= HELD:
            yield built(ids, terms)
            ids, terms, held = [], [], 0
    if held:
        yield built(ids, terms)


def term_bitmaps(records: DataFrame, *cols: str) -> DataFrame:
    """(term, span, ids, uses): vertical layout, a compressed bitmap of record ids per term and span of 65,536 ids.

    Each task builds the bitmaps of its records before the shuffle; those of one term and span are united behind it.
    A container holds at most one span of ids, so none grows with the collection.
    """
    own = record_tokens(records, *cols).mapInArrow(_bitmaps, "term STRING, span BIGINT, ids BINARY, uses BIGINT")
    return merge_bitmaps(own)


def merge_bitmaps(*parts: DataFrame) -> DataFrame:
    """Union of vertical layouts of different records: bitmaps are united, counters added."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("term", "span").agg(F.collect_list("ids").alias("cs"), F.sum("uses").alias("uses")).select("term", "span", _union("cs").alias("ids"), "uses")


def term_frequencies(bitmaps: DataFrame, total: int, rare: int = 3, common: float = 1 / 20) -> DataFrame:
    """(term, uses, records, mark): mark 'rare' below ``rare`` records, 'common' from a share ``common`` of all, or NULL."""
    per = bitmaps.select("term", "uses", _cardinality("ids").alias("c")).groupBy("term")
    out = per.agg(F.sum("uses").alias("uses"), F.sum("c").alias("records"))
    mark = F.when(F.col("records") < rare, "rare").when(F.col("records") >= total * common, "common")
    return out.withColumn("mark", mark)
