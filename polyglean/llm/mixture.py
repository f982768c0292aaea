"""Problem 7: mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sizes are tokens of a public tokenizer. The mixture is cut into shards of equally many blocks of equally many tokens;
each block, the last of a source may be a part of one, goes to the source with the highest quotient share / (2 * blocks so far + 1) among those that still have
text, which gives integer quotas per shard. A source's documents stand on a tape in seeded order, repeated up to
max_repeats times; its blocks are consecutive stretches of the tape, so documents come again only when all have been
used as often. A document belongs to the block its first token lies in and is taken whole.

Positions on the tape are two-level prefix sums (sums of hash buckets, then sums inside a bucket), so no source is
ever sorted in one task. Only sums per source and per bucket are used outside the executors; both are bounded.

NULL texts have no tokens and are never taken. Source names are compared trimmed and in lower case; documents of no
target source are left out. A source without documents gets no blocks; shares it cannot fill go to the others.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from polyglean.runtime import materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HASH_BUCKETS = 4096


def count_tokens(df: DataFrame, key: str, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) with the tokens of the whole text; NULL -> 0. The vocabulary is read here and sent to the tasks."""
    with open(tokenizer, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "n_tokens": n})

    kind = df.schema[key].dataType.simpleString()
    counted = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInPandas(run, f"k {kind}, n_tokens BIGINT")
    return counted.withColumnRenamed("k", key)


def sainte_lague(shares: dict[str, float], caps: dict[str, int], shards: int, blocks: int) -> list[dict[str, int]]:
    """Quotas per shard: ``blocks`` seats each, to the highest quotients; ties by name; none above its cap."""
    used = dict.fromkeys(shares, 0)
    heap = [(-w, s) for s, w in shares.items() if w > 0 and caps.get(s, 0) > 0]
    heapq.heapify(heap)
    out = []
    for _ in range(shards):
        quota = dict.fromkeys(shares, 0)
        for _ in range(blocks):
            if not heap:
                break
            _, s = heapq.heappop(heap)
            quota[s] += 1
            used[s] += 1
            if used[s] < caps[s]:
                heapq.heappush(heap, (-shares[s] / (2 * used[s] + 1), s))
        out.append(quota)
    return out


class Mixture:
    """``total_tokens``: size of the mixture, by default all tokens of the target sources once."""

    def __init__(self, documents: DataFrame, target: DataFrame, total_tokens: int | None = None, shards: int = 8,
                 blocks: int = 1000, seed: int = 7, tokenizer: str = TOKENIZER):
        spark = documents.sparkSession
        norm = F.lower(F.trim(F.col("source")))
        want = target.groupBy(norm.alias("source")).agg(
            F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
        )
        self.target = {r[0]: (r[1], r[2]) for r in want.collect()}  # one row a source of the plan
        known = documents.select("doc_id", "text", norm.alias("source")).where(
            F.col("source").isin(list(self.target)) & (F.length("text") > 0)
        )
        sized = count_tokens(known.select(F.struct("doc_id", "source").alias("k"), "text"), "k", tokenizer=tokenizer)
        h = F.xxhash64(F.lit(seed), "k.doc_id")
        sized = sized.select("k.*", "n_tokens", h.alias("h"), F.pmod(h, F.lit(HASH_BUCKETS)).alias("b"))
        self.docs = materialize(sized, "sized")
        sums = self.docs.groupBy("source", "b").agg(F.sum("n_tokens").alias("n"))
        before = F.sum("n").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
        offsets = sums.select("source", "b", F.coalesce(before, F.lit(0)).alias("offset"))
        inside = F.sum("n_tokens").over(W.partitionBy("source", "b").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1))
        # at most HASH_BUCKETS offsets a source of the plan
        self.tape = self.docs.join(F.broadcast(offsets), ["source", "b"]).select(
            "doc_id", "source", "n_tokens", (F.col("offset") + F.coalesce(inside, F.lit(0))).alias("start")
        )
        self.available = {r[0]: r[1] for r in self.docs.groupBy("source").agg(F.sum("n_tokens")).collect()}
        total = total_tokens or sum(self.available.values())
        self.block_tokens = max(1, -(-total // (shards * blocks)))
        caps = {s: -(-self.available.get(s, 0) * (r or 0) // self.block_tokens) for s, (_, r) in self.target.items()}
        self.quotas = sainte_lague({s: w or 0 for s, (w, _) in self.target.items()}, caps, shards, blocks)
        rows = []
        for s, (w, r) in self.target.items():
            at = 0
            for k, q in enumerate(self.quotas):
                rows.append((s, w, r, self.available.get(s, 0), k, at, at + q[s]))
                at += q[s]
        self.plan = spark.createDataFrame(rows, "source STRING, target_share DOUBLE, max_repeats INT, available BIGINT, shard INT, first BIGINT, until BIGINT")

    def rows(self) -> DataFrame:
        """(doc_id, source, copy, shard, n_tokens): the mixture, one row per use of a document."""
        per = F.broadcast(self.plan.groupBy("source").agg(F.max("available").alias("available"), F.max("max_repeats").alias("repeats"), F.max("until").alias("blocks"), F.array_sort(F.collect_list(F.struct("shard", "first", "until"))).alias("shards")))
        size = F.lit(self.block_tokens)
        used = self.tape.join(per, "source").where("repeats >= 1")
        copies = used.select("*", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("copy"))
        block = F.floor((F.col("copy") * F.col("available") + F.col("start")) / size)
        at = copies.withColumn("block", block).where("block < blocks")
        shard = F.filter("shards", lambda s: (s["first"] <= F.col("block")) & (F.col("block") < s["until"]))[0]["shard"]
        return at.select("doc_id", "source", "copy", shard.alias("shard"), "n_tokens")

    def quota_table(self) -> DataFrame:
        """(source, shard, blocks, tokens): the integer quotas; the last block of a source ends where its tape does."""
        n = F.col("until") - F.col("first")
        tape = F.col("available") * F.coalesce("max_repeats", F.lit(0))
        tokens = F.least(F.col("until") * self.block_tokens, tape) - F.least(F.col("first") * self.block_tokens, tape)
        return self.plan.select("source", "shard", n.alias("blocks"), tokens.alias("tokens"))

    def shares(self) -> DataFrame:
        """One row per target source: what it has, its quota, what was used, and the share reached beside the target."""
        got = self.rows().groupBy("source").agg(
            F.sum("n_tokens").alias("used_tokens"), F.count(F.lit(1)).alias("uses"), (F.max("copy") + 1).alias("repeats")
        )
        per = self.plan.groupBy("source").agg(
            F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"),
            F.max("available").alias("available_tokens"), F.max("until").alias("quota_blocks"),
        )
        out = per.join(F.broadcast(got), "source", "left")
        used = F.coalesce("used_tokens", F.lit(0))
        total = F.sum(used).over(W.partitionBy(F.lit(0)))  # one row a source of the plan
        return out.select(
            "source", "target_share", "max_repeats", "available_tokens", "quota_blocks", used.alias("used_tokens"),
            F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("repeats", F.lit(0)).alias("repeats"),
            F.when(total > 0, used / total).otherwise(0.0).alias("actual_share"),
        )
