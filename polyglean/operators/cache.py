"""Least-recently-used cache statistics from an access log, without a cache.

An access hits exactly if the number of distinct other keys used since the last access to its key is below the
capacity (its stack distance).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from polyglean.runtime import materialize

#: Accesses per block of the replay.
BLOCK = 100_000


def _recent(rows: DataFrame, capacity: int) -> DataFrame:
    """The last use of each key of a block, for the ``capacity`` keys used last."""
    last = rows.groupBy("block", "key").agg(F.max("seq").alias("seq"))
    place = F.row_number().over(W.partitionBy("block").orderBy(F.col("seq").desc()))
    return last.withColumn("n", place).where(F.col("n") <= capacity).drop("n")


def stack_distances(log: DataFrame, key: str, order: str, capacity: int, block: int = BLOCK) -> DataFrame:
    """(seq, key, distance): distinct other keys since the last access of each key, if they are fewer than ``capacity``.

    The distance is NULL at the first access of a key, and may be NULL where it is ``capacity`` or more. An access at t
    of a key last used at p counts the keys whose last use before t lies after p. Blocks of consecutive accesses are
    replayed in separate tasks; what a block needs of the past is the last use of the ``capacity`` keys used last before
    it: all keys used after one of them are among them. These are merged from block to block in doubling steps, so n
    blocks take log n rounds of at most 2 * n * ``capacity`` rows.
    """
    k, o = F.col(key).alias("key"), F.col(order).alias("o")
    rows = log.select(k, o).where("key IS NOT NULL")
    # dense places in log order: places inside order ranges plus the sizes of the ranges before
    ranged = rows.repartitionByRange("o").select("*", F.spark_partition_id().alias("part"))
    ranged = materialize(ranged, "log")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("part").orderBy("o", "key"))
    seq = ranged.join(F.broadcast(before), "part").select("key", (F.col("base") + place - 1).alias("seq"))
    blocked = materialize(seq.withColumn("block", F.floor(F.col("seq") / block)), "blocked")
    state = materialize(_recent(blocked, capacity), "recent")
    blocks, step = (blocked.agg(F.max("block")).first()[0] or 0) + 1, 1
    while step < blocks:
        earlier = state.withColumn("block", F.col("block") + step).where(F.col("block") < blocks)
        state = materialize(_recent(state.unionByName(earlier), capacity), "recent")
        step *= 2
    past = state.withColumn("block", F.col("block") + 1).where(F.col("block") < blocks)
    work = blocked.select("block", "key", "seq", F.lit(1).alias("own")).unionByName(past.select("block", "key", "seq", F.lit(0).alias("own")))
    kind = log.schema[key].dataType.simpleString()

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["own", "seq"], kind="stable")
        slot, tree, out = {}, [0] * (len(group) + 1), []

        def add(i: int, d: int) -> None:
            while i < len(tree):
                tree[i] += d
                i += i & -i

        def upto(i: int) -> int:
            s = 0
            while i > 0:
                s += tree[i]
                i -= i & -i
            return s

        for n, (name, at, own) in enumerate(zip(group["key"], group["seq"], group["own"]), 1):
            p = slot.get(name)
            if own:
                out.append((at, name, upto(n - 1) - upto(p) if p else None))
            if p:
                add(p, -1)
            slot[name] = n
            add(n, 1)
        res = pd.DataFrame(out, columns=["seq", "key", "distance"])
        res["distance"] = res["distance"].astype("Int64")
        return res

    return work.groupBy("block").applyInPandas(replay, f"seq BIGINT, key {kind}, distance BIGINT")


def lru_stats(log: DataFrame, key: str, order: str, capacity: int = 300) -> DataFrame:
    """(capacity, size, hits, misses, hit_rate): what a cache of ``capacity`` would have reported after the log."""
    d = stack_distances(log, key, order, capacity)
    hit = F.coalesce(F.col("distance") < capacity, F.lit(False))
    out = d.agg(F.sum(hit.cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("n"), F.least(F.lit(capacity), F.count_distinct("key")).alias("size"))
    hits = F.coalesce("hits", F.lit(0))
    return out.select(F.lit(capacity).alias("capacity"), "size", hits.alias("hits"), (F.col("n") - hits).alias("misses"), F.when(F.col("n") > 0, F.round(100.0 * hits / F.col("n"), 1)).otherwise(0.0).alias("hit_rate"))


def recent_keys(log: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """(place, key): the keys a cache holds used last, the latest first."""
    last = log.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(order).alias("at"))
    top = last.orderBy(F.col("at").desc(), F.col("key").desc()).limit(n)
    return top.select(F.row_number().over(W.orderBy(F.col("at").desc(), F.col("key").desc())).alias("place"), "key")
