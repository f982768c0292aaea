"""Prefix operators over the vocabulary table: what a trie would answer, as set operations.

A trie node is a distinct prefix of a term. Nothing here builds a tree; one pass explodes terms to prefixes, which a
map-side aggregate makes distinct before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def prefixes(vocab: DataFrame) -> DataFrame:
    """(prefix, depth, parent, is_end): every node but the root."""
    n = F.explode(F.sequence(F.lit(1), F.length("term")))
    nodes = vocab.select("term", n.alias("depth")).select(F.expr("substring(term, 1, depth)").alias("prefix"), "depth", (F.col("depth") == F.length("term")).alias("end"))
    out = nodes.groupBy("prefix").agg(F.max("depth").alias("depth"), F.max("end").alias("is_end"))
    return out.withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))


def trie_stats(vocab: DataFrame) -> DataFrame:
    nodes = prefixes(vocab).agg((F.count(F.lit(1)) + 1).alias("total_nodes"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    return nodes


def prefix_search(vocab: DataFrame, prefix: str, limit: int = 60) -> DataFrame:
    """Terms with the prefix in code point order, at most ``limit``; an empty prefix has none."""
    hits = vocab.where(F.col("term").startswith(prefix.lower()) & F.lit(prefix != ""))
    return hits.select("term", "df").orderBy("term").limit(limit)


def prefix_searches(vocab: DataFrame, queries: list[str], limit: int = 60) -> DataFrame:
    """(prefix, term, df, rank) for a batch of prefixes in one job, the first ``limit`` of each.

    Prefixes join on equality with the terms' own prefixes of the queried lengths, so each term is looked up once per
    length; the rank limit is applied map-side by Spark before the shuffle.
    """
    spark = vocab.sparkSession
    wanted = sorted({q.lower() for q in queries if q})
    lengths = sorted({len(q) for q in wanted})
    q = F.broadcast(spark.createDataFrame([(w,) for w in wanted], "prefix STRING"))
    cut = F.explode(F.filter(F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in lengths]), lambda x: x.isNotNull()))
    hits = vocab.select("term", "df", cut.alias("prefix")).join(q, "prefix")
    rank = F.row_number().over(W.partitionBy("prefix").orderBy("term"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).select("prefix", "term", "df", "rank")


def nodes_visited(vocab: DataFrame, queries: list[str], limit: int = 60) -> DataFrame:
    """(prefix, matches, nodes_visited): the nodes a depth-first search would have opened, in closed form.

    A prefix that is no node: 1 + the characters that could be followed. Otherwise 1 + its length + the distinct
    strict extensions up to the last match (all if there are fewer than ``limit`` matches), + 1 if the limit was hit
    at a match that has children.
    """
    spark = vocab.sparkSession
    nodes = prefixes(vocab)
    wanted = sorted({q.lower() for q in queries if q})
    q = spark.createDataFrame([(w,) for w in wanted], "prefix STRING")
    found = prefix_searches(vocab, wanted, limit).groupBy("prefix").agg(F.count(F.lit(1)).alias("matches"), F.max("term").alias("last"))
    steps = q.select(F.col("prefix").alias("q"), F.explode(F.sequence(F.lit(1), F.length("prefix"))).alias("k")).select("q", F.expr("substring(q, 1, k)").alias("prefix"))
    followed = nodes.join(F.broadcast(steps), "prefix").groupBy("q").agg(F.count(F.lit(1)).alias("followed"))
    f = F.broadcast(found)
    lengths = sorted({len(w) for w in wanted})
    cut = F.explode(F.filter(F.array(*[F.when(F.col("depth") > n, F.substring("prefix", 1, n)) for n in lengths]), lambda x: x.isNotNull()))
    under = nodes.select(F.col("prefix").alias("node"), "parent", cut.alias("prefix")).join(f, "prefix")
    counted = under.groupBy("prefix").agg(
        F.sum(F.when((F.col("matches") < limit) | (F.col("node") <= F.col("last")), 1).otherwise(0)).alias("opened"),
        F.max(F.when((F.col("matches") >= limit) & (F.col("parent") == F.col("last")), 1).otherwise(0)).alias("more"),
    )
    out = q.join(f, "prefix", "left").join(F.broadcast(counted), "prefix", "left").join(F.broadcast(followed.withColumnRenamed("q", "prefix")), "prefix", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    alive = zero("followed") == F.length("prefix")
    visited = F.when(alive, 1 + F.length("prefix") + zero("opened") + zero("more")).otherwise(1 + zero("followed"))
    return out.select("prefix", zero("matches").alias("matches"), visited.alias("nodes_visited"))


def tree_flat(vocab: DataFrame, prefix: str = "", max_depth: int = 3, max_branches: int = 5) -> DataFrame:
    """(node, parent, depth, is_end, children, truncated, has_more): the first branches of each node below ``prefix``.

    ``has_more`` at the deepest level tells of children, ``truncated`` above it counts the branches left out.
    """
    root = prefix.lower()
    near = prefixes(vocab.where(F.col("term").startswith(root))) if root else prefixes(vocab)
    near = near.where((F.col("depth") <= len(root) + max_depth + 1) & (F.col("depth") >= len(root)))
    kids = near.groupBy("parent").agg(F.count(F.lit(1)).alias("children")).withColumnRenamed("parent", "prefix")
    branch = F.row_number().over(W.partitionBy("parent").orderBy("prefix"))
    ranked = near.where(F.col("depth") > len(root)).withColumn("branch", branch).where(F.col("branch") <= max_branches)
    level = ranked.where(F.col("depth") == len(root) + 1)
    out = level
    for d in range(2, max_depth + 1):  # at most max_branches ** max_depth nodes are kept
        level = ranked.where(F.col("depth") == len(root) + d).join(F.broadcast(level.select(F.col("prefix").alias("parent"))), "parent", "left_semi")
        out = out.unionByName(level)
    out = out.join(kids, "prefix", "left")
    n = F.coalesce("children", F.lit(0))
    deep = F.col("depth") == len(root) + max_depth
    return out.select(
        F.col("prefix").alias("node"), "parent", (F.col("depth") - len(root)).alias("depth"), "is_end",
        F.when(~deep & (n > max_branches), n - max_branches).alias("truncated"), F.when(deep, n > 0).alias("has_more"),
    )


def tree(vocab: DataFrame, prefix: str = "", max_depth: int = 3, max_branches: int = 5) -> dict | None:
    """The nested form of ``tree_flat`` for display (its size is bounded by the branches); None for a dead prefix."""
    root = prefix.lower()
    if root and not vocab.where(F.col("term").startswith(root)).limit(1).count():
        return None
    rows = tree_flat(vocab, root, max_depth, max_branches).collect()
    end = bool(root) and bool(vocab.where(F.col("term") == root).limit(1).count())
    below: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r["node"]):
        below.setdefault(r["parent"], []).append(r)

    def item(char: str, node: str, is_end: bool, depth: int, row=None) -> dict:
        out = {"char": char, "is_end": is_end, "children": [item(r["node"][-1], r["node"], r["is_end"], depth + 1, r) for r in below.get(node, [])]}
        if row is not None and row["has_more"] is not None:
            out["has_more"] = row["has_more"]
        if row is not None and row["truncated"] is not None:
            out["truncated"] = row["truncated"]
        return out

    out = item(root[-1] if root else "root", root, end, 0)
    firsts = vocab.where(F.col("term").startswith(root) & (F.length("term") > len(root))).select(F.count_distinct(F.substring("term", len(root) + 1, 1))).first()[0]
    if firsts > max_branches:
        out["truncated"] = firsts - max_branches
    return out

