"""Problem 6: passages of test items inside training documents.

The test items form a BM25 inverted index whose postings are cut into blocks with a stored maximum. Passages of the
documents are queries: block-max WAND skips blocks that cannot reach the threshold and returns all items above it. The
threshold of an item is the least score any run of ``RUN`` of its words gives, so a passage that holds such a run
always reaches it: retrieval loses no case. The pairs retrieved are then verified word by word.

Passages overlap by RUN - 1 words, so each run lies whole in one. A passage is searched only if it holds a pair of
neighbouring words chosen for one of the items' runs (of each run the pair of least hash): a passage that holds a run
holds its pair, so none is missed; pairs are found for a whole batch at once. Documents are read once and never shuffled
before the verified pairs. The items are a stated, fixed set; they are indexed in shards of at most ``SHARD`` items with
the statistics of all items, so what is sent to the executors is bounded whatever their number and scores do not depend
on the shards. Each further shard reads the documents once more.

NULL and empty documents and items shorter than a run give no pair; repeated items each get their own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from polyglean.functions.text import WHITE
from polyglean.runtime import spread

RUN = 10
PASSAGE = 40
SHARD = 20_000
BLOCK = 16
#: Passages a task remembers the result of, so that copies are searched once.
REMEMBERED = 20_000
K1, B = 1.2, 0.75


def words(text: Column) -> Column:
    """Lower-case words without punctuation, quote and list marks and characters without width; empties dropped."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\p{P}\p{Cf}>]+", "")
    return F.filter(F.split(bare, WHITE), lambda w: w != "")


class Index:
    """BM25 index of a shard of items with block maxima, per-item thresholds and the pairs chosen for their runs.

    ``df``, ``total``, ``mean``: in how many of all items each word is, their number and mean length; of the shard itself
    if not given.
    """

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN, df: dict[str, int] | None = None, total: int | None = None, mean: float | None = None):
        self.run = run
        items = [(i, list(ws)) for i, ws in items if len(ws) >= run]
        self.ids = [i for i, _ in items]
        self.runs = [{tuple(ws[k : k + run]) for k in range(len(ws) - run + 1)} for _, ws in items]
        counts = [Counter(ws) for _, ws in items]
        mean = mean or sum(len(ws) for _, ws in items) / max(1, len(items))
        df, total = df or Counter(t for c in counts for t in c), total or len(items)
        idf = {t: math.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) for c in counts for t in c}
        weight = [
            {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean)) for t, f in c.items()}
            for c, (_, ws) in zip(counts, items)
        ]
        self.least = [
            min(sum(w[t] for t in set(ws[k : k + run])) for k in range(len(ws) - run + 1)) * (1 - 1e-9)
            for w, (_, ws) in zip(weight, items)
        ]
        self.floor = min(self.least, default=math.inf)
        self.lists: dict[str, tuple] = {}
        post: dict[str, list] = {}
        for n, w in enumerate(weight):
            for t, x in w.items():
                post.setdefault(t, []).append((n, x))
        for t, p in post.items():
            tops = [max(x for _, x in p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)]
            self.lists[t] = ([n for n, _ in p], [x for _, x in p], tops, max(tops))
        self.words = pa.array(list(post), pa.string())
        place = {t: n for n, t in enumerate(post)}
        pairs = {self.pair(run) for own in self.runs for run in own} if run > 1 else set()
        self.pairs = np.array(sorted(place[a] * len(post) + place[b] for a, b in pairs), np.int64)

    @staticmethod
    def pair(run: tuple[str, ...]) -> tuple[str, str]:
        """The neighbours of least hash: runs that overlap mostly share it."""
        return min(zip(run, run[1:]), key=lambda p: (xxhash.xxh64_intdigest("\n".join(p).encode("utf-8", "surrogatepass")), p))

    def places(self, tokens: pa.ListArray) -> np.ndarray:
        """Where in the words of all rows, one after the other, a chosen pair begins."""
        at = tokens.offsets.to_numpy()
        flat = tokens.values.slice(at[0], at[-1] - at[0])
        if len(flat) < 2 or not len(self.pairs):
            return np.zeros(0, np.int64)
        coded = flat.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        w = known[coded.indices.to_numpy()]
        code = np.where((w[:-1] >= 0) & (w[1:] >= 0), w[:-1] * len(self.words) + w[1:], -1)
        first = np.flatnonzero(np.isin(code, self.pairs))
        last = at[1:][np.diff(at) > 0] - at[0] - 1  # a pair lies in one row
        return first[~np.isin(first, last)]

    def search(self, terms: list[str]) -> list[tuple[int, float]]:
        """All (item number, score) whose score for the distinct ``terms`` reaches the item's threshold."""
        lists = [x for t in terms if (x := self.lists.get(t))]
        floor, out = self.floor, []
        if sum(x[3] for x in lists) < floor:
            return out
        end = len(self.ids)
        live = [[x[0][0], 0, x] for x in lists]  # current item, position, list
        while live:
            live.sort(key=lambda c: c[0])
            bound, p = 0.0, -1
            for p, c in enumerate(live):
                bound += c[2][3]
                if bound >= floor:
                    break
            else:
                break
            pivot = live[p][0]
            while p + 1 < len(live) and live[p + 1][0] == pivot:
                p += 1
            # block maxima of the lists up to the pivot, at the block each would have the pivot in
            top, last = 0.0, end
            for c in live[: p + 1]:
                ids, _, tops, _ = c[2]
                k = c[1] // BLOCK
                while (k + 1) * BLOCK < len(ids) and ids[(k + 1) * BLOCK - 1] < pivot:
                    k += 1
                top += tops[k]
                last = min(last, ids[min((k + 1) * BLOCK, len(ids)) - 1])
            if top >= floor and live[0][0] == pivot:
                score = 0.0
                for c in live[: p + 1]:
                    score += c[2][1][c[1]]
                if score >= self.least[pivot]:
                    out.append((pivot, score))
                to, move = pivot + 1, live[: p + 1]
            elif top >= floor:
                to, move = pivot, [c for c in live[: p + 1] if c[0] < pivot]
            else:  # no item up to the nearest block end can reach the floor
                to = max(last, pivot) + 1 if p + 1 == len(live) else min(max(last, pivot) + 1, live[p + 1][0])
                move = live[: p + 1]
            for c in move:
                ids = c[2][0]
                k, n = c[1], len(ids)
                while k < n and ids[k] < to:
                    k = (k // BLOCK + 1) * BLOCK if ids[min((k // BLOCK + 1) * BLOCK, n) - 1] < to else k + 1
                c[1] = k
                c[0] = ids[k] if k < n else end
            live = [c for c in live if c[0] < end]
        return out

    def verified(self, ws: list[str]) -> list[tuple[int, float]]:
        """(item id, score) of the retrieved items of which the passage holds a run."""
        out, runs = [], None
        for n, score in self.search(list(dict.fromkeys(ws))):
            if runs is None:
                runs = {tuple(ws[k : k + self.run]) for k in range(len(ws) - self.run + 1)}
            if not runs.isdisjoint(self.runs[n]):
                out.append((self.ids[n], score))
        return out


def _passages(begin: int, end: int, places: np.ndarray, run: int) -> list[tuple[int, int]]:
    """(begin, end) of the passages of one document that hold one of the pairs at ``places``, in order."""
    step, out = PASSAGE - run + 1, set()
    for p in places - begin:
        out.update(range(max(0, -(-(p + 2 - PASSAGE) // step)), p // step + 1))
    spans = [(begin + k * step, min(begin + k * step + PASSAGE, end)) for k in sorted(out)]
    return [(a, b) for a, b in spans if a == begin or end - a >= run]


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, score, passages): documents that hold ``run`` or more consecutive words of an item."""
    spark = documents.sparkSession
    ws = spread(documents.select("doc_id", "text")).select(F.col("doc_id").cast("bigint").alias("doc_id"), words(F.col("text")).alias("ws"))
    ws = ws.where(F.size("ws") >= run)
    worded = items.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") >= run)
    total, mean = worded.agg(F.count(F.lit(1)), F.avg(F.size("ws"))).first()
    shards = max(1, -(-total // SHARD))
    df = worded.select(F.explode(F.array_distinct("ws")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    shard, out = F.pmod(F.xxhash64("item_id"), F.lit(shards)), None
    for k in range(shards):
        own = worded.where(shard == k)
        rows = own.collect()  # a shard of the stated query set, and how often its words are in all items
        used = own.select(F.explode("ws").alias("w")).distinct()
        counts = dict(df.join(used, "w", "left_semi").collect()) if shards > 1 else None
        index = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in rows], run, counts, total, mean))

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix, memo = index.value, {}
            for batch in batches:
                ids, tokens = batch.column(0).to_pylist(), batch.column(1)
                at = tokens.offsets.to_numpy()
                places, hits = ix.places(tokens), []
                rows = np.searchsorted(at - at[0], places, "right") - 1
                for r in np.unique(rows):
                    begin, end = int(at[r] - at[0]), int(at[r + 1] - at[0])
                    own = tokens.values.slice(at[r], end - begin).to_pylist()
                    for a, b in _passages(0, end - begin, places[rows == r] - begin, run):
                        key = tuple(own[a:b])
                        if key not in memo:
                            if len(memo) >= REMEMBERED:
                                memo.clear()
                            memo[key] = ix.verified(own[a:b])
                        hits += [(ids[r], i, s) for i, s in memo[key]]
                cols = list(zip(*hits)) or [[], [], []]
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "score"])

        part = ws.mapInArrow(find, "doc_id BIGINT, item_id BIGINT, score DOUBLE")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("passages"))
