"""Problem 4: records equal but for white space, case, punctuation or exchanged fields, kept in an incremental ledger.

The canonical key of a record is a digest of its two fields in plain form and lower case without white space,
punctuation, control and format characters, the two put in order. The ledger has two tables, both cut into buckets:

* entries (key, copies, id_kept), bucketed by key: a batch is aggregated by key first (map-side, so a group of any size
  costs one row a task), then full-outer-joined against the buckets it touches only; counts are added and the smallest
  id stays as the representative.
* ids (id, key, step), bucketed by ranges of ids, appended to by each step: what a record was last delivered as. An id
  delivered again unchanged counts once; one delivered with other content leaves its old group.

A step writes under folders of its own and becomes valid by one manifest file renamed into place; a step that fails
leaves the state before it. A ledger opened on a path continues from the last manifest there. Buckets double when they
hold more than ``KEYS`` keys on average, so a task never gets more than a bounded share.

NULL and empty fields count as empty; two records without any text are copies of each other. A record with a NULL id
counts under a negative id made from its key.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from polyglean.llm.plain_form import plain_form
from polyglean.llm.tables import SURROGATE, records
from polyglean.runtime import files, path_for, split_join

#: White space, punctuation, control and format characters.
DROPPED = r"[\p{Z}\p{P}\p{Cc}\p{Cf}]+"
#: Keys a bucket holds on average before the buckets double, and the buckets a ledger starts with.
KEYS, BUCKETS = 500_000, 16
#: Runs of the id table a bucket may have before they are merged into one.
RUNS = 8
#: Consecutive ids that lie in one bucket: 2 ** NEAR.
NEAR = 12

ENTRIES = "key STRING, copies BIGINT, id_kept BIGINT"
IDS = "id BIGINT, key STRING, old_key STRING, step BIGINT"


def canonical(text: Column) -> Column:
    """Lower case without the dropped characters; the two small sigmas are one letter."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "ς", "σ"), DROPPED, "")


def canonical_key(a: Column, b: Column) -> Column:
    """Digest of the two canonical fields in either order; the separator cannot occur in a field."""
    return F.sha2(F.array_join(F.array_sort(F.array(canonical(a), canonical(b))), "\n"), 256)


class CopyLedger:
    """The ledger at ``path``, or a new one; ``keys``: see ``KEYS``."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, keys: int = KEYS):
        self.spark, self.path, self.keys = spark, (path or path_for(spark, "ledger")).rstrip("/"), keys
        self.files = files(spark, self.path)
        names = sorted(n for n in self.files.names("manifests") if n.endswith(".json"))
        # buckets: their number; entries: bucket -> folder; ids: bucket -> folders. Both have at most that many keys
        self.state = json.loads(self.files.read(f"manifests/{names[-1]}")) if names else {"step": 0, "buckets": buckets, "records": 0, "entries": {}, "ids": {}}

    def _read(self, schema: str, leaves: list[str]) -> DataFrame:
        if not leaves:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in leaves])

    def _entries(self, buckets: list[int] | None = None) -> DataFrame:
        return self._read(ENTRIES, [f"{d}/b={b}" for b, d in self.state["entries"].items() if buckets is None or int(b) in buckets])

    def _ids(self, buckets: list[int] | None = None) -> DataFrame:
        return self._read(IDS, [f"{d}/b={b}" for b, ds in self.state["ids"].items() if buckets is None or int(b) in buckets for d in ds])

    @staticmethod
    def _latest(ids: DataFrame) -> DataFrame:
        return ids.groupBy("id").agg(F.max_by("key", "step").alias("key"))

    def _write(self, df: DataFrame, name: str) -> list[int]:
        """Write ``df`` by its column b; the buckets that got rows."""
        df.repartition("b").write.partitionBy("b").parquet(f"{self.path}/{name}")
        return sorted(int(n[2:]) for n in self.files.names(name) if n.startswith("b="))

    def entries(self) -> DataFrame:
        """(key, copies, id_kept): one row per group of copies."""
        return self._entries()

    def members(self) -> DataFrame:
        """(id, key) of every record."""
        return self._latest(self._ids())

    def add(self, batch: DataFrame) -> None:
        """Merge a batch with the columns id, title and text, one row per id."""
        new = json.loads(json.dumps(self.state))
        step = new["step"] = new["step"] + 1
        folder = f"{step:06d}-{uuid.uuid4().hex[:8]}"
        keyed = plain_form(batch.select("id", "title", "text"), "id", "title", "text").select(
            "id", canonical_key(F.col("plain_title"), F.col("plain_text")).alias("key")
        )
        own_id = F.coalesce("id", F.lit(SURROGATE) - F.pmod(F.xxhash64("key"), F.lit(1 << 62)))
        keyed.select(own_id.alias("id"), "key").write.parquet(f"{self.path}/batch-{folder}")
        keyed = self._read("id BIGINT, key STRING", [f"batch-{folder}"])
        in_bucket = lambda: F.pmod(F.shiftright("id", NEAR), F.lit(new["buckets"])).cast("int")
        sizes = dict(keyed.groupBy(in_bucket().alias("b")).count().collect())  # at most all buckets
        while new["records"] + sum(sizes.values()) > new["buckets"] * self.keys:
            new["buckets"] *= 2
        n = F.lit(new["buckets"])
        grown = new["buckets"] != self.state["buckets"]
        id_bucket, near = in_bucket(), None if grown else list(sizes)
        full = [b for b in near or [] if len(new["ids"].get(str(b), [])) >= RUNS]

        before = self._latest(self._ids(near)).withColumnRenamed("key", "old_key")
        change = keyed.join(before, "id", "left").where("old_key IS NULL OR old_key <> key")
        change = change.select("id", "key", "old_key", F.lit(step).cast("bigint").alias("step"))
        self._merge_ids(new, change, f"ids-{folder}", id_bucket, full, grown)
        own = self._read(IDS, [f"ids-{folder}/b={b}" for b, ds in new["ids"].items() if f"ids-{folder}" in ds]).where(F.col("step") == step)

        came = own.select("key", F.lit(1).alias("n"), F.col("id").alias("came"), F.lit(None).cast("bigint").alias("left"))
        went = own.where("old_key IS NOT NULL").select(F.col("old_key").alias("key"), F.lit(-1).alias("n"), F.lit(None).cast("bigint").alias("came"), F.col("id").alias("left"))
        delta = came.unionByName(went).groupBy("key").agg(F.sum("n").alias("n"), F.min("came").alias("came"), F.min("left").alias("left"))
        bucket = F.pmod(F.xxhash64("key"), n).cast("int")
        touched = None if grown else [r[0] for r in delta.select(bucket).distinct().collect()]  # at most all buckets
        old = self._entries(touched).withColumnsRenamed({"copies": "n0", "id_kept": "id0"})
        least = F.when(F.col("left") == F.col("id0"), None).otherwise(F.least("came", "id0"))
        merged = delta.join(old, "key", "full_outer").select(
            "key", (F.coalesce("n", F.lit(0)) + F.coalesce("n0", F.lit(0))).alias("copies"), least.alias("id_kept")
        )
        fresh, moved = own.agg(F.count(F.when(F.col("old_key").isNull(), 1)), F.count("old_key")).first()
        if moved:  # a group whose kept record left takes the smallest id it still has
            stale = went.select("key").distinct()
            still = self._latest(self._read(IDS, [f"{d}/b={b}" for b, ds in new["ids"].items() for d in ds]))
            again = still.join(stale, "key", "left_semi").groupBy("key").agg(F.min("id").alias("id1"))
            merged = merged.join(again, "key", "left").withColumn("id_kept", F.coalesce("id_kept", "id1")).drop("id1")
        name = f"entries-{folder}"
        written = self._write(merged.where("copies > 0").withColumn("b", bucket), name)
        for b in range(new["buckets"]) if touched is None else touched:
            new["entries"].pop(str(b), None)
        new["entries"] |= {str(b): name for b in written}
        new["records"] += fresh
        self.files.put(f"manifests/{step:010d}.json", json.dumps(new))
        self.state = new
        self.files.delete(f"batch-{folder}")

    def _merge_ids(self, new: dict, change: DataFrame, name: str, bucket: Column, full: list[int], grown: bool) -> None:
        """Append the changes to the id table; buckets of many runs, or all if their number grew, are merged."""
        merge = self._ids(None if grown else full) if grown or full else None
        if merge is not None:
            last = merge.groupBy("id").agg(F.max(F.struct("step", "key")).alias("r")).select("id", "r.key", F.lit(None).cast("string").alias("old_key"), "r.step")
            change = change.unionByName(last)
        written = self._write(change.withColumn("b", bucket), name)
        runs = defaultdict(list, {} if grown else {b: ds for b, ds in new["ids"].items() if int(b) not in full})
        for b in written:
            runs[str(b)] = [*runs[str(b)], name]
        new["ids"] = dict(runs)

    def copies(self) -> DataFrame:
        """(id_kept, id_copy): every member of a group of two or more, but the kept one."""
        groups = self.entries().where("copies >= 2")
        # at most 1000 groups can hold a thousandth of all members each
        hot = f"copies * 1000 >= {max(self.state['records'], 1)}"
        both = split_join(self.members(), groups, ["key"], hot)
        return both.where("id <> id_kept").select("id_kept", F.col("id").alias("id_copy"))

    def vacuum(self) -> None:
        """Delete folders that no bucket uses any more; frames read from an earlier state end with that."""
        used = {*self.state["entries"].values(), *(d for ds in self.state["ids"].values() for d in ds), "manifests"}
        for n in self.files.names(""):
            if n not in used:
                self.files.delete(n)


def ledger_of(corpus: DataFrame, increments: int = 3, buckets: int = BUCKETS) -> CopyLedger:
    """A ledger fed with the corpus in ``increments`` runs of consecutive load batches (NULL batches come first)."""
    ledger = CopyLedger(corpus.sparkSession, buckets=buckets)
    cuts = corpus.select(F.percentile_approx("batch_id", [k / increments for k in range(1, increments)])).first()[0]
    bounds = [None, *dict.fromkeys(cuts or []), None]
    batch = F.coalesce("batch_id", F.lit(-(2**63)))
    for lo, hi in zip(bounds, bounds[1:]):
        part = corpus
        if lo is not None:
            part = part.where(batch > lo)
        if hi is not None:
            part = part.where(batch <= hi)
        ledger.add(records(part))
    return ledger
