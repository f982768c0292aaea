"""Incremental index maintenance: a stream of document changes, applied batch by batch.

All state lies in tables under one folder and one small pointer file that names the valid ones; a batch becomes valid
when that file is replaced. An index opened on a folder continues from there, so a restarted stream finds everything.
Batches append: the changed documents, their postings, the words resolved. What a document is now is its latest change;
older ones are left out when read and dropped when ``SEGMENTS`` segments are merged into one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from polyglean.operators import index as ix, meaning as mg
from polyglean.runtime import files, materialize, path_for
from polyglean.sources.tables import LINK_SCHEMA, LinkStore, require_valid

CHANGE_SCHEMA = "doc_id STRING, title STRING, lang STRING, text STRING, op STRING, at TIMESTAMP"
RESOLVED_SCHEMA = "term STRING, summary STRING, url STRING, glosses ARRAY<STRING>, synonyms ARRAY<STRING>, found BOOLEAN"
SEGMENT_SCHEMA = "doc_id STRING, title STRING, lang STRING, text STRING, gone BOOLEAN, segment BIGINT"
POSTING_SCHEMA = "term STRING, doc_id STRING, tf BIGINT, pos INT, segment BIGINT"
DOCUMENT_COLUMNS = ["doc_id", "title", "lang", "text"]
#: Segments an index may have before they are merged into one.
SEGMENTS = 16
#: Reports kept in the pointer file.
REPORTS = 100


class LiveIndex:
    """Documents, links and resolved words that follow a change stream, kept under ``path``.

    ``links``: a store that also gets the links after each batch; a new index starts with what it holds.
    """

    def __init__(self, spark: SparkSession, dictionary: DataFrame, links: LinkStore | None = None, function_words: list[str] | None = None, path: str | None = None):
        self.spark, self.dictionary, self.store, self.function_words = spark, dictionary, links, function_words or [""]
        self.path = (path or path_for(spark, "live")).rstrip("/")
        self.files = files(spark, self.path)
        held = self.files.read("STATE")
        self.state = json.loads(held) if held else {"done": -1, "segments": [], "postings": [], "resolved": [], "links": None, "reports": []}

    @property
    def done(self) -> int:
        return self.state["done"]

    @property
    def reports(self) -> list[dict]:
        return self.state["reports"]

    def _read(self, schema: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    @staticmethod
    def _live(segments: DataFrame) -> DataFrame:
        """(doc_id, segment) of the documents that are there; texts take no part."""
        last = segments.groupBy("doc_id").agg(F.max(F.struct("segment", "gone")).alias("r"))
        return last.where("NOT r.gone").select("doc_id", F.col("r.segment").alias("segment"))

    def _documents(self, state: dict) -> DataFrame:
        segments = self._read(SEGMENT_SCHEMA, state["segments"])
        return segments.join(self._live(segments), ["doc_id", "segment"], "left_semi").select(*DOCUMENT_COLUMNS)

    def _postings(self, state: dict) -> DataFrame:
        live = self._live(self._read(SEGMENT_SCHEMA, state["segments"]))
        return self._read(POSTING_SCHEMA, state["postings"]).join(live, ["doc_id", "segment"], "left_semi").select("term", "doc_id", "tf", "pos")

    @property
    def documents(self) -> DataFrame:
        return self._documents(self.state)

    @property
    def resolved(self) -> DataFrame:
        return self._read(RESOLVED_SCHEMA, self.state["resolved"])

    @property
    def links(self) -> DataFrame:
        if self.state["links"] is None:
            return self.store.load() if self.store else self.spark.createDataFrame([], LINK_SCHEMA)
        return self._read(LINK_SCHEMA, [self.state["links"]])

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """Apply one batch: the latest change per id counts, adds need a title and a text, deletes remove the id.

        A batch seen before is skipped, so a restarted stream does no harm; one that fails leaves the state before it.
        Words whose lookup failed stay unresolved and are tried again in the next batch that holds them.
        """
        if batch_id <= self.done:
            return
        last = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("at").desc_nulls_last(), F.col("op").desc()))
        latest = changes.withColumn("n", last).where("n = 1")
        gone = latest.where("op = 'delete'").select("doc_id")
        new = require_valid(latest.where("coalesce(op, 'add') = 'add'")).select(*DOCUMENT_COLUMNS)
        tag, state = f"{batch_id}-{uuid.uuid4().hex[:8]}", json.loads(json.dumps(self.state))
        segment = F.lit(batch_id).cast("bigint").alias("segment")
        null = F.lit(None).cast("string")
        added = new.select(*DOCUMENT_COLUMNS, F.lit(False).alias("gone"), segment)
        removed = gone.select("doc_id", null.alias("title"), null.alias("lang"), null.alias("text"), F.lit(True).alias("gone"), segment)
        added.unionByName(removed).write.parquet(f"{self.path}/segment-{tag}")
        own = self._read(SEGMENT_SCHEMA, [f"segment-{tag}"]).where("NOT gone").select(*DOCUMENT_COLUMNS)
        ix.build_postings(own).select("term", "doc_id", "tf", "pos", segment).write.parquet(f"{self.path}/postings-{tag}")
        state["segments"].append(f"segment-{tag}")
        state["postings"].append(f"postings-{tag}")
        self._learn(state, own, tag)
        if len(state["segments"]) > SEGMENTS:
            self._merge(state, tag, segment)
        state["done"] = batch_id
        before = {*self.state["segments"], *self.state["postings"], *self.state["resolved"], self.state["links"]}
        self.files.put("STATE", json.dumps(state))
        self.state = state
        if self.store:
            self.store.save(self.links)
        # what the state before used stays for its readers; anything older, or left by a batch that failed, goes
        used = {*state["segments"], *state["postings"], *state["resolved"], state["links"], *before}
        for name in self.files.names():
            if name.split("-")[0] in ("segment", "postings", "resolved", "links") and name not in used:
                self.files.delete(name)

    def _learn(self, state: dict, own: DataFrame, tag: str) -> None:
        """Look up the words of the new documents and keep links and resolved words of this batch."""
        vocab = ix.build_vocab(self._postings(state))
        total = self._live(self._read(SEGMENT_SCHEMA, state["segments"])).count()
        resolved, links = self.resolved, self.links
        chosen = materialize(mg.select_terms(own, vocab, total, self.function_words, resolved), "terms")
        merged, everything = mg.learn(links, resolved, chosen, self.dictionary)
        everything.join(resolved.select("term"), "term", "left_anti").write.parquet(f"{self.path}/resolved-{tag}")
        merged.write.parquet(f"{self.path}/links-{tag}")
        state["resolved"].append(f"resolved-{tag}")
        state["links"] = f"links-{tag}"
        tried = chosen.select("term").distinct()
        attempted, linked = tried.count(), tried.join(self._read(RESOLVED_SCHEMA, state["resolved"]), "term", "left_semi").count()
        edges = self._read(LINK_SCHEMA, [state["links"]]).count() - links.count()
        report = {"terms_attempted": attempted, "terms_linked": linked, "terms_pending": 0, "terms_failed": attempted - linked, "edges_added": edges}
        state["reports"] = [*state["reports"], report][-REPORTS:]

    def _merge(self, state: dict, tag: str, segment) -> None:
        """One segment of all that is there now."""
        self._documents(state).select(*DOCUMENT_COLUMNS, F.lit(False).alias("gone"), segment).write.parquet(f"{self.path}/segment-m{tag}")
        self._postings(state).select("term", "doc_id", "tf", "pos", segment).write.parquet(f"{self.path}/postings-m{tag}")
        self._read(RESOLVED_SCHEMA, state["resolved"]).write.parquet(f"{self.path}/resolved-m{tag}")
        state["segments"], state["postings"], state["resolved"] = [f"segment-m{tag}"], [f"postings-m{tag}"], [f"resolved-m{tag}"]

    def index(self) -> ix.Index:
        """The index of the documents that are there, from the postings kept."""
        docs, postings = self.documents, self._postings(self.state)
        return ix.Index(ix.with_length(docs), postings, ix.build_vocab(postings), docs.count())

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Start following a streaming DataFrame of ``CHANGE_SCHEMA``; call ``processAllAvailable`` to read own writes."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).start()


def json_changes(spark: SparkSession, path: str) -> DataFrame:
    """Changes arriving as JSON lines files in a folder."""
    return spark.readStream.schema(CHANGE_SCHEMA).json(path)
