"""Search over many queries at once: resolve, expand, weigh, rank, attribute, shape."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from polyglean.functions.text import highlight, highlight_pattern, scripts, snippet, tokenize
from polyglean.operators import fuzzy, meaning as mg, rank, synonyms as syn
from polyglean.operators.index import Index
from polyglean.runtime import materialize
from polyglean.sources.tables import numeric_order


@dataclass(frozen=True)
class Query:
    q: str
    lang: str = "all"
    fuzzy: bool = True
    synonyms: bool = True
    meaning: bool = True
    limit: int = 15

    @classmethod
    def parse(cls, args: dict[str, str]) -> "Query":
        """From text arguments: flags accept 1, true and yes; a limit that is no number is 15."""
        flag = lambda k: args.get(k, "true").lower() in ("1", "true", "yes")
        try:
            limit = int(args.get("limit", "15"))
        except ValueError:
            limit = 15
        return cls(args.get("q", "").strip(), args.get("lang", "all"), flag("fuzzy"), flag("synonyms"), flag("meaning"), limit)


@dataclass(frozen=True)
class Graphs:
    """Synonym components (word, label), merged links (a, b, cost, hub) and known words (term)."""

    words: DataFrame | None = None
    links: DataFrame | None = None
    known: DataFrame | None = None
    overlay: DataFrame | None = None


@dataclass
class Result:
    rows: DataFrame
    weighted: DataFrame | None = None
    resolved: DataFrame | None = None
    trace: dict = field(default_factory=dict)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, qpos, raw) from (query_id, q)."""
    return queries.select("query_id", F.posexplode(tokenize(F.col("q"))).alias("qpos", "raw"))


def _words(queries: DataFrame, graphs: Graphs) -> DataFrame:
    return graphs.words if graphs.words is not None else queries.sparkSession.createDataFrame([], "word STRING, label STRING")


# each stage is used more than once behind it: it is written once instead of being planned again and again
def resolve_terms(queries: DataFrame, index: Index, graphs: Graphs, fuzzy_on: bool = True, meaning_on: bool = True) -> DataFrame:
    """(query_id, qpos, raw, term, distance)."""
    known = graphs.known if meaning_on else None
    return materialize(fuzzy.resolve(query_terms(queries), index.vocab, _words(queries, graphs), known, fuzzy_on), "resolved")


def meaning_terms(resolved: DataFrame, index: Index, graphs: Graphs) -> DataFrame:
    """(query_id, term, cost, path) of indexed words of the same meaning."""
    return materialize(mg.expand_queries(resolved.select("query_id", "qpos", "term"), graphs.links, index.vocab, graphs.overlay), "meanings")


def synonym_terms(resolved: DataFrame, graphs: Graphs) -> DataFrame:
    """(query_id, term) of the synonyms of the query terms."""
    reach = syn.closure(resolved.select(F.col("term").alias("word")), graphs.words)
    asked = resolved.select("query_id", F.col("term").alias("word")).distinct()
    return asked.join(reach, "word").select("query_id", F.col("synonym").alias("term"))


def weigh(queries: DataFrame, index: Index, graphs: Graphs, fuzzy_on: bool = True, synonyms_on: bool = True, meaning_on: bool = True) -> DataFrame:
    """(query_id, term, weight) of a table of queries (query_id, q), each term of a query once."""
    resolved = resolve_terms(queries, index, graphs, fuzzy_on, meaning_on)
    means = mg.reach_queries(resolved, graphs.links, index.vocab, graphs.overlay) if meaning_on and graphs.links is not None else None
    near = synonym_terms(resolved, graphs) if synonyms_on and graphs.words is not None else None
    return materialize(rank.summed_weights(resolved, means, near), "weighted")


def search_batch(queries: DataFrame, index: Index, graphs: Graphs, lang: str = "all", limit: int = 15, fuzzy_on: bool = True, synonyms_on: bool = True, meaning_on: bool = True) -> DataFrame:
    """Ranked rows of many queries: (query_id, rank, doc_id, lang, score, relative_score_pct)."""
    weighted = weigh(queries, index, graphs, fuzzy_on, synonyms_on, meaning_on)
    top = rank.best(weighted, index, lang, limit, summed=True)
    return top.select("query_id", "rank", "doc_id", "lang", F.round("score", 4).alias("score"), "relative_score_pct")


def browse(index: Index, lang: str = "all", limit: int = 15) -> DataFrame:
    """An empty query: all documents by id, without score."""
    docs = index.documents if lang == "all" else index.documents.where(F.col("lang") == lang)
    cut = docs.orderBy(*numeric_order(F.col("doc_id"))).limit(max(limit, 1))
    return cut.select("doc_id", "title", "lang", snippet(F.col("text")).alias("snippet"), F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("relative_score_pct"), "doc_length")


def search(spark: SparkSession, index: Index, query: Query, graphs: Graphs = Graphs()) -> Result:
    """One query with breakdown, attribution, meaning paths, snippets and highlighting, and a trace of its six stages.

    A failing meaning stage leaves the query without meaning terms; the trace holds its error. Texts are joined, cut and
    highlighted only for the rows that stay.
    """
    if not query.q:
        return Result(browse(index, query.lang, query.limit), trace={"mode": "browse", "total_docs": index.total, "stages": []})
    stages, clock = [], time.perf_counter

    def staged(name: str, began: float, **data) -> None:
        stages.append({"stage": name, "ms": round((clock() - began) * 1000, 3), **data})

    began = clock()
    one = spark.createDataFrame([(0, query.q)], "query_id INT, q STRING")
    found = one.select(scripts(F.col("q")).alias("s"), tokenize(F.col("q")).alias("t")).first()
    staged("tokens", began, terms=list(found["t"]), scripts=list(found["s"]))

    began = clock()
    resolved = resolve_terms(one, index, graphs, query.fuzzy, query.meaning)
    terms = resolved.orderBy("qpos").collect()  # of one query
    pruned = fuzzy.pruned_comparisons(resolved.where("distance IS NOT NULL").select(F.col("raw").alias("word")), index.vocab).agg(F.sum("pruned")).first()[0]
    staged("corrections", began, enabled=query.fuzzy, corrections={r["raw"]: r["term"] for r in terms if r["distance"] is not None}, pruned_comparisons=pruned or 0)

    began, means, paths, problem = clock(), None, {}, None
    if query.meaning and graphs.links is not None:
        try:
            means = meaning_terms(resolved, index, graphs)
            paths = {r["term"]: list(r["path"]) for r in means.orderBy("cost", "term").collect()}
        except Exception as error:  # a search goes on without meanings; what went wrong is told
            means, paths, problem = None, {}, f"{type(error).__name__}: {error}"
    staged("meanings", began, enabled=query.meaning, terms=list(paths), paths={t: " → ".join(p) for t, p in paths.items()}, **({"error": problem} if problem else {}))

    began = clock()
    near = synonym_terms(resolved, graphs) if query.synonyms and graphs.words is not None else None
    weighted = materialize(rank.term_weights(resolved.select("query_id", "qpos", "term"), index.vocab, means, near), "weighted")
    weights = weighted.orderBy("qpos").collect()  # of one query
    staged("synonyms", began, enabled=query.synonyms, seeds=[r["term"] for r in terms], terms=[r["term"] for r in weights if r["via"] == "synonym"])

    began = clock()
    stats = rank.term_stats(weighted, index).orderBy("qpos").collect()  # of one query
    staged("postings", began, terms=[r["term"] for r in weights], term_stats=[r.asDict() for r in stats])

    began = clock()
    marks = {*(r["raw"] for r in terms), *(r["term"] for r in terms), *paths}
    if query.synonyms and graphs.words is not None and marks:
        seeds = spark.createDataFrame([(w,) for w in sorted(marks)], "word STRING")
        marks |= {r["synonym"] for r in syn.closure(seeds, graphs.words).collect()}
    pattern = highlight_pattern(sorted(marks))
    scored = materialize(rank.scores_with_breakdown(weighted, index), "scored")
    matched = scored.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top")).first()
    top = rank.ranked(scored, index.documents, query.lang, query.limit)
    texts = index.documents.select("doc_id", "title", "text", "doc_length")
    chain = F.create_map(*[F.lit(x) for t, p in paths.items() for x in (t, " → ".join(p))]) if paths else None
    by = lambda via: rank.attribution(F.col("breakdown"), via)
    rows = F.broadcast(top).join(texts, "doc_id").select(
        "rank", "doc_id", highlight(F.col("title"), pattern).alias("title"), "lang",
        highlight(snippet(F.col("text")), pattern).alias("snippet"),
        F.when(F.col("score") > 0, F.round("score", 4)).alias("score"), "relative_score_pct", "breakdown", "doc_length",
        by("exact").alias("matched_by_exact"), by("meaning").alias("matched_by_meaning"), by("synonym").alias("matched_by_synonym"),
        (F.map_from_entries(F.transform(by("meaning"), lambda t: F.struct(t, F.element_at(chain, t)))) if chain is not None else F.lit(None).cast("map<string,string>")).alias("meaning_paths"),
    ).orderBy("rank")
    staged("scores", began, matched_docs=matched["n"], top_score=round(matched["top"] or 0.0, 4))
    corrected = " ".join(r["term"] for r in terms) if any(r["distance"] is not None for r in terms) else None
    head = {"mode": "search", "total_docs": index.total, "vocab_size": index.vocab.count(), "scripts_detected": list(found["s"]), "corrected_query": corrected}
    return Result(rows, weighted, resolved, {**head, "stages": stages})
