"""Searches whose queries are the records themselves, against brute force on small tables."""

import datetime
import math
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from polyglean.operators import best, index as ix, meaning as mg, rank
from polyglean.plans import queries as plans

TEXTS = {"1": "alpha beta", "2": "beta beta gamma", "100": "alpha alpha", "x9": "gamma alpha", "007": "", "7": "delta"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("records"))
    rows = [(i, None, "en", t, 1, datetime.datetime(2024, 1, 1)) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "id string, title string, lang string, text string, batch_id bigint, loaded_at timestamp").write.parquet(f"{d}/corpus.parquet")
    return d


def test_breakdown_of_every_record(spark, folder):
    tf = {i: Counter(t.split()) for i, t in TEXTS.items()}
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log(len(TEXTS) / (1 + n)) + 1 for t, n in df.items()}
    want = Counter((q, d, t, c[t], round(idf[t], 4), round(c[t] * idf[t], 4)) for q, text in TEXTS.items() for t in text.split() for d, c in tf.items() if t in c)
    got = plans.QUERIES["record_search_breakdown"](spark, folder).collect()
    assert Counter((r["query_id"], r["doc_id"], r["term"], r["tf"], r["idf"], r["contribution"]) for r in got) == want
    assert {r["weight"] for r in got} == {1.0}


def test_matches_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(rank, "PART", 2)
    docs = [(str(i), "", "en", " ".join(["one", "two", "two"][: 1 + i % 3])) for i in range(9)]
    index = ix.written(spark.createDataFrame(docs, "doc_id string, title string, lang string, text string"))
    uses = [(q, p, t, w, "exact") for q in range(3) for p, (t, w) in enumerate([("one", 1.0), ("two", 0.65), ("one", 1.0), ("none", 1.0)])]
    weighted = spark.createDataFrame(uses, "query_id int, qpos int, term string, weight double, via string")
    parts = rank.scores_with_breakdown(weighted, index).select("query_id", "doc_id", F.explode("breakdown").alias("b"))
    want = parts.select("query_id", "doc_id", "b.term", "b.tf", "b.idf", "b.weight", "b.contribution")
    got = rank.contributions(weighted, index)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and want.count() == 3 * (9 * 2 + 6)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 2


def collection(spark, rng, build):
    words = [f"w{k}" for k in range(12)]
    docs = [(rng.choice(["", "x"]) + str(n), "", rng.choice(["en", "fr"]), " ".join(rng.choices(words, range(1, 13), k=rng.randint(0, 6)))) for n in range(300)]
    docs += [(None, "", "fr", "w1 w1 w1 w2 w2"), *((str(1000 + n), "", "en", "w3 w4") for n in range(100))]
    index = build(spark.createDataFrame(docs, "doc_id string, title string, lang string, text string"))
    uses = [(f"q{q}", p, rng.choice(words), rng.choice([1.0, 1.0, 0.65]), "exact") for q in range(25) for p in range(rng.randint(1, 8))]
    uses.append(("none", 0, "unknown", 1.0, "exact"))
    return docs, index, uses, spark.createDataFrame(uses, "query_id string, qpos int, term string, weight double, via string")


@pytest.mark.parametrize("build", [ix.written, ix.for_batches])
@pytest.mark.parametrize("lang,limit,sent,held,many", [("all", 15, 10**6, 10**6, 4096), ("fr", 5, 20, 50, 20), ("all", 0, 30, 200, 30), ("none", 3, 20, 50, 20)])
def test_best_rows_by_blocks(spark, monkeypatch, lang, limit, sent, held, many, build):
    for name, n in (("SENT", sent), ("HELD", held), ("MANY", many), ("LONG", 1 + held // 10)):
        monkeypatch.setattr(best, name, n)
    docs, index, uses, weighted = collection(spark, random.Random(limit), build)
    tf = [(i, d, Counter(t.split())) for i, _, d, t in docs]
    df = Counter(t for *_, c in tf for t in c)
    want = set()
    for q in {u[0] for u in uses}:
        own = [(t, w) for x, _, t, w, _ in uses if x == q]
        scored = [(sum(c[t] * (math.log(len(docs) / (1 + df[t])) + 1) * w for t, w in own if t in c), i, d) for i, d, c in tf]
        top = max(s for s, *_ in scored)
        rows = [(-round(s, 9), not i.isdigit(), int(i) if i.isdigit() else 0, i, d) for s, i, d in scored if s > 0 and i is not None and lang in ("all", d)]
        want |= {(q, k, i, d, round(-s, 4), round(100 * -s / top, 1)) for k, (s, _, _, i, d) in enumerate(sorted(rows)[: max(limit, 1)], 1)}
    got = rank.best(weighted, index, lang, limit).collect()
    assert {(r["query_id"], r["rank"], r["doc_id"], r["lang"], round(r["score"], 4), r["relative_score_pct"]) for r in got} == want and len(got) == len(want)


def test_vocabulary_of_batches(spark):
    docs, index, *_ = collection(spark, random.Random(1), ix.for_batches)
    rows = spark.createDataFrame(docs, "doc_id string, title string, lang string, text string")
    same = lambda i: sorted(map(str, i.vocab.collect()))
    assert same(index) == same(ix.written(rows)) and index.total == len(docs)
    empty = ix.for_batches(rows.where("false"))
    assert empty.total == 0 and empty.vocab.count() == 0
    asked = spark.createDataFrame([(1, 0, "w1", 1.0, "exact")], "query_id int, qpos int, term string, weight double, via string")
    assert rank.best(asked, empty).collect() == [] and rank.best(asked.where("false"), index).collect() == []


def test_copies_in_a_cut():
    scores = np.array([1.0, 3.0, 2.0, *[2.0] * 50, 2.0 + 1e-12, 0.0, 5.0])
    assert best._firsts(scores, 4).tolist() == [55, 1, 53, 2, 3, 4, 5] and best._firsts(scores[-2:], 4).tolist() == [1]


@pytest.mark.parametrize("name", ["record_search_batch", "record_search_lang_filtered", "record_synonym_weighted_search", "record_meaning_weighted_search", "record_full_search"])
def test_no_match_becomes_a_row(spark, monkeypatch, name):
    def fail(*_):
        raise AssertionError("matches as rows")

    data = "/root/testdata/sf0.001"
    want = sorted(map(tuple, plans.QUERIES[name](spark, data).collect()))
    monkeypatch.setattr(rank, "_matches", fail)
    assert want and sorted(map(tuple, plans.QUERIES[name](spark, data).collect())) == want


def test_meanings_of_queries_by_components(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    links = set()
    for _ in range(60):
        a, b = rng.sample(words, 2)
        links.add((a, b, rng.choice([0, 1, 1, 1]), rng.choice([a, b, None])))
    merged = mg.merge_links(spark.createDataFrame(sorted(links, key=str), "a string, b string, cost int, hub string"))
    uses = [(q, p, rng.choice([*words, "far"])) for q in range(30) for p in range(rng.randint(1, 4))]
    terms = spark.createDataFrame(uses, "query_id int, qpos int, term string")
    vocab = spark.createDataFrame([(w,) for w in [*words[:25], "far"]], "term string")
    want = mg.expand_queries(terms, merged, vocab).select("query_id", "term", "cost").collect()
    near = spark.createDataFrame([(q, rng.choice(words)) for q in range(30) for _ in range(3)], "query_id int, term string")
    means = mg.reach_queries(terms, merged, vocab)
    got = means.join(terms, ["query_id", "term"], "left_anti").groupBy("query_id", "term").agg(F.min("cost").alias("cost")).collect()
    weights = rank.term_weights(terms, vocab, means, near).groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))
    indexed = lambda w: sorted(map(tuple, w.join(vocab, "term", "left_semi").select("query_id", "term", "weight").collect()))
    assert indexed(rank.summed_weights(terms, means, near)) == indexed(weights)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["cost"] for r in got} == {0, 1, 2}
