import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from polyglean.operators import index as ix, lexicon as lx
from polyglean.sources.tables import LinkStore, read_json_corpus, require_valid, write_corpus
from polyglean.streaming.ingest import LiveIndex, json_changes

PAGE = """==English==
===Noun===
{{syn|en|tusker|q1=old}} {{synonyms|en|jumbo|mammoth}}
====Translations====
* {{tt+|hi|हाथी|m}}, {{tt+|hi|गज|m}}, {{t|hi|हस्ती}}, {{t|hi|पील}}
* {{t|es|elefante}} {{t|ar|فِيل}} {{t|zh|[[大象]]}} {{tt|tlh|ghIlab}}
==Spanish==
{{syn|es|paquidermo}}
* {{t|es|noenglish}}
"""


def test_inflection(spark):
    cases = {
        "plural of kitten": "kitten", "inflection of viajar: first-person singular present": "viajar",
        "nominative/accusative/genitive plural of Apfel": "apfel", "present participle and gerund of run": "run",
        "ellipsis of jardín delantero": None, "A young cat": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string").select("d", lx.inflection_root(F.col("d")).alias("r"))
    assert {r["d"]: r["r"] for r in df.collect()} == cases


def test_wikitext(spark):
    pages = spark.createDataFrame([("elephant", None, PAGE), ("elephant2", "en", PAGE), ("paquidermo", "es", PAGE)], "word string, section_lang string, text string")
    s = {r["word"]: r["synonyms"] for r in lx.wikitext_synonyms(pages).collect()}
    assert s == {"elephant": ["tusker", "jumbo", "mammoth", "paquidermo"], "elephant2": ["tusker", "jumbo", "mammoth"]}
    t = {r["word"]: r["translations"] for r in lx.wikitext_translations(pages).collect()}
    assert t["elephant"] == ["हाथी", "गज", "हस्ती", "elefante", "فيل", "大象"] and "paquidermo" not in t


def test_records(spark):
    entries = spark.createDataFrame(
        [
            ("kittens", "en", "ok", 0, "en", "English", "Noun", ["plural of <i>kitten</i>"]),
            ("pomme", "en", "ok", 0, "fr", "French", "Verb", ["inflection of pommer: third-person"]),
            ("pomme", "en", "ok", 1, "fr", "French", "Noun", ["apple (fruit)", "apple tree", "breasts"]),
            ("Apfel", "en", "ok", 0, "de", "German", "Noun", ["apple, fruit"]),
            ("apfel", "en", "ok", 0, "gmh", "Middle High German", "Noun", ["apple"]),
            ("lost", "en", "error", 0, None, None, None, None),
        ],
        "title string, edition string, status string, ord int, lang_code string, language string, part_of_speech string, definitions array<string>",
    )
    words = spark.createDataFrame([("kittens", None), ("pomme", "fr"), ("apfel", None), ("lost", None)], "word string, preferred_lang string")
    wiki = spark.createDataFrame([("pomme", "error", "")], "title string, status string, text string")
    got = {r["term"]: r for r in lx.meaning_records(words, entries, wiki).collect()}
    assert got["kittens"]["links"] == [("kitten", 0, None)] and got["kittens"]["found"]
    assert [x["term"] for x in got["pomme"]["links"]] == ["apple"] and not got["pomme"]["complete"]
    assert got["pomme"]["summary"] == "apple (fruit)" and got["pomme"]["inflection_roots"] == []
    assert got["apfel"]["direct_glosses"] == ["apple", "fruit"] and got["apfel"]["url"].endswith("/Apfel")
    assert not got["lost"]["found"]


def test_store_and_json(spark, tmp_path):
    store = LinkStore(spark, f"file://{tmp_path}/links")
    assert store.load().count() == 0
    for k in (1, 2):
        store.save(spark.createDataFrame([("a", "b", k, None), ("b", "a", k, None)], "a string, b string, cost int, hub string"))
        assert [tuple(r) for r in store.load().collect()] == [("a", "b", k, None)]
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps([{"id": "2", "title": "t", "lang": None, "text": "x"}, {"id": "10", "title": None, "lang": "fr", "text": "y"}]))
    docs = read_json_corpus(spark, f"file://{path}")
    assert {r["doc_id"]: (r["title"], r["lang"]) for r in docs.collect()} == {"2": ("t", "en"), "10": ("", "fr")}
    write_corpus(docs, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2
    assert read_json_corpus(spark, f"file://{tmp_path}/none.json").count() == 0
    assert require_valid(spark.createDataFrame([("1", " ", None, "x"), ("2", "a", None, " b ")], "doc_id string, title string, lang string, text string")).count() == 1


def test_stream(spark, tmp_path):
    d = "term string, found boolean, complete boolean, summary string, url string, direct_glosses array<string>, inflection_roots array<string>, thesaurus_synonyms array<string>, links array<struct<term: string, cost: int, hub_side: string>>"
    dictionary = spark.createDataFrame(
        [
            ("kittens", True, True, "s", "u", [], ["kitten"], [], [("kitten", 0, None)]),
            ("kitten", True, True, "s", "u", [], [], [], [("gatito", 1, "self")]),
            ("flaky", False, False, None, None, [], [], [], []),
        ],
        d,
    )
    live = LiveIndex(spark, dictionary)
    inbox = tmp_path / "in"
    inbox.mkdir()
    q = live.follow(json_changes(spark, f"file://{inbox}"), f"file://{tmp_path}/cp")
    try:
        def put(name, *rows):
            (inbox / name).write_text("\n".join(json.dumps(r) for r in rows))
            q.processAllAvailable()

        at = "2024-01-01T00:00:0{}"
        put("a.json", {"doc_id": "1", "title": "pets", "lang": "en", "text": "kittens flaky", "op": "add", "at": at.format(1)}, {"doc_id": "2", "title": "", "text": "no title", "op": "add", "at": at.format(1)})
        assert [r["doc_id"] for r in live.documents.collect()] == ["1"]
        assert {(r["a"], r["b"], r["cost"], r["hub"]) for r in live.links.collect()} == {("kitten", "kittens", 0, None), ("gatito", "kitten", 1, "kitten")}
        assert {r["term"] for r in live.resolved.collect()} == {"kittens"}
        put("b.json", {"doc_id": "1", "op": "delete", "at": at.format(2)}, {"doc_id": "3", "title": "x", "lang": "en", "text": "kittens", "op": "add", "at": at.format(2)})
        assert [r["doc_id"] for r in live.documents.collect()] == ["3"]
        assert live.reports[-1]["edges_added"] == 0
        live.apply(spark.createDataFrame([], "doc_id string"), 0)  # a batch seen before
        assert live.documents.count() == 1
    finally:
        q.stop()


def test_live_index_survives_a_restart(spark, tmp_path, monkeypatch):
    """An index opened again on its folder is the one left; a failed batch changes nothing; segments are merged."""
    from polyglean.streaming import ingest

    monkeypatch.setattr(ingest, "SEGMENTS", 2)
    d = "term string, found boolean, complete boolean, summary string, url string, direct_glosses array<string>, inflection_roots array<string>, thesaurus_synonyms array<string>, links array<struct<term: string, cost: int, hub_side: string>>"
    dictionary = spark.createDataFrame([("kitten", True, True, "s", "u", [], [], [], [("gatito", 1, "self")])], d)
    path, docs = f"file://{tmp_path}/live", {}
    batches = [
        [("1", "pets", "a kitten", "add"), ("2", "cars", "wheel wheel", "add")], [("1", None, None, "delete"), ("3", "more", "kitten wheel", "add")],
        [("2", "cars", "motor", "add")], [("4", "x y", "z", "add"), ("9", None, None, "delete")], [("3", "more", "none", "add")],
    ]
    shape = lambda i: {name: sorted(tuple(r) for r in getattr(i, name).select(*cols).collect()) for name, cols in (("documents", ["doc_id", "title", "text", "doc_length"]), ("postings", ["term", "doc_id", "tf"]), ("vocab", ["term", "df"]))}
    for n, batch in enumerate(batches):
        changes = spark.createDataFrame([(i, t, "en", x, op, None) for i, t, x, op in batch], ingest.CHANGE_SCHEMA)
        live = LiveIndex(spark, dictionary, path=path)
        if n == 2:
            monkeypatch.setattr(live.files, "put", None)
            with pytest.raises(TypeError):
                live.apply(changes, n)
            live = LiveIndex(spark, dictionary, path=path)
        live.apply(changes, n)
        LiveIndex(spark, dictionary, path=path).apply(changes, n)  # seen before
        for i, t, x, op in batch:
            docs.pop(i, None)
            if op == "add":
                docs[i] = (i, t, "en", x)
        again = LiveIndex(spark, dictionary, path=path)
        built = ix.build(spark.createDataFrame(list(docs.values()), "doc_id string, title string, lang string, text string"))
        assert shape(again.index()) == shape(built) and again.index().total == built.total
    assert len(again.state["segments"]) <= 3 and again.done == 4 and len(again.reports) == 5
    assert {(r["a"], r["b"]) for r in again.links.collect()} == {("gatito", "kitten")} and [r["term"] for r in again.resolved.collect()] == ["kitten"]
