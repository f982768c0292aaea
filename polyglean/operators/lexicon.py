"""Dictionary operators: definitions, inflections, glosses, synonym and translation templates, as column expressions.

Lookups come from tables: ``entries`` (title, edition, status, ord, lang_code, language, part_of_speech, definitions) and
``wikitext`` (title, status, text). A status of 'error' marks a lookup that failed and may be tried again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from polyglean.functions.text import clean_html, is_cjk, normalize_link, title_variants, tokenize
from polyglean.functions.words import FUNCTION_WORDS

# Supported languages, words that only describe grammar, limits.
LANGUAGES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "pt": "Portuguese", "ar": "Arabic",
    "zh": "Chinese", "hi": "Hindi", "bn": "Bengali", "te": "Telugu", "mr": "Marathi", "ta": "Tamil", "ur": "Urdu",
    "gu": "Gujarati", "kn": "Kannada", "ml": "Malayalam", "or": "Odia", "pa": "Punjabi", "as": "Assamese",
    "sa": "Sanskrit",
}
GRAMMAR = (
    "inflection plural singular dual participle gerund infinitive feminine masculine neuter comparative superlative "
    "genitive dative accusative nominative vocative ablative locative instrumental past present future tense simple "
    "perfect imperfect preterite indicative subjunctive imperative conditional active passive reflexive person first "
    "second third first-person second-person third-person form forms case alternative spelling obsolete archaic dated "
    "nonstandard misspelling informal formal polite standard and or definite indefinite attributive predicative strong "
    "weak mixed singulative collective"
).split()
SUBSTANTIVE = ["Noun", "Verb", "Adjective", "Interjection"]
MAX_PER_LANGUAGE = 3
MAX_SYNONYMS = 8
MAX_DEFINITIONS = 4
MAX_SENSES = 2

#: Words that definitions are written with: they define others and say nothing as a link themselves. Own list.
DEFINING = (
    "ability act action activity amount anybody anyone anything area aspect attribute become behavior belonging body bring case category certain change characteristic "
    "class collection come common concerning condition consisting containing degree denoting describe describing different direction effect element entity event "
    "everybody everyone everything example expressing extent fact feature find general generally get give go group having help idea include including indicating "
    "instance involving item keep kind know lack large like little long look main make making manner mark matter mean meaning means measure member method name named "
    "nature new nobody nothing number object often old order originally part particular pertaining piece place point position possess possessing practice process "
    "produce property put quality quantity quick range related relating relation represent represents result say see sense serve set shape show similar small "
    "somebody someone something sort specific state step strong style subject substance system take tell thing things think time type unit unspecified usage use used "
    "useful using usual usually various verb noun adjective adverb way whole word words work"
).split()

#: Words never linked, unless a caller passes a list of its own.
BLOCKED = list(dict.fromkeys([*FUNCTION_WORDS, *GRAMMAR, *DEFINING]))

_STRIP = r"^[\s ]+|[\s ]+$"


def acceptable(term: Column, word: Column, blocked: list[str] | None = None) -> Column:
    """One token that is neither the headword nor a word of ``blocked`` (by default ``BLOCKED``)."""
    blocked = BLOCKED if blocked is None else blocked
    ok = (term != "") & ~term.rlike(r"[ :{]") & (term != word) & ((F.length(term) > 1) | is_cjk(term))
    return ok & ~term.isin(blocked) if blocked else ok


def inflection_root(definition: Column) -> Column:
    """The lemma if the definition is only grammar words followed by 'of <lemma>', else NULL."""
    d = F.regexp_replace(F.coalesce(definition, F.lit("")), _STRIP, "")
    pattern = r"^(.*?)\s+of\s+([^\s:;,()]+)"
    words = F.regexp_extract_all(F.lower(F.regexp_extract(d, pattern, 1)), F.lit(r"[a-z]+(?:-[a-z]+)*"), F.lit(0))
    only = (F.size(words) > 0) & F.forall(words, lambda w: w.isin(GRAMMAR))
    root = normalize_link(F.regexp_extract(d, pattern, 2))
    return F.when(d.rlike(pattern) & only & (root != ""), root)


def language_section(wikitext: Column, language: str) -> Column:
    """Body of one level-2 section, '' if there is none."""
    return F.regexp_extract(wikitext, rf"(?ms)^==[^\S\n]*\Q{language}\E[^\S\n]*==[^\S\n]*$(.*?)(?=^==[^=\n][^\n]*==[^\S\n]*$|\z)", 1)


def glosses(definition: Column, word: Column, blocked: list[str] | None = None) -> Column:
    """Leading one-word translations of a foreign definition: before any of ( ; : the first two parts."""
    lead = F.split(definition, r"[(;:]")[0]
    toks = F.transform(F.slice(F.split(lead, "[,/]"), 1, 2), lambda p: tokenize(p))
    one = F.transform(F.filter(toks, lambda t: F.size(t) == 1), lambda t: t[0])
    return F.filter(one, lambda t: acceptable(t, word, blocked) & (F.length(t) > 2))


def templates(text: Column, names: list[str]) -> Column:
    """Parts of the templates of the given names, in page order: name, language code and parameters."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"\{\{([^{}]+)\}\}"), F.lit(1)), lambda t: F.split(t, r"\|"))
    return F.filter(parts, lambda p: p[0].isin(names) & (F.size(p) > 2) & p[1].rlike("^[a-z-]{2,8}$"))


def wikitext_synonyms(pages: DataFrame, blocked: list[str] | None = None) -> DataFrame:
    """(word, synonyms): up to 8 unnamed parameters of synonym templates, in page order.

    ``pages``: (word, section_lang, text); a NULL section language accepts every supported one.
    """
    t = pages.select("word", "section_lang", F.posexplode(templates(F.col("text"), ["syn", "synonyms"])).alias("n", "t"))
    code = F.col("t")[1]
    t = t.where(F.when(F.col("section_lang").isNotNull(), code == F.col("section_lang")).otherwise(code.isin(list(LANGUAGES))))
    p = t.select("word", "n", F.posexplode(F.slice("t", 3, 1 << 20)).alias("k", "p")).where(~F.col("p").contains("="))
    terms = p.select("word", "n", "k", normalize_link(F.col("p")).alias("term"))
    terms = terms.where(acceptable(F.col("term"), F.col("word"), blocked) & (F.length("term") > 2))
    return _in_order(terms, "synonyms", MAX_SYNONYMS)


#: Translation templates of the dictionary: plain, with a link to the other edition, in tables, to be checked.
TRANSLATIONS = [f"{t}{x}" for t in ("t", "tt") for x in ("", "+", "-check", "+check", "-simple")]


def wikitext_translations(pages: DataFrame, blocked: list[str] | None = None) -> DataFrame:
    """(word, translations): terms of translation templates in the English section, at most 3 per language."""
    english = pages.where("section_lang IS NULL OR section_lang = 'en'").select("word", language_section(F.col("text"), "English").alias("text"))
    t = english.select("word", F.posexplode(templates(F.col("text"), TRANSLATIONS)).alias("n", "t"))
    t = t.select("word", "n", F.col("t")[1].alias("code"), normalize_link(F.col("t")[2]).alias("term"))
    t = t.where(F.col("code").isin(list(LANGUAGES)) & acceptable(F.col("term"), F.col("word"), blocked))
    first = t.groupBy("word", "term").agg(F.min(F.struct("n", "code")).alias("f")).select("word", "term", "f.n", "f.code")
    rank = F.row_number().over(W.partitionBy("word", "code").orderBy("n"))
    kept = first.withColumn("r", rank).where(F.col("r") <= MAX_PER_LANGUAGE)
    return _in_order(kept.select("word", "n", F.lit(0).alias("k"), "term"), "translations", None)


def _in_order(terms: DataFrame, name: str, limit: int | None) -> DataFrame:
    first = terms.groupBy("word", "term").agg(F.min(F.struct("n", "k")).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"])
    return first.groupBy("word").agg((F.slice(listed, 1, limit) if limit else listed).alias(name))


def definitions(words: DataFrame, entries: DataFrame) -> DataFrame:
    """(word, page_title, ord, lang_code, language, part_of_speech, definitions): entries of the words' pages.

    ``words``: (word, preferred_lang). Titles are tried as written, then capitalised; a later one only if the earlier
    had no supported language, or always for German. The first title wins per language, the preferred language comes
    first. A failed lookup of a title ends the search for its word. Definitions are cleaned, distinct, at most four.
    """
    tried = words.select("word", "preferred_lang", F.posexplode(title_variants(F.col("word"))).alias("v", "title"))
    hits = tried.join(entries, "title")
    by_title = hits.groupBy("word", "v").agg(
        F.max((F.col("status") == "error").cast("int")).alias("error"),
        F.max((F.col("lang_code").isin(list(LANGUAGES)) & (F.col("status") == "ok")).cast("int")).alias("supported"),
    )
    before = W.partitionBy("word").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    state = by_title.select("word", "v", F.coalesce(F.max("error").over(before), F.lit(0)).alias("failed"), F.coalesce(F.max("supported").over(before), F.lit(0)).alias("had"))
    used = hits.join(state, ["word", "v"]).where("status = 'ok' AND failed = 0 AND (had = 0 OR preferred_lang = 'de')")
    first = used.withColumn("lead", F.min("v").over(W.partitionBy("word", "lang_code"))).where("v = lead")
    clean = F.filter(F.transform("definitions", lambda d: clean_html(d)), lambda d: d != "")
    page = F.min(F.when(F.col("lang_code").isin(list(LANGUAGES)), F.struct("v", "title"))).over(W.partitionBy("word"))
    out = first.select("word", F.coalesce(page["title"], F.col("word")).alias("page_title"), F.when(F.col("lang_code") == F.col("preferred_lang"), 0).otherwise(1).alias("later"), "v", "ord", "lang_code", "language", "part_of_speech", F.slice(F.array_distinct(clean), 1, MAX_DEFINITIONS).alias("definitions"))
    place = F.row_number().over(W.partitionBy("word").orderBy("later", "v", "ord"))
    return out.where(F.size("definitions") > 0).withColumn("ord", place).drop("later", "v")


def meaning_records(words: DataFrame, entries: DataFrame, wikitext: DataFrame, blocked: list[str] | None = None) -> DataFrame:
    """One dictionary row per word: found, complete, summary, direct_glosses, inflection_roots, thesaurus_synonyms, links.

    Entries of the preferred language are used alone if there are any. Substantive parts of speech and real
    definitions come first. Links are lemmas (cost 0), glosses (hub: the gloss), synonyms and translations (hub: the
    word), each term by its first source. Lemmas are dropped if the word has a definition of its own.
    """
    d = definitions(words, entries).where(F.col("language").isin(list(LANGUAGES.values()))).join(words, "word")
    own = F.max((F.col("lang_code") == F.coalesce("preferred_lang", F.lit(""))).cast("int")).over(W.partitionBy("word"))
    d = d.withColumn("own", own).where("own = 0 OR lang_code = preferred_lang")
    root1 = inflection_root(F.col("definitions")[0])
    place = F.row_number().over(W.partitionBy("word").orderBy((~F.col("part_of_speech").isin(SUBSTANTIVE)).cast("int"), root1.isNotNull().cast("int"), "ord"))
    senses = d.withColumn("place", place).select("word", "own", "lang_code", "preferred_lang", "page_title", "place", F.posexplode("definitions").alias("sense", "d"))
    senses = senses.withColumn("root", inflection_root(F.col("d")))
    at = F.struct("place", "sense")
    facts = senses.groupBy("word").agg(
        F.max("own").alias("own"), F.first("preferred_lang").alias("preferred_lang"), F.first("page_title").alias("page_title"),
        F.max(F.col("root").isNull()).alias("lemma"),
        F.coalesce(F.min_by("d", F.when(F.col("root").isNull(), at)), F.min_by("d", at)).alias("summary"),
    )
    roots = senses.where("root IS NOT NULL").join(facts.where("NOT lemma").select("word"), "word", "left_semi")
    roots = roots.where(acceptable(F.col("root"), F.col("word"), blocked)).select("word", F.col("place").alias("n"), F.col("sense").alias("k"), F.col("root").alias("term"))
    gl = senses.where(F.col("root").isNull() & (F.col("lang_code") != "en") & (F.col("sense") < MAX_SENSES))
    gl = gl.select("word", (F.col("place") * 100 + F.col("sense")).alias("n"), F.posexplode(glosses(F.col("d"), F.col("word"), blocked)).alias("k", "term"))
    pages = facts.join(wikitext.where("status = 'ok'").select(F.col("title").alias("page_title"), "text"), "page_title").select("word", F.when(F.col("own") == 1, F.col("preferred_lang")).alias("section_lang"), "text")
    failed = facts.join(wikitext.where("status = 'error'").select(F.col("title").alias("page_title")), "page_title", "left_semi").select("word", F.lit(True).alias("failed"))
    out = words.join(facts, "word", "left")
    for part in (_in_order(roots, "inflection_roots", None), _in_order(gl, "direct_glosses", None), wikitext_synonyms(pages, blocked), wikitext_translations(pages, blocked), failed):
        out = out.join(part, "word", "left")
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(c, empty) for c in ("inflection_roots", "direct_glosses", "synonyms", "translations")]
    link = lambda cost, side: lambda t: F.struct(t.alias("term"), F.lit(cost).alias("cost"), F.lit(side).cast("string").alias("hub_side"))
    kinds = [(lists[0], 0, None), (lists[1], 1, "other"), (lists[2], 1, None), (lists[3], 1, "self")]
    links = F.concat(*[F.transform(c, link(cost, side)) for c, cost, side in kinds])
    names = F.transform(links, lambda x: x["term"])
    unique = F.filter(links, lambda x, i: F.array_position(names, x["term"]) == i + 1)
    return out.select(
        F.col("word").alias("term"), F.col("lemma").isNotNull().alias("found"), (~F.coalesce("failed", F.lit(False))).alias("complete"),
        "summary", F.concat(F.lit("https://en.wiktionary.org/wiki/"), F.coalesce("page_title", "word")).alias("url"),
        lists[1].alias("direct_glosses"), lists[0].alias("inflection_roots"), F.slice(lists[2], 1, 6).alias("thesaurus_synonyms"),
        F.slice(lists[3], 1, 15).alias("translations"), unique.alias("links"),
    )
