"""The registered queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

from polyglean.functions.text import ELIDED, SCRIPTS
from polyglean.functions.words import FUNCTION_WORDS

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_EDGE = r"^[\p{P}<>|]+|[\p{P}<>|]+$"
_ELISION = "^(?:" + "|".join(ELIDED) + r")[''’]([\p{L}\p{N}_])"


def tok(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array(lower({x}), '{_WS}'), lambda w: "
        f"regexp_replace(regexp_replace(w, '{_EDGE}', '', 'g'), '{_ELISION}', '\\1')), lambda w: w <> '')"
    )


DOCS = """docs AS (SELECT id AS doc_id, coalesce(title,'') AS title, coalesce(lang,'en') AS lang, coalesce(text,'') AS text
 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST, lang DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM corpus) WHERE rn = 1)"""
TOKS = f"toks AS (SELECT doc_id, title, lang, text, {tok('''trim(title || ' ' || text)''')} AS tokens FROM docs)"
OCC = "occ AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM toks)"
POST = "postings AS (SELECT term, doc_id, count(*) AS tf, min(pos) AS pos FROM occ GROUP BY term, doc_id)"
VOCAB = """vocab AS (SELECT term, count(*) AS df, min(CAST(doc_id AS BIGINT) * 100000000 + pos) AS ord FROM postings GROUP BY term)"""
BASE = f"WITH RECURSIVE {DOCS}, {TOKS}, {OCC}, {POST}, {VOCAB}"
N = "(SELECT count(*) FROM docs)"
IDF = f"ln({N} / (1.0 + df)) + 1.0"


def values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


def ranked(weighted: str, lang: str = "all", limit: int = 15) -> str:
    """Ranking of a relation weighted(query_id, term, weight), after BASE."""
    where = "" if lang == "all" else f"WHERE lang = '{lang}'"
    return f""", weighted AS ({weighted}), scored AS (SELECT query_id, doc_id, sum(tf * ({IDF}) * weight) AS score
 FROM weighted JOIN postings USING (term) JOIN vocab USING (term) GROUP BY query_id, doc_id),
 best AS (SELECT query_id, max(score) AS best FROM scored GROUP BY query_id),
 rows AS (SELECT s.*, d.lang, row_number() OVER (PARTITION BY s.query_id ORDER BY -round(score, 9), try_cast(s.doc_id AS BIGINT) NULLS LAST, s.doc_id) AS rank
 FROM scored s JOIN docs d USING (doc_id) {where})
 SELECT query_id, rank, doc_id, lang, round(score, 4) AS score, round(100 * score / best, 1) AS relative_score_pct
 FROM rows JOIN best USING (query_id) WHERE rank <= {max(limit, 1)}"""


_RE2 = lambda r: r.replace("\\u", "\\x{").replace("-\\x{", "}-\\x{") + ("}" if "\\u" in r else "")
SCRIPT_SQL = "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '[{_RE2(r)}]') THEN '{n}' END" for n, r in SCRIPTS.items()) + "], lambda x: x IS NOT NULL))"
FW = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
# merged links: the cheaper wins; equal ones that disagree on the hub (NULL is a value) have none
MERGED = """way AS (SELECT least(a,b) AS a, greatest(a,b) AS b, cost, hub FROM links WHERE a <> '' AND b <> '' AND a <> b),
 hubs AS (SELECT a, b, cost, CASE WHEN count(DISTINCT coalesce(hub, chr(1))) = 1 THEN min(hub) END AS hub FROM way GROUP BY a, b, cost),
 merged AS (SELECT a, b, cost, hub FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY cost) AS rn FROM hubs) WHERE rn = 1)"""
BOTH = "both_ways AS (SELECT a AS node, b AS nbr, cost, hub FROM merged UNION ALL SELECT b, a, cost, hub FROM merged)"


def expansion(seeds: str) -> str:
    """CTEs seeds(seed) ... reached(seed, node, cost); the recursive closure of cost-0 links is free(x, y)."""
    return f"""{MERGED}, {BOTH}, seeds AS ({seeds}),
 free AS (SELECT DISTINCT node AS x, node AS y FROM both_ways UNION SELECT f.x, n.nbr FROM free f JOIN both_ways n ON n.node = f.y AND n.cost = 0),
 l0 AS (SELECT seed, seed AS node FROM seeds UNION SELECT seed, y FROM seeds JOIN free ON x = seed),
 hop AS (SELECT l0.seed, nbr AS node, hub FROM l0 JOIN both_ways e ON e.node = l0.node AND cost = 1),
 l1 AS (SELECT DISTINCT seed, y AS node FROM hop JOIN free ON x = hop.node),
 turn AS (SELECT DISTINCT h.seed, e.nbr AS node FROM hop h JOIN both_ways e ON e.node = h.node AND e.cost = 1 AND e.hub = h.node WHERE h.hub = h.node),
 l2 AS (SELECT DISTINCT seed, y AS node FROM turn JOIN free ON x = turn.node),
 reached AS (SELECT seed, node, min(cost) AS cost FROM (SELECT seed, node, 0 AS cost FROM l0 UNION ALL SELECT seed, node, 1 FROM l1 UNION ALL SELECT seed, node, 2 FROM l2) WHERE node <> seed GROUP BY seed, node)"""


CLOSURE = """star AS (SELECT DISTINCT word, cluster_id FROM synonym_cluster WHERE word IS NOT NULL),
 near AS (SELECT DISTINCT a.word AS x, b.word AS y FROM star a JOIN star b USING (cluster_id)),
 reach AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON n.x = r.y)"""
