"""SQL for DuckDB of the training-data queries that SQL can express.

The plain form is written with string functions instead of code point tables; it covers the characters these tables
hold (widths, blanks, ligatures, Arabic presentation forms, radicals, look-alikes, composition).
"""

from __future__ import annotations

import unicodedata as U

from polyglean.plans.oracle import tok

# For each Latin letter what may stand for it, stated apart from the operator's table.
_MEANT = {
    "a": "аαɑ", "b": "ьЬ", "c": "сϲⲥᴄ", "d": "ԁ", "e": "еҽ", "g": "ɡցԍ", "h": "һհ", "i": "іιıɩɪ", "j": "јϳյȷ", "k": "кκ", "l": "ӏ",
    "n": "ո", "o": "оοօⲟᴏ", "p": "рρⲣ", "q": "ԛզ", "r": "г", "s": "ѕꜱ", "t": "τ", "u": "υսʋᴜ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "хχⲭ",
    "y": "уүγʏ", "z": "ᴢ",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹⲤᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗⲎᎻꓧ", "I": "ІΙӀⲒꓲ", "J": "ЈͿᎫꓙ",
    "K": "КΚⲔᏦꓗ", "L": "Ꮮꓡ", "M": "МΜⲘᎷꓟ", "N": "ΝⲚꓠ", "O": "ОΟՕⲞꓳ", "P": "РΡⲢᏢꓑ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏕᏚꓢ", "T": "ТΤⲦᎢꓔ",
    "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳᏔꓪ", "X": "ХΧⲬꓫ", "Y": "ҮУΥᎽꓬ", "Z": "ΖᏃꓜ",
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _plain(x: str) -> str:
    single, several = {}, {}
    for cp in [*range(0x2F00, 0x2FD6), *range(0xFB00, 0xFB07), *range(0xFE80, 0xFEFD), *range(0xFF01, 0xFF5F), *range(0xA0, 0x3001)]:
        ch = chr(cp)
        to = " " if U.category(ch) == "Zs" else U.normalize("NFKC", ch) if cp >= 0x2F00 else ch
        if to != ch:
            (single if len(to) == 1 else several)[ch] = to
    s = f"regexp_replace(coalesce({x}, ''), '\\p{{Cf}}+', '', 'g')"
    s = f"translate({s}, {_q(''.join(single))}, {_q(''.join(single.values()))})"
    for a, b in several.items():
        s = f"replace({s}, {_q(a)}, {_q(b)})"
    look, latin = "".join(_MEANT.values()), "".join(a * len(xs) for a, xs in _MEANT.items())
    runs = f"regexp_extract_all(nfc_normalize({s}), '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+')"
    run = f"CASE WHEN regexp_full_match(r, '[\\p{{Latin}}\\p{{M}}{look}]+') THEN translate(r, {_q(look)}, {_q(latin)}) ELSE r END"
    return f"nfc_normalize(array_to_string(list_transform({runs}, lambda r: {run}), ''))"


# lower() of DuckDB writes every capital sigma as a medial one
def _terms(x: str) -> str:
    return f"list_transform({tok(x)}, lambda t: regexp_replace(t, 'σ$', 'ς'))"


LAST = """(SELECT try_cast(id AS BIGINT) AS id, title, text, row_number() OVER (PARTITION BY try_cast(id AS BIGINT) ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM corpus QUALIFY rn = 1)"""
RECORDS = f"recs AS (SELECT id, coalesce(title, '') AS title, coalesce(text, '') AS text FROM {LAST})"
PLAIN = f"plain AS MATERIALIZED (SELECT id, title, text, {_plain('title')} AS pt, {_plain('text')} AS px FROM recs)"
BASE = f"WITH {RECORDS}, {PLAIN}"
_CANON = lambda c: f"regexp_replace(replace(lower({c}), 'ς', 'σ'), '[\\p{{Z}}\\p{{P}}\\p{{Cc}}\\p{{Cf}}]+', '', 'g')"
_WORDS = lambda c: f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({c}, '')), '[\\p{{P}}\\p{{Cf}}>]+', '', 'g'), '[\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda w: w <> '')"
_USES = f"uses AS (SELECT id, term, count(*) AS k FROM (SELECT id, unnest({_terms('''pt || ' ' || px''')}) AS term FROM plain) GROUP BY id, term)"
_FREQ = f"freq AS (SELECT term, count(*) AS uses, count(DISTINCT id) AS records FROM (SELECT id, unnest({_terms('px')}) AS term FROM plain) GROUP BY term)"
_MARK = "CASE WHEN records < 3 THEN 'rare' WHEN records >= (SELECT count(*) FROM recs) / 20.0 THEN 'common' END"
_XLNX = lambda x: f"CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END"
_TWO = [_XLNX(x) for x in ("k", "len - k", "cf - k", "t - cf - len + k")]
_ONE = [_XLNX(x) for x in ("len", "t - len", "cf", "t - cf")]
_G = f"greatest(2.0 * ({' + '.join(_TWO)} - ({' + '.join(_ONE)}) + {_XLNX('t')}), 0.0)"

SQL = {
    "p1_found": f"{BASE} SELECT a.id AS id_a, b.id AS id_b FROM plain a JOIN plain b ON a.pt = b.pt AND a.px = b.px AND a.id < b.id AND (a.title <> b.title OR a.text <> b.text)",
    "p1_plain": f"SELECT id, CASE WHEN title IS NOT NULL THEN {_plain('title')} END AS plain_title, CASE WHEN text IS NOT NULL THEN {_plain('text')} END AS plain_text FROM {LAST}",
    "p2_found": f"""{BASE}, {_USES}, n AS (SELECT term, count(*) AS n FROM uses GROUP BY term),
 best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -round(k * ln((SELECT count(*) FROM recs) / CAST(n AS DOUBLE)), 9), term) AS rn FROM uses JOIN n USING (term))
 SELECT id, term FROM best WHERE rn = 1 AND k >= 3 AND n BETWEEN 2 AND 20""",
    "p2_scores": f"""{BASE}, {_USES}, n AS (SELECT term, count(*) AS n, sum(k) AS cf FROM uses GROUP BY term), l AS (SELECT id, sum(k) AS len FROM uses GROUP BY id),
 c AS (SELECT id, term, k AS uses, n, CAST(k AS DOUBLE) AS k, CAST(cf AS DOUBLE) AS cf, CAST(len AS DOUBLE) AS len, CAST((SELECT sum(k) FROM uses) AS DOUBLE) AS t FROM uses JOIN n USING (term) JOIN l USING (id))
 SELECT id, term, uses AS k, n, round(CASE WHEN k * (t - len) < (cf - k) * len THEN -({_G}) ELSE {_G} END, 3) + 0.0 AS llr, round(k * ln((SELECT count(*) FROM recs) / CAST(n AS DOUBLE)), 6) + 0.0 AS score FROM c""",
    "p4_found": f"""{BASE}, keyed AS (SELECT id, list_sort([{_CANON('pt')}, {_CANON('px')}]) AS key FROM plain),
 kept AS (SELECT key, min(id) AS id_kept FROM keyed GROUP BY key HAVING count(*) > 1) SELECT id_kept, id AS id_copy FROM keyed JOIN kept USING (key) WHERE id <> id_kept""",
    "p4_ledger": f"""{BASE}, keyed AS (SELECT id, sha256(array_to_string(list_sort([{_CANON('pt')}, {_CANON('px')}]), chr(10))) AS key FROM plain)
 SELECT key, min(id) AS id_kept, count(*) AS copies FROM keyed GROUP BY key""",
    "p5_found": f"{BASE}, {_FREQ} SELECT term, mark FROM (SELECT term, {_MARK} AS mark FROM freq) WHERE mark IS NOT NULL AND NOT regexp_matches(term, '[\\x{{4e00}}-\\x{{9fff}}]')",
    "p5_frequencies": f"{BASE}, {_FREQ} SELECT term, uses, records, {_MARK} AS mark FROM freq",
    "p6_found": f"""WITH w AS (SELECT doc_id, {_WORDS('text')} AS ws FROM documents), g AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k+9], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 8)) AS k FROM w)),
 v AS (SELECT item_id, {_WORDS('text')} AS ws FROM benchmark), h AS (SELECT DISTINCT item_id, array_to_string(ws[k:k+9], ' ') AS gram FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 8)) AS k FROM v))
 SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (gram)""",
}
