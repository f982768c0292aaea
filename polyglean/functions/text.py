"""Scalar text functions as native column expressions (no Python in the hot path)."""

from __future__ import annotations

from html import _invalid_charrefs, _invalid_codepoints
from html.entities import html5

from pyspark.sql import Column, functions as F

# White space, edge punctuation and elided articles of the tokenizer.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
EDGE = r"^[\p{P}<>|]+|[\p{P}<>|]+$"
ELIDED = (
    "l d j m t s n c qu jusqu lorsqu puisqu quoiqu dell all nell sull dall quell quest un anch nient tutt"
).split()
ELISION = "^(?:" + "|".join(ELIDED) + r")['’](?=[\p{L}\p{N}_])"
CJK = r"[\u4e00-\u9fff]"

# Code-point ranges that name a script; Latin is by ASCII letters only.
SCRIPTS = {
    "Latin": "a-zA-Z",
    "Devanagari": "\\u0900-\\u097F",
    "Bengali-Assamese": "\\u0980-\\u09FF",
    "Gurmukhi": "\\u0A00-\\u0A7F",
    "Gujarati": "\\u0A80-\\u0AFF",
    "Odia": "\\u0B00-\\u0B7F",
    "Tamil": "\\u0B80-\\u0BFF",
    "Telugu": "\\u0C00-\\u0C7F",
    "Kannada": "\\u0C80-\\u0CFF",
    "Malayalam": "\\u0D00-\\u0D7F",
    "Arabic-Urdu": "\\u0600-\\u06FF",
    "Hanzi (CJK)": "\\u4E00-\\u9FFF",
}
NO_SCRIPT = "General Script"


def tokenize(text: Column) -> Column:
    """Lower case, split at white space, strip edge punctuation, drop one elided clitic, drop empties. NULL -> []."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE)
    bare = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, EDGE, ""), ELISION, ""))
    return F.filter(bare, lambda w: w != "")


def strip_edges(word: Column) -> Column:
    return F.regexp_replace(word, EDGE, "")


def strip_elision(word: Column) -> Column:
    return F.regexp_replace(word, ELISION, "")


def full_content(title: Column, text: Column) -> Column:
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def scripts(text: Column) -> Column:
    """Sorted script names present in the text, or the general name if none."""
    named = F.array(*[F.when(text.rlike(f"[{r}]"), F.lit(n)) for n, r in SCRIPTS.items()])
    found = F.array_sort(F.filter(named, lambda x: x.isNotNull()))
    return F.when(F.size(found) == 0, F.array(F.lit(NO_SCRIPT))).otherwise(found)


def allowed_distance(word: Column) -> Column:
    n = F.length(F.trim(word))
    return F.when(n <= 3, 0).when(n <= 5, 1).otherwise(2)


def snippet(text: Column, length: int = 190) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def is_cjk(text: Column) -> Column:
    return text.rlike(CJK)


# Named HTML entities, those that need no semicolon (longest first), and numbers that stand for others.
_LEGACY = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
_ENTITY = r"(&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&)"


def _table(pairs: dict) -> Column:
    """A constant map; one literal after folding."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in pairs.items())), F.lit("\x02"), F.lit("\x01"))


def unescape(text: Column) -> Column:
    """Resolve all HTML entities, named and numeric, once and by the rules of HTML 5."""

    def number(p: Column) -> Column:
        hexed = F.regexp_extract(p, "^&#[xX]0*([0-9a-fA-F]*)", 1)
        digits = F.regexp_extract(p, "^&#0*([0-9]*)", 1)
        n = F.when(p.rlike("^&#[xX]"), F.when(F.length(hexed) <= 6, F.conv(F.concat(F.lit("0"), hexed), 16, 10)))
        n = n.otherwise(F.when(F.length(digits) <= 7, F.concat(F.lit("0"), digits))).cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        none = n.isin(sorted(_invalid_codepoints))
        bad = n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        return F.coalesce(F.element_at(_table(_invalid_charrefs), n.cast("string")), F.when(bad, F.lit("\ufffd")).when(none, "").otherwise(char))

    def name(p: Column) -> Column:
        names = _table({f"&{k}": v for k, v in html5.items()})
        start = F.regexp_extract(p, f"^&(?:{_LEGACY})", 0)
        short = F.concat(F.element_at(names, start), F.substr(p, F.length(start) + 1))
        return F.coalesce(F.element_at(names, p), short, p)

    one = lambda p: F.when(p.rlike("^&#[0-9xX]"), number(p)).when(p.startswith("&"), name(p)).otherwise(p)
    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1)), one), "")
    return F.when(text.contains("&"), whole).otherwise(text)


def clean_html(raw: Column) -> Column:
    """Drop comments and tags, resolve entities, collapse white space. NULL -> ''."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"<[^>]+>", "")
    bare = unescape(bare)
    return F.trim(F.regexp_replace(bare, WHITE, " "))


def normalize_link(raw: Column) -> Column:
    """Strip tags and link brackets, resolve entities, lower case, drop Arabic vowel marks and tatweel."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"<[^>]+>|\[\[|\]\]", "")
    bare = unescape(bare)
    return F.regexp_replace(F.lower(F.trim(bare)), r"[\u0640\u064b-\u065f\u0670]", "")


def title_variants(word: Column) -> Column:
    """The word, then the word with its first character in upper case if that differs."""
    return F.array_distinct(
        F.array(word, F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30)))
    )


def worth_linking(term: Column, function_words: list[str]) -> Column:
    """Letters, marks, format characters, hyphen and apostrophes only; long enough; no function word."""
    latin = ~term.rlike(r"[^\u0000-\u024f]")
    return (
        ~term.isin(function_words)
        & term.rlike(r"^[\p{L}\p{M}\p{Cf}\-'’]+$")
        & F.when(latin, F.length(term) >= 3).otherwise((F.length(term) >= 2) | is_cjk(term))
    )


def highlight_pattern(terms: list[str]) -> str | None:
    """Java regex for the distinct terms, longest first; Chinese terms match anywhere, others between non-word characters."""
    import re

    bare = sorted({t.strip() for t in terms if t and t.strip()}, key=lambda t: (-len(t), t))
    if not bare:
        return None
    quote = lambda t: r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E"
    word = r"[\p{L}\p{N}_\u0300-\u036f\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\u0900-\u0d7f]"
    parts = [quote(t) if re.search("[\u4e00-\u9fff]", t) else f"(?<!{word}){quote(t)}(?!{word})" for t in bare]
    return "(?iu)(" + "|".join(parts) + ")"


def highlight(text: Column, pattern: str | None) -> Column:
    return text if pattern is None else F.regexp_replace(text, pattern, "<mark>$1</mark>")
