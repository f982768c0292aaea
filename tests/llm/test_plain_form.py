import datetime as dt
import unicodedata as U

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from polyglean.llm.oracle import _MEANT
from polyglean.llm.plain_form import LOOK_ALIKES, _compat, look_alike_pairs, plain_form
from polyglean.llm.tables import SURROGATE, records

SCHEMA = "id bigint, title string, text string"


def brute(s):
    """The plain form, character by character."""
    if s is None:
        return None
    out = ""
    for ch in s:
        cat = U.category(ch)
        if cat != "Cf":
            out += " " if cat == "Zs" else U.normalize("NFD", _compat(ch))
    out = U.normalize("NFD", out)
    res, i = [], 0
    while i < len(out):
        j = i
        while j < len(out) and U.category(out[j])[0] in "LM":
            j += 1
        if j == i:
            res.append(out[i])
            i += 1
            continue
        run = out[i:j]
        if all(U.category(c)[0] == "M" or "LATIN" in U.name(c, "") or c in LOOK_ALIKES for c in run):
            run = "".join(LOOK_ALIKES.get(c, c) for c in run)
        res.append(run)
        i = j
    return U.normalize("NFC", "".join(res))


CASES = [
    ("été", "été"), ("Ｈａｓ，１", "Has,1"), ("ho\xadne⁠st", "honest"), ("a 　b ", "a  b "),
    ("Pеrsоnne", "Personne"), ("борщ сос", "борщ coc"), ("θάλασσα", "θάλασσα"), ("ﬁn ﻻ ⼈", "fin لا 人"), ("m² … «»", "m² … «»"),
    ("ज़", "ज़"), ("q̣̇ q̣̇", "q̣̇ q̣̇"), ("ো", "ো"), ("가각", "가각"),
    ("", ""), (None, None), ("﻿", ""), ("a\tb\n\r\nc", "a\tb\n\r\nc"), ("с​ос", "coc"), ("😀́é", "😀́é"),
    ("a" + "́" * 400, "á" + "́" * 399), ("é" * 5000 + "é" * 3000, "é" * 8000),
]


def run(spark, texts):
    rows = [(n, t, "x") for n, t in enumerate(texts)]
    out = plain_form(spark.createDataFrame(rows, "id bigint, title string, other string"), "id", "title").collect()
    assert len(out) == len(texts) and all(r["other"] == "x" and r["title"] == texts[r["id"]] for r in out)
    return [r["plain_title"] for r in sorted(out, key=lambda r: r["id"])]


def test_cases(spark):
    got = run(spark, [a for a, _ in CASES])
    assert got == [b for _, b in CASES]
    assert got == [brute(a) for a, _ in CASES]


def test_against_brute_force(spark):
    pieces = "aeо сА̧́‍ ﬁ가ᅡज़़νো .１Ω漢ⅣЩͅ\U0001d16e"
    texts = []

    @settings(max_examples=400, deadline=None, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.text(alphabet=st.one_of(st.sampled_from(pieces), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=12))
    def draw(s):
        texts.append(s)

    draw()
    assert run(spark, texts) == [brute(t) for t in texts]


def test_every_character(spark):
    """Each assigned character comes out as the brute force says, alone and after a letter."""
    texts = []
    for start in range(0, 0x20000, 64):
        chars = [chr(c) for c in range(start, start + 64) if U.category(chr(c)) not in ("Cs", "Cn", "Co")]
        if chars:
            texts.append(" a".join(chars))
    assert run(spark, texts) == [brute(t) for t in texts]


def test_pairs(spark):
    rows = [(1, "é", "x"), (2, "é", "x"), (3, "é", "x"), (4, None, "x"), (5, "", "x"), (6, "é ", "x"), (7, "é", "y")]
    got = {tuple(r) for r in look_alike_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 2), (2, 3)}
    assert look_alike_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_records(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2)]
    rows = [("7", "a", "old", t[0], 1), ("7", "a", "new", t[1], 1), ("x", None, None, t[0], 2), ("y", None, None, t[0], 2), (None, "q", "q", t[0], None), (None, "q", "q", t[1], None), (None, "r", "q", None, None)]
    got = records(spark.createDataFrame(rows, "id string, title string, text string, loaded_at timestamp, batch_id bigint")).collect()
    assert sorted((r["id"] if r["id"] > 0 else None, r["title"] or "", r["text"] or "") for r in got if r["id"] > 0) == [(7, "a", "new")]
    odd = [r for r in got if r["id"] <= SURROGATE]
    assert sorted((r["title"] or "", r["text"] or "") for r in odd) == [("", ""), ("", ""), ("q", "q"), ("r", "q")]
    assert len({r["id"] for r in got}) == 5


def test_look_alikes_stated_twice():
    assert {x: a for a, xs in _MEANT.items() for x in xs} == LOOK_ALIKES


def test_standard_look_alikes(spark):
    """Letters that Unicode lists as confusable, in words that read as Latin; foreign words with other letters stay."""
    cases = [("τοραz", "topaz"), ("кіngz", "kingz"), ("ցаrdеn", "garden"), ("vιrυs", "virus"), ("γеаr", "year"), ("bооκ", "book"), ("ехιt", "exit"), ("ᎡᎬꓮⅮ", "READ"),
             ("хлеб", "хлеб"), ("φίλος", "φίλος"), ("дружба", "дружба"), ("ǆ", "dž")]
    assert run(spark, [a for a, _ in cases]) == [b for _, b in cases]
