import itertools
import random

import pytest

from polyglean.llm import personal as ps, personal_training as pt


@pytest.fixture(scope="module")
def model():
    return ps.train()


# names and sentences that the training material does not hold
GIVEN = {
    "en": "Deborah Kenneth Brenda Wendy Roger Phyllis Trevor Gwen Malcolm Sheila", "es": "Lourdes Esteban Marisol Rodrigo Paloma Ramiro Consuelo",
    "fr": "Mathilde Bertrand Capucine Thierry Sandrine Yannick", "de": "Gudrun Helmut Brigitte Torsten Ingeborg Volker", "pt": "Rosângela Fábio Lurdes Gilberto Jandira Otávio",
    "hi": "दीपक शालिनी हरीश ममता नवीन रेखा",
}
FAMILY = {
    "en": "Hobart Whitcombe Ferris Atherton Quigley Marsden", "es": "Zubiri Pedraza Montoya Echevarría", "fr": "Delacroix Bonnefoy Lemaire Chastain",
    "de": "Kolber Drechsler Hagedorn Wiesner", "pt": "Siqueira Valadares Brandão Teles", "hi": "खुराना त्रिपाठी चौहान बंसल",
}
HELD_OUT = {
    "en": "The choir was led by {N}.|Questions go to {N}.|Mr. {N} sold his boat.|{N} told the reporter that it rained.|Warm regards,\n{N}|Portrait: {N}|Our neighbor {N} bakes bread.|My sister {N} moved away.|They thanked {N} for the cake.|Guest: {N}",
    "es": "La señora {N} llegó tarde.|Pregunten por {N}.|Un abrazo,\n{N}|Mi hermana {N} vive lejos.|Fotografía de {N}|{N} dijo que sí.|Soy {N}.",
    "fr": "Madame {N} est partie.|Demandez {N} au guichet.|Bien à toi,\n{N}|Mon frère {N} chante.|Photo de {N}|{N} a dit oui.|Je suis {N}.",
    "de": "Frau {N} kam zu spät.|Fragen Sie nach {N}.|Liebe Grüße\n{N}|Mein Bruder {N} singt.|Foto von {N}|{N} sagte ja.|Ich bin {N}.",
    "pt": "A senhora {N} chegou tarde.|Pergunte por {N}.|Um abraço,\n{N}|Minha irmã {N} canta.|Foto de {N}|{N} disse que sim.|Sou {N}.",
    "hi": "श्रीमती {N} देर से आईं।|कृपया {N} को बताइए।|सादर,\n{N}|मेरी बहन {N} गाती है।|फ़ोटो: {N}|{N} ने हाँ कहा।",
}
NOTHING = (
    "The Marsden Bridge was closed.|Hotel Atherton Grand opens in May.|We drove from Hobart to Ferris Lake.|Read The Fine Print First.|Why Quigley lost to Marsden|Dieses Haus und Jener Garten.|"
    "Die Kinder lesen Bücher.|La calle Montoya es larga.|Le pont Chastain est vieux.|O Mercado Teles abre cedo.|Order 24-5889-4744 was late.|ISBN 978-3-16-148410-0|लोग शाम को बाज़ार जाते हैं।|"
    "Invoice 2231/0087 is due.|वह पुराना मकान गिर गया।|IBAN DE44 5001 0517 5407 3249 31"
)


def test_names_and_sentences_held_out(model):
    rng, right, found, wanted = random.Random(9), 0, 0, 0
    for lang, sentences in HELD_OUT.items():
        for s in sentences.split("|"):
            for g in GIVEN[lang].split():
                f = rng.choice(FAMILY[lang].split())
                name = rng.choice((f"{g} {f}",) * 4 + ((f"{g} {f}",) if lang == "hi" else (f"{f}, {g}", f"{g} K. {f}")))
                text = rng.choice(("", *(f"{x} " for x in NOTHING.split("|") if not x[-1].isalnum()))) + s.replace("{N}", name)
                got = [text[a:b] for a, b, k in ps.find(model, text) if k == "pname"]
                right += name in got
                found += len(got)
                wanted += 1
    print("held-out names", right, found, wanted)
    assert right / wanted >= 0.9 and right / found >= 0.9


def test_nothing_personal(model):
    got = {s: [(k, s[a:b]) for a, b, k in ps.find(model, s)] for s in NOTHING.split("|")}
    assert sum(map(bool, got.values())) <= 1, got


def test_training_material_is_not_taken_from_the_tables():
    """No sentence, or part of one of two words and twelve letters or more, stands in the documents; no list of names is there."""
    import re
    from pathlib import Path

    duckdb = pytest.importorskip("duckdb")
    table = Path("/root/testdata/sf0.01/documents.parquet")
    if not table.exists():
        pytest.skip("no test tables")
    text = "\n".join(r[0] for r in duckdb.sql(f"SELECT text FROM '{table}' WHERE text IS NOT NULL").fetchall())
    parts = {p.strip() for t in (pt.NAMES, pt.ADDRESSES, pt.IDENTITIES, pt.PHONES, pt.EMAILS, pt.OTHERS) for ss in t.values() for s in ss.split("|") for p in re.split(r"\{.\}", s)}
    lifted = [p for p in parts if sum(c.isalpha() for c in p) >= 12 and " " in p and p in text]
    assert not lifted, lifted
    assert not any(n in vars(pt) for n in ("GIVEN", "FAMILY", "CARRIERS"))


def test_own_sentences(model):
    right = found = wanted = 0
    for text, spans in pt.sentences(600, 77):
        got = set(ps.find(model, text))
        right += len(got & set(spans))
        found += len(got)
        wanted += len(spans)
    assert right / found > 0.95 and right / wanted > 0.95


@pytest.mark.parametrize(
    "text,pieces",
    [
        ("Write to ann.lee (at) foo (dot) example today.", [("email", "ann.lee (at) foo (dot) example")]),
        ("The shop (020 7946 0419) closes at 7.", [("phone", "020 7946 0419")]),
        ("Tel: +1 (299) 555-0150", [("phone", "+1 (299) 555-0150")]),
        ("Order no. 24-5889-4744 was late.", []),
        ("We have lived at No. 12, Vobaro Court since spring.", [("addr", "No. 12, Vobaro Court")]),
        ("Vobaro Street was closed for 50 days.", []),
        ("Photo: Zolabin, Nora", [("pname", "Zolabin, Nora")]),
        ("Meet us @market or at 5 @ 51 coins each.", []),
        ("Photo: No​ra Zo\xadlabin", [("pname", "No​ra Zo\xadlabin")]),
        ("", []),
        (None, []),
        ("Frau Brigitte Kolber kam.", [("pname", "Brigitte Kolber")]),
        ("Ask Dr. Walter Hobart first.", [("pname", "Walter Hobart")]),
        ("SSN 123-45-6789", [("idno", "123-45-6789")]),
        ("Contact Deborah Vobaro about the garden.", [("pname", "Deborah Vobaro")]),
        ("IBAN DE44 5001 0517 5407 3249 31", []),
    ],
)
def test_pieces(model, text, pieces):
    assert [(k, text[a:b]) for a, b, k in ps.find(model, text)] == pieces


def test_best_and_marginals_against_all_sets():
    rng = random.Random(2)
    for _ in range(30):
        cands = []
        for n in range(7):
            a = rng.randrange(10)
            cands.append((a, a + rng.randint(1, 4), "phone", [f"f{n}"]))
        m = ps.SemiCRF()
        m.w["phone"] = {f"f{n}": rng.uniform(-2, 2) for n in range(7)}
        sets = []
        for r in range(8):
            for s in itertools.combinations(range(7), r):
                iv = sorted((cands[n][0], cands[n][1]) for n in s)
                if all(x[1] <= y[0] for x, y in zip(iv, iv[1:])):
                    sets.append((sum(m.w["phone"][f"f{n}"] for n in s), s))
        import math

        z = sum(math.exp(v) for v, _ in sets)
        for n, p in enumerate(m.marginals(cands)):
            assert p == pytest.approx(sum(math.exp(v) for v, s in sets if n in s) / z)
        best = sum(m.w["phone"][c[3][0]] for c in m.best(cands))
        assert best == pytest.approx(max(v for v, _ in sets))


def test_tables(spark):
    rows = [(1, "Tel: 07700 900431 and x@foo.example, x@foo.example"), (2, None), (3, "")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, kind string")
    got = {tuple(r) for r in ps.distinct_pieces(ps.personal(d)).collect()}
    assert got == {(1, "phone", "07700 900431"), (1, "email", "x@foo.example")}
    red = {r["doc_id"]: (r["text"], r["pieces"]) for r in ps.redact(d).collect()}
    assert red == {1: ("Tel: [PHONE] and [EMAIL], [EMAIL]", 3), 2: (None, 0), 3: ("", 0)}
    assert ps.personal(d.limit(0)).count() == 0


def test_long_text(model):
    text = "They walked to Vobaro with a cat. " * 20000 + "Tel: 07700 900431"
    assert [k for *_, k in ps.find(model, text)] == ["phone"]


def test_long_runs(model):
    """Runs longer than any piece are searched by their parts."""
    text = "Photo: Nora Zolabin. " + "Vobaro " * 300 + "12 " * 500 + "Tel. 07700 900431"
    assert [(k, text[a:b]) for a, b, k in ps.find(model, text) if k == "phone"][-1:] == [("phone", "07700 900431")]
