import pytest
from pyspark.sql import functions as F

from polyglean.functions import distance as dist, text as tx

TOKENS = [
    ("L'éléphant boit de l'eau.", ["éléphant", "boit", "de", "eau"]),
    ("हाथी जंगल में है।", ["हाथी", "जंगल", "में", "है"]),
    ("«bonjour», ¿qué?", ["bonjour", "qué"]),
    ("don't it's o'clock", ["don't", "it's", "o'clock"]),
    ("Hello, World!", ["hello", "world"]),
    ("a\x1cb\x85c d　e", ["a", "b", "c", "d", "e"]),
    ("_under_ #tag $5 +x+ a--b <b>", ["under", "tag", "$5", "+x+", "a--b", "b"]),
    ("", []),
    (None, []),
    ("... !!! |", []),
]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,tokens", TOKENS)
def test_tokenize(spark, text, tokens):
    assert one(spark, text, tx.tokenize) == tokens


def test_scripts(spark):
    assert one(spark, "é 123", tx.scripts) == ["General Script"]
    assert one(spark, "abc हाथी 水", tx.scripts) == ["Devanagari", "Hanzi (CJK)", "Latin"]


def test_snippet_and_distance(spark):
    assert one(spark, "x" * 191, tx.snippet) == "x" * 190 + "..."
    assert one(spark, "x" * 190, tx.snippet) == "x" * 190
    assert [one(spark, w, tx.allowed_distance) for w in ("abc", "abcd", "abcde", "abcdef")] == [0, 1, 1, 2]


def test_html_and_links(spark):
    assert one(spark, "a <b>x</b>&amp;lt; <!-- c\n--> y", tx.clean_html) == "a x&lt; y"
    assert one(spark, None, tx.clean_html) == ""
    assert one(spark, " [[فِيل]] ", tx.normalize_link) == "فيل"


def test_highlight(spark):
    p = tx.highlight_pattern(["art", "Art deco", "水", ""])
    assert one(spark, "Start ART deco, art; 清水x", lambda c: tx.highlight(c, p)) == "Start <mark>ART deco</mark>, <mark>art</mark>; 清<mark>水</mark>x"
    assert tx.highlight_pattern([" "]) is None


def test_title_variants_and_worth(spark):
    assert one(spark, "apfel", tx.title_variants) == ["apfel", "Apfel"]
    assert one(spark, "हाथी", tx.title_variants) == ["हाथी"]
    words = "the 2024 elephant and a kitten http://x.y co2 xq हा 水".split()
    kept = [w for w in words if one(spark, w, lambda c: tx.worth_linking(c, ["the", "and"]))]
    assert kept == ["elephant", "kitten", "हा", "水"] or kept == ["elephant", "kitten", "हा"]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_matrix_and_path(spark):
    pairs = [("kitten", "sitting"), ("", "ab"), ("ab", ""), ("", ""), ("été", "ete"), ("paris", "paris")]
    df = spark.createDataFrame(pairs, "word1 string, word2 string")
    for r in df.select("word1", "word2", dist.matrix(F.col("word1"), F.col("word2")).alias("m")).collect():
        assert r["m"][-1][-1] == levenshtein(r["word1"], r["word2"])
        assert len(r["m"]) == len(r["word1"]) + 1
    rows = dist.edit_paths(df).collect()
    steps = [r["op"] for r in sorted(rows, key=lambda r: r["step"]) if r["word1"] == "kitten"]
    assert steps == ["substitute", "match", "match", "match", "substitute", "match", "insert"]
    assert not [r for r in rows if r["word1"] == r["word2"] == ""]


def test_all_entities(spark):
    import html
    from html.entities import html5

    texts = [f"a&{n}b" for n in html5] + [f"&#{n};x" for n in (*range(0, 300), 0xD800, 0xFFFF, 0x1F600, 0x110000, 10**12)]
    texts += ["&eacute;t&#xE9; &#X1F600 &notit; &copy2020 &amp;lt; R&D & &; &unknown; &# &#x; &ampamp; &#00065;", "no mark", "&#x" + "F" * 30 + ";"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.unescape(F.col("t")).alias("u"))
    assert [(r["t"], r["u"]) for r in df.collect() if r["u"] != html.unescape(r["t"])] == []
    assert one(spark, "caf&eacute;&#160;cr&#x27;me", tx.clean_html) == "café cr'me"
    assert one(spark, "Caf&eacute;", tx.normalize_link) == "café"
