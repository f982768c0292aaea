"""Problem 1: one plain form for text that looks alike but is stored with different characters.

Texts are split at blanks; only pieces that hold a character the plain form may change are exploded to positioned
code points, what stands between them stays whole. These are joined with a broadcast mapping table (its size is bounded by Unicode), which gives each code
point its decomposition, the class of each combining mark, the Latin letter it may be mistaken for, and the letters it
composes with. Marks are ordered by class inside their cluster, runs of letters that read wholly as Latin once
look-alikes are resolved take the Latin letters, clusters are composed again and the strings rebuilt.

Everything after the grouping by record keeps its partitioning: one shuffle of the texts in all.

NULL texts stay NULL, empty ones stay empty, texts of any length are handled whole (a text is cut into blocks of whole
clusters while it is composed, so the work is linear in its length).
"""

from __future__ import annotations

import unicodedata as U
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from polyglean.runtime import materialize

# Letters that look like a Latin letter and that letter, from Unicode's list of confusable characters (UTS 39).
# Letters that only resemble a small capital or another shape (Cyrillic в м н т, Greek σ ω) are no look-alikes.
LOOK_ALIKES = dict(zip(
    # Cyrillic
    "асԁеһіјӏоркԛѕуѵԝхүгьҽԍ" "АВСЕԌНІЈКМОРԚЅТѴԜХҮУӀЬ"
    # Greek
    "αγικνορτυχϲϳ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϜ"
    # Armenian
    "օսհոցզյ" "ՕՍՏ"
    # Coptic
    "ⲟⲣⲥⲭ" "ⲞⲢⲤⲬⲎⲒⲔⲘⲚⲦ"
    # Cherokee
    "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴᏃ"
    # Lisu
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
    # Latin variants and small capitals of the same shape
    "ɡɑıɩɪȷʋʏᴄᴏᴜᴠᴡᴢꜱ",
    "acdehijlopkqsyvwxyrbeg" "ABCEGHIJKMOPQSTVWXYYIb"
    "ayikvoptuxcj" "ABEZHIKMNOPTYXCJF"
    "ouhngqj" "OUS"
    "opcx" "OPCXHIKMNT"
    "DRTAJEWMHYGRWSVSLCPKBZ"
    "BPDTGKJCZFMNLSRVHWXYAEIOU"
    "gaiiijuycouvwzs",
    strict=True,
))

#: Ranges of a character class that are looked at one after the other.
FAN = 6
#: Clusters that are composed together; bounds the strings built in one step.
BLOCK = 64

MAPPING_SCHEMA = T.StructType([
    T.StructField("u", T.StringType()),
    T.StructField("parts", T.ArrayType(T.StructType([
        T.StructField("ch", T.StringType()),
        T.StructField("ccc", T.IntegerType()),
        T.StructField("second", T.IntegerType()),
        T.StructField("look", T.StringType()),
    ]))),
])


def _compat(ch: str) -> str:
    """Letters, digits, punctuation and blanks that ``ch`` is another width or presentation of; else ``ch``."""
    d = U.decomposition(ch)
    if not d.startswith("<"):
        return ch
    tag, cp = d[1 : d.index(">")], ord(ch)
    form = tag in ("wide", "narrow", "initial", "medial", "final", "isolated")
    letters = 0xFB00 <= cp <= 0xFB4F or 0x2E80 <= cp <= 0x2FD5 or 0x2160 <= cp <= 0x217F or 0x1C4 <= cp <= 0x1F3
    if form or letters or tag == "compat" and ("LIGATURE" in U.name(ch, "") or "DIGRAPH" in U.name(ch, "")):
        wide = U.normalize("NFKD", ch)
        return ch if " " in wide and cp != 0x3000 else wide
    return ch


@cache
def compositions() -> dict[str, dict[str, str]]:
    """second character -> first character -> composed character (NFC; conjoining jamo by rule)."""
    out: dict[str, dict[str, str]] = {}
    for cp in range(0x110000):
        ch = chr(cp)
        d = U.decomposition(ch)
        if d and d[0] != "<" and " " in d and U.normalize("NFC", ch) == ch:
            a, b = (chr(int(x, 16)) for x in d.split())
            out.setdefault(b, {})[a] = ch
    for v in range(21):
        out[chr(0x1161 + v)] = {chr(0x1100 + c): chr(0xAC00 + (c * 21 + v) * 28) for c in range(19)}
    for t in range(1, 28):
        out[chr(0x11A7 + t)] = {chr(0xAC00 + lv * 28): chr(0xAC00 + lv * 28 + t) for lv in range(399)}
    return out


@cache
def mapping() -> tuple[list, str]:
    """Rows of the mapping table, and a Java pattern that finds every piece the plain form may change."""
    comp = compositions()
    place = {b: n for n, b in enumerate(comp)}
    part = lambda c: (c, U.combining(c), place.get(c), LOOK_ALIKES.get(c))
    rows, changed, nonstarters = [], [], []
    for cp in range(0x110000):
        ch = chr(cp)
        cat = U.category(ch)
        if cat in ("Cn", "Co", "Cs") or 0xAC00 <= cp <= 0xD7A3:  # composed Hangul is plain as it is
            continue
        if cat == "Cf":
            plain = ""
        elif cat == "Zs":
            plain = " "
        else:
            plain = U.normalize("NFD", _compat(ch))
        parts = [part(c) for c in plain]
        if parts != [(ch, 0, None, None)]:
            rows.append((ch, parts))
            if U.normalize("NFC", plain) != ch or ch in LOOK_ALIKES or any(c in LOOK_ALIKES for c in plain):
                changed.append(cp)
        if U.combining(ch):
            nonstarters.append(cp)
    changed += [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]  # conjoining jamo: no list of bases needed
    comp = {b: firsts for b, firsts in comp.items() if not 0x1161 <= ord(b) <= 0x11C2}
    pairs = "|".join(f"(?<=[{_ranges(map(ord, firsts))}]{_x(ord(b))})" for b, firsts in sorted(comp.items()) if b <= "\uffff")
    # one class finds the few characters that matter; what decides is looked up behind it. Look-behind sees UTF-16
    # units: a character beyond the first plane ends in a low surrogate and is always looked at
    special = _ranges({*changed, *map(ord, comp), *nonstarters})
    seconds, marks = _ranges(map(ord, comp)), _ranges(nonstarters)
    behind = f"(?<=[\\x{{dc00}}-\\x{{dfff}}{_ranges(c for c in changed if c <= 0xFFFF)}])|(?<=[{marks}][{marks}])|(?<=[{seconds}])(?:{pairs})"
    return rows, f"[\\x{{80}}-\\x{{10ffff}}&&[{special}]](?:{behind})"


def _x(cp: int) -> str:
    return f"\\x{{{cp:x}}}"


def _ranges(cps) -> str:
    out: list[list[int]] = []
    for cp in sorted(cps):
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    # a tree: the ranges of a group are looked at only for characters between its ends
    nodes = [(a, b, _x(a) + (f"-{_x(b)}" if b > a else "")) for a, b in out]
    while len(nodes) > FAN:
        groups = [nodes[k : k + FAN] for k in range(0, len(nodes), FAN)]
        nodes = [(g[0][0], g[-1][1], f"[{_x(g[0][0])}-{_x(g[-1][1])}&&[{''.join(x for _, _, x in g)}]]") for g in groups]
    return "".join(x for _, _, x in nodes)


def mapping_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(mapping()[0], MAPPING_SCHEMA)


def touched(text: Column) -> Column:
    """True if the plain form may differ from ``text`` (never false for a text that it changes)."""
    return F.coalesce(~text.rlike(r"\A[\x00-\x7f]*\z") & text.rlike(mapping()[1]), F.lit(False))


def _hits(pieces: Column) -> Column:
    """Places of the blank-separated pieces that the plain form may change."""
    return F.filter(F.transform(pieces, lambda w, i: F.when(touched(w), i)), lambda i: i.isNotNull())


def _units(field: int, text: Column, pieces: Column, hits: Column, row: T.StructType) -> Column:
    """A text as ordered units: single code points of the pieces that may change, and what stands between such pieces.

    What stands between holds a blank, or is empty, so no run of letters goes across. An empty last unit carries the
    text through if all else is dropped. Units have a place for the record's other columns, which stays NULL here.
    """
    nothing = F.lit(None).cast(row)
    unit = lambda i, j, u: F.struct(F.lit(field).alias("f"), i.alias("i"), j.alias("j"), u.alias("u"), nothing.alias("row"))
    empty = F.array().cast(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in "fij"] + [T.StructField("u", T.StringType()), T.StructField("row", row)])))
    blank, none = F.array(F.lit("")), F.array().cast("array<string>")

    def piece(t: Column, n: Column) -> Column:
        before = F.when(n > 0, F.element_at(hits, n) + 1).otherwise(0)
        gap = F.concat(F.when(n > 0, blank).otherwise(none), F.slice(pieces, before + 1, t - before), blank)
        points = F.transform(F.regexp_extract_all(F.element_at(pieces, t + 1), F.lit("(?s)."), F.lit(0)), lambda c, j: unit(t, j, c))
        return F.concat(F.array(unit(t, F.lit(-1), F.array_join(gap, " "))), points)

    last = F.element_at(hits, -1)
    tail = F.when(last + 1 < F.size(pieces), F.array_join(F.concat(blank, F.slice(pieces, last + 2, F.size(pieces))), " ")).otherwise("")
    end = F.array(unit(F.lit(2**31 - 1), F.lit(0), F.when(F.size(hits) > 0, tail).otherwise(text)))
    return F.when(text.isNull(), empty).otherwise(F.concat(F.flatten(F.transform(hits, piece)), end))


def _compose(items: Column) -> Column:
    """Canonical composition of ordered items (ch, ccc, second), as one string.

    ``second`` is the place of a second character in two constant lists: what it composes with, and what that gives.
    """
    firsts = F.array(*[F.lit("".join(x)) for x in compositions().values()])
    results = F.array(*[F.lit("".join(x.values())) for x in compositions().values()])
    zero = F.struct(F.lit("").alias("out"), F.lit("").alias("st"), F.lit("").alias("tail"), F.lit(0).alias("last"))

    def step(s: Column, x: Column) -> Column:
        near = (s["tail"] == "") | ((s["last"] < x["ccc"]) & (x["ccc"] > 0))
        at = F.nullif(F.position(s["st"], firsts[x["second"]]), F.lit(0))
        c = F.when(x["second"].isNotNull() & (s["st"] != "") & near, F.substring(results[x["second"]], at, F.lit(1)))
        new = lambda out, st, tail, last: F.struct(
            out.alias("out"), st.alias("st"), tail.alias("tail"), last.alias("last")
        )
        return (
            F.when(c.isNotNull(), new(s["out"], c, s["tail"], s["last"]))
            .when(x["ccc"] == 0, new(F.concat(s["out"], s["st"], s["tail"]), x["ch"], F.lit(""), F.lit(0)))
            .otherwise(new(s["out"], s["st"], F.concat(s["tail"], x["ch"]), x["ccc"]))
        )

    return F.aggregate(items, zero, step, lambda s: F.concat(s["out"], s["st"], s["tail"]))


def plain_form(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """``df`` (one row per ``key``) with a column ``plain_<col>`` for each of ``cols``.

    Rows with the same key, or with a NULL key, must be made unique before; ``records`` does. Other columns pass
    through. Columns named like the work columns here do not clash, as only ``key`` and ``cols`` enter the work.
    """
    spark = df.sparkSession
    any_touched = F.lit(False)
    for c in cols:
        any_touched = any_touched | touched(F.col(c))
    rest = df.where(~any_touched).select("*", *[F.col(c).alias(f"plain_{c}") for c in cols])
    some = df.where(any_touched)

    others = [c for c in df.columns if c != key]
    kind = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(others)])
    # the other columns travel once per record, on a unit of their own: they are never copied along with the others
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).cast(kind)
    carrier = F.array(F.struct(F.lit(-1).alias("f"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit("").alias("u"), row.alias("row")))
    m = F.broadcast(mapping_table(spark))
    split = some.select(F.col(key).alias("k"), carrier.alias("carrier"), *[F.col(c).alias(f"t{n}") for n, c in enumerate(cols)], *[F.split(c, " ", -1).alias(f"p{n}") for n, c in enumerate(cols)])
    marked = split.select("*", *[_hits(F.col(f"p{n}")).alias(f"h{n}") for n, _ in enumerate(cols)])
    units = F.concat("carrier", *[_units(n, F.col(f"t{n}"), F.col(f"p{n}"), F.col(f"h{n}"), kind) for n, _ in enumerate(cols)])
    points = marked.select("k", F.explode(units).alias("x")).select("k", "x.*").join(m, "u", "left")
    own = F.array(F.struct(F.col("u").alias("ch"), F.lit(0).alias("ccc"), F.lit(None).cast("int").alias("second"), F.lit(None).cast("string").alias("look")))
    points = points.select("k", "row", "f", "i", "j", F.posexplode(F.coalesce("parts", own)).alias("sub", "p")).select(
        "k", "row", "f", "i", "j", "sub", "p.*"
    )
    one = F.length("ch") == 1
    kind = (
        F.when(F.col("look").isNotNull(), "look")
        .when(one & F.col("ch").rlike(r"\p{M}"), "mark")
        .when(one & F.col("ch").rlike(r"(?=\p{L})\p{IsLatin}"), "latin")
        .when(one & F.col("ch").rlike(r"\p{L}"), "letter")
        .otherwise("other")
    )
    order = W.partitionBy("k", "f").orderBy("i", "j", "sub").rowsBetween(W.unboundedPreceding, 0)
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(order)
    points = points.withColumn("kind", kind).select(
        "*",
        count(F.col("kind") == "other").alias("run"),
        count(F.col("ccc") == 0).alias("starter"),
        count((F.col("ccc") == 0) & F.col("second").isNull()).alias("cluster"),
    )
    run = W.partitionBy("k", "f", "run")
    foreign = F.max(F.when(F.col("kind") == "letter", 1).otherwise(0)).over(run)
    ch = F.when((F.col("kind") == "look") & (foreign == 0), F.col("look")).otherwise(F.col("ch"))
    item = F.struct("starter", "ccc", "i", "j", "sub", ch.alias("ch"), "second")
    ready = points.select("k", "row", "f", F.floor(F.col("cluster") / BLOCK).alias("block"), item.alias("item"))
    blocks = ready.groupBy("k", "f", "block").agg(
        F.first("row", ignorenulls=True).alias("row"), _compose(F.array_sort(F.collect_list("item"))).alias("s")
    )
    texts = F.collect_list(F.when(F.col("f") >= 0, F.struct("f", "block", "s")))
    done = blocks.groupBy("k").agg(F.first("row", ignorenulls=True).alias("row"), F.array_sort(texts).alias("t"))
    whole = lambda f: F.array_join(
        F.transform(F.filter("t", lambda x: x["f"] == f), lambda x: x["s"]), ""
    )
    done = done.select(
        F.col("k").alias(key),
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)],
        *[F.when(F.col(f"row.c{others.index(c)}").isNotNull(), whole(f)).alias(f"plain_{c}") for f, c in enumerate(cols)],
    )
    return rest.unionByName(done)


def look_alike_pairs(records: DataFrame) -> DataFrame:
    """(id_a, id_b): records of equal plain title and text whose stored title or text differ; NULL counts as empty.

    Records are grouped by stored form first (counted map-side). Only different forms of one class are paired, each
    pair of forms once, and then replaced by their records: every row made is a row of the result, so a class of exact
    copies of any size costs nothing. The form with fewer records is expanded first; the join with the larger one is
    on the form, whose skewed partitions the adaptive join splits. Rows of a NULL id must be made unique before, as
    ``records`` does.
    """
    e = lambda c: F.coalesce(c, F.lit(""))
    forms = plain_form(records, "id", "title", "text").select(
        "id",
        F.sha2(F.to_json(F.struct(e("plain_title").alias("a"), e("plain_text").alias("b"))), 256).alias("class"),
        F.sha2(F.to_json(F.struct(e("title").alias("a"), e("text").alias("b"))), 256).alias("form"),
    )
    forms = materialize(forms, "forms")
    counts = forms.groupBy("class", "form").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("class").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1").select("class")
    own = counts.join(several, "class", "left_semi")
    few = own.select("class", F.col("form").alias("form_1"), F.struct("n", "form").alias("o_1"))
    many = own.select("class", F.col("form").alias("form_2"), F.struct("n", "form").alias("o_2"))
    pairs = few.join(many, "class").where("o_1 < o_2").select("form_1", "form_2")
    one = pairs.join(forms.select(F.col("form").alias("form_1"), F.col("id").alias("id_1")), "form_1")
    both = one.join(forms.select(F.col("form").alias("form_2"), F.col("id").alias("id_2")), "form_2")
    return both.select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))
