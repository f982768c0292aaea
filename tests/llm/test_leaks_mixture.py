import random

import pytest

from polyglean.llm import leaks as lk, mixture as mx


def brute_pairs(docs, items, clean, run=10):
    grams = {}
    for i, t in items:
        w = clean(t)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = clean(t)
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ())}
    return out


def test_block_max_wand_is_exhaustive():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(60)]
    items = [(n, [rng.choice(vocab) for _ in range(rng.randint(5, 40))]) for n in range(200)]
    ix = lk.Index(items)
    number = {i: n for n, i in enumerate(ix.ids)}
    for _ in range(200):
        q = list(dict.fromkeys(rng.choice(vocab) for _ in range(rng.randint(1, 40))))
        expect = {}
        for t in q:
            if t in ix.lists:
                for n, x in zip(*ix.lists[t][:2]):
                    expect[n] = expect.get(n, 0.0) + x
        want = {n: s for n, s in expect.items() if s >= ix.least[n]}
        got = dict(ix.search(q))
        assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-9 for n in got)
    assert number


def test_leaks(spark):
    rng = random.Random(5)
    vocab = [f"word{k}" for k in range(80)]
    items = [(n, " ".join(rng.choice(vocab) for _ in range(rng.choice((6, 15, 30))))) for n in range(40)]
    items += [(98, items[3][1]), (99, None)]
    docs = [(1, None), (2, ""), (3, "word1 word2")]
    for d in range(4, 60):
        i, t = rng.choice(items[:40])
        w = t.split()
        k, m = rng.randrange(len(w)), rng.choice((8, 9, 10, 11, 30))
        piece = " ".join(x.upper() + rng.choice((",", "", " * >")) for x in w[k : k + m])
        docs.append((d, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 300))) + " " + piece.replace("WORD", "WO​RD") + " tail"))
    schema = "doc_id bigint, text string"
    got = {(r["doc_id"], r["item_id"]) for r in lk.leaks(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    import regex

    clean = lambda t: [w for w in regex.sub(r"[\p{P}\p{Cf}>]+", "", (t or "").lower()).split() if w]
    assert got == brute_pairs(docs, items, clean) and got
    assert lk.leaks(spark.createDataFrame([], schema), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert lk.leaks(spark.createDataFrame(docs, schema), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_shards_and_pairs_change_nothing(spark, monkeypatch):
    """Scores and passages are those of all passages searched against one index."""
    rng = random.Random(8)
    vocab = [f"word{k}" for k in range(40)]
    items = [(n, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 30)))) for n in range(30)]
    docs = []
    for d in range(40):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(items)[1].split()
        docs.append((d, " ".join(w)))
    schema = "doc_id bigint, text string"
    run = lambda: {tuple(r) for r in lk.leaks(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    whole, index = run(), lk.Index([(n, t.split()) for n, t in items])
    want = {}
    for d, t in docs:
        w, step = t.split(), lk.PASSAGE - lk.RUN + 1
        for k in range(0, max(0, len(w) - lk.RUN + 1), step):
            for i, s in index.verified(w[k : k + lk.PASSAGE]):
                best, n = want.get((d, i), (0.0, 0))
                want[d, i] = (max(best, s), n + 1)
    assert {(d, i): (pytest.approx(s), n) for d, i, s, n in whole} == want and want
    monkeypatch.setattr(lk, "SHARD", 7)
    assert {(d, i, round(s, 9), n) for d, i, s, n in run()} == {(d, i, round(s, 9), n) for d, i, s, n in whole}


def test_small_sources_give_their_last_part(spark):
    docs = [(n, "word " * 9 + "word", "big") for n in range(900)] + [(9000, "one two three", "small")]
    target = [("big", 0.9, 1), ("small", 0.1, 2)]
    m = mx.Mixture(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(target, "source string, target_share double, max_repeats int"), shards=2, blocks=50)
    got = {r["source"]: r for r in m.shares().collect()}
    assert got["big"]["used_tokens"] == got["big"]["available_tokens"] and got["small"]["used_tokens"] == 2 * got["small"]["available_tokens"]
    quotas = m.quota_table().groupBy("source").sum("tokens").collect()
    assert {r[0]: r[1] for r in quotas} == {s: got[s]["used_tokens"] for s in got}


def test_sainte_lague():
    q = mx.sainte_lague({"a": 0.53, "b": 0.24, "c": 0.23, "d": 0.0}, {"a": 99, "b": 99, "c": 99, "d": 99}, 1, 7)
    assert q == [{"a": 3, "b": 2, "c": 2, "d": 0}]
    q = mx.sainte_lague({"a": 0.5, "b": 0.5}, {"a": 3, "b": 99}, 4, 5)
    assert [sum(x.values()) for x in q] == [5] * 4 and sum(x["a"] for x in q) == 3
    assert mx.sainte_lague({"a": 1.0}, {"a": 2}, 2, 3) == [{"a": 2}, {"a": 0}]


@pytest.fixture(scope="module")
def mix(spark):
    rng = random.Random(1)
    docs = [(n, " ".join("word" for _ in range(rng.randint(1, 60))), rng.choice(["Big ", "big", "mid", "tiny" if n % 40 == 0 else "big", "other", None])) for n in range(1500)]
    docs += [(5000, None, "big"), (5001, "", "mid")]
    target = [("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.15, 2), ("gone", 0.05, 4)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    return mx.Mixture(d, spark.createDataFrame(target, "source string, target_share double, max_repeats int"), shards=4, blocks=50)


def test_shares(mix):
    s = {r["source"]: r for r in mix.shares().collect()}
    assert set(s) == {"big", "mid", "tiny", "gone"}
    assert sum(r["actual_share"] for r in s.values()) == pytest.approx(1.0)
    assert s["gone"]["used_tokens"] == 0 and s["tiny"]["repeats"] == 2
    for r in s.values():
        assert r["repeats"] <= r["max_repeats"] and r["used_tokens"] <= r["available_tokens"] * r["max_repeats"]
        assert abs(r["used_tokens"] - r["quota_blocks"] * mix.block_tokens) <= 60 + 60
    assert s["big"]["actual_share"] / s["mid"]["actual_share"] == pytest.approx(5 / 3, rel=0.05)


def test_rows(mix):
    rows = mix.rows().collect()
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) and all(r["shard"] is not None for r in rows)
    uses = {}
    for r in rows:
        uses.setdefault(r["source"], {}).setdefault(r["doc_id"], 0)
        uses[r["source"]][r["doc_id"]] += 1
    for per in uses.values():  # documents come again only when all have been used as often
        assert max(per.values()) - min(per.values()) <= 1
    assert {r["doc_id"] for r in rows}.isdisjoint({5000, 5001})


def test_empty(spark):
    m = mx.Mixture(spark.createDataFrame([], "doc_id bigint, text string, source string"), spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert m.rows().count() == 0 and m.shares().first()["actual_share"] in (0.0, None)
