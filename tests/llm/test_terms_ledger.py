import math
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyglean.llm import copy_ledger as cl, terms as t
from polyglean.llm.copy_ledger import CopyLedger, canonical_key, ledger_of
from polyglean.llm.tables import SURROGATE

SCHEMA = "id bigint, title string, text string"
ROWS = [
    (1, "Alpha beta", "alpha alpha gamma"), (2, None, "gamma, GAMMA gamma delta"), (3, "", ""), (4, None, None),
    (5, "beta", "beta beta 水 水 水"), (70_000, "x", "alpha delta"), (None, "alpha", "alpha"),
]


def words(row):
    return [w.strip(",.") for w in f"{row[1] or ''} {row[2] or ''}".lower().split()]


def test_scores(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r["id"], r["term"]): r for r in t.distinctive_terms(df).collect()}
    n, docs = len(ROWS), {r[0]: Counter(words(r)) for r in ROWS}
    df_, cf = Counter(w for c in docs.values() for w in c), Counter()
    for c in docs.values():
        cf.update(c)
    total = sum(cf.values())
    assert set(got) == {(i, w) for i, c in docs.items() for w in c}
    for (i, w), r in got.items():
        k, length = docs[i][w], sum(docs[i].values())
        assert (r["k"], r["n"]) == (k, df_[w]) and r["score"] == pytest.approx(k * math.log(n / df_[w]))
        a, b, c, d = k, length - k, cf[w] - k, total - length - cf[w] + k
        e = lambda o, x: o * math.log(o / x) if o else 0.0
        g = 2 * (e(a, length * cf[w] / total) + e(b, length * (total - cf[w]) / total) + e(c, (total - length) * cf[w] / total) + e(d, (total - length) * (total - cf[w]) / total))
        assert abs(r["llr"]) == pytest.approx(g, abs=1e-6) and (r["llr"] >= -1e-9) == (a * (c + d) >= c * (a + b))
    top = {r["id"]: r["term"] for r in t.top_terms(t.distinctive_terms(df)).collect()}
    assert top[5] == "水" and top[2] == "gamma" and 3 not in top
    assert t.distinctive_terms(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bitmaps(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    whole = t.term_bitmaps(df, "text")
    got = {r["term"]: r for r in t.term_frequencies(whole, len(ROWS), 2, 0.4).collect()}
    docs = [Counter((r[2] or "").lower().replace(",", "").split()) for r in ROWS]
    for w, r in got.items():
        assert r["uses"] == sum(c[w] for c in docs) and r["records"] == sum(w in c for c in docs)
        assert r["mark"] == ("rare" if r["records"] < 2 else "common" if r["records"] >= len(ROWS) * 0.4 else None)
    halves = [t.term_bitmaps(df.where(c), "text") for c in ("id % 2 = 0", "id % 2 <> 0 OR id IS NULL")]
    merged = {r["term"]: (r["uses"], r["records"]) for r in t.term_frequencies(t.merge_bitmaps(*halves), 7).collect()}
    assert merged == {w: (r["uses"], r["records"]) for w, r in got.items()}
    assert t.term_frequencies(t.term_bitmaps(spark.createDataFrame([], SCHEMA), "text"), 0).count() == 0


@pytest.mark.parametrize("n", [0, 1, t.DENSE - 1, t.DENSE, t.SPAN])
def test_container_round_trip(n):
    a = np.sort(np.random.default_rng(n).choice(t.SPAN, n, replace=False)).astype(np.uint16)
    c = t.pack(a)
    assert np.array_equal(t.unpack(c), a) and len(c) <= 1 + 8192 and (c[:1] == b"d") == (n >= t.DENSE)


COPIES = [
    (1, "A Title", "Some  text, here."), (2, "some text here", "a-title!"), (3, "ATITLE", "SOMETEXTHERE"), (4, "A Title", "some text her"),
    (5, None, ""), (6, "", " .​"), (7, "A Title", "Some  text, here."), (8, "a+", "b"), (9, "a", "+b"), (10, "Ａ Ｔｉｔｌｅ", "some text here"),
]
GROUPS = {(1, 2), (1, 3), (1, 7), (1, 10), (5, 6)}


def test_ledger_in_any_batches(spark):
    rng = random.Random(1)
    for cut in (1, 2, 4):
        rows = COPIES + rng.sample(COPIES, 4)
        parts = [rows[k::cut] for k in range(cut)]
        ledger = CopyLedger(spark, buckets=4)
        for p in parts:
            ledger.add(spark.createDataFrame(list({r[0]: r for r in p}.values()), SCHEMA))
        assert {tuple(r) for r in ledger.copies().collect()} == GROUPS
        assert {(r["id_kept"], r["copies"]) for r in ledger.entries().collect()} == {(1, 5), (4, 1), (5, 2), (8, 1), (9, 1)}


def test_ledger_of_batches(spark):
    import datetime as dt

    rows = [(str(i), a, b, i % 3 if i % 4 else None, dt.datetime(2024, 1, 1)) for i, a, b in COPIES for _ in range(2)]
    c = spark.createDataFrame(rows, "id string, title string, text string, batch_id bigint, loaded_at timestamp")
    assert {tuple(r) for r in ledger_of(c, 3, 4).copies().collect()} == GROUPS
    assert ledger_of(c.limit(0), 3, 4).copies().count() == 0


def test_hot_group(spark):
    rows = [(n, "same", "text") if n % 3 == 0 else (n, f"t{n}", "x") for n in range(3000)]
    ledger = CopyLedger(spark, buckets=4)
    ledger.add(spark.createDataFrame(rows, SCHEMA))
    got = ledger.copies().collect()
    assert len(got) == 999 and {r["id_kept"] for r in got} == {0}


def test_key_keeps_symbols(spark):
    k = lambda a, b: spark.range(1).select(canonical_key(F.lit(a), F.lit(b))).first()[0]
    assert k("a", "b") == k("B", "a.") != k("a+", "b") and k("ab", "") != k("a", "b")


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_ledger_opened_again(spark, tmp_path, monkeypatch):
    """State survives the object and a failed step; changed ids leave their group; buckets grow; runs are merged."""
    monkeypatch.setattr(cl, "RUNS", 2)
    path, now = f"file://{tmp_path}/ledger", {}
    rng = random.Random(4)
    for step in range(5):
        batch = {n: (n, rng.choice("ab"), rng.choice(["x", "y", "Z", "z!", None])) for n in rng.sample(range(1, 40), 12)}
        now |= batch
        ledger = CopyLedger(spark, path, buckets=2, keys=6)
        if step == 3:
            monkeypatch.setattr(ledger.files, "put", None)
            with pytest.raises(TypeError):
                ledger.add(rows_of(spark, list(batch.values())))
            ledger = CopyLedger(spark, path, buckets=2, keys=6)
        ledger.add(rows_of(spark, list(batch.values())))
        groups = {}
        for n, a, b in now.values():
            groups.setdefault(tuple(sorted([a, (b or "").lower().strip("!")])), []).append(n)
        want = {(min(g), n) for g in groups.values() for n in g if n != min(g)}
        again = CopyLedger(spark, path)
        assert {tuple(r) for r in again.copies().collect()} == want
        assert sorted((r["copies"], r["id_kept"]) for r in again.entries().collect()) == sorted((len(g), min(g)) for g in groups.values())
    assert again.state["buckets"] > 2 and again.state["records"] == len(now)
    again.vacuum()
    assert {tuple(r) for r in CopyLedger(spark, path).copies().collect()} == want


def test_ledger_of_another_process(spark, tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[2])\n"
        "from pyspark.sql import SparkSession\n"
        "from polyglean.llm.copy_ledger import CopyLedger\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "CopyLedger(s, sys.argv[1]).add(s.createDataFrame([(5, 'A b', 'c'), (9, 'q', 'r')], 'id bigint, title string, text string'))\n"
    )
    path = f"file://{tmp_path}/ledger"
    root = str(Path(__file__).resolve().parent.parent.parent)
    subprocess.run([sys.executable, "-c", code, path, root], check=True, timeout=300, capture_output=True)
    ledger = CopyLedger(spark, path)
    ledger.add(rows_of(spark, [(3, "C", "ab"), (9, "other", "r"), (11, "Q", "R.")]))
    assert {tuple(r) for r in ledger.copies().collect()} == {(3, 5)}
    assert {(r["copies"], r["id_kept"]) for r in ledger.entries().collect()} == {(2, 3), (1, 9), (1, 11)}


def test_batch_reads_only_its_buckets(spark):
    ledger = CopyLedger(spark, buckets=64)
    ledger.add(rows_of(spark, [(n, f"t{n}", "x") for n in range(300)]))
    before = dict(ledger.state["entries"])
    ledger.add(rows_of(spark, [(1000, "t7", "x"), (1001, "new", "x")]))
    assert sum(before.get(b) != d for b, d in ledger.state["entries"].items()) <= 2


def test_odd_ids(spark):
    ledger = CopyLedger(spark, buckets=4)
    ledger.add(rows_of(spark, [(None, "a", "b"), (4, "B", "a"), (-7, "", None)]))
    got = {(r["copies"], r["id_kept"] if r["id_kept"] > SURROGATE else None) for r in ledger.entries().collect()}
    assert got == {(2, None), (1, -7)}
