from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyglean.llm import language as lg

TEXTS = {
    "en": "the house near the river is old and the people who live there like it very much today",
    "es": "la casa cerca del río es vieja y la gente que vive allí la quiere mucho cada día",
    "fr": "la maison près de la rivière est vieille et les gens qui y habitent l'aiment beaucoup",
    "de": "das Haus am Fluss ist alt und die Leute die dort wohnen mögen es heute sehr gern",
    "hi": "नदी के पास का घर पुराना है और वहाँ रहने वाले लोग उसे बहुत पसंद करते हैं",
    "mr": "नदीजवळचे घर जुने आहे आणि तिथे राहणाऱ्या लोकांना ते खूप आवडते",
    "zh": "河边的房子很旧住在那里的人们非常喜欢它",
    "ar": "البيت قرب النهر قديم والناس الذين يعيشون هناك يحبونه كثيرا",
}


def rows(n=30):
    out = []
    for k, t in TEXTS.items():
        ws = t.split() if k != "zh" else list(t)
        for i in range(n):
            sep = "" if k == "zh" else " "
            out.append((k, sep.join(ws[(j * (1 if k == "zh" else 7) + i) % len(ws)] for j in range(12)) + "."))
    return out


@pytest.fixture(scope="module")
def model():
    noisy = rows()
    noisy[3] = ("de", noisy[3][1])  # a wrong label
    return lg.train(noisy)


def test_held_out(model):
    for k, t in TEXTS.items():
        got = model.stretches(t + ".")
        assert [g[2] for g in got] == [k] and got[0][3] > 0.6


def test_mixed(model):
    text = TEXTS["en"] + ". " + TEXTS["fr"] + ".\n\n" + TEXTS["hi"] + "। " + TEXTS["hi"] + "।"
    got = model.stretches(text)
    assert [g[2] for g in got] == ["en", "fr", "hi"]
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert [g[2] for g in model.stretches(TEXTS["de"] + ". (θάλασσα) " + TEXTS["de"] + ".")] == ["de"]


def test_odd_texts(model):
    assert model.stretches("") == []
    assert [g[2] for g in model.stretches("θάλασσα борщ щука")] == ["und"]
    assert [g[2] for g in model.stretches("12345 !!!")] == ["und"]
    assert len(model.stretches((TEXTS["en"] + ". ") * 3000)) == 1


def test_labels(spark):
    cases = {
        "en": "en", " EN ": "en", "eng": "en", "en-GB": "en", "pt_BR": "pt", "English": "en", "hi-IN": "hi", "zh-Hans": "zh", "ori": "or",
        "": None, "und": None, "xx": None, "n/a": None, "??": None, "it": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", lg.label_code(F.col("l")).alias("c"))
    assert {r["l"]: r["c"] for r in df.collect()} == cases


def test_detect(spark):
    data = [(n, k, t) for n, (k, t) in enumerate(rows())]
    data += [(1000, None, TEXTS["fr"] + "."), (1001, "de", TEXTS["mr"] + "."), (1002, "xx", None), (1003, "es-MX", TEXTS["es"] + ". " + TEXTS["de"] + "."), (1004, "en", " ")]
    df = lg.detect(spark.createDataFrame(data, "id bigint, lang string, text string"))
    got = {(r["id"], r["seg"], r["seg_lang"]) for r in lg.label_cases(df).collect() if r["id"] >= 1000}
    assert got == {(1000, 1, "fr"), (1001, 1, "mr"), (1003, 1, "es"), (1003, 2, "de")}
    assert lg.detect(spark.createDataFrame([], "id bigint, lang string, text string")).count() == 0


def test_label_takes_no_part(model):
    """The label changes neither language nor confidence; its own probability is reported beside them."""
    for text in (TEXTS["de"], "Leute", "房子", TEXTS["fr"] + ". " + TEXTS["hi"] + "।"):
        plain = model.many([text])[0]
        for label in ("en", "fr", "zh", None, "xx"):
            assert [f[:4] for f in model.many([text], [label])[0]] == [f[:4] for f in plain]
    own = lambda text, label: model.many([text], [label])[0][0][4]
    assert own(TEXTS["de"], "de") > 0.9 and own(TEXTS["de"], "fr") < lg.DOUBT and own(TEXTS["de"], None) == 0.0


def test_batches_and_single_texts_agree(model):
    texts = [*TEXTS.values(), "", "12 !", TEXTS["en"] + ". " + TEXTS["de"] + ".", "Leute. Fluss. Haus."]
    assert model.many(texts) == [m for t in texts for m in model.many([t])]


def test_one_word_sentences(model):
    assert [g[2] for g in model.stretches("Leute. Fluss. Haus.")] == ["de"]
    assert len(model.stretches("coffee. ")) == 1
    # a word of another language between long sentences starts no run, a sentence does
    assert [g[2] for g in model.stretches(f"{TEXTS['de']}. (house) {TEXTS['de']}.")] == ["de"]
    assert [g[2] for g in model.stretches(f"{TEXTS['de']}. {TEXTS['en']}. {TEXTS['de']}.")] == ["de", "en", "de"]


def test_rejection_on_the_tables():
    """Languages left out of training and random strings are 'und', texts of the known languages are not."""
    path = Path("/root/testdata/sf0.1/corpus.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    pd = pytest.importorskip("pandas")
    d = pd.read_parquet(path, columns=["id", "lang", "text"]).drop_duplicates("id").dropna()
    names = {n.lower(): c for n, c in lg.NAMES.items()}
    d["code"] = d["lang"].str.strip().str.lower().str.split("[-_(]").str[0].map(names)
    d = d[d["code"].notna() & (d["text"].str.len() > 0)].sample(frac=1, random_state=1)
    rows = d.groupby("code").head(300)
    whole = lg.train(list(zip(rows["code"], rows["text"])))
    assert 0.1 < whole.temperature < 100 and 0.0 < whole.growth < 1.0 and whole.error < 0.05
    codes = [f[0][2] if len(f) == 1 else None for f in whole.many(list(rows["text"]))]
    rows = rows.assign(true=codes)
    left = ["pt", "de", "mr", "fr", "ur"]
    model = lg.train([(c, t) for c, t, k in zip(rows["code"], rows["text"], rows["true"]) if k is not None and k not in left])
    und = lambda ts: float(np.mean([all(f[2] == "und" for f in x) for x in model.many(list(ts))]))
    assert np.mean([und(rows[rows["true"] == c]["text"]) for c in left]) >= 0.9
    rest = rows[rows["true"].notna() & ~rows["true"].isin(left)]
    assert und(rest["text"]) < 0.01
    rng = np.random.default_rng(0)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(rng.integers(3, 12))) for _ in range(300)]
    assert und(noise) >= 0.9
    print("left out", und(rows[rows["true"].isin(left)]["text"]), "rest", und(rest["text"]), "noise", und(noise), "error", whole.error, whole.temperature, whole.growth)


def test_sample_takes_whole_texts(spark):
    text = (TEXTS["en"] + ". ") * 100 + TEXTS["fr"]
    df = spark.createDataFrame([(1, "en", text)], "id bigint, lang string, plain_text string")
    assert len(text) > 2000 and lg.sample(df) == [("en", text)]


def test_rejection_fit_ends_at_the_minimum():
    """Data on which whole Newton steps overshoot and never come back, among others."""
    for seed in range(30):
        rng = np.random.default_rng(seed)
        v = rng.lognormal(0, 2 + seed % 2, (100, 3)) * rng.choice([-1, 1], (100, 3))
        x, y = np.concatenate([np.ones((100, 1)), v], 1), (v.sum(1) > 0) * 1.0
        b = lg._logistic(x, y, np.ones(100))
        slope = x.T @ (y - 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))) - 1e-2 * b
        assert np.abs(slope).max() < 1e-3 and ((x @ b > 0) == (y > 0)).mean() > 0.95, seed
