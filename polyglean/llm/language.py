"""Problem 3: language of each record and of each single-language stretch of its text, with a confidence.

The classifier averages hashed embeddings of words and their character n-grams and puts a linear softmax on top; it is
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows (``ROWS`` per language). Labels
are noisy, so the rows that a first pass contradicts firmly are relabelled before a second. Held-out rows give the
temperature, found under a likelihood that allows for wrong labels, and the rejection: a logistic model of the share of
a piece's n-grams that were seen in its language, fitted to tell pieces of their own language from pieces whose
language is left out, as the best of the other languages sees them. No script or label decides anything.

Every record is then classified piece by piece (sentences and parts between strong separators), a whole batch at once.
The best sequence of languages, 'und' among them, with a cost for each switch, gives the stretches; a piece weighs the
more the more words it has, up to five. A piece's confidence is the probability of its language times that of being in
a known one.

Records with NULL or blank text give no stretch. Text in no known language gives 'und'. Repeated rows, ties and long
texts need no special care; a text's stretches need memory in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from polyglean.llm.plain_form import plain_form
from polyglean.runtime import materialize, spread

# The languages with their three-letter codes and English names.
LANGUAGES = {
    "en": "eng english", "es": "spa spanish castilian", "fr": "fra fre french", "de": "deu ger german",
    "pt": "por portuguese", "hi": "hin hindi", "mr": "mar marathi", "sa": "san sanskrit",
    "bn": "ben bengali bangla", "as": "asm assamese", "te": "tel telugu", "ta": "tam tamil", "gu": "guj gujarati",
    "kn": "kan kannada", "ml": "mal malayalam", "or": "ori ory odia oriya", "pa": "pan punjabi panjabi",
    "ur": "urd urdu", "ar": "ara arb arabic", "zh": "zho chi cmn chinese mandarin",
}
CODES = sorted(LANGUAGES)
NAMES = {n: c for c, ns in LANGUAGES.items() for n in [c, *ns.split()]}

#: Labelled rows per language the classifier is fitted on: the bound of the sample.
ROWS = 600
#: One in so many of the sampled rows is held out for the temperature and the rejection.
HELD_OUT = 5
BUCKETS, DIM, EPOCHS, RATE = 1 << 18, 16, 4, 0.5
#: Costs of a language switch at a sentence end, or another separator, and inside a sentence.
SWITCH_END, SWITCH_INSIDE = 1.5, 4.0
#: Log probabilities below this count as this.
LEAST = -12.0
#: Words (a Chinese word counted as two characters) from which a piece has its full weight.
FULL = 5
#: Words whose sums a task remembers.
REMEMBERED = 300_000

WORD = regex.compile(r"[\p{L}\p{M}]+")
CUT = regex.compile(r"[.!?।॥؟۔]+[\p{Pf}\p{Pe}\"'”»]*(?=\s|$)|[。！？]+[\p{Pf}\p{Pe}\"']*|\n\s*\n|\s[—/|]\s")
HAN = regex.compile(r"[一-鿿]")
UND = len(CODES)
#: A label is wrong if its language has less than this probability.
DOUBT = 0.02
_CODE = {c: k for k, c in enumerate(CODES)}


def label_code(label: Column) -> Column:
    """Two-letter code a label names in any notation (case, blanks, suffixes, three letters, English name), or NULL."""
    base = F.lower(F.trim(F.split(F.regexp_replace(label, r"[\p{Z}\s]+", " "), "[-_(]")[0]))
    return F.element_at(F.create_map(*[F.lit(x) for p in NAMES.items() for x in p]), base)


def features(word: str) -> list[int]:
    if HAN.search(word):
        grams = [*word, *(word[k : k + 2] for k in range(len(word) - 1))]
    else:
        w = f"<{word}>"
        grams = [w, *word, *(w[k : k + 2] for k in range(len(w) - 1)), *(w[k : k + 3] for k in range(len(w) - 2))]
    return [xxhash.xxh32_intdigest(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


def pieces(text: str) -> list[tuple[int, int, bool]]:
    """(begin, end, is followed by a strong cut) of the parts of a text, in order, without gaps."""
    out, at = [], 0
    for m in CUT.finditer(text):
        if m.start() > at:  # a cut at the start of a part belongs to it
            out.append((at, m.end(), True))
            at = m.end()
    if at < len(text):
        out.append((at, len(text), False))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    """Log probabilities."""
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _novelty(cover: np.ndarray, grams: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """What the rejection sees of pieces: the share of n-grams known in a language, which says more of a longer piece.

    ``cover`` is in units of what is usual for the language, as languages differ in how many of their n-grams a sample
    holds; each has a constant of its own too.
    """
    root = np.sqrt(np.maximum(grams, 1.0))
    return np.concatenate([np.stack([cover, 1 / root, cover / root, cover * np.log(root), np.log(root)], 1), np.eye(len(CODES))[langs]], 1)


class Model:
    def __init__(self, emb: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.emb, self.out, self.bias = emb, out, bias
        self.seen = np.zeros((len(emb), len(CODES)), bool)  # n-grams known in each language
        self.temperature, self.growth, self.accept = 1.0, 0.0, np.zeros(5 + len(CODES))
        self.usual = np.ones(len(CODES))  # share of known n-grams of a language's own pieces
        self.error = float("nan")  # calibration error on the held-out rows
        self._forget()

    def _forget(self) -> None:
        self._rows: dict[str, int] = {}  # word -> row of the arrays below
        self._sums, self._sizes = np.zeros((1024, DIM), np.float32), np.zeros(1024, np.int32)
        self._known, self._words = np.zeros((1024, len(CODES)), np.int32), np.zeros(1024, np.int32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._forget()

    def _row(self, w: str) -> int:
        k = len(self._rows)
        if k == len(self._sizes):
            for name in ("_sums", "_sizes", "_known", "_words"):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, np.zeros_like(a)]))
        f = features(w)
        self._sums[k], self._sizes[k], self._known[k] = self.emb[f].sum(0), len(f), self.seen[f].sum(0)
        self._words[k] = max(1, len(w) // 2) if HAN.search(w) else 1
        self._rows[w] = k
        return k

    def _bags(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(mean embedding, n-grams, n-grams known in each language, words) of each text."""
        if len(self._rows) > REMEMBERED:
            self._forget()
        ids, at, get = [], [], self._rows.get
        for t in texts:
            at.append(len(ids))
            for w in WORD.findall(t.lower()):
                k = get(w)
                ids.append(self._row(w) if k is None else k)
        n = np.diff([*at, len(ids)])
        some = np.flatnonzero(n)
        x, size = np.zeros((len(texts), DIM)), np.zeros(len(texts))
        known, words = np.zeros((len(texts), len(CODES))), np.zeros(len(texts))
        if len(some):
            ids, start = np.array(ids), np.array(at)[some]
            size[some] = np.add.reduceat(self._sizes[ids], start)
            x[some] = np.add.reduceat(self._sums[ids], start, axis=0) / size[some, None]
            known[some] = np.add.reduceat(self._known[ids], start, axis=0)
            words[some] = np.add.reduceat(self._words[ids], start)
        return x, size, known, words

    def _log_probs(self, z: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log probabilities from logits of means: a mean of more n-grams says more."""
        return _softmax(z * (np.maximum(size, 1.0) ** self.growth / self.temperature)[:, None])

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of the languages and 'und' for each text, and its words; rows of texts without words are 0."""
        x, size, known, words = self._bags(texts)
        lp = self._log_probs(x @ self.out + self.bias, size)
        best = lp.argmax(1)
        cover = known[np.arange(len(texts)), best] / np.maximum(size, 1) / self.usual[best]
        z = np.clip(_novelty(cover, size, best) @ self.accept, -30, 30)
        inside, outside = -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))
        out = np.concatenate([lp + inside[:, None], outside[:, None]], 1)
        out[size == 0] = 0.0
        return out, words

    def many(self, texts: list[str], asked: list[str | None] | None = None) -> list[list[tuple[int, int, str, float, float]]]:
        """(begin, end, language, confidence, that of the language asked) of each text's stretches, in reading order."""
        asked = asked or [None] * len(texts)
        parts = [pieces(t) for t in texts]
        scores, words = self.scores([t[a:b] for t, ps in zip(texts, parts) for a, b, _ in ps])
        out, at = [], 0
        for ps, lang in zip(parts, asked):
            lp, n = scores[at : at + len(ps)], words[at : at + len(ps)]
            found = self._path(ps, lp, n)
            k = _CODE.get(lang)
            out.append([(*f, self._of(k, f, ps, lp)) for f in found])
            at += len(ps)
        return out

    @staticmethod
    def _of(k: int | None, stretch: tuple, parts: list, lp: np.ndarray) -> float:
        """Probability of language ``k`` for a whole stretch, all of its pieces taken as one language."""
        if k is None:
            return 0.0
        own = [bool(stretch[0] <= a < stretch[1]) for a, _, _ in parts]
        return float(np.exp(_softmax(lp[own, :UND].sum(0, keepdims=True))[0, k]))

    def stretches(self, text: str) -> list[tuple[int, int, str, float]]:
        return [f[:4] for f in self.many([text])[0]]

    @staticmethod
    def _path(parts: list[tuple[int, int, bool]], lp: np.ndarray, words: np.ndarray) -> list[tuple[int, int, str, float]]:
        if not parts:
            return []
        if not words.any():
            return [(parts[0][0], parts[-1][1], "und", 0.0)]
        top = lp[words > 0].argmax(1)
        if (top == top[0]).all():
            path = [int(top[0])] * len(parts)
        else:
            weight = np.clip((words - 0.75) / (FULL - 0.75), 0.0, 1.0)
            scores = np.maximum(lp, LEAST) * (weight / weight.max())[:, None]
            best, back = scores[0], []
            for k in range(1, len(parts)):
                jump = best.max() - (SWITCH_END if parts[k - 1][2] else SWITCH_INSIDE)
                back.append(np.where(best >= jump, np.arange(UND + 1), best.argmax()))
                best = np.maximum(best, jump) + scores[k]
            path = [int(best.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            path.reverse()
        out: list[list] = []
        for (a, b, _), lang, row, n in zip(parts, path, lp, words):
            ps = [(float(np.exp(row[lang])), float(n))] if n and lang != UND else []
            if out and out[-1][2] == lang:
                out[-1][1] = b
                out[-1][3] += ps
            else:
                out.append([a, b, lang, ps])
        return [(a, b, "und" if lang == UND else CODES[lang], sum(p * n for p, n in ps) / sum(n for _, n in ps) if ps else 0.0) for a, b, lang, ps in out]


def _fit(bags: list[np.ndarray], labels: np.ndarray, model: Model, epochs: int, rng: np.random.Generator, rate: float) -> None:
    n = len(bags)
    for e in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, 32):
            rows = order[s : s + 32]
            lens = np.array([len(bags[r]) for r in rows])
            ids = np.concatenate([bags[r] for r in rows])
            at = np.concatenate([[0], np.cumsum(lens)[:-1]])
            x = np.add.reduceat(model.emb[ids], at, axis=0) / lens[:, None]
            z = x @ model.out + model.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            lr = rate * (1 - (e * n + s) / (epochs * n)) + 0.02
            gx = (p @ model.out.T) / lens[:, None]
            model.out -= lr * (x.T @ p) / 4
            model.bias -= lr * p.sum(0) / 4
            np.add.at(model.emb, ids, np.repeat(-lr * 4 * gx, lens, axis=0).astype(np.float32))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 200, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's method.

    A step is halved until it lowers the loss: whole steps overshoot on some data and then never come back.
    """

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(w @ (np.logaddexp(0.0, z) - y * z) + ridge / 2 * (b @ b))

    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        g = x.T @ (w * (y - p)) - ridge * b
        step = np.linalg.solve(h, g)
        gain, now, part = float(g @ step), loss(b), 1.0
        while part > 1e-9 and loss(b + part * step) > now - 1e-4 * part * gain:
            part /= 2
        if part <= 1e-9 or not gain > 1e-10:  # at the minimum, as far as numbers can tell
            break
        b += part * step
    return b


def train(rows: list[tuple[str, str]], seed: int = 1) -> Model:
    """Fit on (language, text) rows."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32),
        rng.normal(0, 0.1, (DIM, len(CODES))).astype(np.float32),
        np.zeros(len(CODES), np.float32),
    )
    grams = cache(lambda w: np.array(features(w)))
    bags, labels, held, row = [], [], [], []
    for k, (lang, text) in enumerate(sorted(rows)):
        for a, b, _ in pieces(text):
            words = WORD.findall(text[a:b].lower())
            if not words:
                continue
            at = int(rng.integers(len(words)))
            for ws in (words, words[at : at + int(rng.integers(1, 4))]):  # and a short stretch, as short texts are
                bags.append(np.concatenate([grams(w) for w in ws]))
                labels.append(CODES.index(lang))
                held.append(k % HELD_OUT == 0)
                row.append(k)
    if not bags:
        return model
    labels, held = np.array(labels), np.array(held)
    own, y = [b for b, h in zip(bags, held) if not h], labels[~held]
    logits = lambda bs: np.stack([model.emb[b].mean(0) for b in bs]) @ model.out + model.bias
    if own:
        _fit(own, y, model, EPOCHS, rng, RATE)
        # a row whose pieces all together contradict its label firmly gets the language found, its short stretches too
        whole = np.zeros((len(rows), len(CODES)))
        at = np.array(row)[~held]
        np.add.at(whole, at, np.maximum(_softmax(logits(own)), LEAST))
        whole = _softmax(whole)
        y = np.where(whole.max(1)[at] > np.log(0.8), whole.argmax(1)[at], y)
        _fit(own, y, model, EPOCHS, rng, RATE / 2)
    counts = np.zeros((BUCKETS, len(CODES)), np.int32)
    for b, c in zip(own, y):
        counts[np.unique(b), c] += 1
    # what wrong labels left in a language is rare there beside its own language
    model.seen = (counts >= 1) & (counts >= 0.03 * counts.sum(1, keepdims=True))
    out = [b for b, h in zip(bags, held) if h]
    if out:
        _calibrate(model, out, logits(out), labels[held])
    return model


def _calibrate(model: Model, bags: list[np.ndarray], z: np.ndarray, labels: np.ndarray) -> None:
    """Temperature and its growth with the length, rejection and calibration error, all from held-out pieces."""
    n, at = len(bags), np.arange(len(bags))
    size = np.array([len(b) for b in bags], float)
    known = np.stack([model.seen[b].mean(0) for b in bags])
    # how labels go wrong: languages of long pieces, as found, against their labels
    wrong = np.eye(len(CODES)) + 0.05 / len(CODES)
    np.add.at(wrong, (z.argmax(1)[size > 60], labels[size > 60]), 1.0)
    wrong /= wrong.sum(1, keepdims=True)

    def loss() -> float:
        return -np.log((np.exp(model._log_probs(z, size)) @ wrong)[at, labels]).mean()

    def fitted(growth: float) -> tuple[float, float, float]:
        model.growth, lo, hi = growth, np.log(0.02), np.log(200.0)
        for _ in range(30):  # golden section on the logarithm of the temperature
            a, b = hi - 0.618 * (hi - lo), lo + 0.618 * (hi - lo)
            model.temperature = np.exp(a)
            left = loss()
            model.temperature = np.exp(b)
            lo, hi = (lo, b) if left < loss() else (a, hi)
        model.temperature = float(np.exp((lo + hi) / 2))
        return loss(), model.temperature, growth

    _, model.temperature, model.growth = min(fitted(g) for g in np.arange(0.0, 1.01, 0.1))
    # inside: pieces whose label the classifier shares; outside: the same, their language left out
    true = z.argmax(1) == labels
    rest = z.copy()
    rest[at, labels] = -np.inf
    other = rest.argmax(1)
    for k in range(len(CODES)):
        if (own := true & (labels == k)).any():
            model.usual[k] = max(0.1, float((known[own, k] * size[own]).sum() / size[own].sum()))
    known = known / model.usual
    x = np.concatenate([_novelty(known[at, labels], size, labels)[true], _novelty(known[at, other], size, other)[true]])
    y = np.repeat([1.0, 0.0], true.sum())
    if true.any():
        model.accept = _logistic(x, y, np.ones(len(y)))
    p = np.exp(model._log_probs(z, size)) @ wrong  # of the labels, wrong ones among them
    conf, hit = p.max(1), p.argmax(1) == labels
    bins = np.minimum((conf * 10).astype(int), 9)
    model.error = float(sum(abs(conf[bins == b].mean() - hit[bins == b].mean()) * (bins == b).sum() for b in range(10) if (bins == b).any()) / n)


def sample(plain: DataFrame, rows: int = ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` labelled rows per language, the first in the order of a hash of their content.

    Their texts are taken whole: the driver needs memory in proportion to them.
    """
    h = F.xxhash64("plain_text", "id")
    labelled = plain.select(label_code(F.col("lang")).alias("code"), F.col("plain_text").alias("t"), h.alias("h")).where("code IS NOT NULL AND length(trim(t)) > 0")
    first = labelled.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("h"))).where(F.col("n") <= rows)
    return [(r[0], r[1]) for r in first.select("code", "t").collect()]


def detect(records: DataFrame, rows: int = ROWS) -> DataFrame:
    """(id, lang, seg, seg_lang, confidence, label_confidence, begin, end): the stretches of each text in plain form.

    ``label_confidence`` is the probability of the language the record's label names, NULL if it names none. It is
    reported beside the result and takes no part in it.
    """
    spark = records.sparkSession
    plain = plain_form(records.select("id", "lang", "text"), "id", "text").select("id", "lang", "plain_text")
    plain = materialize(plain, "plain")  # read for the sample and for the records
    model = spark.sparkContext.broadcast(train(sample(plain, rows)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for pdf in batches:
            labels = [c if isinstance(c, str) else None for c in pdf["code"]]
            out = [
                (i, lang, k, code, conf, own if label else None, a, b)
                for i, lang, label, found in zip(pdf["id"], pdf["lang"], labels, m.many(list(pdf["plain_text"]), labels))
                for k, (a, b, code, conf, own) in enumerate(found, 1)
            ]
            yield pd.DataFrame(out, columns=["id", "lang", "seg", "seg_lang", "confidence", "label_confidence", "begin", "end"])

    texts = spread(plain.where("length(trim(plain_text)) > 0").select("id", "lang", "plain_text", label_code(F.col("lang")).alias("code")))
    return texts.mapInPandas(run, "id BIGINT, lang STRING, seg INT, seg_lang STRING, confidence DOUBLE, label_confidence DOUBLE, begin INT, end INT")


def label_cases(stretches: DataFrame) -> DataFrame:
    """(id, seg, seg_lang) of records whose label is missing or wrong or whose text has more than one language.

    A label is wrong if the text gives its language a probability below ``DOUBT``: a word that several languages share
    contradicts none of them.
    """
    right = F.coalesce((label_code(F.col("lang")) == F.col("seg_lang")) | (F.col("label_confidence") >= DOUBT), F.lit(False))
    per = W.partitionBy("id")
    flagged = stretches.select("id", "seg", "seg_lang", F.max("seg").over(per).alias("n"), right.alias("right"))
    return flagged.where("seg_lang <> 'und' AND (n > 1 OR NOT right)").select("id", "seg", "seg_lang")
