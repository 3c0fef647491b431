"""The learnt operators against plain versions: FTRL, TF-IDF shares, hashed features; and their odd cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from diffusio.llm import langid, quality, toxicity
from diffusio.llm.ftrl import Ftrl, softmax, temperature

SAID = ["vile text here", "a", "", "zß é é é", "one two three four five one two three", "aaaaaaa aaaaaab", "x-y x_y 12 3"]


def plain_ftrl(rows, size, alpha, beta, l1, l2):
    """Weights after (features, values, label) rows of a logistic regression, coordinate by coordinate."""
    z, n = [0.0] * size, [0.0] * size

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for at, values, label in rows:
        w = {i: weight(i) for i in at}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, values, strict=True))))
        for i, v in zip(at, values, strict=True):
            g = (p - label) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    return [weight(i) for i in range(size)]


def test_ftrl():
    rng = random.Random(1)
    for l1, l2 in ((0.0, 0.0), (0.3, 0.1), (2.0, 0.0)):
        rows = []
        for _ in range(200):
            at = sorted(rng.sample(range(30), 5))
            rows.append((at, [rng.random() for _ in at], int(at[0] < 6)))
        model = Ftrl(30, 1, alpha=0.5, beta=1.0, l1=l1, l2=l2)
        for at, values, label in rows:
            w, v = model.weights(np.array(at)), np.array(values)
            p = 1 / (1 + np.exp(-(v @ w)[0]))
            model.step(np.array(at), w, (v * (p - label))[:, None])
        got = model.weights()[:, 0]
        assert got == pytest.approx(plain_ftrl(rows, 30, 0.5, 1.0, l1, l2), abs=1e-12)
        assert l1 < 2 or (got == 0).any()


def test_temperature_is_the_best_factor():
    rng = np.random.RandomState(3)
    scores, labels = rng.randn(300, 4) * 3, rng.randint(0, 4, 300)
    loss = lambda t: -np.log(np.maximum(softmax(scores * t)[np.arange(300), labels], 1e-12)).mean()
    best = temperature(scores, labels)
    assert loss(best) <= min(loss(t) for t in np.exp(np.linspace(-4, 6, 400))) + 1e-6 and temperature(scores[:0], labels[:0]) == 1.0


def plain_grams(text):
    """Counts of character n-grams of 1 to 3; white space is a blank, a digit 0, with a blank at both ends."""
    t = " " + re.sub(r"[\t-\r]", " ", re.sub("[0-9]", "0", text.lower())) + " "
    return Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1))


def test_shares_of_character_grams(monkeypatch):
    for text in [*SAID, "abc " * 40]:
        grams, want = plain_grams(text), Counter()
        for g, k in grams.items():  # the hash of a gram alone says where it is counted
            want[int(langid._hashes(np.frombuffer(g.encode("utf-32-le"), dtype=np.uint32))[len(g) - 1][0])] += k
        whole = langid.counts(text)
        assert dict(zip(whole[0].tolist(), (whole[1] * grams.total()).round(9), strict=True)) == want, text
        monkeypatch.setattr(langid, "_SLICE", 7)  # slices don't change counts
        cut = langid.counts(text)
        monkeypatch.undo()
        assert (cut[0] == whole[0]).all() and cut[1] == pytest.approx(whole[1])


def test_document_frequencies(spark):
    df, n = langid._document_frequencies(spark.createDataFrame([(t,) for t in SAID] * 2, "text string"))
    want = Counter(b for t in SAID for b in langid.counts(t)[0].tolist() * 2)
    assert n == 2 * len(SAID) and {i: int(df[i]) for i in np.flatnonzero(df)} == want


def plain_features(text):
    """Distinct words, stems of 3 to 6 bytes of longer ones, and pairs one to three places apart."""
    words = [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    out = {("word", w) for w in words} | {("stem", n, w[:n]) for w in words for n in (3, 4, 5, 6) if len(w) > n}
    return out | {("pair", d, a, b) for d in (1, 2, 3) for a, b in zip(words, words[d:], strict=False)}


def test_hashed_features():
    rows = {}
    for lo, at, row, n in toxicity.features(pa.array(SAID, pa.string())):
        for i in range(n):
            rows[lo + i] = set(at[row == i].tolist())
    for i, text in enumerate(SAID):
        assert len(rows[i]) == len(plain_features(text)), text
    alone = {}
    for text in SAID:  # the same feature has the same place in every text
        for f in plain_features(text):
            alone.setdefault(f, set()).add(SAID.index(text))
    for f, where in alone.items():
        common = set.intersection(*(rows[i] for i in where))
        assert common, f


def languages(spark, rows):
    return spark.createDataFrame([(i, t, x, 1) for i, t, x in rows], "doc_id long, text string, lang string, score int")


def test_language_cases(spark):
    rows = [(i, "kala muna " * 3 + str(i), "aa") for i in range(20)] + [(100 + i, "zwrx qvth " * 3 + str(i), "bb") for i in range(20)]
    rows += [rows[0]] * 50 + [(0, "zwrx qvth zwrx", "bb"), (None, "kala", "aa"), (7, None, "aa"), (8, "", "bb"), (9, "kala", None)]
    df = languages(spark, rows)
    model = langid.train(df, sample=45)
    got = langid.identify(df, model, "doc_id", "score").toPandas()
    assert got.shape == (len(rows), 4) and list(got.columns) == ["doc_id", "score", "lang_pred", "score"]
    assert langid.identify(df.limit(0), model, "doc_id").count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, langid.train(df.limit(0)), "doc_id").collect()} == {"und"}
    same = langid.identify(df.where("doc_id = 0 AND lang = 'aa'"), model, "doc_id").distinct().count()
    assert same == 1
    again = langid.train(df.repartition(3), sample=45)
    assert (again.table == model.table).all() and again.heat == model.heat  # the sample and its order don't depend on the layout


def test_toxicity_cases(spark):
    rows = [(i, "vile thing " + str(i) if i % 3 == 0 else f"nice thing {i}") for i in range(60)]
    rows += [rows[0]] * 50 + [(0, "nice other text"), (None, "vile"), (70, None), (71, "")]
    docs = spark.createDataFrame([(i, t, 0.5, 3) for i, t in rows], "doc_id long, text string, toxicity double, t int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(60)] * 2 + [(1, None, 1), (None, 1, 1)], "doc_id long, toxic int, t int")
    model = toxicity.train(docs, labels, sample=50)
    scored = toxicity.score(docs, model)
    assert scored.columns == docs.columns and scored.count() == len(rows)
    assert scored.where("doc_id = 0 AND text <> 'nice other text'").select("toxicity").distinct().count() == 1
    assert toxicity.score(docs.limit(0), model).count() == 0 and not toxicity.train(docs.limit(0), labels).known
    again = toxicity.train(docs.repartition(3), labels, sample=50)
    assert (again.at == model.at).all() and (again.weights == model.weights).all()


def test_fences_are_near_the_plain_ones(spark):
    """Sketches are drawn at random; with k = 200 a quantile's rank is within about 2 percent."""
    rng = random.Random(4)
    rows = [(i, " ".join(["w" * rng.randrange(1, 12) for _ in range(30)]), "en", "s") for i in range(3000)]
    measured = quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    lengths = np.sort([sum(map(len, t.split())) / 30 for _, t, _, _ in rows])
    found = quality.fences(measured).first()["word_length"]
    low, high = lengths[[int(0.22 * 3000), int(0.28 * 3000)]], lengths[[int(0.72 * 3000), int(0.78 * 3000)]]
    assert high[0] + 3 <= found["high"] <= high[1] + 3 * max(high[1] - low[0], 1) and low[0] - 3 * max(high[1] - low[0], 1) <= found["low"] <= low[1] - 3
