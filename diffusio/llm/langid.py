"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed character n-grams (1 to 3) with TF-IDF weights: the share of a text's
n-grams times the inverse document frequency. Document frequencies are counted over all
texts to learn from. The weights are learnt by FTRL with elastic-net penalties from at most
``sample`` rows (those with the least hashes of id, text and label), in a fixed order; a part
of them only sets the temperature. Their features are made on the executors and are all that
reaches the driver: at most BUCKETS numbers a row, however long its text is. Predictions read
whole texts. The model has BUCKETS x languages weights at most, which bounds the broadcast.

Defined cases: a null text or one without a letter is ``und`` with score 0; without texts
to learn from, every text is ``und``; repeated rows are predicted alike and learnt from once;
rows of one id with different texts are all learnt from; ties of score go to the language
that sorts first; rows without id are predicted, not learnt from; an empty table gives no
rows; of the columns only id, text and label are read, the label for learning only, and
those to keep may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from diffusio.llm.ftrl import Ftrl, softmax, temperature
from diffusio.session import ship

BUCKETS, ORDERS, SAMPLE, MOST_LANGUAGES = 1 << 15, 3, 4000, 256
#: Shares are small numbers; features are multiplied by this.
SCALE = 30.0
_LETTER = re.compile(r"[^\W\d_]")
_SLICE = 1 << 18


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points of a text; white space is one code, digits another."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where((c >= 48) & (c <= 57), 48, c)
    return np.concatenate(([32], np.where((c >= 9) & (c <= 13), 32, c), [32])).astype(np.uint32)


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams of each order."""
    out, h = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, ORDERS + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        mixed = h * np.uint32(0x9E3779B1)
        out.append((mixed >> np.uint32(32 - 15)).astype(np.int32))
    return out


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    codes = _codes(text)
    for at in range(0, len(codes), _SLICE):  # slices overlap so that each n-gram counts once
        for n, h in enumerate(_hashes(codes[at : at + _SLICE + ORDERS - 1]), 1):
            total += np.bincount(h[:_SLICE] if n < ORDERS else h, minlength=BUCKETS)
    some = np.flatnonzero(total)
    return some, total[some] / total.sum()


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows; added up on the executors in a tree."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for b in batches:
            for t in b["text"]:
                total[counts(t)[0]] += 1
                n += 1
        yield pd.DataFrame({"n": [n], "df": [total.tobytes()]})

    parts = texts.select("text").mapInPandas(partial, "n long, df binary").rdd.map(lambda r: (r[0], np.frombuffer(bytes(r[1]), dtype=np.int64)))
    n, df = parts.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1])) if not texts.isEmpty() else (0, np.zeros(BUCKETS, dtype=np.int64))
    return df, n


class Model:
    """languages, table (bucket x language: weight times inverse frequency), bias and temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, heat: float):
        self.languages, self.table, self.bias, self.heat = languages, table, bias, heat

    def scores(self, text: str) -> np.ndarray:
        codes, total, n = _codes(text), np.zeros(len(self.languages)), 0
        for at in range(0, len(codes), _SLICE):
            for k, h in enumerate(_hashes(codes[at : at + _SLICE + ORDERS - 1]), 1):
                h = h[:_SLICE] if k < ORDERS else h
                total += self.table[h].sum(axis=0, dtype=np.float64)
                n += len(h)
        return self.bias + total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        p = softmax(self.scores(text) * self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, epochs: int = 4, alpha: float = 0.5, l1: float = 1e-4, l2: float = 1e-3) -> Model:
    """Learn from (buckets, shares, language) of a bounded sample; every fifth row sets the temperature."""
    languages = sorted({x for _, _, x in rows})
    number = {x: i for i, x in enumerate(languages)}
    labels = np.array([number[x] for _, _, x in rows])
    model = Ftrl(BUCKETS + 1, len(languages), alpha=alpha, l1=l1, l2=l2)  # the last feature is the bias

    def vector(i: int) -> tuple[np.ndarray, np.ndarray]:
        at, share, _ = rows[i]
        return np.append(at, BUCKETS), np.append(share * idf[at] * SCALE, 1.0)

    held = np.arange(len(rows)) % 5 == 4
    order = np.flatnonzero(~held)
    rng = np.random.RandomState(7)
    for _ in range(epochs):
        for i in rng.permutation(order):
            at, v = vector(i)
            w = model.weights(at)
            p = softmax(v @ w)
            p[labels[i]] -= 1
            model.step(at, w, v[:, None] * p[None, :])
    w = model.weights()
    out = Model(languages, np.ascontiguousarray((w[:-1] * idf[:, None] * SCALE).astype(np.float32)), w[-1], 1.0)
    check = np.flatnonzero(held)
    if len(check):
        out.heat = temperature(np.array([out.bias + rows[i][1] @ out.table[rows[i][0]] for i in check]), labels[check])
    return out


def train(texts: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text, lang); rows without id, text or lang are passed over.

    Rows (id, hash of the text, language) are chosen first, so that no text is shuffled; at
    most ``sample`` of them are broadcast, and as many rows of features come back.
    """
    ship(texts.sparkSession)
    texts = texts.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    df, n = _document_frequencies(texts)
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = texts.withColumn("t", F.xxhash64("text"))
    chosen = rows.where("doc_id IS NOT NULL").select("doc_id", "t", "lang").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id", "t"), "doc_id", "t", "lang").limit(sample)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            parts = [counts(t) for t in b.column("text").to_pylist()]
            at, share = ([x.astype(kind).tobytes() for x in c] for kind, c in zip(("<i4", "<f8"), zip(*parts, strict=True), strict=True))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "t", "lang")), pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=["doc_id", "t", "lang", "at", "share"])

    found = rows.join(F.broadcast(chosen), ["doc_id", "t", "lang"]).select("doc_id", "t", "lang", "text").mapInArrow(made, "doc_id long, t long, lang string, at binary, share binary")
    found = found.groupBy("doc_id", "t", "lang").agg(F.min("at").alias("at"), F.min("share").alias("share"))
    got = found.toArrow().sort_by([(c, "ascending") for c in ("doc_id", "t", "lang")])
    if not len(got):
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0), 1.0)
    languages = got["lang"].to_pylist()
    if len(set(languages)) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    at, share = ([np.frombuffer(x.as_buffer(), dtype=kind) for x in got[c]] for c, kind in (("at", "<i4"), ("share", "<f8")))
    return fit(list(zip(at, share, languages, strict=True)), idf)


def identify(docs: DataFrame, model: Model, *keep: str | Column) -> DataFrame:
    """The kept columns with lang_pred and score of each whole text. No shuffle."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    rows = docs.select(F.struct(*keep).alias("kept"), predicted("text").alias("found"))
    return rows.select("kept.*", "found.*")
