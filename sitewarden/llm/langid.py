"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A whole text, lower-cased with runs of non-letters as one space, gives its character 1- to 3-grams, hashed to 2**BITS
features; a feature's value is log(1 + count) x idf, the vector has length 1. Document frequencies cover all training
rows. The weights are fitted on the driver by FTRL-proximal steps with L1 and L2 penalties over a sample of at most
SAMPLE training rows, the same number for each language; a fifth of the sample, kept from fitting, gives the
temperature that the scores are divided by.

Training rows have a text and a language, and crc32(doc_id as text) mod 5 is not 0; the rest is held out. A
prediction sees the text only.

Defined cases: a null text or one without a letter is `und` with score 0; without training rows everything is `und`;
with one language its score is 1; a null doc_id counts as an empty text for the split (held out); repeated rows are
predicted one by one; very long texts are read in blocks; an empty table gives an empty result. More than LANGUAGES
languages raise ValueError, so that the weights have a bound.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import map_arrow, worker_cache

BITS, ORDERS = 15, 3
SAMPLE, LANGUAGES, FOLDS = 4000, 256, 5
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 1e-4
BLOCK = 1 << 20
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _letters() -> np.ndarray:
    """Which code points are letters; made once in a worker."""
    kept = worker_cache()
    if "letters" not in kept:
        kept["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return kept["letters"]


def counts(text: str) -> tuple[np.ndarray, bool]:
    """How often each feature occurs in a text, and whether it has a letter."""
    out, any_letter, carry = np.zeros(1 << BITS, np.int64), False, np.array([32], np.uint32)
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        any_letter |= bool(letter.any())
        codes = np.where(letter, codes, np.uint32(32))
        first = np.concatenate([carry[-1:], codes])
        codes = codes[(codes != 32) | (first[:-1] != 32)]
        run = np.concatenate([carry, codes])
        mixed = np.zeros(len(codes), np.uint32)
        for n in range(ORDERS):
            skip = len(carry) - n  # the character n places before each new one
            if skip >= 0:
                part = run[skip : skip + len(codes)]
                mixed = mixed + part * _MIX[n] + np.uint32(n)
                now = mixed
            else:
                part = run[: len(codes) + skip]
                mixed = mixed[-skip:] + part * _MIX[n] + np.uint32(n)
                now = mixed
                mixed = np.concatenate([np.zeros(-skip, np.uint32), mixed])
            out += np.bincount(((now ^ (now >> np.uint32(15))) * _MIX[1]) >> np.uint32(32 - BITS), minlength=1 << BITS)
        carry = run[-(ORDERS - 1) :]
    return out, any_letter


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return "und", 0.0
        found, letter = counts(text)
        if not letter:
            return "und", 0.0
        p = _softmax(_logits(vector(found, self.idf), self.weights, self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(min(max(p[best], 0.0), 1.0))


def vector(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(found)
    x = np.log1p(found[at]) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def _logits(x: tuple[np.ndarray, np.ndarray], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return x[1] @ weights[x[0]] + bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each feature occurs, and how many there are: a vector from each task, summed by Spark."""

    def run(batches):
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += counts(text)[0] > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["feature", "n"])

    summed = map_arrow(rows.select("text"), run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, np.int64)
    real = summed[summed.feature >= 0]
    out[real.feature.to_numpy()] = real.n.to_numpy()
    return out, int(summed.n[summed.feature < 0].sum())


def _sample(rows: DataFrame) -> list[tuple[str, bytes]]:
    """(language, counts) of at most SAMPLE rows, as many for each language, in an order that doc_ids decide."""
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return []
    each = SAMPLE // len(sizes)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.3 * each / n + 10 / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1_000_000))

    def run(batches):
        for batch in batches:
            packed = []
            for text in batch.column("text").to_pylist():
                found, _ = counts(text)
                at = np.flatnonzero(found)
                packed.append(np.stack([at, np.minimum(found[at], 2**31 - 1)]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), batch.column("doc_id"), pa.array(packed, pa.binary())], ["lang", "place", "doc_id", "found"])

    chosen = rows.select("doc_id", "lang", "text", place.alias("place")).where(F.col("place") < share * 1_000_000)
    taken = map_arrow(chosen, run, "lang string, place long, doc_id long, found binary").toPandas().sort_values(["place", "doc_id", "lang"])
    taken = taken.groupby("lang", sort=False).head(each)
    return list(zip(taken["lang"], map(bytes, taken["found"])))


def fit(docs: DataFrame) -> Model:
    """Fit on the training rows of docs (doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sample = _sample(rows)
    if not sample:
        return Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 1.0)
    frequency, n = _frequencies(rows)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    languages = sorted({lang for lang, _ in sample})
    index = {lang: i for i, lang in enumerate(languages)}
    data = []
    for lang, packed in sample:
        at, found = np.frombuffer(packed, np.int32).reshape(2, -1)
        x = np.log1p(found) * idf[at]
        data.append((at, x / max(float(np.sqrt(x @ x)), 1e-12), index[lang]))
    apart = [d for i, d in enumerate(data) if i % FOLDS == 0] if len(data) >= 10 * FOLDS else []
    train = [d for i, d in enumerate(data) if i % FOLDS] if apart else data
    weights, bias = _ftrl(train, len(languages))
    return Model(languages, idf, weights, bias, _temperature(apart, weights, bias))


def _ftrl(train, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    size = (1 << BITS) + 1  # the last is the bias
    z, n = np.zeros((size, n_classes)), np.zeros((size, n_classes))

    def weights_at(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(train)):
            at, x, label = train[i]
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = weights_at(at)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights_at(np.arange(size))
    return w[:-1], w[-1]


def _temperature(apart, weights: np.ndarray, bias: np.ndarray) -> float:
    """The divisor of the scores with the least log loss on rows that weren't fitted."""
    if not apart:
        return 1.0
    scores = np.array([_logits((at, x), weights, bias) for at, x, _ in apart])
    labels = np.array([label for *_, label in apart])

    def loss(t):
        p = _softmax(scores / t)[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    grid = np.exp(np.linspace(np.log(0.2), np.log(5.0), 65))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs; the model has at most LANGUAGES x 2**BITS weights."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        own = Model(**shared.value)
        for batch in batches:
            found = [own.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def describe(model: Model) -> str:
    return json.dumps({"languages": model.languages, "nonzero": int((model.weights != 0).sum()), "temperature": round(model.temperature, 3)})


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns, whose language is recognised with a score of at least `least`; all rows with a
    letter if the model has no language."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        own = Model(**shared.value)
        for batch in batches:
            kept = []
            for text in batch.column("text").to_pylist():
                lang, score = own.predict(text) if own.languages else (("any", 1.0) if text and any(map(str.isalpha, text)) else ("und", 0.0))
                kept.append(lang != "und" and score >= least)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
