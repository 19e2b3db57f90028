"""Language identification: multinomial logistic regression on TF-IDF of
character n-grams, trained with follow-the-regularised-leader under an elastic
net, its probabilities calibrated by a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Hashed n-gram features; bounds the weights that executors get.
FEATURES = 1 << 14

LONGEST = 3

#: Labelled documents, in expectation, that the classifier is fitted on; all
#: labelled ones give the document frequencies.
SAMPLE = 4000

HELD_OUT = 2

#: Languages that a model may have: 16 thousand doubles each.
MOST_LANGS = 200

UNKNOWN = "und"

_U = np.uint64
_SHIFT = _U(64 - FEATURES.bit_length() + 1)
# Odd multipliers, one for each place in an n-gram.
_MULTIPLIERS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(feature numbers, counts) of the n-grams of a whole text, or None if it
    has no letter. Runs of other characters count as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)[keep].astype(_U)
    codes = np.concatenate([np.array([32], _U), codes])
    grams = []
    total = np.zeros(len(codes), _U)
    for k in range(min(LONGEST, len(codes))):
        n = len(codes) - k
        total = total[:n] + codes[k:] * _MULTIPLIERS[k]
        mixed = (total ^ (total >> _U(29))) * _U(0xBF58476D1CE4E5B9 + 2 * k)
        grams.append((mixed >> _SHIFT).astype(np.int64))
    counts = np.bincount(np.concatenate(grams), minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / np.sqrt((x * x).sum())


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.weights[at].T @ x + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        own = features(text) if text else None
        if own is None or not self.langs:
            return UNKNOWN, 0.0
        z = self.logits(own[0], weighted(*own, self.idf)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 3) -> np.ndarray:
    """Weights (features and a bias, by class) by FTRL-proximal.

    ``l1`` and ``l2`` are the elastic net's penalties; the bias has none.
    """
    z = np.zeros((FEATURES + 1, classes))
    n = np.zeros((FEATURES + 1, classes))
    for _ in range(epochs):
        for label, at, x in rows:
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            own_z, own_n = z[at], n[at]
            lasso = np.full((len(at), 1), l1)
            lasso[-1] = 0
            w = np.where(np.abs(own_z) > lasso, (np.sign(own_z) * lasso - own_z) / ((beta + np.sqrt(own_n)) / alpha + l2), 0.0)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / alpha * w
            n[at] += g * g
    lasso = np.full((FEATURES + 1, 1), l1)
    lasso[-1] = 0
    return np.where(np.abs(z) > lasso, (np.sign(z) * lasso - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section."""

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), labels]).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _texts(batches) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        yield batch, batch.column(batch.num_columns - 1)


def _frequencies(batches):
    """(feature, documents) of a partition; feature -1 counts the documents."""
    seen, n = np.zeros(FEATURES, np.int64), 0
    for _, texts in _texts(batches):
        for text in texts:
            own = features(text.as_py())
            if own:
                seen[own[0]] += 1
                n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())], names=["feature", "n"])


def _examples(batches):
    for batch, texts in _texts(batches):
        langs, ats, counts = [], [], []
        for lang, text in zip(batch.column(0), texts, strict=True):
            own = features(text.as_py())
            if own:
                langs.append(lang.as_py())
                ats.append(own[0].astype(np.int32))
                counts.append(np.minimum(own[1], 2**31 - 1).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(ats, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["lang", "at", "counts"]
        )


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4 == HELD_OUT


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on documents with a language that aren't held out.

    Document frequencies come from all of them. The classifier is fitted on
    about ``sample`` of them, spread over the languages by a hash of the id;
    a fifth of the sample sets the temperature. No documents: no languages.
    More than ``MOST_LANGS`` of them are an error: the model has weights for
    each, and such labels aren't languages.
    """
    own = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    own = own.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, F.lit(3)).alias("h"), F.col(text_col).alias("text"))
    labels = written(own.groupBy("lang").count(), "languages")
    if labels.count() > MOST_LANGS:
        raise ValueError(f"{lang_col} has more than {MOST_LANGS} values")
    counts = {r[0]: r[1] for r in labels.collect()}
    if not counts:
        return Model([], np.ones(FEATURES), np.zeros((FEATURES + 1, 0)))
    frequency = own.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES)
    for r in frequency:
        if r["feature"] >= 0:
            df[r["feature"]] = r["n"]
    total = sum(r["n"] for r in frequency if r["feature"] < 0)
    idf = np.log((1 + total) / (1 + df)) + 1

    quota = -(-sample // len(counts))
    share = own.sparkSession.createDataFrame([(k, min(1.0, quota / n)) for k, n in counts.items()], "lang string, share double")
    chance = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = own.join(F.broadcast(share), "lang").filter(chance < F.col("share")).select("lang", "text")
    table = picked.mapInArrow(_examples, "lang string, at array<int>, counts array<int>").toArrow()

    langs = sorted(counts)
    number = {k: i for i, k in enumerate(langs)}
    rows = []
    for lang, at, n in zip(table.column(0).to_pylist(), table.column(1), table.column(2), strict=True):
        at = at.values.to_numpy()
        rows.append((number[lang], at, weighted(at, n.values.to_numpy(), idf)))
    order = np.random.default_rng(11).permutation(len(rows))
    # the same order whatever order the rows came in
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    rows = [rows[k] for k in order]
    kept = rows[: max(1, len(rows) * 4 // 5)]
    model = Model(langs, idf, fit(kept, len(langs)))
    if check := rows[len(kept) :]:
        model.temperature = temperature(np.array([model.logits(at, x) for _, at, x in check]), np.array([r[0] for r in check]))
    return model


def _predict(model: Model):
    def run(batches):
        for batch, texts in _texts(batches):
            got = [model.predict(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is ``und`` with score 0 for a text that is null or has no
    letter, and for all texts if nothing could be learned. A null id is neither
    held out nor learned from. Very long texts are read whole; of equally
    likely languages the first in code point order is predicted. Repeated rows
    are predicted like others; other columns are ignored; an empty table stays
    empty.
    """
    model = model or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
