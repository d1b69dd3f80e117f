"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learnt by follow-the-regularised-leader with elastic-net penalties (the L1 part keeps them
sparse), then a temperature fitted on rows that taught no weight calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import give_back
from .labelled import bounded_sample, held_out

UNKNOWN = "und"
FEATURE_BITS = 15
ORDERS = (1, 2, 3)
# Odd multipliers of the n-gram hash, one for each place.
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)
_PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    """Lower-case code points, with each run of other characters than letters as one space, and a space at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]
    return np.where(letter, codes, 32)[kept].astype(np.uint32)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of a whole text; nothing for a text without a letter."""
    counts = np.zeros(1 << FEATURE_BITS, np.int64)
    codes = _codes(text or "")
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    widest = max(ORDERS)
    for at in range(0, len(codes), _PIECE):  # a piece at a time bounds memory for texts of any length
        piece = codes[at : at + _PIECE + widest - 1]
        for n in ORDERS:
            m = min(len(piece) - n + 1, _PIECE)
            if m <= 0:
                continue
            h = np.full(m, n * 40503, np.uint32)
            for k in range(n):
                h = (h ^ (piece[k : k + m] * _MULTIPLIERS[k])) * _MULTIPLIERS[3]
                h ^= h >> np.uint32(15)
            counts += np.bincount(h & np.uint32((1 << FEATURE_BITS) - 1), minlength=1 << FEATURE_BITS)
    features = np.flatnonzero(counts)
    return features, counts[features]


@dataclass
class Ftrl:
    """FTRL-proximal for multinomial logistic regression; l1 and l2 make the elastic net."""

    classes: int
    features: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros((self.classes, self.features)), np.zeros((self.classes, self.features))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[y] -= 1
        g = p[:, None] * x[None, :]
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    """languages[i] has the weights in row i; idf and weights by feature; the last feature is the bias."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(counts)) * self.idf[features]
        return np.append(features, 1 << FEATURE_BITS), np.append(x / max(np.sqrt(x @ x), 1e-12), 0.1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); und and 0 for a text that is null or has no letter."""
        features, counts = ngram_counts(text)
        if not len(features) or not self.languages:
            return UNKNOWN, 0.0
        at, x = self.vector(features, counts)
        p = softmax((self.weights[:, at] @ x) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden-section search."""

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean())

    a, b, g = np.log(0.002), np.log(50.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Of the one text column: texts with a letter, and for each feature the texts that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << FEATURE_BITS) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                features, _ = ngram_counts(text.as_py())
                seen[features] += 1
                seen[-1] += len(features) > 0
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at), pa.array(seen[at])], names=["feature", "texts"])

    rows = texts.mapInArrow(run, "feature long, texts long").groupBy("feature").agg(F.sum("texts").alias("texts")).collect()
    found = np.zeros((1 << FEATURE_BITS) + 1, np.int64)
    for r in rows:
        found[r["feature"]] = r["texts"]
    return int(found[-1]), found[:-1]


def train(labelled: DataFrame, per_class: int = 1000, epochs: int = 3, calibration: float = 0.2) -> LanguageModel:
    """``labelled`` has id, text, lang (not null). Weights and temperature are fitted on a sample of about
    ``per_class`` rows a language, whole texts; document frequencies are counted over all rows."""
    total, df = document_frequencies(labelled.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_counts(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0), pa.array([f.astype(np.int32) for f, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32())), batch.column(2)],
                names=["draw", "features", "counts", "lang"],
            )

    sample = bounded_sample(labelled, "lang", "id", per_class).select(F.xxhash64("id", F.lit(11)).alias("draw"), "text", "lang")
    rows = sample.mapInArrow(run, "draw long, features array<int>, counts array<int>, lang string").toArrow().sort_by([("draw", "ascending"), ("lang", "ascending")])
    languages = sorted(set(rows["lang"].to_pylist()))
    model = LanguageModel(languages, idf, np.zeros((len(languages), (1 << FEATURE_BITS) + 1)))
    xs, ys = [], []
    for f, c, lang in zip(rows["features"], rows["counts"], rows["lang"].to_pylist(), strict=True):
        f, c = f.values.to_numpy(), c.values.to_numpy()
        if len(f):
            xs.append(model.vector(f.astype(np.int64), c.astype(np.int64)))
            ys.append(languages.index(lang))
    if not xs:
        return LanguageModel([], idf, model.weights[:0])
    apart = int(len(xs) * calibration)
    ftrl = Ftrl(len(languages), (1 << FEATURE_BITS) + 1)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(np.arange(apart, len(xs))):
            ftrl.learn(*xs[k], ys[k])
    model.weights = ftrl.weights()
    if apart >= 20:
        model.temperature = _temperature(np.array([model.weights[:, at] @ x for at, x in xs[:apart]]), np.array(ys[:apart]))
    return model


def identify(texts: DataFrame, model: LanguageModel, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with lang_pred and score; texts are read whole, where they lie."""
    kept = texts.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = kept.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    held = kept.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.predict(t.as_py()) for t in batch.column(len(keep))]
            yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def train_on(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = 1000) -> LanguageModel:
    """A model of the rows of ``df`` that have a language and aren't held out. No such row: a model that knows none."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    model = train(rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("id"))), per_class)
    give_back()  # the sample's vectors, of all steps that follow on the driver
    return model


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = 1000) -> DataFrame:
    """One row per row of ``df``: id, held_out, lang_pred, score.

    Null and letterless texts are ``und`` with score 0, as is all if no row teaches; ties go to the first
    language by name; repeated rows come out each; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    model = train_on(df, id_col, text_col, lang_col, per_class)
    return identify(df, model, id_col, text_col, [id_col]).select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """``df`` without the rows whose text is ``und`` or whose language scores under ``least``; all columns stay, nothing is shuffled."""
    held, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))
        give_back()  # this worker stays, idle, beside the executor's next stages

    return df.mapInArrow(run, df.schema)
