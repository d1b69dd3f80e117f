"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers case, strips accents, maps look-alike letters to Latin ones and digits and signs inside
words to the letters they stand for. The lexicon has words and word beginnings, each with a weight:
fixed seeds, and what the labels teach. The longest entry that matches a word counts, unless an
exception phrase covers it. A text's weights are summed, divided by its length in words, and mapped to
a probability by a logistic curve fitted on rows that taught no weight.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .labelled import bounded_sample, held_out

# Insults that count from the start, with one weight.
SEEDS = "asshole bastard clown cretin degenerate disgusting dumbass filth freak garbage idiot imbecile jerk loser lowlife maggot moron pathetic pig rat scum scumbag sleazy slob stupid trash ugly vermin vile worthless wretch".split()
SEED_WEIGHT = 4.0
# Phrases in which a lexicon word is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "garbage can", "garbage collection", "garbage collector", "garbage truck", "clown fish", "class clown", "guinea pig", "pig iron", "rat race", "lab rat", "ugly duckling", "control freak", "freak accident", "knee jerk", "jerk chicken")
# Look-alikes of Latin letters, and what digits and signs stand for.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ɑ": "a", "ı": "i", "ο": "o", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e", "£": "l"}

_ASCII = str.maketrans(DIGITS)
_ALL = str.maketrans({**DIGITS, **LOOK_ALIKES, **{chr(c): None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, *range(0x300, 0x370))}})
_SIGN = re.compile(r"(?<=[^\W_])[@$!|+€£](?=[^\W_])")
_GAP = re.compile(r"[\W_]+")
PREFIXES = range(5, 9)


def fold(text: str | None) -> str:
    """The text's folded words, one space before, between and after; a single space for a text without words."""
    text = (text or "").lower()
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    text = text.translate(_ASCII) if text.isascii() else unicodedata.normalize("NFKD", text).translate(_ALL)
    return f" {_GAP.sub(' ', text).strip()} ".replace("  ", " ")


@dataclass
class Lexicon:
    """words and beginnings, folded, with weights; curve: the logistic's bias and slopes."""

    words: dict[str, float]
    beginnings: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 0.0, 2.0)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for phrase in self.exceptions:
            key = fold(phrase)
            a.add_word(key, (len(key), None, True))
        for table, end in ((self.beginnings, ""), (self.words, " ")):
            for entry, weight in table.items():
                key = f" {entry}{end}"
                if not a.exists(key):
                    a.add_word(key, (len(key), weight, False))
        a.make_automaton()
        return a

    def hits(self, folded: str) -> dict[int, float]:
        """Weight of the longest entry at each matched word, by the word's place, without excepted ones."""
        found: dict[int, tuple[int, float]] = {}
        excepted: list[tuple[int, int]] = []
        if len(self.automaton):
            for end, (length, weight, exception) in self.automaton.iter(folded):
                begin = end - length + 1
                if exception:
                    excepted.append((begin, end))
                elif length > found.get(begin, (0, 0.0))[0]:
                    found[begin] = (length, weight)
        for begin, end in excepted:
            for at in [at for at in found if begin <= at < end]:
                del found[at]
        return {at: weight for at, (_, weight) in found.items() if weight > 0}

    def density(self, text: str | None) -> float:
        """Summed weights per word; ten words are added to every length, so that one hit doesn't fill a short text."""
        folded = fold(text)
        total = sum(self.hits(folded).values())
        return 100 * total / (folded.count(" ") - 1 + 10) if total else 0.0

    def score(self, text: str | None) -> float:
        d = self.density(text)
        b, linear, log = self.curve
        return float(1 / (1 + np.exp(-np.clip(b + linear * d + log * np.log1p(d), -30, 30))))


def fit_curve(density: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> tuple[float, float, float]:
    """Logistic regression of y on the density's logarithm, by Newton steps; the slope is not negative."""
    x = np.column_stack((np.ones_like(density), np.log1p(density)))
    w, penalty = np.zeros(2), np.diag([0.0, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty @ w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), 0.0, float(max(0.0, w[1]))


_COUNTS = "entry string, whole boolean, toxic_docs long, clean_docs long, toxic_hits long, clean_hits long"


def entry_counts(rows: DataFrame, flush: int = 200_000) -> DataFrame:
    """``rows`` has text and y. For each folded word and word beginning: documents and hits by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bool], list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.bool_())]
            return pa.record_batch([*columns, *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(4))], names=["entry", "whole", "toxic_docs", "clean_docs", "toxic_hits", "clean_hits"])

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                entries: Counter = Counter()
                for word, n in Counter(fold(text.as_py()).split()).items():
                    if len(word) > 2:
                        entries[word, True] += n
                    for k in PREFIXES:
                        if k < len(word):
                            entries[word[:k], False] += n
                at = 0 if y else 1
                for key, n in entries.items():
                    v = seen.setdefault(key, [0, 0, 0, 0])
                    v[at] += 1
                    v[at + 2] += n
                if len(seen) > flush:
                    yield out()
                    seen.clear()
        yield out()

    return rows.mapInArrow(run, _COUNTS).groupBy("entry", "whole").agg(*[F.sum(c).alias(c) for c in ("toxic_docs", "clean_docs", "toxic_hits", "clean_hits")])


def learn(texts: DataFrame, marks: DataFrame, per_class: int = 5000, least_docs: int = 3, least_z: float = 3.0) -> Lexicon:
    """``texts`` has id, text; ``marks`` id, y (0 or 1). The lexicon and its curve come from a sample of about
    ``per_class`` rows a label, whole texts, one half each; what is learnt is bounded by the sample's words."""
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    seeds = {fold(w).strip(): SEED_WEIGHT for w in SEEDS}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon(seeds)
    drawn = bounded_sample(marks, "y", "id", per_class).withColumn("half", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(2)))
    sample = materialise(texts.join(F.broadcast(drawn), "id"), "toxic-sample")  # the sample's bound holds for what is broadcast
    teaching = sample.filter("half = 0").select("text", "y")
    n = {r["y"]: r["n"] for r in teaching.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    a, b = F.col("toxic_docs") + 0.5, F.col("clean_docs") + 0.5
    odds = F.log(a / (toxic + 1)) - F.log(b / (clean + 1))
    scored = entry_counts(teaching).withColumn("weight", odds).withColumn("z", odds / F.sqrt(1 / a + 1 / b))
    found = scored.filter((F.col("toxic_docs") >= least_docs) & (F.col("z") >= least_z) & (F.col("weight") >= 1.5)).collect()  # of the sample's words
    words, beginnings = dict(seeds), {}
    for r in found:
        (words if r["whole"] else beginnings)[r["entry"]] = float(min(r["weight"], 8.0))
    if beginnings:  # a whole word that is no sign of toxicity stays none, though its beginning is
        started = F.lit(False)
        for k in PREFIXES:
            started = started | F.substring("entry", 1, k).isin([p for p in beginnings if len(p) == k] or [""])
        for r in scored.filter(F.col("whole") & started & (F.col("clean_docs") >= 5)).filter("weight < 1.5").collect():
            words.setdefault(r["entry"], 0.0)
    lexicon = Lexicon(words, beginnings)
    held = lexicon

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([held.density(t.as_py()) for t in batch.column(0)], pa.float64()), batch.column(1)], names=["density", "y"])

    rows = sample.filter("half = 1").select("text", F.col("y").cast("int").alias("y")).mapInArrow(measure, "density double, y int").toArrow()
    density, y = rows["density"].to_numpy(), rows["y"].to_numpy().astype(float)
    order = np.lexsort((y, density))
    density, y = density[order], y[order]
    if 0 < y.sum() < len(y):
        share = {k: sizes[k] / max(1, (y == k).sum()) for k in (0, 1)}
        weight = np.where(y == 1, share[1], share[0])
        return Lexicon(words, beginnings, curve=fit_curve(density, y, weight * len(y) / weight.sum()))
    return lexicon


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 5000) -> DataFrame:
    """One row per row of ``df``: id, held_out, score, predicted.

    Labels of held-out rows teach nothing. A null or empty text has no hits and gets the curve's lowest
    score; a null label teaches nothing; without labels of both kinds the seeds alone count; repeated rows
    come out each; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    lexicon = learn(texts, marks.groupBy("id").agg(F.max("y").alias("y")), per_class)
    held = df.sparkSession.sparkContext.broadcast(Lexicon(lexicon.words, lexicon.beginnings, lexicon.exceptions, lexicon.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([held.value.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["id", "score"])

    scored = texts.mapInArrow(run, texts.select("id").schema.add("score", "double"))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
