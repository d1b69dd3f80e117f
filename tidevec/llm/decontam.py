"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

Each document is cut into overlapping passages, so that an item of any length lies whole in one. A
passage's different words are a query; block-max WAND retrieves every item whose score reaches a share
of the item's best possible score (its own text's). Each retrieved item is verified in windows twice as
long as itself: one must score that share, and the words of the item's question and those of its answer
must each be found in it, in order. So what is found doesn't depend on how long other items are.

An item's impacts are divided by its own threshold, so one threshold (1) holds for all items and term
bounds compare across items.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise

K1, B = 1.2, 0.75
LEAST_WORDS = 5
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str | None, answer_share: float = 0.3) -> tuple[list[str], list[str]]:
    """An item's question and answer: an answer after a line that begins with ``Answer``/``A:`` if there is one,
    else the last ``answer_share`` of the words."""
    parts = re.split(r"\n\s*(?:answer|a)\s*[:.]", text or "", maxsplit=1, flags=re.I)
    if len(parts) == 2 and words(parts[0]) and words(parts[1]):
        return words(parts[0]), words(parts[1])
    found = words(text)
    cut = len(found) - max(1, math.ceil(len(found) * answer_share)) if len(found) > 1 else len(found)
    return found[:cut], found[cut:]


def in_order(needle: list[str], hay: list[str]) -> float:
    """Share of ``needle`` that is a common subsequence with ``hay``; 1 for an empty needle."""
    if not needle:
        return 1.0
    wanted = set(needle)
    row = [0] * (len(needle) + 1)
    for h in hay:
        if h not in wanted:
            continue
        diagonal = 0
        for k, n in enumerate(needle, 1):
            above = row[k]
            row[k] = diagonal + 1 if n == h else max(above, row[k - 1])
            diagonal = above
    return row[-1] / len(needle)


@dataclass
class Statistics:
    """Of all items with words: their number, their words, the words of the longest, and for words the items that hold them."""

    items: int
    words: int
    longest: int
    holding: dict[str, int]


@dataclass
class Index:
    """items: (id, words); postings by term, in item order, in blocks with their largest impact; ``statistics`` are
    of all items, where these are a part of them."""

    ids: list[int | None]
    texts: list[list[str]]
    splits: list[tuple[list[str], list[str]]]
    share: float = 0.6
    block: int = 8
    statistics: Statistics | None = None
    terms: dict[str, int] = field(init=False)
    postings: list[list[tuple[int, float]]] = field(init=False)

    def __post_init__(self) -> None:
        self.terms, self.postings = {}, []
        if self.statistics is None:
            self.statistics = Statistics(len(self.texts), sum(map(len, self.texts)), max(map(len, self.texts), default=0), Counter(w for text in self.texts for w in set(text)))
        n, holding = self.statistics.items, self.statistics.holding
        average = self.statistics.words / n if n else 1.0
        for item, text in enumerate(self.texts):
            weight = {w: math.log(1 + (n - holding[w] + 0.5) / (holding[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(text) / average)) for w, c in Counter(text).items()}
            best = sum(weight.values())
            for w, x in sorted(weight.items()):
                if w not in self.terms:
                    self.terms[w] = len(self.postings)
                    self.postings.append([])
                self.postings[self.terms[w]].append((item, x / (self.share * best)))

    @cached_property
    def impacts(self) -> list[dict[str, float]]:
        """Each item's impacts by word."""
        out: list[dict[str, float]] = [{} for _ in self.ids]
        for w, t in self.terms.items():
            for item, x in self.postings[t]:
                out[item][w] = x
        return out

    @cached_property
    def bounds(self) -> np.ndarray:
        """Each term's largest impact."""
        return np.array([max(x for _, x in p) for p in self.postings] or [0.0], np.float64)

    @cached_property
    def lists(self) -> list[tuple[list[int], list[float], list[int], list[float]]]:
        """For each term: items, impacts, and for each of its blocks the last item and the largest impact."""
        out = []
        for p in self.postings:
            cut = [p[k : k + self.block] for k in range(0, len(p), self.block)]
            out.append(([i for i, _ in p], [x for _, x in p], [c[-1][0] for c in cut], [max(x for _, x in c) for c in cut]))
        return out

    @cached_property
    def ranges(self) -> np.ndarray:
        """[term, range of items]: the largest impact of the term in that range; ranges are as long as 64 make them."""
        n = max(1, min(64, len(self.ids)))
        wide = np.zeros((len(self.postings), n), np.float32)
        for t, p in enumerate(self.postings):
            for item, x in p:
                at = item * n // len(self.ids)
                wide[t, at] = max(wide[t, at], x)
        return wide * (1 + 1e-6)

    @cached_property
    def screen(self) -> tuple[dict[str, int], np.ndarray]:
        """The terms that screen passages, and what a range must reach by them: the terms of the least impact,
        which are the most common words, are left out, and all that they could add is taken off the threshold."""
        off, total = set(), np.zeros(self.ranges.shape[1], np.float32)
        for t in np.argsort(self.bounds, kind="stable").tolist():
            total = total + self.ranges[t]
            if total.max() > 0.35:
                total = total - self.ranges[t]
                break
            off.add(t)
        return {w: t for w, t in self.terms.items() if t not in off}, 1 - 1e-4 - total

    def retrieve(self, query: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
        """(item, score) of every item that scores ``threshold`` or more for the terms, by block-max WAND."""
        bounds, lists, found = self.bounds, self.lists, []
        cursors = [[lists[t][0][0], 0, t] for t in query]  # item at the cursor, its place, the term
        slack = 1e-9
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                total += bounds[t]
                if total >= threshold - slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            reach, last = 0.0, None
            for _, _, t in cursors[: pivot + 1]:
                ends, most = lists[t][2], lists[t][3]
                b = bisect_left(ends, item)
                if b < len(ends):
                    reach += most[b]
                    last = ends[b] if last is None else min(last, ends[b])
            if reach < threshold - slack:  # no item up to the end of these blocks, or the next cursor's item, can reach it
                beyond = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else None
                target = last + 1 if last is not None else item + 1
                target = max(item + 1, target if beyond is None else min(target, beyond))
                self._advance(cursors, pivot + 1, target)
            elif cursors[0][0] == item:
                score = sum(lists[t][1][at] for _, at, t in cursors[: pivot + 1])
                if score >= threshold - slack:
                    found.append((item, score))
                self._advance(cursors, pivot + 1, item + 1)
            else:
                self._advance(cursors, pivot, item)
        return found

    def _advance(self, cursors: list[list[int]], count: int, target: int) -> None:
        """Move the first ``count`` cursors to ``target`` or beyond; drop those at their end."""
        for c in cursors[:count]:
            items = self.lists[c[2]][0]
            c[1] = bisect_left(items, target, c[1])
            c[0] = items[c[1]] if c[1] < len(items) else -1
        cursors[:] = [c for c in cursors if c[0] >= 0]

    @property
    def passage(self) -> int:
        """Words in a passage, an even number: twice the longest item, so that half of a passage holds any item."""
        return max(64, 2 * self.statistics.longest)

    def _reachable(self, ids: np.ndarray, half: np.ndarray, most: int = 64) -> Iterator[int]:
        """Passages in which some range of items can reach the threshold; passage k is halves k and k + 1 of the
        text, and ``half`` has each term's. Terms count once a half; ``most`` halves are summed at a time."""
        terms, n = len(self.postings), int(half[-1]) + 1
        sums = np.zeros((n + 1, self.ranges.shape[1]), np.float32)
        for k in range(0, n, most):
            a, b = np.searchsorted(half, (k, k + most))
            once = np.unique(half[a:b] * terms + ids[a:b])
            if len(once):
                which, first = np.unique(once // terms, return_index=True)
                sums[which] = np.add.reduceat(self.ranges[once % terms], first, axis=0)
        yield from np.flatnonzero((sums[:-1] + sums[1:] >= self.screen[1]).any(axis=1)).tolist()

    def matches(self, text: str | None, overlap: float = 0.8) -> dict[int, tuple[float, float, float, int]]:
        """For each item found in the text: (share of its best score, question overlap, answer overlap, first word of the window)."""
        if not self.postings:
            return {}
        found = words(text)
        known = np.fromiter(map(self.screen[0].get, found, repeat(-1)), np.int64, len(found))
        at = np.flatnonzero(known >= 0)
        if not len(at):
            return {}
        ids, size = known[at], self.passage
        out: dict[int, tuple[float, float, float, int]] = {}
        tried: dict[int, int] = {}  # for each item, the first of its windows that isn't tried
        for k in self._reachable(ids, at // (size // 2)):
            begin = k * (size // 2)
            passage = found[begin : begin + 2 * (size // 2)]
            query = np.array(sorted({self.terms[w] for w in passage if w in self.terms}), np.int64)
            if self.ranges[query].sum(axis=0).max() < 1 - 1e-6:
                continue
            for item, _ in self.retrieve(query.tolist()):
                step = len(self.texts[item])
                # windows that the passage overlaps: they begin at multiples of the item's length and are twice as long
                first, last = max(0, begin // step - 1, tried.get(item, 0)), (begin + len(passage) - 1) // step
                tried[item] = max(last + 1, tried.get(item, 0))
                for j in range(first, last + 1):
                    window = found[j * step : (j + 2) * step]
                    if step < LEAST_WORDS and found != self.texts[item]:
                        break
                    share, q, a = self._verify(item, window, overlap)
                    if q >= overlap and a >= overlap and (share, q, a) > out.get(item, (0.0, 0.0, 0.0, 0))[:3]:
                        out[item] = (share, q, a, j * step)
        return out

    def _verify(self, item: int, window: list[str], overlap: float) -> tuple[float, float, float]:
        """The window's share of the item's best score and its overlaps with question and answer; zeros below the shares asked."""
        impacts, (question, answer) = self.impacts[item], self.splits[item]
        score = sum(impacts[w] for w in sorted(impacts.keys() & set(window)))
        if score < 1 - 1e-9 or (q := in_order(question, window)) < overlap:
            return 0.0, 0.0, 0.0
        return score * self.share, q, in_order(answer, window)


def build_index(rows: list, share: float = 0.6, statistics: Statistics | None = None) -> Index:
    """An index of (id, text) rows; items without words are left out, as nothing can match them."""
    kept = sorted(((r[0], r[1]) for r in rows if words(r[1])), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return Index([i for i, _ in kept], [words(t) for _, t in kept], [question_and_answer(t) for _, t in kept], share, statistics=statistics)


def item_blocks(items: DataFrame, id_col: str, text_col: str, most_bytes: int = 32 << 20) -> list[DataFrame]:
    """The items in parts of about ``most_bytes`` of text at most: each part's index is sent to all tasks."""
    picked = items.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = picked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // most_bytes))
    return [picked.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k) for k in range(n)]


def indexes(items: DataFrame, id_col: str, text_col: str, share: float) -> Iterator[Broadcast]:
    """An index of each part of the items, by the statistics of all."""
    spark, parts = items.sparkSession, item_blocks(items, id_col, text_col)
    if len(parts) == 1:
        yield spark.sparkContext.broadcast(build_index([tuple(r) for r in parts[0].collect()], share))
        return

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(words(t.as_py())) for t in batch.column(0)]
            yield pa.record_batch([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64()), pa.array([max(n, default=0)], pa.int64())], names=["items", "words", "longest"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(w for t in batch.column(0) for w in set(words(t.as_py())))
            yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def counted(part: DataFrame) -> DataFrame:
        return part.select("text").mapInArrow(held, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    texts = items.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    total = texts.mapInArrow(sizes, "items long, words long, longest long").agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("items"), F.sum("words"), F.max("longest"))]).first()
    every = materialise(counted(texts), "item-words")
    for part in parts:
        holding = dict(every.join(counted(part).select("word"), "word", "left_semi").toArrow().to_pandas().itertuples(index=False, name=None))
        yield spark.sparkContext.broadcast(build_index([tuple(r) for r in part.collect()], share, Statistics(*total, holding)))


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """A row per document and item found in it: id, item_id, score_share, question_overlap, answer_overlap, passage_start.

    A null or empty text, or item, matches nothing; of items with one id each can match, and one without
    an id can, too; an item of fewer than five words only matches a text of just its words, as
    its words in order say nothing in a longer one; repeated rows come out each; without items or documents there are no rows; other columns
    are ignored, whatever their names. Tables of items beyond a block are matched block by block, to the same result.
    """
    picked = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"`{id_col}` long, item_id long, score_share double, question_overlap double, answer_overlap double, passage_start long"
    result = None
    for held in indexes(items, item_id, item_text, share):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                rows = [(doc, index.ids[item], *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for item, m in sorted(index.matches(text.as_py(), overlap).items())]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[id_col, "item_id", "score_share", "question_overlap", "answer_overlap", "passage_start"])

        found = picked.mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    return result


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """``df`` without the documents in which an item is found; all columns stay, nothing is shuffled."""
    at = df.columns.index(text_col)
    for held in indexes(items, item_id, item_text, share):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = pa.array([not held.value.matches(t.as_py(), overlap) for t in batch.column(at)], pa.bool_())
                yield batch.filter(clean)

        df = df.mapInArrow(run, df.schema)
    return df
