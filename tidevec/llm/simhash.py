"""SimHash near-duplicates by tiled exact comparison.

Every different fingerprint is compared with numpy exclusive-or and bit counts, a tile of rows against
a tile of rows; a tile pair whose population counts differ by more than the radius is skipped, as its
fingerprints must differ in more bits than that. Tiles are dealt to tasks by parts: 64 bits are cut
into radius + 2 parts, so two fingerprints within the radius agree on at least two whole parts, and
fingerprints meet in the tiles of each pair of parts that they share. No link is lost, and work grows
with the fingerprints that share parts instead of with all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, give_back, materialise
from .bits import bit_table, marked
from .components import components
from .skew import salted_join

TILE = 256
_CHUNK = 1 << 15
#: Rows of bands and of prefixes that a round has at least, and the most rounds of prefixes.
ROUND, ROUNDS = 4_000_000, 8
#: Pairs that a round compares at least.
PAIRS = 100_000


def _ones(joined: bytes) -> np.ndarray:
    """How many of the 8-byte big-endian hashes have each bit, highest first."""
    bits = np.unpackbits(np.frombuffer(joined, np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255
    count = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        count += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return count


# Odd multipliers of a mixing step that makes further 64-bit hashes of one.
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_STEP = 0x9E3779B97F4A7C15


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes themselves in lane 0, other hashes of them in the others."""
    if not lane:
        return hashes
    x = hashes + np.uint64(_STEP * lane % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 for a text without words."""
    return wide_fingerprint(text, words_per_shingle, seed, 1)[0]


def shingle_hashes(text: str | None, words_per_shingle: int, seed: int) -> bytes:
    """The 8-byte big-endian hashes of the text's word shingles, repeats included; nothing for a text without words."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return b""
    space = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], space + 1)), np.concatenate((space, [len(joined)]))
    n = max(1, len(starts) - words_per_shingle + 1)
    starts, ends = starts[:n], ends[-n:]
    digest = xxhash.xxh64_digest
    return b"".join(b"".join([digest(joined[a:b], seed) for a, b in zip(starts[k : k + _CHUNK].tolist(), ends[k : k + _CHUNK].tolist(), strict=True)]) for k in range(0, n, _CHUNK))


def wide_fingerprint(text: str | None, words_per_shingle: int, seed: int, lanes: int) -> list[int]:
    """``lanes`` 64-bit SimHashes of the text's word shingles, each by hashes of its own; zeros for a text without words."""
    return _prints(shingle_hashes(text, words_per_shingle, seed), lanes)


def _prints(joined: bytes, lanes: int) -> list[int]:
    if not joined:
        return [0] * lanes
    n, ones = len(joined) // 8, np.zeros((lanes, 64), np.int64)
    for k in range(0, n, _CHUNK):
        hashes = joined[8 * k : 8 * (k + _CHUNK)]
        ones[0] += _ones(hashes)
        for lane in range(1, lanes):
            ones[lane] += _ones(_lane(np.frombuffer(hashes, ">u8").astype(np.uint64), lane).astype(">u8").tobytes())
    return [int.from_bytes(x.tobytes(), "big") for x in np.packbits(ones * 2 > n, axis=1)]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, bits): the fingerprint as a signed long. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), words_per_shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(bits.astype(np.int64))], names=["id", "bits"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "id long, bits long")


def as_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def part_keys(bits: Column, radius: int) -> Column:
    """One key for each pair of the radius + 2 parts: the pair's number and the parts' bits."""
    n = radius + 2
    edges = [round(64 * k / n) for k in range(n + 1)]
    keys = []
    for number, (p, q) in enumerate(combinations(range(n), 2)):
        masks = sum((1 << edges[k + 1]) - (1 << edges[k]) for k in (p, q))
        signed = masks - (1 << 64) if masks >> 63 else masks
        keys.append(F.struct(F.lit(number).alias("part"), bits.bitwiseAND(F.lit(signed).cast("long")).alias("key")))
    return F.array(*keys)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest position that each of n positions reaches over the pairs (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def tile_links(group: np.ndarray, bits: np.ndarray, radius: int, first_new: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j, j >= first_new) of fingerprints of the same group within the radius; rows are ordered by group, then population count."""
    ones = np.bitwise_count(bits).astype(np.int16)
    n, left, right = len(bits), [], []
    for a in range(0, n, TILE):
        sa = slice(a, min(a + TILE, n))
        for b in range(a, n, TILE):
            sb = slice(b, min(b + TILE, n))
            if group[sb.start] != group[sa.stop - 1] and b > a:
                break
            if sb.stop <= first_new:
                continue
            if group[sa.start] == group[sb.stop - 1] and ones[sb.start] - ones[sa.stop - 1] > radius:
                break
            near = np.bitwise_count(bits[sa, None] ^ bits[None, sb]) <= radius
            near &= group[sa, None] == group[None, sb]
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            keep = (i < j) & (j >= first_new)
            left.append(i[keep])
            right.append(j[keep])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def links(distinct: DataFrame, radius: int = 3, col: str = "bits") -> DataFrame:
    """(a, b): links that connect every two fingerprints within ``radius`` bits, as a spanning forest of each task's finds.

    ``distinct`` holds each fingerprint once. A task streams the fingerprints that share parts, in the
    order of their population counts, and keeps those that later rows can still reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        for batch in batches:
            part, key = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()
            bits = batch.column(2).to_numpy().view(np.uint64)
            if not len(bits):
                continue
            first_new = len(held[0])
            part, key, bits = np.concatenate((held[0], part)), np.concatenate((held[1], key)), np.concatenate((held[2], bits))
            group = np.concatenate(([0], np.cumsum((part[1:] != part[:-1]) | (key[1:] != key[:-1]))))
            i, j = tile_links(group, bits, radius, first_new)
            if len(i):
                label = forest(i, j, len(bits))
                node = np.flatnonzero(label != np.arange(len(bits)))
                yield pa.record_batch([pa.array(bits[node].view(np.int64)), pa.array(bits[label[node]].view(np.int64))], names=["a", "b"])
            open_group = (group == group[-1]) & (np.bitwise_count(bits).astype(np.int16) >= int(np.bitwise_count(bits[-1])) - radius)
            held = (part[open_group], key[open_group], bits[open_group])

    parted = distinct.select(F.col(col).alias("bits"), F.explode(part_keys(F.col(col), radius)).alias("p")).select("p.part", "p.key", "bits")
    dealt = parted.repartition("part", "key").sortWithinPartitions("part", "key", F.bit_count("bits"), "bits")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _named(nodes: DataFrame, node: str, found: DataFrame) -> DataFrame:
    """(node, n, component_id) of all ``nodes`` (node, least, n), by the links ``found``."""
    roots = components(found)
    rooted = nodes.join(roots, nodes[node] == roots["node"], "left").select(nodes[node].alias("node"), "least", "n", F.coalesce("root", nodes[node]).alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(smallest, "root").select(F.col("node").alias(node), "n", "component_id"), "simhash-named")
    discard(found)
    discard(nodes)
    return named


def differing_share(similarity: float) -> float:
    """The share of bits in which SimHashes of two shingle sets of one size and this Jaccard similarity differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@dataclass(frozen=True)
class Bands:
    """How fingerprints of ``lanes`` x 64 bits meet that differ in ``share`` of their bits on average.

    They link at ``radius`` or fewer differing bits, which nine in ten such pairs have. They meet if they agree on all
    ``width`` bits of a band; ``number`` bands leave ``miss`` of such pairs apart. Bands are drawn from all bits, always the same.
    """

    lanes: int
    share: float
    width: int
    miss: float = 0.01

    @property
    def radius(self) -> int:
        bits = 64 * self.lanes
        return int(bits * self.share + 1.3 * math.sqrt(bits * self.share * (1 - self.share)))

    @property
    def number(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (1 - self.share) ** self.width))

    def keys(self, prints: np.ndarray, some: range | None = None) -> Iterator[np.ndarray]:
        """For each band, or ``some`` by their numbers, the bands' bits of fingerprints (rows of uint64)."""
        rng = np.random.default_rng(64 * self.lanes)
        bits = np.unpackbits(np.ascontiguousarray(prints.astype(">u8")).view(np.uint8), axis=1)
        power = np.int64(1) << np.arange(self.width, dtype=np.int64)
        for band in range(self.number):
            at = np.sort(rng.choice(64 * self.lanes, self.width, replace=False))
            if some is None or band in some:
                yield bits[:, at].astype(np.int64) @ power


def wide_links(group: np.ndarray, prints: np.ndarray, radius: int, first_new: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``tile_links`` of fingerprints of several lanes."""
    ones = np.bitwise_count(prints).sum(axis=1, dtype=np.int16)
    n, left, right = len(prints), [], []
    for a in range(0, n, TILE):
        sa = slice(a, min(a + TILE, n))
        for b in range(a, n, TILE):
            sb = slice(b, min(b + TILE, n))
            if group[sb.start] != group[sa.stop - 1] and b > a:
                break
            if sb.stop <= first_new:
                continue
            if group[sa.start] == group[sb.stop - 1] and ones[sb.start] - ones[sa.stop - 1] > radius:
                break
            i, j = np.nonzero(group[sa, None] == group[None, sb])
            i, j = i + a, j + b
            keep = (i < j) & (j >= first_new)
            i, j = i[keep], j[keep]
            near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int16) <= radius
            left.append(i[near])
            right.append(j[near])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def banded_links(nodes: DataFrame, bands: Bands, some: range | None = None) -> DataFrame:
    """(a, b): links between ``nodes`` (node, and a fingerprint in ``lanes`` longs), by all bands or ``some``, as a spanning forest of each task's finds."""
    lanes = [f"f{k}" for k in range(bands.lanes)]
    some = range(bands.number) if some is None else some

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.stack([batch.column(1 + k).to_numpy().view(np.uint64) for k in range(bands.lanes)], axis=1) if batch.num_rows else np.zeros((0, bands.lanes), np.uint64)
            ones = pa.array(np.bitwise_count(prints).sum(axis=1, dtype=np.int32))
            for band, key in zip(some, bands.keys(prints, some), strict=True):
                yield pa.record_batch([pa.array(np.full(len(key), band, np.int32)), pa.array(key), ones, *batch.columns], names=["band", "key", "ones", "node", *lanes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        held = (empty, empty, empty, np.zeros((0, bands.lanes), np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            first_new = len(held[0])
            band, key, node = (np.concatenate((held[k], batch.column(c).to_numpy().astype(np.int64))) for k, c in enumerate((0, 1, 3)))
            prints = np.concatenate((held[3], np.stack([batch.column(4 + k).to_numpy().view(np.uint64) for k in range(bands.lanes)], axis=1)))
            group = np.concatenate(([0], np.cumsum((band[1:] != band[:-1]) | (key[1:] != key[:-1]))))
            i, j = wide_links(group, prints, bands.radius, first_new)
            if len(i):
                label = forest(i, j, len(node))
                found = np.flatnonzero(label != np.arange(len(node)))
                yield pa.record_batch([pa.array(node[found]), pa.array(node[label[found]])], names=["a", "b"])
            ones = np.bitwise_count(prints).sum(axis=1, dtype=np.int16)
            open_group = (group == group[-1]) & (ones >= ones[-1] - bands.radius)
            held = (band[open_group], key[open_group], node[open_group], prints[open_group])

    schema = ", ".join(["band int, key long, ones int, node long", *(f"{x} long" for x in lanes)])
    dealt = nodes.select("node", *lanes).mapInArrow(deal, schema).repartition("band", "key").sortWithinPartitions("band", "key", "ones", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def links_in_rounds(nodes: DataFrame, count: int, bands: Bands, least: int = 0) -> DataFrame:
    """``banded_links`` of ``count`` stored nodes, a stored table a round of bands: rows of ``least`` (ROUND), or of eight bands, are on disk at a time."""
    each = max(8, (least or ROUND) // max(1, count))
    return reduce(DataFrame.unionByName, [materialise(banded_links(nodes, bands, range(k, min(k + each, bands.number))), "simhash-met") for k in range(0, bands.number, each)])


def shingle_set(text: str | None, words_per_shingle: int, seed: int) -> np.ndarray:
    """The different shingles' hashes, in order."""
    return np.unique(np.frombuffer(shingle_hashes(text, words_per_shingle, seed), ">u8").astype(np.uint64))


def common_shingles(texts: DataFrame, words_per_shingle: int, seed: int, sample: int = 10_000, share: int = 10, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of shingles that three or more of the sampled texts (text, text_hash) hold; the frequent ones, ``most`` at most.

    The sample is about ``sample`` texts, or one in ``share`` of more, so that the texts that share a shingle it doesn't
    find stay few as the table grows. It only orders shingles: any others give the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), words_per_shingle, seed) for t in batch.column(0)]
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], names=["key"])
        give_back()

    n = texts.count()
    every = max(1, n // max(sample, n // share))
    some = texts.filter(F.pmod("text_hash", F.lit(every)) == 0).select("text")
    counts = materialise(some.mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 2"), "simhash-common")
    least = held = 0
    for row in sorted(counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count(F.lit(1)).alias("keys")).collect(), key=lambda r: -r["n"]):
        held += row["keys"]
        if held > most:
            break
        least = row["n"]
    rows = counts.filter(F.col("n") >= (least or 1 << 62)).toArrow()
    discard(counts)
    keys = rows["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["n"].to_numpy()[order]


def ranks(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How common shingles are: 0 for those that ``common`` doesn't hold."""
    keys, counts = common
    if not len(keys):
        return np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
    return np.where(keys[at] == shingles, counts[at], 0)


def prefix_of(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """The first n * (den - num) // den + 1 of n shingles, common ones last: sets of Jaccard similarity num / den or more share one of them."""
    if not len(shingles):
        return shingles
    return shingles[np.lexsort((shingles, ranks(shingles, common)))[: len(shingles) * (den - num) // den + 1]]


def _crossing(key: np.ndarray, root: np.ndarray, first_new: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i < j, j >= first_new) of one key and different roots; rows are ordered by key."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    for few in (True, False):
        size = np.diff(edge)
        lot = (size <= TILE) if few else (size > TILE)
        if few:  # by distance, over all groups at once
            last = np.repeat(edge[1:], size)
            i = np.flatnonzero(np.repeat(lot & (size > 1), size))
            step = 1
            while len(i := i[i + step < last[i]]):
                kept = (root[i] != root[i + step]) & (i + step >= first_new)
                yield i[kept], i[kept] + step
                step += 1
            continue
        for a, b in zip(edge[:-1][lot].tolist(), edge[1:][lot].tolist(), strict=True):
            order = np.argsort(root[a:b], kind="stable") + a
            cut = np.flatnonzero(np.concatenate(([True], root[order][1:] != root[order][:-1], [True]))).tolist()
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):  # a component against all after it
                later = order[hi:]
                for k in order[lo:hi].tolist():
                    kept = np.maximum(later, k) >= first_new
                    yield np.minimum(later[kept], k), np.maximum(later[kept], k)


def prefix_pairs(nodes: DataFrame, num: int, den: int, share: int = 0, rounds: int = 1) -> DataFrame:
    """(a, b): nodes (node, root, size, prefix) of different roots that share a prefix shingle of one ``share`` of ``rounds`` and whose sizes and places allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            if not batch.num_rows:
                continue
            first_new = len(held[0])
            held = [np.concatenate((h, batch.column(c).to_numpy().astype(np.int64))) for c, h in enumerate(held)]
            key, node, root, size, left = held
            for i, j in _crossing(key, root, first_new):
                low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
                near = (low * den >= high * num) & (np.minimum(left[i], left[j]) * (num + den) >= (low + high) * num)
                if near.any():
                    a, b = node[i[near]], node[j[near]]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            held = [h[np.searchsorted(key, key[-1]) :] for h in held]

    postings = nodes.select("node", "root", "size", F.posexplode("prefix").alias("at", "key")).select("key", "node", "root", "size", (F.col("size") - F.col("at")).alias("rest"))
    if rounds > 1:
        postings = postings.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == share)
    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def pairs_in_rounds(nodes: DataFrame, num: int, den: int, least: int = 0) -> DataFrame:
    """``prefix_pairs`` of stored nodes by all shingles, stored, each pair once; postings of one share of the shingles, ``least`` (ROUND) of them or more, are on disk at a time."""
    postings = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    rounds = min(ROUNDS, max(1, math.ceil(postings / (least or ROUND))))
    parts = [materialise(prefix_pairs(nodes, num, den, share, rounds), "simhash-rest") for share in range(rounds)]
    if rounds == 1:
        return parts[0]
    every = materialise(reduce(DataFrame.unionByName, parts).distinct(), "simhash-rest")
    for part in parts:
        discard(part)
    return every


def in_rounds(pairs: DataFrame, work: Callable[[DataFrame], DataFrame], each: int, label: str) -> DataFrame:
    """``work`` on shares of about ``each`` of the stored ``pairs`` (a, b) one after the other, each stored."""
    rounds = max(1, math.ceil(pairs.count() / each))
    shares = [pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k) for k in range(rounds)] if rounds > 1 else [pairs]
    return reduce(DataFrame.unionByName, [materialise(work(share), label) for share in shares])


def sharing(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs`` (a, b) of nodes (node, size, edge, prefix) whose prefixes share as many shingles as the similarity takes.

    What the prefix that ends first shares with the other set is in the other prefix; the rest of its set, and no more, may be
    common besides. ``edge`` is the rank of a prefix's last shingle; equal ranks go by the hash, unsigned.
    """
    known = nodes.select("node", F.struct("size", "edge", "prefix").alias("x"))
    both = pairs.join(known.select(F.col("node").alias("a"), "x"), "a").join(known.select(F.col("node").alias("b"), F.col("x").alias("y")), "b")
    x, y = F.col("x"), F.col("y")
    common = F.call_function("div", (x["size"] + y["size"]) * num + (num + den - 1), F.lit(num + den))

    def end(z: Column) -> Column:
        return F.struct(z["edge"], F.get(z["prefix"], F.size(z["prefix"]) - 1).bitwiseXOR(F.lit(-(1 << 63))))

    def of(z: Column) -> Column:
        return F.size(z["prefix"]) - z["size"] + common

    return both.filter(F.size(F.array_intersect(x["prefix"], y["prefix"])) >= F.when(end(x) <= end(y), of(x)).otherwise(of(y))).select("a", "b")


def similar(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, words_per_shingle: int, seed: int, num: int, den: int, each: int = 0) -> DataFrame:
    """The stored ``pairs`` (a, b) of nodes (node, text_hash) whose texts' shingle sets have Jaccard similarity num / den or more; texts of about ``each`` pairs (PAIRS) travel at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(4096)(lambda text: shingle_set(text, words_per_shingle, seed))
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = known(x), known(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = common * den >= (len(x) + len(y) - common) * num
            yield pa.record_batch([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])
        known.cache_clear()
        give_back()

    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialise(nodes.select("node", "text_hash").join(named, "node", "left_semi"), "simhash-wanted")
    read = texts.filter(marked(F.col("text_hash"), bit_table(wanted.select("text_hash"), wanted.count()))).join(wanted, "text_hash")
    held = materialise(read.dropDuplicates(["text_hash"]).select("node", "text"), "simhash-texts")

    def told(some: DataFrame) -> DataFrame:
        both = some.join(held.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    found = in_rounds(pairs, told, each or PAIRS, "simhash-similar")
    discard(held)
    discard(wanted)
    return found


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8, lanes: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of ``df``: id, text_hash, component_id (the smallest id that links reach), for texts of ``similarity`` or more.

    Texts link if their sets of word shingles have that Jaccard similarity, and all that do are linked. Most links come
    from SimHashes of ``lanes`` x 64 bits that meet by bands of bits and are verified; a join of the sets by their
    prefixes finds the others, for which only pairs that verified links leave in different components are looked at.
    Of those, only pairs whose prefixes share enough have their texts read. Bands, prefixes and pairs go in rounds, so
    that one round's rows are on disk at a time.

    Texts of one shingle set are one node; null and empty texts have the empty set. A null id is never
    a component's id unless all its ids are null; repeated rows come out each; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    num, den = Fraction(str(similarity)).as_integer_ratio()
    names = [f"f{k}" for k in range(lanes)]
    text = F.col(f"`{text_col}`").cast("string")
    picked = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    common = df.sparkSession.sparkContext.broadcast(common_shingles(picked, words_per_shingle, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), words_per_shingle, seed) for t in batch.column(2)]
            prints = np.array([_prints(h, lanes) for h in hashes], np.uint64).reshape(batch.num_rows, lanes).astype(np.int64)
            sets = [np.unique(np.frombuffer(h, ">u8").astype(np.uint64)) for h in hashes]
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            prefixes = [prefix_of(x, common.value, num, den).view(np.int64) for x in sets]
            edges = [int(ranks(x[-1:].view(np.uint64), common.value)[0]) if len(x) else 0 for x in prefixes]
            columns = [pa.array(node), *(pa.array(prints[:, k]) for k in range(lanes)), pa.array([len(x) for x in sets], pa.int32()), pa.array(edges, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["id", "text_hash", "node", *names, "size", "edge", "prefix"])
        give_back()

    schema = ", ".join(["id long, text_hash long, node long", *(f"{x} long" for x in names), "size int, edge long, prefix array<long>"])
    whole = materialise(picked.mapInArrow(run, schema), "simhash")
    one = F.min_by(F.struct(*names, "size", "edge", "prefix", "text_hash"), "text_hash").alias("one")
    nodes = materialise(whole.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), one).select("node", "least", "n", "one.*"), "simhash-nodes")
    rows = materialise(whole.select("id", "text_hash", "node"), "simhash-rows")
    discard(whole)
    count = nodes.count()
    bands = Bands(lanes, differing_share(similarity), max(12, math.ceil(math.log2(count + 1)) - 6))
    links_ = links_in_rounds(nodes, count, bands)
    met = materialise(links_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-links")
    each = max(PAIRS, count // 4)
    sure = similar(picked, nodes, met, words_per_shingle, seed, num, den, each)
    roots = materialise(components(sure), "simhash-roots")
    rooted = materialise(nodes.select("node", "size", "edge", "prefix").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "simhash-rooted")
    told = materialise(nodes.select("node", "least", "n", "text_hash"), "simhash-told")
    discard(nodes)
    rest = pairs_in_rounds(rooted, num, den)
    few = in_rounds(rest, lambda some: sharing(some, rooted, num, den), max(PAIRS, count), "simhash-few")
    discard(rooted)
    late = similar(picked, told, few, words_per_shingle, seed, num, den, each)
    found = materialise(sure.unionByName(late), "simhash-links")
    for done in (links_, met, rest, few, roots, late, sure):
        discard(done)
    named = _named(told, "node", found)
    return salted_join(rows.select("id", "text_hash", "node"), named, "node", "n").select(F.col("id").alias(id_col), "text_hash", "component_id")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``df``: id, bits, component_id (the smallest id that links reach).

    Texts of one fingerprint are one node, so copies cost nothing. Null and empty texts share fingerprint
    0 and link like others; a null id is never a component's id unless all its ids are null; repeated rows
    come out each; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = materialise(fingerprints(df, id_col, text_col, words_per_shingle, seed), "simhash")
    nodes = materialise(rows.groupBy("bits").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    found = materialise(links(nodes, radius), "simhash-links")
    named = _named(nodes, "bits", found)
    return salted_join(rows, named, "bits", "n").select(F.col("id").alias(id_col), "bits", "component_id")
