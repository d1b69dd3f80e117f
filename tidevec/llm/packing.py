"""Packing token sequences by bin completion.

Documents are tokenised where they lie and cut into pieces; only piece lengths matter for packing, so
the lengths' histogram (at most ``capacity`` numbers) is packed on the driver and the resulting bins
are dealt back to pieces by rank within their length.

Packing is a branch-and-bound over bins: each step takes the largest length left and enumerates
undominated fillings around it, best fit first; a branch ends when its waste passes what the incumbent
allows. Bins repeat while their lengths last, so the search runs over kinds of bins, not bins. Packings
by best-fit decreasing, of all and of what is left at steps of the search, are incumbents.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .numbering import gapless_rank

Bin = tuple[tuple[int, int], ...]  # (length, copies), longest first
Packing = list[tuple[Bin, int]]  # kinds of bins, and how many of each


def bins_of(packing: Packing) -> int:
    return sum(m for _, m in packing)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins needed at least: Martello and Toth's L2 over all thresholds."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for k in {0, *(n for n in lengths if 2 * n <= capacity)}:
        large = sum(c for n, c in counts.items() if n > capacity - k)
        middle = {n: c for n, c in counts.items() if capacity - k >= n and 2 * n > capacity}
        small = sum(n * c for n, c in counts.items() if k <= n and 2 * n <= capacity)
        room = sum(c * (capacity - n) for n, c in middle.items())
        best = max(best, large + sum(middle.values()) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing over groups of equal bins."""
    bins: dict[Bin, int] = {}
    rooms: list[tuple[int, Bin]] = []

    def put(kind: Bin, m: int) -> None:
        if kind not in bins:
            insort(rooms, (capacity - sum(n * c for n, c in kind), kind))
        bins[kind] = bins.get(kind, 0) + m

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            k = bisect_left(rooms, (n, ()))
            if k == len(rooms):
                each = capacity // n
                if left >= each:
                    put(((n, each),), left // each)
                if left % each:
                    put(((n, left % each),), 1)
                break
            room, kind = rooms[k]
            each = room // n
            m = bins[kind]
            if left < each:
                each, m = left, 1
            else:
                m = min(m, left // each)
            bins[kind] -= m
            if not bins[kind]:
                del bins[kind]
                rooms.pop(k)
            put((*kind, (n, each)), m)
            left -= each * m
    return [(kind, m) for kind, m in bins.items() if m]


def fillings(first: int, counts: dict[int, int], capacity: int) -> Iterator[Bin]:
    """Undominated bins around one ``first``, fullest first and the longest lengths first among equally full ones.

    A filling is dominated when some of its lengths can be exchanged for one longer or equally long length
    that is left and fits: what then remains packs at least as well.
    """
    room = capacity - first
    have = dict(counts)
    have[first] -= 1
    lengths = [n for n in sorted(have) if n <= room and have[n]]
    reach = [1]  # reach[k]: bit s is set if the k shortest lengths can sum to s
    full = (1 << (room + 1)) - 1
    for n in lengths:
        bits, copies, step = reach[-1], min(have[n], room // n), 1
        while copies:
            take = min(step, copies)
            bits |= (bits << (n * take)) & full
            copies -= take
            step *= 2
        reach.append(bits)

    def undominated(kind: list[tuple[int, int]], slack: int) -> bool:
        used = dict(kind)
        parts = {0: 0}  # sums of some of the lengths, and the most of them that make each; large sets are tried by singles and pairs
        flat = [n for n, c in kind for _ in range(min(c, 3))]
        if len(flat) <= 8:
            for n in flat:
                for s, k in list(parts.items()):
                    parts[s + n] = max(parts.get(s + n, 0), k + 1)
        else:
            parts |= {n: 1 for n in flat} | {m + n: 2 for i, m in enumerate(flat) for n in flat[:i]}
        for s, k in parts.items():
            for j in range(bisect_left(lengths, s if k > 1 else s + 1), len(lengths)):
                n = lengths[j]
                if n > s + slack:
                    break
                if have[n] > used.get(n, 0):
                    return False
        return True

    def descend(k: int, left: int, kind: list[tuple[int, int]], slack: int) -> Iterator[Bin]:
        """Add lengths among the k shortest that sum to ``left``, longest first."""
        if not left:
            if undominated(kind, slack):
                filled = dict(kind)
                filled[first] = filled.get(first, 0) + 1
                yield tuple(sorted(filled.items(), reverse=True))
            return
        for j in range(min(k, bisect_left(lengths, left + 1)), 0, -1):
            if not (reach[j] >> left) & 1:
                return
            n = lengths[j - 1]
            for c in range(min(have[n], left // n), 0, -1):
                if (reach[j - 1] >> (left - n * c)) & 1:
                    yield from descend(j - 1, left - n * c, [*kind, (n, c)], slack)

    for fill in range(room, -1, -1):
        if (reach[-1] >> fill) & 1:
            yield from descend(len(lengths), fill, [], room - fill)


def pack_lengths(counts: dict[int, int], capacity: int, effort: int = 12) -> Packing:
    """As few bins of ``capacity`` as the search finds for ``counts`` (length to number); lengths are 1 to capacity.

    A depth-first search in passes of rising discrepancy: in pass d a branch may leave the best-fitting
    filling at every step d times. Branches are all undominated fillings, each as often as the lengths
    allow or once. A branch ends when its bins and the least that the rest needs reach the incumbent's, or
    when its waste passes what one bin less than the incumbent's allows. The incumbent is best-fit
    decreasing's packing at first, and of the rest at every ``effort``-th step. It ends when the incumbent
    meets the lower bound, when a pass has tried all there is, or after ``effort`` steps for each
    kind of bin of the first packing (10,000 at least); what is above the lower bound then is ``gap``.
    """
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("a length doesn't fit")
    least, total = lower_bound(counts, capacity), sum(n * c for n, c in counts.items())
    best = best_fit_decreasing(counts, capacity)
    steps = max(10_000, effort * len(best))
    discrepancy = 0
    while bins_of(best) > least and steps > 0:
        cut = False  # whether this pass left out a branch for its discrepancy alone
        left, used, waste = dict(counts), 0, 0
        # a level: (branches, taken (filling, copies) or None, discrepancies that remain)
        stack = [[_branches(left, capacity), None, discrepancy]]
        while stack and bins_of(best) > least and steps > 0:
            level = stack[-1]
            if level[1]:  # undo what was tried
                kind, m = level[1]
                for n, c in kind:
                    left[n] = left.get(n, 0) + c * m
                used, waste, level[1] = used - m, waste - m * (capacity - sum(n * c for n, c in kind)), None
                if not level[2]:
                    cut = cut or next(level[0], None) is not None
                    stack.pop()
                    continue
                level[2] -= 1
            taken = next(level[0], None)
            if taken is None:
                stack.pop()
                continue
            kind, m = taken
            steps -= 1
            for n, c in kind:
                left[n] -= c * m
                if not left[n]:
                    del left[n]
            used, waste, level[1] = used + m, waste + m * (capacity - sum(n * c for n, c in kind)), taken
            done = [x[1] for x in stack]
            if not left:
                if used < bins_of(best):
                    best = done
                continue
            if waste > (bins_of(best) - 1) * capacity - total or used + max(1, -(-sum(n * c for n, c in left.items()) // capacity)) >= bins_of(best):
                continue
            if len(stack) % effort == 0:
                rest = best_fit_decreasing(left, capacity)
                if used + bins_of(rest) < bins_of(best):
                    best = [*done, *rest]
            stack.append([_branches(left, capacity), None, level[2]])
        if not cut:
            break
        discrepancy += 1
    return best


def _branches(left: dict[int, int], capacity: int) -> Iterator[tuple[Bin, int]]:
    """Fillings around the largest length left, each as often as possible, then once; made as they are asked for."""
    now = dict(left)
    for kind in fillings(max(now), now, capacity):
        most = min(now[n] // c for n, c in kind)
        yield kind, most
        if most > 1:
            yield kind, 1


def gap(packing: Packing, capacity: int) -> int:
    """Bins above the lower bound: 0 shows that no packing has fewer."""
    counts: dict[int, int] = {}
    for kind, m in packing:
        for n, c in kind:
            counts[n] = counts.get(n, 0) + c * m
    return bins_of(packing) - lower_bound(counts, capacity)


def places(packing: Packing) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from_rank, to_rank, first_sequence, offset, copies): where the pieces of a length go, by rank."""
    given: dict[int, int] = {}
    out, sequence = [], 0
    for kind, m in packing:
        offset = 0
        for n, c in kind:
            begin = given.get(n, 0)
            out.append((n, begin, begin + c * m, sequence, offset, c))
            given[n] = begin + c * m
            offset += n * c
        sequence += m
    return out


# How byte-level BPE files write bytes as characters (those that print stand for themselves, the others follow from 256 on).
_PRINTED = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_of() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(_PRINTED)]
    return {chr(b): b for b in _PRINTED} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """The ids that the ``tokenizers`` library gives for a text by the file ``path``, as little-endian bytes; special
    strings in texts are their special ids, none are added.

    For a file of plain byte-level BPE whose ids are its merge ranks, that library's vocabulary and special
    strings are read and texts encoded by a faster library to the same ids; other files are encoded by the library itself.
    The pattern's look-ahead for runs of white space makes matching slow; it decides nothing where no two
    white-space characters meet, so such texts are split without it.
    """

    LOOK_AHEAD = r"\s+(?!\S)|"
    RUN = re.compile(r"\s\s")
    # Fixed value: the pattern that byte-level pre-tokenization splits by.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            ranks = _plain_ranks(json.load(f))
        self.full = self.fast = self.special = None
        if ranks is None:
            return
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.full = tiktoken.Encoding("full", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.fast = tiktoken.Encoding("fast", pat_str=self.PATTERN.replace(self.LOOK_AHEAD, ""), mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.full is None:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if self.special and self.special.search(text):
            return array("I", self.full.encode(text, allowed_special="all")).tobytes()
        encoding = self.full if self.RUN.search(text) else self.fast
        return array("I", encoding.encode_ordinary(text)).tobytes()


def _plain_ranks(told: dict) -> dict[bytes, int] | None:
    """Ids by token of a tokenizer file, if it is byte-level BPE and nothing besides, with merges in the order of their ids."""
    model, before, byte_of = told["model"], told.get("pre_tokenizer") or {}, _byte_of()
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and not told.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    special = {t["content"]: t for t in told.get("added_tokens", [])}
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in special.values()):
        return None
    if any(c not in byte_of for t in model["vocab"] if t not in special for c in t):
        return None
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first may be shorter."""
    head = length % capacity or min(length, capacity)
    return [(0, head), *((a, capacity) for a in range(head, length, capacity))]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def tokenised_pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece, tokenised where the document lies; ids stay there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        tail = array("I", [end_id]).tobytes()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                columns: list[list] = [[], [], [], [], []]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = tokens.encode(text or "") + tail
                    for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                        for column, value in zip(columns, (doc_id, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])), strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    picked = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", effort: int = 12) -> DataFrame:
    """Pack all documents of ``df``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows are packed each; a null id stays null; an
    empty table gives no rows; other columns are ignored, whatever their names. Sequence numbers are
    gapless from 0. Only the histogram of lengths and the kinds of bins pass through the driver.
    """
    spark = df.sparkSession
    pieces = materialise(tokenised_pieces(df, path, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = places(pack_lengths(counts, capacity, effort))
    table = spark.createDataFrame(where, "_length long, _from long, _to long, _sequence long, _offset long, _copies long")
    ranked = gapless_rank(pieces, "length", F.struct("doc_id", "start"), [F.col("doc_id"), F.col("start"), F.col("ids_crc32")])
    spans = table.groupBy("_length").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_sequence", "_offset", "_copies"))).alias("_spans"))
    hit = ranked.join(F.broadcast(spans), F.col("length") == F.col("_length")).withColumn("_span", F.filter("_spans", lambda s: (s["_from"] <= F.col("rank")) & (F.col("rank") < s["_to"]))[0])
    within = F.col("rank") - F.col("_span._from")
    return hit.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_span._sequence") + F.floor(within / F.col("_span._copies"))).cast("long").alias("sequence_id"),
        (F.col("_span._offset") + F.pmod(within, F.col("_span._copies")) * F.col("length")).cast("long").alias("offset"),
    )
