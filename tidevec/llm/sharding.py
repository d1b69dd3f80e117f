"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into thousands of slots; slots, not records, belong to shards. Bytes are aggregated per
slot, and rebalancing edits the map: it moves or swaps slots between the heaviest and the lightest
shard until loads are level, so every other slot stays where it was. Each edit is a new version.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise, place
from .numbering import gapless_rank


@dataclass
class SlotMap:
    """versions[v][slot] is the shard of a slot in version v."""

    n_slots: int
    versions: list[list[int]] = field(default_factory=list)

    @classmethod
    def initial(cls, n_shards: int, n_slots: int = 4096) -> SlotMap:
        return cls(n_slots, [[s % n_shards for s in range(n_slots)]])

    @property
    def current(self) -> list[int]:
        return self.versions[-1]

    def rebalance(self, weight: dict[int, int], n_shards: int, tolerance: float = 0.0005) -> SlotMap:
        """Append a version whose shards' weights are level within ``tolerance`` of their mean, or as level as moves and swaps make them; none if they are."""
        shard_of = list(self.current)
        held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
        for slot in range(self.n_slots):
            if w := weight.get(slot, 0):
                held[shard_of[slot]].append((w, slot))
        for each in held:
            each.sort()
        load = [sum(w for w, _ in each) for each in held]
        slack = tolerance * sum(load) / max(1, n_shards)
        for _ in range(20 * self.n_slots):
            edit = None
            light = min(range(n_shards), key=lambda s: (load[s], s))
            for heavy in sorted(range(n_shards), key=lambda s: (-load[s], s))[:4]:
                gap = load[heavy] - load[light]
                if gap <= max(slack, 1):
                    break
                edit = self._edit(held[heavy], held[light], gap)
                if edit:
                    break
            if not edit:
                break
            out, back = edit
            held[heavy].remove(out)
            held[light].append(out)
            shard_of[out[1]] = light
            if back:
                held[light].remove(back)
                held[heavy].append(back)
                shard_of[back[1]] = heavy
            held[heavy].sort()
            held[light].sort()
            shift = out[0] - (back[0] if back else 0)
            load[heavy] -= shift
            load[light] += shift
        return self if shard_of == self.current else SlotMap(self.n_slots, [*self.versions, shard_of])

    @staticmethod
    def _edit(heavy: list[tuple[int, int]], light: list[tuple[int, int]], gap: int):
        """The move or swap that comes nearest to half of the gap without passing it by more than the gap allows."""
        best, found = 0, None
        for out in heavy:
            lone = out[0]
            if lone < gap and min(lone, gap - lone) > best:
                best, found = min(lone, gap - lone), (out, None)
            k = bisect_right(light, (out[0] - gap // 2, self_max)) if light else 0
            for back in light[max(0, k - 1) : k + 1]:
                shift = out[0] - back[0]
                if 0 < shift < gap and min(shift, gap - shift) > best:
                    best, found = min(shift, gap - shift), (out, back)
        return found

    def grow(self, n_shards: int) -> SlotMap:
        """Append a version with shard ``n_shards`` added: it takes an even share of every other shard's slots, and no other slot moves."""
        shard_of = list(self.current)
        share = self.n_slots // (n_shards + 1)
        mine = sorted(range(self.n_slots), key=lambda s: ((s * 2654435761) % 2**32, s))
        size = {k: shard_of.count(k) for k in range(n_shards)}
        for slot in mine:
            if share and size.get(shard_of[slot], 0) > self.n_slots // (n_shards + 1):
                size[shard_of[slot]] -= 1
                shard_of[slot] = n_shards
                share -= 1
        return SlotMap(self.n_slots, [*self.versions, shard_of])

    def save(self, spark: SparkSession, path: str, since: int = 0) -> None:
        """Add the versions from ``since`` on to the map stored at ``path``; stored versions stay as they are."""
        rows = [(v, s, k) for v, version in enumerate(self.versions) for s, k in enumerate(version) if v >= since]
        if rows:
            spark.createDataFrame(rows, "version int, slot int, shard int").coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The map stored at ``path``, or None."""
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            return None
        rows = spark.read.parquet(path).orderBy("version", "slot").collect()
        found = cls(max(r.slot for r in rows) + 1)
        for r in rows:
            if r.version == len(found.versions):
                found.versions.append([])
            found.versions[-1].append(r.shard)
        return found


self_max = float("inf")


def sized(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size (UTF-8 bytes plus 1; a null text has none), text_crc32 (a null text counts as empty), _key (hash of the text)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(
        F.col(f"`{id_col}`").alias(id_col),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
    )


def shard_by_slots(df: DataFrame, n_shards: int, n_slots: int = 4096, id_col: str = "doc_id", text_col: str = "text", hot_share: int = 64, spread: int = 64, map_path: str | None = None, tolerance: float = 0.0005) -> DataFrame:
    """Deal all rows into ``n_shards`` shards of nearly equal bytes (law ``bytes``).

    Returns id, size, text_crc32, virtual_slot, map_version, shard and place (gapless from 0 within the
    shard). A record's slot is a hash of its text, so equal texts share a slot and a shard, however many
    they are, but for a text that alone holds more than a shard's share of all bytes: it spreads over
    ``spread`` slots by id. Texts of over 1/``hot_share`` of all bytes (``hot_share`` at most) get slots
    apart from each other's. Only they and the table of slots reach the driver.

    A map stored at ``map_path`` is edited: where the shards' bytes are further apart than ``tolerance``
    of their mean, slots move until they aren't, and that is its next version; more shards than it has
    take an even share of slots first. All versions stay there. Without a stored map slots begin dealt in turn.

    Null ids and texts are dealt like others (a null text has size 1), repeated rows are dealt each,
    an empty table gives no rows, and other columns of ``df`` are ignored.
    """
    spark = df.sparkSession
    base = materialise(sized(df, id_col, text_col), "sized")
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    hot_share = max(hot_share, n_shards)
    heavy = base.groupBy("_key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") * hot_share > total)
    hot, own = [], {}
    for r in heavy.orderBy(F.desc("bytes"), "_key").limit(hot_share).collect():  # fewer than hot_share can hold so much
        if r["bytes"] * n_shards > total:
            hot.append(r["_key"])
        else:
            at = r["_key"] % n_slots
            while at in own.values():
                at = (at + 1) % n_slots
            own[r["_key"]] = at
    slot = F.pmod(F.xxhash64("_key", F.when(F.col("_key").isin(hot), F.pmod(F.xxhash64(id_col), F.lit(spread))).otherwise(F.lit(-1).cast("long"))), F.lit(n_slots)).cast("int")
    for key, at in own.items():
        slot = F.when(F.col("_key") == key, F.lit(at)).otherwise(slot)
    slotted = base.select(id_col, "size", "text_crc32", slot.alias("virtual_slot"))
    weight = {r.virtual_slot: r.bytes for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}
    path = map_path or place(spark, "slotmap")
    stored = SlotMap.load(spark, path)
    if stored and stored.n_slots != n_slots:
        raise ValueError(f"the stored map has {stored.n_slots} slots")
    slots = stored or SlotMap.initial(n_shards, n_slots)
    for shards in range(max(slots.current) + 1, n_shards):
        slots = slots.grow(shards)
    slots = slots.rebalance(weight, n_shards, tolerance)
    slots.save(spark, path, len(stored.versions) if stored else 0)
    version = len(slots.versions) - 1
    current = spark.read.parquet(path).filter(F.col("version") == version).select(F.col("slot").alias("virtual_slot"), F.col("version").alias("map_version"), "shard")
    dealt = slotted.join(F.broadcast(current), "virtual_slot")  # n_slots rows
    return gapless_rank(dealt, "shard", F.col(id_col), [F.col(id_col), F.col("text_crc32"), F.col("size")], name="place")
