"""Sharding over fixed virtual slots.

A record's virtual slot is a hash of its id modulo ``SLOTS``, for ever. A versioned map says which shard holds each
slot; only edits of the map move records. ``SlotMap.grow`` adds a shard by giving it an even share of the slots and moves
no slot between old shards. ``SlotMap.rebalance`` edits the map by the measured bytes of each slot. The map and the bytes
per slot have ``SLOTS`` rows at any input size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_len

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Version, and the shard of each virtual slot; every edit makes a new version."""

    version: int
    shards: int
    of_slot: tuple[int, ...]

    @staticmethod
    def first(shards: int, slots: int = SLOTS) -> SlotMap:
        """The map that the number of shards alone decides: one shard, grown shard by shard."""
        if not 1 <= shards <= slots:
            raise ValueError("shards must be between 1 and the number of slots")
        out = SlotMap(1, 1, (0,) * slots)
        while out.shards < shards:
            out = out.grow()
        return out

    def grow(self) -> SlotMap:
        """One more shard: it takes slots // (shards + 1) slots, each from the shard that holds most (ties: the lowest)."""
        of_slot, new = list(self.of_slot), self.shards
        held: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(of_slot):
            held[shard].append(slot)
        for _ in range(len(of_slot) // (self.shards + 1)):
            giver = max(held, key=len)
            of_slot[giver.pop()] = new
        return SlotMap(self.version + 1, new + 1, tuple(of_slot))

    def rebalance(self, slot_bytes: dict[int, int], tolerance: float = 0.02) -> SlotMap:
        """Move slots from the heaviest to the lightest shard while that narrows the gap and it exceeds ``tolerance`` of the mean."""
        of_slot, load = list(self.of_slot), [0] * self.shards
        held: list[set[int]] = [set() for _ in range(self.shards)]
        for slot, shard in enumerate(of_slot):
            load[shard] += slot_bytes.get(slot, 0)
            held[shard].add(slot)
        mean = sum(load) / self.shards
        for _ in range(len(of_slot)):
            high, low = max(range(self.shards), key=lambda s: (load[s], -s)), min(range(self.shards), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            movable = [(abs(gap / 2 - slot_bytes.get(s, 0)), s) for s in held[high] if 0 < slot_bytes.get(s, 0) < gap]
            if gap <= tolerance * mean or not movable:
                break
            slot = min(movable)[1]
            held[high].remove(slot)
            held[low].add(slot)
            load[high] -= slot_bytes[slot]
            load[low] += slot_bytes[slot]
            of_slot[slot] = low
        return self if tuple(of_slot) == self.of_slot else SlotMap(self.version + 1, self.shards, tuple(of_slot))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, s, x) for s, x in enumerate(self.of_slot)], "version int, vslot int, shard int")

    def column(self, vslot: Column) -> Column:
        """The shard of a slot, looked up in a literal array of ``SLOTS`` ints."""
        return F.element_at(F.lit(list(self.of_slot)), vslot.cast("int") + 1)


def save_map(slot_map: SlotMap, spark: SparkSession, path: str) -> None:
    """Append a version to the stored history of maps."""
    slot_map.frame(spark).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The latest stored version, or the one asked for; at most ``SLOTS`` rows come to the driver."""
    stored = spark.read.parquet(path)
    version = version if version is not None else stored.agg(F.max("version")).first()[0]
    rows = stored.where(F.col("version") == version).orderBy("vslot").collect()
    return SlotMap(version, max(r.shard for r in rows) + 1, tuple(r.shard for r in rows))


def virtual_slot(doc_id: Column, slots: int = SLOTS) -> Column:
    """First 60 bits of the md5 of the id as text (null: of the empty text), modulo the number of slots."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows and bytes of each virtual slot that has any: at most ``slots`` rows, combined before the shuffle."""
    size = byte_len(F.col("text").cast("string")) + 1
    return docs.groupBy(virtual_slot(F.col("doc_id").cast("long"), slots).alias("vslot")).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))


def rebalance(docs: DataFrame, path: str, tolerance: float = 0.02) -> SlotMap:
    """Edit the map stored under ``path`` by the bytes that ``docs`` have in each slot, and store the edit as its next version."""
    old = load_map(docs.sparkSession, path)
    new = old.rebalance({r.vslot: r.bytes for r in slot_bytes(docs, len(old.of_slot)).collect()}, tolerance)  # a row for each slot
    if new.version != old.version:
        save_map(new, docs.sparkSession, path)
    return new


def shard(docs: DataFrame, slot_map: SlotMap, grown: SlotMap | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version, vslot_bytes for every row of ``docs``.

    ``law`` is ``key``: the id and the map decide alone. ``slot`` is the row's place in its shard, from 0 and without
    gaps: a slot starts where the slots of its shard before it end, and in it rows are numbered by (doc_id, crc, size). A
    slot with far more rows than others, as rows without an id may make, is numbered in parts by the crc, so that no task
    sorts it whole. Null ids share a slot; a null text has size 1 and the checksum of the empty text. Rows that are equal
    in id and text get neighbouring places. An empty table gives no rows; other columns are ignored.
    """
    slots = len(slot_map.of_slot)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (byte_len(text) + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
        virtual_slot(F.col("doc_id").cast("long"), slots).alias("vslot"),
    )
    held = {r.vslot: r for r in slot_bytes(docs, slots).collect()}  # at most ``slots`` rows
    most = max(1, 2 * sum(r.rows for r in held.values()) // slots, 4096)
    cuts = [-(-held[s].rows // most) if s in held else 1 for s in range(slots)]  # in all at most 1.5 * ``slots`` parts
    rows = rows.withColumn("part", F.shiftright(F.col("text_crc32") * F.element_at(F.lit(cuts), F.col("vslot") + 1), 32).cast("int"))
    n_of = {(s, 0): r.rows for s, r in held.items() if cuts[s] == 1}
    large = [s for s in range(slots) if cuts[s] > 1]
    if large:
        n_of |= {(r.vslot, r.part): r.n for r in rows.where(F.col("vslot").isin(large)).groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, filled = [], [0] * slot_map.shards
    for s, x in enumerate(slot_map.of_slot):
        for k in range(cuts[s]):
            table.append((s, k, x, filled[x], (grown or slot_map).of_slot[s], held[s].bytes if s in held else 0))
            filled[x] += n_of.get((s, k), 0)
    placed = F.broadcast(docs.sparkSession.createDataFrame(table, "vslot int, part int, shard int, start long, grown int, vslot_bytes long"))
    place = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("place", place).join(placed, ["vslot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
        (F.col("grown") if grown else F.lit(None).cast("int")).alias("grown_shard"), "vslot", F.lit(slot_map.version).alias("map_version"), "vslot_bytes",
    )
