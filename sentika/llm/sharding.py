"""Shards by fixed virtual slots and a versioned slot-to-shard map.

Every record hashes into one of ``n_slots`` virtual slots, for good. What moves between
shards is slots, never single records: the map from slot to shard is a small table with a
version, built from the bytes of each slot and edited, slot by slot, when shards are added or
have grown apart.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentika.llm.common import written
from sentika.session import scratch_path

N_SLOTS = 8192
MAP_SCHEMA = "version long, vslot int, shard int, bytes long, records long"


def slotted(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns plus ``size`` (UTF-8 bytes + 1), ``text_crc32`` and the virtual slot ``vslot``.

    The slot hashes id and text, so that rows without an id spread too. A null text has size 1
    and the checksum of no bytes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.withColumns(
        {
            "size": (F.octet_length(text) + 1).cast("long"),
            "text_crc32": crc,
            "vslot": F.pmod(F.xxhash64(F.col(id_col), crc, F.octet_length(text)), F.lit(n_slots)).cast("int"),
        }
    )


def slot_bytes(slots: DataFrame) -> DataFrame:
    """Bytes and records of each virtual slot that has rows: at most ``n_slots`` rows."""
    return slots.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))


def _collected(sizes: DataFrame, n_slots: int) -> dict[int, tuple[int, int]]:
    found = {r.vslot: (r.bytes, r.records) for r in sizes.collect()}
    return {v: found.get(v, (0, 0)) for v in range(n_slots)}


def _table(spark: SparkSession, version: int, sizes: dict, shard_of: dict[int, int]) -> DataFrame:
    rows = [(version, v, shard_of[v], b, n) for v, (b, n) in sorted(sizes.items())]
    return spark.createDataFrame(rows, MAP_SCHEMA)


def build_map(sizes: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """First version of the map: the largest slot first, each to the shard with the fewest bytes.

    Only the ``n_slots`` sums come to the driver, whatever the number of records.
    """
    by_slot, load, shard_of = _collected(sizes, n_slots), [(0, s) for s in range(n_shards)], {}
    for v, (b, _) in sorted(by_slot.items(), key=lambda x: (-x[1][0], x[0])):
        least, shard = load[0]
        heapq.heapreplace(load, (least + b, shard))
        shard_of[v] = shard
    return _table(sizes.sparkSession, 1, by_slot, shard_of)


def rebalance(old: DataFrame, sizes: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Next version for the bytes of now and for more shards, moving few slots.

    As long as it brings the fullest and the emptiest shard nearer to each other, the largest slot of
    the fullest shard that fits moves to the emptiest; new shards alone take slots where there are
    any. All other slots stay where they are. ``n_shards`` must not be below the shards in use.
    """
    before = {r.vslot: (r.version, r.shard) for r in old.collect()}
    by_slot = _collected(sizes, n_slots)
    shard_of = {v: before[v][1] for v in by_slot}
    if max(shard_of.values(), default=0) >= n_shards:
        raise ValueError("a map in use cannot lose shards")
    load = dict.fromkeys(range(n_shards), 0)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in load}
    for v, s in shard_of.items():
        load[s] += by_slot[v][0]
        held[s].append((by_slot[v][0], v))
    takers = [s for s in load if s not in set(shard_of.values())] or list(load)
    while True:
        full, empty = max(load, key=lambda s: (load[s], -s)), min(takers, key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        fits = [x for x in held[full] if 0 < x[0] < gap]
        if not fits:
            break
        best = min(fits, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        held[full].remove(best)
        held[empty].append(best)
        load[full] -= best[0]
        load[empty] += best[0]
        shard_of[best[1]] = empty
    return _table(old.sparkSession, max(x[0] for x in before.values()) + 1, by_slot, shard_of)


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add one version of the map below ``path``; versions are never overwritten."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given or else the newest version of the map."""
    kept = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = version if version is not None else kept.agg(F.max("version")).first()[0]
    return kept.where(F.col("version") == version)


def assign(slots: DataFrame, slot_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add ``shard``, the map's ``map_version`` and ``slot``: the row's place in its shard, gapless from 0.

    Places are numbered within each virtual slot and offset by the records of the slots before it
    in the shard, so no task holds a shard. The map has ``n_slots`` rows and is broadcast.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select(
        "vslot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("records").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("vslot").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size")
    placed = slots.withColumn("_place", F.row_number().over(within) - 1)
    return (
        placed.join(F.broadcast(offsets), "vslot")
        .withColumn("slot", (F.col("_place") + F.col("_offset")).cast("long"))
        .drop("_place", "_offset")
    )


def shard_documents(
    docs: DataFrame,
    n_shards: int = 16,
    n_slots: int = N_SLOTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    map_path: str | None = None,
) -> DataFrame:
    """Records with their shard under the law ``bytes``: shard sizes near equal.

    Builds version 1 of the map from the records' bytes, or edits the newest version at
    ``map_path``, stores it there and assigns by it. Columns ``vslot shard slot size text_crc32
    law map_version grown_shard`` replace input columns of these names; all others stay.
    ``grown_shard`` is null, as the law is not ``key``. Rows with equal id and text share a slot;
    a null text has one byte; no rows give an empty result and a map of empty slots.
    """
    spark = docs.sparkSession
    own = ["vslot", "shard", "slot", "size", "text_crc32", "law", "map_version", "grown_shard", "_place", "_offset"]
    slots = slotted(docs.drop(*own), n_slots, id_col, text_col)
    narrow = written(slot_bytes(slots), "slot-bytes")
    if map_path is None:
        map_path = scratch_path(spark, "slot-map")
        store_map(build_map(narrow, n_shards, n_slots), map_path)
    else:
        store_map(rebalance(load_map(spark, map_path), narrow, n_shards, n_slots), map_path)
    placed = assign(slots, load_map(spark, map_path), id_col)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard; a shard's files follow the virtual slots."""
    placed.write.partitionBy("shard").parquet(path)
