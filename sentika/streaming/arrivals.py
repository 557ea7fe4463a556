"""The first row of each key of a stream, by a given order, not by arrival.

A stateful processor keeps the best row of a key until a timer of event time ends; a better row that
arrives later, in another batch or from another feed, replaces it. Every improvement is an update,
so the last update of a key is its row (:func:`last_updates`).

A call of the processor costs milliseconds, whatever it does, so keys are dealt to groups of some
``GROUP_KEYS``, which share a call and a row of the state; each keeps its own timer. Kept rows are
compressed, and read again only if the beginnings of the orders tie.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows travel as JSON text; times keep their microseconds.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
SHIFT = 1 << 63  # makes 64-bit numbers positive
#: Keys in a group, and the fewest groups.
GROUP_KEYS, LEAST_GROUPS = 64, 1024
#: Characters of an order text that the state keeps as they are; numbers have fewer.
HEAD = 24
STATE = "keys array<string>, heads array<array<string>>, rows array<binary>, untils array<long>, timers array<long>"


def sortable(column: Column, kind: T.DataType, descending: bool = False) -> Column:
    """A text that sorts, by code point, as the column does; null comes first, or last when descending.

    Whole numbers, times and dates in either direction, texts ascending only.
    """
    if isinstance(kind, T.StringType):
        if descending:
            raise ValueError("texts sort ascending only")
        return F.coalesce(F.concat(F.lit("1"), column), F.lit("0"))
    if isinstance(kind, T.TimestampType):
        number = F.unix_micros(column)
    elif isinstance(kind, T.DateType):
        number = F.unix_date(column).cast("bigint")
    elif isinstance(kind, T.IntegralType):
        number = column.cast("bigint")
    else:
        raise ValueError(f"no order for {kind.simpleString()}")
    wide = number.cast("decimal(38,0)")
    shift = F.lit(str(SHIFT - descending)).cast("decimal(38,0)")
    shifted = shift - wide if descending else shift + wide
    digits = F.lpad(shifted.cast("decimal(38,0)").cast("string"), 20, "0")
    return F.coalesce(F.concat(F.lit("1"), digits), F.lit("2" if descending else "0"))


def _keep_best(horizon_ms: int):
    """The processor, with all it needs, as workers may not have this module."""

    def packed(rank: list[str], row: str) -> bytes:
        return zlib.compress(json.dumps([rank, row], ensure_ascii=False).encode(errors="surrogatepass"), 1)

    def precedes(rank: list[str], row: str, head: list[str], stored: bytes) -> bool:
        """Whether a row comes before the one kept, of which ``head`` has the beginning of each order text."""
        for own, kept in zip(rank, head):
            if own[:HEAD] != kept:
                return own[:HEAD] < kept
            if len(kept) == HEAD:
                break  # they may differ behind
        return [rank, row] < json.loads(zlib.decompress(stored))

    def run(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        # of each key the beginnings of its order texts, its row, the end of its time, and its timer
        kept = {k: (h, bytes(p), u, t) for k, h, p, u, t in zip(*state.get)} if state.exists else {}
        ends: dict[str | None, int] = {}  # of the keys in this batch
        better: dict[str | None, tuple[list[str], str]] = {}
        for rows in () if state.hasTimedOut else batches:
            for key, order, row, time in zip(rows["__key"], rows["__order"], rows["__row"], rows["__ms"]):
                key = key if isinstance(key, str) else None
                if key not in ends:
                    ends[key] = kept[key][2] if key in kept else int(time) + horizon_ms
                rank = json.loads(order)
                if key in better:
                    ahead = (rank, row) < better[key]
                else:
                    ahead = key not in kept or precedes(rank, row, *kept[key][:2])
                if ahead:
                    better[key] = rank, row
        kept = {k: v for k, v in kept.items() if k in ends or v[3] >= now}
        for key, until in ends.items():
            if key in better:
                rank, row = better[key]
                head, stored = [r[:HEAD] for r in rank], packed(rank, row)
            else:
                head, stored = kept[key][:2]
            kept[key] = head, stored, until, max(until, now + 1)
        if kept:
            state.update((list(kept), *map(list, zip(*kept.values()))))
            state.setTimeoutTimestamp(min(v[3] for v in kept.values()))
        elif state.exists:
            state.remove()
        if better:
            yield pd.DataFrame({"row": [row for _, row in better.values()]})

    return run


def stream_first(
    rows: DataFrame,
    horizon: timedelta,
    key: str,
    time_col: str,
    order: Sequence[tuple[str, bool]],
    lateness: str | None = None,
    expected_keys: int = 1 << 20,
) -> DataFrame:
    """The first row of each key by ``order``, pairs of a column and whether it descends, as updates.

    A key is kept until the watermark passes its first row's time by ``horizon``; one that comes after
    that starts anew. Rows later than ``lateness`` (by default the horizon) are dropped. Rows without a
    time are dropped too, as no timer can end them; null keys count as one key. Rows equal in all of
    ``order`` are compared as JSON text. A repeated batch repeats the same updates. The columns are
    those of ``rows``.

    ``expected_keys`` are those held at a time, roughly; it sets the number of groups, so a stream that
    goes on from its checkpoint needs the same. More keys only make groups larger.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    ms = int(horizon.total_seconds() * 1000)
    ranks = F.to_json(F.array(*[sortable(F.col(c), kinds[c], down) for c, down in order]))
    packed = (
        rows.where(F.col(time_col).isNotNull())
        .withWatermark(time_col, lateness or f"{ms} milliseconds")
        .select(
            F.col(key).cast("string").alias("__key"),
            F.col(time_col).alias("__time"),
            F.unix_millis(F.col(time_col)).alias("__ms"),
            ranks.alias("__order"),
            F.to_json(F.struct("*"), JSON).alias("__row"),
        )
    )
    groups = F.lit(max(LEAST_GROUPS, expected_keys // GROUP_KEYS))
    grouped = packed.withColumn("__group", F.pmod(F.xxhash64("__key"), groups)).groupBy("__group")
    updates = grouped.applyInPandasWithState(
        _keep_best(ms), "row string", STATE, "update", GroupStateTimeout.EventTimeTimeout
    )
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    return updates.select(F.from_json("row", plain, JSON).alias("r")).select("r.*")


def last_updates(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The row each key was given last, of a folder with one partition for each ``batch``.

    A batch holds one update of a key at most.
    """
    updates = spark.read.parquet(path)
    kept = [c for c in updates.columns if c != "batch"]
    newest = updates.groupBy(key).agg(F.max_by(F.struct(*kept), "batch").alias("r"))
    return newest.select("r.*")
