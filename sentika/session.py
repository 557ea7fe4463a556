"""Session helpers: shared scratch space, reliable checkpoints, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine;
    on a cluster a missing setting is an error, because files written to one
    node are lost with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="sentika-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared root; never reused, never cleared."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (eager).

    Pins values that a recomputation could change, such as partition ids after
    a sampled range partitioning, so that losing an executor is harmless.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 500_000, max_chars: int = 1 << 26) -> DataFrame:
    """Mark a lookup side for broadcast after counting it, else leave it to be shuffled.

    The count (an action on at most ``max_rows + 1`` rows) is needed because Spark
    knows no size for tables made in the driver or by a checkpoint, and could then
    broadcast the large side, whose size it underestimates once texts are exploded.
    """
    text = [F.length(f.name) for f in df.schema if f.dataType.typeName() == "string"]
    chars = sum((F.coalesce(n, F.lit(0)) for n in text), F.lit(0))
    size = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(chars).alias("chars")).first()
    if size.rows > max_rows or (size.chars or 0) > max_chars:
        return df
    return F.broadcast(df)


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns so that later filters on them reuse the computed value.

    The optimizer pushes a filter below the projection that defines its column
    and so evaluates the definition twice, which for a chain of regular
    expressions doubles the cost of the job. A one-row generator is a boundary
    that filters on its output do not cross, while column pruning still does.
    """
    kept = [c for c in df.columns if c not in columns]
    fields = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(fields)))
