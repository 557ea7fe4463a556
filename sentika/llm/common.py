"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentika.session import scratch_path

#: Upper to lower case for the ASCII letters alone, byte by byte.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The same, with every ASCII byte that is no letter or digit made a blank.
ALNUM_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


#: Bytes of an Arrow batch sent to a Python worker; a longer row makes a batch of its own.
BATCH_BYTES = 4 << 20
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, and bound their batches.

    Functions that run on executors are imported there by name, wherever the driver was started.
    Batches end at ``BATCH_BYTES``, so that a worker's memory does not follow the length of texts.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="sentika-code-"), f"{top.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` below the shared scratch folder and read it back.

    Cuts the lineage with files that survive a lost executor, and computes the rows once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """Key of a row that holds for null and repeated ids: the id with a hash of the text.

    Rows equal in both are the same record, and share all that is found for it.
    """
    return F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), F.xxhash64(text_col))


def blocks_of(
    batches: Iterable[pa.RecordBatch], text: str, max_bytes: int
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into runs of rows with at most ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = text_bytes(batch.column(batch.schema.get_field_index(text)))
        sizes = [len(b) for b in texts]
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start), texts[start:i]
                start, total = i, 0
            total += n
        yield batch.slice(start), texts[start:]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every input bit (in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
