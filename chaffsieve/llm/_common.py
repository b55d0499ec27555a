"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass holds at a time; a longer text is a pass of its own.
SLICE_BYTES = 2 << 20

#: Maps every byte that is no word byte to a blank and A-Z to a-z: words are then [0-9a-z\x80-\xff]+.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Unset, a local session gets a folder of its own; a cluster falls back on the warehouse, which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local["):
            root = tempfile.mkdtemp(prefix="chaffsieve-")
            spark.conf.set("spark.checkpoint.dir", root)
        else:
            root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes `df` to the shared folder as Parquet and reads it back. The files go when the driver
    ends; `forgotten` takes those of a table that nothing reads any more."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forgotten(df: DataFrame) -> None:
    """Deletes the files of a table that `written` returned."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and the text as UTF-8 bytes under names that no other column can clash with."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("binary").alias("body"))


def slices(batches: Iterator[pa.RecordBatch], by: str = "body", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in slices of about `most` bytes of the column `by`, in order."""
    for batch in batches:
        sizes = np.diff(_offsets(batch.column(by)))
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 64
        if start < batch.num_rows:
            yield batch.slice(start)


def _offsets(column: pa.Array) -> np.ndarray:
    lengths = pc.fill_null(pc.binary_length(column), 0)
    return np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False))])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` neighbours; order counts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * _M1
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words, or of the whole sequence where it is shorter; nothing for no words."""
    return rolling(hashes, min(size, len(hashes))) if len(hashes) else np.empty(0, np.uint64)
