"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where ``written`` has put a table.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset (tests), one in the warehouse, which they share too; being ours, it goes when the driver's JVM ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = re.sub("^file:/+", "file:///", f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", found)
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(found)
        fs = path.getFileSystem(context._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a later loss of an executor re-reads the files instead
    of recomputing what led to them.  Whoever holds the table may remove it with
    ``dropped`` once nothing reads it any more; those that a result still reads
    stay, for whoever owns the shared folder to clear after the job.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing will read again."""
    for own in tables:
        context = own.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(own))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: each query's go when it ends, not when the driver's garbage collection comes to them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def spelled(words: pa.ListArray, ids_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Ids of each list of words, one after another; ``ids_of`` has the ids of different words, one after another, and how many each has."""
    ends, coded = words.offsets.to_numpy(), words.values.dictionary_encode()
    flat, sizes = ids_of(coded.dictionary)
    places = coded.indices.to_numpy()
    lengths = sizes[places]
    stops = np.concatenate([[0], np.cumsum(lengths)])
    ids = flat[np.repeat((np.cumsum(sizes) - sizes)[places] - stops[:-1], lengths) + np.arange(stops[-1])]
    bounds = stops[ends].tolist()
    return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def by_bytes(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Neighbouring texts of about ``most`` bytes together."""
    group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield texts.slice(a, b - a)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def scale_partitions(spark: SparkSession, n_bytes: float, per_partition: float) -> int:
    """Partitions of about ``per_partition`` bytes, at least the session's own number."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(own, int(n_bytes // per_partition) + 1)


def to_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
