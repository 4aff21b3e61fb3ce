"""Pieces that the training-data operators share.

Words are the runs of bytes between ASCII white space (``[^\\x20\\x09-\\x0D]+``): that is what
``bytes.split()`` returns, and ``bytes.lower()`` folds A-Z alone. A null text has no words.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's cache may hold before it is emptied.
CACHE_ENTRIES = 400_000
#: Rows of one key that a task of spread_join() gets, but for the unevenness of hashing; rows that are broadcast at most.
ROWS, BROADCAST_ROWS = 2_000, 200_000
#: Bytes of rows that an operator's function gets at once.
PIECE_BYTES = 1 << 23


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


class Cache(dict):
    """A dict that computes what it lacks; ``trim()`` empties it between batches once it is large."""

    def __init__(self, make: Callable, most: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def hash_cache(seed: int) -> Cache:
    """Word -> signed 64-bit hash."""
    return Cache(lambda w: xxhash.xxh64_intdigest(w, seed) - (1 << 63))


def looked_up(cache: Cache, keys: list, kind=np.int64) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, keys), kind, len(keys))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output (arithmetic modulo 2**64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidemark/{uuid.uuid4().hex}/{name}"


def saved(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder: cuts lineage, and survives the loss of any executor."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of saved() and lets Spark drop the shuffle files that nothing refers to any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def freed(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect garbage, which is when Spark deletes shuffles that no plan refers to."""
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(many: DataFrame, one: DataFrame, on: str, by: str, how: str = "inner", rows: int = ROWS) -> DataFrame:
    """many joined with ``one``, which has one row for each ``on``; keys of more than ``rows`` rows are dealt to several tasks by the hash of ``by``.

    Frequent keys are counted first, and only their rows of ``one`` are copied; ``many`` is read twice.
    """
    spark = many.sparkSession
    parts, part = unused(many, "_parts"), unused(many, "_part")
    hot, path = saved(spark, many.groupBy(on).count().where(F.col("count") > rows).select(on, F.ceil(F.col("count") / rows).alias(parts)), "hot")
    n = hot.count()
    if not n:
        dropped(spark, path)
        return many.join(one, on, how)
    if n <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    left = many.join(hot, on, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(by), F.col(parts)), F.lit(0))).drop(parts)
    right = one.join(hot, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return left.join(right, [on, part], how).drop(part)


def by_batch(df: DataFrame, columns: list, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Rows of ``schema`` from each Arrow batch of ``columns``, cut to pieces of bounded size; make() is called once for each task."""
    names = [x.split()[0].strip("`") for x in _split_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for piece in pieces(batch):
                out = f(piece)
                yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names=names)

    importable(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes, or of one row where that has more."""
    if batch.nbytes <= most:
        if batch.num_rows:
            yield batch
        return
    size = np.zeros(batch.num_rows, np.int64)
    for x in batch.columns:
        if pa.types.is_string(x.type) or pa.types.is_binary(x.type):
            size += pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(x.type):
            size += 8 * pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.diff((np.cumsum(size) - size) // most, prepend=0))
    bounds = [0, *at.tolist(), batch.num_rows]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver found it (unless it was shipped to them)."""
    root = str(Path(__file__).resolve().parents[2])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = f"{path}{os.pathsep}{root}".strip(os.pathsep)


def _split_schema(schema: str) -> list[str]:
    """Top-level fields of a DDL string."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(schema[last:i].strip())
            last = i + 1
    return [*parts, schema[last:].strip()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lists(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def fold(key, modulus: int):
    """crc32 of the key's decimal text modulo ``modulus``; null where the key is null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
