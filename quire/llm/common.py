"""What the training-data operators share: reading, written intermediates, fixed-size bit maps, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: the class ``[\x20\x09-\x0D]``, which is what ``bytes.split()`` uses too.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A to Z only.
LOWER_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Rows of an Arrow batch. Documents are large rows: Spark's default of 10,000 would hold tens of MB per task, twice.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task holds of whole texts, in the JVM and in Python, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="quire-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{_local_scratch()}"
    return f"{at}/quire"


_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, is computed once and outlives an executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_quire_path", None):
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


#: Bits of a bit map for each key, and the least and most of one: 1 to 32 MB. With more keys than that it lets more
#: through, never fewer, and every use of one is followed by an exact join or count.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 23, 1 << 28


def bitmap(hashes: DataFrame, column: str, keys: int | None = None, per_key: int = BITS_A_KEY, least: int = LEAST_BITS) -> bytes:
    """A one-hash Bloom filter over a long column, sized by the number of keys (counted if not given).

    Words of 64 bits reach the driver as Arrow batches, at most MOST_BITS / 64 of them.
    """
    keys = hashes.count() if keys is None else keys
    bits = min(MOST_BITS, max(least, 1 << (per_key * max(1, keys) - 1).bit_length()))
    slot = F.pmod(F.col(column), F.lit(bits))
    rows = (
        hashes.where(F.col(column).isNotNull())
        .select(F.shiftright(slot, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int")).alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.tobytes()


class BitmapTest:
    """Membership test for numpy arrays of int64 hashes."""

    def __init__(self, data: bytes):
        self.words = np.frombuffer(data, np.int64)
        self.bits = np.int64(len(self.words) * 64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slot = np.mod(hashes.astype(np.int64), self.bits)
        return (self.words[slot >> 6] >> (slot & 63)) & 1 == 1


class Levels:
    """How frequent hashes are, by bit maps of those that occur `steps` times or more: 0 below the first step.

    A map may let more through, the same for every task; so the levels order hashes alike everywhere.
    """

    def __init__(self, counts: DataFrame, column: str, steps: tuple[int, ...] = (2, 5, 20, 100, 1000)):
        """counts: column and `c`, its number of occurrences."""
        self.maps = []
        for step in steps:
            some = counts.where(F.col("c") >= step)
            keys = some.count()
            if not keys and self.maps:
                break
            self.maps.append(bitmap(some, column, keys, per_key=16, least=1 << 16))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        tests = [BitmapTest(m)(hashes) for m in self.maps]
        return np.where(tests[0], np.sum(tests, axis=0), 0)


def narrowed(df: DataFrame, column: str, data: bytes) -> DataFrame:
    """The rows of df whose long key the bit map lets through; nothing is shuffled."""
    return df.mapInArrow(functools.partial(by_bitmap, column=column, data=data, through=True), df.schema)


def _release() -> None:
    """Gives freed memory back to the system: Python workers are kept for later tasks, and what they hold counts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(f):
    """For functions of mapInArrow: releases memory at the end of a partition."""

    @functools.wraps(f)
    def g(batches, *args, **kwargs):
        try:
            yield from f(batches, *args, **kwargs)
        finally:
            _release()

    return g


@tidy
def by_bitmap(batches: Iterator[pa.RecordBatch], column: str, data: bytes, through: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose long key the map lets through, or the others; null keys are among the others."""
    test = BitmapTest(data)
    for b in batches:
        key = b[column]
        hit = test(pc.fill_null(key, 0).to_numpy(zero_copy_only=False)) & key.is_valid().to_numpy(zero_copy_only=False)
        yield b.filter(pa.array(hit == through, pa.bool_()))


#: Bytes of text that are worked on together. A longer text is a chunk of its own.
CHUNK_BYTES = 3 << 19


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of a batch of texts with about `most` bytes each."""
    start = held = 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    edges: columns a, b (long). Returns node, component. Alternates two steps until nothing changes:
    every node's larger neighbours are tied to the smallest neighbour (large star), then its smaller
    ones (small star). Both are a grouped minimum, which Spark combines before the shuffle, and a join
    on the node; no neighbour list is ever gathered. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    e = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = written(e)
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a <> b")
            .distinct()
        )
        new = written(small)
        discard(large)
        # Ended when every node has one edge and its end has none upwards: stars only.
        ends = new.select("b").distinct().join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        many = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select(F.col("a").alias("b"))
        done = ends.unionByName(many).isEmpty()
        discard(e)
        e = new
        if done:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
