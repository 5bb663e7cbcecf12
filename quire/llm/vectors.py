"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import connected_components, tidy, written


@dataclass(frozen=True)
class Hashing:
    """cosine: links pairs from here on. recall: of pairs with just that cosine, by which the number of tables is set.
    bucket: vectors of a bucket to aim at, by which the bits of a table are set. block: vectors compared at a time;
    larger buckets are compared block by block. most_bits: of a table."""

    cosine: float = 0.9
    recall: float = 0.9999
    bucket: int = 400
    block: int = 1024
    most_bits: int = 30
    seed: int = 11

    def bits(self, vectors: int) -> int:
        return max(1, min(self.most_bits, math.ceil(math.log2(max(2, vectors) / self.bucket))))

    def tables(self, bits: int) -> int:
        """So many that a pair at the threshold meets in one of them with the probability `recall`."""
        meet = (1 - math.acos(self.cosine) / math.pi) ** bits
        return math.ceil(math.log(1 - self.recall) / math.log(1 - meet)) if meet < 1 else 1



def planes(size: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, tables * bits))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """A row of one bucket number per table for each vector."""
    signs = (x @ planes(x.shape[1], bits, tables, seed)) > 0
    return (signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32)


@tidy
def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's bytes; null where it can't be linked: null, empty, zero, or with a null or non-finite component."""
    for b in batches:
        out = []
        for v in b["embedding"]:
            x = np.zeros(0)
            if v.is_valid and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False)
            out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(out, pa.binary())], names=["vec_id", "vec"])


@tidy
def _hash(batches: Iterator[pa.RecordBatch], dtype: str, bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A row for each vector and table, with the vector and its buckets in all tables."""
    width = np.dtype(dtype).itemsize
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            vec = part["vec"].to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vec):
                by_size.setdefault(len(v), []).append(i)
            for size, rows in by_size.items():
                x = np.frombuffer(b"".join(vec[i] for i in rows), dtype).reshape(len(rows), size // width).astype(np.float64)
                sig = signatures(x, bits, tables, seed)
                bucket = (sig.astype(np.int64) + (np.arange(tables, dtype=np.int64) << bits)).reshape(-1)
                took = part.take(pa.array(np.repeat(rows, tables)))
                blobs = pa.array([s.tobytes() for s in sig], pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), tables)))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), size)), took["rep"], took["n"], took["vec"], blobs], names=["bucket", "size", "rep", "n", "vec", "sig"])


def links_of_group(table: int, x: np.ndarray, sig: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group with cosine of `least` or more that no earlier table has brought together.

    side: 0 for all where a block meets itself; else 0 and 1 for the two blocks, of which only pairs across count.
    """
    u = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (1 if side.any() else 0))
    i, j = np.nonzero(u[left] @ u[right].T >= least)
    i, j = left[i], right[j]
    once = i < j if not side.any() else np.ones(len(i), bool)
    i, j = i[once], j[once]
    if table:
        step, fresh = 1 << 16, []
        for at in range(0, len(i), step):
            fresh.append(~(sig[i[at : at + step], :table] == sig[j[at : at + step], :table]).any(1))
        keep = np.concatenate(fresh) if fresh else np.zeros(0, bool)
        i, j = i[keep], j[keep]
    return i, j


def roots(n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of n nodes the node with the least `order` that pairs i, j connect it to."""
    rank = np.empty(n, np.int64)
    rank[np.argsort(order, kind="stable")] = np.arange(n)
    low = rank.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        by_rank = np.empty(n, np.int64)
        by_rank[rank] = new
        new = np.minimum(new, by_rank[new])
        if (new == low).all():
            break
        low = new
    at = np.empty(n, np.int64)
    at[rank] = np.arange(n)
    return at[low]


@tidy
def _compare(batches: Iterator[pa.RecordBatch], dtype: str, bits: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows come by group; per linked vector of a group: its fresh links, and a vector of its component in the group."""

    def done(key, rows):
        if len(rows) < 2:
            return None
        rep = np.array([r[0] for r in rows], np.int64)
        n = np.array([r[1] for r in rows], np.int64)
        x = np.frombuffer(b"".join(r[2] for r in rows), dtype).reshape(len(rows), -1).astype(np.float64)
        sig = np.frombuffer(b"".join(r[3] for r in rows), np.int32).reshape(len(rows), -1)
        side = np.array([r[4] for r in rows], np.int64)
        i, j = links_of_group(int(key[0] >> bits), x, sig, side, least)
        if not len(i):
            return None
        links = np.bincount(i, weights=n[j], minlength=len(rows)) + np.bincount(j, weights=n[i], minlength=len(rows))
        root = rep[roots(len(rows), i, j, rep)]
        k = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(rep[k]), pa.array(root[k]), pa.array(links[k].astype(np.int64))], names=["rep", "root", "links"])

    key, rows = None, []
    for b in batches:
        keys = zip(*(b[c].to_pylist() for c in ("bucket", "size", "block_a", "block_b")))
        values = zip(*(b[c].to_pylist() for c in ("rep", "n", "vec", "sig", "side")))
        for k, v in zip(keys, values, strict=True):
            if k != key:
                if (out := done(key, rows)) is not None:
                    yield out
                key, rows = k, []
            rows.append(v)
    if (out := done(key, rows)) is not None:
        yield out


def near_duplicates(embeddings: DataFrame, h: Hashing = Hashing()) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of embeddings (vec_id, embedding; others are left out).

    Rows with equal vectors form a class, of which one vector is hashed and compared; its other rows count as links.
    Rows with a vector that can't be linked have no links and are their own component, and so has a null vec_id, with a
    null component and not kept. Repeated rows are vectors of their own. Buckets beyond h.block vectors are dealt
    in blocks, and each pair of blocks is compared by a task: none is cut. A pair is counted in the first table
    that brings it together, so no pair is ever shuffled: a group returns a row per linked vector.
    """
    kind = embeddings.schema["embedding"].dataType.elementType.simpleString()
    dtype = "float32" if kind == "float" else "float64"
    cast = "array<float>" if kind == "float" else "array<double>"
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(cast).alias("embedding"))
    raw = written(given.mapInArrow(_raw, "vec_id long, vec binary"))
    able = raw.where("vec IS NOT NULL AND vec_id IS NOT NULL")
    reps = written(able.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    bits = h.bits(reps.count())
    tables = h.tables(bits)
    spread = reps.repartition("rep")  # small rows, much work on each
    hashed = spread.mapInArrow(functools.partial(_hash, dtype=dtype, bits=bits, tables=tables, seed=h.seed), "bucket long, size long, rep long, n long, vec binary, sig binary")
    large = hashed.groupBy("bucket", "size").count().where(F.col("count") > h.block).select("bucket", "size", F.ceil(F.col("count") / h.block).cast("int").alias("blocks"))
    large = written(large)
    placed = hashed.join(large, ["bucket", "size"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = (
        placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "size", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), (F.col("block") > F.col("other")).cast("int").alias("side"), "rep", "n", "vec", "sig")
    )
    group = ["bucket", "size", "block_a", "block_b"]
    found = dealt.repartition(*group).sortWithinPartitions(*group, "rep").mapInArrow(functools.partial(_compare, dtype=dtype, bits=bits, least=h.cosine), "rep long, root long, links long")
    found = written(found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    classes = reps.join(links, "rep", "left").join(components, "rep", "left").select(
        F.col("vec").alias("of_vec"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    return raw.join(classes, (F.col("vec") == F.col("of_vec")) & F.col("vec_id").isNotNull(), "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, r.component_id, r.component_id = e.vec_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id
"""
