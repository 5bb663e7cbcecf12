"""MinHash near-dedup by bottom-k sketches of one hash function.

A document's sketch is the k least hashes of its shingles. Inverted lists of retained values bring documents
together, the sketch of the union estimates their similarity, and full sets decide it.

No list is expanded into all its pairs. (1) Equal sets are one class from the start. (2) Sketches that share
`t` values share one among the first `shared - t + 1` of any one order of values, so only those are listed, the rarest
first; a passage that many documents share is not among them. (3) Each list ties its members to its most central one;
what that links needs no more pairs within. (4) What stands in one list but in two components is compared by its full
sets in the same way: of the shingles that another such document has too, the rarest `shared - t + 1` are listed, and two
documents of different components meet in a list only if what is left of both behind that place can still reach the
similarity, and the parities of their sets say so too. Sets that link share 75 percent of the larger one at least.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LOWER_ASCII, BitmapTest, Levels, bitmap, by_bitmap, connected_components, discard, narrowed, tidy, written


@dataclass(frozen=True)
class Sketching:
    """words: of a shingle. percent: of similarity that links. k: values of a sketch. least: shared values of two full
    sketches at that similarity, but for one pair in 10 to the 8th (a binomial's 5.7 deviations)."""

    words: int = 5
    percent: int = 75
    k: int = 64
    least: int = 28


class _Hashes(dict):
    """Word to 64-bit hash; forgets when it grows."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_set(text: str | None, hashes: dict, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of fewer words, one of all; none without words."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not ws:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    size = min(len(h), words)
    n = len(h) - size + 1
    s = np.full(n, size, np.uint64)
    for k in range(size):
        s = (s ^ h[k : k + n]) * _M[k % len(_M)]
        s ^= s >> np.uint64(29)
    s = s * _M[0]
    s ^= s >> np.uint64(32)
    return np.unique(s.view(np.int64))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


@tidy
def _sketches(batches: Iterator[pa.RecordBatch], p: Sketching) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for b in batches:
        size, digest, sketch = [], [], []
        for x in b["text"]:
            s = shingle_set(x.as_py(), hashes, p.words)
            size.append(len(s))
            digest.append(_digest(s) if len(s) else None)
            sketch.append(s[: p.k])
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sketch"])


@tidy
def _sets(batches: Iterator[pa.RecordBatch], p: Sketching, wanted: bytes, repeated: bytes | None, through: bool) -> Iterator[pa.RecordBatch]:
    """Full sets of the documents whose ids `wanted` lets through, and `repeated` does (through) or doesn't."""
    hashes, test, again = _Hashes(), BitmapTest(wanted), repeated and BitmapTest(repeated)
    for b in batches:
        b = b.filter(b["doc_id"].is_valid())
        ids = b["doc_id"].to_numpy()
        b = b.filter(pa.array(test(ids) & (again(ids) == through) if again else test(ids), pa.bool_()))
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            sets = [shingle_set(x.as_py(), hashes, p.words) for x in part["text"]]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sets, pa.list_(pa.int64()))], names=["rep", "set"])


def _full_sets(docs: DataFrame, repeated: DataFrame, wanted: bytes, p: Sketching) -> DataFrame:
    """rep, set: the sets of the documents that the bit map of ids lets through, equal ones of one id once."""

    def of(repeated: bytes | None, through: bool) -> DataFrame:
        return docs.mapInArrow(functools.partial(_sets, p=p, wanted=wanted, repeated=repeated, through=through), "rep long, set array<long>")

    repeated = bitmap(narrowed(repeated, "doc_id", wanted), "doc_id")
    if not any(repeated):
        return written(of(None, True))
    return written(of(repeated, False).unionByName(of(repeated, True).distinct()))


def rare_first(lists: pa.ListArray, levels: Levels, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which values of each list are to be listed: row, value, place, and for each row how many it shares.

    Of the values that have a level, the first `shared - least + 1` by level and value; place counts from 1.
    """
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    value = lists.flatten().to_numpy(zero_copy_only=False)
    level = levels(value)
    some = level > 0
    row, value, level = row[some], value[some], level[some]
    shared = np.bincount(row, minlength=len(lists))
    order = np.lexsort((value, level, row))
    row, value = row[order], value[order]
    place = np.arange(len(row)) - (np.cumsum(shared) - shared)[row] + 1
    take = place <= (shared - least + 1)[row]
    return row[take], value[take], place[take], shared


@tidy
def _listed(batches: Iterator[pa.RecordBatch], p: Sketching, levels: Levels) -> Iterator[pa.RecordBatch]:
    """v, rep, central: the values under which a sketch is listed, and how many values it shares."""
    for b in batches:
        n = b["n"].to_numpy()
        # Values that a sketch must share with any sketch of a similar set: exact for sets that are kept whole.
        least = np.minimum(-(-n * p.percent // 100), p.least)
        row, value, _, shared = rare_first(b["sketch"], levels, least)
        yield pa.RecordBatch.from_arrays([pa.array(value), b["rep"].take(pa.array(row)), pa.array(shared[row])], names=["v", "rep", "central"])


@tidy
def _placed(batches: Iterator[pa.RecordBatch], p: Sketching, levels: Levels, wanted: bytes) -> Iterator[pa.RecordBatch]:
    """s, rep, key, n, met, place: the shingles under which a full set is listed, and how many it shares.

    Of the ids that `wanted` lets through; filtered here, as one more Python step in a task is one more worker.
    """
    for b in by_bitmap(batches, "rep", wanted, True):
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            n = pc.list_value_length(part["set"]).to_numpy(zero_copy_only=False).astype(np.int64)
            row, value, place, met = rare_first(part["set"], levels, -(-n * p.percent // 100))
            columns = [pa.array(value), part["rep"].take(pa.array(row)), pa.array(_key(part["set"])[row]), pa.array(n[row]), pa.array(met[row]), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names=["s", "rep", "key", "n", "met", "place"])


def _key(sets: pa.ListArray) -> np.ndarray:
    """What tells the sets of one id apart."""
    return np.array([np.bitwise_xor.reduce(x.values.to_numpy(), initial=0) for x in sets], np.int64)


#: Words of 64 bits that hold the parities of a set.
PARITY = 16


def parities(sets: pa.ListArray) -> np.ndarray:
    """Whether an odd number of a set's values falls on each of PARITY * 64 bits; a row of words for each set.

    Two sets differ in at least as many values as their parities differ in bits.
    """
    bits = PARITY * 64
    row = np.repeat(np.arange(len(sets)), pc.list_value_length(sets).to_numpy(zero_copy_only=False))
    slot = (sets.flatten().to_numpy(zero_copy_only=False) >> 8) & (bits - 1)
    odd = np.bincount(row * bits + slot, minlength=len(sets) * bits).reshape(len(sets), bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


@tidy
def _parities(batches: Iterator[pa.RecordBatch], wanted: bytes) -> Iterator[pa.RecordBatch]:
    for b in by_bitmap(batches, "rep", wanted, True):
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            words = parities(part["set"])
            yield pa.RecordBatch.from_arrays([part["rep"], pa.array(_key(part["set"])), *[pa.array(words[:, i]) for i in range(PARITY)]], names=["rep", "key", *[f"p{i}" for i in range(PARITY)]])


def _estimated(a, b, k: int):
    """Values that both sketches hold among the k least of their union: that sketch's share of the intersection."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union))


def _ends(pairs: DataFrame) -> bytes:
    """A bit map of the ids in a written table of pairs."""
    return bitmap(pairs.select(F.explode(F.array("a", "b")).alias("rep")), "rep", 2 * pairs.count())


def _verified(pairs: DataFrame, sets: DataFrame, p: Sketching, few: bool = False) -> DataFrame:
    """pairs: ids a, b (written). Those whose sketches may, and full sets do, reach the similarity.

    few: of the sets only those at the ends of the pairs are written out first. The joins themselves run no Python, as two
    sides filtered in one task would be two workers more on each core.
    """

    def side(x: DataFrame, of: str, *columns) -> DataFrame:
        return x.select(F.col("rep").alias(of), F.size("set").alias(f"n_{of}"), *[c.alias(f"set_{of}") for c in columns])

    own = written(narrowed(sets, "rep", _ends(pairs))) if few else None
    sets = own if few else sets
    sketch = F.slice("set", 1, p.k)
    known = pairs.join(side(sets, "a", sketch), "a").join(side(sets, "b", sketch), "b")
    least = F.least(F.ceil(F.greatest("n_a", "n_b") * p.percent / 100), F.lit(p.least))
    likely = known.where((100 * F.least("n_a", "n_b") >= p.percent * F.greatest("n_a", "n_b")) & (_estimated(F.col("set_a"), F.col("set_b"), p.k) >= least)).select("a", "b")
    likely = written(likely)
    both = likely.join(side(sets, "a", F.col("set")), "a").join(side(sets, "b", F.col("set")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    found = written(both.withColumn("shared", shared).where(100 * F.col("shared") >= p.percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b"))
    discard(likely, *([own] if few else []))
    return found


def near_duplicates(docs: DataFrame, p: Sketching = Sketching()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text; others are left out).

    Texts without words (null, empty) have an empty set, link with nothing and are kept. Rows with equal ids count as
    one document, which links what any of its texts links; a null id links with nothing, has a null component and is
    kept. Ties don't occur: the smallest id of a component is kept. No rows give no rows.
    """
    docs = docs.selectExpr("cast(doc_id as long) AS doc_id", "text")
    table = written(docs.mapInArrow(functools.partial(_sketches, p=p), "doc_id long, n_shingles long, digest binary, sketch array<long>"))
    one = F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("x")
    reps = written(table.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(one).select("digest", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), F.col("x.sketch").alias("sketch")))
    ids = written(table.drop("sketch"))
    discard(table)

    # Values that two sketches hold, and under the rarest of them the sketches.
    frequent = written(reps.select(F.explode("sketch").alias("v")).groupBy("v").agg(F.count("*").alias("c")).where("c > 1"))
    listed = written(reps.mapInArrow(functools.partial(_listed, p=p, levels=Levels(frequent, "v")), "v long, rep long, central long"))
    classes = written(reps.select("digest", "rep"))
    discard(reps, frequent)

    # Each list's members with its most central one: the least changed copy holds the most shared values.
    heads = listed.groupBy("v").agg(F.max(F.struct("central", "rep")).alias("head"), F.count("*").alias("members")).where("members > 1").select("v", F.col("head.rep").alias("b"))
    star = listed.select("v", F.col("rep").alias("a")).join(heads, "v").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    star = written(star)
    repeated = written(ids.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    sets = _full_sets(docs, repeated, _ends(star), p)
    edges = _verified(star, sets, p)
    if not repeated.isEmpty():  # the texts of one id are one document
        same = ids.join(repeated, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
        edges = written(edges.unionByName(same.distinct()))
    discard(star, repeated)

    component = written(connected_components(edges).withColumnRenamed("node", "rep"))
    rest = _rest(listed, sets, component, p)
    discard(listed)
    more = _verified(rest, sets, p, few=True)
    discard(rest, sets)
    if not more.isEmpty():
        before, component = component, written(connected_components(edges.unionByName(more)).withColumnRenamed("node", "rep"))
        discard(before)
    discard(edges, more)
    ends = classes.join(component, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # Rows without a digest stay out of the join: they would all meet under one null key.
    found = ids.where("digest IS NOT NULL").join(ends, "digest", "left").unionByName(ids.where("digest IS NULL").withColumn("component", F.lit(None).cast("long")))
    out = written(
        found.select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
            (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component", "doc_id"))).alias("kept"),
        )
    )
    discard(ids, classes, component)
    return out


def _rest(listed: DataFrame, sets: DataFrame, component: DataFrame, p: Sketching) -> DataFrame:
    """Pairs a, b (written) of ids that stand in one list but not in one component and that their shared shingles allow."""

    def placed(x: DataFrame) -> DataFrame:
        return x.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    lists = placed(listed.select("v", "rep"))
    open_ = lists.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("v")
    reps = written(lists.join(open_, "v").select("rep").distinct())
    wanted = bitmap(reps, "rep")
    discard(reps)
    # Shingles that another document of an open list has too; a document needs 75 percent of its own among them.
    common = written(narrowed(sets, "rep", wanted).select(F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("c > 1"))
    levels = Levels(common, "s")
    discard(common)
    at = written(placed(sets.mapInArrow(functools.partial(_placed, p=p, levels=levels, wanted=wanted), "s long, rep long, key long, n long, met long, place long")))
    counts = at.groupBy("s", "component").agg(F.count("*").alias("c"))
    tops = counts.groupBy("s").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("s", F.col("top.component").alias("top"))
    spread = written(at.join(tops, "s"))
    discard(at)
    words = written(sets.mapInArrow(functools.partial(_parities, wanted=bitmap(spread, "rep")), "rep long, key long, " + ", ".join(f"p{i} long" for i in range(PARITY))))
    opened = spread.join(words, ["rep", "key"])
    columns = ("rep", "n", "met", "place", "component", *[f"p{i}" for i in range(PARITY)])
    a = opened.where("component <> top").select("s", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = opened.select("s", "top", *[F.col(c).alias(f"{c}_b") for c in columns])
    # One order of two that both are outside the largest component.
    once = (F.col("component_b") == F.col("top")) | (F.col("rep_a") < F.col("rep_b"))
    sizes = 100 * F.least("n_a", "n_b") >= p.percent * F.greatest("n_a", "n_b")
    # At the first shingle that both list, this one and those behind it are all that they can share.
    left = 1 + F.least(F.col("met_a") - F.col("place_a"), F.col("met_b") - F.col("place_b"))
    enough = (100 + p.percent) * left >= p.percent * (F.col("n_a") + F.col("n_b"))
    differ = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(PARITY)])
    alike = (100 + p.percent) * differ <= (100 - p.percent) * (F.col("n_a") + F.col("n_b"))
    pairs = a.join(b, "s").where((F.col("component_a") != F.col("component_b")) & once & sizes & enough & alike)
    out = written(pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct())
    discard(spread, words)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, hash(ws[i : i + 4]) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), one AS (
  SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), link AS (
  SELECT a, b FROM one UNION ALL SELECT b, a FROM one
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), low AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, low.component_id, low.component_id = d.doc_id AS kept
FROM documents d JOIN low USING (doc_id) LEFT JOIN n USING (doc_id)
"""
