"""Writing results: artifacts with a manifest, redaction, and the shared folder for intermediates."""

from __future__ import annotations

import atexit
import contextlib
import functools
import json
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKERS = {"complete": "_SUCCESS_RUN", "complete_with_warnings": "_SUCCESS_RUN", "partial": "_PARTIAL", "failed": "_FAILED"}
REDACTED = "<redacted>"
SECRET_KEYS = r"(?i)(password|secret|token|api_?key|credential|authorization)"
TEXT_KEYS = {"text", "orig", "html"}
PATH_KEYS = r"(?i)(path|dir|file)$"


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quire-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, one of its own in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = _own_folder()
    return f"{at}/quire"


_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage of loops, and outlives a lost executor. Goes with the driver."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Joins of frames that lie by page read them in place, though their keys hold more than the page, and in the order of the files.
_IN_PLACE = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


@contextlib.contextmanager
def in_place(spark: SparkSession):
    """While it holds, frames of paged() are joined and ordered within their pages without a shuffle."""
    before = {k: spark.conf.get(k, None) for k in _IN_PLACE}
    for k, v in _IN_PLACE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def paged(df: DataFrame, key: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """written(), in one file per bucket of pages and sorted by page; what has no page is written as it comes."""
    if not set(key) <= set(df.columns):
        return written(df)
    spark = df.sparkSession
    name = f"quire_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _written.append((spark, path))
    df.repartition(n, *key).write.format("parquet").bucketBy(n, *key).sortBy(*key).option("path", path).saveAsTable(name)
    return spark.read.table(name)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def files(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """Inventory of a folder: path, bytes and SHA-256 of each file, read by Spark."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        r = r.option("pathGlobFilter", f"*{suffix}")
    return r.load(path).select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_artifacts(frames: dict[str, DataFrame], path: str, status: str = "complete") -> None:
    """Each frame as Parquet under path, then a manifest of all files, then the run's marker: the last thing written."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = None
    for name in frames:
        part = files(spark, f"{path}/{name}", ".parquet").withColumn("artifact", F.lit(name))
        manifest = part if manifest is None else manifest.unionByName(part)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    marker(spark, path, MARKERS[status], {"status": status, "artifacts": sorted(frames), "written_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())})


def marker(spark: SparkSession, path: str, name: str, content: dict) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()


def validate_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """What differs between the manifest and the files: missing, changed or unlisted."""
    listed = spark.read.schema("artifact string, path string, bytes long, sha256 string").json(f"{path}/manifest")
    names = [r["artifact"] for r in listed.select("artifact").distinct().collect()]  # one row per artifact of the run
    found = None
    for n in names:
        part = files(spark, f"{path}/{n}", ".parquet")
        found = part if found is None else found.unionByName(part)
    j = listed.alias("m").join(found.alias("f"), "path", "full")
    issue = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("m.sha256").isNull(), "unlisted").when(F.col("f.sha256") != F.col("m.sha256"), "changed")
    return j.select("path", issue.alias("issue")).where("issue IS NOT NULL")


def bounded_json(spark: SparkSession, path: str, schema: str, max_line_bytes: int = 8_000_000, max_rows: int = 2_000_000) -> DataFrame:
    """JSON lines within limits: a longer line or more rows is an error, blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    checked = lines.withColumn("value", F.when(F.octet_length("value") <= max_line_bytes, F.col("value")).otherwise(F.raise_error(F.lit("a line is too long")).cast("string")))
    if lines.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return checked.select(F.from_json("value", schema).alias("x")).select("x.*")


def redact(df: DataFrame, text: bool = True, paths: bool = True) -> DataFrame:
    """Replaces columns and nested fields with secrets, drops those with paths and replaces text, by their names."""

    def rewrite(col, kind, name):
        if re.search(SECRET_KEYS, name) or (text and name in TEXT_KEYS):
            return F.when(col.isNotNull(), F.lit(REDACTED)).cast("string")
        if isinstance(kind, T.StructType):
            kept = [f for f in kind.fields if not (paths and re.search(PATH_KEYS, f.name))]
            return F.when(col.isNotNull(), F.struct(*[rewrite(col[f.name], f.dataType, f.name).alias(f.name) for f in kept]))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(col, lambda x: rewrite(x, kind.elementType, name + "[]"))
        if isinstance(kind, T.StringType):
            return F.regexp_replace(col, r"([a-z][a-z0-9+.-]*://)[^/\s@]+@", f"$1{REDACTED}@")
        return col

    kept = [f for f in df.schema.fields if not (paths and re.search(PATH_KEYS, f.name))]
    return df.select(*[rewrite(F.col(f.name), f.dataType, f.name).alias(f.name) for f in kept])


def config_digest(config) -> str:
    """SHA-256 of a configuration in one JSON form."""
    import dataclasses
    import hashlib

    return hashlib.sha256(json.dumps(dataclasses.asdict(config), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
