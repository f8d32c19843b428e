"""Keyed tables that an upsert rewrites only where keys changed: copy-on-write by hash bucket.

A version of the table is a manifest, which names for each bucket the folder that holds its rows. An upsert reads the buckets that the new
rows fall into, writes these anew and then a manifest in which all others stay as they were. A manifest counts
once its folder is marked complete, so readers never see half an upsert; old folders stay until vacuum().
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bucket int, path string, epoch long, buckets int"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[str]:
    p, fs = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, target: str) -> list[int]:
    """The complete versions of a table, oldest first."""
    def complete(name: str) -> bool:
        mark, fs = _files(spark, f"{target}/manifest/{name}/_SUCCESS")
        return fs.exists(mark)

    return sorted(int(v[1:]) for v in _listed(spark, f"{target}/manifest") if v[1:].isdigit() and complete(v))


def manifest(spark: SparkSession, target: str, version: int | None = None) -> list:
    """Rows (bucket, path, epoch, buckets) of a version, by default of the newest; none before the first. As many rows as buckets."""
    known = versions(spark, target)
    if not known:
        return []
    return spark.read.schema(MANIFEST).json(f"{target}/manifest/v{version if version is not None else known[-1]}").orderBy("bucket").collect()


def live_path(spark: SparkSession, target: str) -> str | None:
    """A path pattern of the newest version's folders, which Spark reads as one table; null before the first version."""
    paths = [r.path for r in manifest(spark, target) if r.path]
    return f"{target}/rows/{{{','.join(paths)}}}" if paths else None


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert(batch: DataFrame, target: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], epoch: int, buckets: int = 64) -> list[int]:
    """Merges a batch into the table and returns the buckets rewritten; merge(new, old) gives the rows of the buckets of both.

    The batch's columns are the table's. A batch whose epoch is not beyond the table's own was merged before and
    changes nothing. The number of buckets is that of the first upsert. An attempt that breaks off leaves folders that no manifest names.
    """
    spark = batch.sparkSession
    now = manifest(spark, target)
    if now and max(r.epoch for r in now) >= epoch:
        return []
    buckets = now[0].buckets if now else buckets
    touched = sorted(r.bucket for r in batch.select(bucket_of(key, buckets).alias("bucket")).distinct().collect())  # at most `buckets` rows
    held = {r.bucket: r.path for r in now}
    if touched:
        old = [f"{target}/rows/{held[b]}" for b in touched if b in held]
        known = spark.read.schema(batch.schema).parquet(*old) if old else spark.createDataFrame([], batch.schema)
        folder = f"e{epoch}-{uuid.uuid4().hex[:8]}"
        rows = merge(batch, known).withColumn("bucket", bucket_of(key, buckets))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{target}/rows/{folder}", compression="zstd")
        held |= {b: f"{folder}/bucket={b}" for b in touched}
    version = (versions(spark, target) or [-1])[-1] + 1
    lines = [(b, p, epoch, buckets) for b, p in sorted(held.items())] or [(0, None, epoch, buckets)]
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{target}/manifest/v{version}")
    return touched


def vacuum(spark: SparkSession, target: str, keep: int = 2) -> list[str]:
    """Removes manifests but for the newest `keep`, and the folders of rows that none of these names; returns the folders removed.

    Only for a table that nobody is writing to; readers of the versions kept aren't disturbed.
    """
    known = versions(spark, target)
    kept = known[-keep:]
    named = {r.path for v in kept for r in manifest(spark, target, v)}
    removed = []
    for name in _listed(spark, f"{target}/manifest"):
        if name not in {f"v{v}" for v in kept}:
            p, fs = _files(spark, f"{target}/manifest/{name}")
            fs.delete(p, True)
    for folder in _listed(spark, f"{target}/rows"):
        for part in _listed(spark, f"{target}/rows/{folder}"):
            if part.startswith("bucket=") and f"{folder}/{part}" not in named:
                p, fs = _files(spark, f"{target}/rows/{folder}/{part}")
                fs.delete(p, True)
                removed.append(f"{folder}/{part}")
    return removed
