"""What the training-data operators share: staged tables, boxed rows, batch slicing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; keeps its memory flat for any Arrow batch.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where that is unset, one of our own on a single machine, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage and fixes its rows against recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame, **named: str) -> DataFrame:
    """Column `row` holds all columns of docs by position, so that none can clash; each named one stands beside it."""
    cols = docs.columns
    flat = docs.toDF(*(f"c{i}" for i in range(len(cols))))
    return flat.select(F.struct(*flat.columns).alias("row"), *(F.col(f"c{cols.index(c)}").alias(k) for k, c in named.items()))


def unboxed(df: DataFrame, cols: list[str], **new: Column) -> DataFrame:
    """The columns that boxed() took, with those in `new` replaced where they exist and added where they don't."""
    out = [(new.get(c, F.col(f"row.c{i}")), c) for i, c in enumerate(cols)] + [(v, k) for k, v in new.items() if k not in cols]
    return df.select(*(v.alias(f"o{i}") for i, (v, _) in enumerate(out))).toDF(*(c for _, c in out))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """The texts of an Arrow batch (null: empty) as lists of at most `limit` bytes or one text."""
    part, size = [], 0
    for text in texts:
        text = text.as_py() or ""
        if part and size + len(text) > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cols or ("doc_id", "text"))
