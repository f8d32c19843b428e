"""Drops lines that many documents repeat.

Two Bloom filters, of line keys seen once and seen twice, are built per input split and merged: a bit
that two splits set counts as seen twice, so the merged second filter holds every repeated key. Only
keys that it holds are shuffled, as 128-bit digests, for exact counts of distinct documents and the
choice of the one document that keeps the line. Lines of all other keys never leave their task.

The filters grow with the bytes of text, from 16 MB up to 128 MB each (what a worker holds): beyond some
hundred million distinct keys more keys become suspects, and the exact confirmation by shuffle takes them
all; nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, slices, staged, unboxed

WHITE = b" \t\n\x0b\x0c\r"
SEGMENTS = 256
#: log2 of the bits of a filter, at least and at most; bits for each line that the text could hold.
LEAST_BITS, MOST_BITS, PER_LINE = 27, 30, 8
HASHES = 2


def _keys(text: str, min_chars: int) -> list[bytes | None]:
    """Of each line: the stripped, A-Z lower-cased key, None if it is shorter than min_chars code points."""
    out = []
    for line in text.encode().lower().split(b"\n"):
        key = line.strip(WHITE) if len(line) >= min_chars else b""
        out.append(key if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars else None)
    return out


def _bits(keys: list[bytes], filter_bits: int) -> np.ndarray:
    """Bit numbers of each key, one row for each hash."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)
    return np.stack([(h[:, 0] + np.uint64(i) * h[:, 1]) % np.uint64(filter_bits) for i in range(HASHES)])


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _put(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bitmap, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def filter_size(docs: DataFrame, min_chars: int) -> int:
    """Bits of a filter for docs' text, if its lines are twice as long as the shortest that count."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    lines = size // (2 * max(min_chars, 1))
    return 1 << min(max((PER_LINE * lines).bit_length(), LEAST_BITS), MOST_BITS)


def _filters(docs: DataFrame, min_chars: int, filter_bits: int) -> np.ndarray:
    """The merged filter of keys that two documents may share."""
    width = filter_bits // 8 // SEGMENTS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(filter_bits // 8, np.uint8), np.zeros(filter_bits // 8, np.uint8)
        for batch in batches:
            for texts in slices(batch.column(0)):
                keys: dict[bytes, int] = {}
                for text in texts:
                    for key in {k for k in _keys(text, min_chars) if k is not None}:
                        keys[key] = keys.get(key, 0) + 1
                if keys:
                    at = _bits(list(keys), filter_bits)
                    again = _has(once, at) | (np.fromiter(keys.values(), np.int64) > 1)
                    _put(twice, at[:, again])
                    _put(once, at)
        for i in range(SEGMENTS):
            part = slice(i * width, (i + 1) * width)
            if once[part].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([once[part].tobytes()]), pa.array([twice[part].tobytes()])], names=["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if i in held:
                    once, twice = held[i]
                    held[i] = [once | a, twice | b | (once & a)]
                else:
                    held[i] = [a, b]
        for i, (_, twice) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([twice.tobytes()])], names=["segment", "twice"])

    parts = docs.select("text").mapInArrow(build, "segment int, once binary, twice binary").repartition("segment").mapInArrow(merge, "segment int, twice binary")
    out = np.zeros(filter_bits // 8, np.uint8)
    for row in parts.collect():  # at most SEGMENTS rows, filter_bits / 8 bytes in all
        out[row.segment * width : (row.segment + 1) * width] = np.frombuffer(row.twice, np.uint8)
    return out


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, filter_bits: int | None = None) -> DataFrame:
    """docs with repeated lines dropped from text_col, and the counts n_lines and n_dropped.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least
    min_chars code points in at least min_docs documents lose their lines everywhere but in the document
    with the largest id. Null or empty text is one empty line and comes back as empty text. Rows with the
    same id count as one document; rows without an id keep all lines and are not counted. Other columns
    pass through; columns named n_lines and n_dropped are replaced. filter_bits, if given, is a multiple of 2048.
    """
    spark, cols = docs.sparkSession, docs.columns
    box = boxed(docs, id=id_col, text=text_col)
    filter_bits = filter_bits or filter_size(box, min_chars)
    seen = spark.sparkContext.broadcast(_filters(box.where("id IS NOT NULL"), min_chars, filter_bits))

    @F.arrow_udf("struct<n_lines: long, suspects: array<binary>>")
    def suspects(texts: pa.Array) -> pa.Array:
        lines, found = [], []
        for part in slices(texts):
            of = [_keys(text, min_chars) for text in part]
            flat = [k for keys in of for k in keys if k is not None]
            maybe = iter(_has(seen.value, _bits(flat, filter_bits)).tolist() if flat else [])
            for keys in of:
                lines.append(len(keys))
                found.append(list({_digest(k) for k in keys if k is not None and next(maybe)}))
        return pa.StructArray.from_arrays([pa.array(lines, pa.int64()), pa.array(found, pa.list_(pa.binary()))], names=["n_lines", "suspects"])

    @F.arrow_udf("struct<text: string, n_dropped: long>")
    def without(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        kept, n = [], []
        for text, drop in zip(texts, dropped):
            text, drop = text.as_py() or "", set(drop.as_py() or ())
            lines = text.split("\n")
            left = [x for x, k in zip(lines, _keys(text, min_chars)) if k is None or _digest(k) not in drop] if drop else lines
            kept.append("\n".join(left))
            n.append(len(lines) - len(left))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n, pa.int64())], names=["text", "n_dropped"])

    marked = staged(box.withColumn("found", suspects("text")).select("row", "id", "found.*"), "lines")
    text = F.col(f"row.c{cols.index(text_col)}")
    some = F.col("id").isNotNull() & (F.size("suspects") > 0)

    pairs = marked.where(some).select("id", F.explode("suspects").alias("key")).distinct()
    shared = pairs.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    drops = pairs.join(shared, "key").where("id <> keeper").groupBy("id").agg(F.collect_list("key").alias("dropped"))

    clean = marked.where(~some).select("row", "n_lines", F.coalesce(text, F.lit("")).alias("kept"), F.lit(0).cast("long").alias("n_dropped"))
    cut = marked.where(some).join(drops, "id", "left").withColumn("left", without(text, F.col("dropped"))).select("row", "n_lines", F.col("left.text").alias("kept"), F.col("left.n_dropped").alias("n_dropped"))
    return unboxed(clean.unionByName(cut), cols, **{text_col: F.col("kept"), "n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")})
