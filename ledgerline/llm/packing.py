"""Packing of documents into training sequences: concatenate and cut.

Two passes. The first encodes every document and writes its ids with their place among the split's tokens;
prefix sums over the splits' token totals (one number a split) turn these places into global ones. The second
pass cuts at multiples of the sequence length. No token is shuffled, and only the very last sequence has room
left. The written table holds each split's order fast, so a lost executor's tasks give the same pieces again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import slices, staged

PIECES = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0) -> DataFrame:
    """The pieces of all documents: (id_col, start, length, ids, doc_tokens, sequence_id, offset).

    A document is its text's ids (null text: none) and end_id after them. A piece is a run of them that lies in
    one sequence: `start` ids of the document come before it, it stands at `offset` in sequence `sequence_id`.
    ids are little-endian unsigned 32-bit integers. Offsets of a sequence have no gaps from 0 on. Repeated rows
    are packed each by itself; null ids are carried as they are. Other columns are not read.
    """
    name = bpe.ship(docs.sparkSession, tokenizer)
    end = np.uint32(end_id).astype("<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, place, split = bpe._load(name), 0, TaskContext.get().partitionId()
        for batch in batches:
            row = 0
            for texts in slices(batch.column(1)):
                ids = [x + end for x in model.encode_whole(texts)]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                places = place + np.cumsum(sizes) - sizes
                place += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), split), pa.int32()), batch.column(0).slice(row, len(ids)), pa.array(places), pa.array(sizes), pa.array(ids, pa.binary())],
                    names=["split", "id", "place", "n", "ids"],
                )
                row += len(ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, place, ids in zip(*(c.to_pylist() for c in batch.columns)):
                n, start = len(ids) // 4, 0
                while start < n:
                    sequence, offset = divmod(place + start, length)
                    size = min(n - start, length - offset)
                    rows.append((i, start, size, ids[4 * start : 4 * (start + size)], n, sequence, offset))
                    start += size
                if len(rows) > 10_000:
                    yield _pieces(rows)
                    rows = []
            if rows:
                yield _pieces(rows)

    encoded = staged(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(encode, "split int, id long, place long, n long, ids binary"), "ids")
    totals = encoded.groupBy("split").agg(F.sum("n").alias("total"))
    before = totals.select("split", (F.sum("total").over(Window.orderBy("split")) - F.col("total")).alias("before"))
    # one row of 12 bytes for each input split, which the driver schedules anyway
    placed = encoded.join(F.broadcast(before), "split").select("id", (F.col("before") + F.col("place")).alias("place"), "ids")
    return placed.mapInArrow(cut, PIECES).withColumnRenamed("id", id_col)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens): each sequence's ids in order; the last is padded with pad_id to `length`, but not where its size is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    full = (F.col("n_tokens") == length) | (F.expr("n_tokens & (n_tokens - 1)") == 0)
    pad = np.uint32(pad_id).astype("<u4").tobytes()
    return whole.select("sequence_id", F.when(full, ids).otherwise(F.concat(ids, F.expr(f"unhex(repeat('{pad.hex()}', {length} - CAST(n_tokens AS INT)))"))).alias("ids"), "n_tokens")
