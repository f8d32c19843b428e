"""Quoted text whose fields can hold line ends, read in parallel: no file is one task's work.

Lines are read by Spark's splits. A line end is a record's end if the quotes before it are even in number, so two passes
are enough. The first sums each split's quotes; prefix sums over a file's splits (a row a split) tell whether a
split begins inside a quoted field. The second puts the lines of a split together to records, in the reader's order, so that no
line is shuffled. What is left at a split's ends, at most two pieces, is joined with its neighbours' pieces.
A compressed file is one split and takes one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

PIECE = "file string, block long, pos int, record string"
#: Of a piece: a whole record, the rest of one that an earlier split began, the begin of one that a later split ends.
WHOLE, REST, BEGIN = 0, 1, 2
#: Ends of the names of files that Spark decompresses and can't split.
PACKED = (".gz", ".deflate")


def _pieces(file: str, block: int, pos: list[int] | np.ndarray, record: pa.Array) -> pa.RecordBatch:
    n = len(record)
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file, pa.string()), n), pa.repeat(pa.scalar(block, pa.int64()), n), pa.array(pos, pa.int32()), record], names=["file", "block", "pos", "record"])


def records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the lines (file, block, inside, line) of some splits, in order; `inside`: whether the split begins in a quoted field."""
    at, held, odd, started = None, [], False, False

    def last() -> pa.RecordBatch:
        return _pieces(*at, [REST if started else BEGIN], pa.array(["\n".join(held)], pa.string()))

    for batch in batches:
        if not len(batch):
            continue
        file, block, inside, line = batch.columns
        quotes = pc.count_substring(line, '"').to_numpy(zero_copy_only=False)
        # where splits change
        changes = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, changes]).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(batch)]):
            key = (file[a].as_py(), block[a].as_py())
            if key != at:
                if held:
                    yield last()
                at, held, odd = key, [], bool(inside[a].as_py())
                started = odd
            # whether each line's end, and so the next one's begin, lies inside a quoted field
            ends = (np.cumsum(quotes[a:b]) + odd) % 2 == 1
            parts = ends | np.r_[odd, ends[:-1]]
            odd, lines = bool(ends[-1]), line.slice(a, b - a)
            whole = lines.filter(pa.array(~parts)) if parts.any() else lines
            if len(whole):
                yield _pieces(*at, np.full(len(whole), WHOLE, np.int32), whole)
            pos, joined = [], []
            for i in np.flatnonzero(parts).tolist():
                held.append(lines[i].as_py())
                if not ends[i]:
                    pos.append(REST if started else WHOLE)
                    joined.append("\n".join(held))
                    held, started = [], False
            if joined:
                yield _pieces(*at, pos, pa.array(joined, pa.string()))
    if held:
        yield last()


def _lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.decode(F.col("value").cast("binary"), encoding).alias("line"))


def _split_records(lines: DataFrame) -> DataFrame:
    sums = lines.groupBy("file", "block").agg(F.sum(F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = sums.select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))
    # a row for each split goes to every task, so that the lines stay where, and in the order in which, they are read
    pieces = lines.join(F.broadcast(splits), ["file", "block"]).select("file", "block", "inside", "line").mapInArrow(records_of, PIECE)
    # only the pieces at the splits' ends are shuffled, at most two a split
    ends = pieces.where(F.col("pos") != WHOLE)
    number = F.count_if(F.col("pos") == BEGIN).over(Window.partitionBy("file").orderBy("block", "pos").rowsBetween(Window.unboundedPreceding, 0))
    joined = ends.withColumn("number", number).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "pos", "record"))).alias("p"))
    joined = joined.select("file", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    return pieces.where(F.col("pos") == WHOLE).select("file", "record").unionByName(joined)


def read_records(spark: SparkSession, paths: list[str] | str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(shard, record): the records of text files, the shard being the file's name.

    Quotes are doubled inside quoted fields, and only quoted fields hold quotes. A record's inner line ends are kept, one
    CR before its last goes; empty lines are no records. A file that ends inside a quoted field gives what there is of its last record.
    """
    paths = [paths] if isinstance(paths, str) else paths
    packed, plain = [p for p in paths if p.endswith(PACKED)], [p for p in paths if not p.endswith(PACKED)]
    # a compressed file begins outside of quotes, and what its only split leaves at its end is its last record
    parts = [_lines(spark, packed, encoding).select("file", "block", F.lit(False).alias("inside"), "line").mapInArrow(records_of, PIECE).select("file", "record")] if packed else []
    parts += [_split_records(_lines(spark, plain, encoding))] if plain else []
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.withColumn("record", F.when(F.col("record").endswith("\r"), F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))).where("record <> ''")
    return rows.select(F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("shard"), "record")


def read_quoted(spark: SparkSession, paths: list[str] | str, schema: StructType, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """The columns of `schema`, all text, and shard: empty fields are '', missing ones null."""
    options = {"sep": sep, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\u0000", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    rows = read_records(spark, paths, encoding).select("shard", F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r"))
    return rows.select("r.*", "shard")
