"""Substring search in names without reading every name: postings of trigrams.

The build writes the names with the keys of the rows that hold them, sorted by name; for every run of three characters of the
distinct folded names, the sorted names that hold it; and a table of how many keys and names each trigram has. A search reads the counts
of its text's trigrams, then the postings of the rarest and of those that are not much longer, intersects them, takes
the keys of the names that are left, and confirms what it reads on the names themselves. No result depends on the index: it only leaves out rows that can't hold the text.
All tables are sorted rows and not lists, so that no task holds a trigram's keys at once, and a name that many rows share is cut into trigrams once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold

NAMES, POSTINGS, COUNTS = "name string, key string", "trigram string, name string, n long", "trigram string, n long, names long"
#: A trigram's postings are read if there are at most so many times as many as of the rarest.
WORTH = 16
#: Up to so many keys, by the counts, a search names them to the scan, whose statistics then skip the rest; more are joined.
NAMED = 2_000
#: Up to so many names go to every task that looks for their keys, more are joined by shuffle.
BROADCAST = 50_000


def trigrams(folded: Column) -> Column:
    """The distinct runs of three characters of a text."""
    return F.array_distinct(F.regexp_extract_all(folded, F.lit("(?s)(?=(...))"), F.lit(1)))


def write_name_index(rows: DataFrame, key: str, names: list[str], path: str, folded: bool = False, **options: str) -> None:
    """Writes the names (name, key), the postings (trigram, name, n) and the counts (trigram, n, names) of the rows' names below `path`; n counts keys.

    Null names and those of less than three characters have no trigrams. A key with several rows of one name has as many rows.
    """
    spark, both = rows.sparkSession, F.array_distinct(F.array(*names))
    pairs = rows.select(F.explode(both).alias("name"), F.col(key).cast("string").alias("key")).where("name IS NOT NULL AND key IS NOT NULL")
    # ranges of names and keys, as one name may have most of the rows
    pairs.repartitionByRange("name", "key").sortWithinPartitions("name", "key").write.options(**options).parquet(f"{path}/names", compression="zstd")
    distinct = spark.read.schema(NAMES).parquet(f"{path}/names").groupBy("name").agg(F.count("*").alias("n"))
    postings = distinct.select(F.explode(trigrams(F.col("name") if folded else fold(F.col("name")))).alias("trigram"), "name", "n")
    postings.repartitionByRange("trigram", "name").sortWithinPartitions("trigram", "name").write.options(**options).parquet(f"{path}/postings", compression="zstd")
    counts = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("trigram").agg(F.sum("n").alias("n"), F.count("*").alias("names"))
    counts.repartitionByRange("trigram").sortWithinPartitions("trigram").write.options(**options).parquet(f"{path}/counts", compression="zstd")


class NameIndex:
    """The index that write_name_index has left at `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.names = spark.read.schema(NAMES).parquet(f"{path}/names")
        self.postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
        self.counts = spark.read.schema(COUNTS).parquet(f"{path}/counts")

    def _read(self, text: str) -> list[Row] | None:
        """The counts of the trigrams to read, as plan gives them."""
        wanted = self.spark.range(1).select(trigrams(fold(F.lit(text))).alias("t")).first().t  # at most as many as the text has characters
        if not wanted:
            return None
        known = self.counts.where(F.col("trigram").isin(wanted)).orderBy("n", "trigram").collect()
        return [r for r in known if r.n <= WORTH * known[0].n] if len(known) == len(wanted) else []

    def plan(self, text: str) -> list[tuple[str, int]] | None:
        """The trigrams to read with their numbers of keys, rarest first; empty if no name can hold the text, None if it has no trigram."""
        known = self._read(text)
        return known if known is None else [(r.trigram, r.n) for r in known]

    def keys(self, text: str) -> tuple[DataFrame | None, int]:
        """(key) of the rows whose names may hold the text, and how many there are at most; None where the index can't tell."""
        known = self._read(text)
        if known is None:
            return None, 0
        if not known:
            return self.spark.createDataFrame([], "key string"), 0
        lists = [self.postings.where(F.col("trigram") == r.trigram).select("name") for r in known]
        met = reduce(DataFrame.unionByName, lists).groupBy("name").agg(F.count("*").alias("lists")).where(F.col("lists") == len(lists)).select("name")
        met = F.broadcast(met) if min(r.names for r in known) <= BROADCAST else met
        return self.names.join(met, "name", "left_semi").select("key"), known[0].n

    def narrowed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """Those of rows whose key the index gives for the text; all of them where it can't tell."""
        keys, most = self.keys(text)
        if keys is None:
            return rows
        if most <= NAMED:
            return rows.where(F.col(key).isin([r.key for r in keys.collect()]))
        return rows.join(keys.withColumnRenamed("key", key), key, "left_semi")
