"""How the sources of a language diverge in their words: hash-consed segment trees over term ids.

Tasks count terms first, so that Spark shuffles counts and no words. A language's kept terms are dealt over
segments, those of a segment are numbered by falling count, and every source (and the language as a whole) becomes
a segment tree over these numbers. Trees of one segment share their nodes: subtrees with the same counts are one
node. Two trees are walked down together, level by level; equal pairs of nodes are met once, with the number of
places where they stand, and so each pair of counts is priced once. The prices depend on both sources' totals,
thus what one pair of sources has priced does not serve another.

A task holds one segment of two blocks of sources, whatever the number of terms, sources or documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Terms of a segment, on average, and sources of a block: what one task holds of a language.
SEGMENT, BLOCK = 8192, 32
#: Distinct terms, and bytes of text, after which a task hands its counts on.
ENTRIES, BYTES = 400_000, 256 << 20
#: Terms are runs of bytes of ASCII letters or of any character beyond ASCII; A-Z are lower-cased.
SEPARATE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"
PRICED = "source string, part string, item string, value long"
#: Shares are in billionths, in three steps of thousands so that nothing overflows.
STEPS, STEP = 3, 1000


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of what a task has read; term null: the group itself."""
    held: dict[tuple[str, str], list] = {}
    entries = size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            group = held.setdefault((lang, source), [Counter(), Counter(), 0])
            terms = text.translate(SEPARATE).split()
            entries -= len(group[0])
            group[0].update(terms)
            group[1].update(set(terms))
            group[2] += 1
            entries += len(group[0])
            size += len(text)
            if entries > ENTRIES or size > BYTES:
                yield from _counts(held)
                held, entries, size = {}, 0, 0
    yield from _counts(held)


def _counts(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs, total) in held.items():
        terms = list(n)
        for i in range(0, len(terms) + 1, 50_000):
            part = terms[i : i + 50_000]
            own = [total] if i == 0 else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(own) + len(part)), pa.string()),
                    pa.array([source] * (len(own) + len(part)), pa.string()),
                    pa.array([None] * len(own) + part, pa.binary()).cast(pa.string()),
                    pa.array([0] * len(own) + [n[t] for t in part], pa.int64()),
                    pa.array(own + [docs[t] for t in part], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), exactly, for totals below 9 * 10^15."""
    out, rest = np.zeros_like(count), count + 2
    for _ in range(STEPS):
        whole, rest = np.divmod(rest * STEP, total + 2 * terms)
        out = out * STEP + whole
    return 1 + out


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Forest:
    """Segment trees with shared nodes over the rows of a matrix of counts (trees x terms); places beyond the last term hold -1."""

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        padded = np.full((len(counts), width), -1, np.int64)
        padded[:, : counts.shape[1]] = counts
        self.counts, self.leaves = self._shared(padded)
        #: Of each level above the leaves: (number of nodes below, left child, right child) by node.
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        nodes, below = self.leaves, len(self.counts)
        while nodes.shape[1] > 1:
            made, nodes = self._shared(nodes[:, 0::2] * below + nodes[:, 1::2])
            self.levels.append((below, made // below, made % below))
            below = len(made)
        self.roots = nodes[:, 0]

    @staticmethod
    def _shared(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made, node = np.unique(keys, return_inverse=True)
        return made, node.reshape(keys.shape)

    def leaf_pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of two trees: the distinct pairs of leaves that stand at one place, and at how many places each does.

        Goes down from the roots; a pair of nodes that comes up at many places is opened once.
        """
        left, right, places = self.roots[[a]], self.roots[[b]], np.ones(1, np.int64)
        for below, first, second in reversed(self.levels):
            pair = np.concatenate([first[left] * below + first[right], second[left] * below + second[right]])
            pair, at = np.unique(pair, return_inverse=True)
            places = np.bincount(at, np.concatenate([places, places])).astype(np.int64)
            left, right = pair // below, pair % below
        real = self.counts[left] >= 0
        return left[real], right[real], places[real]


def audited(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 10, top_terms: int = 10, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs.

    A language keeps the terms found in at least min_docs of its documents (rows; a repeated row counts again).
    A term's share in a group is p = 1 + floor(10^9 * (count + 2) / (N + 2V)), with N all occurrences of kept terms
    there and V kept terms; two shares cost floor((p - q)^2 / (p + q)). Part `pair`: each other source of the
    language with the sum over all kept terms (0 where none is kept). Part `term`: the top_terms terms that occur in
    the group with a larger share than in the language, by that cost. Ranks count from 1 by value falling, then item
    by its UTF-8 bytes. A task holds `segment` terms of twice `block` sources. Null lang, source and text count as ''; no rows give no rows; other columns aren't read.
    """
    cols = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"))]
    parts = docs.select(*cols, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")).mapInArrow(counted, COUNTED)
    term = Window.partitionBy("lang", "term")
    merged = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    merged = merged.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("df"), F.sum("n").over(term).alias("total"), (F.min("source").over(term) == F.col("source")).alias("first"))
    kept = staged(merged.where(F.col("term").isNull() | (F.col("df") >= min_docs)).drop("df"), "terms")

    lang = Window.partitionBy("lang")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count_if(F.col("first") & F.col("term").isNotNull()).alias("firsts"))
    groups = groups.select(
        "lang", "source", "group_n",
        F.sum("firsts").over(lang).alias("v"), F.sum("group_n").over(lang).alias("lang_n"),
        (F.row_number().over(lang.orderBy("source")) - 1).alias("member"), F.count(F.lit(1)).over(lang).alias("members"),
    )
    groups = groups.withColumns({"block": F.floor(F.col("member") / block).cast("int"), "blocks": F.ceil(F.col("members") / block).cast("int"), "segments": F.greatest(F.lit(1), F.ceil(F.col("v") / segment)).cast("int")})
    groups = staged(groups, "groups")

    def met(df: DataFrame) -> DataFrame:
        """Each row once for every block that its own block is held against."""
        return df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def row(df: DataFrame, member, term, n, source=None, v=None, lang_n=None) -> DataFrame:
        null = lambda c, kind: (F.lit(None) if c is None else F.col(c)).cast(kind)
        return df.select("lang", "segment", "lo", "hi", member.cast("int").alias("member"), term.cast("string").alias("term"), F.col(n).cast("long").alias("n"), null(source, "string").alias("source"), null(v, "long").alias("v"), null(lang_n, "long").alias("lang_n"))

    placed = kept.where(F.col("term").isNotNull()).join(groups, ["lang", "source"]).withColumn("segment", F.pmod(F.xxhash64("term"), F.col("segments")).cast("int"))
    whole = placed.where("first").withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("hi", F.explode(F.sequence(F.col("lo"), F.col("blocks") - 1)))
    heads = groups.withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))
    rows = row(met(placed), F.col("member"), F.col("term"), "n").unionAll(row(whole, F.lit(-1), F.col("term"), "total")).unionAll(row(met(heads), F.col("member"), F.lit(None), "group_n", "source", "v", "lang_n"))

    def price(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = key[2].as_py(), key[3].as_py()
        return pa.table(priced(table, lo, hi, top_terms, block), schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]))

    found = rows.groupBy("lang", "segment", "lo", "hi").applyInArrow(price, f"lang string, {PRICED}")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top_terms))


def priced(table: pa.Table, lo: int, hi: int, top_terms: int, per_block: int) -> dict[str, list]:
    """What the sources of two blocks cost in one segment, and each source's dearest terms against the language."""
    head = table.filter(pc.is_null(table["term"])).to_pylist()
    head.sort(key=lambda r: r["member"])
    member_row = {r["member"]: i for i, r in enumerate(head)}
    body = table.filter(pc.is_valid(table["term"]))
    terms = pa.chunked_array(body["term"].chunks, pa.string()).combine_chunks().dictionary_encode()
    code, names = terms.indices.to_numpy(zero_copy_only=False), terms.dictionary
    member, n = body["member"].to_numpy(), body["n"].to_numpy()
    total = np.zeros(len(names), np.int64)
    total[code[member < 0]] = n[member < 0]
    order = np.argsort(-total, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    counts = np.zeros((len(head) + 1, len(names)), np.int64)
    row_of = np.full(max(member_row) + 2, -1)
    row_of[list(member_row)] = list(member_row.values())
    row_of[-1] = len(head)  # the language
    counts[row_of[member], place[code]] = n
    out: dict[str, list] = {"lang": [], "source": [], "part": [], "item": [], "value": []}
    lang = head[0]["lang"]

    def add(source: str, part: str, item: str, value: int) -> None:
        for k, x in zip(out, (lang, source, part, item, value)):
            out[k].append(x)

    if not len(names):
        forest = None
    else:
        forest = Forest(counts)
        # shares of every distinct count, by tree
        totals = [r["n"] for r in head] + [head[0]["lang_n"]]
        share = [shares(forest.counts, t, head[0]["v"]) for t in totals]
    block = [r["member"] // per_block for r in head]
    for a in range(len(head)):
        for b in range(a + 1, len(head)):
            if (block[a], block[b]) == (lo, hi):
                value = 0
                if forest:
                    x, y, places = forest.leaf_pairs(a, b)
                    value = int((prices(share[a][x], share[b][y]) * places).sum())
                add(head[a]["source"], "pair", head[b]["source"], value)
                add(head[b]["source"], "pair", head[a]["source"], value)
        if lo == hi and forest:
            x, y, places = forest.leaf_pairs(a, len(head))
            above = (forest.counts[x] > 0) & (share[a][x] > share[-1][y])
            if above.any():
                x, y, places = x[above], y[above], places[above]
                cost = prices(share[a][x], share[-1][y])
                falling = np.argsort(-cost, kind="stable")
                enough = falling[: np.searchsorted(np.cumsum(places[falling]), top_terms) + 1]
                wanted = cost >= cost[enough[-1]]
                price_of = dict(zip(zip(x[wanted].tolist(), y[wanted].tolist()), cost[wanted].tolist()))
                width = len(forest.counts)
                at = np.flatnonzero(np.isin(forest.leaves[a, : len(names)] * width + forest.leaves[-1, : len(names)], x[wanted] * width + y[wanted]))
                best = [(-price_of[forest.leaves[a, i], forest.leaves[-1, i]], names[int(order[i])].as_py()) for i in at.tolist()]
                for value, item in sorted(best, key=lambda r: (r[0], r[1].encode()))[:top_terms]:
                    add(head[a]["source"], "term", item, -value)
    return out
