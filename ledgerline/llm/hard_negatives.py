"""Hard-negative mining on an R-tree packed by sort-tile-recursive.

The rows are cut by range (label, then the coordinates of the largest variance) into groves of a bounded size, and
every grove is packed into one tree for each of its labels: sorted and cut by one coordinate after the other down to
leaves, FAN boxes to a box above. A minimum bounding box gives an interval for each coordinate, and so bounds of the inner
product with an anchor. A search opens boxes from a queue, highest bound first. It leaves out a box whose
bounds lie outside all its score windows, and ends when the highest bound is strictly below the k-th
score of every window; equal scores are still looked at, as the smaller id wins.

Two searches are made. The first looks in trees of an anchor's own label for its positives. Their scores give the windows
in which the second looks for negatives in all other trees. Chunks of anchors meet groves in a cogroup, so a task holds one
chunk and one grove; each search's best of every grove are then merged by a window of a few rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Bytes of a grove's vectors, anchors of a chunk, rows of a leaf, boxes below a box.
GROVE, CHUNK, LEAF, FAN = 4 << 20, 2_048, 128, 16
#: Components beyond this could make scores that no long holds.
LARGEST = 1 << 26
ROWS = "id long, label long, vector array<int>"
TREE = "grove int, label long, ids binary, vectors binary"
FOUND = "uid long, slot int, score long, id long"
FAR = 1 << 62


class Tree:
    """One R-tree: rows in packed order, and the boxes of every level, leaves first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        starts = np.arange(0, len(ids), LEAF)
        self.levels = [(np.minimum.reduceat(vectors, starts), np.maximum.reduceat(vectors, starts))]
        while len(self.levels[-1][0]) > 1:
            starts = np.arange(0, len(self.levels[-1][0]), FAN)
            self.levels.append((np.minimum.reduceat(self.levels[-1][0], starts), np.maximum.reduceat(self.levels[-1][1], starts)))

    def bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each level: the least and largest inner product that a vector in the box can have, by (anchor, box)."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return [(up @ low.T + down @ high.T, up @ high.T + down @ low.T) for low, high in self.levels]


def packed_order(vectors: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Sort-tile-recursive: the rows' order in which every LEAF of them make a leaf. `dims`: coordinates, the widest first."""

    def tile(rows: np.ndarray, dims: list[int]) -> Iterator[np.ndarray]:
        leaves = -(-len(rows) // LEAF)
        if leaves <= 1 or not dims:
            yield rows
            return
        rows = rows[np.argsort(vectors[rows, dims[0]], kind="stable")]
        slabs = 2 if len(dims) > 1 else leaves
        size = -(-leaves // slabs) * LEAF
        for i in range(0, len(rows), size):
            yield from tile(rows[i : i + size], dims[1:])

    return np.concatenate(list(tile(np.arange(len(vectors)), dims.tolist())))


class Windows:
    """The k best (score high, then id low) of each score window [low, high] of one anchor."""

    def __init__(self, low: list[int], high: list[int], k: int):
        self.low, self.high, self.k = low, high, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in low]
        self.floors = list(low)
        self.floor = min(low)
        self.top = max(high)

    def open(self, least: float, most: float) -> bool:
        """Whether a box with these bounds can hold a row that is wanted."""
        return any(most >= f and least <= h for f, h in zip(self.floors, self.high))

    def take(self, rows: list[tuple[int, int]]) -> None:
        """rows: (-score, id), sorted."""
        for j, best in enumerate(self.best):
            i = bisect_left(rows, (-self.high[j], -(1 << 63)))
            new = [r for r in rows[i : i + self.k] if -r[0] >= self.floors[j]]
            if new:
                best += new
                best.sort()
                del best[self.k :]
                if len(best) == self.k:
                    self.floors[j] = max(self.low[j], -best[-1][0])
        self.floor = min(self.floors)


def search(trees: list[Tree], bounds: list[list[tuple[np.ndarray, np.ndarray]]], at: int, anchor: np.ndarray, own: int | None, windows: Windows) -> None:
    """Best-first search of some trees for one anchor, `at` its place in the bounds; rows with the id `own` are left out."""
    heap = [(-float(b[-1][1][at, 0]), t, len(b) - 1, 0) for t, b in enumerate(bounds)]
    heapify(heap)
    while heap:
        most, t, level, box = heappop(heap)
        if -most < windows.floor:
            return
        least, largest = bounds[t][level][0][at], bounds[t][level][1][at]
        if not windows.open(least[box], largest[box]):
            continue
        if level:
            least, largest = bounds[t][level - 1][0][at], bounds[t][level - 1][1][at]
            for child in range(box * FAN, min((box + 1) * FAN, len(largest))):
                if windows.open(least[child], largest[child]):
                    heappush(heap, (-float(largest[child]), t, level - 1, child))
            continue
        rows = slice(box * LEAF, (box + 1) * LEAF)
        score = trees[t].vectors[rows] @ anchor
        good = np.flatnonzero((score >= windows.floor) & (score <= windows.top))
        if len(good):
            ids = trees[t].ids[rows][good]
            hits = [(-s, i) for s, i in zip(score[good].astype(np.int64).tolist(), ids.tolist()) if i != own]
            hits.sort()
            windows.take(hits)


def matrix(lists: pa.ListArray | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of integers as rows of a matrix; short ones end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(len(lists), dims).astype(np.int64)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def number_type(a: np.ndarray, b: np.ndarray) -> type:
    """The type in which all inner products of rows of a with rows of b are exact: doubles below 2^53."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float64 if largest < 1 << 53 else np.int64


def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector): every component as floor(256 * x), of rows that take part."""
    for batch in batches:
        vectors = batch.column(2)
        flat = vectors.flatten()
        x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            q = np.floor(256 * x)
        bad = np.concatenate([[0], np.cumsum(~(np.abs(q) <= LARGEST))])
        size = np.array([-1 if v is None else v for v in pc.list_value_length(vectors).to_pylist()], np.int64)
        end = np.cumsum(np.maximum(size, 0))
        good = np.flatnonzero((size >= 0) & (bad[end] == bad[end - np.maximum(size, 0)]))
        cells = np.where(np.abs(q) <= LARGEST, q, 0).astype(np.int32)
        whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(cells))
        yield pa.RecordBatch.from_arrays([c.take(pa.array(good)) for c in (batch.column(0), batch.column(1), whole)], names=["id", "label", "vector"])


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, n, total, squares) of every coordinate over what a task has read; place -1 has the number of rows."""
    n, total, squares = np.zeros(1), np.zeros(0), np.zeros(0)
    for batch in batches:
        sizes = np.diff(batch.column(0).offsets.to_numpy())
        m = matrix(batch.column(0), int(sizes.max(initial=len(total))))
        grow = m.shape[1] - len(total)
        if grow > 0:
            total, squares = np.pad(total, (0, grow)), np.pad(squares, (0, grow))
        n[0] += len(m)
        total[: m.shape[1]] += m.sum(axis=0)
        squares[: m.shape[1]] += (m.astype(float) ** 2).sum(axis=0)
    places = np.arange(-1, len(total))
    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(np.full(len(places), int(n[0])), pa.int64()), pa.array(np.append(0.0, total)), pa.array(np.append(0.0, squares))], names=["place", "n", "total", "squares"])


def planting(order: list[int]):
    """The task that packs its partition, a grove, into a tree for each label; `order`: the coordinates, the widest first."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        label, ids = table["label"].to_numpy(), table["id"].to_numpy()
        vectors = matrix(table["vector"], len(order))
        for value in np.unique(label).tolist():
            rows = np.flatnonzero(label == value)
            rows = rows[packed_order(vectors[rows], np.array(order, np.int64))]
            cells = (TaskContext.get().partitionId(), value, ids[rows].astype("<i8").tobytes(), vectors[rows].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["grove", "label", "ids", "vectors"])

    return plant


class Index:
    """The trees of all rows: `trees` (grove, label, ids, vectors), `rows` (uid, id, label, vector) as written."""

    def __init__(self, rows: DataFrame, grove_bytes: int = GROVE):
        """rows: id long, label long, vector array<int>, none null."""
        self.rows = staged(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
        # a row for each coordinate
        found = self.rows.select("vector").mapInArrow(moments, "place int, n long, total double, squares double").groupBy("place").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares"))).collect()
        n = next((r.n for r in found if r.place < 0), 0)
        spread = {r.place: r.squares - r.total**2 / n for r in found if r.place >= 0}
        order = sorted(spread, key=lambda i: (-spread[i], i))
        self.groves = max(1, -(-n * 4 * max(1, len(order)) // grove_bytes))
        widest = [F.get("vector", F.lit(i)) for i in order[:2]]
        # label and coordinates may be the same in any number of rows, the last key is not
        self.trees = staged(self.rows.repartitionByRange(self.groves, "label", *widest, "uid").select("id", "label", "vector").mapInArrow(planting(order), TREE), "trees")
        self.meets = self.trees.select("grove", "label")

    def best(self, queries: DataFrame, k: int, same_label: bool, chunk: int = CHUNK) -> DataFrame:
        """(uid, slot, score, id, rank): the k best rows, by score falling and id, of each score window of each query.

        queries: uid, label, vector, low and high (arrays of long: the windows, slot by slot, ends included), own
        (null, or the id that no answer may have). Looks at the rows of the query's own label, or at all others.
        """
        chunks = max(1, -(-queries.count() // chunk))
        asked = queries.withColumns({"chunk": F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int"), "grove": F.explode(F.sequence(F.lit(0), F.lit(self.groves - 1)))})
        if same_label:
            asked = asked.join(self.meets, ["grove", "label"], "left_semi")
        else:
            other = self.meets.groupBy("grove").agg(F.min("label").alias("least"), F.max("label").alias("largest"))
            asked = asked.join(other, "grove").where((F.col("least") != F.col("label")) | (F.col("largest") != F.col("label")))
        asked = asked.select("grove", "chunk", "uid", "label", "vector", "low", "high", "own")
        trees = self.trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

        def meet(asked: pa.Table, trees: pa.Table) -> pa.Table:
            return pa.table(answers(asked, trees, k, same_label), schema=pa.schema([("uid", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())]))

        found = asked.groupBy("grove", "chunk").cogroup(trees.groupBy("grove", "chunk")).applyInArrow(meet, FOUND)
        rank = F.row_number().over(Window.partitionBy("uid", "slot").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def answers(asked: pa.Table, trees: pa.Table, k: int, same_label: bool) -> dict[str, list]:
    """Searches a grove's trees for the queries of a chunk."""
    out: dict[str, list] = {"uid": [], "slot": [], "score": [], "id": []}
    if not len(asked) or not len(trees):
        return out
    ids = [np.frombuffer(b, "<i8") for b in trees["ids"].to_pylist()]
    blobs = [np.frombuffer(b, "<i4").reshape(len(i), -1).astype(np.int64) for i, b in zip(ids, trees["vectors"].to_pylist())]
    dims = blobs[0].shape[1]
    anchors = matrix(asked["vector"], dims)
    kind = number_type(np.concatenate([anchors, *(np.abs(b).max(axis=0, keepdims=True) for b in blobs)]), np.concatenate([np.abs(b).max(axis=0, keepdims=True) for b in blobs]))
    anchors = anchors.astype(kind)
    forest = [(label, Tree(i, b.astype(kind))) for label, i, b in zip(trees["label"].to_pylist(), ids, blobs)]
    label = asked["label"].to_numpy()
    uid, low, high, own = (asked[c].to_pylist() for c in ("uid", "low", "high", "own"))
    for value in np.unique(label).tolist():
        chosen = [t for v, t in forest if (v == value) == same_label]
        rows = np.flatnonzero(label == value)
        bounds = [t.bounds(anchors[rows]) for t in chosen]
        for at, i in enumerate(rows.tolist()):
            windows = Windows(low[i], high[i], k)
            search(chosen, bounds, at, anchors[i], own[i], windows)
            for slot, best in enumerate(windows.best):
                for score, found in best:
                    out["uid"].append(uid[i])
                    out["slot"].append(slot)
                    out["score"].append(-score)
                    out["id"].append(found)
    return out


def mined(vectors: DataFrame, anchor: Column, relabel: Column | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, grove_bytes: int = GROVE, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    Components become floor(256 * x), a score is the integer inner product. An anchor is a row for which `anchor` (over
    the columns id and label) holds. Its positives are the best `positives` other rows of its label, its negatives for each the
    best `negatives` rows of other labels with low * positive_score <= 100 * score <= high * positive_score; ties go to the smaller id.
    `relabel` (over id and label) changes labels first. Rows with a null id, label or vector, or with a component
    that is null, not finite or beyond 2^18 (scores might not fit a long) take no part. Shorter vectors count as ending in
    zeros. Repeated rows are rows of their own; a row with the anchor's id is not one of its positives. A positive
    without negatives has no rows, and so has no anchor without positives; no rows give no rows.
    """
    cols = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("vector")).where("id IS NOT NULL AND label IS NOT NULL")
    if relabel is not None:
        cols = cols.withColumn("label", relabel.cast("long")).where("label IS NOT NULL")
    index = Index(cols.mapInArrow(quantised, ROWS), grove_bytes)
    anchors = index.rows.where(anchor)
    any_score = {"low": F.array(F.lit(-FAR)), "high": F.array(F.lit(FAR)), "own": F.col("id")}
    best = staged(index.best(anchors.withColumns(any_score), positives, True, chunk).select("uid", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # of a negative score no part can be wanted: low * score lies above high * score
    least, most = F.expr(f"({low} * positive_score + 99) div 100"), F.expr(f"{high} * positive_score div 100")
    windows = best.where(f"positive_score > 0 OR positive_score = 0 AND {low} >= 0").withColumn("w", F.struct("slot", least.alias("low"), most.alias("high"))).groupBy("uid").agg(F.array_sort(F.collect_list("w")).alias("w"))
    queries = anchors.join(windows, "uid").select("uid", "label", "vector", F.col("w.low").alias("low"), F.col("w.high").alias("high"), F.lit(None).cast("long").alias("own"))
    found = index.best(staged(queries, "windows"), negatives, False, chunk)
    named = anchors.select("uid", F.col("id").alias("anchor_id")).join(best, "uid")
    return found.join(named, ["uid", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
