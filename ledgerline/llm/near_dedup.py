"""Near-duplicate documents: MinHash candidates, checked on signatures and full shingle sets, joined into components.

Documents with equal shingle sets are folded first, so a group of exact copies is one node of the rest.
Bands of universal-hash minima tell which sets have a candidate at all. Of these sets, shingles are ordered from
rare to frequent; two linked sets must share one of their rarest (the prefix), early enough in both orders for the
rest to reach the threshold. So a bucket of candidates is split by the rare shingles that its members share. First
every set is tested with the head of each of its shingles and what is linked is contracted; then the pairs that
lie in different components and share such a shingle are tested, all of them. A group of thousands of near copies thus costs a
few tests a member, a group that is merely similar has no pairs to test, and no candidate pair that could join two
components goes untested.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, slices, staged, unboxed
from .components import components

#: Multiplier of shingles, and of the word places in one.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Signature rows a document has; a band takes `rows` of them.
SIGNATURE = 120
#: Similarity that the signatures of a pair must show: so many standard deviations below the threshold.
SLACK = 6.0
#: Ids that may be broadcast (16 MB); more are joined by shuffle.
BROADCAST_IDS = 1 << 20


def band_rows(similarity: float, miss: float = 1e-5) -> int:
    """The longest band with which a pair at the threshold is missed with a chance of `miss` at most."""
    fits = [r for r in range(1, 21) if (1 - similarity**r) ** (SIGNATURE // r) <= miss]
    return max(fits, default=1)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Of each text: the sorted distinct 64-bit hashes of its shingles; of fewer words, one of the whole sequence."""
    known: dict[bytes, int] = {}
    flat, ends = [], []
    for text in texts:
        tokens = text.encode().lower().split()
        for w in set(tokens):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        flat += map(known.__getitem__, tokens)
        ends.append(len(flat))
    h = np.array(flat, np.uint64)
    mixed = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for i in range(words):
        mixed = (mixed ^ h[i : i + len(mixed)]) * MIX
        mixed ^= mixed >> np.uint64(29)
    out, start = [], 0
    for end in ends:
        n = end - start
        if n >= words:
            out.append(np.unique(mixed[start : end - words + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[start:end].tobytes(), seed=n)] if n else [], np.uint64))
        start = end
    return out


_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SIGNATURE, np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    """Minima of SIGNATURE universal hashes a * x + b, as their upper 32 bits."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 512):
        np.minimum(least, (_A[:, None] * items[None, i : i + 512] + _B[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _linked(similarity: float):
    percent = round(100 * similarity)

    @F.arrow_udf("boolean")
    def linked(sig_a: pa.Array, set_a: pa.Array, sig_b: pa.Array, set_b: pa.Array) -> pa.Array:
        floor = similarity - SLACK * math.sqrt(similarity * (1 - similarity) / SIGNATURE)
        out = []
        for sa, a, sb, b in zip(sig_a, set_a, sig_b, set_b):
            same = np.count_nonzero(np.frombuffer(sa.as_buffer(), "<u4") == np.frombuffer(sb.as_buffer(), "<u4"))
            if same < floor * SIGNATURE:
                out.append(False)
                continue
            a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    return linked


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, id, n_shingles, component_id) for boxed documents (row, id, text); see near_dedup()."""
    rows = band_rows(similarity)
    bands = SIGNATURE // rows

    @F.arrow_udf("struct<n: int, fp: binary, bands: array<long>>")
    def profile(texts: pa.Array) -> pa.Array:
        n, fp, out = [], [], []
        for part in slices(texts):
            for items in shingle_sets(part, words):
                n.append(len(items))
                fp.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                sig = signature(items)[: bands * rows].reshape(bands, rows)
                out.append([xxhash.xxh3_64_intdigest(s.tobytes(), seed=i) - (1 << 63) for i, s in enumerate(sig)] if len(items) else [])
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(fp, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["n", "fp", "bands"])

    @F.arrow_udf("struct<sig: binary, items: binary>")
    def full(texts: pa.Array) -> pa.Array:
        sets = [items for part in slices(texts) for items in shingle_sets(part, words)]
        return pa.StructArray.from_arrays([pa.array([signature(x).tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["sig", "items"])

    @F.arrow_udf("array<long>")
    def items(sets: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x.as_buffer(), "<i8") for x in sets], pa.list_(pa.int64()))

    profiles = staged(docs.select("id", profile("text").alias("p")).select("id", "p.*"), "profiles")
    nodes = staged(profiles.where("id IS NOT NULL AND n > 0").groupBy("fp").agg(F.min(F.struct("id", "bands")).alias("x")).select("fp", F.col("x.id").alias("rep"), "x.bands"), "nodes")

    # sets that share a band with another one
    posts = nodes.select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))
    buckets = posts.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    ids = staged(posts.join(buckets, "bucket", "left_semi").select("id").distinct(), "members")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = docs.join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    sets = staged(sets.select("id", full("text").alias("f")).select("id", "f.*"), "sets")
    linked = _linked(similarity)

    # a set's shingles from rare to frequent; those of one set only come first and are counted, not kept
    flat = sets.select("id", (F.octet_length("items") / 8).cast("int").alias("n"), F.explode(items("items")).alias("shingle"))
    often = flat.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    order = flat.join(often, "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("common"))
    percent = round(100 * similarity)
    own, length = F.col("n") - F.size("common"), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = order.withColumns({"own": own, "take": (length - own).cast("int")}).where("take > 0").select("id", "n", "own", F.posexplode(F.slice("common", 1, F.col("take"))).alias("k", "c"))
    prefix = staged(prefix.select("id", "n", (F.col("own") + F.col("k")).alias("pos"), F.col("c.shingle").alias("shingle")), "prefix")
    # two sets whose first shared shingle comes at pos and pos_a have at most what follows in common
    near = f"{100 + percent} * least(n - pos, n_a - pos_a) >= {percent} * (n + n_a)"

    def tested(pairs: DataFrame) -> DataFrame:
        """The links (u, v) among pairs (a, b), by signatures and then by full sets."""
        a, b = (sets.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("items").alias(f"set_{x}")) for x in ("a", "b"))
        pairs = pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        return staged(pairs.join(b, "b").join(a, "a").where(linked("sig_a", "set_a", "sig_b", "set_b")).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")

    # heads are the sets in which a shingle comes first: copies of one text differ least from those
    head = prefix.groupBy("shingle").agg(F.min(F.struct(F.col("pos").alias("pos_a"), F.col("id").alias("a"), F.col("n").alias("n_a"))).alias("h")).select("shingle", "h.*")
    links = tested(prefix.join(head, "shingle").where(f"id <> a AND {near}"))
    labels = components(links)

    at = staged(prefix.join(labels.withColumnRenamed("u", "id"), "id", "left").withColumn("comp", F.coalesce("v", "id")).drop("v"), "labelled")
    several = at.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    mixed = at.join(several, "shingle", "left_semi")
    other = mixed.select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("n", "pos", "comp")), F.col("id").alias("a"))
    more = tested(mixed.join(other, "shingle").where(f"id < a AND comp <> comp_a AND {near}"))
    if not more.isEmpty():
        labels = components(labels.unionByName(more))

    comp = nodes.join(labels.withColumnRenamed("u", "rep"), "rep", "left").select("fp", F.coalesce("v", "rep").alias("component_id"))
    known = profiles.where("id IS NOT NULL").join(comp, "fp", "left").select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    none = profiles.where("id IS NULL").select("id", F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(none)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row (id, n_shingles, component_id, kept) for each row of docs.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a document is the set of its
    distinct shingles of `words` words, or its whole sequence where that is shorter. Two documents are linked if
    their sets' Jaccard similarity is at least `similarity` (a multiple of 0.01); component_id is the least id
    that links reach. Documents without words are linked with nothing. Rows with the same id are one node;
    rows without an id have no component and are kept. Only id_col and text_col are read.
    """
    box = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = near_groups(box, words, similarity)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows whose document is not its component's least; rows that share an id stay together."""
    gone = staged(near_dedup(docs, id_col, text_col, words, similarity).where("NOT kept").select(F.col(id_col).alias("gone")).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    box = boxed(docs, id=id_col)
    return unboxed(box.join(gone, box.id == F.col("gone"), "left_anti"), docs.columns)
