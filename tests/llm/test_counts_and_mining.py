"""Token counts, the source divergence audit and hard-negative mining against brute force and odd input."""

import math
import random
import re
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from ledgerline.llm import hard_negatives, queries, source_audit, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [None, "", " ", "\n", "a", "x" * 60, "<|endoftext|> it's  a\n\n 'll \u3000 \U0001d518 12\u0969 <|endoftext|>", "word " * 3000, "tab\tand\x0bvt " * 30, "y" * 30_000, "no\x00nul\u0301 "]


def library_counts(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_equal_the_library():
    counter = token_count.Counter(open(PATH, encoding="utf-8").read())
    rng = random.Random(3)
    signs = [*"abcdeaaa  \n\t'sltv0123\u00e9\u00df\U0001d518\u4e2d\u3000\x85.,-<|>", "<|endoftext|>", "'ll", "the ", "aaaa", "  "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 5001, "ab" * 3000, "<|endoftext|>" * 3]
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        assert counter.count(part) == library_counts(part)
    small = token_count.Counter(open(PATH, encoding="utf-8").read())
    small.words.size = small.pieces.size = 7  # words that are forgotten are counted again
    assert small.count(texts) == library_counts(texts)


def test_token_counts_of_odd_rows(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(5, ODD[5], "x", 5), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, row long")
    out = token_count.token_counts(docs, PATH, limit=100)
    assert out.columns == [*docs.columns, "n_bytes", "over_limit"]
    want = sorted((str(i), len((t or "").encode()), n, n > 100) for (i, t, _, _), n in zip(rows, library_counts([r[1] for r in rows])))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    assert token_count.token_counts(docs.limit(0), PATH).count() == 0


def test_op13_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op13_token_count(spark, folder).collect()}
    assert got == {i: (len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, library_counts([t for _, t in rows]))}


def audit_loops(rows, min_docs, top):
    """The audit's contract by plain loops: {(lang, source, part, item): (value, rank)}."""
    words = lambda t: [w.encode().lower().decode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(lang or "", source or "", words(text)) for lang, source, text in rows]
    out = {}
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= min_docs) for s in {d[1] for d in own}}
        total = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in counts:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item): (-v, i + 1) for i, (v, _, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("segment, block", [(8192, 32), (3, 2)])
def test_source_audit_against_loops(spark, segment, block):
    rng = random.Random(5)
    vocabulary = ["a", "B", "b", "\u00e9t\u00e9", "\u00c9t\u00e9", "\U0001d518x", "z", "\ufffd", *(f"w{chr(97 + i)}" for i in range(12))]
    rows = [(lang, f"s{s}", " ".join(rng.choices(vocabulary, weights=range(1, 21), k=rng.randint(0, 25))) + "1 b-b") for lang, s in product(("x", "y"), range(5)) for _ in range(4)]
    rows += [(None, None, None), ("x", None, "lone"), ("x", "s0", None), ("z", "one", "alone"), ("z", "two", "1 2 3"), ("x", "s1", "b" * 100_000)] + [("x", "s2", "wa wb B b")] * 7
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, member int")
    out = source_audit.audited(docs, min_docs=4, top_terms=3, segment=segment, block=block)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [((r.lang, r.source, r.part, r["item"]), (r.value, r.rank)) for r in out.collect()]
    assert len(got) == len(dict(got)) and dict(got) == audit_loops(rows, 4, 3)


def test_source_audit_empty_and_shared_nodes(spark):
    assert source_audit.audited(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    forest = source_audit.Forest(np.array([[3, 0] * 512, [5, 0] * 512]))
    assert [len(made) for _, made, _ in forest.levels] == [2] * 10  # identical subtrees are one node
    x, y, places = forest.leaf_pairs(0, 1)
    assert sorted(zip(forest.counts[x].tolist(), forest.counts[y].tolist(), places.tolist())) == [(0, 0, 512), (3, 5, 512)]
    big = np.array([0, 1, 10**13])
    assert source_audit.shares(big, 10**13, 3).tolist() == [1 + 10**9 * (c + 2) // (10**13 + 6) for c in big.tolist()]


def mining_loops(rows, anchor, positives, negatives, low, high):
    """The mining's contract by plain loops, over (id, label, components)."""
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and abs(x) <= 2**18 for x in v)]
    out = []
    for a, own, u in filter(lambda r: anchor(r[0]), good):
        scored = [(-sum(x * y for x, y in zip(u, v)), i, label) for i, label, v in good]
        for ps, p, _ in sorted(s for s in scored if s[2] == own and s[1] != a)[:positives]:
            fit = sorted(s for s in scored if s[2] != own and low * -ps <= 100 * -s[0] <= high * -ps)[:negatives]
            out += [(a, p, rank, n, -ps, -s) for rank, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def test_hard_negatives_against_loops(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(0, 2), [rng.choice([-1.5, -0.3, 0.0, 0.004, 0.25, 1.0]) for _ in range(3)]) for i in range(-20, 160)]
    rows += [(i, 1, [1.0, 0.25, 0.25]) for i in range(200, 240)] + [rows[5], rows[30], (300, 0, [1.0]), (310, 1, []), (320, 2, [2.0, 1.0, 1.0, 5.0])]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (400, None, [1.0, 1.0, 1.0]), (410, 1, None), (420, 1, [None, 1.0, 1.0]), (430, 1, [math.nan, 0.0, 0.0]), (440, 1, [math.inf, 0.0, 0.0]), (450, 1, [1e30, 0.0, 0.0]), (460, 9, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, label int, embedding array<double>, uid int, grove string")
    want = mining_loops(rows, lambda i: i % 10 == 0, 3, 4, 30, 90)
    assert len(want) > 100
    for grove, chunk in ((4 << 20, 2048), (400, 3)):
        out = hard_negatives.mined(frame, F.expr("id % 10 = 0"), positives=3, negatives=4, grove_bytes=grove, chunk=chunk)
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, out.collect())) == want
    assert hard_negatives.mined(frame.limit(0), F.expr("id % 10 = 0")).count() == 0
    assert hard_negatives.mined(frame.where("vec_id = 0"), F.expr("id % 10 = 0")).count() == 0


@pytest.mark.parametrize("scale", [1, 2**24])
def test_tree_search_prunes_and_is_exact(monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "LEAF", 4)
    monkeypatch.setattr(hard_negatives, "FAN", 3)
    rng = np.random.default_rng(4)
    vectors = rng.integers(-3, 4, (500, 8)) * scale
    vectors[100:300] = vectors[100]  # a large group of copies
    ids = rng.permutation(500)
    kind = hard_negatives.number_type(vectors, vectors)
    assert kind is (np.float64 if scale == 1 else np.int64)
    order = hard_negatives.packed_order(vectors, np.arange(8))
    assert sorted(order.tolist()) == list(range(500))
    tree = hard_negatives.Tree(ids[order], vectors[order].astype(kind))
    anchors = vectors[rng.integers(0, 500, 40)].astype(kind)
    bounds = [tree.bounds(anchors)]
    looked = []
    take = hard_negatives.Windows.take
    monkeypatch.setattr(hard_negatives.Windows, "take", lambda self, rows: (looked.append(len(rows)), take(self, rows))[1])
    for at in range(40):
        scores = sorted(zip((-(vectors @ anchors[at].astype(np.int64))).tolist(), ids.tolist()))
        cuts = [(-(1 << 62), 1 << 62), (0, -scores[40][0]), (-scores[300][0], -scores[200][0]), (1, 0)]
        windows = hard_negatives.Windows(*map(list, zip(*cuts)), k=7)
        hard_negatives.search([tree], bounds, at, anchors[at], None, windows)
        assert windows.best == [[s for s in scores if low <= -s[0] <= high][:7] for low, high in cuts]
    assert sum(looked) < 40 * 500
    one = hard_negatives.Windows([-(1 << 62)], [1 << 62], 1)
    looked.clear()
    hard_negatives.search([tree], bounds, 0, anchors[0], None, one)
    assert sum(looked) < 250  # boxes below the best score aren't opened
