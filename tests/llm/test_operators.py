"""The training-data operators against brute force, exact round trips and odd input."""

import hashlib
import itertools
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from ledgerline.llm import bpe, chat, components, flac, line_dedup, lm_score, near_dedup, packing, quality, secrets, url_trust

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [None, "", " ", "\n", "a", "x" * 60, "é" * 39 + "\n" + "é" * 40, "<|endoftext|> it's  a\n\n 'll \u3000 𝔘 12३ <|endoftext|>", "word " * 3000, "tab\tand\x0bvt " * 30]
BASE = "the quick brown fox jumps over a lazy dog while seven wizards mix a potion of rare herbs under the pale moon and sing loud songs about old kings "


def make(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with nulls, ties, repeated rows and columns whose names clash with the operators' own."""
    rows = [(i, t, "x", i, "r") for i, t in enumerate(ODD)]
    return make(spark, [*rows, rows[5], rows[8], (None, "no id", None, None, None)], "doc_id long, text string, n_lines string, id long, row string")


EMPTY = "doc_id long, text string"


def test_line_dedup_brute_force(spark, odd):
    lines = [f"{c} this line is long enough to be a key of its own {c}" for c in "abcdef"] + ["short", "é" * 40, ""]
    rng = np.random.default_rng(1)
    rows = [(i, "\n".join(rng.choice(lines, 5))) for i in range(40)] + [(i, ODD[i - 40]) for i in range(40, 40 + len(ODD))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(make(spark, rows), filter_bits=1 << 16).collect()}
    keys = {i: [x.strip(" \t\n\x0b\x0c\r").encode().lower().decode() for x in (t or "").split("\n")] for i, t in rows}
    holders = {}
    for i, ks in keys.items():
        for k in set(ks):
            if len(k) >= 40:
                holders.setdefault(k, set()).add(i)
    for i, t in rows:
        split = (t or "").split("\n")
        kept = [x for x, k in zip(split, keys[i]) if len(holders.get(k, ())) < 5 or max(holders[k]) == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(split), len(split) - len(kept), "\n".join(kept))
    out = line_dedup.dedup_lines(odd, filter_bits=1 << 16)
    assert out.count() == odd.count() and out.columns == [*odd.columns, "n_dropped"]
    assert line_dedup.dedup_lines(make(spark, [], EMPTY)).count() == 0


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("words,similarity", [(3, 0.85), (5, 0.8)])
def test_near_dedup_brute_force(spark, words, similarity):
    rng = np.random.default_rng(2)
    base, rows = BASE.split() * 3, []
    for i in range(120):
        w = list(base)
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, len(w)))] = f"w{rng.integers(0, 1000)}"
        rows.append((i + 1, " ".join(w)))
    rows += [(500 + i, t) for i, t in enumerate(ODD)] + [(900, "x" * 60), (1, rows[0][1]), (None, rows[0][1])]
    out = near_dedup.near_dedup(make(spark, rows), words=words, similarity=similarity)
    got = {r.doc_id: r for r in out.collect()}
    sets = {i: shingles(t, words) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= round(100 * similarity) * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items() if i is not None} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert got[None].component_id is None and got[None].kept and out.count() == len(rows)
    assert near_dedup.near_dedup(make(spark, [], EMPTY)).count() == 0


@pytest.mark.parametrize("one_task", [0, 1 << 16])
def test_components(spark, one_task):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(chain, "u long, v long"), one_task).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100, 201: 200}


def test_secrets(spark, odd):
    key, hexa = "AKIA" + "Q7ZD2M4K8P3X9W5R", hashlib.sha1(b"x").hexdigest()
    rows = [(1, f'before {key} after\npassword="{hexa}" x', "src/a.py"), (2, "card 4785380592391139 and EXAMPLEKEY1234567890", "docs/b.md"), (3, None, None), (4, "", ""), (5, f"token: {hexa}{hexa[:3]} " * 2 + "z" * 50000, "src/c.py")]
    docs = make(spark, rows, "doc_id long, text string, source string")
    found = secrets.scan(docs).collect()
    texts = {i: t for i, t, _ in rows}
    for r in found:
        assert hashlib.sha256(texts[r.doc_id][r.start : r.start + r.length].encode()).hexdigest() == r.secret_sha256
    assert sorted((r.doc_id, r.secret) for r in found) == [(1, True), (1, True), (2, False), (2, False), (5, True), (5, True)]
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert clean[1] == 'before [SECRET] after\npassword="[SECRET]" x' and clean[2] == texts[2] and clean[3] is None and clean[4] == "" and hexa not in clean[5]
    assert secrets.redacted(odd, path_col=None).count() == odd.count()
    plan = secrets.redacted(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secrets_of_kinds_that_no_template_has(spark):
    """Precision and recall on keys and harmless strings whose shapes are not the templates'."""
    rng = np.random.default_rng(8)
    of = lambda chars, n: "".join(rng.choice(list(chars), n))
    letters, alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    kinds = {
        "base64 with padding": lambda: f"SECRET_KEY_BASE: {of(alnum + '+/', 42)}==",
        "short password": lambda: f"login with password: {of(letters, 5)}{rng.choice(list('!%&*?'))}{of('0123456789', 3)} please",
        "letters only": lambda: f"api-key={of(letters, 28)}",
        "upper case": lambda: f'ACCESS_KEY="{of("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 30)}"',
        "url": lambda: f"redis://admin:{of(alnum, 9)}@cache.internal:6379/0",
        "hexadecimal": lambda: f"export AUTH_TOKEN={of('0123456789abcdef', 48)}",
    }
    harmless = {
        "commit": lambda: f"fixed in commit {of('0123456789abcdef', 40)} today",
        "uuid": lambda: "-".join(of("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        "identifier": lambda: "see " + "".join(str(rng.choice(["Order", "Item", "Value", "Index", "Session", "Customer"])) for _ in range(4)) + " there",
        "word after a credential word": lambda: f"password: {rng.choice(['required', 'string', 'default', 'value', 'name'])}",
        "number": lambda: f"order {of('123456789', 18)} shipped",
        "slug": lambda: "http://x.com/" + "-".join(str(rng.choice(["order", "item", "value", "index", "session"])) for _ in range(5)) + "-2024",
    }
    rows, kind_of = [], {}
    for i, (k, f) in enumerate((k, f) for d in (kinds, harmless) for k, f in d.items() for _ in range(25)):
        kind_of[i] = k
        rows.append((i, f"{BASE}\n{f()}\n{BASE}", None))
    found = secrets.scan(make(spark, rows, "doc_id long, text string, source string")).where("secret").collect()
    caught = Counter(kind_of[i] for i in {r.doc_id for r in found})
    assert all(caught[k] >= 20 for k in kinds) and all(caught[k] <= 2 for k in harmless)


def test_secrets_of_any_length_go_to_the_last_character(spark):
    rng = np.random.default_rng(11)
    key = lambda n, signs="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789": "".join(rng.choice(list(signs), n))
    long, longer, password = key(10_000), key(100_000), key(300, "abcdefghkmnpqrstwxyzABCDEFGHKMNPRSTWXYZ2345679!$.&") + "!9z"
    texts = [f'token = "{long}" is set', f"api_key={longer}\nafter", f"see postgres://admin:{password}@db.host/x", f"see https://{'u' * 500}:{password}@db.host/x", f"many {' '.join(f'password={key(20)}' for _ in range(3000))} end"]
    texts += ["plain words " * 20] * 20
    clean = {r.doc_id: r.text for r in secrets.redacted(make(spark, list(enumerate(texts))), path_col=None).collect()}
    assert clean[0] == 'token = "[SECRET]" is set' and clean[1] == "api_key=[SECRET]\nafter"
    assert clean[2] == "see postgres://admin:[SECRET]@db.host/x" and clean[3] == f"see https://{'u' * 500}:[SECRET]@db.host/x"
    assert clean[4] == f"many {' '.join(['password=[SECRET]'] * 3000)} end" and clean[5] == texts[5]
    starts = sorted(r.start for r in secrets.scan(make(spark, [(4, texts[4])]), path_col=None).collect())
    assert starts == [14 + 30 * i for i in range(3000)]


def test_secrets_on_nothing(spark):
    for rows in ([], [(1, None, None), (1, "", ""), (1, "", ""), (None, "no candidate here", "x")]):
        docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, source string, word string, n long")
        assert secrets.scan(docs).count() == 0 and sorted(map(str, secrets.redacted(docs).collect())) == sorted(map(str, docs.collect()))


def test_bpe_equals_the_library(spark, odd):
    texts = [t or "" for t in ODD] + ["a" * 1000, "don't'S'll'", "''s", " 's", "\u00a0x", "l'été — 100€", "  \n x", "q\u0085w"]
    ids = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    model = bpe.Bpe(open(PATH, encoding="utf-8").read())
    for encode in (model.encode, model.encode_whole):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == ids
    assert [model.decode(np.array(i, "<u4").tobytes()) for i in ids] == texts
    assert model.decode(np.array(ids[6][1:2], "<u4").tobytes()) == LIBRARY.decode(ids[6][1:2])
    rows = bpe.encode_decode(odd, PATH).collect()
    assert all(r.decoded == (r.text or "") and r.n_tokens == len(r.ids) for r in rows) and bpe.encode_decode(make(spark, [], EMPTY), PATH).count() == 0


def test_packing(spark, odd):
    rows = packing.pack(odd.repartition(3), PATH, length=64).collect()
    pieces = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.offset + r.length <= 64
        pieces.setdefault(r.doc_id, []).append((r.start, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()))
    # the pieces of each document are the library's ids and the end, once for each of its rows
    for (i, t), n in Counter((r.doc_id, r.text) for r in odd.collect()).items():
        want = LIBRARY.encode(t or "", add_special_tokens=False).ids + [0]
        got = Counter(at + k for at, total, ids in pieces[i] if total == len(want) for k in range(len(ids)))
        assert got == Counter({k: n for k in range(len(want))})
        assert all(ids == want[at : at + len(ids)] for at, total, ids in pieces[i] if total == len(want))
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert sorted(filled) == list(range(len(filled))) and all(filled[s] == 64 for s in list(sorted(filled))[:-1])
    for s in filled:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    sizes = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packing.pack(make(spark, [(1, "a b c"), (2, "d")]), PATH, length=64), 64).collect()}
    assert sizes == {0: 64}
    assert packing.pack(make(spark, [], EMPTY), PATH).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a[TURN]b\\b\\e\\\\"), (1, 1, "user", None), (1, 2, "assistant", "\n</s>\r\n x "), (1, 3, "assistant", ""), (1, 4, "we[ird]<s>\n role\\", " [/ROLE] y"), (1, None, None, "z[/INST]"), (None, 1, "tool", ""), (2, 1, "assistant", "[ANSWER]$1 \\$"), (2, 2, "user", " [INST]  [/INST]")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in chat.read_back(chats, "conv_id").collect()}
    for i, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is None, r[0], -1 if r[1] is None else r[1])), lambda r: r[0]):
        group = list(group)
        assert [(t.role, t.text) for t in back[i].turns] == [(r[2] or "", r[3] or "") for r in group]
        assert back[i].loss_text == "".join(r[3] or "" for r in group if r[2] == "assistant")
    assert chats.where("conv_id = 1").first().formatted.count("[INST]") == 1  # neighbours of one role share a header
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_lm_score(spark, odd):
    syllables = {"x": "ka lo mi ne ru sa to vi".split(), "y": "ber den gol haf jik lum nor pas".split()}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("".join(rng.choice(syllables["xy"[i % 2]], int(rng.integers(1, 4)))) for _ in range(150)), "xy"[i % 2]) for i in range(300)]
    out = lm_score.scored(make(spark, rows, "doc_id long, text string, lang string"), profile_col="lang").collect()
    rows = [(i, t) for i, t, _ in rows]
    tokens = {i: t.split() + ["\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in out:
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[r.doc_id])
        assert r.held_out == held[r.doc_id] and r.n_tokens == len(tokens[r.doc_id]) and r.n_known == sum(c[w] > 0 for w in tokens[r.doc_id]) and r.train_tokens == n and abs(r.base_score - base) < 1e-6
    test = [r for r in out if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test) and np.mean([r.bits_per_byte for r in test]) < 2.5
    one = lm_score.scored(make(spark, rows)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert one[0] > 1.02 * one[1]  # one profile of words that are all alike frequent leaves little to learn
    got = lm_score.scored(odd)
    assert got.count() == odd.count() and got.where("score IS NULL OR score > 0").isEmpty()
    assert lm_score.scored(make(spark, [], EMPTY)).count() == 0


def test_lm_score_of_texts_with_many_unknown_words(spark):
    rng = np.random.default_rng(9)
    known = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(120)]
    fresh = lambda: "".join(rng.choice(list("aeiou"), 1)[0] + rng.choice(list("klmnprst"), 1)[0] for _ in range(5))
    rows = [(i, " ".join(fresh() if rng.random() < 0.3 else known[int(rng.integers(0, 120) ** 2 / 120)] for _ in range(60))) for i in range(250)]
    for hot in (1 << 16, 60):  # every word in the tree, and most words behind its escape
        out = lm_score.scored(make(spark, rows), hot_words=hot).where("held_out").collect()
        tokens, unknown = sum(r.n_tokens for r in out), sum(r.n_tokens - r.n_known for r in out)
        assert 0.25 < unknown / tokens < 0.35
        score, base, spelled = (sum(getattr(r, c) for r in out) for c in ("score", "base_score", "spelled_score"))
        # an unknown word is as likely as it is frequent, and its ten letters cost little more than they must (10 * log2(5 * 8) / 2 = 26.6 bits)
        assert score > base + 0.5 * tokens
        assert all(r.spelled_score < r.score < 0 for r in out)
        assert 26 < (score - spelled) / unknown * np.log2(10) < 36
    tree = lm_score.Tree([b"a", b"b"], [3, 1], 1, 2, np.ones((2, 1)))
    leaf, at = tree.with_escapes(np.array([0, 1, 1, 3]))
    assert leaf.tolist() == [0, 2, 1, 2, 1, 3] and at.tolist() == [0, 1, 1, 2, 2, 3]
    # profiles worked out in runs are those worked out at once
    tree = lm_score.Tree([b"a", b"b", b"c"], [3, 2, 2], 1, 2, rng.random((3, 4)))
    leaf, place = rng.integers(0, 5, 500), np.concatenate([np.arange(n) for n in (1, 120, 0, 300, 79)])
    assert (tree.best_profile(leaf, place) == tree.best_profile(leaf, place, 7)).all()


def small_model(rng, slots):
    counts = rng.integers(0, 70, slots).astype(np.uint64) | rng.integers(0, 90, slots).astype(np.uint64) << np.uint64(32)
    x, seen = lm_score.prepared(counts)
    maps = rng.integers(1, 50, (2, lm_score.GATES, lm_score.BUCKETS)).astype(float)
    return lm_score.Model(lm_score.packed(x, seen), rng.normal(0.3, 0.1, (lm_score.GATES, lm_score.CONTEXTS)), np.minimum(maps, maps[1])), maps


def small_tree(rng):
    words = [f"w{i}".encode() for i in range(40)]
    return lm_score.Tree(words, rng.integers(1, 100, 40).tolist(), 30, 7, rng.random((40, 3)))


def test_mixer_is_a_distribution():
    rng = np.random.default_rng(0)
    tree = small_tree(rng)
    model, _ = small_model(rng, sum(tree.sizes(12)))
    every = np.arange(tree.end + 1)
    for context in rng.integers(0, 1 << 63, (5, 3)).astype(np.uint64):
        token, slots, bit = tree.bits(every, np.repeat(context[:, None], len(every), axis=1), 12)
        assert abs((10 ** np.bincount(token, model.frozen(slots, bit))).sum() - 1) < 1e-5
    model, _ = small_model(rng, lm_score.SPELLED[0] + (3 << 12))
    word, slots, bit = lm_score.spelling([b"ab" + bytes([a]) for a in range(256) if a not in (9, 10, 11, 12, 13, 32)] + [b"ab"], 12)
    third = model.frozen(slots, bit)[np.arange(len(word)) - np.searchsorted(word, word) >= 16]
    of = word[np.arange(len(word)) - np.searchsorted(word, word) >= 16]
    chance = [10 ** third[of == w][:8].sum() for w in range(251)]
    assert 0.9 < sum(chance) <= 1 + 1e-5  # all bytes but the white ones, and the word's end


def test_score_equals_a_loop_over_bits():
    """Each bit on its own, weights of the text moved after every block, in plain Python."""
    rng = np.random.default_rng(6)
    tree, size = small_tree(rng), 12
    model, maps = small_model(rng, sum(tree.sizes(size)))
    texts = [[f"w{rng.integers(0, 44)}".encode() for _ in range(n)] for n in (0, 3, 63, 64, 65, 700, 200)]
    got = model.score(tree, [tree.tokens(t) for t in texts], size)
    for words, score in zip(texts, got):
        leaf, hashes = tree.tokens(words)
        contexts = tree.contexts(leaf, hashes, np.arange(len(leaf)))
        weights, slope, total = model.weights.T.astype(float), np.full(lm_score.GATES, lm_score.HOLD), 0.0
        for at in range(0, len(leaf), lm_score.BLOCK):
            step, more = np.zeros_like(weights), np.zeros(lm_score.GATES)
            for t in range(at, min(at + lm_score.BLOCK, len(leaf))):
                _, slots, bits = tree.bits(leaf[t : t + 1], contexts[:, t : t + 1], size)
                for k, bit in enumerate(bits.tolist()):
                    x, seen = [int(model.table[s[k]] >> 5) / 64 - 16 for s in slots], [int(model.table[s[k]] & 31) for s in slots]
                    g = min((seen[2] + 1) >> 2, 3) * 4 + min(seen[3], 3)
                    st = min(max(sum(w * v for w, v in zip(weights[g], x)), -16), 16)
                    p = 1 / (1 + np.exp(-st))
                    hits, tries = np.minimum(maps, maps[1])[:, g, round(st + 16)]
                    fine = (p + (hits + 20 * p) / (tries + 20)) / 2
                    total += np.log10(fine if bit else 1 - fine)
                    step[g] += (bit - p) * np.array(x)
                    more[g] += p * (1 - p) * sum(v * v for v in x)
            slope += more
            weights += step / slope[:, None]
        assert abs(total - score) < 1e-3 * max(1, abs(total))


def lpc_frame(samples, coefs, shift):
    """A frame with a linear predictor of explicit coefficients, written bit by bit."""
    bits = lambda v, n: [(v >> (n - 1 - i)) & 1 for i in range(n)]
    order, out = len(coefs), []
    out += bits((32 + order - 1) << 1, 8) + [b for s in samples[:order] for b in bits(s & 255, 8)] + bits(6, 4) + bits(shift, 5) + [b for c in coefs for b in bits(c & 127, 7)]
    residual = [samples[i] - (sum(c * samples[i - 1 - j] for j, c in enumerate(coefs)) >> shift) for i in range(order, len(samples))]
    out += bits(0, 2) + bits(1, 4)
    for part in (residual[: len(samples) // 2 - order], residual[len(samples) // 2 - order :]):
        out += bits(3, 4)
        for r in part:
            u = r << 1 ^ r >> 31
            out += [0] * (u >> 3) + [1] + bits(u & 7, 3)
    out += [0] * (-len(out) % 8)
    head = b"\xff\xf8\x70\x02\x00" + struct.pack(">H", len(samples) - 1)
    frame = head + bytes([flac._crc([head], 8, 7)[0]]) + np.packbits(np.array(out, np.uint8)).tobytes()
    return frame + struct.pack(">H", flac._crc([frame], 16, 0x8005)[0])


def test_flac(spark, odd):
    rng = np.random.default_rng(4)
    payloads = [flac.payload(t or "") for t in ODD] + [rng.integers(0, 256, 192 * 19).astype(np.uint8).tobytes()]
    streams = flac.encode(payloads)
    assert [(x + 128).astype(np.uint8).tobytes() for _, x in flac.decode(streams)] == payloads
    for at in (-1, -20, len(streams[8]) // 2, 30):
        broken = bytearray(streams[8])
        broken[at] ^= 16
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])
    samples = [int(60 * np.sin(i / 5)) + int(rng.integers(-3, 4)) for i in range(192)]
    assert flac.decode_frames([lpc_frame(samples, [28, -13], 4)])[0].tolist() == samples
    media = odd.select("doc_id", flac.stored(F.col("text")).alias("media"))
    blocks = flac.pcm_blocks(media, "doc_id", "media").where("doc_id = 8").orderBy("block").collect()
    once = blocks[::2] if len({b.block for b in blocks}) < len(blocks) else blocks
    assert b"".join(b.pcm for b in once) == flac.payload(ODD[8]) and [b.sample_offset for b in once] == [i * flac.BLOCK for i in range(len(once))]
    assert flac.pcm_blocks(media.limit(0), "doc_id", "media").count() == 0


def test_quality(spark, odd):
    good = [(i, " ".join(f"w{(i * 7919 + j * 104729) % 99991} the" if j % 3 else f"tale{j}" for j in range(80))) for i in range(60)]
    junk = [(100 + i, " ".join(f"ab{j}$$$ cd{i}###" for j in range(80))) for i in range(12)] + [(200 + i, "BUY NOW CHEAP PILLS " * 60) for i in range(12)]
    rows = {r.doc_id: r for r in quality.judged(make(spark, good + junk)).collect()}
    assert all(rows[i].kept for i, _ in good) and not any(rows[i].kept for i, _ in junk)
    # the expressions give what the estimate says of each row's votes
    voted = quality.judged(make(spark, good + junk)).select("p_good", *(v.alias(k) for k, v in quality.votes().items())).collect()
    seen = Counter(tuple(r[1:]) for r in voted)
    share, rate = quality.estimate(np.array(sorted(seen)), np.array([seen[p] for p in sorted(seen)], float))
    for r in voted:
        like = [s * np.exp(sum(of[i][v + 1] for i, v in enumerate(r[1:]))) for s, of in zip(share, rate)]
        assert abs(r.p_good - like[0] / sum(like)) < 1e-9
    for t in ODD:
        t = t or ""
        w = t.encode().split()
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        assert quality.text_counts(t)[:5] == (len(w), sum(len(x.decode()) for x in w), sum(t.count(s) for s in "#*$%&|<>"), dup, len(covered))
    assert quality.judged(odd).count() == odd.count() and quality.judged(make(spark, [], EMPTY)).count() == 0
    assert quality.keep_good(odd).columns == odd.columns


def test_quality_estimate():
    """The estimate against plain loops over patterns, classes and rules; junk as frequent as 30 % stays junk, errors of a rule on good documents stay good."""
    rng = np.random.default_rng(5)
    seen = Counter()
    for i in range(4000):
        kind = "good" if i % 10 < 7 else "symbols" if i % 10 < 9 else "phrase"
        wrong = {"good": (0.02, 0.01, 0.01, 0.01, 0.01), "symbols": (0.02, 0.95, 0.95, 0.01, 0.01), "phrase": (0.02, 0.01, 0.01, 0.97, 0.9)}[kind]
        seen[tuple(-1 if rng.random() < w else int(rng.random() < 0.8) for w in wrong)] += 1
    patterns, weight = np.array(list(seen)), np.array(list(seen.values()), float)
    share, rate = quality.estimate(patterns, weight)

    def posterior(share, rate):
        out = []
        for p in patterns:
            like = [s * np.prod([np.exp(r[v + 1]) if v else 1.0 for r, v in zip(of, p)]) for s, of in zip(share, rate)]
            out.append([x / sum(like) for x in like])
        return out

    member = [[1.0, 0, 0, 0, 0, 0] if (n := sum(v < 0 for v in p)) == 0 else [g := 1 / (1 + np.exp(3.0 * n - 3)), *((1 - g) * (v < 0) / n for v in p)] for p in patterns]
    for _ in range(1000):
        before, shares, rates = member, [], []
        for k in range(6):
            shares.append((sum(w * m[k] for w, m in zip(weight, member)) + 1) / (4000 + 6))
            of = []
            for r in range(5):
                bad, good = (1, 4) if k == 0 else (4, 1) if k == r + 1 else (1, 1)
                for p, w, m in zip(patterns, weight, member):
                    bad, good = bad + w * m[k] * (p[r] < 0), good + w * m[k] * (p[r] > 0)
                of.append([np.log(bad / (bad + good)), 0.0, np.log(good / (bad + good))])
            rates.append(of)
        member = posterior(shares, rates)
        if max(abs(a - b) for x, y in zip(member, before) for a, b in zip(x, y)) < 1e-7:
            break
    assert np.allclose(share, shares, atol=1e-6) and np.allclose(rate, rates, atol=1e-4)
    good = {tuple(p): m[0] for p, m in zip(patterns, posterior(share, rate))}
    assert abs(share[0] - 0.7) < 0.03
    assert good[1, 1, 1, 1, 1] > 0.99 and good[-1, 1, 1, 1, 1] > 0.9 and good[1, -1, -1, 1, 1] < 0.05 and good[1, 1, 1, -1, -1] < 0.05


def test_url_trust(spark):
    # the contract lists five rules
    assert sorted(f"{v} {h}{p}" for v, h, p in url_trust.RULES) == ["allow example.com/en/7", "allow net/de/", "block com/en/", "block example.net/de/8", "block org/es/"]
    link = '<a href="http://bad.org/x">x</a>'
    rows = [(1, "http://A.example.com/en/7?q", None), (2, "https://x.com/en/", None), (3, "http://bad.net/fr", None), (4, "http://farm.example.edu/", link), (5, "http://quiet.sample.edu/", ""), (6, None, None), (7, "no url", link), (8, "http://example.net/de/80", None), (9, "http://good.net/de/1", '<A HREF=http://friend.edu/>'), (10, "http://friend.edu", None), (11, "http://x.org#/es/", None), (12, "a://b://c/d", None), (13, "http://bad.org/es/1", None), (14, "http://bad.org/fr/1", None), (15, "http://sub.good.net/de/8", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_trust.judged(pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 3, 6, 7, 8, 9, 11, 12, 13, 15)] == [
        ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("x.com", "/en/", "com/en/", "block"), ("bad.net", "/fr", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("example.net", "/de/80", "example.net/de/8", "block"), ("good.net", "/de/1", "net/de/", "allow"), ("x.org", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("bad.org", "/es/1", "org/es/", "block"), ("sub.good.net", "/de/8", "net/de/", "allow"),
    ]
    assert got[4].verdict == "block" and got[14].verdict == "block" and got[5].verdict == "allow" and got[10].verdict == "allow" and got[10].trust > 0
    alone = {r.page_id: r for r in url_trust.judged(pages, parents=False).collect()}
    assert alone[4].verdict == "block" and alone[10].trust > 0 and alone[5].distrust == 0
    assert url_trust.judged(pages.limit(0)).count() == 0
    clash = url_trust.judged(pages.selectExpr("page_id", "url", "html", "'x' AS host", "1 AS trust", "2 AS many"))
    assert clash.count() == len(rows) and clash.where("host = 'x'").isEmpty() and clash.where("many <> 2").isEmpty()


@pytest.mark.parametrize("one_task, hub", [(0, 100_000), (1 << 16, 100_000), (0, 2), (1 << 16, 2)])
def test_propagation_equals_dense_algebra(spark, one_task, hub):
    """With and without hosts whose links are dealt over chunks: two graphs at once, with hosts that link nowhere, seeds that link nowhere, and a chain that is longer than any fixed number of rounds."""
    rng = np.random.default_rng(5)
    graphs = {"trust": [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 12, 30), rng.integers(0, 15, 30), rng.integers(1, 5, 30)) if a != b], "distrust": [(i, i + 1, 1.0) for i in range(20)]}
    seeds = {"trust": {0: 0.5, 3: 0.25, 14: 0.25}, "distrust": {0: 1.0}}
    edges = spark.createDataFrame([(k, f"h{a}", f"h{b}", w) for k, es in graphs.items() for a, b, w in es], "kind string, src string, dst string, w double")
    mass = spark.createDataFrame([(k, f"h{h}", m) for k, ms in seeds.items() for h, m in ms.items()], "kind string, host string, mass double")
    got = {(r.kind, r.host): r.score for r in url_trust.propagate(edges, mass, tolerance=1e-4, one_task=one_task, hub=hub).collect()}
    for kind, es in graphs.items():
        n = 21
        w, s = np.zeros((n, n)), np.zeros(n)
        for a, b, x in es:
            w[a, b] += x
        for h, m in seeds[kind].items():
            s[h] = m
        walk = np.where(w.sum(1, keepdims=True) > 0, w / np.maximum(w.sum(1, keepdims=True), 1e-9), s)  # hosts without edges return to the seeds
        want = np.linalg.solve(np.eye(n) - 0.85 * walk.T, 0.15 * s)
        assert np.abs(want - [got.get((kind, f"h{i}"), 0.0) for i in range(n)]).sum() < 1e-3 and abs(want.sum() - 1) < 1e-9


def test_lm_score_learns_from_everything(spark):
    # tables grow with the corpus, up to what a worker holds
    assert [lm_score.table_bits(n) for n in (0, 1 << 18, (1 << 18) + 1, 1 << 40)] == [14, 16, 17, lm_score.MOST_BITS]
    # counts are merged over tasks to the same tables, and every bit of every row is learned from
    words = [f"w{i * 7919 % 1009}" for i in range(3000)]

    def stream(batch):
        for w in batch.to_pylist():
            yield lm_score.spelling([w.encode()], 12)[1:]

    rows = make(spark, [(w,) for w in words], "word string")
    one, three = (lm_score._learned(rows.repartition(n), stream, lm_score.SPELLED[0] + (3 << 12)) for n in (1, 3))
    assert (one.table == three.table).all() and (one.table != one.table[-1]).sum() > 1000
    tries = [(20 / (2 * m.slope.astype(float) - 1) - 20).sum() for m in (one, three)]
    assert np.allclose(tries, 8 * sum(len(w) + 1 for w in words), rtol=1e-3)
    # the most frequent words are found without a sort of all
    counted = make(spark, [(f"w{i}", i) for i in range(1, 2001)], "word string, c long")
    some = [r.c for r in lm_score.frequent(counted, 100).collect()]
    assert 0 < len(some) <= 100 and min(some) == 2001 - len(some)  # from a count on, in steps of a sixteenth of a doubling


def test_lm_score_finds_the_words_that_bytes_split_finds():
    texts = ["", None, " A b\x1cC ", "\t\n\x0b\x0c\r ", "É É\x85x\xa0y\u2003Z", "one", "  two\nTWO  Two", "ka" * 5000]
    words, n = lm_score.split(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert [w.encode() for w in words.to_pylist()] == [w for ws in want for w in ws] and n.tolist() == [len(ws) for ws in want]
    parts = list(lm_score.runs(pa.array(texts), 12))
    assert [t for part in parts for t in part.to_pylist()] == texts and all(len(part) == 1 or sum(len((t or "").encode()) for t in part.to_pylist()) <= 12 for part in parts)
    tree = lm_score.Tree([b"one", b"two"], [5, 3], 2, 8, np.ones((2, 1)))
    leaf, hashes, place = tree.tokens_of(words, n)
    alone = [tree.tokens(ws) for ws in want]
    assert (leaf == np.concatenate([a for a, _ in alone])).all() and (hashes == np.concatenate([h for _, h in alone])).all()
    assert place.tolist() == [i for ws in want for i in range(len(ws) + 1)]


def test_lm_score_slots_of_a_group_of_bits_lie_together():
    rng = np.random.default_rng(4)
    tree = small_tree(rng)
    token, slots, bit = tree.bits(np.arange(tree.end + 1), rng.integers(0, 1 << 63, (3, tree.end + 1)).astype(np.uint64), 12)
    word, spelled, _ = lm_score.spelling([b"abc", b"d"], 12)
    for of, tables in ((token, slots), (word, spelled)):
        depth = np.arange(len(of)) - np.searchsorted(of, of)
        if tables is spelled:
            depth %= 8
        group = np.cumsum(depth % lm_score.DEEP == 0)
        for table in tables[1:]:
            line = table >> 4
            assert all(len(set(line[group == g])) == 1 and len(set(table[group == g])) == (group == g).sum() for g in set(group.tolist()))
    # the paths are those of a prefix code
    paths = ["".join(map(str, bit[token == t])) for t in range(tree.end + 1)]
    assert sum(2.0 ** -len(x) for x in paths) == 1 and not any(a != b and b.startswith(a) for a in paths for b in paths)


def test_lm_score_learner_equals_a_loop_over_bits():
    rng = np.random.default_rng(8)
    learner, counts = lm_score.Learner(400), np.zeros((400, 2), np.int64)
    counts[:] = rng.choice([0, 1, 2, 3, 4, 63, 64, 1023, 1024, 5000], (400, 2))
    learner.counts[:] = counts[:, 0].astype(np.uint64) | counts[:, 1].astype(np.uint64) << np.uint64(32)
    weights, slope, tries = learner.weights.astype(float), learner.slope.copy(), np.zeros((2, lm_score.GATES, lm_score.BUCKETS))
    for _ in range(3):
        slots, bits = [rng.integers(100 * k, 100 * k + 100, 300) for k in range(4)], rng.integers(0, 2, 300).astype(np.uint8)
        step, more = np.zeros_like(weights), np.zeros(lm_score.GATES)
        for i, bit in enumerate(bits.tolist()):
            seen = [counts[s[i]] for s in slots]
            x = np.array([np.log((c[1] + 0.2) / (c[0] + 0.2)) for c in seen])
            logs = [int(np.ceil(np.log2(c.sum() + 1))) for c in seen]
            g = min((logs[2] + 1) >> 2, 3) * 4 + min(logs[3], 3)
            st = min(max(weights[g] @ x, -16), 16)
            p = 1 / (1 + np.exp(-st))
            step[g] += (bit - p) * x
            more[g] += p * (1 - p) * (x * x).sum()
            tries[:, g, round(st + 16)] += bit, 1
        for s in slots:
            np.add.at(counts, (s, bits), 1)
        slope = lm_score.KEPT * slope + more
        weights += step / (slope + 20)[:, None]
        learner.learn(slots, bits)
        assert (learner.counts & np.uint64(0xFFFFFFFF) == counts[:, 0]).all() and (learner.counts >> np.uint64(32) == counts[:, 1]).all()
    assert np.allclose(learner.weights, weights, atol=1e-4) and np.allclose(learner.slope, slope, rtol=1e-4)
    assert np.abs(learner.maps - tries).sum() <= 4  # a mix that lies on a bucket's edge may round to the other


def test_url_trust_takes_links_without_a_scheme(spark):
    pages = make(spark, [("x.edu", '<a href="//y.edu/p">y</a> <a href="/local">z</a>')], "host string, html string")
    assert [(r.src, r.dst) for r in url_trust.host_edges(pages).collect()] == [("x.edu", "y.edu")]
