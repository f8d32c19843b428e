"""FLAC frames of all kinds, and the registered queries against DuckDB and brute force on a small awkward fixture."""

import hashlib
import struct
import zlib

import duckdb
import numpy as np
import pytest

from ledgerline.llm import chat, flac, line_dedup, queries


def bits(value, width):
    return [(value >> (width - 1 - i)) & 1 for i in range(width)]


def frame(samples, kind, wasted, body):
    """A frame whose subframe holds the bits `body` after its header."""
    out = bits(kind << 1 | (wasted > 0), 8) + ([0] * (wasted - 1) + [1] if wasted else []) + body
    head = b"\xff\xf8\x70\x02\x00" + struct.pack(">H", len(samples) - 1)
    raw = head + bytes([flac._crc([head], 8, 7)[0]]) + np.packbits(np.array(out + [0] * (-len(out) % 8), np.uint8)).tobytes()
    return raw + struct.pack(">H", flac._crc([raw], 16, 0x8005)[0])


@pytest.mark.parametrize("wasted", [0, 1, 3, 7])
def test_plain_frames_with_wasted_bits(wasted):
    rng = np.random.default_rng(wasted)
    width = 8 - wasted
    small = rng.integers(-(1 << width - 1), 1 << width - 1, 48).tolist()
    verbatim = frame(small, 1, wasted, [b for s in small for b in bits(s, width)])
    constant = frame(small, 0, wasted, bits(small[0], width))
    got = flac.decode_frames([verbatim, constant])
    assert got[0].tolist() == [s << wasted for s in small] and got[1].tolist() == [small[0] << wasted] * 48


@pytest.mark.parametrize("wasted", [0, 2])
@pytest.mark.parametrize("method", [0, 1])
def test_escaped_partitions(wasted, method):
    """Fixed order 1, two partitions: one frame with both escaped, one with none, one with numbers of no bits at all."""
    rng = np.random.default_rng(5)
    frames, want = [], []
    for escaped in ((True, True), (False, False), (True, False), (False, True)):
        small = np.clip(np.cumsum(rng.integers(-3, 4, 64)), -20, 20).tolist()
        if escaped == (False, True):
            small[32:] = [small[31]] * 32
        steps = [b - a for a, b in zip(small, small[1:])]
        body = bits(small[0], 8 - wasted) + bits(method, 2) + bits(1, 4)
        for part, esc in zip((steps[:31], steps[31:]), escaped):
            if esc:
                n = 0 if not any(part) else 7
                body += [1] * (4 + method) + bits(n, 5) + [b for v in part for b in bits(v, n)]
            else:
                body += bits(1, 4 + method)
                for v in part:
                    u = v << 1 ^ v >> 31
                    body += [0] * (u >> 1) + [1, u & 1]
        frames.append(frame(small, 9, wasted, body))
        want.append([s << wasted for s in small])
    assert [x.tolist() for x in flac.decode_frames(frames)] == want


def kinds(stream):
    _, _, first, points = flac._seek_points(stream)
    return [stream[first + a + 6 + (2 if stream[first + a + 2] >> 4 == 7 else 0)] >> 1 for _, a, _ in points]


def test_linear_predictors_are_written_and_read():
    rng = np.random.default_rng(1)
    wave = (128 + 90 * np.sin(np.arange(192 * 60) / 3) + rng.normal(0, 2, 192 * 60)).astype(np.uint8).tobytes()
    prose = flac.payload("the quick brown fox jumps over a lazy dog while seven wizards mix a potion " * 90)
    streams = flac.encode([wave, prose, wave])
    assert all(k == 31 + flac.ORDER for k in kinds(streams[0])[:-1]) and streams[0] == streams[2]
    assert len(streams[0]) < 0.6 * len(wave)
    assert [(x + 128).astype(np.uint8).tobytes() for _, x in flac.decode(streams)] == [wave, prose, wave]


def test_wild_samples():
    """Steps between the extremes, for which a predictor would leave residuals beyond 16 bits."""
    rng = np.random.default_rng(2)
    wild = [(np.arange(192 * 13) % 2 * 255).astype(np.uint8).tobytes(), (rng.integers(0, 2, 192 * 13) * 255).astype(np.uint8).tobytes(), bytes(192 * 7), bytes(191) + b"\xff"]
    assert [(x + 128).astype(np.uint8).tobytes() for _, x in flac.decode(flac.encode(wild))] == wild


def test_runs_and_long_blocks(monkeypatch):
    text = flac.payload("".join(chr(97 + i * i % 26) for i in range(200_000)))
    usual = flac.encode([text, text[:192]])
    monkeypatch.setattr(flac, "STEP", 5000)
    monkeypatch.setattr(flac, "FRAMES", 3)
    assert flac.encode([text, text[:192]]) == usual
    assert [(x + 128).astype(np.uint8).tobytes() for _, x in flac.decode(usual)] == [text, text[:192]]
    monkeypatch.setattr(flac, "MOST_POINTS", 10)
    stream = flac.encode([text])[0]
    offsets, x = flac.decode([stream])[0]
    assert offsets == list(range(0, len(text), flac.LONG_BLOCK)) and (x + 128).astype(np.uint8).tobytes() == text


def test_null_streams_have_no_blocks(spark):
    media = spark.createDataFrame([(1, None, "x"), (2, flac.encode([b"a" * 192])[0], "y"), (None, flac.encode([b"b" * 384])[0], "z")], "doc_id long, media binary, block string")
    rows = flac.pcm_blocks(media, "doc_id", "media").collect()
    assert sorted((r.doc_id or 0, r.block, r.sample_offset, r.n_samples, bytes(r.pcm)) for r in rows) == [(0, 0, 0, 384, b"b" * 384), (2, 0, 0, 192, b"a" * 192)]


COPY = " ".join(f"w{i * 37 % 101}" for i in range(90))
TEXTS = [None, "", " \n\t ", "one", "Two words", "THREE little words", "three  little\nwords", "é" * 500, COPY, COPY + " end", COPY.upper(), COPY.replace("w5 ", "v5 "), "line of text that is long enough to count, A\nx\n" * 3, "𝔘 12३ \u3000 x" * 40]
SHARED = "a line that many of the documents have in common, word for word"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(50 + i, f"head {i}\n \t{SHARED.upper() if i % 2 else SHARED}\ntail {i}\n{SHARED}") for i in range(6)]
    chats = [(1, 0, "user", "a[TURN]b\\"), (1, 1, "user", None), (1, 2, "assistant", "</s>\n é"), (1, 3, "assistant", "𝔘[["), (2, 0, None, "<s>"), (2, None, "od[d", "\\e"), (3, 0, "user", ""), (3, 0, "user", ""), (3, 0, "assistant", "x")]
    chats += [(4, i, ["user", "assistant"][i // 3 % 2], f"turn {i}") for i in range(3000)]
    docs = [(i, t, [None, "x", "y"][i % 3], f"s{i % 4}" if i % 7 else None) for i, t in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    rng = np.random.default_rng(2)
    vectors = [(i, int(rng.integers(0, 10)), rng.normal(0, 0.3, 8).tolist()) for i in range(0, 900, 2)] + [(1, 2, None), (3, None, [0.5] * 8), (5, 2, [None] + [0.5] * 7), (7, 2, [float("nan")] * 8)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    urls = [None, "no scheme", "http://a.Example.com/en/7x?q", "https://b.example.com/en/8", "https://c.net/de/8", "https://Example.net/de/81#f", "https://x.org/es/", "https://org/es/2", "https://xorg/es/2", "ftp://h.edu?x://y", "https://h.edu#/en/"]
    pages = [(i, u, f'<a href="https://link{i}.org/">x</a>' if i % 2 else None) for i, u in enumerate(urls)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(chats, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet/*.parquet'")
    out = queries.queries()[name](spark, sf)
    want = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(map(repr, map(tuple, out.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_media_query_equals_brute_force(spark, sf):
    rows = {r.doc_id: r for r in queries.op8_flac(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for i, text in docs:
        raw, r = (text or "").encode(), rows[i]
        held = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = flac.encode([held])[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        x = np.frombuffer(held, np.uint8).astype(float) - 128
        assert r.feature == f"blocks={-(-len(held) // 1152)};peak={int(np.abs(x).max())};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};steps={np.abs(np.diff(x)).mean():.4f}"


def test_groups_of_one_role_share_a_header(spark):
    rows = [(1, i, role, f"t{i}") for i, role in enumerate(["user", "user", "assistant", "assistant", "assistant", "user", "tool", "tool"])]
    text = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first().formatted
    assert text == "<s>[INST] t0[TURN]t1 [/INST][ANSWER]t2[TURN]t3[TURN]t4</s>[INST] t5 [/INST][ROLE] tool [/ROLE]t6[TURN]t7</s>"


def test_filters_grow_with_the_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{SHARED}\n{i} " + "word " * 40) for i in range(30)] + [(99, None)], "doc_id long, text string")
    assert line_dedup.filter_size(docs, 40) == 1 << line_dedup.LEAST_BITS
    want = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()), key=repr)
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 11)
    assert line_dedup.filter_size(docs.limit(0), 40) == 1 << 11 and line_dedup.filter_size(docs, 1) == 1 << 15  # 8 bits for half of about 8,000 characters
    monkeypatch.setattr(line_dedup, "MOST_BITS", 11)  # a filter that is full
    assert sorted(map(tuple, line_dedup.dedup_lines(docs, min_chars=1, min_docs=5).collect()), key=repr) == want
