"""FLAC media columns: 8-bit mono streams written with fixed or linear predictors and Rice codes, and decoded in lockstep.

All frames of a run that share block size, predictor and partition order are decoded together: one numpy step
takes the next Rice code of every frame. Frame and header checksums and the stream's MD5 are verified. A seek
point for every frame gives sample and byte offsets, so any PCM block can be read alone. Long streams are encoded
and decoded in runs of frames, so the work space doesn't grow with the text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

BLOCK = 1152
UNIT = 192
RATE = 8000
#: Bytes of payload that are encoded or decoded at once, and the frames of one run.
STEP = 1 << 21
FRAMES = STEP // BLOCK
#: Most seek points of a stream (the table's length has 24 bits); longer streams take blocks of LONG_BLOCK samples.
MOST_POINTS, LONG_BLOCK = 900_000, 1 << 15
#: Linear predictors: how many samples they look back, and bits of a coefficient.
ORDER, PRECISION = 8, 10


@lru_cache(2)
def _crc_table(bits: int, poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table


def _crc(rows: list[bytes], bits: int, poly: int) -> np.ndarray:
    """The checksum of each row. It starts at 0, so zeros put before shorter rows don't change it."""
    table = _crc_table(bits, poly)
    width = max(map(len, rows))
    data = np.frombuffer(b"".join(r.rjust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width).T.copy()
    crc = np.zeros(len(rows), np.uint32)
    for column in data:
        crc = table[crc >> (bits - 8) ^ column] ^ (crc << 8 & ((1 << bits) - 1))
    return crc


def _coded_number(n: int) -> bytes:
    """The frame number in the form that FLAC shares with UTF-8, up to 36 bits."""
    if n < 128:
        return bytes([n])
    tail = next(t for t in range(1, 7) if n < 1 << 5 * t + 6)
    return bytes([(0xFF00 >> tail + 1) & 0xFF | n >> 6 * tail, *(0x80 | n >> 6 * i & 63 for i in range(tail - 1, -1, -1))])


def _predictors(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame (row) the ORDER coefficients, as integers, that predict a sample from those before it, and their shift."""
    count, n = samples.shape
    x = samples * np.hanning(n + 2)[1:-1].astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", x[:, : n - lag], x[:, lag:]) for lag in range(ORDER + 1)], axis=1).astype(float)
    left = r[:, 0] * (1 + 1e-6) + 1e-6
    coefs = np.zeros((count, ORDER))
    for i in range(ORDER):  # Levinson's recursion, all frames at once
        k = np.clip((r[:, i + 1] - (coefs[:, :i] * r[:, i:0:-1]).sum(axis=1)) / left, -0.999, 0.999)
        coefs[:, :i] -= k[:, None] * coefs[:, :i][:, ::-1]
        coefs[:, i] = k
        left *= 1 - k * k
    most = 1 << PRECISION - 1
    shift = np.clip(np.floor(np.log2((most - 1) / np.maximum(np.abs(coefs).max(axis=1), 1e-3))), 0, 15).astype(np.int32)
    return np.clip(np.rint(coefs * (1 << shift)[:, None]), -most, most - 1).astype(np.int32), shift


def _bodies(samples: np.ndarray) -> list[bytes]:
    """The subframes of frames (rows) of one size, each padded to whole bytes."""
    count, n = samples.shape
    residual = [samples, np.diff(samples, axis=1), np.diff(samples, n=2, axis=1)]
    folded = [(r << 1 ^ r >> 15).astype(np.uint16) for r in residual]
    mean = [f.mean(axis=1) for f in folded]
    orders, extra = [0, 1, 2], np.zeros(3)
    if n > 4 * ORDER:
        coefs, shift = _predictors(samples)
        wide = samples.astype(np.int32)
        guess = sum(coefs[:, j : j + 1] * wide[:, ORDER - 1 - j : n - 1 - j] for j in range(ORDER))
        linear = wide[:, ORDER:] - (guess >> shift[:, None])
        small = np.abs(linear).max(axis=1) < 1 << 14
        folded.append((linear << 1 ^ linear >> 31).astype(np.uint16))
        mean.append(np.where(small, folded[3].mean(axis=1), 1e9))
        orders, extra = [*orders, ORDER], np.array([0, 0, 0, (9 + ORDER * PRECISION) / n])
    means = np.stack(mean)
    ks = np.clip(np.floor(np.log2(np.maximum(means, 1))).astype(int), 0, 14)
    choice = (means / (1 << ks) + ks + extra[:, None]).argmin(axis=0)
    k_of = ks[choice, np.arange(count)]
    out: list[bytes] = [b""] * count
    for c, k in {*zip(choice.tolist(), k_of.tolist())}:
        at = np.flatnonzero((choice == c) & (k_of == k))
        order, linear = orders[c], c == 3
        head = 10 + (9 + ORDER * PRECISION if linear else 0)
        u = folded[c][at].astype(np.int64)
        q = u >> k
        size = q + 1 + k
        end = np.cumsum(size, axis=1)
        total = (head + end[:, -1] + 7) // 8
        base = 8 * (np.cumsum(total) - total)
        bits = np.zeros(8 * int(total.sum()), np.uint8)

        def put(place: int, value: np.ndarray | int, width: int) -> None:
            for j in range(width):
                bits[base + place + j] = value >> (width - 1 - j) & 1

        if linear:
            put(0, PRECISION - 1, 4)
            put(4, shift[at], 5)
            for j in range(ORDER):
                put(9 + j * PRECISION, coefs[at, j], PRECISION)
        put(head - 4, k, 4)
        stop = (base[:, None] + head + end - size + q).ravel()
        bits[stop] = 1
        low = u.ravel()
        for j in range(k):
            bits[stop + 1 + j] = low >> (k - 1 - j) & 1
        packed = np.packbits(bits).tobytes()
        kind = bytes([(31 + ORDER if linear else 8 + order) << 1])
        for row, a, b in zip(at.tolist(), (base // 8).tolist(), (base // 8 + total).tolist()):
            body = kind + samples[row, :order].astype(np.int8).tobytes() + packed[a:b]
            out[row] = body if len(body) <= n else b"\x02" + samples[row].astype(np.int8).tobytes()
    for row in np.flatnonzero((samples == samples[:, :1]).all(axis=1)).tolist():
        out[row] = b"\0" + samples[row, :1].astype(np.int8).tobytes()
    return out


def block_size(size: int) -> int:
    """Samples of a block in a stream of so many samples."""
    return BLOCK if size <= BLOCK * MOST_POINTS else LONG_BLOCK


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; a sample is a byte less 128."""
    where: dict[int, list[tuple[int, int, int]]] = {}
    of: list[list[bytes]] = []
    for i, p in enumerate(payloads):
        block = block_size(len(p))
        of.append([b""] * -(-len(p) // block))
        for number, start in enumerate(range(0, len(p), block)):
            where.setdefault(min(block, len(p) - start), []).append((i, number, start))
    for n, places in where.items():
        step = max(STEP // n, 1)
        for run in range(0, len(places), step):
            some = places[run : run + step]
            samples = np.frombuffer(b"".join(payloads[i][start : start + n] for i, _, start in some), np.uint8).reshape(-1, n).astype(np.int16) - 128
            size, length = (b"\x30", b"") if n == BLOCK else (b"\x70", struct.pack(">H", n - 1))
            heads = [b"\xff\xf8" + size + b"\x02" + _coded_number(j) + length for _, j, _ in some]
            frames = [h + bytes([c]) + f for h, c, f in zip(heads, _crc(heads, 8, 0x07).tolist(), _bodies(samples))]
            for (i, j, _), f, c in zip(some, frames, _crc(frames, 16, 0x8005).tolist()):
                of[i][j] = f + struct.pack(">H", c)
    return [_stream(p, frames) for p, frames in zip(payloads, of)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes, block = [len(f) for f in frames], block_size(len(payload))
    signed = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
    info = struct.pack(">HH", block, block) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
    info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    points, offset = [], 0
    for j, size in enumerate(sizes):
        points.append(struct.pack(">QQH", j * block, offset, min(block, len(payload) - j * block)))
        offset += size
    seek = b"".join(points)
    return b"".join([b"fLaC\0", len(info).to_bytes(3, "big"), info, b"\x83", len(seek).to_bytes(3, "big"), seek, *frames])


def _seek_points(stream: bytes) -> tuple[bytes, int, int, list[tuple[int, int, int]]]:
    """MD5, total samples, where the frames start, and (sample, byte offset, samples) of each seek point."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, points, md5, total = 4, False, [], b"", 0
    while not last:
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            md5, total = body[18:34], int.from_bytes(body[10:18], "big") & (1 << 36) - 1
        elif kind == 3:
            points = [x for x in struct.iter_unpack(">QQH", body) if x[0] != (1 << 64) - 1]
        at += 4 + size
    return md5, total, at, points


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The samples of whole 8-bit mono frames. Wrong checksums, and what isn't such a frame, raise ValueError."""
    if not frames:
        return []
    if (_crc([f[:-2] for f in frames], 16, 0x8005) != [int.from_bytes(f[-2:], "big") for f in frames]).any():
        raise ValueError("frame checksum")
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(frames)
    heads, groups = [], {}
    for i, f in enumerate(frames):
        if f[0] != 0xFF or f[1] & 0xFE != 0xF8 or f[3] & 0xFE != 0x02:
            raise ValueError("not an 8-bit mono frame")
        at = 5 if f[4] < 128 else 4 + 8 - (f[4] ^ 0xFF).bit_length()
        code = f[2] >> 4
        n = 192 if code == 1 else 576 << code - 2 if code < 6 else f[at] + 1 if code == 6 else int.from_bytes(f[at : at + 2], "big") + 1 if code == 7 else 256 << code - 8
        at += {6: 1, 7: 2}.get(code, 0)
        heads.append(f[: at + 1])
        kind, wasted, bit = f[at + 1] >> 1, 0, 8 * (at + 2)
        if f[at + 1] & 1:  # as many low bits of all samples are zero
            zeros = int.from_bytes(f[at + 2 : at + 4], "big")
            wasted = 17 - zeros.bit_length()
            bit += wasted
        if wasted > 7:
            raise ValueError("more wasted bits than a sample has")
        if kind < 2:
            count, width = n if kind else 1, 8 - wasted
            plain = np.unpackbits(np.frombuffer(f, np.uint8, (bit + count * width + 7) // 8 - bit // 8, bit // 8))[bit % 8 :][: count * width].reshape(count, width)
            plain = np.packbits(plain, axis=1)[:, 0].view(np.int8).astype(np.int16)  # the sign is in the highest bit
            out[i] = np.broadcast_to(plain, n) if kind == 0 else plain
        else:
            groups.setdefault((n, kind, wasted), []).append((i, bit))
    if (_crc([h[:-1] for h in heads], 8, 0x07) != [h[-1] for h in heads]).any():
        raise ValueError("header checksum")
    for (n, kind, wasted), members in groups.items():
        order = kind - 31 if kind & 32 else kind - 8
        data = b"".join(frames[i] for i, _ in members) + bytes(8)
        raw = np.frombuffer(data, np.uint8)
        size = np.array([len(frames[i]) for i, _ in members])
        pos = 8 * (np.cumsum(size) - size) + [bit for _, bit in members]
        wide = raw[:-3].astype(np.uint32) << 24 | raw[1:-2].astype(np.uint32) << 16 | raw[2:-1].astype(np.uint32) << 8 | raw[3:]

        def take(pos: np.ndarray, bits) -> np.ndarray:
            """The next `bits` (up to 25) bits at bit positions pos."""
            return (wide[pos >> 3] << (pos & 7).astype(np.uint32) >> np.uint32(7) >> (25 - np.asarray(bits)).astype(np.uint32)).astype(np.int64)

        def signed(pos: np.ndarray, bits) -> np.ndarray:
            value = take(pos, bits)
            return value - (value >> (np.asarray(bits) - 1) << bits)

        width = 8 - wasted
        warm = signed(pos[:, None] + np.arange(order) * width, width)
        pos = pos + order * width
        coefs = shift = None
        if kind & 32:
            precision = take(pos, 4) + 1
            shift = take(pos + 4, 5)
            coefs = np.stack([signed(pos + 9 + j * precision, precision) for j in range(order)])
            pos = pos + 9 + order * precision
        method, parts = take(pos, 2), take(pos + 2, 4)
        pos = pos + 6
        # for each bit the place of the next one that is set
        after = np.where(np.unpackbits(raw), np.arange(8 * len(raw), dtype=np.int32), np.int32(8 * len(raw)))[::-1]
        after = np.minimum.accumulate(after, out=after)[::-1]
        folded = np.empty((len(members), n - order), np.int64)
        for m, p in {*zip(method.tolist(), parts.tolist())}:
            some = np.flatnonzero((method == m) & (parts == p))
            here, done = pos[some].copy(), 0
            for part in range(1 << p):
                count = (n >> p) - (order if part == 0 else 0)
                k, here = take(here, 4 + m), here + 4 + m
                escaped = k == (15 if m == 0 else 31)
                if escaped.any():  # numbers of a stated width follow in place of codes
                    at = here[escaped][:, None]
                    bits = take(at, 5)
                    if (bits > 25).any():
                        raise ValueError("escaped numbers too wide for 8-bit samples")
                    value = np.where(bits > 0, signed(at + 5 + np.arange(count) * bits, np.maximum(bits, 1)), 0)
                    folded[some[escaped], done : done + count] = value << 1 ^ value >> 63
                    here[escaped] = (at + 5 + count * bits)[:, 0]
                coded = np.flatnonzero(~escaped)
                now, k, step = here[coded], k[coded], k[coded] + 1
                start, stop = np.empty((count, len(coded)), np.int64), np.empty((count, len(coded)), np.int64)
                for j in range(count):
                    start[j] = now
                    stop[j] = after[now]
                    now = stop[j] + step
                folded[some[coded], done : done + count] = ((stop - start << k) | take(stop + 1, k)).T
                here[coded] = now
                done += count
        residual = folded >> 1 ^ -(folded & 1)
        if coefs is None:
            samples = _fixed(warm, residual)
        else:
            samples = np.concatenate([warm, residual], axis=1).T.copy()
            backwards = coefs[::-1].copy()
            for j in range(order, n):
                samples[j] += np.einsum("ij,ij->j", samples[j - order : j], backwards) >> shift
            samples = samples.T
        for (i, _), row in zip(members, (samples << wasted).astype(np.int16)):
            out[i] = row
    return out


def _fixed(warm: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Undoes `order` rounds of differences; each starts from the differences that the warm-up samples have."""
    out = residual
    for d in range(warm.shape[1] - 1, -1, -1):
        out = np.cumsum(np.concatenate([np.diff(warm, n=d, axis=1)[:, :1], out], axis=1), axis=1)
    return out


def decode(streams: list[bytes]) -> list[tuple[list[int], np.ndarray]]:
    """Of each stream: the blocks' sample offsets and all samples, checked against the stream's MD5."""
    return [(offsets, samples.astype(np.int16)) for offsets, samples in _decoded(streams)]


def _decoded(streams: list[bytes]) -> list[tuple[list[int], np.ndarray]]:
    """As decode(), the samples as signed bytes."""
    parsed = [_seek_points(s) for s in streams]
    where = []
    for s, (_, _, first, points) in zip(streams, parsed):
        ends = [first + o for _, o, _ in points[1:]] + [len(s)]
        where += [(s, first + a, b) for (_, a, _), b in zip(points, ends)]
    blocks, run, size = [], [], 0
    for k, (s, a, b) in enumerate(where, 1):
        run.append(s[a:b])
        size += b - a
        if size >= STEP or len(run) == FRAMES or k == len(where):
            blocks += [x.astype(np.int8) for x in decode_frames(run)]
            run, size = [], 0
    out, i = [], 0
    for md5, total, _, points in parsed:
        own = blocks[i : i + len(points)]
        i += len(points)
        samples = np.concatenate(own) if own else np.zeros(0, np.int8)
        if len(samples) != total or hashlib.md5(samples.tobytes()).digest() != md5:
            raise ValueError("stream checksum, or no seek point for some frame")
        out.append(([p[0] for p in points], samples))
    return out


def payload(text: str) -> bytes:
    """The text's UTF-8 bytes, blanks appended up to a positive multiple of UNIT."""
    raw = text.encode()
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def stored(texts: Column) -> Column:
    """A FLAC stream (binary) that holds the payload of each text; null is stored as empty text."""

    @F.arrow_udf("binary")
    def store(batch: pa.Array) -> pa.Array:
        return pa.array([s for part in slices(batch, STEP) for s in encode([payload(t) for t in part])], pa.binary())

    return store(texts)


def _streams(batch: pa.Array) -> Iterator[list[bytes | None]]:
    part, size = [], 0
    for s in batch:
        s = s.as_py()
        if part and size + len(s or b"") > STEP:
            yield part
            part, size = [], 0
        part.append(s)
        size += len(s or b"")
    if part:
        yield part


def feature(offsets: list[int], samples: np.ndarray) -> str:
    """What is written about a stream's samples."""
    seen, values = np.bincount(samples.view(np.uint8), minlength=256), np.arange(256, dtype=np.uint8).view(np.int8).astype(np.int64)
    n, steps = max(len(samples), 1), sum(int(np.abs(np.diff(samples[i : i + STEP + 1].astype(np.int16))).sum()) for i in range(0, len(samples), STEP))
    peak = np.abs(values[seen > 0]).max(initial=0)
    return f"blocks={len(offsets)};peak={peak};mean={(seen * values).sum() / n:.4f};rms={np.sqrt((seen * values * values).sum() / n):.4f};steps={steps / max(len(samples) - 1, 1):.4f}"


def decoded(media: Column) -> Column:
    """struct<feature, blocks>: features of the samples, and the PCM blocks with their sample offsets, of each stored stream; null for null."""

    @F.arrow_udf("struct<feature: string, blocks: array<struct<sample_offset: long, n_samples: long, pcm: binary>>>")
    def blocks(batch: pa.Array) -> pa.Array:
        features, starts, offsets, sizes, pcm = [], [0], [], [], []
        for part in _streams(batch):
            read = iter(_decoded([s for s in part if s is not None]))
            for s in part:
                if s is None:
                    features.append(None)
                else:
                    at, x = next(read)
                    raw = (x.view(np.uint8) ^ 128).tobytes()
                    features.append(feature(at, x))
                    offsets += at
                    sizes += [b - a for a, b in zip(at, [*at[1:], len(raw)])]
                    pcm += [raw[a : a + n] for a, n in zip(at, sizes[len(pcm) :])]
                starts.append(len(pcm))
        inner = pa.StructArray.from_arrays([pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(pcm, pa.binary())], names=["sample_offset", "n_samples", "pcm"])
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), inner)
        return pa.StructArray.from_arrays([pa.array(features, pa.string()), lists], names=["feature", "blocks"], mask=pa.array([f is None for f in features], pa.bool_()))

    return blocks(media)


def joined(blocks: Column) -> Column:
    """The bytes of PCM blocks, one after the other."""
    return F.encode(F.array_join(F.transform(blocks, lambda b: F.decode(b["pcm"], "ISO-8859-1")), ""), "ISO-8859-1")


def pcm_blocks(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id_col, block, sample_offset, n_samples, pcm): the decoded blocks of each stream, as unsigned 8-bit PCM.

    Null streams have none; an empty table gives no rows; a repeated row's blocks come as often as the row. Other
    columns are not read. A stream that doesn't hold what its checksums say raises ValueError.
    """
    some = media.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{media_col}`").alias("media")).where("media IS NOT NULL")
    rows = some.select("id", decoded(F.col("media"))["blocks"].alias("blocks")).select("id", F.posexplode("blocks").alias("block", "b"))
    return rows.select(F.col("id").alias(id_col), "block", "b.sample_offset", "b.n_samples", "b.pcm")
