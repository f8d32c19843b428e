"""Text scoring by online logistic context mixing over bits.

A text is a row of tokens: its words (A-Z lower-cased) and an end. Each token is a path of bits in a Huffman tree of the
frequent words, the end and an escape; a word that the tree lacks follows its escape by its own bits. A word
seen once is learned twice where it stands, as itself and as an escape: so often would the rest of the texts have needed one. Each bit of a path is
predicted by four contexts: the node alone, and the node hashed with the profile (language) that the words so far fit
best, the last word, and the last two words. Counts of every
context come from all training texts; tables grow with the training tokens up to a size that a worker holds.
The predictions are mixed in the logistic domain by weights that a gate selects (how often the longer contexts were
seen). Weights and adaptive probability maps are learned online over every training text, each task by itself,
and merged; from there the weights go on adapting within each scored text, block by block, so that every bit is
predicted from what comes before it alone. A word behind an escape takes a discounted share of its training count, or, if
it is new, the discount's share times its spelling: the same kind of mixer over the bits of its bytes, with
contexts of bytes, learned from all distinct words.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

#: Frequent words that the tree holds at most; they are looked up without a shuffle.
HOT_WORDS = 1 << 16
#: log2 of the slots of a hashed table at most (three tables, 8 bytes a slot while learning, 2 while scoring).
MOST_BITS = 23
CONTEXTS, GATES, BUCKETS = 4, 16, 33
#: Profiles are told apart by their digest modulo this; those of a large number share places.
PROFILES = 64
#: Tokens after which the weights of a text are adapted; tokens that are expanded to bits at once.
BLOCK, RUN = 64, 1 << 12
#: Texts whose blocks are scored together.
PIECE = 128
#: Bits of a path whose slots lie together: one hash and about one line of the cache stand for them.
DEEP = 4  # 4 at most, as a place in a group has four bits
#: Strength of the learned weights against what a text shows.
HOLD = 400.0
#: Slots that are packed together; bytes of text whose words are counted before they are handed on.
PART, COUNTED = 1 << 16, 1 << 25
#: Bytes of text whose tokens are held at once.
TEXTS = 1 << 21
END = "\n"
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
Bits = tuple[list[np.ndarray], np.ndarray]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (null: none) one behind the other, A-Z lower-cased, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, n = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    there = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # blanks at an end leave empty ones
    if there.all():
        return words, n
    return words.filter(pa.array(there)), np.bincount(np.repeat(np.arange(len(n)), n)[there], minlength=len(n))


def runs(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Parts of a column of texts of about `limit` bytes, or one text."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + limit, side="right")))
        yield column.slice(begin, end - begin)
        begin = end


def squeezed(data: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(data), asbytes=True)


def spread(data: bytes, size: int, dtype: str) -> np.ndarray:
    """The `size` values that squeezed() took."""
    return np.frombuffer(pa.Codec("zstd", 1).decompress(data, size * np.dtype(dtype).itemsize), dtype)


def table_bits(events: int, least: int = 14, most: int = MOST_BITS) -> int:
    """log2 of the slots of a hashed table for so many training tokens or words."""
    return min(max(math.ceil(math.log2(max(events, 1))) - 2, least), most)


class Tree:
    """A Huffman tree of hot words (by their counts), an escape and the end: paths of nodes and bits."""

    def __init__(self, words: list[bytes], counts: list[int], escaped: int, ends: int, profiles: np.ndarray):
        # log P(word | profile) by leaf; the escape and the end tell nothing
        self.profiles = np.log((profiles + 0.1) / (profiles.sum(0) + 0.1 * max(len(words), 1))).astype(np.float32)
        self.profiles = np.concatenate([self.profiles - self.profiles.mean(1, keepdims=True), np.zeros((2, profiles.shape[1]), np.float32)]).T.copy()
        self.words = pa.array(words, pa.binary())
        self.escape, self.end = len(words), len(words) + 1
        self.counts = np.array([*counts, 0, ends], float)
        heap = [(max(c, 1), i) for i, c in enumerate([*counts, escaped, ends])]
        heapq.heapify(heap)
        up = np.zeros(2 * len(heap) - 1, np.int64)
        side, node = np.zeros(len(up), np.uint8), len(heap)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i] = up[j] = node
            side[j] = 1
            heapq.heappush(heap, (a + b, node))
            node += 1
        self.nodes = len(words) + 1
        at, bit, inside, root, deep, groups = [], [], [], [], [], [0]
        for leaf in range(len(words) + 2):
            path = []
            while leaf != node - 1:
                path.append((up[leaf] - self.nodes - 1, side[leaf]))
                leaf = up[leaf]
            for i, (n, b) in enumerate(reversed(path)):
                if i % DEEP == 0:
                    root.append(n)
                    deep.append(min(DEEP, len(path) - i))
                inside.append(2 * inside[-1] + bit[-1] if i % DEEP else 1)
                at.append(n)
                bit.append(b)
            groups.append(len(root))
        # of each bit of a group: its node, the node's place in the group, and the bit; -1 behind a path's end
        # a path's groups of DEEP bits, and their first nodes
        self.group, self.root, deep = np.array(groups), np.array(root, np.uint64) * M3, np.array(deep, np.int64)
        self.path = np.full((len(root), DEEP), -1, np.int32)
        self.path[np.arange(DEEP) < deep[:, None]] = np.array(at, np.int64) << 5 | np.array(inside, np.int64) << 1 | np.array(bit, np.int64)
        self.hashes = np.array([*map(xxhash.xxh3_64_intdigest, words), 0, 0], np.uint64)

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and hash of each word, and of the end."""
        return self.tokens_of(pa.array(words, pa.binary()), np.array([len(words)]))[:2]

    def tokens_of(self, words: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, hash and place of each token of texts that have `n` words each, an end behind each text's."""
        at = np.arange(len(words)) + np.repeat(np.arange(len(n)), n)
        leaf = np.full(len(words) + len(n), self.end)
        leaf[at] = pc.index_in(words.cast(pa.binary()), value_set=self.words).fill_null(self.escape).to_numpy(zero_copy_only=False)
        hashes = self.hashes.take(leaf)
        rare = np.flatnonzero(leaf[at] == self.escape)
        hashes[at[rare]] = np.fromiter(map(xxhash.xxh3_64_intdigest, words.take(pa.array(rare)).to_numpy(zero_copy_only=False)), np.uint64, len(rare))
        ends = np.cumsum(n + 1)
        return leaf, hashes, np.arange(len(leaf)) - np.repeat(ends - n - 1, n + 1)

    def contexts(self, leaf: np.ndarray, hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each token, at `place` in its text: hashes of the profile so far, the last word, and the last two words."""
        n = len(leaf)
        out = np.empty((3, n), np.uint64)
        profile = self.best_profile(leaf, place)
        out[0] = profile.astype(np.uint64) * M3 + M2
        mixed = np.full(n, M2)
        for k in (1, 2):
            before = np.concatenate([np.zeros(min(k, n), np.uint64), hashes[:-k]])
            mixed = (mixed ^ np.where(place >= k, before, np.uint64(k))) * M1
            mixed ^= mixed >> np.uint64(31)
            out[k] = mixed
        return out

    def with_escapes(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves to learn, and the tokens that they stand for: an escape before each leaf that was seen once."""
        once = np.flatnonzero(self.counts[leaf] == 1)
        once = once[leaf[once] < self.escape]
        at = np.insert(np.arange(len(leaf)), once, once)
        out = leaf[at]
        out[once + np.arange(len(once))] = self.escape
        return out, at

    def best_profile(self, leaf: np.ndarray, place: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """Of each token: the profile, from 1 on, that the words of its text before it fit best; 0 for a first token. Worked out `step` tokens at a time."""
        out = np.empty(len(leaf), np.int64)
        carried, begun = np.zeros(len(self.profiles)), np.zeros(len(self.profiles))
        for a in range(0, len(leaf), step):
            some, there = leaf[a : a + step], place[a : a + step]
            start = np.arange(len(some)) - there
            here, start = start >= 0, np.maximum(start, 0)
            best, which = np.full(len(some), -np.inf), np.zeros(len(some), np.int64)
            for k, logs in enumerate(self.profiles):
                sums = np.empty(len(some) + 1)
                sums[0] = 0
                np.cumsum(logs.take(some), dtype=np.float64, out=sums[1:])
                sums += carried[k]
                before = np.where(here, sums.take(start), begun[k])
                carried[k], begun[k] = sums[-1], before[-1]
                fit = np.subtract(sums[:-1], before, out=before)
                which[fit > best] = k + 1
                np.maximum(best, fit, out=best)
            out[a : a + step] = np.where(there > 0, which, 0)
        return out

    def bits(self, leaf: np.ndarray, contexts: np.ndarray, size: int) -> tuple[np.ndarray, *Bits]:
        """For every bit of the tokens: token, slots in the four tables, bit."""
        of, group = _ranges(self.group, leaf)
        path = self.path.take(group, axis=0, mode="clip").ravel()
        there = np.flatnonzero(path >= 0)
        path = path.take(there, mode="clip")
        bit_of = there // DEEP
        slots = _hashed(contexts, of, self.root.take(group), bit_of, (path >> 1 & 15).astype(np.int64), self.sizes(size))
        return of.take(bit_of, mode="clip"), [(path >> 5).astype(np.int64), *slots], (path & 1).astype(np.uint8)

    def sizes(self, size: int) -> list[int]:
        """Slots of the four tables."""
        return [-(-self.nodes // 16) * 16, *[1 << size] * 3]


def _ranges(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges from start[i] to start[i + 1] for each i in `of`, one behind the other: which one, and the places in it."""
    first = start.take(of)
    n = start.take(of + 1) - first
    ends = np.cumsum(n)
    which = np.repeat(np.arange(len(of)), n)
    first -= ends
    first += n
    place = first.take(which, mode="clip")  # which is faster than the mode that raises; all places are there
    place += np.arange(len(which))
    return which, place


def _hashed(contexts: np.ndarray, of: np.ndarray, step: np.ndarray, group: np.ndarray, inside: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Slots of hashed contexts, each table behind the ones before it: a hash for each group of bits, and each of its nodes has its own slot beside the others'."""
    out, at = [], sizes[0]
    for c, n in zip(contexts, sizes[1:]):
        slot = (((c.take(of) + step) * M2) >> np.uint64(65 - int(n).bit_length())).view(np.int64)
        slot += at  # tables begin at multiples of 16
        slot = slot.take(group, mode="clip")
        slot ^= inside
        out.append(slot)
        at += n
    return out


SPELLED = [1 << 16]
# of each byte: its bits' nodes, and its groups of DEEP bits as a tree's paths have them
_NODE = 1 << np.arange(8) | np.arange(256)[:, None] >> 8 - np.arange(8)
_DEEP = np.array([min(DEEP, 8 - i) for i in range(0, 8, DEEP)])
_ROOT = _NODE[:, ::DEEP].astype(np.uint64) * M3
_INSIDE = np.concatenate([1 << np.arange(n) | (_NODE[:, i : i + n] & (1 << np.arange(n)) - 1) for i, n in zip(range(0, 8, DEEP), _DEEP)], axis=1)


def spelling(words: list[bytes], size: int) -> tuple[np.ndarray, *Bits]:
    """For every bit of every word and its end: word, slots (the last byte; the last two, the last three, the word so far), bit."""
    flat = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    last = [np.where(place >= k, np.concatenate([np.zeros(min(k, len(flat)), np.uint8), flat[:-k]]), 0).astype(np.uint64) for k in (1, 2, 3)]
    two = last[0] | last[1] << np.uint64(8)
    # the word so far: sums of its bytes times odd powers, each place with its own
    power = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * M1
    power = (power ^ power >> np.uint64(29)) * M3
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    sofar = total[:-1] - total[np.arange(len(flat)) - place]
    contexts = np.stack([two * M1 + np.uint64(2), (two | last[2] << np.uint64(16)) * M1 + np.uint64(3), (sofar ^ sofar >> np.uint64(31)) * M1 + np.uint64(4)])
    of, group = np.repeat(np.arange(len(flat)), 8), np.repeat(np.arange(len(flat)), len(_DEEP))
    slots = _hashed(contexts, group, _ROOT.take(flat, axis=0).ravel(), np.repeat(np.arange(len(group)), np.tile(_DEEP, len(flat))), _INSIDE.take(flat, axis=0).ravel(), [*SPELLED, *[1 << size] * 3])
    return word.take(of), [(last[0].astype(np.int64) << 8).take(of) | _NODE.take(flat, axis=0).ravel(), *slots], np.unpackbits(flat)


_SMALL = np.arange(64)
_LOGS = np.log((_SMALL[:, None] + 0.2) / (_SMALL[None, :] + 0.2)).astype(np.float32).ravel()
_SEEN = np.ceil(np.log2(_SMALL[:, None] + _SMALL[None, :] + 1)).astype(np.uint8).ravel()


def prepared(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of counts (ones in the upper half, zeros in the lower): the mixer's input, and how often the slot was seen (log2)."""
    at = ((counts >> np.uint64(26)) | counts) & np.uint64(4095)
    x, seen = _LOGS.take(at), _SEEN.take(at)
    large = np.flatnonzero(counts & np.uint64(0xFFFFFFC0FFFFFFC0))
    if len(large):
        zeros, ones = (counts[large] & np.uint64(0xFFFFFFFF)).astype(float), (counts[large] >> np.uint64(32)).astype(float)
        x[large] = np.log((ones + 0.2) / (zeros + 0.2))
        seen[large] = np.ceil(np.log2(zeros + ones + 1))
    return x, seen


def fresh(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mixer's input as prepared() has it, by arithmetic alone, and how often the slot was seen (and 0.4)."""
    both = counts.view(np.int32).astype(np.float32)  # zeros and ones by turns; a learner hands its counts on before they reach 2^31
    both += np.float32(0.2)
    zeros, ones = both[::2], both[1::2]
    x = ones / zeros
    return np.log(x, out=x), zeros + ones


#: Gates by how often the longer contexts' slots were seen (log2).
_GATES = [np.minimum((np.arange(32) + 1) >> 2, 3) * 4, np.minimum(np.arange(32), 3)]


def gate_of(two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """The gate, from log2 of how often the slots of the last word and of the last two were seen."""
    return _GATES[0].take(two) + _GATES[1].take(three)


def gate_of_sums(two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """The same from what fresh() tells: their logs are 3, 7 and 11 from 4, 64 and 1024 on; 1, 2 and 3 from 1, 2 and 4 on."""
    far = (two > 4).view(np.uint8) + (two > 64).view(np.uint8) + (two > 1024).view(np.uint8)
    return (far * np.uint8(4) + (three > 1).view(np.uint8) + (three > 2).view(np.uint8) + (three > 4).view(np.uint8)).astype(np.int64)


def mixed(weights: list[np.ndarray], x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The mix in the logistic domain of columns of inputs with their weights, and its probability; weights are overwritten."""
    st = weights[0]
    st *= x[0]
    for w, v in zip(weights[1:], x[1:]):
        w *= v
        st += w
    np.clip(st, -16, 16, out=st)
    p = np.exp(-st)
    p += 1
    return st, np.divide(1, p, out=p)


#: Slots of a scoring table hold the mixer's input in steps of 1/64 and, in the lower five bits, how often they were seen.
_STEP = np.float32(1 / 64)


def packed(x: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return (np.clip(np.rint((x + 16) * 64), 0, 2047).astype(np.uint16) << np.uint16(5)) | np.minimum(seen, 31)


#: What a zero and a one add to a slot; the share of a gate's slope that stays from run to run.
_ONE = np.array([1, 1 << 32], np.uint64)
KEPT = 0.995 ** (RUN / (1 << 13))


def aligned(n: int, dtype: str) -> np.ndarray:
    """Zeros that begin with a line of the cache, so that a group's slots don't lie across one more; numpy's own memory lies on large pages."""
    raw = np.zeros(n * np.dtype(dtype).itemsize + 64, np.uint8)
    return raw[-raw.ctypes.data % 64 :][: n * np.dtype(dtype).itemsize].view(dtype)


class Learner:
    """What one task learns: counts of all slots, weights by gate with their slopes, hits and tries of the maps."""

    def __init__(self, slots: int):
        self.counts = aligned(slots, "u8")  # two counts of 32 bits each
        self.weights, self.slope, self.maps, self.n = np.full((GATES, CONTEXTS), 0.35, np.float32), np.full(GATES, 20.0), np.zeros((2, GATES, BUCKETS)), 0

    def learn(self, slots: list[np.ndarray], bit: np.ndarray) -> None:
        """Counts the bits, predicts them from what was seen before, and moves the weights of each gate against the error."""
        one, x, seen = _ONE.take(bit, mode="clip"), [], []
        for s in slots:
            found = self.counts.take(s, mode="clip")
            np.add.at(self.counts, s, one)  # while the slots are in the core's cache
            v, n = fresh(found)
            x.append(v)
            seen.append(n)
        gate = gate_of_sums(*seen[2:])
        st, p = mixed([w.take(gate, mode="clip") for w in self.weights.T.copy()], x)
        error = bit.astype(np.float32)
        error -= p
        step = np.stack([np.bincount(gate, error * v, GATES) for v in x], axis=1)
        self.slope = KEPT * self.slope + np.bincount(gate, p * (1 - p) * sum(v * v for v in x), GATES)
        self.weights += (step / (self.slope + 20)[:, None]).astype(np.float32)
        at = np.rint(st + 16).astype(np.int64)
        at += gate * BUCKETS
        at += at
        at += bit
        tries = np.bincount(at, minlength=2 * GATES * BUCKETS).reshape(GATES, BUCKETS, 2)
        self.maps[0] += tries[:, :, 1]
        self.maps[1] += tries.sum(2)
        self.n += len(bit)


class Model:
    """Prepared tables of all slots, the learned weights, and the maps."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, maps: np.ndarray):
        self.table, self.weights = table, np.ascontiguousarray(weights.T, np.float32)
        # the mean of the mixed probability and what the maps saw of bits with this gate and about this mix, as a line in the former
        self.slope = ((1 + 20 / (maps[1] + 20)) / 2).astype(np.float32).ravel()
        self.rise = (maps[0] / (maps[1] + 20) / 2).astype(np.float32).ravel()

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        table = self.table
        self.table = aligned(len(table), "u2")
        self.table[:] = table

    def look(self, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        codes = [self.table.take(s, mode="clip") for s in slots]
        x = [(c >> np.uint16(5)).view(np.int16).astype(np.float32) for c in codes]
        for v in x:
            v *= _STEP
            v -= 16
        return x, gate_of(*(c & np.uint16(31) for c in codes[2:]))

    def logs(self, p: np.ndarray, st: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log10 of the refined probability of each bit."""
        at = np.rint(st + 16).astype(np.int64)
        at += gate * BUCKETS
        fine = self.slope.take(at, mode="clip")
        fine *= p
        fine += self.rise.take(at, mode="clip")
        np.subtract(1 - bit, fine, out=fine)  # a one's chance with its sign turned, or a zero's
        np.log(np.abs(fine, out=fine), out=fine)  # the natural logarithm has a vector form
        fine *= np.float32(1 / math.log(10))
        return fine

    def frozen(self, slots: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
        """log10 probability of each bit, without adapting."""
        x, gate = self.look(slots)
        st, p = mixed([w.take(gate) for w in self.weights], x)
        return self.logs(p, st, gate, bit)

    def score(self, tree: Tree, texts: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
        """log10 probability of each text (leaves, hashes); its weights start as learned and adapt after every BLOCK tokens.

        All texts take a block at a time together: the longest come first, so that those that go on are the first ones.
        """
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i][0]))
        length = np.array([len(texts[i][0]) for i in order])
        leaf, hashes = (np.concatenate([texts[i][k] for i in order]) for k in (0, 1))
        text = np.repeat(np.arange(len(order)), length)
        place = np.arange(len(leaf)) - np.repeat(np.cumsum(length) - length, length)
        contexts = tree.contexts(leaf, hashes, place)
        by_block = np.argsort(place // BLOCK, kind="stable")
        # pieces of a block: the tokens of up to PIECE neighbouring texts
        piece = (place // BLOCK * len(order) + text // PIECE)[by_block]
        ends = np.append(np.flatnonzero(np.diff(piece)) + 1, len(piece))
        weights = [np.tile(w, len(order)) for w in self.weights]
        slope = np.full(len(order) * GATES, HOLD)
        out, first = np.zeros(len(order)), 0
        while first < len(ends):
            # pieces of about RUN tokens are expanded to bits at once
            begin = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begin + RUN)))
            some = by_block[begin : ends[last - 1]]
            token, slots, bit = tree.bits(leaf[some], contexts[:, some], size)
            x, gate = self.look(slots)
            of = text[some].take(token, mode="clip")
            row = of * GATES + gate
            cuts = np.searchsorted(token, ends[first:last] - begin).tolist()
            for a, b in zip([0, *cuts[:-1]], cuts):
                if a == b:  # a tree of one leaf has no bits
                    continue
                part, now, v = slice(a, b), row[a:b], [y[a:b] for y in x]
                st, p = mixed([w.take(now, mode="clip") for w in weights], v)
                low, high = int(of[a]), int(of[b - 1]) + 1
                out[low:high] += np.bincount(of[part] - low, self.logs(p, st, gate[part], bit[part]), high - low)
                error = bit[part] - p
                low, high = low * GATES, high * GATES
                now = now - low
                slope[low:high] += np.bincount(now, p * (1 - p) * sum(y * y for y in v), high - low)
                for w, y in zip(weights, v):
                    w[low:high] += (np.bincount(now, error * y, high - low) / slope[low:high]).astype(np.float32)
            first = last
        back = np.empty(len(order))
        back[order] = out
        return back


def _learned(rows: DataFrame, stream: Callable[[pa.Array], Iterator[Bits]], slots: int) -> Model:
    """The merged model of all rows of a column, which `stream` turns into runs of (slots, bit)."""
    named = lambda block, data: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["block", "data"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = None

        def handed() -> Iterator[pa.RecordBatch]:
            for i in range(0, slots, PART):
                block = learner.counts[i : i + PART]
                if block.any():  # by byte planes, as most counts are small
                    yield named(i // PART, squeezed(block.view(np.uint8).reshape(-1, 8).T))
            yield named(-1 - TaskContext.get().partitionId(), pickle.dumps((learner.weights, learner.slope, learner.maps)))

        for batch in batches:
            for part in stream(batch.column(0)):
                learner = learner or Learner(slots)
                learner.learn(*part)
                if learner.n >= 1 << 30:  # before a count could overflow
                    yield from handed()
                    learner.counts[:], learner.maps[:], learner.n = 0, 0, 0
        if learner:
            yield from handed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(*(c.to_pylist() for c in batch.columns)):
                if i < 0:
                    yield named(i, data)
                    continue
                counts = np.ascontiguousarray(spread(data, 8 * min(PART, slots - i * PART), "u1").reshape(8, -1).T).view("<u4").reshape(-1, 2)
                if i in held:
                    held[i] += counts
                else:
                    held[i] = counts.astype(np.uint64)
        for i, counts in held.items():
            # sums beyond 32 bits are halved together: what the mixer takes is their ratio
            counts >>= np.maximum(np.ceil(np.log2(counts.max(1) + 1.0)) - 32, 0).astype(np.uint64)[:, None]
            x, seen = prepared(counts[:, 0] | counts[:, 1] << np.uint64(32))
            yield named(i, squeezed(packed(x, seen).astype("<u2")))

    table = np.full(slots, packed(np.zeros(1), np.zeros(1, np.uint8))[0])
    slope, pull, maps = np.full(GATES, 20.0), np.full((GATES, CONTEXTS), 0.35 * 20), np.zeros((2, GATES, BUCKETS))
    parts = rows.mapInArrow(learn, "block int, data binary").repartition("block").mapInArrow(merge, "block int, data binary")
    for row in parts.toLocalIterator():  # bounded by the tables' size; the tasks' weights are a few KB each
        if row.block < 0:
            w, s, m = pickle.loads(row.data)
            slope, pull, maps = slope + s, pull + w * s[:, None], maps + m
        else:
            data = spread(row.data, min(PART, slots - row.block * PART), "<u2")
            table[row.block * PART :][: len(data)] = data
    return Model(table, pull / slope[:, None], maps)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts by profile, texts' ends among them, summed over runs of texts."""
    for batch in batches:
        names = batch.column(1).dictionary_encode()
        for i, name in enumerate(names.dictionary.to_pylist()):
            for texts in runs(batch.column(0).filter(pc.equal(names.indices, i)), COUNTED):
                counted = split(texts)[0].value_counts()
                words, c = pa.concat_arrays([counted.field(0), pa.array([END])]), pa.concat_arrays([counted.field(1), pa.array([len(texts)])])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), words, c], names=["profile", "word", "c"])


def frequent(counted: DataFrame, most: int = HOT_WORDS) -> DataFrame:
    """The rows (word, c) of the most frequent words: all with at least the count from which on they are `most` at most."""
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = {r.s: r.n for r in counted.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}  # at most 16 * 63 rows
    least, total = max(sizes, default=0) + 1, 0
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > most:
            break
        least = s
    return counted.where(step >= least)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", profile_col: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """One row (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score, bits_per_byte) for each row of docs.

    Tokens are the words and one end. Documents whose crc32 of the id as text is 1 modulo 5 are held out; the rest
    is learned from. base_score is the log10 probability under add-one-half unigram counts, score that under
    the model; both take the words that training lacks as one kind of token. spelled_score also has the probability of such words'
    bytes, and so is that of the very text; bits_per_byte comes from it. profile_col, if given, parts the training documents' word counts (null: the empty profile; of very many profiles several
    count together); it is not looked at in scoring. Null text has no words. Repeated rows count each; rows without an id are scored, not
    learned from, and not held out. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    profile = F.coalesce(F.col(f"`{profile_col}`").cast("string"), F.lit("")) if profile_col else F.lit("")
    profile = (F.crc32(profile) % PROFILES).cast("string")
    box = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), profile.alias("profile"))
    training = box.where(F.crc32(F.col("id").cast("string")) % 5 != 1).select("text", "profile")
    by_profile = training.mapInArrow(_counts, "profile string, word string, c long").repartition("word").groupBy("word", "profile").agg(F.sum("c").alias("c"))
    by_profile = staged(by_profile, "profiles")
    counted = staged(by_profile.groupBy("word").agg(F.sum("c").alias("c")), "words")
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    norm = total + 0.5 * (distinct + 1)

    words = counted.where(F.col("word") != END)
    hot = frequent(words, hot_words).orderBy(F.desc("c"), "word").collect()  # hot_words at most
    listed = F.broadcast(spark.createDataFrame([(r.word,) for r in hot], "word string"))
    place, names = {r.word: i for i, r in enumerate(hot)}, [r.profile for r in training.select("profile").distinct().orderBy("profile").collect()]
    shares = np.zeros((len(hot), max(len(names), 1)))
    for r in by_profile.join(listed, "word", "left_semi").toLocalIterator():
        shares[place[r.word], names.index(r.profile)] = r.c
    ends = counted.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    rest = words.join(listed, "word", "left_anti")
    n_rare, kinds = rest.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    once, twice = words.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    tree, size, spelled_size = Tree([r.word.encode() for r in hot], [r.c for r in hot], n_rare + sum(r.c == 1 for r in hot), ends, shares), table_bits(total), table_bits(8 * (distinct - 1))
    sent = spark.sparkContext.broadcast(tree)

    def read(batch: pa.Array) -> Iterator[Bits]:
        for texts in runs(batch, TEXTS):
            leaf, hashes, place = sent.value.tokens_of(*split(texts))
            contexts = sent.value.contexts(leaf, hashes, place)
            leaf, at = sent.value.with_escapes(leaf)
            contexts = contexts[:, at]
            for i in range(0, len(leaf), RUN):
                yield sent.value.bits(leaf[i : i + RUN], contexts[:, i : i + RUN], size)[1:]

    def spell(batch: pa.Array) -> Iterator[Bits]:
        for words in slices(batch, 1 << 13):
            yield spelling([w.encode() for w in words], spelled_size)[1:]

    model = spark.sparkContext.broadcast(_learned(training.select("text"), read, sum(tree.sizes(size))))
    speller = spark.sparkContext.broadcast(_learned(words.select("word"), spell, SPELLED[0] + 3 * (1 << spelled_size)))

    @F.arrow_udf("double")
    def spelled(words: pa.Array) -> pa.Array:
        out = np.zeros(len(words))
        at = np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False))
        for part in slices(words.drop_null(), 1 << 14):
            of, slots, bit = spelling([w.encode() for w in part], spelled_size)
            out[at[: len(part)]] = np.bincount(of, speller.value.frozen(slots, bit), len(part))
            at = at[len(part) :]
        return pa.array(out, pa.float64())

    # P(word | escape): a discounted count, or the discount's share by the word's spelling
    less = min(once / (once + 2 * twice), 0.95) if once else 0.5
    known = F.log10((F.col("c") - less) / max(n_rare, 1))
    new = math.log10(less * kinds / n_rare) if n_rare else 0.0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = TaskContext.get().partitionId() << 40, sent.value
        logs = np.log10(tree.counts + 0.5)
        for batch in batches:
            at = 0
            for texts in runs(batch.column(1), TEXTS):
                words, n = split(texts)
                leaf, hashes, _ = tree.tokens_of(words, n)
                ends = np.cumsum(n + 1)
                path = model.value.score(tree, list(zip(np.split(leaf, ends[:-1]), np.split(hashes, ends[:-1]))), size)
                there = leaf != tree.escape
                sums_of = lambda v, of: np.add.reduceat(np.where(there, v.take(leaf), 0), ends - n - 1).astype(of)
                lengths = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])
                cuts = np.cumsum(np.concatenate([np.zeros(1, np.int64), n]))
                # words behind an escape with their counts, as lists by text
                rare = np.flatnonzero(np.delete(~there, ends - 1))
                of = np.searchsorted(cuts, rare, side="right") - 1
                listed = words.take(pa.array(rare)).dictionary_encode()
                kinds, times = np.unique(of * max(len(listed.dictionary), 1) + listed.indices.to_numpy(zero_copy_only=False), return_counts=True)
                of, kind = np.divmod(kinds, max(len(listed.dictionary), 1))
                lists = pa.array(np.searchsorted(of, np.arange(len(n) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(n)),
                        pa.array(key + np.arange(len(n))),
                        pa.array(n + 1),
                        pa.array(lengths[cuts[1:]] - lengths[cuts[:-1]] + n + 1),
                        pa.array(sums_of(tree.counts > 0, np.int64)),
                        pa.array(sums_of(logs, float)),
                        pa.array(path),
                        pa.ListArray.from_arrays(lists, listed.dictionary.take(pa.array(kind))),
                        pa.ListArray.from_arrays(lists, pa.array(times, pa.int64())),
                    ],
                    names=["id", "key", "n_tokens", "size", "known", "base", "path", "words", "times"],
                )
                at += len(n)
                key += len(n)

    own = staged(box.select("id", "text").mapInArrow(sums, "id long, key long, n_tokens long, size long, known long, base double, path double, words array<string>, times array<long>"), "documents")
    rare = own.select("key", F.explode(F.arrays_zip("words", "times")).alias("w")).select("key", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    rare = rare.join(rest.hint("shuffle_hash"), "word", "left").withColumn("spelled", spelled(F.when(F.col("c").isNull(), F.col("word"))))
    chance = F.when(F.col("c").isNull(), F.lit(new)).otherwise(known)
    times = lambda c: F.sum(F.col("n") * c)
    rare = rare.groupBy("key").agg(F.sum(F.when(F.col("c").isNull(), 0).otherwise(F.col("n"))).alias("known_r"), times(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("base_r"), times(chance).alias("path_r"), times(F.when(F.col("c").isNull(), F.col("spelled")).otherwise(0.0)).alias("spelled_r"))
    both = own.drop("words", "times").join(rare, "key", "left").na.fill(0, ["known_r", "base_r", "path_r", "spelled_r"])
    score = F.col("path") + F.col("path_r")
    whole = score + F.col("spelled_r")
    return both.select(
        F.col("id").alias(id_col),
        F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("known_r")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("base_r") - F.col("n_tokens") * math.log10(norm)).alias("base_score"),
        score.alias("score"),
        whole.alias("spelled_score"),
        (-whole * math.log2(10) / F.col("size")).alias("bits_per_byte"),
    )
