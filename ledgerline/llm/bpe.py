"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A batch of texts is cut into words by character classes; each distinct word is encoded once for the batch. The symbols of
all new words lie in one flat array. A round looks up every adjacent pair by binary search over the sorted
pair keys, merges in each word the pairs of its lowest rank from left to right, and closes the gaps; words
without a pair are done.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, slices, unboxed

#: Entries of each of the two generations that a worker keeps encoded.
KNOWN = 300_000
BLANK_BEFORE_WHITE = re.compile(r" (?=\s|\Z)")
LETTER, NUMBER, SPACE, OTHER = range(4)
#: The pattern of byte-level BPE's words, and the contractions that it splits off.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Longest run that goes to the compiled encoder, whose time grows with its square.
LONG_RUN = 10_000
NONE = np.iinfo(np.int64).max


@lru_cache(1)
def _classes() -> np.ndarray:
    """Of each code point: letter, number, white space or other, as the regular expression's \\p{L}, \\p{N} and \\s have them."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
        elif kind == "Z":
            out[c] = SPACE
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return out


def split_words(text: str) -> list[str]:
    """The pre-tokens of a text: contractions, runs of letters, numbers or other signs with at most one blank before, white space."""
    if not text:
        return []
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kind = _classes()[code]
    n = len(code)
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    # a run of white space before a word gives its last character away: to the word, if it is a blank
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:])
    start[last] = True
    start[last[code[last] == 32] + 1] = False
    for i in np.flatnonzero((code == 39) & start).tolist():
        for c in CONTRACTIONS:
            if text.startswith(c, i):
                start[i + 1 : i + len(c)] = False
                if i + len(c) < n:
                    if not (space[i + len(c)]):
                        start[i + len(c)] = True
                break
    at = np.flatnonzero(start).tolist()
    return [text[a:b] for a, b in zip(at, at[1:] + [n])]


class Recent:
    """What was encoded lately, in two generations: the older goes when the younger is full, except for what was asked for again."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def recall(self, keys: set[str]) -> tuple[list[str], dict[str, bytes]]:
        """The unknown keys, and the values of the others."""
        known = {k: v for k in keys if (v := self.young.get(k) or self.old.get(k))}
        self.young.update(known)
        return [k for k in keys if k not in known], known

    def add(self, items: dict[str, bytes]) -> None:
        if len(self.young) + len(items) > self.size:
            self.old, self.young = self.young, {}
        self.young.update(items)


class Bpe:
    """The tables of a tokenizer file of the `tokenizers` library with a byte-level BPE model."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        byte_of = {c: b for b, c in enumerate(_byte_chars())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.id_of_byte = np.array([vocab[c] for c in _byte_chars()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.compiled: tiktoken.Encoding | None = None
        self.chunks, self.words = Recent(KNOWN), Recent(KNOWN // 2)

    def _rank(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The merge rank of the pair that starts at each place `at`; NONE where no merge fits or a word ends."""
        key = np.where(word[at] == word[at + 1], sym[at] << 32 | sym[at + 1], -1)
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.ranks[found], NONE)

    def _merge(self, words: list[str]) -> dict[str, bytes]:
        """Encodes the words together."""
        if not words:
            return {}
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.id_of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        rank = np.append(self._rank(sym, word, np.arange(len(sym) - 1)), NONE)
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
            over = least == NONE
            done_sym.append(sym[over])
            done_word.append(word[over])
            # of pairs that overlap, as in aaa, every other one from the left
            run = np.flatnonzero((rank == least) & ~over)
            if len(run):
                head = np.flatnonzero(np.r_[True, run[1:] != run[:-1] + 1])
                place = np.arange(len(run)) - np.repeat(head, np.diff(np.r_[head, len(run)]))
                run = run[place % 2 == 0]
            sym[run] = self.merged[rank[run]]
            keep = ~over
            keep[run + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            # only pairs with a new symbol have another rank now
            run = moved[run]
            at = np.concatenate([run, run[run > 0] - 1])
            rank[at] = NONE
            at = at[at < len(sym) - 1]
            rank[at] = self._rank(sym, word, at)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        flat, ends = sym[order].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(word, minlength=len(raw)))).tolist()
        return {w: flat[a:b] for w, a, b in zip(words, [0, *ends], ends)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text: its ids as little-endian unsigned 32-bit integers.

        A blank before a character that isn't white space always starts a word, so a text is first cut at
        blanks, and what stands after one is kept whole. Other texts are cut into words one by one.
        """
        cut = [t.split(" ") if not self._odd(t) else [t] for t in texts]
        heads = [self._cut(c.pop(0)) for c in cut]
        found = [list(map(self.chunks.young.get, c)) for c in cut]
        lacks = [None in f for f in found]
        chunks, fill = self.chunks.recall({x for c, f, lack in zip(cut, found, lacks) if lack for x, y in zip(c, f) if y is None})
        words = split_words(" " + " ".join(chunks)) if chunks else []
        fresh, ids = self.words.recall({*words} | {w for h in heads for p in h if isinstance(p, list) for w in p})
        learned = self._merge(fresh)
        ids |= learned
        self.words.add(learned)
        get = ids.__getitem__
        first = [i for i, w in enumerate(words) if w[0] == " "]  # only a chunk's first word starts with a blank
        learned = {c: b"".join(map(get, words[a:b])) for c, a, b in zip(chunks, first, [*first[1:], len(words)])}
        fill |= learned
        self.chunks.add(learned)
        found = [[y or fill[x] for x, y in zip(c, f)] if lack else f for c, f, lack in zip(cut, found, lacks)]
        return [b"".join([*(b"".join(map(get, p)) if isinstance(p, list) else p for p in h), *f]) for h, f in zip(heads, found)]

    def _odd(self, text: str) -> bool:
        return BLANK_BEFORE_WHITE.search(text) is not None or any(t in text for t in self.special)

    def _cut(self, text: str) -> list[list[str] | bytes]:
        """The words between special tokens, and the ids of those."""
        out: list = []
        while found := min(((i, t) for t in self.special if (i := text.find(t)) >= 0), default=None):
            i, token = found
            out += [split_words(text[:i]), self.special[token].to_bytes(4, "little")]
            text = text[i + len(token) :]
        return [*out, split_words(text)]

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        """As encode(), by the compiled tiktoken encoder with this file's tables; texts with a run of LONG_RUN characters without a blank by encode()."""
        if self.compiled is None:
            ranks = {x: i for i, x in enumerate(self.bytes_of) if i not in self.special.values()}
            self.compiled = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        return [self.encode([t])[0] if max(map(len, t.split(" "))) > LONG_RUN else self.compiled.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes() for t in texts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


def _byte_chars() -> str:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + i) for i in range(256))
    return "".join(chr(b) if b in own else next(rest) for b in range(256))


@lru_cache(2)
def _load(name: str) -> Bpe:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return Bpe(f.read())


def ship(spark: SparkSession, path: str) -> str:
    """Sends the tokenizer file to all executors; returns the name by which tasks open it."""
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encoder(spark: SparkSession, tokenizer: str):
    """A column function text -> ids (binary, little-endian unsigned 32-bit); null is encoded as empty text."""
    name = ship(spark, tokenizer)

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        bpe = _load(name)
        return pa.array([ids for part in slices(texts) for ids in bpe.encode(part)], pa.binary())

    return encode


def encode_decode(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """docs with ids (array of int), n_tokens, and decoded (the text that the ids give back).

    Null and empty text has no ids. Special tokens' strings in a text become their ids, as by default in the
    library whose file `tokenizer` is. Columns of these names are replaced, all others pass through.
    """
    name = ship(docs.sparkSession, tokenizer)

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(texts: pa.Array) -> pa.Array:
        bpe = _load(name)
        ids, back = [], []
        for part in slices(texts):
            for x in bpe.encode(part):
                ids.append(np.frombuffer(x, "<i4"))
                back.append(bpe.decode(x))
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], names=["ids", "decoded"])

    box = boxed(docs, text=text_col).withColumn("out", both("text"))
    return unboxed(box, docs.columns, ids=F.col("out.ids"), n_tokens=F.size("out.ids").cast("long"), decoded=F.col("out.decoded"))


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encode_decode() with ids and text digested where they are made."""
    name = ship(docs.sparkSession, tokenizer)

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digest(texts: pa.Array) -> pa.Array:
        bpe = _load(name)
        rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(bpe.decode(x).encode()).hexdigest()) for part in slices(texts) for x in bpe.encode(part)]
        n, ids, back = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(f"`{id_col}`").alias(id_col), digest(F.col(f"`{text_col}`")).alias("d")).select(id_col, "d.*")
