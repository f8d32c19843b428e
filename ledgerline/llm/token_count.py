"""Token counts by byte-pair merging on a heap and a linked list: no identifier is emitted.

A text is cut into words as in bpe.py. Of each word only the number of tokens is wanted: its bytes form a linked
list, a heap holds every adjacent pair that some merge fits, and the pair of the lowest rank, the leftmost of
equals, is popped and merged until none is left. The count is the initial symbols minus the merges, so the
final symbols are never gathered. A worker remembers the counts of words and of what stands between blanks.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BLANK_BEFORE_WHITE, Bpe, Recent, ship, split_words
from .common import boxed, slices, unboxed

#: Longest piece whose count is remembered, in characters; longer ones are counted each time. Bounds the memory's bytes, not the results.
REMEMBERED = 128
#: Entries of each of the two generations that a worker remembers.
KNOWN = 400_000
#: A heap entry holds rank, merged symbol and, in its low 32 bits, the place of the pair in the word.
SYMBOL_BITS = 24
SYMBOL, PLACE = (1 << SYMBOL_BITS) - 1, (1 << 32) - 1


class Counter:
    """Counts the tokens of texts under a tokenizer file of the `tokenizers` library with a byte-level BPE model."""

    def __init__(self, spec: str):
        bpe = Bpe(spec)
        self.special = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.id_of_byte = bpe.id_of_byte.tolist()
        # pair of symbols -> rank (from 1 on) and merged symbol
        value = (bpe.ranks + 1) << SYMBOL_BITS | bpe.merged[bpe.ranks]
        self.merge_of = dict(zip(bpe.keys.tolist(), value.tolist())).get
        self.words, self.pieces = Recent(KNOWN), Recent(KNOWN)

    def count_word(self, word: bytes) -> int:
        """Tokens of one word: symbols at first minus merges."""
        merge_of, left = self.merge_of, len(word)
        sym = [*map(self.id_of_byte.__getitem__, word)]
        pair = [merge_of(a << 32 | b, 0) for a, b in zip(sym, sym[1:])]
        pair.append(0)
        heap = [v << 32 | i for i, v in enumerate(pair) if v]
        if not heap:
            return left
        heapify(heap)
        end = left
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while heap:
            top = heappop(heap)
            i, v = top & PLACE, top >> 32
            if pair[i] != v:  # stale: a symbol of it has gone into another merge
                continue
            j = after[i]
            k = after[i] = after[j]
            a = sym[i] = v & SYMBOL
            pair[i] = pair[j] = 0
            left -= 1
            if k < end:
                before[k] = i
                if v := merge_of(a << 32 | sym[k], 0):
                    pair[i] = v
                    heappush(heap, v << 32 | i)
            h = before[i]
            if h >= 0:
                pair[h] = v = merge_of(sym[h] << 32 | a, 0)
                if v:
                    heappush(heap, v << 32 | h)
        return left

    def _words(self, words: list[str]) -> list[int]:
        """Tokens of each word."""
        counts = list(map(self.words.young.get, words))
        fresh: dict[str, int] = {}
        for i, n in enumerate(counts):
            if n is None:
                w = words[i]
                n = counts[i] = fresh.get(w) or self.words.old.get(w) or self.count_word(w.encode())
                if len(w) <= REMEMBERED:
                    fresh[w] = n
        self.words.add(fresh)
        return counts

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. A special token's string in it is one token, as by default in the library.

        A blank before a character that isn't white space always starts a word, so texts are cut at blanks, and
        the pieces not remembered are cut into words together; texts with other blanks are cut one by one.
        """
        totals, cut = [], []
        for text in texts:
            plain, special = self._plain(text) if any(t in text for t in self.special) else ([text], 0)
            for part in plain:
                if BLANK_BEFORE_WHITE.search(part) is not None:
                    special += sum(self._words(split_words(part)))
                else:
                    head, *pieces = part.split(" ")
                    special += sum(self._words(split_words(head)))
                    cut.append((len(totals), pieces))
            totals.append(special)
        found = [(i, pieces, list(map(self.pieces.young.get, pieces))) for i, pieces in cut]
        unknown, known = self.pieces.recall({p for _, pieces, counts in found if None in counts for p, n in zip(pieces, counts) if n is None})
        fresh: dict[str, int] = {}
        if unknown:
            words = split_words(" " + " ".join(unknown))
            counts = np.array(self._words(words), np.int64)
            # only a piece's first word starts with a blank
            first = np.fromiter((i for i, w in enumerate(words) if w[0] == " "), np.int64, len(unknown))
            fresh = dict(zip(unknown, np.add.reduceat(counts, first).tolist()))
        self.pieces.add({p: n for p, n in fresh.items() if len(p) <= REMEMBERED})
        known |= fresh
        for i, pieces, counts in found:
            totals[i] += sum(n or known[p] for p, n in zip(pieces, counts)) if None in counts else sum(counts)
        return totals

    def _plain(self, text: str) -> tuple[list[str], int]:
        """What stands between special tokens, and the number of these."""
        parts, n = [text], 0
        while found := min(((i, -len(t), t) for t in self.special if (i := parts[-1].find(t)) >= 0), default=None):
            i, _, token = found
            rest = parts.pop()
            parts += [rest[:i], rest[i + len(token) :]]
            n += 1
        return parts, n


@lru_cache(2)
def _load(name: str) -> Counter:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return Counter(f.read())


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens (long) and over_limit (n_tokens > limit).

    Null and empty text has 0 bytes and 0 tokens. Repeated rows are counted each; ids, null or not, are only
    carried. Whole texts are counted, a word of any length on one heap. Columns of the three names are replaced,
    all others pass through. No rows give no rows. Nothing is shuffled: a lost executor's splits are counted again.
    """
    name = ship(docs.sparkSession, tokenizer)

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        counter = _load(name)
        return pa.array(np.fromiter((n for part in slices(texts) for n in counter.count(part)), np.int64, len(texts)))

    box = boxed(docs, text=text_col).withColumn("n", counted("text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return unboxed(box, docs.columns, n_bytes=n_bytes, n_tokens=F.col("n"), over_limit=F.col("n") > limit)
