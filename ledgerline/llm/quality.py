"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The rules' accuracies, on good documents and on
each kind of bad ones, and the shares of these are estimated by expectation-maximisation from the votes alone, and a document's posterior probability
of being good decides, instead of a demand that all rules pass. Documents with equal votes are equal to the
model, so Spark counts the vote patterns (at most 3 ** rules rows) and only these counts reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, slices, staged, unboxed

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct")


def text_counts(text: str) -> tuple[int, ...]:
    """The COUNTS of a text. Words are runs without ASCII white space."""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    repeated = lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            repeated += line in seen
            seen.add(line)
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n_repeat = 0
    if len(at) > 3:
        _, inverse, times = np.unique((at[:-2] << 42 | at[1:-1] << 21 | at[2:]) if len(ids) < 1 << 21 else _triples(at), return_inverse=True, return_counts=True)
        twice = times[inverse] > 1
        covered = np.zeros(len(at), bool)
        for i in range(3):
            covered[i : i + len(twice)] |= twice
        n_repeat = int(covered.sum())
    chars = len(text) - (len(raw) - sum(map(len, words)))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), repeated, n_repeat, lines, upper, len(ids)


def _triples(at: np.ndarray) -> np.ndarray:
    """Numbers of the three-word windows, for texts of over two million distinct words."""
    pair = np.unique(at[:-1] * (at.max() + 1) + at[1:], return_inverse=True)[1]
    return pair[:-1] * (at.max() + 1) + at[2:]


def counts(texts: Column) -> Column:
    """A struct of the COUNTS; null text has no words."""

    @F.arrow_udf(f"struct<{', '.join(f'{k}: long' for k in COUNTS)}>")
    def count(batch: pa.Array) -> pa.Array:
        rows = np.array([text_counts(t) for part in slices(batch) for t in part], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=list(COUNTS))

    return count(texts)


def votes() -> dict[str, Column]:
    """The rules over the columns COUNTS: 1 good, -1 bad, 0 abstains."""

    def rule(bad: str, good: str) -> Column:
        return F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END")

    return {
        "length": rule("n_words < 20", "n_words >= 50"),
        "symbols": rule("10 * n_symbols > n_words", "20 * n_symbols < n_words"),
        "symbol_share": rule("20 * n_symbols > word_chars", "100 * n_symbols < word_chars"),
        "lines": rule("2 * n_dup_lines > n_lines", "5 * n_dup_lines <= n_lines"),
        "repeats": rule("100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words < 20 * n_words"),
        "word_length": rule("word_chars > 20 * n_words OR 2 * word_chars < 5 * n_words", "word_chars BETWEEN 3 * n_words AND 8 * n_words"),
        "capitals": rule("2 * n_upper > word_chars", "5 * n_upper < word_chars"),
        "variety": rule("n_words >= 50 AND 10 * n_distinct < n_words", "n_words BETWEEN 1 AND 200 AND 3 * n_distinct > n_words"),
    }


def estimate(patterns: np.ndarray, weight: np.ndarray, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes, and log P(vote | class) by class, rule and vote (-1, 0, 1). Class 0 is good, class k junk of the kind that rule k - 1 finds.

    Rules depend on each other: a text of one repeated phrase fails several at once. So bad documents aren't one class
    but one kind for each rule, and votes are taken as independent within a kind only. A kind has a rate of bad votes
    for every rule, so a frequent kind of junk explains its own votes and doesn't pass for an error of the rules on
    good documents. (A kind that one rule alone finds can't be told from that rule's errors; the votes leave it good.)
    Votes are compared among documents on which a rule doesn't abstain; an abstention says nothing (0).

    Expectation-maximisation starts from documents without a bad vote as good; each bad vote lowers the odds
    twentyfold, and what is bad is shared among the kinds of its bad votes. Weak priors name the classes: rules are
    right more often than wrong on good documents, and on the kind that is theirs.
    """
    onehot = np.stack([patterns == v for v in (-1, 1)], axis=2).astype(float)
    bad = (patterns < 0).astype(float)
    n_bad, kinds = bad.sum(axis=1), 1 + patterns.shape[1]
    prior = np.ones((kinds, patterns.shape[1], 2))
    prior[0] = 1.0, 4.0
    prior[range(1, kinds), range(kinds - 1)] = 4.0, 1.0
    good = np.where(n_bad > 0, 1 / (1 + np.exp(3.0 * n_bad - 3.0)), 1.0)
    member = np.column_stack([good, (1 - good)[:, None] * bad / np.maximum(n_bad, 1)[:, None]])
    for _ in range(rounds):
        share = (weight @ member + 1) / (weight.sum() + kinds)
        votes_of = np.einsum("p,pk,prv->krv", weight, member, onehot) + prior
        rate = np.log(votes_of / votes_of.sum(axis=2, keepdims=True))
        logs = np.log(share) + np.einsum("krv,prv->pk", rate, onehot)
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        change, member = np.abs(new - member).max(), new
        if change < 1e-7:
            break
    return share, np.insert(rate, 1, 0.0, axis=2)


def judged(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with the COUNTS, base_failed, p_good and kept.

    base_failed: under 50 words, or over half of them in repeated three-word windows. p_good is the posterior of
    the votes; kept is false where base_failed, else whether p_good reaches the threshold. Null text has no words.
    Equal texts get equal verdicts. Columns of these names are replaced, all others pass through.
    """
    cols = docs.columns
    box = staged(boxed(docs, text=text_col).withColumn("c", counts(F.col("text"))).select("row", "c.*"), "counts")
    rules = votes()
    seen = box.select(*(v.alias(k) for k, v in rules.items())).groupBy(*rules).agg(F.count("*").alias("n")).orderBy(*rules).collect()  # at most 3 ** 8 rows
    p_good = F.lit(0.0)
    if seen:
        share, rate = estimate(np.array([[r[k] for k in rules] for r in seen]), np.array([r.n for r in seen], float))
        # the odds of each kind of junk against good; for a rule's vote they are an array of all kinds
        odds = F.array(*(F.lit(float(x)) for x in np.log(share[1:] / share[0])))
        for by_kind, rule in zip(np.moveaxis(rate[1:] - rate[0], 1, 0), rules.values()):
            of_vote = F.element_at(F.array(*(F.array(*(F.lit(float(x)) for x in by_vote)) for by_vote in by_kind.T)), rule + 2)
            odds = F.zip_with(odds, of_vote, lambda a, b: a + b)
        p_good = 1 / (1 + F.aggregate(odds, F.lit(0.0), lambda total, x: total + F.exp(x)))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    out = {k: F.col(k) for k in COUNTS}
    return unboxed(box, cols, **out, base_failed=failed, p_good=p_good, kept=~failed & (p_good >= threshold))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that judged() keeps, with their own columns."""
    box = boxed(docs, text=text_col)
    return unboxed(judged(box.select("row", "text")).where("kept"), docs.columns)
