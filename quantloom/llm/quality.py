"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at a few counts of the whole text and votes good, bad or abstains. Over all
documents the vote patterns are counted; from these counts alone, expectation-maximisation
estimates the share of good documents and, of each rule, how often it votes good or bad on good and
on bad ones where it votes. The posterior probability of good, given the pattern, is the verdict.

So no rule has to be passed: one that good documents trip now and then (unusual punctuation, a few
symbols) is outvoted by the others, while one that they never trip decides. Symbols have two rules, as
one vote alone could be outvoted by five that look at other defects.

A pattern is one of 3^rules, so counts, posteriors and what comes to the driver are bounded.

Defined cases: null text has no words; a text without words fails the base rules; a pattern that
no document shows has no posterior and is not needed; equal texts get equal verdicts; an empty
table gives none; other columns are not used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

_WORD = re.compile(WORD)
_MARK = re.compile(r"[.,;:!?](?![^\x20\x09-\x0D])")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BAD, ABSTAIN, GOOD = 0, 1, 2
#: Base rule: fewer words than this, or a larger share (per cent) of repeated words, fails.
MIN_WORDS, MAX_REPEAT = 10, 20


@dataclass(frozen=True)
class Counts:
    """What the rules look at."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int
    n_distinct: int
    n_upper: int
    n_marks: int


def count(text: str | None) -> Counts:
    text = text or ""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return Counts(
        n_words=len(words),
        word_chars=sum(map(len, words)),
        n_symbols=sum(map(text.count, SYMBOLS)),
        n_lines=len(lines),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated_words(words),
        n_distinct=len(set(words)),
        n_upper=sum(map(str.isupper, words)),
        n_marks=len(_MARK.findall(text)),
    )


def repeated_words(words: Sequence[str], window: int = WINDOW) -> int:
    """Words covered by windows that are found twice or more, the first included."""
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    found, covered, end = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if found[gram] > 1:
            covered += i + window - max(end, i)
            end = i + window
    return covered


def _vote(applies: bool, bad: bool, good: bool) -> int:
    return ABSTAIN if not applies else BAD if bad else GOOD if good else ABSTAIN


#: name -> vote. Thresholds are shares of the words or lines; a rule abstains where a text is too short
#: (or, for the vocabulary, too long) to tell, and between its two thresholds.
RULES: dict[str, Callable[[Counts], int]] = {
    "symbols": lambda c: _vote(c.n_words > 0, c.n_symbols > 0.05 * c.n_words, c.n_symbols == 0 and c.n_words >= 20),
    "markup": lambda c: _vote(c.n_words > 0, c.n_symbols > 0.2 * c.n_words, c.n_symbols <= 0.01 * c.n_words and c.n_words >= 20),
    "shouting": lambda c: _vote(c.n_words >= 5, c.n_upper > 0.3 * c.n_words, c.n_upper <= 0.02 * c.n_words and c.n_words >= 20),
    "repetition": lambda c: _vote(c.n_words >= 2 * WINDOW, c.n_repeat_words > 0.2 * c.n_words, c.n_repeat_words == 0),
    "lines": lambda c: _vote(c.n_lines >= 3, c.n_dup_lines > 0.35 * c.n_lines, c.n_dup_lines == 0),
    "punctuation": lambda c: _vote(c.n_words >= 20, not 0.1 * c.n_words <= c.n_marks <= 0.25 * c.n_words, 0.12 * c.n_words <= c.n_marks <= 0.2 * c.n_words),
    "vocabulary": lambda c: _vote(50 <= c.n_words <= 1000, c.n_distinct < 0.5 * c.n_words, c.n_distinct >= 0.7 * c.n_words),
    "word_length": lambda c: _vote(c.n_words >= 20, not 3 * c.n_words <= c.word_chars <= 6.5 * c.n_words, 4 * c.n_words <= c.word_chars <= 5.8 * c.n_words),
}

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def vote(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, and ``pattern``: a digit for each rule's vote."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("pattern", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), *(pa.array([getattr(c, k) for c in found], pa.int64()) for k in _COUNTS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(["".join(str(r(c)) for r in RULES.values()) for c in found], pa.string())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern string"
    )


@dataclass(frozen=True)
class LabelModel:
    """How often each rule is right where it votes; probability of good for each pattern; share of good documents."""

    accuracy: dict[str, float]
    posterior: dict[str, float]
    prior: float


#: What is assumed of a rule before any document is seen, as shares of bad and good votes on bad and on
#: good documents, and of the share of good ones; and how many votes, or documents, that counts as.
FIRST_VOTES, FIRST_GOOD, VOTE_WEIGHT, GOOD_WEIGHT = ((0.6, 0.4), (0.1, 0.9)), 0.8, 20.0, 10.0


def estimate(patterns: dict[str, int], rounds: int = 500) -> LabelModel:
    """Expectation-maximisation over pattern counts. An abstention is no evidence.

    Where it starts (a rule votes bad more often on bad documents) settles which class is the good one.
    """
    keys = sorted(patterns)
    if not keys:
        return LabelModel(dict.fromkeys(RULES, FIRST_VOTES[1][1]), {}, FIRST_GOOD)
    votes = np.array([[int(v) for v in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)[:, None]
    says = np.stack([votes == BAD, votes == GOOD], -1).astype(float)  # pattern, rule, vote
    first = np.array(FIRST_VOTES)[:, None, :]
    chance, prior, good = np.repeat(first, len(RULES), 1), FIRST_GOOD, None  # chance: class, rule, vote
    for _ in range(rounds):
        log = np.einsum("prv,crv->pc", says, np.log(chance)) + np.log([1 - prior, prior])
        both = np.exp(log - log.max(1, keepdims=True))
        both /= both.sum(1, keepdims=True)
        done = good is not None and np.abs(both[:, 1] - good).max() < 1e-9
        good, weight = both[:, 1], both * n
        counts = np.einsum("pc,prv->crv", weight, says) + VOTE_WEIGHT * first
        chance = counts / counts.sum(2, keepdims=True)
        prior = float((weight[:, 1].sum() + GOOD_WEIGHT * FIRST_GOOD) / (n.sum() + GOOD_WEIGHT))
        if done:
            break
    right, voted = counts[0, :, 0] + counts[1, :, 1], counts.sum((0, 2))
    return LabelModel(dict(zip(RULES, (right / voted).tolist())), dict(zip(keys, good.tolist())), prior)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, counts, base_failed, p_good and kept: one row a document."""
    votes = written(vote(docs, id_col, text_col), "votes")
    patterns = {r["pattern"]: r["n"] for r in votes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 3^rules rows
    model = estimate(patterns)
    table = docs.sparkSession.createDataFrame(sorted(model.posterior.items()), "pattern string, p_good double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return (
        votes.join(F.broadcast(table), "pattern", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
        .select("doc_id", *_COUNTS, "base_failed", "kept", "p_good")
    )
