"""Language identification in two steps: the family first, then the language within it.

Features are hashed counts of letter bigrams and trigrams of the lower-cased whole text, one space
for every run of other characters, square-rooted and scaled to length 1. Languages whose mean
features are alike form a family. One linear support vector machine per family (against the rest)
chooses it; within it, one for each pair of languages votes.

The machines are fitted on a bounded sample (``per_language`` texts of each language, those with the
lowest hashes of all labelled texts handed to ``fit``); every row is predicted.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows with null labels
teach nothing; one language only is always predicted; no labelled row at all gives ``und`` for
every row; equal texts get equal predictions; an empty table gives none; the columns of ``docs``
pass through, but for those named like the new ones (in any case of letters), which are replaced. Letters are characters for which ``str.isalpha`` holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, without

UND = "und"
#: Hashed features.
BINS = 1 << 13
#: Training rows of each language, and of all languages together.
PER_LANGUAGE, MOST_ROWS, LEAST_ROWS = 500, 4000, 8

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:  # built once a worker from the rule
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str | None) -> np.ndarray | None:
    """The scaled feature vector of a whole text; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters
    points = np.concatenate(([np.uint32(32)], points[keep], [np.uint32(32)]))
    two = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + points[2:] * np.uint32(0x27D4EB2F)
    counts = np.bincount(two >> np.uint32(19), minlength=BINS) + np.bincount(three >> np.uint32(19), minlength=BINS)
    v = np.sqrt(counts.astype(np.float32))
    return v / np.linalg.norm(v)


def _svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 80) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss; y in -1, 1; classes weigh the same."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * len(y)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    look, look_b, step = w.copy(), b, 1.0 / (1.0 + 4.0 * c)
    for k in range(rounds):  # accelerated gradient steps; rows have length 1, so the step is safe
        slack = np.maximum(0.0, 1.0 - y * (x @ look + look_b)) * share
        pull = -2.0 * c * (slack * y) / len(y)
        new_w = look - step * (look + x.T @ pull)
        new_b = look_b - step * float(pull.sum())
        look, look_b = new_w + k / (k + 3) * (new_w - w), new_b + k / (k + 3) * (new_b - b)
        w, b = new_w, new_b
    return np.append(w, np.float32(b))


def group_families(centres: np.ndarray) -> list[list[int]]:
    """Languages joined into about as many families as the root of their number, the most alike first."""
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    alike = unit @ unit.T
    groups = [[i] for i in range(len(centres))]
    while len(groups) > np.ceil(np.sqrt(len(centres))):
        i, j = max(combinations(range(len(groups)), 2), key=lambda p: alike[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


@dataclass(frozen=True)
class Model:
    """Languages, their families, and the machines: one a family, one a pair within a family."""

    languages: list[str]
    families: list[list[int]]
    family_machines: np.ndarray
    pair_machines: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    #: Log of each feature's frequency against chance, a language a row; what a text must reach on it.
    profiles: np.ndarray | None = None
    least: np.ndarray | None = None

    def predict(self, text: str | None) -> tuple[str, float]:
        return self._place(features(text))

    def knows(self, text: str | None, min_score: float) -> bool:
        """Whether the predicted language has the score, and the text's letter groups are those of that language."""
        x = features(text)
        lang, score = self._place(x)
        if lang == UND or score < min_score:
            return False
        i = self.languages.index(lang)
        chance = 2.0 / np.sqrt(np.count_nonzero(x))  # a short text may be of rare words
        return self.profiles is None or float((x * x) @ self.profiles[i]) >= self.least[i] - chance

    def _place(self, x: np.ndarray | None) -> tuple[str, float]:
        if x is None or not self.languages:
            return UND, 0.0
        family, margin = self.families[0], 1.0
        if len(self.families) > 1:
            margins = self.family_machines[:, :-1] @ x + self.family_machines[:, -1]
            family, margin = self.families[int(margins.argmax())], float(margins.max())
        best = family[0]
        if len(family) > 1:
            votes, won = dict.fromkeys(family, 0), dict.fromkeys(family, 0.0)
            for i, j in combinations(family, 2):
                m = self.pair_machines[i, j]
                d = float(m[:-1] @ x + m[-1])
                votes[i if d > 0 else j] += 1
                won[i] += d
                won[j] -= d
            best = max(family, key=lambda i: (votes[i], won[i], -i))
            margin = min(margin, won[best] / (len(family) - 1))
        return self.languages[best], float(1.0 / (1.0 + np.exp(-2.0 * margin)))


def _profile(squares: np.ndarray) -> np.ndarray:
    mass = squares.sum(0) + 0.1 * len(squares) / BINS  # a feature that was never seen counts as a tenth of chance
    return np.log(mass / mass.sum() * BINS)


def evidence(x: np.ndarray, share: float = 0.3, tail: float = 0.01, enough: int = 8) -> tuple[np.ndarray, float]:
    """A language's profile, and the mean log frequency (0: chance) that a text of it reaches.

    Rows are held out in turn: half of them make a profile, the others are measured on it. A text
    must reach ``share`` of their median, or less if more than ``tail`` of them do not reach that.
    """
    squares, even = x * x, np.arange(len(x)) % 2 == 0
    if len(x) < enough:
        return _profile(squares), -np.inf
    held = np.concatenate([squares[~even] @ _profile(squares[even]), squares[even] @ _profile(squares[~even])])
    return _profile(squares), float(min(share * np.median(held), np.quantile(held, tail)))


def train(rows: list[tuple[str, np.ndarray]]) -> Model:
    """A model of labelled feature vectors."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], [], np.zeros((0, BINS + 1), np.float32))
    x = np.stack([r[1] for r in rows])
    of = np.array([languages.index(r[0]) for r in rows])
    families = group_families(np.stack([x[of == i].mean(0) for i in range(len(languages))]))
    machines = [_svm(x, np.where(np.isin(of, f), 1.0, -1.0).astype(np.float32)) for f in families] if len(families) > 1 else []
    pairs = {}
    for f in families:
        for i, j in combinations(f, 2):
            at = (of == i) | (of == j)
            pairs[i, j] = _svm(x[at], np.where(of[at] == i, 1.0, -1.0).astype(np.float32))
    profiles, least = zip(*(evidence(x[of == i]) for i in range(len(languages))))
    return Model(languages, families, np.stack(machines) if machines else np.zeros((1, BINS + 1), np.float32), pairs, np.stack(profiles).astype(np.float32), np.array(least))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model:
    """Fit on a sample of ``labelled``: up to ``per_language`` texts a language, about ``most_rows`` in all.

    Every language is learned, from ``LEAST_ROWS`` texts at least if it has as many. Equal texts of a
    language are one; of its texts those with the lowest hashes are in. Only sparse features of those
    come to the driver.
    """
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit("langid"), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    texts = known.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = texts.count()
    if not languages:
        return train([])
    each = min(per_language, max(LEAST_ROWS, most_rows // languages))
    # what may be among the lowest, with room to spare, so that few hashes are put in order
    luck = F.shiftrightunsigned("h", 12) / F.lit(float(2**52))
    # a row a language; while there are no more of them than rows to train on, they go to every task, else both sides meet by language
    near = known.join(F.broadcast(texts) if languages <= most_rows else texts, "lang").filter(luck * F.col("n") < max(4 * each, 256)).groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= each).select("lang", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = {"lang": [], "at": [], "value": []}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (x := features(text)) is not None:
                    at = np.flatnonzero(x)
                    out["lang"].append(lang)
                    out["at"].append(at.astype("<u2").tobytes())
                    out["value"].append(x[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("at", pa.binary()), ("value", pa.binary())]))

    rows = []
    for r in sorted(sample.mapInArrow(sparse, "lang string, at binary, value binary").collect()):
        x = np.zeros(BINS, np.float32)
        x[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f4")
        rows.append((r["lang"], x))
    return train(rows)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` plus the predicted language of its whole texts and a score from 0 to 1."""
    schema = T.StructType([docs.schema[c] for c in without(docs.columns, lang_out, score_out)] + [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    kept = [f.name for f in schema][:-2]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.predict(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*kept, lang_out, score_out])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(True))


def keep_known(docs: DataFrame, labelled: DataFrame, min_score: float = 0.1) -> DataFrame:
    """``docs`` without those in no known language: ``und``, a score under ``min_score``, or letter groups too rare in the language predicted.

    A language of fewer than 8 learned rows has no limit on letter groups.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([shared.value.knows(t, min_score) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
