"""Piece ids: the model's own encoder for merge ranks, brute force for log probabilities, exact decoding."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import pieces
from quantloom.llm import queries as Q

LETTERS = "▁theanois😀é\r;ɸ"


@pytest.fixture(scope="module")
def table():
    if not os.path.exists(Q.PIECES):
        pytest.skip("no piece table")
    return pieces.Pieces.load(Q.PIECES)


@pytest.fixture(scope="module")
def toy():
    """Pieces with log probabilities; ties and characters without a piece occur."""
    rows = [("▁", -1.5), ("t", -2.0), ("h", -2.5), ("e", -2.25), ("th", -3.0), ("he", -3.0), ("the", -4.5), ("▁the", -5.0), ("a", -2.0), ("an", -2.5), ("n", -2.0), ("aa", -4.0), ("aaa", -5.5)]
    return pieces.Pieces([(p, 300 + i, s) for i, (p, s) in enumerate(rows)], list(range(256)), [*range(256), *[None] * 44, *[p for p, _ in rows]])


def _best(unit, table):
    score = {p: (s, i) for p, i, s in table.rows}
    best = [(0.0, [])] + [None] * len(unit)
    for end in range(1, len(unit) + 1):
        options = []
        for start in range(max(0, end - table.longest), end):
            if unit[start:end] in score:
                s, i = score[unit[start:end]]
                options.append((best[start][0] + s, start, best[start][1] + [i]))
        if unit[end - 1] not in score:
            options.append((best[end - 1][0] + table.unknown_score, end - 1, best[end - 1][1] + [table.bytes_[b] for b in unit[end - 1].encode()]))
        s, _, ids = max(options, key=lambda o: (o[0], o[1]))
        best[end] = (s, ids)
    return best[-1][1]


def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=Q.PIECES)


def _segmented(spark, units, table):
    return {r["unit"]: r["ids"] for r in pieces.segment(spark.createDataFrame([(u,) for u in units], "unit string"), table).collect()}


def test_viterbi_is_best(spark, toy):
    rng = random.Random(6)
    units = {"".join(rng.choices("▁theanx", k=rng.randint(1, 14))) for _ in range(200)} | {"▁the", "▁", "x", "a" * 59, "a" * 60, "the" * 19 + "x"}
    long = ["a" * 61, "the" * 100 + "x", "x" * 90]
    assert [pieces.finder(toy)(u) for u in long] == [_best(u, toy) for u in long]
    assert not toy.merges and _segmented(spark, units, toy) == {u: _best(u, toy) for u in units}


def test_merges_are_the_models(spark, table):
    rng, model = random.Random(7), _library()
    texts = ["".join(rng.choices(" theanois😀é;ɸ", k=rng.randint(1, 40))) for _ in range(300)] + ["a" * 500, " " * 100 + "x", "the" * 60, "ab" * 31]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert table.merges
    for r in pieces.encode(docs, table).collect():
        assert r["ids"] == model.encode(r["text"]), r["text"]


def test_fold_and_helper_agree(spark, table, toy):
    rng = random.Random(8)
    units = {"".join(rng.choices(LETTERS, k=rng.randint(1, 60))) for _ in range(100)}
    for t in (table, toy):
        find = pieces.finder(t)
        assert _segmented(spark, units, t) == {u: find(u) for u in units}


def test_units_are_cut_where_no_piece_reaches(table):
    model = _library()
    for word in ("▁foo12,bar", "▁http://a.b/c_d", "x" * 70):
        units, counts = table.units([word, "▁a", word])
        assert "".join(units) == word + "▁a" + word and list(counts[[0, 2]]) == [(len(units) - counts[1]) // 2] * 2
        units = units[: counts[0]]
        for a, b in zip(units, units[1:]):
            assert not any(a[-1] + b[0] in p for p, _, _ in table.rows)
    assert model.get_piece_size() > len(table.rows)


@pytest.mark.parametrize("bucket", [16 << 20, 2000])
def test_round_trip(spark, odd_docs, table, bucket):
    docs = odd_docs.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    done = pieces.decode(pieces.encode(docs, table, bucket=bucket), table)
    assert done.columns == [*docs.columns, "ids", "decoded"]
    rows, model = done.collect(), _library()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["decoded"] == (None if r["text"] is None else r["text"].replace("▁", " "))
        assert r["ids"] == (None if r["text"] is None else model.encode(r["text"]))


def test_words_of_a_bucket_are_cut_and_looked_up_once(table):
    slices = [["the cat sat", "the  dog sat", None, ""], [], [None], ["the cat", "é😀 sat\nthe dog", "a▁the cat ", "x" * 70, "the cat sat"]]
    texts, find, asked, looked = [pa.array(s, pa.string()) for s in slices], pieces.finder(table), [], []

    def cut(words):
        asked.extend(words.to_pylist())
        return table.cut(words)

    class Known(pieces._Known):
        def of(self, units):
            looked.append(len(units))
            return super().of(units)

    units = sorted({u for s in slices for t in s if t for u in table.units(pieces.words_of(t))[0] if len(u) <= pieces.FOLDED})
    encoder = pieces._Encoder(texts, Known(pa.array(units), pa.array([find(u) for u in units], pa.list_(pa.int16())), find), cut)
    assert len(asked) == len(set(asked)) and len(looked) == 1
    model = _library()
    for k, s in enumerate(slices):
        for at in range(len(s)):
            assert encoder.ids(k, at, texts[k][at : at + 2]).to_pylist() == [None if t is None else model.encode(t) for t in s[at : at + 2]]


def test_empty_table(spark, odd_docs, table):
    assert pieces.encode(odd_docs.limit(0), table).count() == 0
