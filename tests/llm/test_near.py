"""Near copies at a similarity of 0.8, held against every pair."""

import random

from quantloom.llm import near
from quantloom.llm.simhash import fingerprint


def _similarity(a, b):
    x, y = set(near.shingles(a).tolist()), set(near.shingles(b).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def _brute(rows):
    """The smallest id of each group, by every pair."""
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if _similarity(a, b) >= 0.8:
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {top(i) for i in parent}


def test_near_copies_beyond_two_bits_go(spark):
    draw = random.Random(5)
    base = [[f"w{draw.randrange(4000)}" for _ in range(120)] for _ in range(30)]
    rows = []
    for words in base:
        for edits in (0, 1, 2, 3, 9):
            copy = list(words)
            for _ in range(edits):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    got = {r[0] for r in near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute(rows)
    texts = [t for _, t in rows]
    far = [(a, b) for k, a in enumerate(texts) for b in texts[:k] if _similarity(a, b) >= 0.8 and (fingerprint(a, 5) ^ fingerprint(b, 5)).bit_count() > 2]
    assert len(far) > 20  # what two bits of a SimHash cannot link


def test_one_large_group_of_near_copies(spark):
    draw = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        copy = list(base)
        copy[draw.randrange(10, 140)] = f"x{i}"
        copy[draw.randrange(10, 140)] = f"y{i}"
        rows.append((i, " ".join(copy)))
    got = {r[0] for r in near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_documents_against_every_pair(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert {r[0] for r in near.keep_one(docs).collect()} == _brute([tuple(r) for r in docs.collect()])


def test_rows_without_id_and_with_repeated_ids(spark):
    rows = [(None, "a text of its own without any id at all"), (1, "same words in this one text"), (1, "same words in this one text"), (None, "same words in this one text"), (2, "one more text that is alone here"), (2, "other text under a repeated id here")]
    got = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [rows[0], rows[1], rows[4], rows[5]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def _template(members, own):
    """Texts of one passage with words of their own, too far from each other; every fortieth has a near copy."""
    draw, rows = random.Random(9), []
    base = [f"w{i}" for i in range(150)]
    for i in range(members):
        words = base + [f"x{i}_{k}" for k in range(own)]
        rows.append((len(rows), " ".join(words)))
        if i % 40 == 0:
            words[draw.randrange(150, 150 + own)] = f"y{i}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_few_links_within_a_full_group(spark, monkeypatch):
    """All pairs of a full group count, and few are written out."""
    rows, written_out, similar = _template(300, 24), [], near._similar

    def counted(pairs, *rest):
        written_out.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(near, "_similar", counted)
    got = {r[0] for r in near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0.7 < _similarity(rows[2][1], rows[3][1]) < 0.8 < _similarity(rows[0][1], rows[1][1])
    assert got == {i for i, text in rows if " y" not in text}
    assert sum(written_out) < 20 * len(rows)


def test_texts_are_shuffled_once(spark):
    """However many joins look texts up, and with none of them broadcast; the few that are compared move to each other."""
    draw, rows = random.Random(11), []
    for i in range(120):
        words = [f"{draw.getrandbits(64):x}" for _ in range(1000)]
        rows.append((i, " ".join(words)))
        if i < 5:
            words[draw.randrange(1000)] = f"y{i}"
            rows.append((1000 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    moved = lambda: sum(e.totalShuffleWrite() for e in map(store.executorList(False).apply, range(store.executorList(False).size())))
    store, before = spark.sparkContext._jsc.sc().statusStore(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = moved()
        got = {r[0] for r in near.keep_one(docs).collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert got == set(range(120))
        assert moved() - began < 1.6 * sum(len(t) for _, t in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
