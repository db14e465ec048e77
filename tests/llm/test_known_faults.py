"""Cases that earlier versions got wrong."""

import time

import pytest

from quantloom.llm import langid, licenses, quality


def test_a_language_of_few_distinct_texts_is_learned(spark):
    english = [(i, f"the thing that was there is number word {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} and {'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000]} again", "en") for i in range(2000)]
    german = [(10_000 + i, ("und der Mann ist nicht zu Haus", "die Frau geht über die Straße", "das Kind schläft noch nicht", "wir haben keine Zeit für euch")[i % 4], "de") for i in range(5000)]
    df = spark.createDataFrame(english + german, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == ["de", "en"]
    found = langid.identify(df.filter("doc_id % 500 = 0 or doc_id >= 14990"), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found)


def test_texts_with_the_lowest_hashes_teach(spark):
    df = spark.createDataFrame([(f"text {'abcdefghijklmnop'[i % 16]}{'abcdefghijklmnop'[i // 16]}", "xy"[i % 2]) for i in range(256)] * 3, "text string, lang string")
    assert langid.fit(df, per_language=20).languages == ["x", "y"] and langid.fit(df, most_rows=2).languages == ["x", "y"]
    assert langid.fit(df.limit(0)).languages == [] and langid.fit(df.selectExpr("text", "null as lang")).languages == []


@pytest.mark.parametrize("times", [2_000, 16_000])
def test_license_finds_take_time_in_proportion(times):
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    scanner.scan("All rights reserved. " * 10)
    began = time.process_time()
    found = scanner.scan("All rights reserved. " * times)
    assert len(found) == times and time.process_time() - began < times * 1e-3


def test_overlapping_license_finds_keep_the_best(monkeypatch):
    templates = {"long": "permission is hereby granted to any person obtaining this copy", "short": "granted to any person"}
    found = licenses.Scanner(templates, 0.8).scan("x permission is hereby granted to any person obtaining this copy y granted to any person z")
    assert [f[:3] for f in found] == [("long", 1, 11), ("short", 12, 16)]


def test_good_votes_outvote_a_weak_rule_and_not_a_sure_one(spark):
    """Texts on which the posterior and all-must-pass differ, rightly; the share of good ones is estimated."""
    words = [f"{a}{b}{c}re" for a in "bcdfglmn" for b in "aeiou" for c in "stv"]
    prose = lambda i, every: " ".join(w + ("." if k % every == every - 1 else "") for k, w in enumerate(words[i % 40 : i % 40 + 60]))
    clean = [(i, prose(i, 7)) for i in range(400)]  # a mark to seven words
    sparse = [(1000 + i, prose(i, 12)) for i in range(12)]  # few marks: the punctuation rule says bad
    symbols = [(2000 + i, " ".join(w + "#" * (k % 2) for k, w in enumerate(prose(i, 7).split()))) for i in range(40)]
    verdict = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(clean + sparse + symbols, "doc_id long, text string")).collect()}
    votes = lambda t: {n: rule(quality.count(t)) for n, rule in quality.RULES.items()}
    assert all(quality.BAD in votes(t).values() for _, t in sparse)  # all-must-pass drops them
    assert all(verdict[i]["kept"] for i, _ in clean + sparse) and not any(verdict[i]["kept"] or verdict[i]["base_failed"] for i, _ in symbols)


def test_the_share_of_good_documents_is_estimated():
    base = "2" * len(quality.RULES)
    for share in (0.5, 0.9):
        patterns = {base: round(1000 * share), "0" * 4 + "2" * (len(base) - 4): round(1000 * (1 - share))}
        assert abs(quality.estimate(patterns).prior - share) < 0.02


def test_new_columns_replace_names_in_any_case(spark):
    from pyspark.sql import functions as F

    from quantloom.llm import line_dedup, pieces
    from quantloom.llm.queries import PIECES

    df = spark.createDataFrame([(i, "some words here\nand there", "h", 1, "x", 2.0, "i") for i in range(3)], "doc_id long, text string, source string, N_Dropped int, LANG_PRED string, Score double, IDS string")
    assert line_dedup.drop_boilerplate_lines(df, F.col("source")).select("n_dropped").schema[0].dataType.simpleString() == "bigint"
    model = langid.fit(df.selectExpr("text", "'en' as lang"))
    assert [r["lang_pred"] for r in langid.identify(df, model).select("lang_pred", "score").collect()] == ["en"] * 3
    table = pieces.Pieces.load(PIECES)
    encoded = pieces.encode(df, table)
    assert encoded.select("ids").schema[0].dataType.simpleString() == "array<int>"
    assert {r["lang_pred"] for r in pieces.decode(encoded, table, text_out="lang_pred").select("lang_pred").collect()} == {df.first()["text"]}
