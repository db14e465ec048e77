"""Fill-in-middle against a plain version: tokens by a regular expression, texts cut by joining them."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.llm import fill_middle as fm


def plain_version(doc_id, text, plain_percent=10):
    text = text or ""
    words = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(words)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(words[:a]), "".join(words[a:b]), "".join(words[b:])
    if not text or any(x in text for x in fm.MARKS) or h3 % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "a", "ab cd", "a<P>b", "x <M>", "éa é\n\n", "😀x😀", "word " * 9_000, "z" * 70_000 + "é" * 3, "a.b,c" * 30_000, "<S", "P>", "\x00a\x00"]


@pytest.mark.parametrize("chunk", [1, 3, 64, 1 << 16])
def test_against_plain_version(spark, chunk):
    texts = [t if t is None or chunk > 3 else t[:200] for t in TEXTS]
    rows = [(i * 100 + j, t, "kept", "mine") for i, t in enumerate(texts) for j in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, N string")
    out = fm.fill_in_middle(df, chunk=chunk, plain_percent=0).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    assert {r["form"] for r in out} == {"plain", "psm", "spm"} and len(out) == len(rows) and out[0]["source"] == "kept"
    for r in out:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_version(r["doc_id"], r["text"], 0)
        assert r["back"] == (r["text"] or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB. é😀", max_size=30), min_size=1, max_size=5), st.integers(1, 9))
def test_cuts_at_every_rank(texts, chunk):
    ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
    chunks = fm.Chunks(np.frombuffer("".join(texts).encode(), np.uint8), ends[:-1], ends[1:], chunk)
    for i, text in enumerate(texts):
        words = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert chunks.tokens(i) == len(words)
        for rank in range(len(words) + 1):
            before = "".join(words[:rank])
            assert chunks.cut(i, rank) == (len(before.encode()), len(before))


def test_only_owning_chunks_are_looked_at_again(monkeypatch):
    data = np.frombuffer(b"ab, " * 5_000, np.uint8)
    chunks = fm.Chunks(data, np.array([0]), np.array([len(data)]), 100)
    seen = []
    monkeypatch.setattr(chunks, "_marks", lambda i, t, real=chunks._marks: seen.append(i) or real(i, t))
    chunks.cut(0, 7_000)
    assert seen == [93]  # three tokens in four bytes: token 7,000 is in the chunk of byte 9,333


def test_odd_rows_and_empty_table(spark, odd_docs):
    out = fm.fill_in_middle(odd_docs).select("doc_id", "text", "output", "form", "key_", fm.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(out) == odd_docs.count() and all(r["back"] == (r["text"] or "") and r["key_"] == 1 for r in out)
    assert fm.fill_in_middle(odd_docs.limit(0)).count() == 0
