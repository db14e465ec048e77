"""A chunk's first window repeats the history that it would have within one chunk."""

import pytest

from quantloom.llm import chat


@pytest.mark.parametrize("chunk_turns", [2, 8])
def test_history_across_chunks(spark, chunk_turns):
    rows = [(c, i, "system" if i == 0 else "user" if i % 2 else "assistant", f"turn {i}") for c in (1, None) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(df, budget=48, history=24, chunk_turns=chunk_turns).collect()
    firsts = [r for r in windows if r["window"] == 0 and r["chunk"] > 0]
    assert len(firsts) == 2 * (40 // chunk_turns - 1)
    for r in firsts:  # a turn costs 6 tokens: four fit into the history, besides the system turn
        start = r["chunk"] * chunk_turns
        want = [f"turn {i}" for i in sorted({0, *range(max(0, start - 4), start)})]
        shown = [text for _, text, _, _ in chat.parse_window(r["formatted"])]
        assert r["n_repeated"] == len(want) and shown[: len(want)] == want and shown[len(want)] == f"turn {start}"
