"""Chat formatting with budgeted windows.

A conversation becomes one or more training windows. Prefix sums of the turns' token counts
choose turn-aligned spans of new turns; a window repeats the system turn and the longest run of
earlier turns within the history budget, and its loss mask covers the new assistant turns only.

Conversations are worked on in chunks of ``chunk_turns`` turn numbers, so one of any length is
spread over many tasks; a chunk is handed the last turns before it as history. A window still ends
where its chunk ends.

Defined cases: null text or role is empty; null turn numbers come first; turns with the same
number are ordered by role, then text; equal rows are separate turns; a null ``conv_id`` is a
conversation like any other; a turn above the budget gets a window of its own (``over_budget``);
an empty table gives no windows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed template: <s>ROLE[INST]TEXT[/INST]</s>
BOS, OPEN, CLOSE, EOS = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)

#: What the marks of a turn cost in tokens.
MARKS = 4

WINDOWS = (
    "conv_id long, chunk long, window int, formatted string, n_repeated int, n_tokens long, over_budget boolean,"
    " loss_spans array<struct<start:int,end:int>>"
)


def escape(text: str) -> str:
    """Control strings lose their shape; a backslash is doubled. ``unescape`` undoes it exactly."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def parse_window(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn of a formatted window."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def count_tokens(text: Column) -> Column:
    """Words and single symbols: a cheap stand-in for a tokenizer's count."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"))


def plan_windows(tokens: list[int], budget: int, history: int, reserved: list[int], begin: int = 0) -> list[tuple[int, int, int]]:
    """(history start, start, end) of each window over turns with these token counts.

    ``reserved[i]``: tokens of the system turn to repeat in a window that starts at turn i; turns before ``begin`` are history only.
    """
    prefix = [0]
    for t in tokens:
        prefix.append(prefix[-1] + t)
    out, start, n = [], begin, len(tokens)
    while start < n:
        first = start
        while first > 0 and prefix[start] - prefix[first - 1] <= history:
            first -= 1
        room = budget - reserved[start] - (prefix[start] - prefix[first])
        while first < start and tokens[start] > room:  # history yields to a new turn
            room += tokens[first]
            first += 1
        end = start + 1
        while end < n and prefix[end + 1] - prefix[start] <= room:
            end += 1
        out.append((first, start, end))
        start = end
    return out


def format_conversations(
    turns: DataFrame,
    budget: int = 512,
    history: int = 128,
    chunk_turns: int = 256,
    tokens: Column | None = None,
    loss_role: str = "assistant",
) -> DataFrame:
    """Windows (see ``WINDOWS``) of turns ``conv_id, turn, role, text``; ``tokens``: a count of ``text``."""
    text = F.coalesce("text", F.lit(""))
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        text.alias("text"),
        # what the marks cost, so that an empty turn is not free
        (F.coalesce(tokens if tokens is not None else count_tokens(text), F.lit(0)) + MARKS).cast("long").alias("tokens"),
    ).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk_turns), F.lit(-(2**62))).cast("long"))
    chunks = (
        t.groupBy("conv_id", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "tokens"))).alias("turns"))
    )
    # a conversation's system turn: its first one; chunks after it repeat it
    system = (
        t.filter(F.col("role") == "system")
        .groupBy(F.col("conv_id").alias("sys_conv"))
        .agg(F.min(F.struct("chunk", "turn", "text", "tokens")).alias("system"))
    )
    joined = chunks.join(system, F.col("conv_id").eqNullSafe(F.col("sys_conv")), "left").select(
        "conv_id", "chunk", "turns", "system"
    )
    if most := history // MARKS:
        tails = _tails(t, chunks, most)
        joined = joined.join(tails, F.col("conv_id").eqNullSafe(F.col("to_conv")) & (F.col("chunk") == F.col("to")), "left").drop("to_conv", "to")
    else:
        joined = joined.withColumn("before", F.lit(None).cast(joined.schema["turns"].dataType))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "chunk", "window", "formatted", "n_repeated", "n_tokens", "over_budget", "loss_spans")}
            for row in batch.to_pylist():
                for values in _windows_of(row, budget, history, loss_role):
                    for k, v in zip(out, (row["conv_id"], row["chunk"], *values)):
                        out[k].append(v)
            schema = schema or pa.schema([
                ("conv_id", pa.int64()), ("chunk", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()),
                ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()),
                ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return joined.mapInArrow(windows, WINDOWS)


def _tails(turns: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """to_conv, to, before: for each chunk the last ``most`` turns before it; no history has more, as each costs its marks."""
    ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(1, most)
    sizes = turns.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    later = sizes.select("conv_id", "chunk", F.collect_list(F.struct("chunk", "n")).over(ahead).alias("later")).filter(F.size("later") > 0)
    between = F.aggregate(F.slice("later", 1, F.col("at")), F.lit(0).cast("long"), lambda n, c: n + c["n"])
    later = later.select("conv_id", "chunk", "later", F.posexplode("later").alias("at", "c")).filter(between < most)
    later = later.select(F.col("conv_id").alias("to_conv"), F.col("chunk").alias("of"), F.col("c.chunk").alias("to"))
    last = lambda a: F.slice(a, F.greatest(F.size(a) - most, F.lit(0)) + 1, most)
    sent = chunks.join(later, F.col("conv_id").eqNullSafe(F.col("to_conv")) & (F.col("chunk") == F.col("of"))).select("to_conv", "to", "of", last("turns").alias("tail"))
    parts = sent.groupBy("to_conv", "to").agg(F.array_sort(F.collect_list(F.struct("of", "tail"))).alias("parts"))
    return parts.select("to_conv", "to", last(F.flatten(F.col("parts.tail"))).alias("before"))


def _windows_of(row: dict, budget: int, history: int, loss_role: str) -> Iterator[tuple]:
    before, system = row["before"] or [], row["system"]
    turns = [*before, *row["turns"]]
    at = None
    if system and system["chunk"] <= row["chunk"]:  # its place among these turns, if it is there
        at = next((i for i, t in enumerate(turns) if t["role"] == "system" and (t["turn"], t["text"]) == (system["turn"], system["text"])), None)
    elif not system or system["chunk"] > row["chunk"]:
        at = len(turns)
    repeats = [system["tokens"] if at is None or at < i else 0 for i in range(len(turns))]
    for k, (first, start, end) in enumerate(plan_windows([t["tokens"] for t in turns], budget, history, repeats, len(before))):
        lead = [system | {"role": "system"}] if repeats[start] and (at is None or at < first) else []
        shown = [*lead, *turns[first:end]]
        repeated = len(lead) + start - first
        parts, spans, pos = [], [], 0
        for i, t in enumerate(shown):
            head, body = f"{BOS}{escape(t['role'])}{OPEN}", escape(t["text"])
            if i >= repeated and t["role"] == loss_role:
                spans.append({"start": pos + len(head), "end": pos + len(head) + len(body)})
            parts.append(head + body + CLOSE + EOS)
            pos += len(parts[-1])
        total = sum(t["tokens"] for t in shown)
        yield k, "".join(parts), repeated, total, total > budget, spans
