"""Digests of conversations, read back from their formatted windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .chat import parse_window, unescape

_OUT = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()),
])


class _Digest:
    """Running digests of one conversation; its windows come in order and none is kept."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.n_windows = 0

    def add(self, formatted: str, n_repeated: int, spans: list[dict]) -> None:
        for role, text, _, _ in parse_window(formatted)[n_repeated:]:
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in spans:
            text = unescape(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)
        self.n_windows += 1

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.n_windows


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if now is None or now.conv_id != r["conv_id"]:
                if now is not None:
                    done.append(now.row())
                now = _Digest(r["conv_id"])
            now.add(r["formatted"], r["n_repeated"], r["loss_spans"])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _OUT)], schema=_OUT) if done else pa.RecordBatch.from_pylist([], schema=_OUT)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(now.row(), _OUT)], schema=_OUT)


def read_back(windows: DataFrame) -> DataFrame:
    """One row a conversation. Windows stream in order through a task; only hash states are held."""
    return (
        windows.select("conv_id", "chunk", "window", "formatted", "n_repeated", "loss_spans")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "chunk", "window")
        .mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
    )

