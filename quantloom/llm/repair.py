"""Conversation structure repair: the cheapest edits that make the roles alternate.

A conversation shall read ``(s?(ua)+)?`` by role initials. Each of its rows is kept, given another
role or deleted, and empty rows are put in; blank rows and repeated ones must go, and an unfinished
row that stays costs more (``COSTS``).

What matters of a row is one letter: ``x`` if it must go, else its role (``s``, ``u``, ``a``, ``o``
for others), a capital if it is unfinished. The letters of a conversation are its signature, and few
signatures are distinct. Edits are worked out from the last row back, so signatures are put into the
trie from their ends: sorted by their reverse, each range of them is walked once, the layers of the
part it shares with the one before are kept on a stack and only the rest is computed. A layer holds
the costs of the four states of the pattern and the order of their edit strings, not the strings,
so it is small and layers that are alike are made once.

Rows of a conversation stream through a task in order; neither pass holds more of one than a row,
its signature and its edits.

Defined cases: rows are in order of turn, nulls first, then role, then text; a null role, text or id
reads as one space where it is shown; equal rows are repeats; a null ``conv_id`` is a conversation
like any other; a conversation whose rows are all ``gone`` has zeros and empty edits; an empty table
gives none; further columns are not used and may have any name.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Costs of the edits; an unfinished row that stays adds ``UNFINISHED``.
COSTS, UNFINISHED = {"K": 0, "R": 1, "D": 2, "I": 5}, 5
#: States of the pattern: nothing yet, after s, after u, after a. What an added u or a leads to.
START, SYSTEM, USER, PAIR = range(4)
_AFTER = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", PAIR), PAIR: ("u", USER)}
_NEVER = 1 << 40

ROWS = "conv_id long, turn long, role string, text string, gone boolean"


def damaged(turns: DataFrame) -> DataFrame:
    """``ROWS`` of conversations, damaged by a checksum of conversation and turn modulo 20.

    0 marks a row as gone, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
        .withColumn("copies", F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode("copies").alias("copy"))
        .drop("copy")
    )


def _letter(role: Column, unfinished: Column) -> Column:
    initial = F.substring(role, 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(unfinished, F.upper(known)).otherwise(known)


def judged(rows: DataFrame) -> DataFrame:
    """Rows with ``fault`` (of the row alone, or of a repeat on an earlier turn) and ``letter``.

    A repeat on the same turn follows the row it repeats and is seen when the rows stream by.
    """
    digest = F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))
    here = rows.withColumn("digest", digest)
    # only what occurs twice is looked up, so that unique rows meet nothing
    first = here.filter("not gone").groupBy("conv_id", "digest").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))).alias("first")).filter("times > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    joined = here.join(first, here["conv_id"].eqNullSafe(first["c"]) & (here["digest"] == first["d"]), "left")
    ending = F.rtrim(F.col("text"), F.lit("\t\n\x0b\x0c\r "))
    blank = ending == ""
    repeat = F.coalesce(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")) > F.col("first"), F.lit(False))
    unfinished = ~F.substring(ending, -1, 1).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(repeat, "duplicate").when(unfinished, "truncated").otherwise("")
    return joined.select("conv_id", "turn", "role", "text", "gone", fault.alias("fault"), _letter(F.col("role"), unfinished).alias("letter"))


class _Layer:
    """What is cheapest from each state on over the rest of a signature: costs over ``base``, and ranks of the edit strings."""

    __slots__ = ("costs", "ranks", "edits", "before")

    def __init__(self, costs: tuple, ranks: tuple, edits: tuple) -> None:
        self.costs, self.ranks, self.edits = costs, ranks, edits  # edits: of each state, (letter, state after, whether a row is used)
        self.before: dict[str, tuple[int, _Layer]] = {}


def _layer(options: list[list[tuple]], known: dict) -> tuple[int, _Layer]:
    """A layer from the ways on of each state: (cost, (letter, rank after), edit)."""
    best = [min(o, default=(_NEVER, (), None)) for o in options]
    for _ in range(3):  # rows put in lead from state to state before the next row is used
        for state, (_, after) in _AFTER.items():
            cost, key, _ = best[after]
            best[state] = min(best[state], (cost + COSTS["I"], ("I", *key), ("I", after, False)), key=lambda o: o[:2])
    base = min(b[0] for b in best)
    order = {key: i for i, key in enumerate(sorted({b[1] for b in best}))}
    made = tuple(b[0] - base for b in best), tuple(order[b[1]] for b in best), tuple(b[2] for b in best)
    if made not in known:
        known[made] = _Layer(*made)
    return base, known[made]


class Edits:
    """The layers of signatures, each made once."""

    def __init__(self) -> None:
        self.known: dict = {}
        base, self.last = _layer([[(0, (), None)], [], [], [(0, (), None)]], self.known)

    def before(self, layer: _Layer, letter: str) -> tuple[int, _Layer]:
        """The layer one row earlier, and what its costs rise by."""
        if letter not in layer.before:
            options: list[list[tuple]] = []
            for state in range(4):
                ways = [("D", state)]
                if letter != "x":
                    role, (wanted, after) = letter.lower(), _AFTER[state]
                    if role == wanted:
                        ways.append(("K", after))
                    if role == "s" and state == START:
                        ways.append(("K", SYSTEM))
                    ways.append(("R", after))
                extra = UNFINISHED if letter.isupper() else 0
                options.append([(COSTS[e] + layer.costs[after] + extra * (e != "D"), (e, layer.ranks[after]), (e, after, True)) for e, after in ways])
            layer.before[letter] = _layer(options, self.known)
        return layer.before[letter]

    @staticmethod
    def read(layers: list[_Layer]) -> str:
        """The edits of a signature whose layers, from the last row back, are these."""
        out, state, i = [], START, len(layers) - 1
        while edit := layers[i].edits[state]:
            letter, state, used = edit
            out.append(letter)
            i -= used
        return "".join(out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_EDITS = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])


def repairs(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit: cheapest edits of each distinct ``signature``, ties in favour of the least string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, path = Edits(), ""
        layers, costs = [made.last], [0]  # of the path from the root of the trie
        for batch in batches:
            out = []
            for reverse in batch.column(0).to_pylist():
                shared = len(os.path.commonprefix([path, reverse]))
                del layers[shared + 1 :], costs[shared + 1 :]
                for letter in reverse[shared:]:
                    more, layer = made.before(layers[-1], letter)
                    layers.append(layer)
                    costs.append(costs[-1] + more)
                path = reverse
                out.append((reverse[::-1], costs[-1] + layers[-1].costs[START], made.read(layers)))
            yield _batch(out, _EDITS)

    reverse = signatures.select(F.reverse("signature").alias("reverse")).distinct()
    return reverse.repartitionByRange("reverse").sortWithinPartitions("reverse").mapInArrow(run, "signature string, cost long, audit string")


_SEEN = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), ("signature", pa.string())])
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """Counts and signature of one conversation, row by row."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.low, self.high, self.turns = conv_id, None, None, 0
        self.faults, self.illegal, self.row, self.letters = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, 0, None, []

    def add(self, turn: int | None, role: str, text_key: bytes, fault: str, letter: str) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if fault != "blank" and self.row == (turn, role, text_key):
            fault = "duplicate"
        if self.row is not None and self.row[1][:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        self.faults[fault] += 1
        self.letters.append("x" if fault in ("blank", "duplicate") else letter)
        self.row = turn, role, text_key

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, "".join(self.letters)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        done = []
        for conv_id, turn, role, text, gone, fault, letter in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(conv_id)
            if not gone:
                now.add(turn, role, hashlib.md5(text.encode()).digest(), fault, letter)
        yield _batch(done, _SEEN)
    if now is not None:
        yield _batch([now.result()], _SEEN)


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation's rows together and in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "text")


def diagnose(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``ROWS``: gaps in its turns, its faults, illegal neighbours, signature, cost and edits (``audit``)."""
    seen = written(_ordered(judged(rows)).mapInArrow(_signatures, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"), "conversations")
    return seen.join(repairs(seen.select("signature")), "signature")


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, role and text of the repaired rows of conversations, each of which begins with a row that holds its edits."""
    edits, at, place, last = "", 0, 0, ""

    def put(role: str, text: str) -> tuple:
        nonlocal place, last
        place, last = place + 1, role[:1]
        return conv_id, place, role, text

    for batch in batches:
        out = []
        for conv_id, _, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
            wanted = lambda: "assistant" if last == "u" else "user"
            if audit is not None:
                edits, at, place, last = audit, 0, 0, ""
            else:
                if edits[at] == "K":
                    out.append(put(role, text))
                elif edits[at] == "R":
                    out.append(put(wanted(), text))
                at += 1
            while at < len(edits) and edits[at] == "I":
                out.append(put(wanted(), ""))
                at += 1
        yield _batch(out, _REPAIRED)


def repair(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, role, text: conversations after the edits that ``diagnose`` found, each together and in order; empty ones have no row."""
    heads = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit", F.lit(0).alias("after"))
    rest = rows.filter("not gone").select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("after"))
    ordered = _ordered(heads.unionByName(rest), "after").select("conv_id", "turn", "role", "text", "audit")
    return ordered.mapInArrow(_repaired, "conv_id long, place long, role string, text string")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, None
    for batch in batches:
        done = []
        for conv_id, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if digest is not None and now == conv_id:
                digest.update(b"\n")
            else:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = conv_id, hashlib.sha256()
            digest.update(f"{role}:{text}".encode())
        yield _batch(done, _DIGESTS)
    if digest is not None:
        yield _batch([(now, digest.hexdigest())], _DIGESTS)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256: of the repaired ``role:text`` of each conversation, joined by line breaks; of what ``repair`` returned, in its order."""
    return repaired.mapInArrow(_digests, "conv_id long, sha256 string")
