"""Benchmark decontamination by CGK embedding and bit-sampling LSH over item-sized windows.

Texts and items are sequences of lower-cased words. A text leaks an item if the edit distance, in
words, of the item to the best stretch of the text is at most ``1 - similarity`` of the item's
words (0.8 by default).

1. Parts. Items of 32 words or more are cut into equal parts of 16 to 31 words. If an item leaks,
   then at least one part has no more than its own share of the edits, so parts are looked for.
2. Windows. Every word position of every text starts one window of each size class (part sizes,
   rounded up). A window can only hold a part if it shares enough word trigrams with the parts of
   its class: one edit destroys at most three of them. All starts from which the edits allow a part
   are embedded, others cannot be one.
3. CGK. A window is embedded by a walk: step i writes the word under the cursor and moves on if a
   random bit of (i, word) says so. Small edit distance becomes small Hamming distance.
4. LSH. A few sampled steps make a key; ``tables`` keys come from independent walks and samples. An
   equality join with the parts' keys gives places where an item may be. The table of a block's keys
   is broadcast and joined inside the task, where the rest of the text is at hand.
5. The exact edit distance of the whole item to the stretch around those places decides.

Items under ``SHORT`` words have too few trigrams for a walk. They are found exactly: up to 4 words
allow no edit and are looked up whole; 5 to 7 words allow one, which leaves one half as it is.

Items are the stated query set; they are worked on in blocks of about ``block`` characters of text,
and what is broadcast for a block is bounded by that. Each block passes over the texts once.

Defined cases: null texts and items have no words; an item without words is never leaked; equal
items are all reported; ``find_leaks`` counts rows with equal ids (null ids too) as one document,
``drop_leaking`` judges each row by itself, whatever its id; empty tables give no rows; columns that
are not used may have any name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
SHORT, PART, SIZE_STEP = 8, 16, 4
#: Characters of items in a block; what is broadcast for one stays under about 40 bytes a character.
BLOCK = 4_000_000
#: LSH tables, and sampled steps in a key.
TABLES, SAMPLED = 32, 3
#: Slots of the trigram filter, one byte each. Trigrams that share a slot only add windows.
SLOT_BITS = 22
UNKNOWN = 0
_FOUND = "doc_id long, item_id long, distance int, start int, end int"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def allowed(n_words: int, similarity: float) -> int:
    """Edits that an item of this many words may have."""
    return int(n_words * (1 - similarity) + 1e-9)


def _last_row(item: np.ndarray, window: np.ndarray, anywhere: bool) -> np.ndarray:
    """Edit distance of ``item`` to the stretches of ``window`` that end at each place and start ``anywhere`` or at 0."""
    at = np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64) if anywhere else at
    for x in item:
        new = row + 1  # the item's word is left out
        new[1:] = np.minimum(new[1:], row[:-1] + (window != x))
        row = np.minimum.accumulate(new - at) + at  # words of the window that the item lacks
    return row


def fitting_distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end): the edit distance of ``item`` to the best stretch of ``window``.

    Of equal ones the first end, then the shortest stretch.
    """
    row = _last_row(item, window, True)
    end = int(row.argmin())
    back = _last_row(item[::-1], window[:end][::-1], False)
    return int(row[end]), end - int(np.flatnonzero(back == row[end])[0]), end


def _bits(step: int, words: np.ndarray, walk: int) -> np.ndarray:
    """A random bit of (walk, step, word)."""
    with np.errstate(over="ignore"):
        h = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 64 + walk) * 0xBF58476D1CE4E5B9 % 2**64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(63)).astype(np.int64)


def embed_keys(windows: np.ndarray, tables: int, sampled: int, per_walk: int = 4) -> np.ndarray:
    """A key (rows: windows, columns: tables) of each row of word ids."""
    n, size = windows.shape
    padded = np.concatenate([windows, np.full((n, 1), -1, windows.dtype)], 1)
    keys = np.zeros((n, tables), np.uint64)
    rows = np.arange(n)
    for walk in range(-(-tables // per_walk)):
        mine = range(walk * per_walk, min(tables, (walk + 1) * per_walk))
        # steps of which a word is still written in nearly every walk
        picks = [np.sort(np.random.default_rng([size, t]).choice(max(sampled, 3 * size // 2), sampled, replace=False)) for t in mine]
        cursor = np.zeros(n, np.int64)
        for step in range(max(int(p[-1]) for p in picks) + 1):
            word = padded[rows, cursor]
            for t, pick in zip(mine, picks):
                if step in pick:
                    with np.errstate(over="ignore"):
                        keys[:, t] = (keys[:, t] ^ (word.astype(np.uint64) + np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
            cursor = np.minimum(cursor + _bits(step, word, walk), size)
    with np.errstate(over="ignore"):
        keys ^= np.arange(tables, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(size)
    return keys


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words."""
    with np.errstate(over="ignore"):
        h = np.full(max(0, len(ids) - n + 1), n, np.uint64)
        for k in range(n):
            h = (h ^ ids[k : k + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h * np.uint64(0xBF58476D1CE4E5B9)


def _slots(ids: np.ndarray) -> np.ndarray:
    return (_grams(ids, 3) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def size_class(n_words: int) -> int:
    return -(-n_words // SIZE_STEP) * SIZE_STEP


def parts_of(n_words: int) -> list[tuple[int, int]]:
    """Where an item is cut: equal parts of 16 to 31 words, or the item itself if it has fewer than 32."""
    k = max(1, n_words // PART)
    return [(i * n_words // k, (i + 1) * n_words // k) for i in range(k)]


@dataclass(frozen=True)
class Items:
    """A block of items, as word ids from 1, and what finds them."""

    vocabulary: dict[str, int]
    ids: list[int]
    words: list[np.ndarray]
    #: of each slot, a bit for every size class that has a trigram there
    slots: np.ndarray
    #: (size, fewest trigrams that a window with a part shares, words from a part's start to its first one), by bit
    sizes: list[tuple[int, int, int]]
    #: lengths of the runs by which short items are found
    runs: list[int]
    #: the sorted keys, and for each the item and the words before the part
    keys: np.ndarray
    of: np.ndarray
    before: np.ndarray
    similarity: float
    tables: int
    sampled: int

    @staticmethod
    def build(rows: Iterable[tuple[int, str | None]], similarity: float, tables: int, sampled: int) -> Items:
        vocabulary: dict[str, int] = {}
        ids: list[int] = []
        words: list[np.ndarray] = []
        keys: list[tuple[np.ndarray, int, int]] = []
        parts: dict[int, list[tuple[int, int, np.ndarray]]] = defaultdict(list)
        runs: set[int] = set()
        for item_id, text in rows:
            found = words_of(text)
            if not found:
                continue
            item = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in found], np.int64)
            if len(item) >= SHORT:
                for a, b in parts_of(len(item)):
                    parts[size_class(b - a)].append((len(ids), a, item[a:b]))
            else:
                half = len(item) if not allowed(len(item), similarity) else len(item) // 2
                for a, b in {(0, half), (len(item) - half if half < len(item) else 0, len(item))}:
                    runs.add(b - a)
                    keys.append((_grams(item[a:b], b - a), len(ids), a))
            ids.append(item_id)
            words.append(item)
        slots, sizes = np.zeros(1 << SLOT_BITS, np.uint8), []
        for bit, (size, mine) in enumerate(sorted(parts.items())):
            edits = [allowed(len(p), similarity) for _, _, p in mine]
            sizes.append((size, min(max(1, len(p) - 2 - 3 * e) for (_, _, p), e in zip(mine, edits)), 4 * max(edits)))
            padded = np.full((len(mine), size), -1, np.int64)
            for k, (_, _, p) in enumerate(mine):
                padded[k, : len(p)] = p
                slots[_slots(p)] |= np.uint8(1 << bit)
            for row, (item, a, _) in zip(embed_keys(padded, tables, sampled), mine):
                keys.append((np.unique(row), item, a))
        flat = np.concatenate([k for k, _, _ in keys]) if keys else np.zeros(0, np.uint64)
        counts = [len(k) for k, _, _ in keys]
        order = np.argsort(flat, kind="stable")
        of, before = (np.repeat(np.array([k[i] for k in keys], np.int64), counts)[order] for i in (1, 2))
        return Items(vocabulary, ids, words, slots, sizes, sorted(runs), flat[order], of, before, similarity, tables, sampled)

    def _starts(self, bit: int, classes: np.ndarray) -> np.ndarray:
        """Where windows of a class may hold a part."""
        size, least, reach = self.sizes[bit]
        at = np.flatnonzero((classes >> bit) & 1)
        last = at[least - 1 :]  # the least-th shared trigram from here on must be within the window
        first = at[: len(last)][last - at[: len(last)] < size + size // 4]
        step = np.zeros(len(classes) + 1, np.int64)
        np.add.at(step, np.maximum(first - reach, 0), 1)
        np.add.at(step, first + 1, -1)
        return np.flatnonzero(np.cumsum(step[:-1]) > 0)

    def _places(self, word: np.ndarray, end_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, keys), a slice of windows at a time; a window ends with its text (``end_of`` each word)."""
        classes = self.slots[_slots(word)]
        for bit, (size, _, _) in enumerate(self.sizes):
            starts = self._starts(bit, classes)
            for k in range(0, len(starts), 4096):
                at = starts[k : k + 4096]
                cells = at[:, None] + np.arange(size)[None, :]
                inside = cells < end_of[at][:, None]
                yield at, embed_keys(np.where(inside, word[np.minimum(cells, len(word) - 1)], -1), self.tables, self.sampled)
        for n in self.runs:
            found = _grams(word, n)
            where = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            at = np.flatnonzero(self.keys[where] == found)
            yield at, found[at][:, None]

    def look(self, word: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of each text and item that leak; text k has the words from begin[k] to two before begin[k + 1]."""
        end_of = np.repeat(begin[1:] - 2, np.diff(begin))
        may: dict[tuple[int, int], list[int]] = defaultdict(list)
        for starts, keys in self._places(word, end_of) if len(self.keys) else ():
            low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
            for r, c in zip(*np.nonzero(high > low)):
                text = int(np.searchsorted(begin, starts[r], "right")) - 1
                for k in range(low[r, c], high[r, c]):
                    may[text, int(self.of[k])].append(int(starts[r] - self.before[k]))
        for (text, item), places in may.items():
            words = self.words[item]
            most = allowed(len(words), self.similarity)
            slack, first, last = most + SHORT, int(begin[text]), int(begin[text + 1]) - 2
            best = None
            for low, high in _stretches(sorted(set(places)), slack, len(words) + slack):
                low, high = max(low, first), min(high, last)
                if high > low:
                    d, a, b = fitting_distance(words, word[low:high])
                    found = (d, low + a - first, low + b - first)
                    best = found if best is None or found < best else best
            if best is not None and best[0] <= most:
                yield text, self.ids[item], *best

    def search(self, texts: Iterable[str | None], chunk: int = 200_000) -> Iterator[tuple[int, int, int, int, int]]:
        """(place among ``texts``, item_id, distance, start, end), looked through in chunks of about ``chunk`` words."""
        get = self.vocabulary.get
        ids: list[int] = []
        begin, first = [0], 0
        for k, text in enumerate(texts):
            ids += [get(w, UNKNOWN) for w in words_of(text)]
            ids += (UNKNOWN, UNKNOWN)
            begin.append(len(ids))
            if len(ids) >= chunk:
                for at, *leak in self.look(np.array(ids, np.int64), np.array(begin)):
                    yield first + at, *leak
                ids, begin, first = [], [0], k + 1
        if ids:
            for at, *leak in self.look(np.array(ids, np.int64), np.array(begin)):
                yield first + at, *leak


def _stretches(places: list[int], before: int, after: int) -> Iterator[tuple[int, int]]:
    """The stretches from ``before`` words before to ``after`` words after each place, joined where they meet."""
    low, high = places[0] - before, places[0] + after
    for p in places[1:]:
        if p - before > high:
            yield low, high
            low = p - before
        high = p + after
    yield low, high


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, similarity: float, block: int, tables: int, sampled: int) -> Iterator[Items]:
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text").cast("long") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        mine = Items.build(((r["item_id"], r["text"]) for r in items.filter(part == k).toLocalIterator()), similarity, tables, sampled)
        if mine.words:
            yield mine


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = 0.8,
    block: int = BLOCK,
    tables: int = TABLES,
    sampled: int = SAMPLED,
) -> DataFrame:
    """doc_id, item_id, distance, start, end (word positions): the best leak of each pair."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    out = spark.createDataFrame([], _FOUND)
    for items in _blocks(benchmark, item_col, item_text_col, similarity, block, tables, sampled):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                found = [(ids[k].as_py(), *leak) for k, *leak in shared.value.search(t.as_py() for t in batch.column(1))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        out = out.unionByName(texts.mapInArrow(run, _FOUND))
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start", "end")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def drop_leaking(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = 0.8,
    block: int = BLOCK,
    tables: int = TABLES,
    sampled: int = SAMPLED,
) -> DataFrame:
    """``docs`` without the rows whose texts leak an item."""
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text_col, similarity, block, tables, sampled):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaking = {k for k, *_ in shared.value.search(t.as_py() for t in batch.column(at))}
                yield batch.filter(pa.array([k not in leaking for k in range(batch.num_rows)], pa.bool_())) if leaking else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs
