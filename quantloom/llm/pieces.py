"""SentencePiece encoding and decoding by a relational lattice.

1. Texts fall into words (a run of blanks with the characters after it) and words into units: a word
   is cut wherever no piece of the table holds the two characters side by side, so that no piece
   reaches across a cut. Only distinct units are worked on.
2. Lattice: every substring of a unit, up to the longest piece, is exploded and equality-joined to
   the piece table (its size is checked before it is broadcast); the edges are grouped by unit.
3. A higher-order ``aggregate`` folds the edges of a unit to its best segmentation:
   - a table of log probabilities: Viterbi; the largest sum of scores, of equal ones that whose last
     piece is shortest;
   - a table of merge ranks (scores 0, -1, -2, ...): sums of ranks mean nothing and do not give the
     ids of the model, so the fold keeps the open cuts as bits and applies, of the edges that join
     two neighbouring pieces, the best-ranked one (the leftmost of equal ones) until none is left.
     These are the ids that the model itself gives.
   Units over ``FOLDED`` characters (a run that can be cut nowhere, such as one letter many
   times) get the same result in linear space inside the tasks.
4. Rows are packed in compressed slices, in buckets of about ``bucket`` bytes of text from one input
   partition, and the buckets are dealt out once. A bucket's distinct units are joined with their ids,
   and each bucket is put together from its own units; its distinct words are cut and looked up once.

A character without a piece costs more than any piece and becomes its UTF-8 bytes.

Defined cases: a null text has null ids; an empty one none; blanks U+2581 in a text decode as
spaces; words of any length are encoded whole; equal texts get equal ids; an empty table gives none;
other columns pass through, whatever their names and types; a column named like the new one is
replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, without

BLANK = "▁"
_WORD = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
#: Pieces that may be broadcast, bytes of text in a bucket, whose units one task holds, and in a slice.
MAX_PIECES, BUCKET, SLICE = 1_000_000, 32 << 20, 2 << 20
#: The most characters of a unit in the fold: its cuts and its end are bits of one long.
FOLDED = 60
#: Words of a bucket's packets that wait to be made distinct, words cut at once, and units sent on at once.
WORDS_WAITING, WORDS_CUT, UNITS_SENT = 250_000, 20_000, 20_000


@dataclass(frozen=True)
class Pieces:
    """A piece table: (piece, id, score), the ids of the 256 bytes, and what each id decodes to."""

    rows: list[tuple[str, int, float]]
    bytes_: list[int]
    strings: list[str | int | None]
    #: whether the scores are merge ranks, not log probabilities
    merges: bool = False
    #: pairs of characters that some piece holds side by side
    joins: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "joins", frozenset(p[i : i + 2] for p, _, _ in self.rows for i in range(len(p) - 1)))

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rows, at_byte, strings = [], [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                at_byte[int(piece[3:5], 16)] = i
                strings.append(int(piece[3:5], 16))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                strings.append(None)
            else:
                rows.append((piece, i, model.get_score(i)))
                strings.append(piece)
        # only ranks are whole numbers
        return Pieces(rows, at_byte, strings, merges=all(s == int(s) for _, _, s in rows)).checked()

    def checked(self) -> Pieces:
        if len(self.rows) > MAX_PIECES:
            raise ValueError(f"{len(self.rows)} pieces are too many for a broadcast")
        for piece, _, _ in self.rows:
            if len(piece) > 1 and re.search(rf"\n|[^{BLANK}]{BLANK}", piece):
                raise ValueError(f"the piece {piece!r} reaches across words")
        return self

    @property
    def longest(self) -> int:
        return max((len(r[0]) for r in self.rows), default=1)

    @property
    def unknown_score(self) -> float:
        return min((r[2] for r in self.rows), default=0.0) - 10.0

    def ranked(self) -> list[tuple[str, int, float, int, bool]]:
        """(piece, id, score, rank, late): the best score has rank 0; late: a prefix or suffix of two characters or more ranks after the piece."""
        at = {s: k for k, s in enumerate(sorted({-r[2] for r in self.rows}))}
        of = {p: at[-s] for p, _, s in self.rows}
        parts = lambda p: (x for k in range(2, len(p)) for x in (p[:k], p[-k:]))
        return [(p, i, s, of[p], any(of.get(x, -1) >= of[p] for x in parts(p))) for p, i, s in self.rows]

    def units(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The units of some words one after the other, and how many each word has."""
        parts, counts = self.cut(pa.array(words, pa.string()))
        return parts.to_pylist(), counts

    def cut(self, words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """``units`` on Arrow arrays; no word is empty. Few words are cut at once, as a character takes many bytes meanwhile."""
        done = [self._cut(words.slice(k, WORDS_CUT)) for k in range(0, len(words), WORDS_CUT)]
        return pa.concat_arrays([pa.array([], pa.string()), *(u for u, _ in done)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in done)])

    def _cut(self, words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        place, holds = self._pairs
        ends = np.frombuffer(words.buffers()[1], "<i4")[words.offset : words.offset + len(words) + 1]
        raw = words.buffers()[2][int(ends[0]) : int(ends[-1])]
        of = place[np.frombuffer(bytes(raw).decode().encode("utf-32-le"), "<u4")]
        # the first byte of each character, and whether a word or a unit begins there
        at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        first = np.zeros(ends[-1] - ends[0] + 1, bool)
        first[ends[:-1] - ends[0]] = True
        first = first[at]
        begins = first.copy()
        begins[1:] |= ~holds.ravel()[of[:-1] * len(holds) + of[1:]]
        bounds = np.append(at[begins], ends[-1] - ends[0]).astype("<i4")
        parts = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(raw))
        return parts, np.diff(np.append(np.flatnonzero(first[begins]), len(parts)))

    @cached_property
    def raw(self) -> pa.LargeBinaryArray:
        """The bytes that each id decodes to."""
        return pa.array([bytes([s]) if isinstance(s, int) else (s or "").encode() for s in self.strings], pa.large_binary())

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each code point, and for two numbers whether some piece holds such characters side by side."""
        letters = sorted({c for pair in self.joins for c in pair})
        place, holds = np.zeros(0x110000, np.int32), np.zeros((len(letters) + 1, len(letters) + 1), bool)
        number = {c: i for i, c in enumerate(letters, 1)}
        place[[ord(c) for c in letters]] = list(number.values())
        for pair in self.joins:
            holds[number[pair[0]], number[pair[1]]] = True
        return place, holds


def words_of(text: str) -> list[str]:
    """The words of a text, with blanks for spaces and one blank before it."""
    return _WORD.findall(BLANK + text.replace(" ", BLANK)) if text else []


#: An edge's place as one number, so that sorting by end, then start, compares once.
PLACE = 1 << 16


def _viterbi(n: Column, edges: Column, unknown: float) -> Column:
    """array<struct<start, id>>: the best path over ``edges`` (at: end * PLACE + start, id, score)."""
    ends = lambda found: F.transform(F.filter(found, lambda e: F.pmod(e["at"], F.lit(PLACE)) + 1 == F.shiftright(e["at"], 16)), lambda e: F.shiftright(e["at"], 16))
    # a character with a piece of its own never needs its bytes
    bare = F.transform(F.array_except(F.sequence(F.lit(1), n), ends(edges)), lambda i: F.struct((i * PLACE + i - 1).alias("at"), F.lit(-1).alias("id"), F.lit(unknown).alias("score")))

    def step(acc: Column, e: Column) -> Column:
        """``done`` holds the best for every end before ``at``; the rest of ``acc`` is the best for ``at``."""
        end, start = F.shiftright(e["at"], 16), e["at"].bitwiseAND(F.lit(PLACE - 1))
        score = e["score"] + F.when(start == acc["at"], acc["score"]).otherwise(F.get(acc["done"], start)["score"])
        taken = lambda done: F.struct(end.alias("at"), score.alias("score"), start.alias("start"), e["id"].alias("id"), done.alias("done"))
        done = F.concat(acc["done"], F.array(F.struct(acc["score"].alias("score"), acc["start"].alias("start"), acc["id"].alias("id"))))
        return F.when(end > acc["at"], taken(done)).when(score >= acc["score"], taken(acc["done"])).otherwise(acc)

    def path(state: Column) -> Column:
        nothing = F.array().cast("array<struct<start:int,id:int>>")
        return F.aggregate(
            F.sequence(F.lit(1), n),
            F.struct(n.alias("at"), nothing.alias("out")),
            lambda acc, _: F.when(
                acc["at"] > 0,
                F.struct(
                    F.get(state, acc["at"])["start"].alias("at"),
                    F.concat(F.array(F.struct(F.get(state, acc["at"])["start"].alias("start"), F.get(state, acc["at"])["id"].alias("id"))), acc["out"]).alias("out"),
                ),
            ).otherwise(acc),
            lambda acc: acc["out"],
        )

    first = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(-1).alias("id"), F.array().cast("array<struct<score:double,start:int,id:int>>").alias("done"))
    last = lambda acc: path(F.concat(acc["done"], F.array(F.struct(acc["score"].alias("score"), acc["start"].alias("start"), acc["id"].alias("id")))))
    # by end, then start: of equal scores the later start, which is the shorter piece, wins
    return F.aggregate(F.array_sort(F.concat(edges, bare)), first, step, last)


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


#: How an edge is packed into a long: rank, start (6 bits), end (6 bits), late (1 bit), id (21 bits).
ID_BITS, AT_BITS = 21, 6
END = ID_BITS + 1
START = END + AT_BITS
RANK = START + AT_BITS


def _merged(n: Column, packed: Column) -> Column:
    """array<struct<start, id>> of the segmentation that merging by rank gives; id -1: no piece.

    A cut between two characters is a bit. An edge applies if its two ends and one cut between
    them are open, and closes that cut. The best-ranked edge that applies is taken, the leftmost of
    equal ones; the packed edges sort that way.

    One pass over the sorted edges does it, unless an edge closes a cut so that a better-ranked one,
    already passed, now applies. Only an edge with a part of worse rank than its own (``late``) can do
    so; a unit in which one does is folded again, looking at all edges for each cut.
    """
    at = lambda p, shift: F.shiftright(p, shift).bitwiseAND(F.lit((1 << AT_BITS) - 1))

    def opened(p: Column) -> Column:
        start, end = at(p, START), at(p, END)
        ends, span = _bit(start) + _bit(end), _bit(end + 1) - _bit(start)
        return F.struct(p.alias("key"), ends.alias("ends"), span.alias("span"), F.bitwise_not(span).bitwiseOR(ends).alias("keep"))

    def holds(cuts: Column, e: Column, count: int) -> Column:
        """Whether the ends of an edge are open, and so many cuts from end to end."""
        return (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["span"])) == count)

    def quick(edges: Column, late: Column) -> Column:
        """The open cuts after one pass; -1 if an edge that was passed applies."""

        def step(cuts: Column, e: Column) -> Column:
            after = cuts.bitwiseAND(e["keep"])
            missed = F.exists(late, lambda f: (f["key"] < e["key"]) & holds(after, f, 3))
            return F.when(cuts < 0, cuts).when(holds(cuts, e, 3), F.when(missed, F.lit(-1).cast("long")).otherwise(after)).otherwise(cuts)

        return F.aggregate(edges, _bit(n + 1) - 1, step)

    def again(edges: Column) -> Column:
        def step(cuts: Column) -> Column:
            after = F.transform(F.filter(edges, lambda e: holds(cuts, e, 3)), lambda e: F.struct(e["key"], cuts.bitwiseAND(e["keep"]).alias("after")))
            # a negative number says that no edge is left
            return F.when(cuts < 0, cuts).otherwise(F.coalesce(F.array_min(after)["after"], -cuts))

        return F.abs(F.aggregate(F.sequence(F.lit(1), n), _bit(n + 1) - 1, lambda cuts, _: step(cuts)))

    def path(cuts: Column) -> Column:
        inside = lambda p: (cuts.bitwiseAND(_bit(at(p, END) + 1) - _bit(at(p, START))) == _bit(at(p, START)) + _bit(at(p, END)))
        found = F.transform(F.filter(packed, inside), lambda p: F.struct(at(p, START).cast("int").alias("start"), p.bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int").alias("id")))
        single = F.filter(F.sequence(F.lit(0), n - 1), lambda i: cuts.bitwiseAND(_bit(i) + _bit(i + 1)) == _bit(i) + _bit(i + 1))
        bare = F.transform(F.array_except(single, F.transform(found, lambda f: f["start"])), lambda i: F.struct(i.alias("start"), F.lit(-1).alias("id")))
        return F.array_sort(F.when(F.size(found) == F.bit_count(cuts) - 1, found).otherwise(F.concat(found, bare)))

    # arrays of one bind a value, so that it is worked out once
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    multi = F.transform(F.filter(F.sort_array(packed), lambda p: at(p, END) - at(p, START) > 1), opened)
    late = lambda edges: F.filter(edges, lambda e: F.shiftright(e["key"], ID_BITS).bitwiseAND(F.lit(1)) == 1)
    cuts = bound(multi, lambda edges: bound(bound(late(edges), lambda x: quick(edges, x)), lambda k: F.when(k < 0, again(edges)).otherwise(k)))
    return bound(cuts, path)


def segment(units: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, ids: the best segmentation of each distinct ``unit`` (of at most ``FOLDED`` characters)."""
    spark = units.sparkSession
    code = F.shiftleft(F.col("rank").cast("long"), RANK) + F.shiftleft(F.col("late").cast("long"), ID_BITS) + F.col("id")
    table = spark.createDataFrame(pieces.ranked(), "piece string, id int, score double, rank int, late boolean")
    table = table.select(F.xxhash64("piece").alias("key"), "piece", "id", "score", code.alias("code"))
    size = F.length("unit")
    # no two units are equal, so the hash only makes the grouping's sort cheap
    starts = units.select(F.xxhash64("unit").alias("h"), "unit", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    cuts = starts.select("h", "unit", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), size - F.col("start")))).alias("m"))
    cuts = cuts.withColumn("part", F.substring("unit", F.col("start") + 1, F.col("m")))
    end = F.col("start") + F.col("m")
    if pieces.merges:
        edge = F.col("code") + F.shiftleft(F.col("start").cast("long"), START) + F.shiftleft(end.cast("long"), END)
    else:
        edge = F.struct((end * PLACE + F.col("start")).alias("at"), "id", "score")
    edges = (
        # by a hash, as long keys join faster; the piece itself is compared as a range, which makes no second key
        cuts.join(F.broadcast(table), (F.xxhash64("part") == F.col("key")) & (F.col("part") <= F.col("piece")) & (F.col("part") >= F.col("piece")), "left")
        # one row without a piece stays for each unit, so that one of unknown characters is kept
        .filter(F.col("id").isNotNull() | (end == 1))
        .groupBy("h", "unit")
        .agg(F.collect_list(F.when(F.col("id").isNotNull(), edge)).alias("edges"))
    )
    path = _merged(size, F.col("edges")) if pieces.merges else _viterbi(size, F.col("edges"), pieces.unknown_score)
    found = edges.select("unit", path.alias("path"))
    byte_ids = F.array(*[F.lit(i) for i in pieces.bytes_])

    def spelled(x: Column) -> Column:
        code = F.hex(F.encode(F.substring("unit", x["start"] + 1, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: F.get(byte_ids, F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int")))

    plain = F.transform("path", lambda x: x["id"])
    full = F.flatten(F.transform("path", lambda x: F.when(x["id"] >= 0, F.array(x["id"])).otherwise(spelled(x))))
    return found.select("unit", F.when(F.exists("path", lambda x: x["id"] < 0), full).otherwise(plain).alias("ids"))


def finder(pieces: Pieces):
    """A function from a unit of any length to its ids, in space that is linear in it."""
    table = {p: (i, s, r) for p, i, s, r, _ in pieces.ranked()}
    longest, unknown = pieces.longest, pieces.unknown_score

    def spelled(found: Iterable[str]) -> list[int]:
        return [i for p in found for i in ((table[p][0],) if p in table else (pieces.bytes_[b] for b in p.encode()))]

    def viterbi(unit: str) -> list[int]:
        best, came = [0.0], [0]
        for end in range(1, len(unit) + 1):
            options = [(best[start] + table[unit[start:end]][1], start) for start in range(max(0, end - longest), end) if unit[start:end] in table]
            if unit[end - 1] not in table:
                options.append((best[end - 1] + unknown, end - 1))
            score, start = max(options)
            best.append(score)
            came.append(start)
        cuts = [len(unit)]
        while cuts[-1]:
            cuts.append(came[cuts[-1]])
        cuts.reverse()
        return spelled(unit[a:b] for a, b in zip(cuts, cuts[1:]))

    def merged(unit: str) -> list[int]:
        n = len(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of each open cut the next and the last one
        waiting: list[tuple[int, int, int, int]] = []

        def offer(start: int, middle: int) -> None:
            end = after[middle]
            if end - start <= longest and (found := table.get(unit[start:end])):
                heapq.heappush(waiting, (found[2], start, middle, end))

        for i in range(n - 1):
            offer(i, i + 1)
        closed = bytearray(n + 1)
        while waiting:
            _, start, middle, end = heapq.heappop(waiting)
            if closed[start] or closed[middle] or after[start] != middle or after[middle] != end:
                continue
            closed[middle] = 1
            after[start] = end
            if end < n:
                before[end] = start
                offer(start, end)
            if before[start] >= 0:
                offer(before[start], start)
        cuts = [i for i in range(n) if not closed[i]] + [n]
        return spelled(unit[a:b] for a, b in zip(cuts, cuts[1:]))

    return merged if pieces.merges else viterbi


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of some texts one after the other, coded, and how many each text has.

    Most texts are cut at single spaces, all at once; those with other blanks one by one.
    """
    odd = pc.fill_null(reduce(pc.or_, [pc.match_substring(texts, "  "), pc.match_substring(texts, BLANK), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.equal(texts, "")]), True)
    tokens = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    coded = tokens.flatten().dictionary_encode()
    coded = pa.DictionaryArray.from_arrays(coded.indices, pc.binary_join_element_wise(pa.scalar(BLANK), coded.dictionary.cast(pa.string()), pa.scalar("")))
    sizes, is_odd = np.zeros(len(texts), np.int64), np.asarray(odd)
    sizes[~is_odd] = np.diff(np.asarray(tokens.offsets))
    if is_odd.any():
        found = [words_of(text or "") for text in texts.filter(odd).to_pylist()]
        sizes[is_odd] = [len(words) for words in found]
        rest = pa.array([w for words in found for w in words], pa.string()).dictionary_encode()
        both = pa.chunked_array([coded, rest]).unify_dictionaries()
        # back to the order of the texts
        places, of_odd = np.empty(sizes.sum(), np.int32), np.repeat(is_odd, sizes)
        places[~of_odd], places[of_odd] = np.asarray(both.chunk(0).indices), np.asarray(both.chunk(1).indices)
        coded = pa.DictionaryArray.from_arrays(pa.array(places), both.chunk(0).dictionary)
    return coded, sizes


def _sliced(batch: pa.RecordBatch, texts: pa.Array, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Slices of a batch with about ``most`` bytes of text, and those bytes."""
    ends, begin = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64) + 8), 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(begin, end - begin), int(ends[end - 1] - before)
        begin = end


def _packed(docs: DataFrame, text_col: str, bucket: int) -> DataFrame:
    """bucket, rows: compressed slices of ``docs``, dealt out by bucket."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        number, filled, squeeze = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(6)
        for batch in batches:
            for part, size in _sliced(batch, batch.column(at)):
                if filled and filled + size > bucket:
                    number, filled = number + 1, 0
                filled += size
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([squeeze.compress(sink.getvalue())], pa.binary())], ["bucket", "rows"])

    return docs.mapInArrow(run, "bucket long not null, rows binary not null").repartition("bucket")


def _unpacked(rows: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows.as_py())).read_next_batch()


def _bucket_units(packed: DataFrame, shared: Broadcast, at: int) -> DataFrame:
    """bucket, unit: the distinct units of each bucket; its words are cut once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        rows = ((bucket, packet) for batch in batches for bucket, packet in zip(batch.column(0).to_pylist(), batch.column(1)))
        for bucket, packets in groupby(rows, lambda r: r[0]):
            words = pa.array([], pa.string())
            waiting: list[pa.Array] = []
            for _, packet in packets:
                waiting.append(_words(_unpacked(packet).column(at))[0].dictionary)
                if sum(map(len, waiting)) > WORDS_WAITING:
                    words, waiting = pc.unique(pa.chunked_array([words, *waiting])), []
            units = pc.unique(shared.value.cut(pc.unique(pa.chunked_array([words, *waiting])))[0])
            units = units.filter(pc.less_equal(pc.utf8_length(units), FOLDED))
            del words, waiting
            for k in range(0, len(units), UNITS_SENT):
                part = units.slice(k, UNITS_SENT)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bucket)), part], ["bucket", "unit"])
            del units
        give_back()

    return packed.sortWithinPartitions("bucket").mapInArrow(run, "bucket long not null, unit string not null")


@dataclass(frozen=True)
class _Known:
    """The ids of units, in Arrow; those of long units are found when asked for."""

    units: pa.Array
    ids: pa.ListArray
    find: Callable[[str], list[int]]

    def of(self, asked: pa.Array) -> pa.ListArray:
        place, ids = pc.index_in(asked, self.units), self.ids
        if place.null_count:
            missing = pc.unique(asked.filter(place.is_null()))
            if short := [u for u in missing.to_pylist() if len(u) <= FOLDED]:
                raise KeyError(short[0])
            ids = pa.concat_arrays([ids, pa.array([self.find(u) for u in missing.to_pylist()], ids.type)])
            place = pc.coalesce(place, pc.add(pc.index_in(asked, missing), pa.scalar(len(self.units), pa.int32())))
        return ids.take(place)


class _Encoder:
    """The ids of the texts of a bucket, whose distinct words are cut and looked up once."""

    def __init__(self, texts: Iterable[pa.Array], known: _Known, cut: Callable[[pa.Array], tuple[pa.Array, np.ndarray]]) -> None:
        found = [_words(t) for t in texts]
        coded = pa.chunked_array([c for c, _ in found], pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
        self.places = [c.indices for c in coded.chunks]
        self.ends = [np.concatenate([[0], np.cumsum(sizes)]) for _, sizes in found]
        words = coded.chunk(0).dictionary if found else pa.array([], pa.string())
        del found, coded
        give_back()
        units, counts = cut(words)
        ids = known.of(units)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(), dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        self.of_word = pa.LargeListArray.from_arrays(pa.array(ends), ids.flatten())

    def ids(self, k: int, start: int, texts: pa.Array) -> pa.ListArray:
        """The ids of ``texts``, which are those of the array ``k`` from ``start`` on."""
        ends = self.ends[k][start : start + len(texts) + 1]
        of_place = self.of_word.take(self.places[k].slice(ends[0], ends[-1] - ends[0]))
        bounds = np.asarray(of_place.offsets)[ends - ends[0]] if len(of_place) else np.zeros(len(texts) + 1, np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), of_place.flatten().cast(pa.int32()), mask=texts.is_null())


def _put_together(docs: DataFrame, pieces: Pieces, text_col: str, bucket: int, kept: list[str], added: list[tuple[str, T.DataType]], make: Callable, worked: int = SLICE) -> DataFrame:
    """The ``kept`` columns plus the ``added`` ones, which ``make`` gives for a slice of texts and their ids."""
    shared, at = docs.sparkSession.sparkContext.broadcast(pieces), docs.columns.index(text_col)
    packed = _packed(docs, text_col, bucket)
    units = _bucket_units(packed, shared, at).repartition("unit")
    # all columns and a number, so that no filter or projection of the lattice moves below the exchange
    # of the units, and it serves both sides
    distinct = units.withColumn("number", F.monotonically_increasing_id()).groupBy("unit").agg(F.min(F.struct("number", "bucket")).alias("number")).filter("number is not null")
    narrow = "array<short>" if len(pieces.strings) < 1 << 15 else "array<int>"
    found = units.join(segment(distinct, pieces), "unit").withColumn("ids", F.col("ids").cast(narrow))
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, t) for n, t in added)])
    places = [docs.columns.index(c) for c in kept]

    def run(mine: pa.Table, dictionary: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        of_unit = pa.list_(pa.int16() if narrow == "array<short>" else pa.int32())
        known = _Known(pa.concat_arrays([pa.array([], pa.string()), *dictionary.column("unit").chunks]), pa.concat_arrays([pa.array([], of_unit), *(c.cast(of_unit) for c in dictionary.column("ids").chunks)]), finder(shared.value))
        # packets are opened twice, so that one is held at a time
        encoder = _Encoder((_unpacked(rows).column(at) for rows in mine.column("rows")), known, shared.value.cut)
        del known
        give_back()
        out = []
        for k, rows in enumerate(mine.column("rows")):
            packet, start = _unpacked(rows), 0
            for part, _ in _sliced(packet, packet.column(at), worked):
                texts = part.column(at)
                made = make(texts, encoder.ids(k, start, texts), shared.value)
                start += len(part)
                # columns are copied, so that none keeps the whole packet
                out.append(pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(range(len(part)))) for i in places), *made], [f.name for f in schema]))
                del part, texts, made
            del packet
            give_back()
        del encoder
        give_back()
        return pa.Table.from_batches(out)

    return packed.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, schema)


_IDS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", ids_col: str = "ids", bucket: int = BUCKET) -> DataFrame:
    """``docs`` plus ``ids_col``: the piece ids of its whole texts."""
    kept = without(docs.columns, ids_col)
    return _put_together(docs, pieces, text_col, bucket, kept, [(ids_col, _IDS)], lambda texts, ids, _: [ids])


def _decoded(ids: pa.ListArray, pieces: Pieces) -> pa.Array:
    """The texts of ids. Bytes that are no UTF-8 become U+FFFD."""
    flat, ends = pieces.raw.take(ids.flatten()), np.asarray(ids.offsets)
    sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(flat)), dtype=np.int64)])
    raw = b"".join(flat.to_pylist()) if flat.offset else flat.buffers()[2].to_pybytes()[: sizes[-1]] if len(flat) else b""
    bounds = sizes[ends - ends[0]]
    missing = np.asarray(ids.is_null())
    joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(bounds.astype("<i8").tobytes()), pa.py_buffer(raw)])
    try:
        texts = joined.cast(pa.large_string())
    except pa.ArrowInvalid:
        texts = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.large_string())
    texts = pc.replace_substring_regex(pc.replace_substring(texts, BLANK, " "), "^ ", "")
    return pc.if_else(pa.array(missing), pa.scalar(None, pa.large_string()), texts).cast(pa.string())


def decode(docs: DataFrame, pieces: Pieces, ids_col: str = "ids", text_out: str = "decoded") -> DataFrame:
    """``docs`` plus the text of its ids; null ids have null text."""
    kept = [docs.schema[c] for c in without(docs.columns, text_out)]
    names, schema = [f.name for f in kept], T.StructType([*kept, T.StructField(text_out, T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = _decoded(part.column(part.schema.get_field_index(ids_col)), shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), texts], [*names, text_out])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "round_trip", bucket: int = BUCKET, worked: int = SLICE) -> DataFrame:
    """``docs`` without the text, plus ids and whether they decode to the text (true for a null text).

    ``worked``: bytes of text whose ids are made and decoded at once; fewer take less memory and a little more time.
    """

    def make(texts: pa.Array, ids: pa.ListArray, pieces: Pieces) -> list[pa.Array]:
        return [ids, pc.fill_null(pc.equal(_decoded(ids, pieces), texts), True)]

    kept = without(docs.columns, text_col, ids_col, out_col)
    return _put_together(docs, Pieces.load(path), text_col, bucket, kept, [(ids_col, _IDS), (out_col, T.BooleanType())], make, worked)
