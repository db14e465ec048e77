"""Fill-in-the-middle: a text is cut twice at token borders and its middle moved to the end.

Tokens are ``[A-Za-z]+|[^A-Za-z]``, so one starts wherever a character is no letter, or is a letter
after a character that is none. That looks at two adjacent characters only; over UTF-8 the same holds
of bytes, leaving out those that continue a character.

Every text is laid out in chunks of ``chunk`` bytes, each seen with the byte before it. The starts of
all chunks of a batch are counted at once; running sums of the counts tell which chunk owns the rank
of each cut, and only those chunks are looked at again. A text is one value of one row, so its chunks
stay in the task that read it and nothing is shuffled.

Forms: ``plain`` leaves the text, ``psm`` gives ``<P>``prefix``<S>``suffix``<M>``middle, ``spm`` gives
``<S>``suffix``<P>``prefix``<M>``middle. A text that contains a mark stays plain, so ``restored`` is exact.

Defined cases: a null text is an empty one, and empty texts are plain; a null id draws as the empty
string does; equal ids draw alike; texts of any length are cut whole; an empty table gives none;
columns of the caller with names of the result, in any case of letters, are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices

MARKS = ("<P>", "<S>", "<M>")
_P, _S, _M = (m.encode() for m in MARKS)
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")
_OUT = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])

#: Whether a byte is a letter, and whether it begins a character.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document: the first groups of a digest of the seed and its id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


class Chunks:
    """Token starts and characters of a byte string by chunk, with their running sums."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, chunk: int) -> None:
        self.data, self.begins, self.ends, self.chunk = data, begins, ends, chunk
        per_text = -(-(ends - begins) // chunk)
        self.first = np.concatenate([[0], np.cumsum(per_text)])  # a text's first chunk
        owner = np.repeat(np.arange(len(begins)), per_text)
        self.at = begins[owner] + (np.arange(len(owner)) - self.first[owner]) * chunk
        self.to = np.minimum(self.at + chunk, ends[owner])
        counts = np.array([self._count(i, o) for i, o in enumerate(owner)], np.int64).reshape(-1, 2)
        self.sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(counts, axis=0)])

    def _marks(self, i: int, text: int) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes of a chunk start a token, and which begin a character."""
        at, to = self.at[i], self.to[i]
        seen = self.data[max(at - 1, 0) : to]  # the chunk and the byte before it
        letter, own = _LETTER[seen], seen[at - max(at - 1, 0) :]
        before = letter[:-1] if at else np.concatenate([[False], letter[:-1]])
        leads = _LEADS[own]
        starts = leads & ~(letter[len(seen) - len(own) :] & before)
        if at == self.begins[text]:  # what is before belongs to another text
            starts[0] = True
        return starts, leads

    def _count(self, i: int, text: int) -> tuple[int, int]:
        starts, leads = self._marks(i, text)
        return np.count_nonzero(starts), np.count_nonzero(leads)

    def tokens(self, text: int) -> int:
        return int(self.sums[self.first[text + 1], 0] - self.sums[self.first[text], 0])

    def cut(self, text: int, rank: int) -> tuple[int, int]:
        """Bytes and characters of a text before its token number ``rank``, counted from 0; all of it at the end."""
        low, high = self.first[text], self.first[text + 1]
        base = self.sums[low]
        if rank >= self.sums[high, 0] - base[0]:
            return int(self.ends[text] - self.begins[text]), int(self.sums[high, 1] - base[1])
        i = low + int(np.searchsorted(self.sums[low + 1 : high + 1, 0] - base[0], rank, side="right"))
        starts, leads = self._marks(i, text)
        place = int(np.flatnonzero(starts)[rank - (self.sums[i, 0] - base[0])])
        return int(self.at[i] - self.begins[text]) + place, int(self.sums[i, 1] - base[1]) + int(np.count_nonzero(leads[:place]))


def _form(text: bytes, h3: int, h4: int, plain_percent: int, spm_percent: int) -> str:
    if not text or h3 % 100 >= 100 - plain_percent or any(m in text for m in (_P, _S, _M)):
        return "plain"
    return "spm" if h4 % 100 < spm_percent else "psm"


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, chunk: int = 1 << 16
) -> DataFrame:
    """``docs`` with ``RESULT``: tokens, form, characters of prefix and middle (null if plain), and the output text.

    The cuts fall after as many tokens as two draws of the id and ``seed`` say, the form on two more.
    """
    keep = [c for c in docs.columns if c.lower() not in RESULT]
    key, text = free_name(docs.select(*keep), "key_", "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
            ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            chunks = Chunks(data, ends[:-1], ends[1:], chunk)
            rows = []
            for i, doc_id in enumerate(batch.column(batch.schema.get_field_index(key)).to_pylist()):
                h1, h2, h3, h4 = draws(doc_id, seed)
                whole, n = data[ends[i] : ends[i + 1]].tobytes(), chunks.tokens(i)
                form = _form(whole, h3, h4, plain_percent, spm_percent)
                if form == "plain":
                    rows.append((n, form, None, None, whole))
                    continue
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                (a, a_chars), (b, b_chars) = chunks.cut(i, low), chunks.cut(i, high)
                head = (_P, whole[:a], _S, whole[b:]) if form == "psm" else (_S, whole[b:], _P, whole[:a])
                rows.append((n, form, a_chars, b_chars - a_chars, b"".join((*head, _M, whole[a:b]))))
            made = [pa.array(c, f.type if f.name != "output" else pa.large_binary()) for c, f in zip(zip(*rows), _OUT)]
            made[-1] = made[-1].cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], [*keep, *RESULT])

    wide = docs.select(*keep, F.col(id_col).cast("long").alias(key), F.coalesce(text_col, F.lit("")).alias(text))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return wide.mapInArrow(run, f"{kinds}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    p, s, m = (F.lit(x) for x in MARKS)
    head, middle = F.substring_index(output, MARKS[2], 1), F.substring_index(output, MARKS[2], -1)
    first = lambda mark: F.substr(F.substring_index(head, mark, 1), F.lit(4))
    last = lambda mark: F.substring_index(head, mark, -1)
    return (
        F.when(form == "psm", F.concat(first(MARKS[1]), middle, last(MARKS[1])))
        .when(form == "spm", F.concat(last(MARKS[0]), middle, first(MARKS[0])))
        .otherwise(output)
    )
