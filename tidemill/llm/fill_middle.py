"""Fill-in-the-middle transformation with a sparse checkpoint index.

A text is a row of units, runs of ASCII letters and single other code points. One pass
over its UTF-8 bytes counts them and notes, every ``STEP`` units, the byte and the code
point where the unit begins. The places of two cuts are drawn from a hash of the document's
id and the number of units; for each a binary search finds the checkpoint before it, and
a short second scan from there the cut itself. So a text is scanned once, and what is
remembered of it are three numbers a checkpoint, whatever the units' lengths.

The parts are put in the order prefix, suffix, middle (``psm``) or suffix, prefix, middle
(``spm``), each after its mark. A text that has a mark itself, an empty one and a share of
all others stay as they are (``plain``). ``restored`` gives the text back from what was
written and its form alone: no mark can begin inside another one or in the text, so the
first of each kind is the one that was put there.

Defined results: a null text counts as empty; a null id counts as the empty string where it
is hashed; equal ids are cut by the same draws; rows are independent, so repeated rows give
repeated rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import words

#: Units from one checkpoint to the next, and bytes that are looked at together.
STEP, WINDOW = 256, 1 << 18
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, how many change, and how many of these have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
SEED = "1:"


def begins(data: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Whether each byte begins a unit, whether it begins a code point, and whether the last one is a letter."""
    letter = ((data | 32) - np.uint8(97)) < 26
    head = (data & 0xC0) != 0x80
    inside = np.empty(len(data), bool)
    inside[:1] = after_letter
    inside[1:] = letter[:-1]
    return head & ~(letter & inside), head, bool(letter[-1])


class Checkpoints:
    """The units of a text: their number, and a checkpoint every ``step`` of them."""

    def __init__(self, text: bytes, step: int = STEP, window: int = WINDOW):
        self.data, self.window = np.frombuffer(text, np.uint8), window
        self.unit, self.byte, self.char = [], [], []
        self.units = self.chars = 0
        letter = False
        for at in range(0, len(self.data), window):
            starts, heads, letter = begins(self.data[at : at + window], letter)
            place = np.flatnonzero(starts)
            chosen = place[-self.units % step :: step]
            if len(chosen):
                self.byte += (at + chosen).tolist()
                self.char += (self.chars + np.cumsum(heads)[chosen] - 1).tolist()
                first = self.units + -self.units % step
                self.unit += range(first, first + step * len(chosen), step)
            self.units += len(place)
            self.chars += int(np.count_nonzero(heads))

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code point where ``unit`` begins; the text's end if there are no more."""
        if unit >= self.units:
            return len(self.data), self.chars
        k = bisect_right(self.unit, unit) - 1
        byte, char, left = self.byte[k], self.char[k], unit - self.unit[k]
        stop = self.byte[k + 1] if k + 1 < len(self.byte) else len(self.data)
        letter, size = False, 4 * (left + 1)
        while byte < stop:  # a few bytes at first; a window each if the units are long
            starts, heads, letter = begins(self.data[byte : min(stop, byte + size)], letter)
            place = np.flatnonzero(starts)
            if left < len(place):
                at = int(place[left])
                return byte + at, char + int(np.count_nonzero(heads[:at]))
            left, char, byte = left - len(place), char + int(np.count_nonzero(heads)), byte + len(starts)
            size = self.window
        raise AssertionError("a unit lies before the next checkpoint")


def draws(doc_id: object) -> list[int]:
    """Four numbers below 2^32 from an id."""
    digest = hashlib.sha256(f"{SEED}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def form_of(text: bytes, numbers: list[int]) -> str:
    if not text or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)) or numbers[2] % 100 >= CHANGED:
        return "plain"
    return "spm" if numbers[3] % 100 < SUFFIX_FIRST else "psm"


def transform(docs: DataFrame, step: int = STEP) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row; see the module for the defined results."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
        for batch in batches:
            for part in words.slices(batch, "text"):
                rows = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), words.texts(part, "text").cast(pa.binary()).to_pylist(), strict=True):
                    points, numbers = Checkpoints(text, step), draws(doc_id)
                    form = form_of(text, numbers)
                    if form == "plain":
                        rows.append((points.units, form, None, None, text))
                        continue
                    (a, first), (b, last) = (points.cut(u) for u in sorted(x % (points.units + 1) for x in numbers[:2]))
                    prefix, middle, suffix = (marks[0], text[:a]), (marks[2], text[a:b]), (marks[1], text[b:])
                    order = (prefix, suffix, middle) if form == "psm" else (suffix, prefix, middle)
                    rows.append((points.units, form, first, last - first, b"".join(x for pair in order for x in pair)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], names=names)

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return given.mapInArrow(words.returning(work), f"doc_id {doc_id}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again, from what was written and its form."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands after the mark ``first``, after ``second`` and after that of the middle."""
        a = F.substring_index(F.substring(output, len(first) + 1, 2**31 - 1), second, 1)
        rest = F.substr(output, F.length(a) + len(first) + len(second) + 1)
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substr(rest, F.length(b) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_first, prefix_last, middle_last = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_last, middle_last, suffix_first)).otherwise(output)
