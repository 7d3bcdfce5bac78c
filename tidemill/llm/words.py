"""Fast access to the words of Arrow text batches.

A batch of texts is split into pieces by Arrow, each distinct piece is looked at
once, and the result is spread over the batch with numpy. What is known about a
piece stays with the Python worker between batches and tasks, up to a number of
bytes; what a task has freed goes back to the system when it ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are held split at a time, unless one text has more.
SLICE_BYTES = 4 << 20
#: Bytes of what a worker remembers of distinct pieces; then it starts afresh. An entry costs so much besides its text.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 230
#: A blank inside or at the end of a longer run of white space: such texts are not split at blanks.
_RUN = r"[\s\pZ\x{0b}\x{1c}-\x{1f}\x{85}] (?:[\s\pZ\x{0b}\x{1c}-\x{1f}\x{85}]|\z)"


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, in slices of about ``limit`` bytes of ``column``."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column with null as empty."""
    return pc.fill_null(batch[column].cast(pa.string()), "")


def split(array: pa.Array, by: str | None = " ") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces, the piece number of each position, and the first position of each text (and the end).

    ``by`` None splits at runs of ASCII white space (the empty pieces at a text's edges stay).
    """
    parts = pc.ascii_split_whitespace(array) if by is None else pc.split_pattern(array, by)
    coded = parts.flatten().dictionary_encode()
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.concatenate(([0], ends))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def returning(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` as a task that gives freed memory back at its end, so that a worker doesn't keep the peak of each stage it served."""

    def task(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return task


_held: list = []


def hold(cache) -> None:
    """Only one cache of a worker is filled at a time: when another one is used, it forgets."""
    if _held and _held[0] is not cache:
        _held.pop().forget()
    if not _held:
        _held.append(cache)


class ChunkEncoder:
    """Token ids of texts by a tokenizer whose tokens never run across a blank that follows a non-blank.

    ``encode`` turns a list of strings into a list of id lists. Texts are cut
    before each blank, distinct chunks are encoded once and remembered. A text in
    which a blank stands inside a longer run of white space is encoded whole, so
    the ids always equal those of the whole text.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], lead: Callable[[list[str]], list[list[int]]] | None = None, run: str = _RUN):
        self.encode, self.lead, self.run = encode, lead or encode, run
        self.owner, self.limit = self, CACHE_BYTES
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str | tuple[str], int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used, self.count, self.bytes = 0, 0, 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _add(self, found: list[list[int]] | tuple[np.ndarray, np.ndarray]) -> None:
        """``found`` is a list for each string, or all ids in one array and the number of each."""
        if isinstance(found, list):
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            found = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes
        ids, sizes = found
        total = len(ids)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.count + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        at = slice(self.count, self.count + len(sizes))
        self.size[at] = sizes
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + total] = ids
        self.used, self.count = self.used + total, self.count + len(sizes)
        self.bytes += 4 * total + ENTRY_BYTES * len(sizes)

    def _slots(self, keys: list, encode: Callable) -> np.ndarray:
        get = self.slot.get
        out = np.fromiter(map(get, keys, repeat(-1)), np.int64, len(keys))
        at = np.flatnonzero(out < 0)
        if len(at):
            wanted = list(map(keys.__getitem__, at.tolist()))
            missing = list(dict.fromkeys(wanted))
            first = self.count
            self._add(encode(missing))
            self.slot.update(zip(missing, range(first, self.count), strict=True))
            self.bytes += sum(map(len, missing)) if isinstance(missing[0], str) else sum(len(k) for (k,) in missing)
            out[at] = np.arange(first, self.count) if len(missing) == len(wanted) else list(map(get, wanted))
        return out

    def __call__(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins in it (and the end)."""
        hold(self.owner)
        if self.bytes > self.limit:
            self.forget()
        whole = pc.match_substring_regex(array, self.run).to_numpy(zero_copy_only=False)
        if whole.any():
            parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(array)
            for i in np.flatnonzero(whole):
                parts[i] = np.asarray(self.lead([array[int(i)].as_py()])[0], np.uint32)
            rest = np.flatnonzero(~whole)
            ids, ends = self(array.take(pa.array(rest))) if len(rest) else (parts[0], np.zeros(1, np.int64))
            for k, i in enumerate(rest):
                parts[i] = ids[ends[k] : ends[k + 1]]
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
        pieces, index, begin = split(array)
        # A piece that follows a blank takes it along; a text's first piece has a key of another kind.
        slots = self._slots(pieces, lambda keys: self.encode([" " + k for k in keys]))[index] if len(index) > len(array) else np.zeros(len(index), np.int64)
        heads = [(pieces[i],) for i in index[begin[:-1]]]
        slots[begin[:-1]] = self._slots(heads, lambda keys: self.lead([k for (k,) in keys]))
        sizes = self.size[slots]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.pool[spread(self.start[slots], sizes)], ends[begin]
