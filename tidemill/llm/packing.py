"""Best-fit packing of token pieces into sequences of fixed capacity.

Documents become token pieces; the number of pieces of each length is a
histogram of at most ``capacity`` bins. A configuration linear program over it
(which multisets of lengths fill a sequence, and how often each is used) is
solved by multiplicative weights: each length has a price that falls as it gets
covered, and a knapsack dynamic program finds the dearest configurations. The
solution is rounded down and what is left is packed best-fit decreasing; if all pieces
packed best-fit decreasing need fewer sequences, that plan is taken. The pieces of
each length are dealt to the slots by rank.

Only the histogram and the configurations, both bounded by the capacity, are on
the driver; pieces stay on the executors.

Defined results: a null or empty text is one piece of length 1 (the end id
alone); a document longer than the capacity is cut, all but its first piece full;
repeated rows and equal or null doc_ids are packed row by row; an empty table
gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import scratch, words

CAPACITY = 2048
#: Rows of one length are ranked in parts of so many at least, and of the square root of their number, so that a
#: frequent length is spread, and its parts are no more than a part has rows.
PART_ROWS = 1000
#: Rounds of the multiplicative weights, and how fast a price falls with coverage.
ROUNDS, RATE = 48, 6.0

#: Chunks that are encoded in one string.
TOGETHER = 500

_encoders: dict[str, words.ChunkEncoder] = {}


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> words.ChunkEncoder:
    """The byte-level BPE tokenizer of ``path`` behind a cache of chunks; the text of a special token is ordinary text.

    Chunks are encoded many in one string: each begins with a blank, and so does its first
    token and no other one, which tells where its ids begin.
    """
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        blank = np.zeros(tok.get_vocab_size(), bool)
        blank[[i for token, i in tok.get_vocab().items() if token.startswith("Ġ")]] = True

        def apart(found: list[str]) -> list[list[int]]:
            return [e.ids for e in tok.encode_batch_fast(found, add_special_tokens=False)]

        def together(found: list[str]) -> list[list[int]] | tuple[np.ndarray, np.ndarray]:
            if " " in found:  # a blank at a text's end, which would join the next chunk
                return apart(found)
            joined = ["".join(found[k : k + TOGETHER]) for k in range(0, len(found), TOGETHER)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(joined, add_special_tokens=False)])
            first = np.flatnonzero(blank[ids])
            return (ids, np.diff(np.append(first, len(ids)))) if len(first) == len(found) and not first[0] else apart(found)

        _encoders[path] = words.ChunkEncoder(together, apart)
    return _encoders[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document."""
    path = tokenizer or byte_bpe_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in words.slices(batch, "text"):
                ids, begin = encode(words.texts(part, "text"))
                # one end id after each document
                ids = np.insert(ids.astype("<u4"), begin[1:], end_id)
                begin = begin + np.arange(len(begin))
                size = np.diff(begin)
                count = -(-size // capacity)
                number = words.spread(np.zeros(len(count), np.int64), count)
                row = np.repeat(np.arange(len(size)), count)
                first = size[row] - (count[row] - 1) * capacity
                start = np.where(number == 0, 0, first + (number - 1) * capacity)
                length = np.where(number == 0, first, capacity)
                raw, at = memoryview(ids.tobytes()), (begin[row] + start) * 4
                crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(words.returning(cut), schema)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room, the best total price of lengths that fit (each any number of times) and a length to take first (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        if fits[room]:
            worth = best[room - lengths[: fits[room]]] + prices[: fits[room]]
            k = len(worth) - 1 - int(worth[::-1].argmax())  # of equal ones the longest, so that short lengths are left to fill up with
            best[room], take[room] = worth[k], lengths[k]
    return best, take


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[tuple[int, ...], int]]:
    """Multisets of lengths with how often each is used; together they hold ``histogram`` exactly."""
    out = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    lengths = np.array(sorted(n for n, k in histogram.items() if 0 < n < capacity and k), np.int64)
    if not len(lengths):
        return out
    need = np.array([histogram[n] for n in lengths.tolist()], float)
    place = {n: i for i, n in enumerate(lengths.tolist())}
    covered, used = np.zeros(len(need)), {}
    for t in range(1, rounds + 1):
        prices = lengths / capacity * np.exp(-rate * (covered / need - t / rounds))
        _, take = knapsack(lengths, prices, capacity)
        for i in range(len(lengths) - 1, -1, -1):
            short = need[i] * t / rounds - covered[i]
            if short <= 0:
                continue
            items, room = [int(lengths[i])], capacity - int(lengths[i])
            while room and take[room]:
                items.append(int(take[room]))
                room -= items[-1]
            held, times = np.unique(items, return_counts=True)
            at = np.array([place[n] for n in held.tolist()])
            amount = min(short / times[at == i][0], *((need[at] - covered[at]) / times)) if len(at) > 1 else short / times[0]
            if amount <= 0:  # a partner is used up: the length alone, with what still fits, is left to the rounding
                continue
            covered[at] += amount * times
            key = tuple(sorted(items, reverse=True))
            used[key] = used.get(key, 0.0) + amount
    left = {n: int(k) for n, k in zip(lengths.tolist(), need.tolist(), strict=True)}
    for key in sorted(used, key=lambda x: (capacity - sum(x), -used[x], x)):
        held, times = np.unique(key, return_counts=True)
        n = min(int(used[key] + 1e-9), *(left[a] // b for a, b in zip(held.tolist(), times.tolist(), strict=True)))
        if n > 0:
            out.append((key, n))
            for a, b in zip(held.tolist(), times.tolist(), strict=True):
                left[a] -= n * b
    solved, plain = out + best_fit(left, capacity), best_fit(histogram, capacity)
    # rounding may cost more than the program gains, as where lengths are so spread that best-fit leaves next to nothing
    return min(solved, plain, key=lambda plan: sum(times for _, times in plan))


def least_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """A bound from below: as many sequences as the tokens fill, and no fewer than pieces of over half the capacity."""
    return max(-(-sum(n * k for n, k in histogram.items()) // capacity), sum(k for n, k in histogram.items() if 2 * n > capacity))


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal sequences are handled together."""
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for n in sorted((n for n, k in histogram.items() if k), reverse=True):
        k = histogram[n]
        for room in range(n, capacity + 1):
            while k and rooms[room]:
                key, there = rooms[room].popitem()
                moved = min(k, there)
                if there > moved:
                    rooms[room][key] = there - moved
                rooms[room - n][(*key, n)] = rooms[room - n].get((*key, n), 0) + moved
                k -= moved
            if not k:
                break
        while k:
            each = min(capacity // n, k)
            many = k // each
            key = (n,) * each
            rooms[capacity - n * each][key] = rooms[capacity - n * each].get(key, 0) + many
            k -= many * each
    return [(key, k) for room in rooms for key, k in room.items()]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank, the first sequence and the offset of each run of slots."""
    runs: dict[int, list[tuple[int, int]]] = {}
    taken: dict[int, list[int]] = {}
    base = 0
    for items, times in plan:
        offset = 0
        for n in items:
            runs.setdefault(n, []).append((base, offset))
            taken.setdefault(n, [0]).append(taken[n][-1] + times if n in taken else times)
            offset += n
        base += times
    return {n: (np.array(taken[n][:-1]), *np.array(x, np.int64).T) for n, x in runs.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Every piece with its ``sequence_id`` and its ``offset`` there; see the module for the method and the defined results.

    Reads the texts once; the table of pieces (five numbers each) goes to the shared folder.
    """
    cut = scratch.table(pieces(docs, capacity, tokenizer, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    table = slots(configurations(histogram, capacity))

    # A length has as many parts as its pieces need; the map has an entry for each frequent length.
    many = {n: -(-k // max(PART_ROWS, math.isqrt(k))) for n, k in histogram.items() if k > PART_ROWS}
    parts = F.coalesce(F.create_map(*(F.lit(x) for pair in many.items() for x in pair))[F.col("length")], F.lit(1)) if many else F.lit(1)
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), parts).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                first, base, at = table[n]
                run = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = base[run] + rank[rows] - first[run], at[run]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(*kept, "rank").mapInArrow(place, f"doc_id {doc_id}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
