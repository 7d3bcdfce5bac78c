"""Exact top-k search by inner product, a block of rows at a time.

Vectors become integers, ``floor(256 * x)`` of each component. Rows are put in the order of
their nearest pivots and cut into blocks of ``BLOCK`` rows. A block has a forward index, the
integers of its rows, and the largest and smallest value of each term (dimension), so that
no row of it scores more for a query than the sum of the query's values times these maxima.
For each query the blocks are taken in the order of that sum and scored through their forward
index, until the bound falls below the k-th best score so far.

A query first meets the blocks of its own range, where rows like it are; its k-th score there
goes along to all others. Work is cut into units of about ``UNIT`` blocks and tiles of about
``TILE`` queries, and a task holds one of each, whatever the number of rows; a unit returns at
most k rows for a query, none below its k-th score, and these are merged. On vectors without
structure the bounds of dense blocks seldom fall below the k-th score; then all blocks are
scored, by a matrix product each.

Rows with the same id and vector are one row with a number of copies, so a third of all rows
may be copies of one. The pivots are ``PIVOTS`` rows with the smallest hashes; they decide on
the order of rows alone, never on a result.

Defined results: a null vector or one with a null or non-finite component takes no part, also
not as a query; an empty vector scores 0; of vectors of different length, what one lacks counts
as 0; components beyond 65536 either way count as that; a row without an id is a candidate, after
those with one among equals, and as a query only if the condition says so; of repeated rows each
is a query and each a candidate but for the query's own; fewer than k other rows give fewer
results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import scratch, words

#: Rows of a block, blocks of a range and of a unit (about), queries of a tile (about), rows that order the others.
BLOCK, RANGE, UNIT, TILE, PIVOTS = 64, 64, 64, 1024, 64
#: A component becomes floor(SCALE * x), within LARGEST either way, so that sums stay exact in 64 bits.
SCALE, LARGEST = 256, 1 << 24


def matrix(packed: list[bytes], width: int | None = None) -> np.ndarray:
    """Rows of little-endian 32-bit integers, filled up with zeros to the longest or to ``width``."""
    rows = [np.frombuffer(x, "<i4") for x in packed]
    width = max([width or 0, *map(len, rows)])
    if rows and all(len(x) == width for x in rows):
        return np.stack(rows)
    out = np.zeros((len(rows), width), np.int32)
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def exact(*parts: np.ndarray) -> type:
    """The fastest kind of number in which inner products of ``parts`` are exact."""
    most = max((int(np.abs(x).max()) for x in parts if x.size), default=0)
    total = most * most * max([1, *(x.shape[-1] for x in parts)])
    return np.float32 if total < 1 << 24 else np.float64 if total < 1 << 53 else np.int64


def integers(embeddings: DataFrame, queries: Column) -> DataFrame:
    """``vec_id, vector, asks, copies``: the distinct rows that take part, their integers as bytes, and whether they are queries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            flat = lists.flatten()
            whole = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
            values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            bad = np.append(0, np.cumsum(~np.isfinite(values)))
            keep = (bad[whole[1:]] == bad[whole[:-1]]) & ~lists.is_null().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore"):
                scaled = np.clip(np.floor(SCALE * np.clip(np.nan_to_num(values), -LARGEST, LARGEST)), -LARGEST, LARGEST).astype("<i4")
            at = np.flatnonzero(keep)
            vectors = [scaled[whole[i] : whole[i + 1]].tobytes() for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(at)), pa.array(vectors, pa.binary()), batch["asks"].take(pa.array(at))], names=["vec_id", "vector", "asks"])

    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
    return given.mapInArrow(work, "vec_id long, vector binary, asks boolean").groupBy("vec_id", "vector", "asks").agg(F.count("*").alias("copies"))


def blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of neighbouring rows: ``block, range, vec_ids, asks, copies, data, high, low`` (the last three as 32-bit integers)."""
    first = vectors.orderBy(F.xxhash64("vec_id", "vector"), "vec_id", "vector").limit(PIVOTS).select("vector").collect()
    found = matrix(sorted({bytes(r.vector) for r in first})).astype(float)
    found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the numbers of the two pivots with the smallest angles."""
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch["vector"].to_pylist(), found.shape[1]).astype(float)
            pivots = np.pad(found, ((0, 0), (0, rows.shape[1] - found.shape[1])))
            best = np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :2]
            code = best[:, 0] * PIVOTS + best[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(np.int32))], names=[*batch.schema.names, "code"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number, held = TaskContext.get().partitionId() << 36, 0, []

        def packed(rows: list) -> tuple:
            values = matrix([r[1] for r in rows])
            return base + number, (base + number) // RANGE, *map(list, ([r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows])), values.tobytes(), values.max(0).tobytes(), values.min(0).tobytes()

        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            done, rows = [], zip(*(batch[c].to_pylist() for c in ("vec_id", "vector", "asks", "copies")), strict=True)
            for row in rows:
                held.append(row)
                if len(held) == BLOCK:
                    done.append(packed(held))
                    number, held = number + 1, []
            yield _batch(done, kinds, INDEX)
        if held:
            yield _batch([packed(held)], kinds, INDEX)

    dealt = F.xxhash64("vec_id", "vector")  # rows of one code are dealt to several partitions
    coded = vectors.mapInArrow(near, "vec_id long, vector binary, asks boolean, copies long, code int")
    ordered = coded.withColumn("dealt", dealt).repartitionByRange("code", "dealt").sortWithinPartitions("code", "dealt", "vec_id", "vector")
    return ordered.select("vec_id", "vector", "asks", "copies").mapInArrow(words.returning(cut), "block long, range long, vec_ids array<long>, asks array<boolean>, copies array<long>, data binary, high binary, low binary")


INDEX = ["block", "range", "vec_ids", "asks", "copies", "data", "high", "low"]


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)


class Best:
    """The k best (score, id) of each of ``n`` queries, and the score below which nothing counts."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.query, self.score, self.vec, self.named, self.times = (np.zeros(0, x) for x in (np.int64, np.int64, np.int64, bool, np.int64))

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray, named: np.ndarray, times: np.ndarray) -> None:
        """``named`` tells ids from nulls; a candidate counts ``times`` times."""
        parts = [np.concatenate(x) for x in zip((self.query, self.score, self.vec, self.named, self.times), (query, score, vec, named, times), strict=True)]
        order = np.lexsort((parts[2], ~parts[3], -parts[1], parts[0]))
        query, score, vec, named, times = (x[order] for x in parts)
        many = np.minimum(times, self.k)
        before = np.cumsum(many) - many
        first = np.flatnonzero(np.diff(query, prepend=-1))
        place = before - np.repeat(before[first], np.diff(np.append(first, len(query))))
        keep = place < self.k
        self.query, self.score, self.vec, self.named, self.times = (x[keep] for x in (query, score, vec, named, np.minimum(many, self.k - place)))
        last = np.flatnonzero(np.diff(self.query, append=-1)) if len(self.query) else np.zeros(0, int)
        filled = (place[keep] + self.times)[last] >= self.k
        at = self.query[last][filled]
        self.least[at] = np.maximum(self.least[at], self.score[last][filled])


def search(index: list[dict], queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[Best, int]:
    """The k best rows of the blocks of ``index`` for each of ``queries``, and how many pairs of query and block were scored.

    ``own`` has the block and the place of each query. ``least`` is the score a row must reach. Each
    query takes its blocks by falling bounds, in waves of growing size, until a bound is below its k-th score.
    """
    best, scored = Best(len(queries), k, least.copy()), 0
    if not index or not len(queries):
        return best, scored
    width = max(queries.shape[1], *(len(b["high"]) // 4 for b in index))
    high, low = (matrix([b[c] for b in index], width) for c in ("high", "low"))
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    kind = exact(queries, high, low)
    asked, high, low = queries.astype(kind), high.astype(kind), low.astype(kind)
    bounds = np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    data: dict[int, tuple] = {}
    start, size = 0, 1
    while start < len(index):
        taken = order[:, start : start + size]
        rows, places = np.nonzero(np.take_along_axis(bounds, taken, 1) >= best.least[:, None])
        if not len(rows):
            break
        at = taken[rows, places]
        by = np.argsort(at, kind="stable")
        found = []
        for group in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
            number, asking = int(at[group[0]]), rows[group]
            block = index[number]
            if number not in data:
                held = np.frombuffer(block["data"], "<i4").reshape(len(block["vec_ids"]), -1)
                ids = np.array([x or 0 for x in block["vec_ids"]], np.int64)
                data[number] = np.pad(held, ((0, 0), (0, width - held.shape[1]))).astype(kind), ids, np.array([x is not None for x in block["vec_ids"]]), np.array(block["copies"], np.int64)
            values, ids, named, copies = data[number]
            scores = asked[asking] @ values.T
            scored += len(asking)
            q, r = np.nonzero(scores >= best.least[asking][:, None])
            times = copies[r] - ((own[asking[q], 0] == block["block"]) & (own[asking[q], 1] == r))
            q, r, times = q[times > 0], r[times > 0], times[times > 0]
            found.append((asking[q], scores[q, r].astype(np.int64), ids[r], named[r], times))
        best.add(*map(np.concatenate, zip(*found, strict=True)))
        start, size = start + size, size * 2
    return best, scored


NOTHING = np.iinfo(np.int64).min
QUERY = "query_id long, block long, place int, copies long, vector binary, least long"


def seeded(index: pa.Table, k: int) -> pa.Table:
    """The queries of a range, each with its k-th best score there (the least number if there are fewer)."""
    rows = index.to_pylist()
    asks = [(b["vec_ids"][i], b["block"], i, b["copies"][i], b["data"][i * (n := len(b["high"])) : (i + 1) * n]) for b in rows for i, asked in enumerate(b["asks"]) if asked]
    ids, block, place, copies, vector = zip(*asks, strict=True) if asks else [()] * 5
    own = np.array([block, place], np.int64).T
    best, _ = search(rows, matrix(list(vector)), own, k, np.full(len(asks), NOTHING))
    return pa.table([pa.array(ids, pa.int64()), pa.array(block, pa.int64()), pa.array(place, pa.int32()), pa.array(copies, pa.int64()), pa.array(vector, pa.binary()), pa.array(best.least if asks else [], pa.int64())], names=["query_id", "block", "place", "copies", "vector", "least"])


def top_k(embeddings: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``embeddings`` that meets ``queries`` the k other rows with the highest scores.

    Equal scores go by the smaller ``vec_id``. See the module for the method and the defined results.
    """
    if k < 1:
        raise ValueError("k must be 1 at least")
    index = scratch.table(blocks(scratch.table(integers(embeddings, queries), "vectors")), "blocks")
    asked = scratch.table(index.groupBy("range").applyInArrow(lambda t: seeded(t, k), QUERY), "queries")
    tiles, units = (max(1, -(-df.count() // n)) for df, n in ((asked, TILE), (index, UNIT)))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        """All queries of a tile in one row."""
        names = rows.schema.names[1:]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([rows[c].to_pylist()], pa.list_(rows.schema.field(c).type)) for c in names)], names=["tile", *names])

    lists = "tile int, query_id array<long>, block array<long>, place array<int>, copies array<long>, vector array<binary>, least array<long>"
    tiled = asked.select(F.pmod(F.xxhash64("block", "place"), F.lit(tiles)).cast("int").alias("tile"), *asked.columns).groupBy("tile").applyInArrow(packed, lists)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select(F.pmod(F.xxhash64("block"), F.lit(units)).cast("int").alias("unit"), every(tiles).alias("tile"), "block", "vec_ids", "copies", "data", "high", "low")
    right = scratch.table(tiled, "tiles").select(every(units).alias("unit"), "*")

    def score(rows: pa.Table, tile: pa.Table) -> pa.Table:
        names = ["block", "place", "query_id", "asked", "vec_id", "score", "times"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        if not rows.num_rows or not tile.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        (asked,) = tile.to_pylist()
        own = np.array([asked["block"], asked["place"]], np.int64).T
        best, _ = search(rows.to_pylist(), matrix(asked["vector"]), own, k, np.array(asked["least"], np.int64))
        at = best.query.tolist()
        columns = [own[best.query, 0], own[best.query, 1], [asked["query_id"][i] for i in at], [asked["copies"][i] for i in at], pa.array(best.vec, mask=~best.named), best.score, best.times]
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    found = left.groupBy("unit", "tile").cogroup(right.groupBy("unit", "tile")).applyInArrow(score, "block long, place int, query_id long, asked long, vec_id long, score long, times long")
    # a candidate of several copies takes as many places, and a query of several copies has as many results
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "copy")
    merged = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("asked")))).select("query_id", "rank", "vec_id", "score")
