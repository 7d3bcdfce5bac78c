"""Near-duplicates by SetSketch registers.

A document is its set of word shingles. Equal word sequences are one class from
the start. Each class has a SetSketch: exponentially spaced, truncated minima,
mergeable by their maximum. Bands of registers are bucket keys. In a bucket each
class is paired with the smallest one (a star, so a bucket of any size makes no
more pairs than members); the similarity of a pair is estimated jointly by
likelihood from how many registers are larger, equal and smaller, unlikely pairs
go, and the rest is verified on the full sets. Buckets that still hold several
components are then compared completely, in blocks of bounded size, so that no
link between members of a bucket is missed; a block answers with the links that
join components, never with all pairs.

At the default 24 bands of 4 registers a pair at the threshold shares no band with
probability 3e-6.

Defined results: null and empty texts, and texts of white space, have no shingles
and are linked with nothing; a text of fewer words than a shingle is one shingle;
repeated rows are copies of each other; a null doc_id is linked like others but is
never a component's id (a component of null ids alone has a null id); an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import graph, scratch, words
from tidemill.operators.slices import fresh

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 24, 4
#: Fixed values of the sketch: base, rate, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Pairs estimated further below the threshold are dropped: five standard errors of 96 registers.
MARGIN = 0.2
#: A block of a bucket has at most about so many shingles and members.
BLOCK_SHINGLES, BLOCK_MEMBERS = 200_000, 1_000

_M = np.random.default_rng(20_240_229)
_XOR = _M.integers(0, 2**64, BANDS * ROWS, np.uint64, endpoint=False)
_MUL = _M.integers(0, 2**64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
_STEP = _M.integers(0, 2**64, 64, np.uint64, endpoint=False) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, bytes | None]]:
    """For each text its shingles as sorted distinct hashes, and a digest of its word sequence."""
    pieces, index, begin = words.split(pc.ascii_lower(texts), None)
    code = pd.util.hash_array(np.array(pieces, object), categorize=False) if pieces else np.zeros(0, np.uint64)
    if "" in pieces:
        there = index != pieces.index("")
        begin = np.concatenate(([0], np.cumsum(there)))[begin]
        index = index[there]
    code = code[index]
    n = max(0, len(code) - k + 1)
    hashes = np.zeros(n, np.uint64)
    for j in range(k):
        hashes += code[j : j + n] * _STEP[j]
    hashes = mix(hashes)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if a == b:
            yield np.zeros(0, np.uint64), None
            continue
        if b - a < k:
            own = np.array([int.from_bytes(hashlib.blake2b(code[a:b].tobytes(), digest_size=8).digest(), "little")], np.uint64)
        else:
            own = np.unique(hashes[a : b - k + 1])
        yield own, hashlib.blake2b(code[a:b].tobytes(), digest_size=16).digest()


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers: floor(1 - log_b of the smallest exponential variate), cut to 0..TOP."""
    least = np.full(len(_MUL), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, ((shingles[at : at + 512, None] ^ _XOR) * _MUL).min(0), out=least)
    variate = -np.log1p(-(least.astype(float) + 1) / 2.0**64 * (1 - 2**-53)) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, TOP).astype("<u2")


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs, from registers (a row each) and set sizes, on a grid of hundredths."""
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    grid = np.minimum(np.linspace(0, 1, 101)[None, :], np.minimum(u / v, v / u))

    def odds(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    above, below = odds(u - v * grid), odds(v - u * grid)
    tiny = 1e-9
    score = (left > right).sum(1)[:, None] * np.log(above + tiny) + (left < right).sum(1)[:, None] * np.log(below + tiny)
    score += (left == right).sum(1)[:, None] * np.log(np.maximum(1 - above - below, 0) + tiny)
    return grid[np.arange(len(grid)), score.argmax(1)]


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """``row, doc_id, text_hash, n, digest, registers`` of each row; ``row`` numbers them."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in words.slices(batch, "text"):
                found = [(len(s), d, registers(s).tobytes() if d else None) for s, d in shingle_sets(words.texts(part, "text"), k)]
                n, digest, regs = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(n))), part["doc_id"], part["text_hash"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["row", "doc_id", "text_hash", "n", "digest", "registers"])
                row += len(n)

    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(words.returning(work), f"row long, doc_id {doc_id}, text_hash long, n long, digest binary, registers binary")


def _matrix(column: pa.Array, kind: str = "<u2") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def bands(classes: DataFrame) -> DataFrame:
    """``key, id`` for each band of each class; the key has all bits of the band's registers, mixed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = np.ascontiguousarray(_matrix(batch["registers"])).view("<u8")
            keys = mix(packed + _STEP[: packed.shape[1]])
            ids = np.repeat(batch["cid"].to_numpy(zero_copy_only=False), packed.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])

    return classes.select("cid", "registers").mapInArrow(words.returning(work), "key long, id long")


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose estimated similarity is not far below the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = [batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")]
                keep = estimate(_matrix(batch["reg_a"]), _matrix(batch["reg_b"]), *n) >= percent / 100 - MARGIN
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(words.returning(work), "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``id, n, shingles`` of the wanted classes (``cid, digest, doc_id``), from the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                found = [(d, len(s), s.tobytes()) for s, d in shingle_sets(words.texts(part, "text"), k)]
                digest, n, own = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(own, pa.binary())], names=["digest", "n", "shingles"])

    ids = scratch.sized(scratch.table(wanted.select(F.col("doc_id").alias("wanted_id")).distinct(), "wanted_ids"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    sets = texts.mapInArrow(words.returning(work), "digest binary, n long, shingles binary").join(wanted.select("digest", F.col("cid").alias("id")), "digest")
    return sets.groupBy("id").agg(F.any_value("n").alias("n"), F.any_value("shingles").alias("shingles"))


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a, b`` and their sets) that reach the threshold on the full sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(words.returning(work), "a long, b long")


def block_links(table: pa.Table, percent: int) -> pa.Table:
    """Links that join components, among the members of one block or between two blocks of a bucket."""
    ids, comps, sides = (table[c].to_numpy() for c in ("id", "comp", "side"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
    sizes = np.array([len(x) for x in sets])
    values, index = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(index) > 1
    owner = np.repeat(np.arange(len(sets)), sizes)[common[index]]
    column = (np.cumsum(common) - 1)[index[common[index]]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, min(int(common.sum()), (8 << 20) // max(1, len(sets))))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    edges = np.searchsorted(column, np.arange(0, int(common.sum()) + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - k * width] = 1
        both += part @ part.T
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    linked &= (comps[:, None] != comps[None, :]) & (ids[:, None] < ids[None, :])
    if (sides != sides[0]).any():
        linked &= sides[:, None] != sides[None, :]
    a, b = np.nonzero(linked)
    one = pd.DataFrame({"a": ids[a], "b": ids[b], "x": np.minimum(comps[a], comps[b]), "y": np.maximum(comps[a], comps[b])}).drop_duplicates(["x", "y"])
    return pa.table({"a": pa.array(one["a"].to_numpy(np.int64)), "b": pa.array(one["b"].to_numpy(np.int64))})


def rest_of_buckets(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within buckets that hold several components, by complete comparison in blocks.

    Sets whose sizes differ too much can't be linked: a bucket of many sizes is split by size, so
    that a set, however large, meets only those of about its size.
    """
    sizes = sets.select("id", "n")
    # linked sets are of the same class or of neighbouring ones
    rank = F.floor(F.log("n") / math.log(100 / percent)) if percent < 100 else F.col("n")
    placed = members.join(comps, "id", "left").join(sizes, "id").select("key", "id", F.coalesce("comp", "id").alias("comp"), "n", rank.alias("rank"))
    placed = scratch.table(placed, "members")
    wide = placed.groupBy("key").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).where("b - a > 1").select("key", F.lit(True).alias("wide"))
    ranks = F.when(F.col("wide"), F.array("rank", F.col("rank") + 1)).otherwise(F.array(F.lit(-1).cast("long")))
    placed = placed.join(scratch.sized(scratch.table(wide, "wide_buckets")), "key", "left").select("key", "id", "comp", "n", F.explode(ranks).alias("rank"))
    placed = scratch.table(placed.select(F.when(F.col("rank") < 0, F.col("key")).otherwise(F.xxhash64("key", "rank")).alias("key"), "id", "comp", "n"), "members")
    shape = placed.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s"))
    # A bucket of two was one pair of the star. Buckets with the same members are compared once.
    open_ = shape.where("members > 2 AND low < high").groupBy("members", "shingles", "x", "s").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.greatest(F.col("shingles") / BLOCK_SHINGLES, F.col("members") / BLOCK_MEMBERS)).cast("int")
    open_ = scratch.table(open_.select("key", blocks.alias("blocks")), "buckets")
    own = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
    dealt = placed.join(scratch.sized(open_), "key").withColumn("block", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "id", "comp", F.col("block").alias("side"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return dealt.join(sets.select("id", "shingles"), "id").groupBy("key", "i", "j").applyInArrow(lambda t: block_links(t.combine_chunks(), percent), "a long, b long")


def components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_hash, n_shingles, comp, component_id`` of every row.

    ``comp`` numbers the components, also those whose smallest doc_ids are equal or
    null; it is null for a row without shingles. ``text_hash`` is Spark's xxhash64.
    """
    rows = scratch.table(sketch(docs, shingle), "sketches")
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("cid"), F.min("doc_id").alias("first_id"), F.min_by(F.struct("doc_id", "n", "registers"), "row").alias("r"))
    classes = scratch.table(classes.select("digest", "cid", "first_id", "r.doc_id", "r.n", "r.registers"), "classes")

    keyed = bands(classes)
    buckets = scratch.table(keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot"), "buckets")
    members = scratch.table(keyed.join(scratch.sized(buckets), "key").select("key", "id", "pivot"), "memberships")
    wanted = classes.join(scratch.sized(scratch.table(members.select(F.col("id").alias("cid")).distinct(), "candidates")), "cid")
    wanted = scratch.table(wanted.select("cid", "digest", "doc_id", "n", "registers"), "candidates")

    star = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    regs = [wanted.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"reg_{x}")) for x in "ab"]
    pairs = scratch.table(likely(star.join(regs[0], "a").join(regs[1], "b"), percent), "pairs")
    sets = scratch.table(full_sets(docs, wanted, shingle), "sets")
    ends = [sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"]
    links = scratch.table(verified(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "set_a", "set_b"), percent), "links")
    comps = graph.components(links)

    more = scratch.table(rest_of_buckets(members, comps, sets, percent), "links")
    over = comps.select("id", "comp")
    joined = more.join(over.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a", "left").join(over.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b", "left")
    merged = graph.components(joined.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))

    found = classes.select("digest", "cid", "first_id").join(over.withColumnRenamed("id", "cid"), "cid", "left")
    found = found.withColumn("comp", F.coalesce("comp", "cid")).join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("into")), "comp", "left").withColumn("comp", F.coalesce("into", "comp"))
    least = found.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    ids = found.join(least, "comp").select("digest", "comp", "component_id")
    out = rows.select("doc_id", "text_hash", "n", "digest").join(ids, "digest", "left")
    root = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "comp", root.alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; see the module for the method and the defined results."""
    found = components(docs, shingle, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with exactly one row of each component: the smallest doc_id (null last), then text hash, then the other columns.

    Rows without shingles all stay.
    """
    found = components(docs, shingle, percent).where("comp IS NOT NULL")
    pairs = scratch.table(found.groupBy("comp", "doc_id", "text_hash").agg(F.count("*").alias("n")), "component_rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")
    best = pairs.groupBy("comp").agg(F.min(place).alias("best"), F.sum("n").alias("rows")).where("rows > 1")
    best = scratch.table(best.select("comp", F.col("best.doc_id").alias("best_id"), F.col("best.text_hash").alias("best_hash"), F.col("best.n").alias("times")), "kept_rows")
    is_best = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_hash") == F.col("best_hash"))
    gone = pairs.join(scratch.sized(best.select("comp", "best_id", "best_hash")), "comp").where(~is_best)
    other_id, other_hash = fresh(docs.columns, "other_id", "other_hash")
    gone = scratch.table(gone.select(F.col("doc_id").alias(other_id), F.col("text_hash").alias(other_hash)), "dropped_rows")
    again = scratch.table(best.where("times > 1").select(F.col("best_id").alias(other_id), F.col("best_hash").alias(other_hash)), "repeated_rows")

    text_hash = F.xxhash64(F.col("text").cast("string"))
    same = F.col("doc_id").eqNullSafe(F.col(other_id)) & (text_hash == F.col(other_hash))
    single = docs.join(scratch.sized(gone.union(again)), same, "left_anti")
    repeated = docs.join(scratch.sized(again), same, "left_semi").groupBy("doc_id", text_hash.alias("h")).agg(F.min(F.struct(*docs.columns)).alias("r"))
    return single.union(repeated.select("r.*"))

