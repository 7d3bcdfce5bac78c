"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each part of a partition (``PART_ROWS`` rows or little more) hashes its normalised
texts, sorts the distinct fingerprints and sends them, Golomb-Rice coded, to the
owners of their ranges, of which there are as many as the rows need. An owner decodes
what it got and answers each part with a bitmap of the fingerprints that
another part has too. Only the rows so suspected are then grouped by the
bytes of their normalised texts; all other rows are known to be unique.

Texts never move for the comparison of fingerprints, a group of copies collapses
before its shuffle, and what is exchanged is a few bytes a row. A task holds the fingerprints of one part or
one owner, however large the table and its partitions are.

Defined results: null counts as the empty text; texts that are equal after white
space ``[\\x20\\x09-\\x0D]`` is deleted are copies, empty ones too; of copies the
row with the most code points, then the smallest doc_id (null last), then the
first in the input's order stays, so that of repeated rows one stays; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scratch, words

WHITE = b" \t\n\x0b\x0c\r"
#: A shorter fingerprint means fewer bytes exchanged and more rows suspected in vain.
BITS = 48
#: Rows after which a partition begins a new part.
PART_ROWS = 1 << 20
#: Fingerprints of an owner, on average, at most.
OWNER_ROWS = 1 << 21


def code(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of ascending distinct values: the width of the remainders, the unary quotients, the remainders."""
    gaps = np.diff(values, prepend=np.int64(-1)) - 1
    width = max(0, int(np.log2(max(1.0, float(gaps.mean())))))
    marks = np.cumsum((gaps >> width) + 1) - 1
    unary = np.zeros(int(marks[-1]) + 1, np.uint8)
    unary[marks] = 1
    rest = (gaps[:, None] >> np.arange(width - 1, -1, -1)) & 1
    return width, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def decode(count: int, width: int, unary: bytes, rest: bytes) -> np.ndarray:
    marks = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:count]
    gaps = (np.diff(marks, prepend=-1) - 1).astype(np.int64) << width
    if width:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: count * width].reshape(count, width)
        gaps |= bits.astype(np.int64) @ (np.int64(1) << np.arange(width - 1, -1, -1))
    return np.cumsum(gaps + 1) - 1


def owners_of(rows: int, least: int) -> int:
    """Owners for a table of so many rows: a power of two, at least ``least``, with no more than ``OWNER_ROWS`` rows for each."""
    return 1 << (max(least, -(-rows // OWNER_ROWS), 1) - 1).bit_length()


def hashed(docs: DataFrame, owners: int, bits: int = BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """A row for each document (``row`` numbers them), and for each part and owner a coded list (``owner`` is not null)."""
    doc_id = docs.schema["doc_id"].dataType
    share = bits - (owners.bit_length() - 1)  # bits within an owner's range

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row, seen, waiting, ids = TaskContext.get().partitionId(), 0, [], 0, None
        part = task << 24
        names = ["part", "row", "doc_id", "n_chars", "sha", "fp", "owner", "count", "width", "unary", "rest"]

        def lists() -> pa.RecordBatch:
            """The coded lists of the part that ends here."""
            values = np.unique(np.concatenate(seen))
            owner = values >> share
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            coded = [(int(owner[a]), len(x), *code(x - (owner[a] << share))) for a, x in zip(first, np.split(values, first[1:]), strict=True)]
            n = len(coded)
            columns = [pa.array(x, t) for x, t in zip(zip(*coded, strict=True), [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, ids), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), *columns], names=names)

        for batch in batches:
            ids = batch["doc_id"].type
            for piece in words.slices(batch, "text"):
                text, n = words.texts(piece, "text"), piece.num_rows
                digests = [hashlib.sha256(x.translate(None, WHITE)).digest() for x in text.cast(pa.binary()).to_pylist()]
                fp = (np.frombuffer(b"".join(digests), ">u8")[::4] >> np.uint64(64 - bits)).astype(np.int64)
                seen.append(fp)
                columns = [pa.array(np.full(n, part, np.int64)), pa.array((task << 36) + row + np.arange(n)), piece["doc_id"], pc.utf8_length(text).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(fp)]
                row, waiting = row + n, waiting + n
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
                if waiting >= part_rows:
                    yield lists()
                    part, seen, waiting = part + 1, [], 0
        if waiting:
            yield lists()

    schema = f"part long, row long, doc_id {doc_id.simpleString()}, n_chars long, sha binary, fp long, owner int, count int, width int, unary binary, rest binary"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(words.returning(work), schema)


def answer(table: pa.Table) -> pa.Table:
    """An owner's answers: for each part that sent a list, a bitmap of the values that other lists have too."""
    lists = [decode(*x) for x in zip(*(table[c].to_pylist() for c in ("count", "width", "unary", "rest")), strict=True)]
    values, times = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[times > 1]
    bitmaps = [np.isin(x, shared, assume_unique=True) for x in lists]
    keep = pa.array([bool(x.any()) for x in bitmaps])
    out = pa.table({"part": table["part"], "owner": table["owner"], "bitmap": pa.array([np.packbits(x).tobytes() for x in bitmaps], pa.binary())})
    return out.filter(keep)


def suspects(rows: pa.Table, answers: pa.Table, share: int) -> pa.Table:
    """The rows of a part whose fingerprint occurs again, there or elsewhere."""
    fp = rows["fp"].to_numpy()
    values, index, times = np.unique(fp, return_inverse=True, return_counts=True)
    again = times > 1
    for owner, bitmap in zip(answers["owner"].to_pylist(), answers["bitmap"].to_pylist(), strict=True):
        a, b = np.searchsorted(values, [owner << share, (owner + 1) << share])
        again[a:b] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=b - a).astype(bool)
    return rows.select(["row", "doc_id", "n_chars", "sha"]).filter(pa.array(again[index]) if len(fp) else pa.array([], pa.bool_()))


def deduplicate(docs: DataFrame, bits: int = BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_chars`` of every row; see the module for the defined results."""
    spark = docs.sparkSession
    owners = owners_of(docs.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = bits - (owners.bit_length() - 1)
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    both = scratch.table(hashed(docs, owners, bits, part_rows), "fingerprints")
    rows = both.where("owner is null").select("part", "row", "doc_id", "n_chars", "sha", "fp")
    answers = both.where("owner is not null").select("part", "owner", "count", "width", "unary", "rest").groupBy("owner").applyInArrow(answer, "part long, owner int, bitmap binary")
    found = rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda left, right: suspects(left, right, share), f"row long, doc_id {doc_id}, n_chars long, sha binary")
    found = scratch.table(found, "suspects")

    # The bytes decide: rows are grouped by their normalised text.
    ids = scratch.table(found.select(F.col("doc_id").alias("suspect_id")).distinct(), "suspect_ids")
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), WHITE.decode(), "").alias("norm")
    checked = docs.join(scratch.sized(ids), F.col("doc_id").eqNullSafe(F.col("suspect_id")), "left_semi").select(text)
    checked = checked.groupBy("norm").count().select(F.unhex(F.sha2("norm", 256)).alias("sha"), "count")
    checked = checked.groupBy("sha").agg(F.sum("count").alias("group_size"), F.count("*").alias("texts"))
    checked = checked.select("sha", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts have one SHA-256"))).alias("group_size"))

    order = F.struct("n_chars", (-F.col("doc_id").cast("decimal(20,0)")).alias("a"), (-F.col("row")).alias("b"))
    best = found.groupBy("sha").agg(F.max_by(F.struct("doc_id", "row"), order).alias("best")).join(checked, "sha")
    # A table of its own, a row for each group: it is broadcast if small, and else nothing in the stage of
    # the join keeps adaptive execution from splitting the rows of a hot group.
    best = scratch.table(best.select("sha", F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row"), "group_size"), "groups")
    out = rows.join(scratch.sized(best), "sha", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "n_chars",
    )
