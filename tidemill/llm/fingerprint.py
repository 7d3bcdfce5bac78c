"""Document fingerprints by I-Match with randomised lexicon subsets.

The lexicon holds the terms whose share of documents, and so whose inverse document
frequency, lies within a band. The band's lower edge is a share of all rows. Its upper
edge is a share of the groups of copies and near copies (rows with equal ``KEY_TERMS``
smallest term hashes): a term counts once for a group in which any row has it, so that a
group, however large, can't push its own terms out of the band. The groups of a term are
counted by a sketch of all their keys, bitmaps of falling shares of the keys, that merges
by OR. The bitmaps that all keys together fill too much are useless for any term, and what fills them
in a part of the rows fills them in all; so a task drops them early. An estimate is some 7 % off
at the edge, but a function of the rows alone: the lexicon and the fingerprints
don't depend on how rows are dealt to partitions or in what order they come.

From the lexicon come random subsets: ``CHAINS`` chains of nested ones with falling
shares of its terms. A document's distinct terms in a subset are sorted and hashed, all
of them; the fingerprint is the list of these hashes and that of the whole lexicon. Two
fingerprints are alike as far as chains agree: a chain agrees if a subset of it, in which
both have terms, has equal hashes. The small subsets survive edits, the large ones tell
that nothing was edited.

A document has, on average, so many distinct terms, and a term of the lexicon is in
at least a share ``LEAST_SHARE`` of documents; so the lexicon has at most their
quotient of terms, 8 bytes each, however many documents there are. It is sent to the tasks.

Defined results: null counts as empty; a document without a term of the lexicon has
the hash of its whole text as fingerprint, which is like no other but an equal one;
equal texts have equal fingerprints; a null doc_id comes last in the order; rows with
one doc_id come in an arbitrary order; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scratch, words
from tidemill.plans import inspect

LEAST_SHARE, MOST_SHARE = 0.001, 0.3
#: Chains of nested subsets, and the share of the lexicon's terms in the subsets of each.
CHAINS, SHARES = 32, (1 / 8, 1 / 64, 1 / 512)
#: Smallest term hashes that make the key of a group of near copies.
KEY_TERMS = 4
#: A sketch of group keys has so many levels of so many bits; a level with a larger share of its bits set isn't read.
LEVELS, BITS, FULL = 32, 512, 0.7
#: Text bytes looked at together, and bytes of terms that a worker remembers: small, as each text is there twice.
SLICE_BYTES, REMEMBERED = 2 << 20, 48 << 20
_M = np.random.default_rng(7)
_XOR = _M.integers(0, 2**64, CHAINS, np.uint64, endpoint=False)
_MUL = _M.integers(0, 2**64, CHAINS, np.uint64, endpoint=False) | np.uint64(1)
_EDGES = np.array([int(2**64 * x) - 1 for x in SHARES], np.uint64)
_BASE = _M.integers(0, 2**64, dtype=np.uint64, endpoint=False) | np.uint64(1)
_EDGE_SIGNS = " \t\r\n.,;:!?\"'()[]{}<>|*#$%&+-_=/\\~`^"


class Terms:
    """Term hashes of the strings between white space; 0 stands for no term. The worker remembers them."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0

    def __call__(self, strings: list[str]) -> np.ndarray:
        words.hold(self)
        if self.bytes > REMEMBERED:
            self.forget()
        if new := [x for x in strings if x not in self.known]:
            terms = np.array([x.strip(_EDGE_SIGNS).lower() for x in new], object)
            codes = pd.util.hash_array(terms, categorize=False) | np.uint64(1)
            codes[terms == ""] = 0
            self.known.update(zip(new, codes.tolist(), strict=True))
            self.bytes += sum(map(len, new)) + words.ENTRY_BYTES * len(new)
        return np.fromiter((self.known[x] for x in strings), np.uint64, len(strings))


_terms = Terms()


def distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of text number and term, each once, sorted by text."""
    strings, index, begin = words.split(texts, None)
    values, local = np.unique(_terms(strings), return_inverse=True)
    pairs = np.unique(np.repeat(np.arange(len(texts)), np.diff(begin)) * len(values) + local[index]) if len(index) else np.zeros(0, np.int64)
    owner, term = pairs // max(1, len(values)), values[pairs % max(1, len(values))] if len(pairs) else np.zeros(0, np.uint64)
    return owner[term != 0], term[term != 0]


def group_keys(owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` texts the mixed hash of its smallest terms (``distinct_terms`` sorts them); 0 without terms."""
    begin = np.searchsorted(owner, np.arange(n + 1))
    keys = np.zeros(n, np.uint64)
    for k in range(KEY_TERMS):
        at = begin[:-1] + k
        there = at < begin[1:]
        keys[there] = (keys[there] ^ term[at[there]]) * _MUL[k]
    return keys


def sketch_places(keys: np.ndarray) -> np.ndarray:
    """Where each group key is in a sketch: its level, which is l for a share 2**-(l+1) of the keys, times ``BITS``, plus its bit."""
    mixed = keys ^ (keys >> np.uint64(32))
    for k in (0, 1):
        mixed = mixed * _MUL[k]
        mixed ^= mixed >> np.uint64(30 + k)
    rest = (mixed // np.uint64(BITS)) | np.uint64(1 << (LEVELS - 1))
    level = np.log2((rest & (~rest + np.uint64(1))).astype(np.float64)).astype(np.int64)
    return level * BITS + (mixed % np.uint64(BITS)).astype(np.int64)


def base_level(filled: np.ndarray) -> int:
    """The first level that is read, from the number of set bits by level in the sketch of all keys: that above the last one that is too full."""
    return int(np.flatnonzero(np.append(True, filled > FULL * BITS))[-1])


def sketched_groups(filled: Column, level: Column, base: int) -> Column:
    """Aggregate: the number of keys in a sketch, from a row for each level with the number of its bits that are set.

    The levels from ``base`` on are read: each by its empty bits, in whole millionths, so that the
    sum doesn't depend on the order; together they have 2**-base of the keys.
    """
    keys = F.round(F.log1p(-filled / BITS) * (-BITS * 1_000_000)).cast("long")
    return F.round(F.coalesce(F.sum(F.when(level >= base, keys)), F.lit(0)) * 2.0**base / 1_000_000).cast("long")


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> np.ndarray:
    """Sorted hashes of the terms within the band: in enough of all rows, and in not too many groups of near copies."""
    places, cells_each = LEVELS * BITS, LEVELS * BITS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, df, pairs = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, ...]] = []
        everyone, base = np.zeros((LEVELS, BITS), bool), 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            values, at = np.unique(np.concatenate([seen, *(x for x, _, _ in waiting)]), return_inverse=True)
            own, new = at[: len(seen)], at[len(seen) :]
            times = np.bincount(new, minlength=len(values))
            times[own] += df
            ends = np.cumsum([0, *(len(x) for x, _, _ in waiting)])
            found = [own[pairs // places] * places + pairs % places, *(new[start + at] * places + where for start, (_, at, where) in zip(ends, waiting))]
            pairs_ = np.unique(np.concatenate(found))
            return values, times, pairs_[pairs_ % places >= base * BITS]

        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                owner, term = distinct_terms(words.texts(part, "text"))
                place = sketch_places(group_keys(owner, term, part.num_rows))
                everyone.flat[place] = True
                base = base_level(everyone.sum(1))
                # term 0, which is no term, stands for all rows
                term, place = np.append(term, np.zeros(part.num_rows, np.uint64)), np.append(place[owner], place)
                read = np.flatnonzero(place >= base * BITS)
                waiting.append((term, read, place[read]))
                if sum(len(x) for x, _, _ in waiting) > 1_000_000:
                    seen, df, pairs = merged()
                    waiting = []
        seen, df, pairs = merged()
        if len(seen):
            # a row of cell -1 for each term with its number of rows, then one for each 64 bits of a sketch that aren't empty
            first = np.flatnonzero(np.diff(pairs // 64, prepend=-1))
            bits = np.bitwise_or.reduceat(np.uint64(1) << (pairs % 64).astype(np.uint64), first) if len(pairs) else np.zeros(0, np.uint64)
            at, cell = np.divmod(pairs[first] // 64, cells_each)
            terms = np.concatenate((seen, seen[at])).view(np.int64)
            cell = np.concatenate((np.full(len(seen), -1), cell)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(cell), pa.array(np.append(df, np.zeros(len(at), np.int64))), pa.array(np.append(np.zeros(len(seen), np.uint64), bits).view(np.int64))], names=["term", "cell", "df", "bits"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(words.returning(count), "term long, cell int, df long, bits long")
    cells = scratch.table(counts.groupBy("term", "cell").agg(F.sum("df").alias("df"), F.bit_or("bits").alias("bits")).where("df > 1 OR cell >= 0 OR term = 0"), "cells")
    total = (cells.where("term = 0 AND cell = -1").first() or {"df": 0})["df"]
    often = scratch.table(cells.where((F.col("cell") == -1) & (F.col("df") >= max(2, least * total))).select("term"), "often")
    level = F.floor(F.col("cell") * 64 / BITS).cast("int").alias("level")
    levels = cells.where("cell >= 0").join(scratch.sized(often), "term", "left_semi").groupBy("term", level).agg(F.sum(F.bit_count("bits")).alias("filled"))
    levels = scratch.table(levels, "levels")
    everyone = np.zeros(LEVELS)
    for row in levels.where("term = 0").collect():
        everyone[row["level"]] = row["filled"]
    groups = often.join(levels, "term", "left").groupBy("term").agg(sketched_groups(F.col("filled"), F.col("level"), base_level(everyone)).alias("groups"))
    groups = scratch.table(groups, "groups")
    apart = groups.where("term = 0").first()
    kept = groups.where((F.col("groups") <= max(2, most * (apart["groups"] if apart else 0))) & (F.col("term") != 0)).select("term")
    return np.sort(kept.toPandas()["term"].to_numpy(np.int64).view(np.uint64))


def _sorted_hashes(owner: np.ndarray, mixed: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` texts a 32-bit hash of its terms (mixed, in the terms' order; not 0); 0 without terms."""
    out = np.zeros(n, np.uint32)
    if len(owner):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        size = np.diff(np.append(first, len(owner)))
        place = np.arange(len(owner)) - np.repeat(first, size)
        powers = np.cumprod(np.full(int(size.max()), _BASE))
        total = np.add.reduceat(mixed * powers[place], first)
        total = (total ^ (total >> np.uint64(29))) * _MUL[0]
        out[owner[first]] = (total >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def prints(texts: pa.Array, terms: np.ndarray) -> np.ndarray:
    """A row of hashes for each text: of its terms in the whole lexicon, then in the subsets, chain by chain; 0 where it has none."""
    owner, term = distinct_terms(texts)
    values, index = np.unique(term, return_inverse=True)
    at = np.minimum(np.searchsorted(terms, values), max(0, len(terms) - 1))
    known = terms[at] == values if len(terms) else np.zeros(len(values), bool)
    keep = known[index]
    owner, term, index = owner[keep], term[keep], index[keep].astype(np.int32)
    mixed = term ^ (term >> np.uint64(31))
    out = np.zeros((len(texts), 1 + CHAINS * len(SHARES)), np.uint32)
    out[:, 0] = _sorted_hashes(owner, mixed, len(texts))
    for chain in range(CHAINS):
        rank = (values ^ _XOR[chain]) * _MUL[chain]
        rank ^= rank >> np.uint64(32)
        # the terms of the largest subset alone are looked at for the smaller ones, which it holds
        rows = np.flatnonzero((rank <= _EDGES[0])[index])
        own, some, ranks = owner[rows], mixed[rows], rank[index[rows]]
        for level in range(len(SHARES)):
            if level:
                inside = np.flatnonzero(ranks <= _EDGES[level])
                own, some, ranks = own[inside], some[inside], ranks[inside]
            out[:, 1 + chain * len(SHARES) + level] = _sorted_hashes(own, some, len(texts))
    return out


def written(hashes: np.ndarray, texts: pa.Array) -> list[str]:
    """Fingerprints as strings: eight hexadecimal digits a hash; that of the whole text where there is none."""
    there = hashes[:, 0] != 0
    return [row.astype(">u4").tobytes().hex() if t else "=" + hashlib.sha256(text.as_py().encode()).hexdigest() for row, t, text in zip(hashes, there.tolist(), texts, strict=True)]


def fingerprints(texts: pa.Array, terms: np.ndarray) -> list[str]:
    """The fingerprint of each text."""
    return written(prints(texts, terms), texts)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of rows of hashes: the share of agreeing chains among those in which either has terms; without such, whether the lexicon's hashes are equal."""
    subsets = [x[:, 1:].reshape(len(x), CHAINS, -1) for x in (a, b)]
    agree = ((subsets[0] == subsets[1]) & (subsets[0] != 0)).any(2).sum(1)
    either = ((subsets[0] != 0) | (subsets[1] != 0)).any(2).sum(1)
    whole = (a[:, 0] == b[:, 0]) & (a[:, 0] != 0)
    return np.where(either > 0, agree / np.maximum(either, 1), whole.astype(float))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a[:1] == "=" or b[:1] == "=":
        return float(a == b)
    return float(alike(*(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32)[None] for x in (a, b)))[0])


def successors(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, tail, doc_id, text``: documents in buckets by doc_id, sorted down within each, then as ``tail`` the head of the next bucket.

    So each document's next one, by descending doc_id, follows it in its partition.
    Rows with one doc_id are dealt by a hash of text and row, so that an id (or none) with
    many rows has as many buckets as its share. Driver and tasks share the buckets'
    edges and heads, two numbers for each bucket. Rows are numbered in two passes, for the heads and for
    the rows; an input that comes from a shuffle, whose order may differ from one to the other, is written first.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if inspect.shuffles(given):
        given = scratch.table(given, "given")
    wanted = [k / buckets for k in range(1, buckets)]
    edges = given.agg(F.percentile_approx(key, wanted, 10_000).alias("e")).first()["e"] if wanted else None
    value, first, times = np.unique(np.array(edges or [], np.int64), return_index=True, return_counts=True)
    number = np.arange(int(times.sum())) - np.repeat(first, times)
    # the k-th of n equal edges ends at k/n of the hashes
    cut = np.array([-(2**63) + (2**64 * (k + 1)) // n - 1 for k, n in zip(number.tolist(), np.repeat(times, times).tolist(), strict=True)], np.int64)

    def bucket_of(keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        at = np.searchsorted(value, keys, side="left")
        out = np.append(first, len(cut))[at]
        for k in np.flatnonzero(times > 1).tolist():
            own = np.flatnonzero((at == k) & (keys == value[k]))
            out[own] += np.searchsorted(cut[first[k] : first[k] + times[k]], ties[own], side="left")
        return out.astype(np.int32)

    @F.pandas_udf("int")
    def bucket(keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(keys.to_numpy(), ties.to_numpy()))

    numbered = given.withColumn("key", key).withColumn("tie", F.xxhash64("text", F.monotonically_increasing_id()))
    heads = numbered.select("key", "tie", bucket("key", "tie").alias("bucket")).groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("head")).orderBy("bucket").collect()
    place = {r["bucket"]: k for k, r in enumerate(heads)}
    top = np.array([(r["head"]["key"], r["head"]["tie"]) for r in heads], np.int64).reshape(-1, 2)
    # the bucket whose last document is followed by this head: the next higher one, and for the highest the lowest
    before = np.array([r["bucket"] for r in heads[1:] + heads[:1]], np.int32)

    @F.pandas_udf("bucket int, after int")
    def dealt_to(keys: pd.Series, ties: pd.Series) -> pd.DataFrame:
        own = bucket_of(keys.to_numpy(), ties.to_numpy())
        at = np.array([place[b] for b in own.tolist()], np.int64)
        is_head = (top[at, 0] == keys.to_numpy()) & (top[at, 1] == ties.to_numpy()) if len(own) else np.zeros(0, bool)
        return pd.DataFrame({"bucket": own, "after": np.where(is_head, before[at], -1) if len(own) else own}).astype("int32")

    placed = numbered.withColumn("place", dealt_to("key", "tie")).select("key", "tie", "doc_id", "text", "place.bucket", "place.after")
    own, tail = F.struct("bucket", F.lit(False).alias("tail")), F.struct(F.col("after").alias("bucket"), F.lit(True).alias("tail"))
    dealt = placed.select(F.explode(F.when(F.col("after") >= 0, F.array(own, tail)).otherwise(F.array(own))).alias("p"), "key", "tie", "doc_id", "text")
    return dealt.select("p.bucket", "p.tail", "key", "tie", "doc_id", "text").repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), F.desc("tie"))


def fingerprint(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE, buckets: int | None = None) -> DataFrame:
    """``doc_id, text, edited, next_id, fingerprint, edited_fingerprint, next_fingerprint, near_edited, near_next``.

    The edited text is the document with its last floor(n/2) code points replaced by as
    many first ones of the next document, by descending doc_id (after the last: the first).
    """
    terms = lexicon(docs, least, most)
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # bucket, tail, doc_id, text, fingerprint, hashes
        names = ["doc_id", "text", "edited", "next_id", "fingerprint", "edited_fingerprint", "next_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                text = words.texts(part, "text")
                hashes = prints(text, terms)
                rows = list(zip(part["bucket"].to_pylist(), part["tail"].to_pylist(), part["doc_id"].to_pylist(), text.to_pylist(), written(hashes, text), hashes, strict=True))
                pairs = [(a, b) for a, b in zip([last, *rows[:-1]] if last else rows[:-1], rows if last else rows[1:], strict=True) if a[0] == b[0] and not a[1]]
                last = rows[-1]
                if not pairs:
                    continue
                edited = pa.array([a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs], pa.string())
                edited_hashes = prints(edited, terms)
                edited_prints = written(edited_hashes, edited)
                own, other = (np.stack([x[k][5] for x in pairs]) for k in (0, 1))
                lone = [[float(a[4] == x) if a[4][0] == "=" else None for (a, _), x in zip(pairs, given, strict=True)] for given in (edited_prints, [b[4] for _, b in pairs])]
                near = [[n if one is None else one for n, one in zip(alike(own, hashed).tolist(), alone, strict=True)] for hashed, alone in zip((edited_hashes, other), lone, strict=True)]
                ids = [pa.array([x[k][2] for x in pairs], part["doc_id"].type) for k in (0, 1)]
                own_prints, next_prints = (pa.array([x[k][4] for x in pairs]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids[0], pa.array([a[3] for a, _ in pairs], pa.string()), edited, ids[1], own_prints, pa.array(edited_prints), next_prints, *(pa.array(x, pa.float64()) for x in near)], names=names)

    return successors(docs, buckets).mapInArrow(words.returning(work), f"doc_id {doc_id}, text string, edited string, next_id {doc_id}, fingerprint string, edited_fingerprint string, next_fingerprint string, near_edited double, near_next double")
