"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

A line goes if an equal line, or one within ``edits`` edits, comes first earlier in
the corpus (ordered by doc_id, then a hash of the text, then the line's place).
Two lines within that distance share one of ``edits`` + 1 segments at nearly the
same place. So each line is indexed by its segments, each line probes the segments
of lines that are up to ``edits`` shorter, at the few places that can match, and
what meets is compared by letter counts right after the join and then verified on
the texts by Spark's banded edit distance (a bit-parallel one written with array
functions gave the same results but took many times as long).

A segment that over ``HOT`` lines have, such as the fixed part of a template, is not
joined. Of these lines those go first that are near the earliest line with which they
agree but for two signs side by side. For the rest the common segment is taken out and what
remains, which must be within the same distance, is cut into segments in turn, under the
segment taken out, until no segment is hot or no line of its group is open. So a probe meets
at most ``HOT`` lines for each of its keys.

What is shuffled are hashes; texts of lines move only for pairs to be verified. A
line that many documents share is one line before its first shuffle.

Defined results: a null text stays null; blank lines are always kept; lines shorter
than ``least_chars`` (or than ``edits`` + 1) are compared for equality alone; a document may end up
without lines (its text is empty then); rows equal in doc_id and text get the same
text; an empty table gives no rows; further columns are carried along, but those
named ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scratch
from tidemill.operators.slices import fresh

EDITS = 2
#: The least that can be cut into EDITS + 1 segments.
LEAST_CHARS = EDITS + 1
#: Letters whose counts (modulo 32) a signature holds: the most frequent ones of Latin-script prose.
LETTERS = "enitraoshdlu"
#: So many lines with one segment are joined at most.
HOT = 128
#: Places at which two signs are left out of a line, to compare it with the earliest line that is then the same.
PLACES = 128


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, xh, at, line`` of every line that is not blank; ``xh`` tells texts with one doc_id apart."""
    text = F.col("text").cast("string")
    # Hashed and split once a document, before the lines are made. The outer form has the same
    # rows here, but no filter is inferred from it, which would split each text again.
    parts = docs.select("doc_id", F.xxhash64(text).alias("xh"), F.split(text, "\n").alias("parts"))
    lines = parts.select("doc_id", "xh", F.posexplode_outer("parts").alias("at", "line"))
    return lines.where(F.col("line").rlike(r"\S"))


def hashes(line: Column) -> list[Column]:
    """128 bits that stand for the line."""
    return [F.xxhash64(line).alias("l1"), F.xxhash64(F.lit(7), line).alias("l2")]


def signature(line: Column, size: Column) -> Column:
    """Counts of twelve letters, 5 bits each (modulo 32), and above them the length modulo 8. An edit changes two counts by one at most."""
    octets, packed = F.octet_length(line), F.shiftleft((size % 8).cast("long"), 60)
    for k, letter in enumerate(LETTERS):
        count = (octets - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(31)), 5 * k))
    return packed


def apart(a: Column, b: Column) -> Column:
    """A lower bound of the sum of count differences of two signatures."""
    total = F.lit(0)
    for k in range(len(LETTERS)):
        one = (F.shiftright(a, 5 * k) - F.shiftright(b, 5 * k)).bitwiseAND(F.lit(31))
        total = total + F.least(one, 32 - one)
    return total


def _segment(size: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``i`` of a line; the last segments are the longer ones."""
    more = size % parts
    short = ((size - more) / parts).cast("int")
    first = parts - more  # segments from here on have one more
    return 1 + i * short + F.greatest(F.lit(0), i - first), short + F.when(F.lit(i) >= first, 1).otherwise(0)


def line_keys(line: Column, size: Column, edits: int, group: Column | None = None) -> Column:
    """Keys of the line's own segments, and of its substrings that can match a segment of a line up to ``edits`` shorter.

    With ``group``, of which the keys are then a part, each has also the line without the substring.
    """
    keys = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            start, length = _segment(size - shorter, i, edits + 1)
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            for shift in range(low, high + 1):
                at = start + shift
                key = F.xxhash64(*([] if group is None else [group]), F.lit(i), size - shorter, F.substring(line, at, length))
                parts = [key.alias("key"), F.lit(shorter == 0 and shift == 0).alias("own")]
                if group is not None:
                    rest = F.concat(F.substring(line, 1, at - 1), F.substring(line, at + length, size))
                    parts += [rest.alias("rest"), (size - shorter < edits + 1).alias("short")]
                keys.append(F.struct(*parts))
    return F.array(*keys)


def _witnesses(lines: DataFrame, edits: int) -> DataFrame:
    """``a, b``: for lines of ``id, line, size, first`` the earliest line that differs from each only in two signs side by side, if within ``edits``."""
    step = F.greatest(F.lit(1), F.ceil(F.col("size") / PLACES).cast("int"))
    placed = lines.select("id", "line", "first", "size", F.explode(F.sequence(F.lit(1), F.col("size"), step)).alias("at"))
    key = F.xxhash64("size", "at", F.substring("line", F.lit(1), F.col("at") - 1), F.substring("line", F.col("at") + 2, F.col("size")))
    keyed = placed.select("id", "line", "first", key.alias("key"))
    best = keyed.groupBy("key").agg(F.min(F.struct("first", "id", "line")).alias("w"), F.count("*").alias("n")).where("n > 1")
    best = scratch.table(best.select("key", "w"), "witnesses")
    met = keyed.join(scratch.sized(best), "key").where((F.col("first") > F.col("w.first")) & (F.levenshtein("line", "w.line", edits) >= 0))
    return met.select(F.col("w.id").alias("a"), F.col("id").alias("b")).dropDuplicates(["b"])


def hot_pairs(lines: DataFrame, edits: int) -> DataFrame:
    """``a, b``: candidates among ``lines`` (``id, line, size, first``), enough to find each line that goes."""
    near = scratch.table(_witnesses(lines, edits), "near_witnesses")
    lines = lines.join(near.select(F.col("b").alias("id"), F.lit(False).alias("open")), "id", "left").withColumn("open", F.coalesce("open", F.lit(True)))
    state = ["id", "first", "open"]
    out = [near]
    rows = lines.select(*state, F.lit(True).alias("own"), F.lit(0).cast("long").alias("gid"), F.col("line").alias("rest"))
    while True:
        size = F.char_length("rest")
        made = rows.select(*state, F.col("own").alias("whole"), F.explode(line_keys(F.col("rest"), size, edits, F.col("gid"))).alias("k"))
        made = scratch.table(made.select(*state, "k.key", (F.col("whole") & F.col("k.own")).alias("own"), "k.rest", "k.short"), "parts")
        shape = made.groupBy("key").agg(F.count_if("own").alias("n_own"), F.count_if("open").alias("n_open"), F.bool_or(F.col("own") & F.col("short")).alias("last")).where("n_own > 0 AND n_open > 0")
        is_hot = (F.col("n_own") > HOT) & (F.col("n_open") > HOT) & ~F.col("last")
        shape = scratch.table(shape.select("key", is_hot.alias("hot")), "shapes")
        live = scratch.table(made.join(scratch.sized(shape), "key"), "live_parts")
        cold = live.where("NOT hot")
        one, two = (cold.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "first", "open", "own", "rest"))) for x in "ab")
        later_open = F.when(F.col("first_a") > F.col("first_b"), F.col("open_a")).otherwise(F.col("open_b"))
        size_a, size_b = F.char_length("rest_a"), F.char_length("rest_b")
        differ = ((size_b > size_a) | ((size_b == size_a) & (F.col("id_a") < F.col("id_b")))) & (size_b - size_a <= edits)
        near_rest = differ & later_open & (F.levenshtein("rest_a", "rest_b", edits) >= 0)
        # one end of a pair is open, and a cold segment has few lines that are its own or few that are open
        met = [x.join(y, "key").where(near_rest).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")) for x, y in ((one.where("own_a AND open_a"), two), (one.where("own_a AND NOT open_a"), two.where("open_b")))]
        out.append(scratch.table(met[0].union(met[1]).distinct(), "hot_pairs"))
        rows = live.where("hot").select(*state, "own", F.col("key").alias("gid"), "rest")
        if rows.isEmpty():
            return functools.reduce(DataFrame.union, out)
        # lines that are now known to go are open no more
        ends = [lines.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"), F.col("first").alias(f"first_{x}")) for x in "ab"]
        late = out[-1].join(ends[0], "a").join(ends[1], "b").where(F.levenshtein("line_a", "line_b", edits) >= 0)
        late = late.select(F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()
        late = scratch.table(late.withColumn("late", F.lit(True)), "late_lines")
        rows = rows.join(scratch.sized(late), "id", "left").withColumn("open", F.col("open") & F.col("late").isNull()).drop("late")


def near_lines(docs: DataFrame, repeated: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``a1, a2, b1, b2``: pairs of different lines (by their hashes) within ``edits`` edits, each pair once.

    All pairs whose lines have no hot segment, and for each other line that has an earlier one
    within the edits at least one such pair. ``repeated`` has the lines that occur more than
    once with their first place; of these only the first takes part.
    """
    line, size, least_chars = F.col("line"), F.col("size"), max(least_chars, edits + 1)
    lines = lines_of(docs).withColumn("size", F.char_length(line)).where(size >= least_chars)
    known = repeated.select(F.col("l1").alias("k1"), F.col("l2").alias("k2"), "first")
    here = F.struct("doc_id", "xh", "at")
    hashed = lines.select("line", "size", here.alias("here"), *hashes(line))
    once = hashed.join(scratch.sized(known), (F.col("l1") == F.col("k1")) & (F.col("l2") == F.col("k2")), "left").where(F.col("first").isNull() | F.col("here").eqNullSafe(F.col("first")))
    signed = once.select(F.col("l1").alias("id"), signature(line, size).alias("sig"), line_keys(line, size, edits).alias("keys"))
    # only now, and in the outer form, or signature and keys would be computed again for each key
    keyed = signed.select("id", "sig", F.explode_outer("keys").alias("k"))
    keyed = scratch.table(keyed.select("k.key", "k.own", "id", "sig"), "segments")

    hot = scratch.table(keyed.where("own").groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot_segments")
    any_hot = not hot.isEmpty()
    index = keyed.where("own").select("key", F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    if any_hot:
        index = index.join(scratch.sized(hot), "key", "left_anti")
    probes = keyed.select("key", F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    longer = (F.shiftright("sig_b", 60) - F.shiftright("sig_a", 60)).bitwiseAND(F.lit(7))
    differ = ((longer > 0) & (longer <= edits)) | ((longer == 0) & (F.col("a") < F.col("b")))
    pairs = index.join(probes, "key").where(differ & (apart(F.col("sig_a"), F.col("sig_b")) <= 2 * edits))
    pairs = scratch.table(pairs.select("a", "b").distinct(), "line_pairs")
    if any_hot:
        ids = scratch.table(keyed.join(scratch.sized(hot), "key", "left_semi").select("id").distinct(), "hot_ids")
        members = once.select(F.col("l1").alias("id"), "line", "size", F.col("here").alias("first")).join(scratch.sized(ids), "id", "left_semi")
        pairs = scratch.table(pairs.union(hot_pairs(scratch.table(members, "hot_lines"), edits)).distinct(), "line_pairs")

    ids = scratch.table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "line_ids")
    texts = scratch.table(lines.select(F.xxhash64(line).alias("id"), "line").join(scratch.sized(ids), "id", "left_semi").distinct(), "line_texts")
    ends = [texts.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}")) for x in "ab"]
    checked = pairs.join(ends[0], "a").join(ends[1], "b").where((F.levenshtein("line_a", "line_b", edits) >= 0) & (F.col("line_a") != F.col("line_b")))
    return checked.select(*(h.alias(f"{x}{k}") for x in "ab" for k, h in enumerate(hashes(F.col(f"line_{x}")), 1))).distinct()


def deduplicate(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with the lines kept in ``text``, and ``n_lines, n_dropped``; see the module for the rule and the defined results."""
    seen = lines_of(docs).select("doc_id", "xh", "at", *hashes(F.col("line")))
    seen = scratch.table(seen, "lines")
    place = F.struct("doc_id", "xh", "at")
    firsts = scratch.table(seen.groupBy("l1", "l2").agg(F.min(place).alias("first"), F.count("*").alias("times")), "first_lines")

    repeated = scratch.table(firsts.where("times > 1").select("l1", "l2", "first"), "repeated_lines")
    near = scratch.table(near_lines(docs, repeated, edits, least_chars), "near_lines")
    known = [firsts.select(F.col("l1").alias(f"{x}1"), F.col("l2").alias(f"{x}2"), F.col("first").alias(f"first_{x}")) for x in "ab"]
    ordered = near.join(known[0], ["a1", "a2"]).join(known[1], ["b1", "b2"])
    later = F.col("first_a") > F.col("first_b")
    late = ordered.select(F.when(later, F.col("a1")).otherwise(F.col("b1")).alias("l1"), F.when(later, F.col("a2")).otherwise(F.col("b2")).alias("l2")).distinct()

    again = repeated.join(late.withColumn("late", F.lit(True)), ["l1", "l2"], "full")
    again = scratch.table(again, "lines_to_drop")
    gone = seen.join(scratch.sized(again, limit=200_000), ["l1", "l2"]).where(F.coalesce("late", F.lit(False)) | ~place.eqNullSafe(F.col("first")))
    docs = docs.drop("n_lines", "n_dropped")
    places, gone_id, gone_xh = fresh(docs.columns, "gone", "gone_id", "gone_xh")
    gone = gone.groupBy("doc_id", "xh").agg(F.collect_set("at").alias(places))
    gone = scratch.table(gone.select(F.col("doc_id").alias(gone_id), F.col("xh").alias(gone_xh), places), "dropped_lines")

    text = F.col("text").cast("string")
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.xxhash64(text) == F.col(gone_xh))
    joined = docs.join(scratch.sized(gone, limit=200_000), same, "left")
    parts = F.split(text, "\n")
    kept = F.concat_ws("\n", F.filter(parts, lambda x, i: ~F.array_contains(places, i)))
    cleaned = F.when(F.col(places).isNull(), text).otherwise(kept).alias("text")
    return joined.select(*(cleaned if c == "text" else docs[c] for c in docs.columns), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_dropped"))
