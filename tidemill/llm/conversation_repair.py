"""Repair of a conversation's structure by a dynamic program over the turns that stay.

Turns are kept (0), rerolled to user or assistant (2), deleted (3), and empty turns of user or
assistant are inserted (2), so that at the least cost the roles' initials read ``(s?(ua)+)?``.
A blank turn and one that repeats an earlier one of its conversation have to go; a truncated
one that stays costs 1 more. Of edits of one cost those whose letters (D, I, K, R, in order)
come first count.

The program runs from the last turn to the first over the turns that may stay. What lies
between two of them is deleted, at the difference of two sums of deletions, so it keeps, for
each state (nothing yet, after s, u, a), a running minimum of the cost less that sum; the pair
of roles says what is inserted. A letter decides a tie, since from one state different edits
have different letters. Going backwards, the rest of the letters is settled by then.

A conversation may hold a third of all rows. Rows are dealt by range of conversation and turn,
equal rows as one with a count, and cut into segments of at most ``ROWS`` turns and about
``BYTES`` of text. A segment is solved alone for each state it may be entered and left in:
16 costs, and the order of the four ways' letters from each state. Small as they are, these are
put together backwards along the conversation; then each segment is gone through again
between the two states chosen. Only the repaired turns of a conversation are read one after the
other, as a stream; for the query's digest that can't be otherwise.

Defined results: a null role or text is one blank; turns are in order of ``turn`` (null first),
then role, then text; a repeated row is a duplicate of the one before; equality of role and
text is that of their SHA-256; a role counts by its first letter; a null conv_id is a
conversation of its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scratch, words

#: A segment's turns and bytes of text, at most (a longer text is a segment of its own).
ROWS, BYTES = 256, 1 << 14
WHITE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, INSERT, DELETE, CUT_SHORT = 0, 2, 2, 3, 1
START, S, U, A = range(4)
ROLES = {U: "user", A: "assistant"}
_STATE = {"s": S, "u": U, "a": A}
LEGAL = frozenset({"su", "ua", "au"})
_NEVER = 1 << 60
#: What has to be inserted between a state and a turn of a role, and after the last turn; other pairs can't be.
BETWEEN = {(START, S): (), (START, U): (), (START, A): (U,), (S, U): (), (S, A): (U,), (U, A): (), (U, U): (A,), (A, U): (), (A, A): (U,)}
AFTER = {START: (), S: (U, A), U: (A,), A: ()}


def _options() -> dict[int, list[list[tuple[int, str, int]]]]:
    """By a turn's role and the state before: what may be done besides deleting it, as (cost less that of deleting, letters, state after), by letters."""
    out = {}
    for role in (START, S, U, A):  # START: a role of another kind
        out[role] = []
        for state in (START, S, U, A):
            found = [(KEEP, "K", role)] if role != START else []
            found += [(REROLE, "R", to) for to in (U, A)]
            ways = [(cost + INSERT * len(BETWEEN[state, to]) - DELETE, "I" * len(BETWEEN[state, to]) + letter, to) for cost, letter, to in found if (state, to) in BETWEEN]
            out[role].append(sorted(ways, key=lambda x: (x[1], x[0])))
    return out


OPTIONS = _options()


class Segment:
    """Turns in a row: ``roles`` are states (START for other roles), ``faults`` and ``times`` as in ``turns``."""

    def __init__(self, roles: list[int], faults: list[int], times: list[int]):
        self.roles, self.faults, self.times = roles, faults, times
        self.deleted = DELETE * sum(times)

    def ways(self, leave: int) -> tuple[list[int], list[tuple | None]]:
        """For each state entered, the least cost of leaving in ``leave``; for each turn, what is done by state (None: deleted whatever the state)."""
        least = [_NEVER] * 4
        least[leave] = 0
        chosen: list[tuple | None] = [None] * len(self.roles)
        for j in range(len(self.roles) - 1, -1, -1):
            if self.faults[j] in (BLANK, DUPLICATE):
                continue
            extra, now, how = CUT_SHORT if self.faults[j] == TRUNCATED else 0, [], []
            for state, options in enumerate(OPTIONS[self.roles[j]]):
                best, way = least[state], None  # deleted: D comes before all other letters
                for option in options:
                    if (cost := option[0] + extra + least[option[2]]) < best:
                        best, way = cost, option
                now.append(best)
                how.append(way)
            least, chosen[j] = now, tuple(how)
        return [x + self.deleted if x < _NEVER // 2 else _NEVER for x in least], chosen

    def edits(self, enter: int, chosen: list[tuple | None]) -> list[tuple[str, int]]:
        """For each turn its letters and the state after it."""
        out, state = [], enter
        for how in chosen:
            way = how[state] if how else None
            state = way[2] if way else state
            out.append((way[1] if way else "D", state))
        return out

    def summary(self, entered: tuple[int, ...]) -> tuple[list[int], list[int]]:
        """By state entered and left: the cost, and the place of the letters among the four ways from that state."""
        ways = [self.ways(leave) for leave in range(4)]
        costs, places = [ways[e][0][s] for s in range(4) for e in range(4)], [0] * 16
        for s in entered:
            open_ways = [e for e in range(4) if costs[4 * s + e] < _NEVER]
            if len(open_ways) > 1:
                text = {e: "".join(x + "D" * (t - 1) for (x, _), t in zip(self.edits(s, ways[e][1]), self.times, strict=True)) for e in open_ways}
                for place, e in enumerate(sorted(open_ways, key=text.get)):
                    places[4 * s + e] = place
        return costs, places


def join_segments(segments: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost over all segments in a row, and the states each is entered and left in. For tests; the operator streams."""
    path = Path()
    for costs, places in reversed(segments):
        path.before(costs, places)
    return path.least[START], list(path.states())


class Path:
    """Segments of one conversation, taken from the last to the first: four bytes of each are remembered."""

    def __init__(self):
        self.least, self.left = [INSERT * len(AFTER[e]) for e in range(4)], bytearray()

    def before(self, costs: list[int], places: list[int]) -> None:
        best = [min((costs[4 * s + e] + self.least[e], places[4 * s + e], e) for e in range(4)) for s in range(4)]
        self.least = [min(x[0], _NEVER) for x in best]
        self.left += bytes(x[2] for x in best)

    def states(self) -> Iterator[tuple[int, int]]:
        """States entered and left, from the first segment to the last."""
        state = START
        for k in range(len(self.left) // 4 - 1, -1, -1):
            before, state = state, self.left[4 * k + state]
            yield before, state


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, times, fault``: distinct rows with their number and the fault of the first of them; the others' is that of a duplicate or a blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said")
    rows = scratch.table(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times")).withColumn("said", same), "turns")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")))
    again = rows.groupBy(F.col("conv_id").alias("conv"), F.col("said").alias("again")).agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    again = scratch.table(again.select("conv", "again", F.col("first.turn").alias("first")), "repeated")
    met = rows.join(scratch.sized(again), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("said") == F.col("again")), "left")
    repeats = F.col("again").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    return met.select("conv_id", "turn", "role", "text", "times", fault_of("text", repeats).alias("fault"))


def fault_of(text: str, repeats: Column) -> Column:
    """The first fault of a turn, 0 if it has none."""
    end = F.right(F.rtrim(F.col(text), F.lit(WHITE)), F.lit(1))
    return F.when(end == "", BLANK).when(repeats, DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(0)


_FACTS = "n_blank long, n_duplicate long, n_truncated long, n_illegal long, n_turns long, low long, high long, head string, tail string"
_LISTS = "roles array<string>, texts array<string>, faults array<int>, times array<long>"


def segments(faulty: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """The turns of ``turns``, packed in segments in order, each with its facts, costs and places."""
    conv = faulty.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, segment long, {_LISTS}, {_FACTS}, costs array<long>, places array<int>"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def packed(held: list[tuple], whole: bool) -> tuple:
        turn, roles, texts, times, faults = map(list, zip(*held, strict=True))
        heads = [r[:1] for r in roles]
        later = sum(n - 1 for f, n in zip(faults, times, strict=True) if f != BLANK)  # rows that repeat the one before
        counts = sum(n for f, n in zip(faults, times, strict=True) if f == BLANK), faults.count(DUPLICATE) + later, faults.count(TRUNCATED)
        illegal = sum(times) - len(times) + sum(a + b not in LEGAL for a, b in zip(heads[:-1], heads[1:], strict=True))
        known = [x for x in turn if x is not None]
        costs, places = Segment([_STATE.get(h, START) for h in heads], faults, times).summary((START,) if whole else (START, S, U, A))
        return roles, texts, faults, times, *counts, illegal, len(set(known)), known[0] if known else None, known[-1] if known else None, heads[0], heads[-1], costs, places

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, weight, done, kind = TaskContext.get().partitionId() << 36, [], 0, [], pa.null()
        here, begun, cut = None, False, True  # the first conversation may have begun in another partition, and the last may go on

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [kind, pa.int64(), *kinds], strict=True)], names=names)

        for given in batches:
            kind = given["conv_id"].type
            for conv_id, *row in zip(*(given[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "times", "fault")), strict=True):
                weight += len(row[2])
                other = begun and conv_id != here
                if held and (other or len(held) >= rows or weight > size):
                    done.append((here, number, *packed(held, other and not cut)))
                    number, held, weight = number + 1, [], len(row[2])
                    cut = not other
                here, begun = conv_id, True
                held.append(row)
            yield batch()
        if held:
            done.append((here, number, *packed(held, False)))
            yield batch()

    dealt = faulty.withColumn("begin", F.substring("text", 1, 64))
    ordered = dealt.repartitionByRange("conv_id", "turn", "role", "begin").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "turn", "role", "text", "times", "fault").mapInArrow(words.returning(work), schema)


def joined(cut: DataFrame) -> DataFrame:
    """For each segment the states it is entered and left in, and whether it is the last; on the first one of a conversation also that one's facts.

    ``at, enter, leave, last``, and ``conv_id, gaps, blank, duplicate, truncated, illegal, cost`` (null but for the first, which ``first`` marks).
    """
    conv = cut.schema["conv_id"].dataType.simpleString()
    facts = ["n_blank", "n_duplicate", "n_truncated", "n_illegal", "n_turns", "low", "high", "head", "tail"]
    names = ["conv_id", "at", "enter", "leave", "last", "first", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, path, kind = None, None, pa.null()
        ids, totals, lowest, highest, head = array("q"), [0] * 5, None, None, ""

        def close() -> list[tuple]:
            gaps = highest - lowest + 1 - totals[4] if highest is not None else 0
            n = len(ids)
            return [(here, ids[n - 1 - k], a, b, k == n - 1, k == 0, *((gaps, *totals[:4], path.least[START]) if k == 0 else [None] * 6)) for k, (a, b) in enumerate(path.states())]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [kind, pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

        for given in batches:
            kind, done = given["conv_id"].type, []
            for conv_id, number, costs, places, *counts, low, high, first, tail in zip(*(given[c].to_pylist() for c in ("conv_id", "segment", "costs", "places", *facts)), strict=True):
                if path is None or conv_id != here:
                    if path is not None:
                        done += close()
                    here, path, ids, totals, lowest, highest, head = conv_id, Path(), array("q"), [0] * 5, None, None, None
                path.before(costs, places)
                ids.append(number)
                totals = [a + b for a, b in zip(totals, counts, strict=True)]
                totals[3] += head is not None and tail + head not in LEGAL
                totals[4] -= high is not None and high == lowest  # a turn on both sides of the cut
                lowest, highest, head = lowest if low is None else low, high if highest is None else highest, first
            yield batch(done)
        if path is not None:
            yield batch(close())

    ordered = cut.select("conv_id", "segment", "costs", "places", *facts).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment"))
    return ordered.mapInArrow(work, f"conv_id {conv}, at long, enter int, leave int, last boolean, first boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


def repair(conversations: DataFrame, rows: int = ROWS, size: int = BYTES) -> tuple[DataFrame, DataFrame]:
    """What was found in each conversation, and the edits.

    The first: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost``. The second, in the order
    of each conversation within a partition: ``conv_id, edit, times, role, text``, where ``edit`` is K, R,
    I or D, and D has no role and no text but the number of rows deleted one after the other.
    """
    cut = scratch.table(segments(turns(conversations), rows, size), "segments")
    plan = scratch.table(joined(cut), "plan")
    conv = cut.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "edit", "times", "role", "text"]
        for given in batches:
            done = []
            for conv_id, roles, texts, faults, times, enter, leave, last in zip(*(given[c].to_pylist() for c in ("conv_id", "roles", "texts", "faults", "times", "enter", "leave", "last")), strict=True):
                part = Segment([_STATE.get(r[:1], START) for r in roles], faults, times)
                state = enter
                for (letters, after), role, text, n in zip(part.edits(enter, part.ways(leave)[1]), roles, texts, times, strict=True):
                    if letters != "D":
                        done += [(conv_id, "I", 1, ROLES[x], "") for x in BETWEEN[state, after]]
                        done.append((conv_id, letters[-1], 1, role if letters[-1] == "K" else ROLES[after], text))
                    if deleted := n - (letters != "D"):
                        done.append((conv_id, "D", deleted, None, None))
                    state = after
                if last:
                    done += [(conv_id, "I", 1, ROLES[x], "") for x in AFTER[state]]
            columns = list(zip(*done, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [given["conv_id"].type, pa.string(), pa.int64(), pa.string(), pa.string()], strict=True)], names=names)

    steps = cut.select("conv_id", "segment", "roles", "texts", "faults", "times").join(scratch.sized(plan.select("at", "enter", "leave", "last")), F.col("segment") == F.col("at"))
    edits = steps.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(work, f"conv_id {conv}, edit string, times long, role string, text string")
    return plan.where("first").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"), edits
