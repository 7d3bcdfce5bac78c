"""Top-k search, fill-in-the-middle and conversation repair, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import conversation_repair, fill_middle, queries, topk_search

from .conftest import odd_texts

# --- top-k search


def brute_top(rows, asks, k):
    """(query_id, rank, vec_id, score) of every query row against all other rows."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(whole):
        if asks(i):
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0) for other, (j, w) in enumerate(whole) if other != at)
            out += [(i, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(found[:k])]
    return Counter(out)


def vectors(seed, n, dims, copies=0):
    rng = random.Random(seed)
    rows = [(k, [round(rng.uniform(-1, 1), 3) for _ in range(dims)]) for k in range(n)]
    rows += [(n + k, rows[0][1]) for k in range(copies)]  # one vector under many ids
    rows += [(50, rows[1][1])] * 3 + [(7, rows[2][1])] * 9  # repeated rows, queries among them
    rows += [(None, rows[3][1]), (None, None), (100, None), (150, []), (200, [0.5, None]), (250, [float("nan")]), (300, [float("inf")] * dims), (350, [0.25] * (dims - 1)), (400, [2.0] * (dims + 2))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "dims", "copies", "tile"), [(1, 120, 3, 0, 1024), (2, 300, 4, 150, 2)])
def test_top_k_equals_brute_force(spark, monkeypatch, seed, n, dims, copies, tile):
    for name, value in (("BLOCK", 8), ("RANGE", 4), ("UNIT", 4), ("TILE", tile), ("PIVOTS", 8)):
        monkeypatch.setattr(topk_search, name, value)
    rows = vectors(seed, n, dims, copies)
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("vector", "copies", "asks", "code", "dealt", "block", "range", "rank", "score", "data", "tile", "unit", "query_id", "label")}).repartition(3)
    got = topk_search.top_k(given, F.col("vec_id") % 50 == 0, 5)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert Counter(tuple(r) for r in got.collect()) == brute_top(rows, lambda i: i is not None and i % 50 == 0, 5)


def test_top_k_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk_search.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert topk_search.top_k(spark.createDataFrame([(1, [1.0])], schema), F.col("vec_id") % 50 == 0).count() == 0
    two = topk_search.top_k(spark.createDataFrame([(0, [1.0]), (3, [-0.5])], schema), F.col("vec_id") % 50 == 0)
    assert [tuple(r) for r in two.collect()] == [(0, 1, 3, -32768)]
    with pytest.raises(ValueError):
        topk_search.top_k(two, F.lit(True), 0)


def block(number, ids, values):
    held = np.array(values, "<i4")
    return {"block": number, "vec_ids": ids, "copies": [1] * len(ids), "data": held.tobytes(), "high": held.max(0).tobytes(), "low": held.min(0).tobytes()}


def test_bounds_spare_blocks():
    """Blocks apart from the query are not scored, and ties at the bound still are."""
    index = [block(b, [10 * b + i for i in range(4)], [[b * 100 + i, 0] for i in range(4)]) for b in range(16)]
    own = np.array([[99, 0]])
    best, scored = topk_search.search(index, np.array([[1, 0]], np.int32), own, 3, np.array([topk_search.NOTHING]))
    assert best.vec.tolist() == [153, 152, 151] and scored <= 3
    same = [block(b, [10 * b], [[5, 5]]) for b in range(8)][::-1]
    best, scored = topk_search.search(same, np.array([[1, 1]], np.int32), own, 2, np.array([topk_search.NOTHING]))
    assert best.vec.tolist() == [0, 10] and scored == 8


def test_products_stay_exact():
    large = np.array([[topk_search.LARGEST] * 64], np.int32)
    assert topk_search.exact(large, large) is np.int64
    best, _ = topk_search.search([block(0, [1, 2], [[topk_search.LARGEST] * 64, [topk_search.LARGEST] * 63 + [topk_search.LARGEST - 1]])], large, np.array([[9, 9]]), 2, np.array([topk_search.NOTHING]))
    assert best.score.tolist() == [64 << 48, (64 << 48) - (1 << 24)]


# --- fill-in-the-middle


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abZ é😀\n[`{@<P>", max_size=60), st.integers(1, 7), st.integers(1, 9))
def test_checkpoints_find_every_cut(text, step, window):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    points = fill_middle.Checkpoints(text.encode(), step, window)
    assert (points.units, points.chars, len(points.unit)) == (len(units), len(text), -(-len(units) // step))
    for k in range(len(units) + 2):
        before = "".join(units[:k])
        assert points.cut(k) == (len(before.encode()), len(before))


def test_middle_of_odd_rows(spark, odd, nothing):
    out = fill_middle.transform(odd, step=4)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((i, *brute_middle(i, t)) for i, t in odd_texts())
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in odd_texts())
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(nothing).count() == 0


def test_middle_with_marks(spark):
    texts = ["a<P>b", "<S>", "x <M> y", "<P", "S>", "<<P", "a<P b>S><M", "P>", "<" * 50, ">" * 50, "<p>"]
    rows = [(k * 100 + j, t) for k in range(40) for j, t in enumerate(texts)]
    out = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.form, r.output, r.back) for r in out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()}
    assert {i: got[i] for i, _ in rows} == {i: (brute_middle(i, t)[1], brute_middle(i, t)[4], t) for i, t in rows}


def test_middle_of_a_very_long_text(spark):
    text = ("word " * 30_000 + "x" * 700_000 + "é" * 10_000) * 2
    docs = spark.createDataFrame([(k, text) for k in range(8)], "doc_id long, text string")
    got = fill_middle.transform(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got} == {(k, *brute_middle(k, text)) for k in range(8)}
    assert all(r.back == text for r in got)


# --- conversation repair


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        tip = re.sub(r"[ \t-\r]+\Z", "", text)[-1:]
        out.append("blank" if not tip else "duplicate" if (role, text) in seen else "truncated" if tip not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired turns: every sequence of edits is tried, with two inserts anywhere."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    found, known = faults(rows), [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows[:-1], rows[1:], strict=True))
    paths = {("", 0, "", ())}  # all ways so far: the last initial, the cost, the audit, the turns

    def inserted(given):
        out = set(given)
        for _ in range(2):
            out |= {("u" if last != "u" else "a", cost + 2, audit + "I", (*turns, "user:" if last != "u" else "assistant:")) for last, cost, audit, turns in out}
        return out

    for (_, role, text), fault in zip(rows, found, strict=True):
        now = set()
        for last, cost, audit, turns in inserted(paths):
            now.add((last, cost + 3, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            head = role[:1]
            if (last, head) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                now.add((head, cost + extra, audit + "K", (*turns, f"{role}:{text}")))
            to = "a" if last == "u" else "u"
            now.add((to, cost + 2 + extra, audit + "R", (*turns, f"{'user' if to == 'u' else 'assistant'}:{text}")))
        paths = now
    done = [(cost, audit, turns) for last, cost, audit, turns in inserted(paths) if last in ("", "a")]
    cost, audit, turns = min(done)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(turns)


def conversations(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for k in range(rng.randint(1, most)):
            turn = None if rng.random() < 0.05 else k + rng.randint(0, 1)
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No!", "Why", "so what? \n", "", " \t", None, f"Own text {rng.randint(0, 99)}."])))
            if rng.random() < 0.15:
                rows += [rows[-1]] * rng.randint(1, 2)
    rng.shuffle(rows)
    return rows


def repaired(found, edits):
    counts = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost) for r in found.collect()}
    told = {}
    for part in edits.rdd.glom().collect():  # rows of a conversation are together and in order
        for r in part:
            told.setdefault(r.conv_id, []).append(r)
    return {c: (*n, "".join(r.edit * r.times for r in told[c]), "\n".join(f"{r.role}:{r.text}" for r in told[c] if r.edit != "D")) for c, n in counts.items()}


@pytest.mark.parametrize(("seed", "rows", "size"), [(1, 256, 1 << 14), (2, 1, 1 << 14), (3, 2, 1 << 14), (4, 256, 12)])
def test_repair_equals_brute_force(spark, seed, rows, size):
    """Also with segments of one or two turns, or a few bytes."""
    given = conversations(seed, 60, 5)
    clash = {c: F.lit("clash") for c in ("times", "said", "fault", "again", "first", "conv", "segment", "begin", "at", "enter", "cost", "n", "copy", "draw")}
    docs = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").withColumns(clash).repartition(3)
    got = repaired(*conversation_repair.repair(docs, rows, size))
    by = {}
    for conv, *row in given:
        by.setdefault(conv, []).append(tuple(row))
    assert got == {c: brute_repair(r) for c, r in by.items()}


def test_a_hot_conversation_is_cut_and_put_together(spark):
    """One conversation with most rows, and a row that is there a thousand times: cut or whole, the repair is the same."""
    rng = random.Random(5)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice([f"Text {k}.", f"text {k}", "again."])) for k in range(1500)]
    rows += [(1, 700, "user", "the same.")] * 1000 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    cut = conversation_repair.segments(conversation_repair.turns(docs), rows=16)
    assert cut.where("conv_id = 1").count() > 90
    small, large = (repaired(*conversation_repair.repair(docs, n)) for n in (16, 100_000))
    assert small == large and small[2][-2:] == ("KK", "user:Hi.\nassistant:Ho.")
    assert small[1][6].count("D") >= 999 and re.fullmatch("(user:.*\nassistant:.*\n?)+", small[1][7])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(1, 3)), min_size=1, max_size=12), st.lists(st.integers(1, 11), max_size=4))
def test_segments_put_together_are_the_whole(rows, cuts):
    part = lambda x: conversation_repair.Segment(*map(list, zip(*x, strict=True)))

    def letters(edges):
        parts = [part(rows[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        cost, states = conversation_repair.join_segments([p.summary((0, 1, 2, 3)) for p in parts])
        return cost, [x for p, (enter, leave) in zip(parts, states, strict=True) for x in p.edits(enter, p.ways(leave)[1])]

    assert letters(sorted({0, len(rows), *(c for c in cuts if c < len(rows))})) == letters([0, len(rows)])


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found, edits = conversation_repair.repair(empty)
    assert found.count() == edits.count() == 0


def test_repair_query_on_odd_rows(spark, tmp_path):
    """The damage as stated, conversations that lose all rows, and nulls, against a plain version."""
    import zlib

    given = conversations(9, 150, 4) + [(1000 + k, 1, "user", "Alone.") for k in range(60)]
    spark.createDataFrame(given, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    by = {}
    for conv, turn, role, text in given:
        rows = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        rows += [(turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    want = {c: brute_repair(rows) if rows else (0, 0, 0, 0, 0, 0, "", "") for c, rows in by.items()}
    out = queries.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out} == {c: (*x[:7], hashlib.sha256(x[7].encode()).hexdigest()) for c, x in want.items()}
    assert len(out) == len(want) and any(not rows for rows in by.values())


def test_new_queries_equal_sql(spark, small, oracle):
    for name in ("op11_topk_search", "op12_fill_middle", "op13_conversation_repair"):
        got = queries.QUERIES[name](spark, small)
        want = oracle.execute(queries.ORACLE_SQL[name])
        order = [c[0] for c in want.description]
        assert sorted(map(str, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(str, want.fetchall()))
