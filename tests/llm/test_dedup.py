"""Exact dedup, near-dedup, line dedup and components against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import exact_dedup, graph, line_dedup, near_dedup, queries

from .conftest import odd_texts, words


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for size, top in ((1, 10), (1, 2**40), (500, 600), (3000, 2**44)):
        values = np.unique(rng.integers(0, top, size))
        assert (exact_dedup.decode(len(values), *exact_dedup.code(values)) == values).all()


def test_exact_dedup(odd):
    rows = odd_texts()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    want = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        for i, _ in members:
            want[i, best, len(members), hashlib.sha256(norm.encode()).hexdigest()] += 1
    got = exact_dedup.deduplicate(odd).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys((hashlib.sha256(n.encode()).hexdigest() for n in groups), 1)


def test_exact_dedup_with_short_fingerprints(odd):
    """With 12 bits many rows are suspected in vain; the bytes decide."""
    key = lambda r: (str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256)
    assert sorted(map(key, exact_dedup.deduplicate(odd, bits=12).collect())) == sorted(map(key, exact_dedup.deduplicate(odd).collect()))


def test_exact_dedup_in_small_parts(odd):
    """A partition in many parts: copies within a part, between the parts of a partition and between partitions."""
    key = lambda r: (str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256)
    want = sorted(map(key, exact_dedup.deduplicate(odd).collect()))
    for parts in (1, 5):
        assert sorted(map(key, exact_dedup.deduplicate(odd, part_rows=parts).collect())) == want


def test_owners_follow_the_rows():
    assert [exact_dedup.owners_of(n, 8) for n in (0, 10**6, 8 * exact_dedup.OWNER_ROWS, 8 * exact_dedup.OWNER_ROWS + 1)] == [8, 8, 8, 16]
    assert 10**10 / exact_dedup.owners_of(10**10, 200) <= exact_dedup.OWNER_ROWS


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                comp[root(a)] = root(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[root(a)].append(i)
    ids = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return [(i, len(s), ids[root(a)]) for a, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("k", "percent"), [(4, 80), (5, 80), (1, 60)])
def test_near_dedup_on_odd_rows(odd, k, percent):
    want = brute_components(odd_texts(), k, percent)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.deduplicate(odd, k, percent).collect()]
    assert Counter(got) == Counter(want)


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """Copies with edits of one text, most of them unlike each other, in blocks of a few members."""
    rng = random.Random(3)
    base, rows = words(rng, 120), []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 8)):
            own[rng.randrange(len(own))] = "".join(rng.choice("klmnop") for _ in range(5))
        rows.append((1000 - i, " ".join(own)))
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 20)
    got = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 4, 80))


def test_a_long_document_in_a_bucket(spark, monkeypatch):
    """Sets of many sizes in one bucket: the links join what brute force joins, and the long set is not sent around."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 3000)
    base = rng.integers(0, 2**63, 400_000).astype(np.uint64)
    sets = {0: base}
    for k in range(1, 60):
        size = int(rng.integers(20, 200))
        sets[k] = np.concatenate((base[: size - size // 12], rng.integers(0, 2**63, size // 12).astype(np.uint64)))
    sets = {k: np.unique(x) for k, x in sets.items()}
    table = spark.createDataFrame([(k, len(x), bytearray(x.tobytes())) for k, x in sets.items()], "id long, n long, shingles binary")
    members = spark.createDataFrame([(7, k) for k in sets], "key long, id long")
    seen = []
    monkeypatch.setattr(near_dedup.scratch, "table", lambda df, name, f=near_dedup.scratch.table: seen.append((name, f(df, name))) or seen[-1][1])
    links = near_dedup.rest_of_buckets(members, spark.createDataFrame([], "id long, comp long"), table, 80)
    got = {r.id: r.comp for r in graph.components(links).collect()}
    roots = {k: k for k in sets}
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((roots[a], roots[b]))
                roots = {k: low if r == high else r for k, r in roots.items()}
    assert {k: got.get(k, k) for k in sets} == roots and len(set(roots.values())) > 2
    assert all(df.where("id = 0").count() <= 2 for name, df in seen if name == "members")


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        a = rng.integers(0, 2**63, 2000).astype(np.uint64)
        b = np.concatenate((a[: int(2000 * share)], rng.integers(0, 2**63, 2000 - int(2000 * share)).astype(np.uint64)))
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([2000.0]), np.array([2000.0]))[0]
        assert abs(found - truth) < 0.2


def test_registers_merge():
    rng = np.random.default_rng(6)
    a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (700, 900))
    assert (np.maximum(near_dedup.registers(a), near_dedup.registers(b)) == near_dedup.registers(np.union1d(a, b))).all()


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(5, 5)]
    got = {r.id: r.comp for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(7, 30), 7)}


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup(spark, edits):
    rng = random.Random(1)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(8, 20))) for _ in range(25)]

    def edited(line):
        line = list(line)
        for _ in range(rng.randint(0, 3)):
            k, what = rng.randint(0, len(line)), rng.randint(0, 2)
            if what == 0:
                line.insert(k, rng.choice("abé "))
            elif k < len(line):
                line[k : k + 1] = rng.choice("abé ") if what == 1 else ""
        return "".join(line)

    rows = [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "x\n\n" + base[0]), (5, base[1]), (5, base[1]), (7, "short\nshort")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_lines string")
    places = list({(i is not None, i or 0, t, k, line) for i, t in rows if t for k, line in enumerate(t.split("\n")) if line.strip()})
    keys = {(r.doc_id, r.text): r.xh for r in docs.selectExpr("doc_id", "text", "xxhash64(text) xh").collect()}
    places.sort(key=lambda p: (p[0], p[1], keys[p[1] if p[0] else None, p[2]], p[3]))
    first = {}
    for n, p in enumerate(places):
        first.setdefault(p[4], n)
    gone = set()
    for n, (there, i, text, k, line) in enumerate(places):
        earlier = first[line] < n or len(line) >= 8 and any(len(x) >= 8 and m < first[line] and abs(len(x) - len(line)) <= edits and distance(x, line) <= edits for x, m in first.items())
        if earlier:
            gone.add((i if there else None, text, k))
    want = Counter((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, t, k) not in gone)) for i, t in rows)
    got = line_dedup.deduplicate(docs, edits, 8).collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.n_lines >= r.n_dropped for r in got)


def test_short_lines_are_compared_by_default(spark):
    """The registered floor against brute force, on lines of 1 to 31 characters."""
    rng = random.Random(8)
    lines = ["Are is anwh reenen.", "Are. Is anwh reenen.", "abc", "abd", "x", "y", "ab", "b"]
    for n in (3, 4, 5, 9, 16, 31):
        base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        lines += [base, base[:-1] + "#", "@" + base[1:-1] + "%", "+-*" + base[3:], base + "!", base + "!?:"]
    lines = list(dict.fromkeys(lines))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_dropped for r in line_dedup.deduplicate(docs).collect()}
    want = {k: int(len(x) > 2 and any(len(y) > 2 and distance(x, y) <= 2 for y in lines[:k])) for k, x in enumerate(lines)}
    assert got == want and want[1] == want[3] == 1


def brute_lines(lines, edits=2):
    """1 for each line of a list of different ones, one a document, that is near an earlier one."""
    return {k: int(any(abs(len(x) - len(y)) <= edits and distance(x, y) <= edits for y in lines[:k])) for k, x in enumerate(lines)}


@pytest.mark.parametrize("kind", ["numbers", "sparse", "mixed"])
def test_hot_segments(spark, monkeypatch, kind):
    """Lines of a template, with few or many near ones among them, against brute force; segments of more than three lines are hot."""
    monkeypatch.setattr(line_dedup, "HOT", 3)
    rng = random.Random(6)
    if kind == "numbers":
        lines = [f"user {k} logged in" for k in rng.sample(range(3000), 150)]
    elif kind == "sparse":
        lines = [f"id {rng.randrange(10**12):012d} of the long template {rng.randrange(10**6)} of lines" for _ in range(120)]
    else:
        lines = [f"{rng.choice(('get', 'post', 'put'))} /page/{rng.randrange(400)}/item{rng.choice('abc')} took {rng.randrange(50)} ms" for _ in range(110)]
        lines += [x[: rng.randrange(len(x))] + rng.choice(("", "x", "yz")) + x[rng.randrange(len(x)) :] for x in lines[:30]]
    lines = [x for x in dict.fromkeys(lines) if len(x) > 2]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.n_dropped for r in line_dedup.deduplicate(docs).collect()} == brute_lines(lines)


def test_line_query(spark, small):
    """The registered query on its whole small table, against all pairs of lines of about one length and the same letters."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(rows, key=lambda r: (r.doc_id, r.h))
    places = [(r.doc_id, k, line) for r in order for k, line in enumerate((r.text or "").split("\n")) if line.strip()]
    first = {}
    for n, (_, _, line) in enumerate(places):
        first.setdefault(line, n)
    lines = [x for x in first if len(x) > 2]
    signs = {c: k for k, c in enumerate(sorted({c for x in lines for c in x}))}
    counts = np.zeros((len(lines), len(signs)), np.int32)
    for k, x in enumerate(lines):
        np.add.at(counts[k], [signs[c] for c in x], 1)
    size, rank, late = counts.sum(1), np.array([first[x] for x in lines]), set()
    for k, x in enumerate(lines):
        near = np.flatnonzero((rank < rank[k]) & (abs(size - size[k]) <= 2))
        near = near[abs(counts[near] - counts[k]).sum(1) <= 4]
        if any(distance(lines[j], x) <= 2 for j in near.tolist()):
            late.add(x)
    gone = {(i, k) for n, (i, k, line) in enumerate(places) if first[line] < n or line in late}
    kept = {r.doc_id: "\n".join(x for k, x in enumerate((r.text or "").split("\n")) if (r.doc_id, k) not in gone) for r in rows}
    got = queries.op8_line_dedup(spark, small).collect()
    assert {r.doc_id: (r.n_chars_kept, r.kept_sha256) for r in got} == {i: (len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept.items()}
    assert sum(r.n_dropped for r in got) == len(gone) > 20 and len(late) > 0


def test_line_dedup_on_odd_rows(odd):
    got = line_dedup.deduplicate(odd).collect()
    assert len(got) == len(odd_texts())
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].text is None and by_id[2].text == "" and by_id[42].n_dropped == 49
    assert by_id[91].text == "second own line of some length, longer" and by_id[92].text == ""


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, small, oracle):
    got = queries.QUERIES[name](spark, small)
    names = sorted(got.columns)
    want = oracle.execute(queries.ORACLE_SQL[name])
    order = [c[0] for c in want.description]
    assert sorted(order) == names
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(tuple(r[order.index(c)] for c in names) for r in want.fetchall())


def test_empty_tables(nothing):
    assert exact_dedup.deduplicate(nothing).count() == 0
    assert near_dedup.deduplicate(nothing).count() == 0
    assert line_dedup.deduplicate(nothing).count() == 0
