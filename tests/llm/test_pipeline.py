"""The pipeline's stages: what they return, and that their decisions take effect."""

import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tidemill.llm import near_dedup, packing

from .conftest import SCHEMA, odd_texts
from .test_dedup import brute_components, distance


def test_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found and sum(k.startswith("op") for k in found) == 13
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "best-fit packing"]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, small).cache()
        assert docs.schema.names == before.schema.names
        assert 0.5 * before.count() < docs.count() <= before.count(), name
    assert near_dedup.deduplicate(docs).where("not kept").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_decisions_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd_texts()], SCHEMA)
    language, lines, near, _ = (f for _, f in corpus_pipeline.STAGES)
    kept = language(spark, docs, "")
    assert not {1, 2, 3, 10} & {r.doc_id for r in kept.collect()}
    cleaned = {r.doc_id: r for r in lines(spark, docs, "").collect()}
    assert cleaned[90].text.startswith("a line that") and cleaned[91].text == "second own line of some length, longer" and 92 not in cleaned
    assert all(r.n_chars == len(r.text) for r in cleaned.values() if r.text)
    left = [r.doc_id for r in near(spark, docs, "").collect()]
    assert {20, 21, 22, 23, 30} & set(left) == {20}


def test_near_stage_decides_by_row(spark):
    """Exactly one row of each component stays, with repeated rows, null doc_ids, and doc_ids that recur with other texts."""
    texts = {i: t for i, t in odd_texts() if i is not None and t}
    a, near_a, b, c, d = texts[20], texts[31], texts[50], texts[51], texts[52]
    rows = [(1, a), (1, a), (2, near_a), (None, near_a), (None, a), (2, b), (2, c), (3, c), (None, d), (None, d), (4, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    got = corpus_pipeline.near_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (2, b), (2, c), (None, d), (4, None), (4, ""), (4, "")])


def brute_pipeline(rows, hashes):
    """Rows of the last stage for (doc_id, text) rows in one language, by comparing everything with everything."""
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in rows if any(unicodedata.category(c)[0] == "L" for c in t or "")]
    # lines, in the order of doc_id, hash of the text, place
    order = sorted(rows, key=lambda r: (r[0], hashes[r[1]]))
    first = {}
    places = [(i, t, k, line) for i, t in order for k, line in enumerate(t.split("\n")) if line.strip()]
    for n, p in enumerate(places):
        first.setdefault(p[3], n)
    gone = {
        (i, t, k)
        for n, (i, t, k, line) in enumerate(places)
        if first[line] < n or len(line) > 2 and any(len(x) > 2 and m < first[line] and abs(len(x) - len(line)) <= 2 and distance(x, line) <= 2 for x, m in first.items())
    }
    cleaned = [(i, t, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, t, k) not in gone)) for i, t in rows]
    rows = [(i, new) for i, t, new in cleaned if new == t or new.strip()]
    # one row of each component: the smallest doc_id
    kept, seen = [], set()
    for (i, t), (_, n, component) in sorted(zip(rows, brute_components(rows, 5, 80), strict=True), key=lambda x: x[0][0]):
        if n and component not in seen or not n:
            kept.append((i, t))
            seen.add(component)
    tok = Tokenizer.from_file(packing.byte_bpe_path())
    out = Counter()
    for i, t in kept:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        head = (len(ids) - 1) % packing.CAPACITY + 1
        cuts = [0, *range(head, len(ids), packing.CAPACITY), len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            out[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    return out


def test_run_against_brute_force(spark, small, tmp_path):
    """The whole pipeline on documents of the table with planted copies, near copies, shared lines and texts without letters."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").where("lang = 'en'").orderBy(F.length("text"), "doc_id").limit(30).collect()]
    texts = [t for _, t in rows]
    long = " ".join(f"{t} and the other words of it" for t in texts[:12])
    rows += [(10_000, texts[3]), (10_001, texts[20] + " more"), (10_002, long), (10_003, long.replace("other", "othre", 1)), (10_004, "12345 ½ !!!"), (10_005, None), (10_006, ""), (10_007, "a line that is the only one\n" + texts[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_pipeline(rows, hashes)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) > 20


def test_run(spark, small):
    got = corpus_pipeline.run(spark, small).collect()
    assert len({r.doc_id for r in got}) > 100 and sum(r.length for r in got) <= 2048 * len({r.sequence_id for r in got})


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    """An empty table goes through all stages."""
    from .conftest import SCHEMA

    nothing.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns
