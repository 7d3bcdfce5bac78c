"""Language ID, SentencePiece, packing, fingerprints, sharding, chat formatting and HTML extraction."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import chat_format, fingerprint, html_extract, language_id, packing, queries, sentencepieces, sharding
from tidemill.llm import words as fast

from .conftest import odd_texts

CASES = ["", " ", "  ", " a", "a  b", "a\n\n b ", "日本 語\t🙂 x", "▁ a▁b", "a   b\n c", "\x00 x", "<s> </s> <unk>", "it's  we'll\r\n \n end ", "<|endoftext|> text", "é" * 300, "tab\t\tx   y z"]


# --- words and packing


def test_chunked_ids_are_those_of_the_whole_text():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.byte_bpe_path())
    tok.encode_special_tokens = True
    ids, begin = packing.encoder(packing.byte_bpe_path())(pa.array(CASES))
    for k, text in enumerate(CASES):
        assert ids[begin[k] : begin[k + 1]].tolist() == tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sé1.▁ ", max_size=25), min_size=1, max_size=4))
def test_chunked_ids_of_any_text(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.byte_bpe_path()) if not hasattr(test_chunked_ids_of_any_text, "tok") else test_chunked_ids_of_any_text.tok
    test_chunked_ids_of_any_text.tok = tok
    ids, begin = packing.encoder(packing.byte_bpe_path())(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_slices_cover_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "x" * 50, "", "y"])], names=["text"])
    assert [x for part in fast.slices(batch, "text", 5) for x in part["text"].to_pylist()] == batch["text"].to_pylist()


@pytest.mark.parametrize("seed", range(4))
def test_configurations_hold_the_histogram(seed):
    rng = random.Random(seed)
    lengths = [min(64, max(1, int(rng.expovariate(1 / 20)))) for _ in range(rng.choice((1, 50, 5000)))]
    plan = packing.configurations(Counter(lengths), 64)
    held = Counter()
    for items, times in plan:
        assert sum(items) <= 64 and times > 0
        for n in items:
            held[n] += times
    assert held == Counter(lengths)
    least = -(-sum(lengths) // 64)
    assert sum(t for _, t in plan) <= least * 1.02 + 2


@pytest.mark.parametrize("histogram", [{n: 50 for n in range(1, 257)}, {85: 90, 86: 70, 171: 60, 40: 300, 1: 5}, {100: 9, 70: 9, 43: 9, 30: 7}, {256: 3}, {1: 1000}])
def test_packing_is_no_worse_than_best_fit(histogram):
    used = sum(k for _, k in packing.configurations(histogram, 256))
    assert packing.least_sequences(histogram, 256) <= used <= sum(k for _, k in packing.best_fit(histogram, 256))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_packing_of_few_pieces_against_every_way(lengths):
    """At most one sequence more than the fewest of all ways."""

    def fewest(rest, rooms):
        if not rest:
            return len(rooms)
        n, after = rest[0], rest[1:]
        best = fewest(after, [*rooms, 12 - n])
        for k in {r: i for i, r in enumerate(rooms) if r >= n}.values():
            best = min(best, fewest(after, [*rooms[:k], rooms[k] - n, *rooms[k + 1 :]]))
        return best

    used = sum(k for _, k in packing.configurations(Counter(lengths), 12))
    assert packing.least_sequences(Counter(lengths), 12) <= fewest(lengths, []) <= used <= fewest(lengths, []) + 1


@pytest.mark.parametrize("page", ["<p>word " * 80_000 + "</b>" * 80_000, "<a " * 300_000 + "'", "<a \"" * 200_000 + "'", "<li>x " * 160_000, "<" + "a" * 900_000 + " '", "<a" * 400_000 + " '", "</a " * 200_000 + "'", "<article>" + "<form>" * 70_000 + "</nav>" * 70_000, "<a b=\"c' d>" * 80_000 + '"'])
def test_broken_markup_takes_time_in_proportion(page):
    """Pages of about a megabyte that took minutes to hours when each tag looked for its own end."""
    import time

    start = time.time()
    html_extract.count(page)
    html_extract.main_text(page, html_extract.Shares())
    assert time.time() - start < 60


def test_tags_without_an_end_are_text():
    seen = [text for f, text, _ in html_extract.tokens("<p>one <a 'two <b>three") if f[0] == "w"]
    assert "".join(seen) == "one <a 'two three"
    assert [f[1] for f, _, _ in html_extract.tokens("<div><p>a</b></p></div>") if f[0] == "<"] == ["div", "p", "/b", "/p", "/div"]


def test_packing_of_odd_rows(odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.byte_bpe_path())
    got = packing.pack(odd, capacity=256).toPandas()
    want = Counter()
    for i, t in odd_texts():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids), 256), len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[-1 if i is None else i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 256


def test_packing_keeps_large_and_null_ids(spark, nothing, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    ids = [2**53 + 1, None, 2**53 + 3, *range(30)]
    docs = spark.createDataFrame([(i, "one and the same text") for i in ids], "doc_id long, text string")
    got = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(ids)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(ids)
    assert packing.pack(nothing).count() == 0


def test_packing_query(spark, small):
    got = queries.op5_best_fit_packing(spark, small).toPandas()
    assert set(got.doc_id) == {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()}
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 2048) + 1


# --- language ID


def test_language_of_held_out_rows(spark, small):
    got = queries.op2_language_id(spark, small).toPandas()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    unseen = got[got.held_out]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (unseen.lang_pred == unseen.doc_id.map(truth)).mean() > 0.97 and len(unseen) > 20
    assert got.score.between(0, 1).all()


def brute_likelihood(word, prob, letters):
    if not word:
        return 1.0
    return sum((prob.get(word[:k]) or (language_id.UNKNOWN if k == 1 else 0)) * brute_likelihood(word[k:], prob, letters) for k in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    prob = {"▁": 0.1, "a": 0.2, "ab": 0.15, "▁a": 0.1, "b": 0.05, "ba": 0.2, "bab": 0.2}
    model = language_id.Model(["x"], list(prob), np.array(list(prob.values()))[:, None])
    given_words = ["▁abab", "▁b", "▁zab", "ab"]
    assert np.allclose(np.exp(model.likelihood(given_words)[:, 0]), [brute_likelihood(w, prob, None) for w in given_words])
    # expected uses: the pieces of each segmentation spell the word
    uses = model.expected(["▁abab"], np.ones((1, 1)))[:, 0]
    assert abs(sum(u * len(p) for u, p in zip(uses, prob, strict=True)) - 5) < 1e-6


def test_long_words_are_summed_whole(monkeypatch):
    """The logarithms of long words against the plain sums, in blocks that cut them; and no word is cut."""
    rng = random.Random(9)
    pieces = sorted({"▁", *"abc", *("".join(rng.choice("abc") for _ in range(rng.randint(2, 16))) for _ in range(60))})
    table = np.random.default_rng(1).random((len(pieces), 2)) / 40
    model = language_id.Model(["x", "y"], pieces, table)
    given_words = ["▁" + "".join(rng.choice("abcz") for _ in range(n)) for n in (1, 9, 20, 23)]
    times = np.random.default_rng(2).random((4, 2))
    plain, uses = model.likelihood(given_words), model.expected(given_words, times)
    for block in (5, 4096):
        monkeypatch.setattr(language_id, "BLOCK", block)
        monkeypatch.setattr(language_id, "SHORT", 0)
        assert np.allclose(model.likelihood(given_words), plain) and np.allclose(model.expected(given_words, times), uses)
    long = model.likelihood(["▁" + "ab" * 3000])
    assert np.isfinite(long).all() and (long < model.likelihood(["▁" + "ab" * 2999])).all()
    assert language_id.in_words("x" * 500) == ["▁" + "x" * 500]
    monkeypatch.undo()
    assert max(map(len, language_id.vocabulary())) == language_id.Model(["x"], language_id.vocabulary(), np.ones((len(language_id.vocabulary()), 1))).longest > 12


def test_letters_are_those_of_the_category(spark):
    docs = spark.createDataFrame([(k, "plain words of prose", "en") for k in range(8)] + [(100, "½² ①", None), (101, "Ⅷ 12", None), (102, "½ a", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs).collect()}
    assert got[100] == got[101] == ("und", 0.0) and got[102][0] == "en"


def test_training_rows_of_a_huge_language(spark, monkeypatch):
    """A share that rounds to nothing still trains on a row at least where the hash allows; nothing is set for the session."""
    docs = spark.createDataFrame([(k, "plain words", "en") for k in range(40)], "doc_id long, text string, lang string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(language_id, "HASHES", 4)
    assert {r.lang_pred for r in language_id.predict(docs, train_rows=1).collect()} == {"en"}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_language_query_against_brute_force(spark, small):
    """The registered query against sums over all segmentations, word by word, under the same model."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.train(docs)
    number = {p: k for k, p in enumerate(language_id.vocabulary())}

    def log_sums(word):
        sums = [np.ones(len(model.languages))]
        for end in range(1, len(word) + 1):
            total = np.zeros(len(model.languages))
            for start in range(end):
                k = number.get(word[start:end])
                total += sums[start] * (model.table[k] if k is not None else language_id.UNKNOWN if end == start + 1 else 0)
            sums.append(total)
        return np.log(sums[-1])

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op2_language_id(spark, small).collect()}
    for i in sorted(texts, key=lambda i: len(texts[i]))[:60]:
        total = sum(map(log_sums, language_id.in_words(texts[i])), np.zeros(len(model.languages)))
        odds = np.exp(total - total.max())
        if language_id.in_words(texts[i]):
            assert got[i].lang_pred == model.languages[int(odds.argmax())] and abs(got[i].score - 1 / odds.sum()) < 1e-6
        else:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)


def test_new_words_are_scored_in_small_slices():
    """However many strings of a batch are new, about a megabyte of them is looked at together."""
    rng = random.Random(6)
    texts = pa.array([" ".join("".join(rng.choices("xyz", k=12)) for _ in range(400)) for _ in range(600)])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    sizes = [sum(len(x) for x in part["text"].to_pylist()) for part in fast.slices(batch, "text", language_id.SLICE_BYTES)]
    assert sum(sizes) > 3_000_000 and max(sizes) <= (1 << 20)
    assert language_id.REMEMBERED <= fast.CACHE_BYTES // 2


def test_language_of_odd_rows(odd, nothing):
    got = language_id.predict(odd)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == rows[10].lang_pred == "und" and rows[10].score == 0
    assert rows[41].lang_pred in ("en", "fr") and rows[9].lang_pred in ("en", "fr")
    assert got.count() == len(odd_texts())
    assert language_id.predict(nothing).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- SentencePiece


def test_parity_with_sentencepiece():
    from sentencepiece import SentencePieceProcessor

    native = SentencePieceProcessor(model_file=sentencepieces.model_path())
    own = sentencepieces.Backend(sentencepieces.model_path())
    ids, begin = own.encode(pa.array(CASES))
    for k, text in enumerate(CASES):
        want = native.encode(text)
        assert ids[begin[k] : begin[k + 1]].tolist() == want
    odd_ids = [[1, 0, 300, 2], [], [1], [230, 231, 5000, 240], [300, 1, 301], [0, 0], list(range(3, 259)), [3 + 0xC3, 3 + 65, 3 + 0xC3, 3 + 0xA9, 3 + 0xF0, 3 + 0x9F], [29871, 29871, 500]]
    given = [*native.encode(CASES), *odd_ids]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in given])))
    assert own.decode(np.array([i for x in given for i in x], np.int32), starts).to_pylist() == native.decode(given)


def test_unigram_model_is_rebuilt(tmp_path):
    """A unigram model written by hand: the library's best segmentation is that of the scores."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    proto = ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{k:02X}>", 0, 6) for k in range(256)), ("▁", -3, 1), ("a", -2, 1), ("b", -2.5, 1), ("ab", -3, 1), ("▁ab", -3.5, 1), ("ba", -5, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.unk_id = 1, True, 0
    proto.normalizer_spec.name, proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = "identity", True, False, True
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    native, own = SentencePieceProcessor(model_file=str(path)), sentencepieces.Backend(str(path))
    texts = ["ab", "ab ba abba", "b a  b", "é ab", ""]
    ids, begin = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == native.encode(texts)


def test_user_defined_pieces(tmp_path):
    """Pieces that a model's user defined are taken first, also inside words and with blanks."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    proto = ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("<sep>", 0, 4), *((f"<0x{k:02X}>", 0, 6) for k in range(256)), ("▁a", 0, 1), ("ab", -1, 1), ("▁", -2, 1), ("a", -3, 1), ("b", -4, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.unk_id = 2, True, 0
    proto.normalizer_spec.name, proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = "identity", True, False, True
    path = tmp_path / "user.model"
    path.write_bytes(proto.SerializeToString())
    native, own = SentencePieceProcessor(model_file=str(path)), sentencepieces.Backend(str(path))
    texts = ["ab<sep>ab", "a <sep> b", "<sep>", "ba é<sep>", ""]
    ids, begin = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == native.encode(texts)
    assert own.decode(ids, begin).to_pylist() == native.decode(native.encode(texts))


def test_sentencepiece_on_odd_rows(odd, nothing):
    both = sentencepieces.round_trip(odd)
    assert Counter((r.doc_id, r.text or "") for r in both.collect()) == Counter((r.doc_id, r.decoded) for r in both.collect())
    assert sentencepieces.round_trip(nothing).count() == 0
    got = sentencepieces.decode(sentencepieces.encode(odd)).select("doc_id", "text", "ids", "decoded", "lang").collect()
    assert len(got) == len(odd_texts()) and all((r.text or "") == r.decoded for r in got)
    assert sentencepieces.decode(sentencepieces.encode(nothing)).count() == 0


# --- fingerprints


def test_fingerprints(spark, odd, nothing):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    down = sorted(texts, reverse=True)
    after = dict(zip(down, down[1:] + down[:1], strict=True))
    for buckets in (1, 7):
        got = {r.doc_id: r for r in fingerprint.fingerprint(docs, buckets=buckets).collect()}
        assert got.keys() == texts.keys()
        for i, r in got.items():
            half = len(texts[i]) // 2
            assert r.text == texts[i] and r.next_id == after[i]
            assert r.edited == texts[i][: len(texts[i]) - half] + texts[after[i]][:half]
            assert r.next_fingerprint == got[after[i]].fingerprint
    assert got[21].fingerprint == got[22].fingerprint and fingerprint.likeness(got[21].fingerprint, got[22].fingerprint) == 1
    assert fingerprint.fingerprint(odd).count() == len(odd_texts())
    assert fingerprint.fingerprint(nothing).count() == 0
    assert fingerprint.fingerprint(docs.where("doc_id = 20")).first().next_id == 20


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(k, f"all w{k % 3} only{k}") for k in range(30)], "doc_id long, text string").repartition(4)
    want = {f"w{k}" for k in range(3)}
    terms = fingerprint.Terms()(sorted(want))
    assert set(fingerprint.lexicon(docs, 0.2, 0.5)) == set(terms)


@pytest.mark.parametrize("changed", [False, True])
def test_hot_group_keeps_its_lexicon_terms(spark, changed):
    """Half of the rows are copies, or near copies, of one text; its terms occur nowhere else."""
    rng = random.Random(4)
    base = [f"hot{k}" for k in range(40)]
    rows = []
    for i in range(200):
        own = list(base)
        if changed and i:
            own[rng.randrange(40)] = f"other{i}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, " ".join(rng.sample([f"w{k}" for k in range(300)], 30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    terms = fingerprint.lexicon(docs)
    edited = " ".join(["new", *base[1:]])
    whole, near, far = fingerprint.fingerprints(pa.array([rows[0][1], edited, rows[-1][1]]), terms)
    assert set(fingerprint.Terms()(base)) <= set(terms)
    assert not whole.startswith("=") and fingerprint.likeness(whole, near) > 0.5 > fingerprint.likeness(whole, far)


@pytest.mark.parametrize("n", [1, 30, 1000, 50_000])
def test_group_sketch_counts_keys(spark, n):
    """Distinct keys by the sketch, against their number; merged of two halves that overlap, it is the same."""
    keys = np.random.default_rng(n).integers(0, 2**64, n, np.uint64)

    def counted(places):
        filled = np.bincount(np.unique(places) // fingerprint.BITS, minlength=fingerprint.LEVELS)
        levels = spark.createDataFrame(list(enumerate(filled.tolist())), "level int, filled long")
        return levels.agg(fingerprint.sketched_groups(F.col("filled"), F.col("level"), fingerprint.base_level(filled))).first()[0]

    places = fingerprint.sketch_places(keys)
    assert abs(counted(places) - n) <= max(1, 0.15 * n)
    assert counted(np.concatenate((places[n // 3 :], places[: 2 * n // 3]))) == counted(places)


def test_subsets_are_hashed_once_narrowed():
    """The hashes are those of a plain version, which goes over all terms for each chain."""
    rng = random.Random(5)
    texts = pa.array([" ".join(str(rng.randint(0, 5000)) for _ in range(rng.randint(0, 300))) for _ in range(2000)])
    owner, term = fingerprint.distinct_terms(texts)
    lexicon = np.unique(term)[::2]

    def plain():
        values, index = np.unique(term, return_inverse=True)
        keep = np.isin(values, lexicon)[index]
        own, some, at = owner[keep], term[keep], index[keep]
        hashed = lambda o, t: plain_hashes(o, t, len(texts))
        out = [hashed(own, some)]
        for chain in range(fingerprint.CHAINS):
            rank = (values ^ fingerprint._XOR[chain]) * fingerprint._MUL[chain]
            rank ^= rank >> np.uint64(32)
            depth, rows = (rank[:, None] <= fingerprint._EDGES).sum(1).astype(np.int8)[at], np.arange(len(at))
            for level in range(len(fingerprint.SHARES)):
                rows = rows[depth[rows] > level]
                out.append(hashed(own[rows], some[rows]))
        return np.stack(out, 1)

    def plain_hashes(o, t, n):
        out = np.zeros(n, np.uint32)
        if len(o):
            first = np.flatnonzero(np.diff(o, prepend=-1))
            size = np.diff(np.append(first, len(o)))
            powers = np.cumprod(np.full(int(size.max()), fingerprint._BASE))
            total = np.add.reduceat((t ^ (t >> np.uint64(31))) * powers[np.arange(len(o)) - np.repeat(first, size)], first)
            total = (total ^ (total >> np.uint64(29))) * fingerprint._MUL[0]
            out[o[first]] = (total >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        return out

    assert (fingerprint.prints(texts, lexicon) == plain()).all()


def test_fingerprints_dont_depend_on_partitions(spark, small):
    """In 1, 7 and 40 partitions, in any order: the lexicon and all fingerprints are the same."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    dealt = [docs.coalesce(1), docs.repartition(7), docs.repartition(40).sortWithinPartitions(F.xxhash64("doc_id"))]
    lexicons = [fingerprint.lexicon(d).tolist() for d in dealt]
    assert lexicons[0] and lexicons[0] == lexicons[1] == lexicons[2]
    found = [{r.doc_id: r[1:] for r in fingerprint.fingerprint(d).select("doc_id", "fingerprint", "edited_fingerprint", "next_fingerprint").collect()} for d in dealt]
    assert len(found[0]) == docs.count() and found[0] == found[1] == found[2]


def test_every_subset_is_hashed_whole():
    """The hashes against sets: equal exactly where the terms of a text in a subset are equal, whatever their number."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.sample(vocabulary, n)) for n in (0, 1, 3, 40, 200, 390)]
    texts += [t + " " + rng.choice(vocabulary) for t in texts] + [" ".join(reversed(t.split())) for t in texts] + ["no term of it"]
    terms = np.sort(fingerprint.Terms()(vocabulary[:350]))
    hashes = fingerprint.prints(pa.array(texts), terms)
    known = [set(fingerprint.Terms()(t.split()).tolist()) & set(terms.tolist()) for t in texts]
    for column in range(hashes.shape[1]):
        chain, level = divmod(column - 1, len(fingerprint.SHARES))

        def within(term, chain=chain, level=level, column=column):
            rank = (term ^ int(fingerprint._XOR[chain])) * int(fingerprint._MUL[chain]) % 2**64
            return column == 0 or rank ^ (rank >> 32) < int(2**64 * fingerprint.SHARES[level])

        sets = [frozenset(filter(within, own)) for own in known]
        assert [h == 0 for h in hashes[:, column].tolist()] == [not s for s in sets]
        for a in range(len(texts)):
            for b in range(a):
                assert (hashes[a, column] == hashes[b, column]) == (sets[a] == sets[b])
    assert max(len(s) for s in known) > 300


def test_likeness_by_chains():
    a, b, c = fingerprint.fingerprints(pa.array(["w1 w2 w3 w4 w5", "w5 w4 w3 w2 w1", "unknown"]), np.sort(fingerprint.Terms()([f"w{k}" for k in range(9)])))
    assert a == b and fingerprint.likeness(a, b) == 1 and c.startswith("=") and fingerprint.likeness(a, c) == 0 and fingerprint.likeness(c, c) == 1


def test_one_id_on_many_rows(spark):
    """Rows without an id, and of one id, are dealt over the buckets; each is followed by one of the same or the next lower id."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k}") for k in range(300)] + [(7, "the same")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt = Counter(r.bucket for r in fingerprint.successors(docs, 8).where("not tail").collect())
    assert len(dealt) >= 6 and max(dealt.values()) < 150
    got = fingerprint.fingerprint(docs, buckets=8).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert Counter(r.next_id for r in got) == Counter(i for i, _ in rows)
    assert sum(r.doc_id != r.next_id for r in got) == len({i for i, _ in rows})


def test_edited_text_is_nearer_than_the_next(spark, small):
    got = queries.op6_fingerprints(spark, small).toPandas()
    assert got.near_edited.mean() > 5 * got.near_next.mean() and (got.near_edited > got.near_next).mean() > 0.8
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    down = sorted(texts, reverse=True)
    for i, after in zip(down, down[1:] + down[:1], strict=True):
        half = len(texts[i]) // 2
        row = got[got.doc_id == i].iloc[0]
        assert row.n_chars == len(texts[i]) and row.edited_sha256 == hashlib.sha256((texts[i][: len(texts[i]) - half] + texts[after][:half]).encode()).hexdigest()


# --- sharding


def test_sharding_of_odd_rows(odd, nothing):
    got = sharding.shard(odd, bucket_bytes=20_000).select("doc_id", "text", "shard", "slot", "grown_shard", "kept").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(odd_texts())
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert all(r.grown_shard in (8, r.shard) for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.shard(nothing).count() == 0


def highest_hash(spark, doc_ids, shards):
    """The shard of each id by the highest of Spark's hashes, compared in Python."""
    row = spark.createDataFrame([(i,) for i in doc_ids], "doc_id long")
    hashes = row.select("doc_id", F.array(*(F.xxhash64("doc_id", F.lit(sharding.SEED), F.lit(k)) for k in range(shards))).alias("h")).collect()
    return {r.doc_id: max(range(shards), key=lambda k: r.h[k]) for r in hashes}


def test_sharding_depends_on_the_rows_alone(spark):
    docs = spark.range(3000).select((F.col("id") % 2500).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2500).cast("string")).alias("text"), (F.col("id") % 7 == 0).alias("more"))
    hot = spark.range(1500).select(F.lit(-5).cast("long").alias("doc_id"), F.lit("the same record again and again").alias("text"), F.lit(True).alias("more"))
    docs = docs.union(hot)
    got = [Counter(tuple(r) for r in sharding.shard(docs.repartition(n), bucket_bytes=2000).select("doc_id", "more", "shard", "slot", "grown_shard").collect()) for n in (3, 7)]
    assert got[0] == got[1]
    ids = {r[0] for r in got[0]}
    for place, shards in ((2, 8), (4, 9)):
        want = highest_hash(spark, ids, shards)
        assert all(r[place] == want[r[0]] for r in got[0])
    # copies of one record are spread over the buckets of their shard
    sizes = Counter(r.bucket for r in sharding.shard(docs, bucket_bytes=2000).where("doc_id = -5").collect())
    assert len(sizes) > 3 and max(sizes.values()) < 700


def test_shards_are_even_and_written(spark, tmp_path):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    out = sharding.shard(docs, bucket_bytes=4000)
    rows = out.collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) < 1150 and min(sizes.values()) > 850
    path = str(tmp_path / "shards")
    sharding.write_shards(out, path)
    back = sharding.read_shards(spark, path, out.schema).collect()
    assert Counter(map(tuple, back)) == Counter(map(tuple, rows))
    # later buckets have later slots, so the folders' names order a shard
    for k in range(8):
        spans = sorted((b, min(x), max(x)) for b in {r.bucket for r in back if r.shard == k} for x in [[r.slot for r in back if r.bucket == b]])
        assert all(a[2] + 1 == b[1] for a, b in zip(spans, spans[1:]))
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert sum(a < b for a, b in zip(order, order[1:])) < 4300


def test_sharding_query(spark, small):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op10_sharding(spark, small).collect()
    want = [highest_hash(spark, rows, n) for n in (8, 9)]
    assert len(got) == len(rows)
    for r in got:
        raw = rows[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "key", want[0][r.doc_id], want[1][r.doc_id])
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


# --- chat formatting

TRICKY = st.text(alphabet="<s>/\\[IN]\n a", max_size=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=4))
def test_chat_round_trip(turns):
    parts = [chat_format.render(role, text) for role, text in turns]
    back = chat_format.parse("".join(p[0] for p in parts))
    assert [x[:2] for x in back] == turns
    assert all(chat_format.unescape(whole[a:b]) == text for (whole, a, b), (_, text) in zip(parts, turns, strict=True))


def test_chat_escapes_only_conflicts():
    assert chat_format.render("user", "plain <b> text")[0] == "<s>user\nplain <b> text</s>\n"
    assert chat_format.render("user", "a </s> b")[0] == "<s>user\na <\\/s> b</s>\n"


def test_chat_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "x"), (3, 0, "assistant", "</s>" * 5000), (4, 0, "user", "")]
    given_rows = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = chat_format.format_turns(given_rows).collect()
    assert Counter((r.conv_id, r.turn, *chat_format.parse(r.rendered)[0][:2]) for r in got) == Counter((c, t, role or "", text or "") for c, t, role, text in rows)
    assert [r.turn for r in got if r.conv_id == 1] == [0, 1, 1]
    assert chat_format.format_turns(given_rows.limit(0)).count() == 0


def test_chat_query(spark, small):
    got = {r.conv_id: r for r in queries.op9_chat_format(spark, small).collect()}
    rows = [*(tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted(x[1:] for x in rows if x[0] == c)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# --- HTML

PAGE = """<html><head><title>Site</title><style>p{}</style></head><body><nav><a href=x>Home</a> <a href=y>News</a></nav>
<div class="ad">buy now</div><article><h1>Tom &amp; Ann</h1><p>First <b>bold</b>word
 here.<br>After<script>var a="</p>";</script><aside>see also</aside><p>Second &lt;one&gt; &#233;.<!-- not this --></article>
<div class="comments"><p>what a reader says</p></div><footer>&copy; site</footer></body></html>"""


def test_html_of_a_page(spark, nothing):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<nav>only menus</nav>"), (5, "u", "<p>cut off <b>text &am"), (6, "u", PAGE), (6, "u", PAGE), (None, None, "plain words")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    by_id = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert by_id[1] == by_id[6] == "Tom & Ann First boldword here. After Second <one> é."
    assert by_id[2] == by_id[3] == by_id[4] == "" and by_id[5] == "cut off text &am" and by_id[None] == "plain words"
    assert html_extract.extract(pages.limit(0)).count() == 0


def article(page):
    """The article of a page as generated for the tables, by another way than the operator's."""
    found = re.search(r"<article>(.*?)</article>", page, re.S)
    text = re.sub(r"<(/?)(b|a|i)\b[^>]*>", "", re.sub(r"<!--.*?-->", "", found[1], flags=re.S))
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "\n", text)).split())


CHANGES = {
    "as it is": lambda p: p,
    "article renamed": lambda p: p.replace("<article>", '<div class="story">').replace("</article>", "</div>"),
    "in a form": lambda p: p.replace("<body>", "<body><form action=x>").replace("</body>", "</form></body>"),
    "section named like another part": lambda p: p.replace("<article>", '<article><section class="related-work sidebar">').replace("</article>", "</section></article>"),
    "body named like another part": lambda p: p.replace("<body>", "<body class='has-sidebar comments'>"),
    "an aside within": lambda p: p.replace("</article>", "<aside><p>see also this and that</p></aside></article>"),
}


@pytest.mark.parametrize("change", CHANGES)
def test_held_out_pages(spark, small, change):
    """Scores of one half of the pages give the articles of the other half, with their marks or without."""
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").orderBy("page_id").collect()]
    counts = sum(map(html_extract.count, pages[::2]), Counter())
    shares = html_extract.Shares(counts)
    for page in pages[1::2]:
        assert html_extract.main_text(CHANGES[change](page), shares) == article(page)


def test_comments_are_learned(spark, small):
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").orderBy("page_id").collect()]
    said = '</article><div class="talk"><p>what a reader says here</p><p>and what another one says</p></div>'
    nested = "<article><p>a reader's own words in an article of their own</p></article></article>"
    for more in (said, nested):
        with_talk = [p.replace("</article>", more) for p in pages]
        shares = html_extract.Shares(sum(map(html_extract.count, with_talk[::2]), Counter()))
        for plain, page in zip(pages[1::2], with_talk[1::2], strict=True):
            got = html_extract.main_text(page, shares)
            assert got == article(plain) if more == said else got.startswith(article(plain))


def test_words_are_positive_and_tags_negative(spark, small):
    shares = html_extract.train(spark.read.parquet(f"{small}/pages.parquet"))
    features = {*shares.exact[True], *shares.exact[False], ("w", "unseen", ""), ("<", "unseen", ""), ("<", "aside", "")}
    for feature in features:
        score = shares.score(feature)
        assert score > 0 if feature[0] == "w" else score < 0 or feature[1].lstrip("/") == "article"


def test_html_without_labelled_pages():
    """What is known of the elements themselves, until pages tell more."""
    page = PAGE.replace("article", "main").replace('<div class="comments"><p>what a reader says</p></div>', "").replace("Second", "A second one of more words than the aside before it")
    assert html_extract.main_text(page, html_extract.Shares()) == "Tom & Ann First boldword here. After A second one of more words than the aside before it <one> é."


def test_blanks_between_inline_elements_are_kept():
    page = "<article><p><b>foo</b> <i>bar</i>\n<a href=x>one</a> <a>two</a><span>x</span><b>y</b></p><p>the end of it all</p></article>"
    assert html_extract.main_text(page, html_extract.Shares(html_extract.count(page))) == "foo bar one twoxy the end of it all"
    assert not any(f[0] == "w" and n == 0 for (f, _), n in html_extract.count(page).items())


def test_scan_finds_the_best_region():
    """The linear scan against all contiguous regions: the exact span, also among equal sums."""
    rng = random.Random(2)
    for _ in range(400):
        scores = [float(rng.choice((-2, -1, -1, 0, 1, 2, 3))) for _ in range(rng.randint(0, 14))]
        spans = [(sum(scores[a:b]), -b, a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        best = max(spans, default=(0, 0, 0))
        assert html_extract.best_region(scores) == ((best[2], -best[1]) if best[0] > 0 else (0, 0))


def test_a_head_without_an_end():
    page = "<html><head><meta charset=utf-8><title>not this</title><body><p>the words of the page</p>"
    assert html_extract.main_text(page, html_extract.Shares()) == "the words of the page"


def test_a_very_long_page():
    page = "<nav>" + "<a href=x>menu</a>" * 2000 + "</nav><article>" + "<p>some words of <b>a paragraph</b>.</p>" * 20_000 + "</article><footer>end</footer>"
    got = html_extract.main_text(page, html_extract.Shares(html_extract.count(page)))
    assert got == " ".join(["some words of a paragraph."] * 20_000)


def test_html_query(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = queries.op7_html_extraction(spark, small).collect()
    assert {r.page_id: r.text for r in got} == {i: article(p) for i, p in pages.items()} and all(r.n_chars == len(r.text) for r in got)


def test_sentencepiece_query(spark, small):
    from sentencepiece import SentencePieceProcessor

    native = SentencePieceProcessor(model_file=sentencepieces.model_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op4_sentencepiece(spark, small).collect():
        assert r.n_ids == len(native.encode(texts[r.doc_id])) and r.round_trip and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
