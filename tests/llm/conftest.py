import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that results or intermediate tables have; the input's columns of that name must not matter.
CLASHING = ("kept", "shard", "slot", "sequence_id", "length", "n_lines", "row", "key", "id", "bucket", "ids", "h", "line", "turn", "score", "gone", "gone_id", "gone_xh", "xh", "at", "times", "r1", "r2", "r", "copy", "other_id", "other_hash", "comp", "text_hash", "scored", "_scored", "part", "fp", "owner", "piece", "start", "rank", "before", "first", "late")


def words(rng, n, letters="abcdefghij"):
    return [" " * 0 + "".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n)]


def odd_texts():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows, copies that differ in white space or in a word."""
    rng = random.Random(11)
    base = words(rng, 60)
    near = [*base[:30], "other", *base[31:]]
    out = [(1, None), (2, ""), (3, " \t\n"), (None, "a lone text without an id"), (None, None), (7, "one"), (8, "One"), (9, "日本語 テキスト é"), (10, "12345 !!! ...")]
    out += [(20 + k, " ".join(base)) for k in range(4)] + [(20, " ".join(base))] + [(30, "  ".join(base) + "\n"), (31, " ".join(near)), (32, " ".join(base[:40]))]
    out += [(40, " ".join(words(rng, 30_000))), (41, "x" * 50_000), (42, "\n".join(["the same line again and again, over and over"] * 50))]
    out += [(50 + k, " ".join(words(rng, rng.randint(1, 80)))) for k in range(40)]
    out += [(90, "a line that many documents have in common\nfirst own line of some length"), (91, "second own line of some length, longer\na line that many documents have in common"), (92, "a line that many documents have in commom")]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, ("en", "fr", None)[k % 3], "s", len(t) if t is not None else None) for k, (i, t) in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})
