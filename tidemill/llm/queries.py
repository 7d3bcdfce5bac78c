"""The registered queries of the training-data operators: thin functions of (spark, sf_dir)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import chat_format, conversation_repair, exact_dedup, fill_middle, fingerprint, html_extract, language_id, line_dedup, near_dedup, packing, sentencepieces, sharding, topk_search
from tidemill.session import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = sentencepieces.round_trip(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.fingerprint(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], given.schema)
    formatted = chat_format.format_turns(given.unionByName(planted))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads the rendered turns back; the rows of a conversation come one after the other."""
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kind, here, state = None, None, None

        def closed(rows: list) -> pa.RecordBatch:
            columns = list(zip(*((c, n, a.hexdigest(), k, b.hexdigest(), f) for c, (n, a, k, b, f) in rows), strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names=names)

        for batch in batches:
            kind, done = batch["conv_id"].type, []
            for conv, text, a, b in zip(*(batch[c].to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end")), strict=True):
                if state is None or conv != here:
                    if state is not None:
                        done.append((here, state))
                    here, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in chat_format.parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                under = chat_format.unescape(text[a:b])
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += len(text)
            yield closed(done)
        if state is not None:
            yield closed([(here, state)])

    conv_id = given.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(digest, f"conv_id {conv_id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, path = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text")), shared_folder(spark, "shards")
    sharding.write_shards(made, path)
    out = sharding.read_shards(spark, path, made.schema)
    return out.select("doc_id", sharding.size_of().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform(_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The faults that the query plants: rows are dropped, emptied, cut short, repeated or given to the user, by a hash of conversation and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = conversations.withColumn("draw", draw).where("draw <> 0").select("conv_id", "turn", F.when(draw == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, edits = conversation_repair.repair(damaged(given))
    conv = given.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The audit and the hash of the repaired turns; the rows of a conversation come one after the other."""
        kind, here, audit, sha = None, None, None, None

        def closed(rows: list) -> pa.RecordBatch:
            columns = list(zip(*((c, "".join(a), s.hexdigest()) for c, a, s in rows), strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [kind, pa.string(), pa.string()], strict=True)], names=["edited_id", "audit", "repaired_sha256"])

        for batch in batches:
            kind, done = batch["conv_id"].type, []
            for conv_id, edit, times, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "edit", "times", "role", "text")), strict=True):
                if sha is None or conv_id != here:
                    if sha is not None:
                        done.append((here, audit, sha))
                    here, audit, sha, begun = conv_id, [], hashlib.sha256(), False
                audit.append(edit * times)
                if edit != "D":
                    sha.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
            yield closed(done)
        if sha is not None:
            yield closed([(here, audit, sha)])

    digests = edits.mapInArrow(digest, f"edited_id {conv}, audit string, repaired_sha256 string")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = given.select("conv_id").distinct()
    out = every.join(found.withColumnRenamed("conv_id", "found_id"), F.col("conv_id").eqNullSafe(F.col("found_id")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("edited_id")), "left")
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), *(F.coalesce(c, F.lit(x)).alias(c) for c, x in nothing.items()))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_minhash_near_dedup, op4_sentencepiece, op5_best_fit_packing, op6_fingerprints, op7_html_extraction, op8_line_dedup, op9_chat_format, op10_sharding, op11_topk_search, op12_fill_middle, op13_conversation_repair)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256, n_chars FROM g""",
    "op3_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op9_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
        f AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss, regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g') AS escaped FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
               sha256(string_agg(loss, '' ORDER BY turn)) AS loss_sha256, CAST(sum(length(role) + length(escaped) + 9) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id""",
    "op11_topk_search": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 5""",
    "op12_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
        n AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS UBIGINT)) AS h4 FROM d),
        c AS (SELECT *, least(h4[1] % (n + 1), h4[2] % (n + 1)) AS a, greatest(h4[1] % (n + 1), h4[2] % (n + 1)) AS b,
              CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h4[3] % 100 >= 90 THEN 'plain' WHEN h4[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
        p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}


def _repair_sql() -> str:
    """The dynamic program as a recursion over the turns, last to first: for each state the least (cost, letters, turns)."""
    start, s, u, a = "start", "s", "u", "a"
    inserted = {(start, s): "", (start, u): "", (start, a): "u", (s, u): "", (s, a): "u", (u, a): "", (u, u): "a", (a, u): "", (a, a): "u"}
    named = {"u": "user", "a": "assistant"}
    line = lambda x: f"chr(10) || {x}"

    def way(state: str, to: str, letter: str, cost: int, role: str, given: str) -> str:
        added = inserted[state, to]
        turns = "".join(line(f"'{named[x]}:'") + " || " for x in added)
        return f"CASE WHEN {given} THEN {{'c': r.{to}.c + {cost + 2 * len(added)} + f.truncated, 'a': '{'I' * len(added)}{letter}' || r.{to}.a, 't': {turns}{line(role)} || ':' || f.text || r.{to}.t}} END"

    def least(state: str) -> str:
        ways = [f"{{'c': r.{state}.c + 3, 'a': 'D' || r.{state}.a, 't': r.{state}.t}}"]
        ways += [way(state, to, "K", 0, "f.role", f"f.gone = 0 AND f.head = '{to}'") for to in (s, u, a) if (state, to) in inserted]
        ways += [way(state, to, "R", 2, f"'{named[to]}'", "f.gone = 0") for to in (u, a)]
        return f"list_min([{', '.join(ways)}]) AS {state}"

    ended = {start: "{'c': 0, 'a': '', 't': ''}", s: "{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}", u: "{'c': 2, 'a': 'I', 't': chr(10) || 'assistant:'}", a: "{'c': 0, 'a': '', 't': ''}"}
    white = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    step = "list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: CASE WHEN p % 2 = 1 THEN xor(p // 2, 3988292384) ELSE p // 2 END)"
    return f"""
        WITH RECURSIVE g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        h AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda x, y: {step}), 4294967295) % 20 AS draw FROM g),
        d AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE draw <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS head, right(rtrim(text, {white}), 1) AS tip FROM d),
        m AS (SELECT *, CASE WHEN tip = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN tip NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(head) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        f AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1 ELSE 0 END AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS truncated FROM m),
        t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
              count(*) FILTER (WHERE before || head NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
        r AS (SELECT conv_id, n + 1 AS i, {', '.join(f'{x} AS {k}' for k, x in ended.items())} FROM t
              UNION ALL SELECT r.conv_id, f.i, {', '.join(map(least, ended))} FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i - 1),
        e AS (SELECT conv_id, start.c AS c, start.a AS a, substr(start.t, 2) AS t FROM r WHERE i = 1),
        k AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT k.conv_id, {', '.join(f'CAST(coalesce({x}, 0) AS BIGINT) AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, CAST(coalesce(c, 0) AS BIGINT) AS cost, coalesce(a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
        FROM k LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM k.conv_id"""


ORACLE_SQL["op13_conversation_repair"] = _repair_sql()
