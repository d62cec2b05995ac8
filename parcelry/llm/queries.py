"""One registered query for each operator, over the whole of its table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.llm import byte_bpe, compression, cross_polytope, exact_dedup, merkle, merkle_sql, mixing, ngram_join, quality_rules, token_alignment, token_files, tool_calls, warc, word_language
from parcelry.session import use_utc

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf, "documents"), width=3, threshold=90)


def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf, "pages"), min_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_compression(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return compression.quality_scores(docs, compression.trained(docs, table(spark, sf, "labels")), threshold=0.3)


def op4_weak_supervision(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op5_tree_merge(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"), keep="largest")


def op6_word_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return word_language.document_languages(docs, word_language.trained(docs))


def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.round_trips(table(spark, sf, "documents"), RANK_FILE, public_tokenizers.PATTERN)


def op8_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    calls, results, others = tool_calls.turns_as_calls(table(spark, sf, "conversations"))
    found = tool_calls.linked(calls, results, {"answer": tool_calls.ANSWER_SCHEMA}, others)
    # Turns that call nothing have no depth, shown as -1, and no arguments that could be wrong.
    depth, valid = F.coalesce("depth", F.lit(-1).cast("long")), F.coalesce("valid", F.lit(True))
    return found.select("conv_id", "turn", "call_id", depth.alias("depth"), "status", "n_results", valid.alias("valid"), "errors", F.sha2("message", 256).alias("message_sha256"))


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.token_round_trip(table(spark, sf, "documents"), TOKENIZER_FILE, end_id=0)


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed_copies(table(spark, sf, "documents"))


def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return token_alignment.aligned_documents(table(spark, sf, "documents"), TOKENIZER_FILE, PIECE_FILE)


def op12_cross_polytope(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return cross_polytope.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op13_merkle(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = merkle.proofs(merkle.manifest(docs, merkle.lowered_text(docs)), whole=False)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_warc, op3_compression, op4_weak_supervision, op5_tree_merge, op6_word_language, op7_byte_bpe,
        op8_tool_calls, op9_token_files, op10_mixing, op11_token_alignment, op12_cross_polytope, op13_merkle,
    )
}

#: A-Z alone is lower-cased, so the letters are named.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op5_tree_merge": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents),
        g AS (
            SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
                count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op1_ngram_join": """
        WITH RECURSIVE split AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
        ),
        held AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
            FROM split
        ),
        sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s, hash(list_sort(s)) AS h FROM held),
        one AS (SELECT min(doc_id) AS doc_id, any_value(n) AS n, any_value(s) AS s, list_sort(s) AS whole FROM sized WHERE n > 0 GROUP BY list_sort(s)),
        grams AS (SELECT doc_id, n, unnest(s) AS g FROM one),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
                AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM one
            UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
        ),
        named AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
        SELECT z.doc_id, z.n AS n_shingles, coalesce(component, z.doc_id) AS component_id
        FROM sized z LEFT JOIN one ON one.whole = list_sort(z.s) AND z.n > 0 LEFT JOIN named ON named.a = one.doc_id
    """,
    "op8_tool_calls": """
        WITH RECURSIVE calls AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
        climb AS (
            SELECT c.conv_id, c.turn, 0 AS depth FROM calls c
            WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
            UNION ALL SELECT c.conv_id, c.turn, p.depth + 1 FROM climb p JOIN calls c ON c.conv_id = p.conv_id AND c.turn = p.turn + 2
        ),
        depths AS (SELECT conv_id, turn, max(depth) AS depth FROM climb GROUP BY ALL),
        results AS (
            SELECT conv_id, turn - 1 AS turn, count(*) AS n, arg_min(text, struct_pack(t := turn, c := text)) AS content
            FROM conversations WHERE role = 'assistant' GROUP BY ALL
        ),
        shown AS (
            SELECT c.conv_id, c.turn, 'call_' || c.turn AS call_id, CAST(d.depth AS BIGINT) AS depth, CASE WHEN r.n IS NULL THEN 'pending' ELSE 'linked' END AS status,
                coalesce(r.n, 0) AS n_results, coalesce(length(c.text) > 0, false) AS valid,
                CASE WHEN c.text IS NULL THEN '$.question: not of type string' WHEN c.text = '' THEN '$.question: shorter than 1' ELSE '' END AS errors,
                '[{"role":"assistant","tool_calls":[{"function":{"arguments":{"question":' || coalesce(to_json(c.text), 'null') || ',"turn":' || c.turn
                    || '},"name":"answer"},"id":"call_' || c.turn || '","type":"function"}]}'
                    || CASE WHEN r.n IS NULL THEN '' ELSE ',{"content":' || coalesce(to_json(r.content), 'null') || ',"role":"tool","tool_call_id":"call_' || c.turn || '"}' END
                    || ']' AS message
            FROM calls c JOIN depths d USING (conv_id, turn) LEFT JOIN results r USING (conv_id, turn)
            UNION ALL
            SELECT conv_id, turn, 'call_' || (turn - 1), -1, 'orphan', 1, true, '',
                '[{"content":' || coalesce(to_json(text), 'null') || ',"role":"tool","tool_call_id":"call_' || (turn - 1) || '"}]'
            FROM conversations o WHERE role = 'assistant'
                AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = o.conv_id AND c.turn = o.turn - 1)
            UNION ALL
            SELECT conv_id, turn, NULL, -1, 'message', 0, true, '',
                '[{"content":' || coalesce(to_json(text), 'null') || ',"role":' || coalesce(to_json(role), 'null') || '}]'
            FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
        )
        SELECT conv_id, turn, call_id, depth, status, n_results, valid, errors, sha256(message) AS message_sha256 FROM shown
    """,
    "op13_merkle": merkle_sql.text(),
}
