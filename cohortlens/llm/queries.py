"""The operators of this subpackage on the whole test tables, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import byte_bpe
from cohortlens.llm.chat_format import format_chats, learned_text, read_chat
from cohortlens.llm.common import table
from cohortlens.llm.conversation_repair import conversation_repair
from cohortlens.llm.decontaminate import contamination
from cohortlens.llm.main_text import main_text
from cohortlens.llm.pii import find_personal_data
from cohortlens.llm.quality_rules import quality_rules
from cohortlens.llm.shingle_join import shingle_components
from cohortlens.llm.source_divergence import source_divergence
from cohortlens.llm.token_counts import token_counts
from cohortlens.llm.token_files import token_files
from cohortlens.llm.toxicity import toxicity
from cohortlens.llm.warc import archive_round_trip

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(table(spark, folder, "documents")).select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
    )


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: A conversation whose texts look like the template's own marks.
TRICKY = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    chats = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY, chats.schema)
    formatted = format_chats(chats.unionByName(tricky))
    read = formatted.select(
        "conv_id",
        read_chat(F.col("formatted")).alias("turns"),
        learned_text(F.col("segments")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_components(table(spark, folder, "documents"), words=4, link=85)


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    done = byte_bpe.round_trip(
        table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    )
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair(table(spark, folder, "conversations"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_main_text": op4_main_text,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontaminate": op6_decontaminate,
    "op7_chat_format": op7_chat_format,
    "op8_shingle_join": op8_shingle_join,
    "op9_token_files": op9_token_files,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_toxicity": op12_toxicity,
    "op13_source_divergence": op13_source_divergence,
}

#: Twins of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), d AS (
            SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest
            FROM p
        ), h AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM d
        )
        SELECT
            page_id,
            payload_bytes,
            payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN holder END AS refers_to
        FROM h
    """,
    "op7_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
            SELECT
                *,
                regexp_replace(
                    regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'),
                    '\[(/?(?:INST|ANSWER|SYS)\]|/?ROLE:)', '[\\\1', 'g'
                ) AS escaped,
                CASE role WHEN 'user' THEN 'INST' WHEN 'assistant' THEN 'ANSWER' WHEN 'system' THEN 'SYS'
                    ELSE 'ROLE:' || role END AS label
            FROM c
        )
        SELECT
            conv_id,
            count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length('<s>[') + length('] ') + length(' [/') + length(']</s>') + 2 * length(label)
                + length(escaped)) AS BIGINT) AS formatted_chars
        FROM e
        GROUP BY conv_id
    """,
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), w AS (
            SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), dc AS (
            SELECT doc, lang, source, term, count(*) AS n FROM w GROUP BY ALL
        ), kept AS (
            SELECT lang, term FROM dc GROUP BY lang, term HAVING count(*) >= 30
        ), v AS (
            SELECT lang, count(*) AS v FROM kept GROUP BY lang
        ), c AS (
            SELECT lang, source, term, sum(n)::HUGEINT AS c FROM dc JOIN kept USING (lang, term) GROUP BY ALL
        ), g AS (
            SELECT lang, source, coalesce(any_value(n), 0)::HUGEINT AS n, coalesce(any_value(v), 0)::HUGEINT AS v
            FROM (SELECT DISTINCT lang, source FROM d)
            LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) USING (lang, source)
            LEFT JOIN v USING (lang)
            GROUP BY lang, source
        ), p AS (
            SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c,
                1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * g.v) AS p
            FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
        ), q AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v) AS q
            FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM c GROUP BY ALL)
            JOIN (SELECT lang, sum(n)::HUGEINT AS n, max(v) AS v FROM g GROUP BY lang) USING (lang)
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f
            FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY ALL
        ), parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
            FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
            UNION ALL
            SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT)
            FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q
        )
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
        FROM parts
        QUALIFY part = 'pair' OR rank <= 50
    """,
}
