"""The operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from branchframe.llm.bpe import bpe_round_trip
from branchframe.llm.chat import format_chats
from branchframe.llm.common import table
from branchframe.llm.embed_dedup import near_vectors
from branchframe.llm.exact_dedup import exact_dedup
from branchframe.llm.language_id import identify_languages
from branchframe.llm.packing import pack
from branchframe.llm.simhash import near_duplicates
from branchframe.llm.token_counts import token_counts
from branchframe.llm.toxicity import score_toxicity
from branchframe.llm.warc import warc_round_trip


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine and on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_token_counts, op3_simhash, op4_warc, op5_toxicity, op6_exact_dedup, op7_packing, op8_chat_format, op9_bpe_round_trip, op10_embedding_near_dedup]
    return {f.__name__: f for f in found}


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32_sql(hex_digest: str) -> str:
    """Five bits at a time, from the 4-bit digits that hold them."""
    digit = lambda i: f"(instr('0123456789abcdef', substr({hex_digest}, {i + 1}, 1)) - 1)"
    letters = []
    for i in range(32):
        first, shift = divmod(5 * i, 4)
        both = f"({digit(first)} * 16 + {digit(first + 1)})"
        letters.append(f"substr('{_BASE32}', (({both} // {2 ** (3 - shift)}) % 32)::INT + 1, 1)")
    return " || ".join(letters)


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS code FROM pages),
            w AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS win FROM p)
            SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {_base32_sql("code")} AS payload_digest,
                   CASE WHEN page_id = win THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> win THEN win END AS refers_to
            FROM w""",
        "op6_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
        "op8_chat_format": """
            WITH c AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn) AS turns
                       FROM conversations GROUP BY conv_id),
            m AS (SELECT min(conv_id) AS conv_id, turns FROM c GROUP BY turns)
            SELECT conv_id, len(turns)::BIGINT AS n_turns,
                   array_to_string(list_transform(turns, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') AS chat
            FROM m WHERE NOT EXISTS (SELECT 1 FROM m b WHERE len(b.turns) > len(m.turns) AND b.turns[1] = m.turns[1] AND b.turns[1:len(m.turns)] = m.turns)""",
        "op10_embedding_near_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
            links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                      WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
            reach AS (SELECT vec_id AS id, vec_id AS other FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
            low AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
            n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
            SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
            FROM v JOIN low ON low.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    }
