"""The registered queries of these operators, with their contract's digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm.sql import OP11_SQL, OP12_SQL, OP13_SQL


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from spanwise.llm.toxicity import REJECT, held_out, score, train

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, _table(spark, folder, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= REJECT).cast("int").alias("predicted"),
    )


def op2_wrapper(spark: SparkSession, folder: str) -> DataFrame:
    from spanwise.llm.wrapper import extract

    return extract(_table(spark, folder, "pages"))


def op3_overlap_join(spark: SparkSession, folder: str) -> DataFrame:
    from spanwise.llm.overlap_join import Rule, link_classes

    return link_classes(_table(spark, folder, "documents"), Rule(3, 90))


def op4_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    from spanwise.llm.chat import digest, windows

    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        role.alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return digest(windows(rows.unionByName(probe)))


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from spanwise.llm.parsing import compare

    return compare(_table(spark, folder, "documents"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    from spanwise.llm.warc import archive_folder, verified, write

    place = archive_folder(spark)
    write(_table(spark, folder, "pages"), place)
    return verified(spark, place).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from spanwise.llm.decontamination import find

    return find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from spanwise.llm.pii import digest, find, train

    docs = _table(spark, folder, "documents")
    return digest(find(docs, train(docs)))


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from spanwise.llm.packing import pack

    return pack(_table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from spanwise.llm.token_files import read, token_folder, write

    place = token_folder(spark)
    files = write(_table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"), 50_257, place)
    return read(spark, files, place)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from spanwise.llm.trie import number_turns, trie, with_shared_heads

    items, lengths = with_shared_heads(number_turns(_table(spark, folder, "conversations")))
    return trie(items, lengths).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op12_lattice(spark: SparkSession, folder: str) -> DataFrame:
    from spanwise.llm.lattice import near_duplicates

    return near_duplicates(_table(spark, folder, "embeddings"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    from spanwise.llm.spelling import group_variants

    return group_variants(_table(spark, folder, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_wrapper": op2_wrapper,
    "op3_overlap_join": op3_overlap_join,
    "op4_chat_windows": op4_chat_windows,
    "op5_fingerprints": op5_fingerprints,
    "op6_warc": op6_warc,
    "op7_decontamination": op7_decontamination,
    "op8_personal_data": op8_personal_data,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_files": op10_token_files,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lattice": op12_lattice,
    "op13_spelling": op13_spelling,
}

# The windows of op4 written out: a budget of 1024 tokens, 256 of them for history, a token for four characters.
OP4_SQL = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
    SELECT *, row_number() OVER w AS number, ceil(length(text) / 4) + 5 AS tokens,
        row_number() OVER w = 1 AND role = 'system' AS is_system,
        length(role) + length(text) + 13 + length(regexp_replace(role || text, '[^\\\\<|]', '', 'g')) AS chars
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), p AS (
    SELECT *, sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER w AS stop,
        greatest(1, floor((768 - coalesce(max(CASE WHEN is_system THEN tokens END) OVER w, 0)) / 2)) AS cell
    FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY number)
), c AS (
    SELECT *, tokens > cell AS alone, floor((stop - 1) / cell) AS place FROM p
), f AS (
    SELECT *, CASE WHEN is_system THEN 0
        WHEN alone OR lag(alone) OVER w OR lag(place) OVER w <> place OR lag(is_system) OVER w
            OR lag(number) OVER w IS NULL THEN 1 ELSE 0 END AS opens
    FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY number)
), v AS (
    SELECT *, greatest(0, sum(opens) OVER (PARTITION BY conv_id ORDER BY number) - 1) AS win FROM f
), l AS (
    SELECT *, max(win) OVER (PARTITION BY conv_id) AS last, max(stop) OVER (PARTITION BY conv_id, win) AS win_stop
    FROM v
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY number)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY number) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars * CASE WHEN is_system THEN last + 1
        WHEN win < last AND stop - tokens >= win_stop - 256 THEN 2 ELSE 1 END) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""

SQL: dict[str, str] = {
    "op4_chat_windows": OP4_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_lattice": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
