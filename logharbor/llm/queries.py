"""The queries of the operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm import block_naming, chat_format, cover_tree, hard_negatives, line_dedup, merkle, ngram_join, packing, pseudonyms, quality, source_mix, suffix_dedup, token_counts
from logharbor.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: DuckDB for lower-casing A-Z alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


@_query(
    "op5_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(table(spark, sf_dir, "documents"))


@_query("op4_source_mix")
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source_mix.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@_query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op7_pattern_packing")
def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: The shortest texts that hold control strings, as a conversation of their own.
_PROBE = """
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text
    FROM VALUES (-1, 0, 'user'), (-1, 1, 'assistant') AS probe(conv_id, turn, role)
"""
_MARK = r"([<\[])(\\*)(\|(?:turn|body|part|end|image|audio|document|im_start|im_end|endoftext)\|>|/?s>|/?INST\])"


@_query(
    "op1_chat_format",
    f"""
    WITH turns AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    sized AS (
      SELECT *, length('<|turn|>' || '<|body|>' || '<|end|>')
                + length(regexp_replace(role, '{_MARK}', '\\1\\2#\\3', 'g'))
                + length(regexp_replace(text, '{_MARK}', '\\1\\2#\\3', 'g')) AS chars
      FROM turns)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(_PROBE))
    parted = turns.withColumn("parts", chat_format.text_parts(F.col("text")))
    return chat_format.digest(chat_format.format_chats(parted))


@_query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op2_near_vectors")
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


@_query("op9_ngram_join")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.linked_documents(table(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


@_query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


@_query("op8_pseudonyms")
def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.with_pseudonyms(table(spark, sf_dir, "documents"), key="logharbor")
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), "found", "text")


@_query(
    "op11_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (
      SELECT * FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
           n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
      AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
    QUALIFY rank <= 3
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings").where(
        "NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    )
    vectors = found.select(
        "vec_id",
        F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"),
        F.expr("transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE))").alias("vector"),
    )
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def _value(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


#: The CRC-32 of the decimal digits of an id, bit by bit.
_CRC = """
    xor(4294967295, list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, byte: list_reduce(
        list_prepend(xor(crc, byte), [CAST(b AS BIGINT) FOR b IN range(8)]),
        lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)))
"""


@_query(
    "op12_merkle_manifest",
    f"""
    WITH RECURSIVE d AS (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx,
             dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
             count(*) OVER (PARTITION BY lang) AS n,
             sha256({_value('doc_id')} || {_value('source')} || {_value('lang')} || {_value('n_chars')} || {_value('text')}) AS leaf,
             CASE WHEN {_CRC} % 7 = 0
               THEN sha256({_value('doc_id')} || {_value('source')} || {_value('lang')} || {_value('n_chars + 1')} || {_value('text')}) END AS other
      FROM documents),
    low AS (
      SELECT tree, 0 AS level, idx, n, leaf AS h FROM d
      UNION ALL
      SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
      FROM low WHERE n > 1 GROUP BY tree, level, idx // 2, n),
    high AS (
      SELECT 0 AS level, tree AS idx, count(*) OVER () AS n, h FROM low WHERE n = 1
      UNION ALL
      SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, idx // 2, n),
    heights AS (SELECT tree, max(level) AS height FROM low GROUP BY tree),
    steps AS (
      SELECT d.doc_id, l.level, l.idx, s.h AS sibling
      FROM d JOIN low l ON l.tree = d.tree AND l.n > 1 AND l.idx = d.idx // CAST(power(2, l.level) AS BIGINT)
      LEFT JOIN low s ON s.tree = l.tree AND s.level = l.level AND s.idx = xor(l.idx, 1)
      UNION ALL
      SELECT d.doc_id, 1000 + h.level, h.idx, s.h
      FROM d JOIN high h ON h.n > 1 AND h.idx = d.tree // CAST(power(2, h.level) AS BIGINT)
      LEFT JOIN high s ON s.level = h.level AND s.idx = xor(h.idx, 1)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k FROM steps),
    folded AS (
      SELECT doc_id, CAST(1 AS BIGINT) AS k, coalesce(other, leaf) AS h FROM d
      UNION ALL
      SELECT f.doc_id, f.k + 1,
             sha256(CASE WHEN s.sibling IS NULL THEN f.h WHEN s.idx % 2 = 0 THEN f.h || s.sibling ELSE s.sibling || f.h END)
      FROM folded f JOIN numbered s ON s.doc_id = f.doc_id AND s.k = f.k),
    ends AS (SELECT doc_id, max_by(h, k) AS folded_root FROM folded GROUP BY doc_id),
    proofs AS (SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY k), '')) AS proof_sha256 FROM numbered GROUP BY doc_id),
    root AS (SELECT h AS root FROM high WHERE n = 1)
    SELECT d.doc_id, d.leaf, l.h AS subroot, root.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
           e.folded_root, e.folded_root = root.root AS verified
    FROM d JOIN low l ON l.tree = d.tree AND l.n = 1 CROSS JOIN root
    JOIN ends e USING (doc_id) LEFT JOIN proofs p USING (doc_id)
    """,
)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.document_manifest(table(spark, sf_dir, "documents"))
    proof = F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


@_query(
    "op13_line_dedup",
    """
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
      FROM documents),
    keyed AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM lines),
    common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (common.key IS NULL), '')) AS kept_sha256
    FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id
    """,
)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_common_lines(table(spark, sf_dir, "documents"), min_docs=10, least_points=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
