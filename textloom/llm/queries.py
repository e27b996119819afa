"""Queries of the operators, by the contracts' columns, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clusters, chat_format, collocations, decontaminate, embedding_dedup, html_extract, language_id, mining_sql, minhash_dedup, mixing, quality_rules, token_counts, toxicity, warc
from ._common import read, scratch_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.deduplicate(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language_id.identify(read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), (~language_id.is_training_row("id")).alias("held_out"), "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch_table(warc.write_archives(read(spark, sf_dir, "pages")), "archives")
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.digests(rows.unionByName(more))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return rows.select(F.col("id").alias("doc_id"), (~toxicity.is_training_row("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.account(*mixing.mix(read(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.ranked(collocations.mine(read(spark, sf_dir, "documents")))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id").drop("n_compared")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_decontaminate": op6_decontaminate,
    "op7_html_extract": op7_html_extract,
    "op8_chat_format": op8_chat_format,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_collocations": op12_collocations,
    "op13_centroid_clusters": op13_centroid_clusters,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
key AS (SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS k FROM win),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM key) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
base AS (
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(rep.n, 0) AS n_repeat_words,
        len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS n_plain, len(list_filter(w, lambda x: regexp_matches(x, '[.!?]$'))) AS n_ends
    FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
told AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND n_symbols * 10 <= n_words AND word_chars BETWEEN n_words * 2 AND n_words * 12 AND n_dup_lines * 10 <= len(lines) * 4 AND n_plain * 10 <= n_words * 4 AND n_ends * 10 <= n_words * 7 AS kept
FROM told"""
_DEDUP = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS k FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON y.k = x.k AND y.doc_id <> x.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS node, doc_id AS found FROM documents UNION SELECT e.a, r.found FROM r JOIN e ON e.b = r.node AND r.found < e.a),
c AS (SELECT node, min(found) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
_WARC = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to, true AS complete FROM f"""


def _escaped_sql(column: str, role: bool = False) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for string, letter in (*chat_format.CONTROL, *((("\n", "n"),) if role else ())):
        quoted = "chr(10)" if string == "\n" else f"'{string}'"
        out = f"replace({out}, {quoted}, '\\{letter}')"
    return out


_CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(length('<|im_start|>' || {_escaped_sql("role", True)} || chr(10) || {_escaped_sql("text")} || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def _ranges(bounds: list[tuple[int, int]]) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in bounds)


# Code points from 0x80 between the ranges of scripts without blanks: there words are runs, in those each character is a token.
_FIRST, _LAST = zip(*decontaminate.UNSPACED, strict=True)
_BETWEEN = [(a + 1, b - 1) for a, b in zip((0x7F, *_LAST), (*_FIRST, 0x110000), strict=True) if a + 1 < b]
_TOKENS = f"regexp_extract_all(lower(text), '[{_ranges(list(decontaminate.UNSPACED))}]|[0-9a-zA-Z{_ranges(_BETWEEN)}]+')"
_LEAKS = f"""
WITH d AS (SELECT doc_id, unnest({_TOKENS}) AS w, generate_subscripts({_TOKENS}, 1) - 1 AS p FROM documents),
b AS (SELECT item_id, len({_TOKENS}) AS n, least({decontaminate.STRETCH}, len({_TOKENS})) AS wide, unnest({_TOKENS}) AS w, generate_subscripts({_TOKENS}, 1) - 1 AS q FROM benchmark),
g AS (SELECT doc_id, item_id, p - q AS o, any_value(n) AS n, any_value(wide) AS wide, list(q ORDER BY q) AS qs FROM d JOIN b ON b.w = d.w GROUP BY 1, 2, 3 HAVING 100 * count(*) >= {decontaminate.AGREE} * any_value(wide)),
k AS (SELECT *, list_max(list_transform(range(0, n - wide + 1), lambda s: len(list_filter(qs, lambda q: q >= s AND q < s + wide)))) AS stretch FROM g),
h AS (SELECT * FROM k WHERE 100 * stretch >= {decontaminate.AGREE} * wide)
SELECT DISTINCT ON (doc_id, item_id) doc_id, item_id, CAST(len(qs) AS BIGINT) AS n_matched, CAST(n AS BIGINT) AS n_item_tokens, CAST(o AS BIGINT) AS first_token, CAST(stretch AS BIGINT) AS best_stretch FROM h ORDER BY doc_id, item_id, len(qs) DESC, stretch DESC, o"""

ORACLE_SQL: dict[str, str] = {
    "op6_decontaminate": _LEAKS,
    "op2_minhash_dedup": _DEDUP,
    "op4_quality_rules": _QUALITY,
    "op5_warc": _WARC,
    "op8_chat_format": _CHAT,
    "op11_embedding_dedup": mining_sql.LINKS,
    "op12_collocations": mining_sql.PHRASES,
    "op13_centroid_clusters": mining_sql.clusters(),
}
