"""Queries on whole documents: scans, overviews, bundles, slices, drafts of comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as G
from ..operators import scan as N
from ..operators import structure as S
from ..sources.tables import read, replace_documents
from .compare_queries import _versions
from .retrieval_queries import _section_numbers
from .structure_queries import _HEADS, _NUMBERED, _numbered_lines, document_chunks, lengths, section_tree, text_lines

TOPICS = [("the", [" this the ", " the of "]), ("et", [" et la ", " de la "]), ("und", [" und die "])]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").alias("doc"), "text")


def _numbered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_lines(spark, sf_dir).groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.rpad("text", 100, " ").alias("t")))), lambda x: x["t"]), "").alias("text"))


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document asked for its passages on the opening words of a benchmark item, with the deterministic extractor."""
    windows = S.windows(document_chunks(spark, sf_dir), lengths(spark, sf_dir), 1500)
    docs = _docs(spark, sf_dir)
    n = read(spark, sf_dir, "benchmark").count()
    asked = read(spark, sf_dir, "benchmark").select(F.row_number().over(_by("item_id")).alias("k"), F.col("text").alias("q"))
    questions = docs.select("doc", (F.pmod("doc", F.lit(n)) + 1).alias("k")).join(asked, "k").select(F.col("doc").alias("question_id"), "doc", F.substring("q", 1, 60).alias("text"))
    found, account = N.scan(windows, docs, questions, N.sentence_picker)
    return account.join(found.groupBy("question_id").agg(F.count("*").alias("n_findings")), "question_id", "left").select("doc", "n_windows", "n_failed", "n_discarded", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def _by(column: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.orderBy(column)


def clean_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents", "doc_id", "text")
    return rows.select("doc_id", F.md5(N.clean_slice(F.regexp_replace("text", r"\.\n", ".  \n\n\n"))).alias("digest"))


def topic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.first_topics(text_lines(spark, sf_dir), TOPICS).select("doc", "topic", F.col("start").cast("long").alias("start"))


def overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = S.fallback_parts(text_lines(spark, sf_dir), lengths(spark, sf_dir)).withColumn("level", F.lit(1))
    return N.overview(text_lines(spark, sf_dir), parts, lengths(spark, sf_dir).where("n > 0"), TOPICS, 400)


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.section_page(section_tree(spark, sf_dir), _numbered_texts(spark, sf_dir), 700)
    return rows.select("doc", "ord", F.col("page").cast("long").alias("page"), F.md5("text").alias("digest"))


def plain_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.concat(F.lit('It says "'), F.substring("text", 1, 90), F.lit('" and “no more”, "four words are few" too.')).alias("content"))
    return N.plain_quotes(rows).select("answer_id", F.col("pos").cast("long").alias("pos"), "quote")


def recovered_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    answers = docs.select(F.col("doc_id").alias("answer_id"), "doc_id", F.concat(F.lit("So “"), F.expr("substring(text, 11, 80)"), F.lit("” it is, not “these are five other words”.")).alias("content"))
    return N.recovered_citations(answers, docs)


def document_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = S.fallback_parts(text_lines(spark, sf_dir), lengths(spark, sf_dir))
    pages = parts.select("doc", "start", (F.col("ord") + 1).alias("page_no"))
    rows = N.document_bundle(_docs(spark, sf_dir), pages, parts)
    return rows.select("doc", F.size("pages").cast("long").alias("n_pages"), F.size("sections").cast("long").alias("n_sections"), "tokens")


def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels", "doc_id", "quality")
    fresh = rows.where("quality = 0").select("doc_id", F.lit(9).alias("quality"))
    return replace_documents(rows, fresh).select("doc_id", F.col("quality").cast("long").alias("quality"))


def ordered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks named by (doc, ord), in order: a left semi join on few names."""
    lines = text_lines(spark, sf_dir)
    named = read(spark, sf_dir, "benchmark", "item_id").select(F.col("item_id").alias("doc"), (F.col("item_id") % 3).cast("int").alias("ord"))
    return lines.join(named, ["doc", "ord"], "left_semi").select("doc", F.col("ord").cast("long").alias("ord"), "text").orderBy("doc", "ord")


def word_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines as Word paragraphs: every third has a label, every seventh a style."""
    k = F.col("ord")
    rows = _numbered_lines(spark, sf_dir).withColumns({
        "label": F.when(k % 3 == 0, F.concat((k % 4 + 1).cast("string"), F.lit("."), (k % 5).cast("string"), F.lit("."))).when(k % 11 == 1, "(a)"),
        "heading_level": F.when(k % 7 == 0, k % 3 + 1).cast("int"), "bold_lead": F.when(k % 2 == 0, F.lit("Bold words")), "in_table": k % 13 == 5,
    })
    return S.word_headings(rows).select("doc", F.col("ord").cast("long").alias("ord"), "number", "title", F.col("level").cast("long").alias("level"))


def section_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = section_tree(spark, sf_dir).join(_section_numbers(spark, sf_dir), ["doc", "ord"])
    rows = G.section_units(tree, _numbered_texts(spark, sf_dir))
    return rows.select("doc", F.col("idx").cast("long").alias("idx"), "number", "title", F.length("text").cast("long").alias("n_chars"))


def draft_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.drafted(*_versions(spark, sf_dir))


def visible_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.visible(draft_comparisons(spark, sf_dir)).select("a", "b", "shown_at", "type", "severity", "title")


QUERIES = {f.__name__: f for f in (
    scan_findings, clean_slices, topic_passages, overviews, section_pages, plain_quotes, recovered_citations, document_bundles, replaced_documents, ordered_chunks, word_headings, section_units, draft_comparisons, visible_changes,
)}

_LINES = """SELECT doc, ord, x, CAST(coalesce(sum(length(x) + 1) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p
    FROM (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents WHERE text IS NOT NULL)"""
_TREE = f"""SELECT h.*, coalesce((SELECT min(b.start) FROM ({_HEADS}) b WHERE b.doc = h.doc AND b.start > h.start AND b.level <= h.level), 4000) AS e, row_number() OVER (PARTITION BY h.doc ORDER BY h.start) - 1 AS i FROM ({_HEADS}) h"""
_TEXTS = f"SELECT doc, string_agg(rpad(text, 100, ' '), '' ORDER BY ord) AS text FROM ({_NUMBERED}) GROUP BY doc"

SQL = {
    "document_bundles": """WITH RECURSIVE l AS (SELECT doc, CAST(coalesce(sum(length(x) + 1) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p
            FROM (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents WHERE text <> '')),
        c AS (SELECT doc, CAST(0 AS BIGINT) AS p, 1 AS k FROM l WHERE p = 0 UNION SELECT c.doc, min(l.p), c.k + 1 FROM c JOIN l ON l.doc = c.doc AND l.p - c.p >= 2000 GROUP BY c.doc, c.p, c.k), n AS (SELECT doc, count(*) AS n FROM c GROUP BY doc)
        SELECT doc_id AS doc, n AS n_pages, n AS n_sections, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents LEFT JOIN n ON n.doc = doc_id WHERE text IS NOT NULL""",
    "clean_slices": "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(text, '.' || chr(10), '.  ' || chr(10) || chr(10) || chr(10)), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM documents",
    "topic_passages": f"""WITH l AS (SELECT doc, p, x, len(list_filter(regexp_split_to_array(trim(x, ' '), '\\s+'), lambda w: w <> '')) AS n FROM ({_LINES})),
        t AS (SELECT doc, 'the' AS topic, 0 AS k, p FROM l WHERE n >= 6 AND regexp_matches(x, '(?i) this the ') UNION ALL SELECT doc, 'the', 1, p FROM l WHERE n >= 6 AND regexp_matches(x, '(?i) the of ') UNION ALL SELECT doc, 'et', 0, p FROM l WHERE n >= 6 AND regexp_matches(x, '(?i) et la ')
            UNION ALL SELECT doc, 'et', 1, p FROM l WHERE n >= 6 AND regexp_matches(x, '(?i) de la ') UNION ALL SELECT doc, 'und', 0, p FROM l WHERE n >= 6 AND regexp_matches(x, '(?i) und die '))
        SELECT doc, topic, arg_min(p, (k, p)) AS start FROM t GROUP BY doc, topic""",
    "section_pages": f"""WITH t AS ({_TREE}), p AS (SELECT t.doc, i, start, e, x.text, unnest(range(0, (e - start - 1) // 700 + 1)) AS k FROM t JOIN ({_TEXTS}) x ON x.doc = t.doc)
        SELECT doc, i AS ord, k AS page, md5(substring(text, CAST(start + k * 700 + 1 AS BIGINT), CAST(least(700, e - start - k * 700) AS BIGINT))) AS digest FROM p""",
    "plain_quotes": "SELECT item_id AS answer_id, CAST(0 AS BIGINT) AS pos, substring(text, 1, 90) AS quote FROM benchmark WHERE len(list_filter(regexp_split_to_array(trim(substring(text, 1, 90), ' '), '\\s+'), lambda w: w <> '')) >= 5",
    "replaced_documents": "SELECT doc_id, CASE WHEN quality = 0 THEN 9 ELSE CAST(quality AS BIGINT) END AS quality FROM labels",
    "ordered_chunks": f"SELECT l.doc, l.ord, x AS text FROM ({_LINES}) l JOIN benchmark b ON b.item_id = l.doc AND l.ord = b.item_id % 3",
    "section_units": f"""WITH t AS ({_TREE}), s AS (SELECT t.*, coalesce(lead(t.start) OVER (PARTITION BY t.doc ORDER BY t.start), length(x.text)) AS stop, x.text AS body FROM t JOIN ({_TEXTS}) x ON x.doc = t.doc),
        u AS (SELECT doc, start, number, title, trim(regexp_replace(substring(body, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)), '[ \\t]+', ' ', 'g'), ' ') AS b FROM s), v AS (SELECT *, len(list_filter(string_split(b, ' '), lambda w: w <> '')) AS n FROM u)
        SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY start) - 1 AS idx, number, title, CAST(length(b) AS BIGINT) AS n_chars FROM v WHERE n >= 4 AND NOT (n <= 12 AND NOT regexp_matches(b, '[.;:]$'))""",
}
