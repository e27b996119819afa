"""Queries of the comparison. Versions are documents that share a long line; facts come from sentences on orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import compare as G
from ..sources.scratch import scratch_table
from ..sources.tables import read
from .structure_queries import text_lines
from .verification_queries import spaced_sql

_LONG = 200


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): each document with the first that shares one of its long lines."""
    lines = text_lines(spark, sf_dir).where(F.length("text") >= _LONG).select("doc", F.md5("text").alias("line")).distinct()
    first = lines.groupBy("line").agg(F.min("doc").alias("a"))
    return lines.join(first, "line").groupBy(F.col("doc").alias("b")).agg(F.min("a").alias("a")).where("a < b").select("a", "b")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The paragraphs of documents that are in a pair, and the pairs: both are read more than once, so they are made once, and texts in no pair are
    left out before they are cut up."""
    pairs = scratch_table(_pairs(spark, sf_dir), "version-pairs")
    return scratch_table(G.paragraph_units(text_lines(spark, sf_dir, G.paired(pairs))).drop("start", "end"), "version-units"), pairs


def version_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def paragraph_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.paragraph_units(text_lines(spark, sf_dir))
    return rows.select("doc", F.col("idx").cast("long").alias("idx"), "title", F.md5("compact").alias("digest"))


def exact_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.exact_pairs(*_versions(spark, sf_dir))
    return rows.select("a", "b", F.col("a_idx").cast("long").alias("a_idx"), F.col("b_idx").cast("long").alias("b_idx"))


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(X.word_shingles(X.spaced(F.col("text")))).cast("long").alias("n"))


def part_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard and title similarity of parts next to each other within their brand."""
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    other = rows.select((F.col("p_partkey") + 25).alias("p_partkey"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    rows = rows.join(other, "p_partkey")
    words = lambda a, b: F.split(F.lower(F.concat_ws(" ", a, b)), " ")
    return rows.select("p_partkey", F.round(X.jaccard(words("p_name", "p_type"), words("name", "type")), 6).alias("jaccard"), F.round(X.title_similarity(F.col("p_name"), F.col("name")), 6).alias("title"))


def unit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the units that alignment puts together in each pair of versions; a unit put with none has a row with null."""
    units, pairs = _versions(spark, sf_dir)
    side = lambda doc, name: units.select(F.col("doc").alias(doc), F.col("idx").alias(f"{doc}_idx"), F.struct("number", "title", "spaced").alias(name))
    rows = G.alignments(units, pairs).join(side("a", "u"), ["a", "a_idx"], "left").join(side("b", "v"), ["b", "b_idx"], "left")
    told = F.when(F.col("a_idx").isNotNull() & F.col("b_idx").isNotNull(), F.round(G.similarity(F.col("u"), F.col("v")), 6))
    return rows.select("a", "b", F.col("a_idx").cast("long").alias("a_idx"), F.col("b_idx").cast("long").alias("b_idx"), told.alias("similarity"))


def unit_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.alignments(*_versions(spark, sf_dir))


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each later version by type and severity, facts and titles included."""
    return G.counted(G.drafted(*_versions(spark, sf_dir)), "b")


def word_redlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, pairs = _versions(spark, sf_dir)
    rows = G.alignments(units, pairs).where("type = 'modified'")
    rows = rows.join(units.select(F.col("doc").alias("a"), F.col("idx").alias("a_idx"), F.col("text").alias("before")), ["a", "a_idx"]).join(units.select(F.col("doc").alias("b"), F.col("idx").alias("b_idx"), F.col("text").alias("after")), ["b", "b_idx"])
    rows = G.redlines(rows.select(F.struct("a", "b", "b_idx").alias("id"), "before", "after"))
    return rows.select("id.a", "id.b", "id.b_idx", F.size("hunks").alias("n_hunks"), G.changed_snippet(F.col("hunks"), "after", 200).alias("snippet"))


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence on each order, and its next version. The orders are few bytes and much work, so they are dealt to all cores, not by file sizes; a stated
    number of shuffle partitions is not put together again for being small."""
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    amount = lambda c: F.format_string("USD %d", F.floor(c).cast("long"))
    text = lambda a, d, m, p, j: F.concat(F.lit("The buyer "), m, F.lit(" pay "), a, F.lit(" within "), d, F.lit(" days at "), p, F.lit("% under the laws of "), j, F.lit("."))
    place = lambda n: F.element_at(F.array(*map(F.lit, ("England", "France", "Spain"))), (n % 3 + 1).cast("int"))
    before = text(amount(price), (k % 3 * 15 + 15).cast("string"), F.lit("shall"), (k % 4).cast("string"), place(k))
    after = text(amount(F.when(k % 5 == 0, price * 6).when(k % 5 == 1, price + 1000).otherwise(price)), F.when(k % 7 == 0, "90").otherwise((k % 3 * 15 + 15).cast("string")), F.when(k % 11 == 0, F.lit("may")).when(k % 13 == 0, F.lit("shall not")).otherwise("shall"), F.when(k % 17 == 0, "9.5").otherwise((k % 4).cast("string")), F.when(k % 19 == 0, place(k + 1)).otherwise(place(k)))
    return rows.select("o_orderkey", before.alias("before"), after.alias("after"))


def changed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clauses(spark, sf_dir).select("o_orderkey", F.explode(G.changed_facts(F.col("before"), F.col("after"))).alias("f"))
    return rows.select("o_orderkey", "f.kind", "f.before", "f.after", F.floor(F.col("f.ratio") * 10).alias("ratio_tenths"))


def change_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clauses(spark, sf_dir).withColumn("facts", G.changed_facts(F.col("before"), F.col("after")))
    rows = rows.withColumn("severity", G.severity(F.lit("modified"), F.lit(True), F.col("facts"), F.lit("Price")))
    return rows.groupBy("severity").agg(F.count("*").alias("n"))


def change_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clauses(spark, sf_dir).withColumn("facts", G.changed_facts(F.col("before"), F.col("after")))
    return rows.select("o_orderkey", G.summary(F.lit("modified"), F.lit(True), F.col("facts"), F.lit("Price")).alias("summary"))


def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey", "l_partkey")
    item = F.struct("l_linenumber", "l_suppkey", "l_partkey", F.col("l_returnflag").alias("v"), F.col("l_linestatus").alias("w"))
    rows = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("x")).select("l_orderkey", F.col("x.v").alias("a"), F.col("x.w").alias("b"))
    return rows.select("l_orderkey", F.array_join(F.sort_array(G.surplus(F.col("a"), F.col("b"))), "").alias("removed"), F.array_join(F.sort_array(G.surplus(F.col("b"), F.col("a"))), "").alias("added"))


def money_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.format_string("AED %d,500", k)).when(k % 4 == 1, F.format_string("$%d.5 million", k)).when(k % 4 == 2, F.format_string("%d k euros", k)).otherwise(F.lit("no amount"))
    return read(spark, sf_dir, "part", "p_partkey").select("p_partkey", G.money_value(text).alias("value"))


def change_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("Payment terms", "Limitation of liability", "Renewal term", "Data and privacy", "Courts", "General")))
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", G.category(F.element_at(names, (k % 6 + 1).cast("int")), F.when(k % 4 == 0, F.concat(F.lit("the services of "), "p_name")).otherwise("p_name")).alias("category"))


def severity_raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda c: F.element_at(F.array(*map(F.lit, (*G.SEVERITIES, "unsure"))), c.cast("int"))
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part", "p_partkey").select("p_partkey", G.raised(level(k % 4 + 1), level(F.floor(k / 4) % 5 + 1)).alias("severity"))


QUERIES = {f.__name__: f for f in (
    version_pairs, paragraph_units, exact_units, shingle_counts, part_similarity, unit_similarity, unit_alignment, change_counts, word_redlines, changed_facts, change_severity, change_summaries, multiset_difference, money_values,
    change_categories, severity_raised,
)}

_LINES = "SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents WHERE text IS NOT NULL"
_PAIRS = f"""SELECT min(f.a) AS a, l.doc AS b FROM (SELECT DISTINCT doc, md5(x) AS h FROM ({_LINES}) WHERE length(x) >= 200) l JOIN (SELECT md5(x) AS h, min(doc) AS a FROM ({_LINES}) WHERE length(x) >= 200 GROUP BY 1) f ON f.h = l.h GROUP BY l.doc HAVING min(f.a) < l.doc"""
_PLAIN = "regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '^\\s*(?:§\\s*)?\\d{1,3}(?:\\.\\d{1,3})*\\.?\\s+', '')"
_UNITS = f"""SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ord) - 1 AS idx, array_to_string(regexp_split_to_array(t, '\\s+')[1:8], ' ') AS title, {spaced_sql(_PLAIN)} AS spaced, regexp_replace(lower({_PLAIN}), '[^\\p{{L}}\\p{{N}}%$€£¥§]', '', 'g') AS compact
    FROM (SELECT doc, ord, trim(x, ' ') AS t FROM ({_LINES})) WHERE len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) >= 5 AND NOT regexp_matches(t, '(\\.{{3,}}|…{{2,}})\\s*\\d+\\s*$')"""
_CLAUSE = """SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS m0, CAST(floor(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 6 WHEN o_orderkey % 5 = 1 THEN o_totalprice + 1000 ELSE o_totalprice END) AS BIGINT) AS m1,
    CAST(o_orderkey % 3 * 15 + 15 AS VARCHAR) AS d0, CASE WHEN o_orderkey % 7 = 0 THEN '90' ELSE CAST(o_orderkey % 3 * 15 + 15 AS VARCHAR) END AS d1, CASE WHEN o_orderkey % 11 = 0 THEN 'may' WHEN o_orderkey % 13 = 0 THEN 'shall not' ELSE 'shall' END AS v,
    CAST(o_orderkey % 4 AS VARCHAR) AS p0, CASE WHEN o_orderkey % 17 = 0 THEN '9.5' ELSE CAST(o_orderkey % 4 AS VARCHAR) END AS p1, (['England', 'France', 'Spain'])[o_orderkey % 3 + 1] AS j0, CASE WHEN o_orderkey % 19 = 0 THEN (['England', 'France', 'Spain'])[(o_orderkey + 1) % 3 + 1] ELSE (['England', 'France', 'Spain'])[o_orderkey % 3 + 1] END AS j1 FROM orders"""
_FACTS = f"""SELECT k AS o_orderkey, 'money' AS kind, 'USD ' || m0 AS before, 'USD ' || m1 AS after, round(m1 / m0, 3) AS ratio FROM ({_CLAUSE}) WHERE m0 <> m1
    UNION ALL SELECT k, 'percent', p0 || '%', p1 || '%', NULL FROM ({_CLAUSE}) WHERE p0 <> p1 UNION ALL SELECT k, 'duration', d0 || ' days', d1 || ' days', NULL FROM ({_CLAUSE}) WHERE d0 <> d1
    UNION ALL SELECT k, 'modality', 'shall', v, NULL FROM ({_CLAUSE}) WHERE v <> 'shall' UNION ALL SELECT k, 'negation', '—', 'not', NULL FROM ({_CLAUSE}) WHERE v = 'shall not' UNION ALL SELECT k, 'jurisdiction', j0, j1, NULL FROM ({_CLAUSE}) WHERE j0 <> j1"""

SQL = {
    "version_pairs": _PAIRS,
    "paragraph_units": f"SELECT doc, idx, title, md5(compact) AS digest FROM ({_UNITS})",
    "exact_units": f"""WITH u AS (SELECT doc, idx, compact, row_number() OVER (PARTITION BY doc, compact ORDER BY idx) AS k FROM ({_UNITS})) SELECT p.a, p.b, x.idx AS a_idx, y.idx AS b_idx FROM ({_PAIRS}) p JOIN u x ON x.doc = p.a JOIN u y ON y.doc = p.b AND y.compact = x.compact AND y.k = x.k""",
    "shingle_counts": f"""WITH w AS (SELECT item_id, list_filter(string_split({spaced_sql("text")}, ' '), lambda x: x <> '') AS w FROM benchmark)
        SELECT item_id, len(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS n FROM w""",
    "part_similarity": """WITH p AS (SELECT a.p_partkey, a.p_name AS n, b.p_name AS m, list_distinct(string_split(lower(a.p_name || ' ' || a.p_type), ' ')) AS x, list_distinct(string_split(lower(b.p_name || ' ' || b.p_type), ' ')) AS y FROM part a JOIN part b ON b.p_partkey + 25 = a.p_partkey)
        SELECT p_partkey, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS jaccard, round(1 - levenshtein(lower(n), lower(m)) / greatest(length(n), length(m)), 6) AS title FROM p""",
    "changed_facts": f"SELECT o_orderkey, kind, before, after, CAST(floor(ratio * 10) AS BIGINT) AS ratio_tenths FROM ({_FACTS})",
    "change_severity": f"""WITH f AS ({_FACTS}), g AS (SELECT k, max(CASE WHEN kind = 'jurisdiction' OR ratio >= 5 OR ratio <= 0.2 THEN 3 WHEN kind IS NOT NULL THEN 2 ELSE 0 END) AS r FROM ({_CLAUSE}) c LEFT JOIN f ON f.o_orderkey = c.k GROUP BY k)
        SELECT (['cosmetic', 'minor', 'major', 'critical'])[r + 1] AS severity, count(*) AS n FROM g GROUP BY 1""",
    "change_summaries": f"""WITH f AS (SELECT *, list_position(['money', 'percent', 'duration', 'date', 'modality', 'negation', 'jurisdiction'], kind) AS n FROM ({_FACTS})),
        p AS (SELECT o_orderkey, n, CASE kind WHEN 'negation' THEN '“' || after || '” added' WHEN 'modality' THEN '“' || before || '” changed to “' || after || '”'
            ELSE CASE kind WHEN 'money' THEN 'amount' WHEN 'percent' THEN 'percentage' WHEN 'duration' THEN 'period' ELSE kind END || ' changed from ' || before || ' to ' || after END AS t FROM f QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY n) <= 2),
        s AS (SELECT o_orderkey, string_agg(t, '; ' ORDER BY n) AS t FROM p GROUP BY 1) SELECT o.o_orderkey, coalesce('Price: ' || t || '.', 'Changed; classification unavailable.') AS summary FROM orders o LEFT JOIN s ON s.o_orderkey = o.o_orderkey""",
    "multiset_difference": """WITH v AS (SELECT l_orderkey AS k, l_returnflag AS x, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n, 0 AS s FROM lineitem UNION ALL SELECT l_orderkey, l_linestatus, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber), 1 FROM lineitem),
        d AS (SELECT k, x, n, min(s) AS s FROM v GROUP BY k, x, n HAVING count(*) = 1) SELECT o.k AS l_orderkey, coalesce((SELECT string_agg(x, '' ORDER BY x) FROM d WHERE d.k = o.k AND s = 0), '') AS removed, coalesce((SELECT string_agg(x, '' ORDER BY x) FROM d WHERE d.k = o.k AND s = 1), '') AS added
        FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o""",
    "money_values": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey * 1000.0 + 500 WHEN 1 THEN (p_partkey + 0.5) * 1000000 WHEN 2 THEN p_partkey * 1000.0 END::DOUBLE AS value FROM part",
    "change_categories": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'payment' WHEN 1 THEN 'liability' WHEN 2 THEN 'term' WHEN 3 THEN 'data_protection' WHEN 4 THEN 'governing_law' ELSE CASE WHEN p_partkey % 4 = 0 THEN 'scope' ELSE 'obligations' END END AS category FROM part",
    "severity_raised": "SELECT p_partkey, (['cosmetic', 'minor', 'major', 'critical'])[greatest(p_partkey % 4 + 1, CASE WHEN p_partkey // 4 % 5 = 4 THEN 0 ELSE p_partkey // 4 % 5 + 1 END)] AS severity FROM part",
}
