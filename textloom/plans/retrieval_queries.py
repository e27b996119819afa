"""Queries of retrieval and coverage. Lines of documents are chunks; the openings of benchmark passages are questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import coverage as C
from ..operators import retrieval as R
from ..sources.tables import read
from .structure_queries import _HEADS, _numbered_lines, lengths, section_tree, text_lines


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).withColumn("tokens", X.token_estimate(F.col("text")))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.array_join(F.slice(F.split("text", "[ \n]+"), 1, 9), " ").alias("text"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the questions' terms."""
    return R.postings(_chunks(spark, sf_dir), R.question_terms(_questions(spark, sf_dir)))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of several kinds made of part names."""
    k, name = F.col("p_partkey"), F.col("p_name")
    kinds = ["Can you summarize it?", "hightlight the imp[ortant stuff", "Is there any {} in section 4.2?", "What does Force Majeure say about \"{}\"?", "does it mention the {}", "tell me about clause 12.3 and the {}", "{}", "How many {} are there, and who pays?", "give me an overwiew please", "the agreement"]
    text = F.when(F.lit(False), "")
    for i, q in enumerate(kinds):
        a, _, b = q.partition("{}")
        text = text.when(k % len(kinds) == i, F.concat(F.lit(a), name, F.lit(b)) if "{}" in q else F.lit(q))
    return read(spark, sf_dir, "part", "p_partkey", "p_name").select(k.alias("question_id"), text.alias("text"))


_ASKED = """SELECT p_partkey AS question_id, CASE p_partkey % 10 WHEN 0 THEN 'Can you summarize it?' WHEN 1 THEN 'hightlight the imp[ortant stuff' WHEN 2 THEN 'Is there any ' || p_name || ' in section 4.2?'
    WHEN 3 THEN 'What does Force Majeure say about "' || p_name || '"?' WHEN 4 THEN 'does it mention the ' || p_name WHEN 5 THEN 'tell me about clause 12.3 and the ' || p_name WHEN 6 THEN p_name
    WHEN 7 THEN 'How many ' || p_name || ' are there, and who pays?' WHEN 8 THEN 'give me an overwiew please' ELSE 'the agreement' END AS text, p_name FROM part"""
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_GENERIC = "[" + ", ".join(f"'{w}'" for w in X.CONTRACT_WORDS) + "]"


def _terms_sql(column: str) -> str:
    words = f"list_filter(list_distinct(regexp_extract_all(lower({column}), '[a-z0-9]{{3,}}')), lambda w: NOT list_contains({_STOP}, w))"
    return words


def or_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("question_id", F.array_join(F.sort_array(X.search_terms(F.col("text"))), " | ").alias("query"))


def boost_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("question_id", F.array_join(X.phrases(F.col("text")), ";").alias("phrases"))


def section_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("question_id", F.array_join(X.section_refs(F.col("text")), ";").alias("refs"))


def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.postings(_chunks(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("n_chunks"), F.count_distinct("doc").alias("n_docs"), F.sum("tf").alias("n"))
    return rows


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.keyword_leg(_index(spark, sf_dir), _questions(spark, sf_dir))
    return rows.select("question_id", "doc", F.col("ord").cast("long").alias("ord"), F.col("rank").cast("long").alias("rank"))


def precise_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.precise_leg(_index(spark, sf_dir), _questions(spark, sf_dir))
    return rows.select("question_id", "doc", F.col("ord").cast("long").alias("ord"), F.col("rank").cast("long").alias("rank"))


def filled_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, questions = _index(spark, sf_dir), _questions(spark, sf_dir)
    rows = R.filled(R.precise_leg(index, questions), R.keyword_leg(index, questions))
    return rows.select("question_id", "doc", F.col("ord").cast("long").alias("ord"), F.col("rank").cast("long").alias("rank"))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("question_id", F.array_join(F.slice(F.split("text", " "), 3, 3), " ").alias("phrase"))


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.phrase_leg(_chunks(spark, sf_dir), _phrases(spark, sf_dir))
    return rows.select("question_id", "doc", F.col("ord").cast("long").alias("ord"), F.col("rank").cast("long").alias("rank"))


def section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = section_tree(spark, sf_dir).join(_section_numbers(spark, sf_dir), ["doc", "ord"])
    chunks = _numbered_lines(spark, sf_dir).select("doc", "ord", F.col("start").cast("long").alias("start"), (F.col("start") + 150).cast("long").alias("end"))
    refs = read(spark, sf_dir, "part", "p_partkey").select(F.floor(F.col("p_partkey") / 40).alias("doc")).distinct().select(F.col("doc").alias("question_id"), "doc", F.concat(F.col("doc") % 5 + 1, F.lit(".1")).alias("number"))
    rows = R.section_leg(chunks, tree, refs)
    return rows.select("question_id", "doc", F.col("ord").cast("long").alias("ord"), F.col("rank").cast("long").alias("rank"))


def _section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import structure as S

    heads = S.headings(_numbered_lines(spark, sf_dir))
    return S.section_tree(heads, heads.groupBy("doc").agg(F.lit(4000).alias("n"))).select("doc", F.col("ord").cast("long").alias("ord"), "number")


def fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    rows = R.fused([(R.keyword_leg(_index(spark, sf_dir), questions), 1.0), (R.phrase_leg(chunks, _phrases(spark, sf_dir)), 1.5)])
    return rows.select("question_id", "doc", F.col("ord").cast("long").alias("ord"), "score", F.col("rank").cast("long").alias("rank"))


def budgeted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    ranked = R.keyword_leg(_index(spark, sf_dir), _questions(spark, sf_dir))
    return R.within_budget(ranked, chunks, 600).select("question_id", "doc", F.col("ord").cast("long").alias("ord"), F.col("place").cast("long").alias("place"))


def neighbour_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    ranked = R.keyword_leg(_index(spark, sf_dir), _questions(spark, sf_dir)).withColumn("place", F.col("rank") - 1)
    return R.with_neighbours(ranked, chunks).select("question_id", "doc", F.col("ord").cast("long").alias("ord"))


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = section_tree(spark, sf_dir).join(_section_numbers(spark, sf_dir), ["doc", "ord"]).withColumn("level", F.col("level").cast("int"))
    return R.outline(tree, 110).select("doc", F.col("levels").cast("long").alias("levels"), F.col("hidden").cast("long").alias("hidden"), F.md5("outline").alias("digest"))


def exhaustive_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("question_id", F.col("text").rlike(R.EXHAUSTIVE).alias("exhaustive"))


def overview_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _asked(spark, sf_dir).select(F.explode(R.content_words(F.col("text"))).alias("word")).distinct().withColumn("specific", F.col("word") != "overwiew")
    return R.overview_questions(_asked(spark, sf_dir), words)


def specific_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark passages with a letter changed, against the documents' vocabulary."""
    vocab = R.vocabulary(read(spark, sf_dir, "documents", "text"))
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("w"))
    words = words.select(F.when(F.length("w") % 2 == 0, F.concat(F.substring("w", 1, 2), F.lit("q"), F.expr("substring(w, 4)"))).otherwise(F.col("w")).alias("word"))
    return R.specific_words(words, vocab)


def section_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = section_tree(spark, sf_dir).join(_section_numbers(spark, sf_dir), ["doc", "ord"])
    asked = tree.select("doc").distinct().select(F.col("doc").alias("ask_id"), "doc", F.concat(F.col("doc") % 6, F.lit("."), F.col("doc") % 11).alias("query"))
    return R.did_you_mean(asked, tree).select("ask_id", "number", "title", F.col("place").cast("long").alias("place"))


def answer_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("question_id")
    mode = R.answer_mode(n % 7 == 0, n % 5 == 0, F.col("text").rlike(R.EXHAUSTIVE), n % 3, n % 11 == 0)
    return _asked(spark, sf_dir).groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


def find_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often "the" stands in each text (1000 at most), and 40 characters around its first place."""
    rows = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.lower("text").alias("t"))
    n = F.least(F.lit(1000), ((F.length("t") - F.length(F.replace("t", F.lit("the"), F.lit("")))) / 3).cast("long"))
    at = F.instr("t", F.lit("the"))
    return rows.where(at > 0).select("doc_id", n.cast("long").alias("n"), F.substring("t", F.greatest(F.lit(1), at - 40), F.lit(83)).alias("around"))


def absence_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("The text does not mention a "), "p_name")).when(k % 4 == 1, F.concat(F.lit("There is no "), "p_name")).when(k % 4 == 2, F.concat(F.lit("A "), "p_name", F.lit(" is due"))).otherwise("It contains nothing but that is not included")
    return read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", C.absence_claim(text).alias("claims"))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("doc"), F.length("text").alias("n")).where("n > 0")
    cut = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(700))).alias("start")
    rows = rows.select("doc", "n", cut)
    return rows.select("doc", "n", F.col("start").cast("long").alias("start"), F.least("n", F.col("start") + F.when(F.col("doc") % 3 == 0, 700).otherwise(500)).cast("long").alias("end"), (F.col("start") / 700).cast("long").alias("k"))


_READS = "SELECT doc_id AS doc, n, k * 700 AS s, least(n, k * 700 + CASE WHEN doc_id % 3 = 0 THEN 700 ELSE 500 END) AS e, k FROM (SELECT doc_id, length(text) AS n, unnest(range(0, (length(text) + 699) // 700)) AS k FROM documents WHERE length(text) > 0)"


def document_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reads(spark, sf_dir)
    furniture = rows.where("k % 4 = 1").select("doc", F.col("start").alias("start"), F.least("n", F.col("start") + 30).cast("long").alias("end"))
    bad = rows.where("k % 9 = 5").select("doc", "start", F.least("n", F.col("start") + 100).cast("long").alias("end"))
    out = C.coverage(lengths(spark, sf_dir).where("n > 0"), rows, furniture, bad)
    return out.select("doc", F.col("total").cast("long").alias("total"), F.col("covered").cast("long").alias("covered"), F.round("fraction", 6).alias("fraction"))


def complete_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = lengths(spark, sf_dir).select("doc", F.when(F.col("doc") % 5 == 0, 0.5).otherwise(1.0).alias("fraction"), F.when(F.col("doc") % 31 == 0, 1).otherwise(0).alias("n_unreadable"), F.lit(0).alias("n_failed"))
    asked = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select((F.col("o_orderkey") % 3000).alias("question_id"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 900).alias("doc"))
    return C.complete(per, asked)


def touched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reads(spark, sf_dir)
    pages = rows.select("doc", F.col("start"), F.least("n", F.col("start") + 700).cast("long").alias("end"), (F.col("k") + 1).alias("page"))
    return C.touched(rows.where("k % 3 <> 2").select("doc", (F.col("start") + 90).alias("start"), "end"), pages, "page")


def unique_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "value").select(F.col("user_id").alias("doc"), F.floor("value").alias("start"), (F.floor("value") + 5).alias("end"), F.col("event_id").alias("window"))
    return C.unique_findings(rows)


def reduced_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "value").select(F.col("user_id").alias("doc"), F.floor(F.col("value") * 40).alias("start"), (F.floor(F.col("value") * 40) + 5).alias("end"))
    n = rows.groupBy("doc").agg(F.lit(20000).cast("long").alias("n"))
    return C.reduced_context(rows, n, 30, 400)


def failed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return C.failed_pages(rows.select(F.col("l_orderkey").alias("doc"), (F.col("l_quantity").cast("long") - 3).alias("page_start"), (F.col("l_quantity").cast("long") - 3 + F.col("l_linenumber") % 3).alias("page_end")))


def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    seq = F.col("l_linenumber") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_quantity")
    # The SQL's casts round, those here cut off.
    reads = rows.select(F.col("l_orderkey").alias("run_id"), F.rint(seq).cast("long").alias("seq"), (F.col("l_suppkey") % 3).alias("doc"), (F.rint("l_quantity").cast("long") % 4).alias("start"), F.lit(3).cast("long").alias("end"))
    return C.evidence(reads)


QUERIES = {f.__name__: f for f in (
    or_queries, boost_phrases, section_refs, term_postings, keyword_search, precise_search, filled_search, phrase_search, section_search, fused_search, budgeted_choice, neighbour_chunks, outlines, exhaustive_questions,
    overview_questions, specific_words, section_suggestions, answer_modes, find_exact, absence_claims, document_coverage, complete_answers, touched_pages, unique_findings, reduced_context, failed_pages, evidence_ids,
)}

_LINES = "SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents WHERE text IS NOT NULL"
_POSTINGS = f"SELECT doc, ord, w AS term, count(*) AS tf FROM (SELECT doc, ord, unnest(regexp_extract_all(lower(x), '[a-z0-9]{{3,}}')) AS w FROM ({_LINES})) WHERE NOT list_contains({_STOP}, w) GROUP BY 1, 2, 3"
_QUESTIONS = "SELECT item_id AS q, array_to_string(regexp_split_to_array(text, '[ \\n]+')[1:9], ' ') AS t FROM benchmark"


def _search_terms(column: str) -> str:
    words = _terms_sql(column)
    specific = f"list_filter({words}, lambda w: NOT list_contains({_GENERIC}, w))"
    return f"(CASE WHEN len({specific}) > 0 THEN {specific} ELSE {words} END)[1:12]"


def _ordered_terms(source: str, key: str, column: str) -> str:
    """Distinct terms by first place, as DuckDB's list_distinct keeps no order."""
    return f"""SELECT {key}, w AS term FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY p) AS k FROM (SELECT {key}, w, min(p) AS p FROM (
        SELECT {key}, unnest(regexp_extract_all(lower({column}), '[a-z0-9]{{3,}}')) AS w, generate_subscripts(regexp_extract_all(lower({column}), '[a-z0-9]{{3,}}'), 1) AS p FROM ({source})) WHERE NOT list_contains({_STOP}, w) GROUP BY 1, 2)) WHERE k <= 12"""


_KEYWORD = f"""SELECT q, doc, ord, row_number() OVER (PARTITION BY q ORDER BY m DESC, tf DESC, doc, ord) AS rank FROM (
    SELECT q, doc, ord, count(*) AS m, sum(tf) AS tf FROM ({_ordered_terms(_QUESTIONS, "q", "t")}) t JOIN ({_POSTINGS}) p ON p.term = t.term GROUP BY 1, 2, 3) QUALIFY rank <= 20"""
_PRECISE = f"""SELECT q, doc, ord, row_number() OVER (PARTITION BY q ORDER BY tf DESC, doc, ord) AS rank FROM (
    SELECT t.q, doc, ord, count(*) AS m, sum(tf) AS tf, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY q) AS n FROM ({_ordered_terms(_QUESTIONS, "q", "t")})) t JOIN ({_POSTINGS}) p ON p.term = t.term GROUP BY 1, 2, 3) WHERE m = n QUALIFY rank <= 20"""
_PHRASE = f"""SELECT q, doc, ord, row_number() OVER (PARTITION BY q ORDER BY doc, ord) AS rank FROM ({_LINES}) l JOIN (SELECT q, lower(array_to_string(string_split(t, ' ')[3:5], ' ')) AS p FROM ({_QUESTIONS})) f ON contains(lower(l.x), f.p) QUALIFY rank <= 10"""
_TREE = f"""SELECT x.*, coalesce((SELECT min(b.start) FROM h b WHERE b.doc = x.doc AND b.i > x.i AND b.level <= x.level), 4000) AS e FROM h x"""
_H = f"h AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY start) - 1 AS i FROM ({_HEADS}))"

SQL = {
    "or_queries": f"SELECT question_id, array_to_string(list_sort({_search_terms('text')}), ' | ') AS query FROM ({_ASKED})",
    "boost_phrases": f"""SELECT question_id, CASE question_id % 10 WHEN 3 THEN p_name || ';Force Majeure' ELSE '' END AS phrases FROM ({_ASKED})""",
    "section_refs": f"SELECT question_id, array_to_string(regexp_extract_all(text, '(?i)(?:clause|section|article|§)\\s*(\\d{{1,3}}(?:\\.\\d{{1,3}}){{0,3}})', 1), ';') AS refs FROM ({_ASKED})",
    "term_postings": f"SELECT term, count(*) AS n_chunks, count(DISTINCT doc) AS n_docs, CAST(sum(tf) AS BIGINT) AS n FROM ({_POSTINGS}) GROUP BY term",
    "keyword_search": f"SELECT q AS question_id, doc, ord, rank FROM ({_KEYWORD})",
    "precise_search": f"SELECT q AS question_id, doc, ord, rank FROM ({_PRECISE})",
    "filled_search": f"""WITH b AS (SELECT q, doc, ord, min((leg, rank)) AS k FROM (SELECT *, 0 AS leg FROM ({_PRECISE}) UNION ALL SELECT *, 1 FROM ({_KEYWORD})) GROUP BY 1, 2, 3)
        SELECT q AS question_id, doc, ord, row_number() OVER (PARTITION BY q ORDER BY k) AS rank FROM b QUALIFY rank <= 20""",
    "phrase_search": f"SELECT q AS question_id, doc, ord, rank FROM ({_PHRASE})",
    "section_search": f"""WITH {_H}, t AS ({_TREE}), r AS (SELECT DISTINCT p_partkey // 40 AS doc, (p_partkey // 40 % 5 + 1) || '.1' AS n FROM part),
        s AS (SELECT t.*, row_number() OVER (PARTITION BY t.doc ORDER BY i) AS k FROM t JOIN r ON r.doc = t.doc AND (t.number = r.n OR starts_with(t.number, r.n || '.'))), l AS (SELECT p_partkey // 40 AS doc, p_partkey % 40 AS ord, p_partkey % 40 * 100 AS a FROM part),
        c AS (SELECT s.doc, s.i, l.ord, row_number() OVER (PARTITION BY s.doc, s.i ORDER BY l.ord) AS k FROM s JOIN l ON l.doc = s.doc AND l.a < s.e AND s.start < l.a + 150 WHERE s.k <= 6), m AS (SELECT doc, ord, min((i, k)) AS b FROM c WHERE k <= 6 GROUP BY 1, 2)
        SELECT doc AS question_id, doc, ord, row_number() OVER (PARTITION BY doc ORDER BY b) AS rank FROM m""",
    "fused_search": f"""WITH b AS (SELECT q, doc, ord, round(sum(s), 9) AS score, min((leg, rank)) AS k FROM (SELECT *, 1.0::DOUBLE / (60 + rank) AS s, 0 AS leg FROM ({_KEYWORD}) UNION ALL SELECT *, 1.5::DOUBLE / (60 + rank), 1 FROM ({_PHRASE})) GROUP BY 1, 2, 3)
        SELECT q AS question_id, doc, ord, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, k, doc, ord) AS rank FROM b""",
    "budgeted_choice": f"""WITH RECURSIVE r AS (SELECT k.q, k.doc, k.ord, k.rank, CAST(ceil(length(x) / 4) AS BIGINT) AS n FROM ({_KEYWORD}) k JOIN ({_LINES}) l ON l.doc = k.doc AND l.ord = k.ord),
        f AS (SELECT q, 0 AS rank, CAST(0 AS BIGINT) AS used, false AS took, CAST(0 AS BIGINT) AS doc, CAST(0 AS BIGINT) AS ord FROM (SELECT DISTINCT q FROM r)
            UNION ALL SELECT f.q, f.rank + 1, CASE WHEN f.used < 582 AND f.used + r.n <= 600 THEN f.used + r.n ELSE f.used END, f.used < 582 AND f.used + r.n <= 600, r.doc, r.ord FROM f JOIN r ON r.q = f.q AND r.rank = f.rank + 1)
        SELECT q AS question_id, doc, ord, row_number() OVER (PARTITION BY q ORDER BY rank) - 1 AS place FROM f WHERE took""",
    "neighbour_chunks": f"""WITH k AS ({_KEYWORD}) SELECT q AS question_id, doc, ord FROM k UNION SELECT k.q, l.doc, l.ord FROM k JOIN ({_LINES}) l ON l.doc = k.doc AND abs(l.ord - k.ord) = 1 WHERE k.rank <= 3""",
    "exhaustive_questions": f"SELECT question_id, regexp_matches(text, '{R.EXHAUSTIVE}') AS exhaustive FROM ({_ASKED})",
    "overview_questions": f"SELECT question_id, question_id % 10 IN (0, 1, 8, 9) AS overview FROM ({_ASKED})",
    "specific_words": """WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS v FROM documents), b AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark),
        q AS (SELECT DISTINCT CASE WHEN length(w) % 2 = 0 THEN substring(w, 1, 2) || 'q' || substring(w, 4) ELSE w END AS w FROM b)
        SELECT w AS word, w IN (SELECT v FROM v) OR (length(w) >= 4 AND NOT EXISTS (SELECT 1 FROM v WHERE abs(length(v) - length(w)) <= 2 AND levenshtein(v, w) <= CASE WHEN length(w) >= 7 THEN 2 ELSE 1 END)) AS specific FROM q""",
    "section_suggestions": f"""WITH {_H}, q AS (SELECT DISTINCT doc, (doc % 6) || '.' || (doc % 11) AS q FROM h), s AS (SELECT h.doc, number, title, row_number() OVER (PARTITION BY h.doc ORDER BY CASE WHEN contains(lower(title), q) THEN 0 ELSE 1 END,
        levenshtein(number, q) - CASE WHEN string_split(number, '.')[1] = string_split(q, '.')[1] THEN 0.5 ELSE 0 END, i) AS place FROM h JOIN q ON q.doc = h.doc WHERE number IS NOT NULL) SELECT doc AS ask_id, number, title, place FROM s WHERE place <= 3""",
    "answer_modes": f"""SELECT CASE WHEN question_id % 7 = 0 THEN 'full' WHEN question_id % 5 = 0 THEN 'overview' WHEN regexp_matches(text, '{R.EXHAUSTIVE}') THEN 'scan' WHEN question_id % 3 = 0 OR question_id % 11 = 0 THEN 'scan' ELSE 'excerpts' END AS mode, count(*) AS n FROM ({_ASKED}) GROUP BY 1""",
    "find_exact": "SELECT doc_id, least(1000, (length(t) - length(replace(t, 'the', ''))) // 3) AS n, substring(t, greatest(1, instr(t, 'the') - 40), 83) AS around FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE contains(t, 'the')",
    "absence_claims": "SELECT p_partkey, p_partkey % 4 <> 2 AS claims FROM part",
    "document_coverage": f"""WITH r AS ({_READS}), c AS (SELECT doc, n, p, (p % 700 < CASE WHEN doc % 3 = 0 THEN 700 ELSE 500 END) AND NOT (p // 700 % 4 = 1 AND p % 700 < 30) AND NOT (p // 700 % 9 = 5 AND p % 700 < 100) AS read, p // 700 % 4 = 1 AND p % 700 < 30 AS f
            FROM (SELECT doc_id AS doc, length(text) AS n, unnest(range(0, length(text))) AS p FROM documents WHERE length(text) > 0)),
        g AS (SELECT doc, count(*) FILTER (WHERE NOT f) AS total, count(*) FILTER (WHERE read) AS covered FROM c GROUP BY doc)
        SELECT doc, total, covered, round(CASE WHEN covered >= greatest(1, total) - 2 THEN 1.0 ELSE covered / greatest(1, total) END, 6) AS fraction FROM g""",
    "complete_answers": """WITH a AS (SELECT o_orderkey % 3000 AS q, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 900 END AS doc FROM orders)
        SELECT q AS question_id, count(a.doc) > 0 AND bool_and(a.doc IS NULL OR (d.doc_id IS NOT NULL AND d.doc_id % 5 <> 0 AND d.doc_id % 31 <> 0)) AS complete FROM a LEFT JOIN documents d ON d.doc_id = a.doc GROUP BY q""",
    "touched_pages": f"""WITH r AS ({_READS}), t AS (SELECT doc, k + 1 AS n FROM r WHERE k % 3 <> 2 AND e - (s + 90) > 20), i AS (SELECT doc, n, n - row_number() OVER (PARTITION BY doc ORDER BY n) AS g FROM t), u AS (SELECT doc, min(n) AS lo, max(n) AS hi FROM i GROUP BY doc, g)
        SELECT doc, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '–' || hi END, ', ' ORDER BY lo) AS label FROM u GROUP BY doc""",
    "unique_findings": """SELECT user_id AS doc, CAST(floor(value) AS BIGINT) AS start, CAST(floor(value) AS BIGINT) + 5 AS "end", min(event_id) AS "window" FROM events GROUP BY 1, 2, 3""",
    "reduced_context": """WITH f AS (SELECT user_id AS doc, greatest(0, CAST(floor(value * 40) AS BIGINT) - 30) AS s, least(20000, CAST(floor(value * 40) AS BIGINT) + 35) AS e FROM events),
        o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM f), i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o),
        m AS (SELECT doc, min(s) AS s, max(e) AS e FROM i GROUP BY doc, k), u AS (SELECT *, CAST(sum(ceil((e - s) / 4)) OVER (PARTITION BY doc ORDER BY s) AS BIGINT) AS used FROM m) SELECT doc, s AS start, e AS "end", used FROM u WHERE used <= 400""",
    "failed_pages": """WITH p AS (SELECT DISTINCT l_orderkey AS doc, unnest(range(CAST(l_quantity AS BIGINT) - 3, CAST(l_quantity AS BIGINT) - 3 + l_linenumber % 3 + 1)) AS n FROM lineitem WHERE CAST(l_quantity AS BIGINT) - 3 > 0),
        i AS (SELECT doc, n, n - row_number() OVER (PARTITION BY doc ORDER BY n) AS g FROM p), u AS (SELECT doc, min(n) AS lo, max(n) AS hi FROM i GROUP BY doc, g)
        SELECT doc, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '–' || hi END, ', ' ORDER BY lo) AS label FROM u GROUP BY doc""",
    "evidence_ids": """WITH r AS (SELECT l_orderkey AS run_id, CAST(l_linenumber * 1000000 + l_suppkey * 100 + l_quantity AS BIGINT) AS seq, l_suppkey % 3 AS doc, CAST(l_quantity AS BIGINT) % 4 AS s FROM lineitem),
        f AS (SELECT run_id, doc, s, min(seq) AS seq FROM r WHERE s < 3 GROUP BY 1, 2, 3) SELECT run_id, 'E' || row_number() OVER (PARTITION BY run_id ORDER BY seq) AS evidence_id, doc, s AS start, CAST(3 AS BIGINT) AS "end" FROM f""",
}
