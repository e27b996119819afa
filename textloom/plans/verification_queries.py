"""Queries that look benchmark passages, as quotes, up in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import verification as V
from ..sources.tables import read

_EMPTY = "cast(array() as array<struct<start:int,end:int>>)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text")


def verified_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.passages(_docs(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def compact_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.compact_passages(_docs(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def normalized_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.spaced(F.col("text"))).alias("digest"))


def normalized_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", X.compact(F.col("text")).alias("compact"))


def dehyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.regexp_replace("text", "([aeiou])(nt|th|re)", "$1-\n$2")
    return read(spark, sf_dir, "benchmark").select("item_id", X.dehyphenated(broken).alias("text"))


def precleaned_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("item_id"), F.col("text")
    raw = F.when(k % 4 == 0, F.concat(F.lit("“"), t, F.lit("” "))).when(k % 4 == 1, F.concat(F.lit("... "), t, F.lit(" [p. 12] …"))).when(k % 4 == 2, F.concat(F.lit("**\""), t, F.lit("\"**"))).otherwise(F.concat(F.lit(" "), t, F.lit("\n\n")))
    return read(spark, sf_dir, "benchmark").select("item_id", X.precleaned(raw).alias("quote"))


def extracted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", X.numbers(F.col("text")).alias("n"))
    return rows.where(F.size("n") > 0).select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.array_join("n", " ").alias("numbers"))


def number_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order line's label and its rounded twin read the same numbers."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    a = F.format_string("pay %.2f for %d", "l_extendedprice", F.col("l_quantity").cast("int"))
    b = F.format_string("pay %.1f for %d", "l_extendedprice", F.col("l_quantity").cast("int"))
    return rows.groupBy((X.numbers(a) == X.numbers(b)).alias("same")).agg(F.count("*").alias("n"))


def find_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often "an" stands in each whole text, and the first 25 places. A text is cut before each place, so the pieces'
    lengths tell where they are."""
    needle, none = "an", F.expr("named_struct('at', 0, 'places', cast(array() as array<int>))")
    rows = _docs(spark, sf_dir).select("doc_id", F.split(F.lower("text"), f"(?={needle})").alias("parts"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.when(x.startswith(needle), F.array_append(acc["places"], acc["at"])).otherwise(acc["places"]).alias("places"))
    places = F.aggregate(F.slice("parts", 1, 26), none, step, lambda acc: F.array_join(F.slice(acc["places"], 1, 25), ","))
    return rows.select("doc_id", F.size(F.filter("parts", lambda x: x.startswith(needle))).cast("long").alias("n"), places.alias("places"))


def short_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote of under three words is verified only where it stands exactly once."""
    docs = _docs(spark, sf_dir).select("doc_id", X.spaced(F.col("text")).alias("t"))
    quote = F.array_join(F.slice(F.split("t", " "), 2, 2), " ")
    rows = docs.select("doc_id", "t", quote.alias("q")).where("q <> ''")
    n = F.when(F.instr("t", F.col("q")) == 0, 0).when(F.instr(F.expr("substring(t, instr(t, q) + 1)"), F.col("q")) == 0, 1).otherwise(2)
    return rows.select("doc_id", F.when(n == 1, "verified").when(n == 0, "not_found").otherwise("too_short").alias("verdict"))


def _mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of the passages found, told as they are, in other case and spacing, with an omission, a slip, and a word replaced."""
    found = verified_passages(spark, sf_dir).join(read(spark, sf_dir, "benchmark"), "item_id")
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    n = F.size(words)
    forms = {
        "same": F.col("text"),
        "spacing": F.upper(F.regexp_replace("text", r"\s+", "  ")),
        "elided": F.concat(F.array_join(F.slice(words, 2, 4), " "), F.lit(" ... "), F.array_join(F.slice(words, n - 5, F.lit(5)), " ")),
        "slip": F.concat(F.substring("text", 1, 20), F.regexp_replace(F.expr("substring(text, 21)"), r"^(.*?[a-z]{4})[a-z]([a-z]+\b)", "$1x$2")),
        "changed": F.concat(F.array_join(F.slice(words, 1, 4), " "), F.lit(" zebra "), F.array_join(F.slice(words, F.lit(6), F.greatest(n - 5, F.lit(1))), " ")),
    }
    told = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), form.alias("text")) for kind, form in forms.items()])).alias("q")
    return found.select("doc_id", "item_id", told).select(F.concat_ws(":", "q.kind", "doc_id", "item_id").alias("quote_id"), "doc_id", "q.text")


def quote_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.expr(_EMPTY).alias("furniture"))
    rows = V.verify_quotes(docs, _mutated(spark, sf_dir).withColumn("context", F.expr(_EMPTY)))
    return rows.select("quote_id", "doc_id", "status", "method", "score", "reason", F.size("occurrences").alias("n_found"), F.get("occurrences", F.lit(0))["start"].alias("start"), F.get("occurrences", F.lit(0))["end"].alias("end"))


def attributed_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats of three documents; each quote is said to come from D1."""
    found = verified_passages(spark, sf_dir).join(read(spark, sf_dir, "benchmark"), "item_id")
    chats = found.select(F.col("item_id").alias("chat_id"), "doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.col("doc_id").desc()))
    decoys = read(spark, sf_dir, "benchmark", "item_id").select(F.col("item_id").alias("chat_id"), (F.col("item_id") + 1).alias("doc_id"))
    chats = chats.unionByName(decoys).distinct().withColumn("k", place).where("k <= 5").select("chat_id", F.concat(F.lit("D"), F.col("k")).alias("tag"), "doc_id")
    quotes = found.groupBy("item_id").agg(F.first("text").alias("text")).select(F.col("item_id").alias("quote_id"), F.col("item_id").alias("chat_id"), F.when(F.col("item_id") % 2 == 0, " d1").otherwise("D2").alias("tag"), "text")
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.expr(_EMPTY).alias("furniture"))
    return V.attribute(docs, chats, quotes).select("quote_id", "doc_id", "status", "method", "reason", "found_in")


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sections and pages laid over texts by their length."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.length("text").alias("n")).where("n > 0")
    top = docs.select("doc", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(900))).alias("start"), "n").select("doc", "start", F.least(F.col("start") + 900, "n").alias("end"), F.lit(1).alias("level"))
    sub = top.select("doc", (F.col("start") + 300).alias("start"), F.least(F.col("start") + 500, "end").alias("end"), F.lit(2).alias("level")).where("start < end")
    sections = top.unionByName(sub).withColumn("ord", F.col("start")).withColumn("number", F.when(F.col("level") == 1, F.floor(F.col("start") / 900).cast("string")).otherwise(F.concat(F.floor(F.col("start") / 900).cast("string"), F.lit(".1")))).withColumn("title", F.concat(F.lit("S"), F.col("number")))
    pages = docs.select("doc", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(1500))).alias("start")).select("doc", "start", (F.floor(F.col("start") / 1500) + 1).alias("page_no"))
    return sections, pages


def citation_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections, pages = _grid(spark, sf_dir)
    found = _docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.lit(0).alias("id"), (F.col("doc_id") % F.greatest(F.length("text"), F.lit(1))).cast("int").alias("start"), F.length("text").alias("n")).where("n > 0")
    found = found.select("doc", "id", "start", F.least(F.col("start") + 700, "n").alias("end"))
    return V.located(found, sections, pages).select("doc", F.col("start").cast("long").alias("start"), "section_number", "page_start", "page_end")


def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the orders table: line numbers stand for marks, parts for passages."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    lines = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"))
    marks = F.transform(F.sort_array(F.collect_list(F.struct((F.col("l_linenumber") * 5 % 7).alias("o"), "l_linenumber"))), lambda x: F.concat(F.lit("text ⟦c"), x["l_linenumber"].cast("string"), F.lit("⟧")))
    answers = lines.groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.array_join(marks, " ").alias("content"))
    citations = lines.select(F.col("l_orderkey").alias("answer_id"), F.concat(F.lit("c"), "l_linenumber").alias("citation_id"), (F.col("part") % 3).alias("passage"), F.when(F.col("flag") == "R", "unverified").otherwise("verified").alias("status"))
    return V.citation_numbers(answers, citations).select("answer_id", "citation_id", F.col("number").cast("long").alias("number"))


def rendered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    answers = nation.select(F.col("n_nationkey").alias("answer_id"), F.concat(F.lit("It says ⟦c1⟧ and ⟦c2⟧, as "), "n_name", F.lit(" has it ⟦c1⟧.")).alias("content"))
    citations = nation.select(F.col("n_nationkey").alias("answer_id"), F.lit("c1").alias("citation_id"), F.lit("D1").alias("tag"), F.lower("n_name").alias("display"), F.when(F.col("n_nationkey") % 3 == 0, "unverified").otherwise("verified").alias("status"))
    return V.rendered_answers(answers, citations)


def location_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    number = F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("string"))
    page = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size"))
    return rows.select("p_partkey", X.location_label(number, F.col("p_name"), page, page + (F.col("p_partkey") % 2)).alias("label"))


def highlight_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where("length(text) > 200").select(F.col("doc_id").alias("doc"))
    item = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct((i * 10).alias("start"), F.lit(9).alias("len"), (0.1 + (i % 4) * 0.2).alias("x"), (0.1 + F.floor(i / 4) * 0.05).cast("double").alias("y"), F.lit(0.195).cast("double").alias("w"), F.lit(0.02).cast("double").alias("h")))
    pages = docs.select("doc", F.lit(1).alias("page_no"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), item.alias("items"))
    spans = docs.select("doc", F.lit(0).alias("id"), (F.col("doc") % 50).cast("int").alias("start"), (F.col("doc") % 50 + 45).cast("int").alias("end"))
    rows = V.highlight_boxes(pages, spans)
    return rows.select("doc", "page_no", F.size("rects").alias("n_rects"), F.to_json("rects").alias("rects"))


QUERIES = {f.__name__: f for f in (
    verified_passages, compact_passages, normalized_spaced, normalized_compact, dehyphenated, precleaned_quotes, extracted_numbers, number_guard, find_positions, short_quotes, quote_tiers,
    attributed_quotes, citation_locations, citation_numbers, rendered_answers, location_labels, highlight_boxes,
)}


def spaced_sql(column: str) -> str:
    plain = f"translate(lower({column}), '‘’‚‛′`´“”„‟″«»‐‑‒–—―−﹘﹣－' || chr(160) || chr(173) || chr(8203) || chr(65279), '''''''''''''''\"\"\"\"\"\"\"---------- ')"
    return f"trim(regexp_replace({plain}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"


_COMPACT = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}%$€£¥§]', '', 'g')"

SQL = {
    "verified_passages": f"""WITH d AS (SELECT doc_id, {spaced_sql("text")} AS t FROM documents), b AS (SELECT item_id, {spaced_sql("text")} AS p FROM benchmark)
        SELECT doc_id, item_id, CAST(instr(t, p) - 1 AS BIGINT) AS position FROM d JOIN b ON contains(t, p) WHERE p <> '' AND len(string_split(p, ' ')) >= 5""",
    "compact_passages": f"""WITH d AS (SELECT doc_id, text, {_COMPACT.format("text")} AS t FROM documents), b AS (SELECT item_id, {_COMPACT.format("text")} AS p, text AS x FROM benchmark)
        SELECT doc_id, item_id FROM d JOIN b ON contains(t, p) WHERE length(p) >= 16 AND list_has_all(list_transform(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*'), lambda n: replace(n, ',', '')), list_transform(regexp_extract_all(x, '\\d+(?:[.,]\\d+)*'), lambda n: replace(n, ',', '')))""",
    "normalized_spaced": f"SELECT doc_id, md5({spaced_sql('text')}) AS digest FROM documents",
    "normalized_compact": f"SELECT item_id, {_COMPACT.format('text')} AS compact FROM benchmark",
    "dehyphenated": "SELECT item_id, regexp_replace(regexp_replace(text, '([aeiou])(nt|th|re)', '\\1-' || chr(10) || '\\2', 'g'), '[-\\x{AD}\\x{2010}\\x{2011}][ \\t\\r\\x{A0}]*\\n[ \\t\\r\\n\\x{A0}]*(\\p{Ll})', '\\1', 'g') AS text FROM benchmark",
    "precleaned_quotes": """WITH q AS (SELECT item_id, item_id % 4 AS k, text AS t FROM benchmark), c AS (SELECT item_id, k, trim(regexp_replace(regexp_replace(t, '\\r?\\n+', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS t FROM q)
        SELECT item_id, t AS quote FROM c""",
    "extracted_numbers": """WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*'), lambda x: replace(x, ',', '')) AS n FROM documents)
        SELECT doc_id, len(n) AS n_numbers, array_to_string(n, ' ') AS numbers FROM n WHERE len(n) > 0""",
    "number_guard": "SELECT printf('%.2f', l_extendedprice) = printf('%.1f', l_extendedprice) AS same, count(*) AS n FROM lineitem GROUP BY 1",
    "find_positions": """WITH d AS (SELECT doc_id, string_split(lower(text), 'an') AS p FROM documents)
        SELECT doc_id, len(p) - 1 AS n, array_to_string(list_transform(range(1, least(25, len(p) - 1) + 1), lambda k: list_sum(list_transform(p[1:k], lambda x: length(x) + 2)) - 2), ',') AS places FROM d""",
    "short_quotes": f"""WITH d AS (SELECT doc_id, {spaced_sql("text")} AS t FROM documents), q AS (SELECT doc_id, t, array_to_string(string_split(t, ' ')[2:3], ' ') AS q FROM d)
        SELECT doc_id, CASE WHEN instr(t, q) = 0 THEN 'not_found' WHEN instr(substring(t, instr(t, q) + 1), q) = 0 THEN 'verified' ELSE 'too_short' END AS verdict FROM q WHERE q <> ''""",
    "citation_locations": """WITH d AS (SELECT doc_id AS doc, length(text) AS n FROM documents WHERE length(text) > 0), f AS (SELECT doc, n, doc % n AS s, least(doc % n + 700, n) AS e FROM d)
        SELECT doc, s AS start, CASE WHEN s % 900 >= 300 AND s % 900 < 500 THEN (s // 900) || '.1' ELSE CAST(s // 900 AS VARCHAR) END AS section_number, s // 1500 + 1 AS page_start, greatest(s, e - 1) // 1500 + 1 AS page_end FROM f""",
    "citation_numbers": """WITH l AS (SELECT l_orderkey AS a, l_linenumber AS c, min(l_partkey) % 3 AS p, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c * 5 % 7, c) AS pos FROM l),
        m AS (SELECT a, c, min(pos) OVER (PARTITION BY a, p) AS seen FROM o WHERE f <> 'R') SELECT a AS answer_id, 'c' || c AS citation_id, dense_rank() OVER (PARTITION BY a ORDER BY seen) AS number FROM m""",
    "rendered_answers": """SELECT n_nationkey AS answer_id, 'It says ' || q || ' and , as ' || n_name || ' has it ' || q || '.' AS content
        FROM (SELECT *, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE ' <quote doc="D1">' || lower(n_name) || '</quote> ' END AS q FROM nation)""",
    "location_labels": """SELECT p_partkey, concat_ws(' · ', CASE WHEN p_partkey % 4 <> 0 THEN '§' || p_size || ' ' || p_name ELSE p_name END,
        CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'p. ' || p_size ELSE 'p. ' || p_size || '–' || (p_size + 1) END END) AS label FROM part""",
}
