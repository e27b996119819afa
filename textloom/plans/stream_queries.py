"""Queries of the quote parser, file intake and tool calls. Quotes are put into conversations."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tools as T
from ..functions import text as X
from ..functions.quote_stream import QUOTE_LIMIT
from ..sources import files as S
from ..sources.tables import read
from ..streaming import answers as A
from ..streaming import quotes as Q


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn whole, with a quote from its character 41: of 40 characters, or of all that follow in each third message; some
    behind the sentinel, some that never close. A null turn is an empty one."""
    rows = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    t, k = F.col("text"), F.col("conv_id") + F.col("turn")
    stop = F.when(k % 3 == 0, F.greatest(F.length(t), F.lit(40))).otherwise(80)
    quote, rest = F.substring(t, F.lit(41), F.greatest(stop - 40, F.lit(0))), F.substring(t, stop + 1, F.length(t))
    body = F.concat(F.substring(t, 1, 40), F.lit('<quote doc="2">'), quote, F.when(k % 5 != 0, "</quote>").otherwise(""), rest)
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.when(k % 7 == 0, F.concat(F.lit("[[NOT_FOUND]]\n"), body)).otherwise(body).alias("text"))


def quote_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.parsed(_messages(spark, sf_dir)).select("msg_id", F.col("seq").cast("long").alias("seq"), "type", "tag", "text", "reason")


def _pieces(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """The messages in pieces of 23 characters, written to a folder; a message of no text has one empty piece."""
    rows = _messages(spark, sf_dir).select("msg_id", F.posexplode(F.expr("transform(sequence(0, length(text) - 1, 23), i -> substring(text, i + 1, 23))")).alias("seq", "delta"), F.ceil(F.length("text") / 23).alias("n"))
    rows = rows.select("msg_id", "seq", "delta", (F.col("seq") == F.col("n") - 1).alias("last"))
    rows.write.parquet(f"{root}/deltas")
    return rows


def _files_a_batch(spark: SparkSession) -> int:
    """Files that a micro-batch reads: each batch opens every partition's state, so with more partitions it takes more files; else batches and partitions would
    both grow with the input, and the openings by their product."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


def quote_events_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages in pieces of 23 characters through Structured Streaming, to the events' table and back; neighbouring
    text events are joined."""
    from ..sources.scratch import folder

    root = f"{folder(spark)}/quote-stream-{uuid.uuid4().hex}"
    rows = _pieces(spark, sf_dir, root)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _files_a_batch(spark)).parquet(f"{root}/deltas")
    query = Q.streamed(stream).writeStream.outputMode("append").format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return _joined_events(spark.read.schema(Q.EVENTS).parquet(f"{root}/events"))


def _joined_events(events: DataFrame, order: str = "seq") -> DataFrame:
    per = events.groupBy("msg_id").agg(F.sort_array(F.collect_list(F.struct(order, "type", "text"))).alias("e"))
    text = F.array_join(F.transform(F.filter("e", lambda x: x["type"] == "text"), lambda x: x["text"]), "")
    return per.select("msg_id", F.md5(text).alias("text"), F.array_join(F.transform(F.filter("e", lambda x: x["type"] != "text"), lambda x: x["type"]), ",").alias("events"))


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the messages' pieces send, as a sink has written it; those of nothing found end early."""
    from ..sources.scratch import folder

    root = f"{folder(spark)}/answers-{uuid.uuid4().hex}"
    rows = _pieces(spark, sf_dir, root)
    if (none := _none_read(spark, f"{root}/deltas", A.SENT)) is not None:
        return none
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _files_a_batch(spark)).parquet(f"{root}/deltas")
    query = A.sent(stream, escalate=True).writeStream.foreachBatch(A.table_sink(f"{root}/sent")).option("checkpointLocation", f"{root}/state").trigger(processingTime="200 milliseconds").start()
    A.drained(query, spark.read.parquet(f"{root}/deltas").count())
    return A.received(spark, f"{root}/sent")


def _none_read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """An empty frame if the folder's table has no rows: a stream over it would send nothing and write no table."""
    return spark.createDataFrame([], f"{schema}, batch_id long") if spark.read.parquet(path).isEmpty() else None


def sent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered events of each message: whether the numbers have no gap, and the kinds in order; one done or escalated, at the end."""
    rows = _sent(spark, sf_dir)
    counts = rows.groupBy("msg_id").agg(F.max("id").alias("most"), F.count_distinct("id").alias("n"), F.count("id").alias("m"))
    told = _joined_events(rows.where("id is not null"), "id").join(counts, "msg_id")
    return told.select("msg_id", "text", "events", ((F.col("most") == F.col("n")) & (F.col("n") == F.col("m"))).alias("gapless"))


def escalated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that ended early, each asked anew of the whole document of its conversation's number, in windows, with the deterministic extractor:
    the account of its windows, and its findings as verified places of the document, in order ("12–40, 55–90", empty without any)."""
    from ..operators import scan as N
    from ..operators import structure as S
    from ..sources.scratch import scratch_table
    from .document_queries import _docs
    from .structure_queries import chunks_of

    stopped = scratch_table(A.escalated(_sent(spark, sf_dir)).withColumn("doc", F.floor(F.col("msg_id") / 1000)), "stopped")
    # Only documents that are asked are cut into chunks and windows; what follows reads them from here.
    docs = scratch_table(_docs(spark, sf_dir).join(stopped.select("doc").distinct(), "doc", "left_semi"), "asked-documents")
    turns = _messages(spark, sf_dir).select("msg_id", F.substring("text", 15, 60).alias("text"))
    questions = stopped.join(docs.select("doc"), "doc").join(turns, "msg_id").select(F.col("msg_id").alias("question_id"), "doc", "text")
    windows = S.windows(chunks_of(docs), docs.select("doc", F.length("text").alias("n")), 1500)
    found, account = N.scan(windows, docs, questions, N.sentence_picker)
    place = F.struct("start", "end", F.concat_ws("–", "start", "end").alias("label"))
    per = found.groupBy("question_id", "doc").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(place))["label"], ", ").alias("places"))
    return account.join(per, ["question_id", "doc"], "left").select(F.col("question_id").alias("msg_id"), "doc", "n_windows", "n_failed", "n_discarded", F.coalesce("n", F.lit(0)).alias("n_findings"), F.coalesce("places", F.lit("")).alias("findings"))


def saved_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as states of their users' messages, saved through a stream with timers; of what was saved, the latest."""
    from ..sources.scratch import folder

    root = f"{folder(spark)}/saved-{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "props").select(F.col("user_id").alias("msg_id"), F.col("event_id").cast("int").alias("seq"), F.col("props").alias("content"))
    ends = rows.groupBy(F.col("msg_id").alias("m")).agg(F.max("seq").alias("end"))
    rows = rows.join(ends, F.col("msg_id").eqNullSafe(F.col("m"))).select("msg_id", "seq", "content", (F.col("seq") == F.col("end")).alias("last"))
    rows.write.parquet(f"{root}/states")
    if (none := _none_read(spark, f"{root}/states", A.FLUSHED)) is not None:
        return none.select("msg_id", "content", F.col("seq").cast("long").alias("seq"))
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/states")
    query = A.saved(stream).writeStream.foreachBatch(A.table_sink(f"{root}/saved")).option("checkpointLocation", f"{root}/state").trigger(processingTime="200 milliseconds").start()
    A.drained(query, spark.read.parquet(f"{root}/states").count())
    return Q.latest_state(A.received(spark, f"{root}/saved", A.FLUSHED)).withColumn("seq", F.col("seq").cast("long"))


def quote_event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.citations_first(Q.parsed(_messages(spark, sf_dir)))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.sum("place").alias("places"))


def events_until_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "event_type").select(F.col("user_id").alias("msg_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 9 == 0, "done").otherwise("ping")).otherwise("text").alias("type"))
    return Q.until_done(rows).groupBy("msg_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def latest_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "props").select(F.col("user_id").alias("msg_id"), F.col("event_id").alias("seq"), F.col("props").alias("content"))
    return Q.latest_state(rows)


def tool_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    k = F.col("event_id")
    args = F.when(k % 6 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k % 6 == 1, "no arguments").when(k % 6 == 2, '{"q": 1}').otherwise(F.col("props"))
    calls = rows.select(F.col("user_id").alias("run_id"), k.alias("seq"), F.col("event_type").alias("tool"), args.alias("args"))
    tools = spark.createDataFrame([("click", "k"), ("view", None), ("error", "k")], "tool string, required string")
    return T.dispatched(calls, tools, 60).groupBy("outcome").agg(F.count("*").alias("n"))


def loose_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id", "props")
    k = F.col("event_id")
    told = F.when(k % 3 == 0, F.concat(F.lit("Sure: ```json\n"), "props", F.lit("\n``` done"))).when(k % 3 == 1, F.concat(F.lit("It is "), "props", F.lit(" as asked"))).otherwise("none")
    return rows.select("event_id", F.get_json_object(T.loose_json(told), "$.k").cast("long").alias("k"))


def result_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(T.envelope(F.col("text"), 500)).alias("digest"))


def clean_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_name")
    name = F.when(k % 3 == 0, F.concat(F.lit("C:\\docs\\"), n, F.lit(".pdf"))).when(k % 3 == 1, F.concat(F.lit("/tmp/a/\x07"), n, F.lit("\n.docx "))).otherwise(F.repeat(n, 30))
    return read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", X.clean_filename(name).alias("name"))


def intake_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ("pdf", "docx", "doc", "text", "zip")))
    code = S.intake_error(F.element_at(kinds, (k % 5 + 1).cast("int")), k * 50_000)
    rows = read(spark, sf_dir, "part", "p_partkey").select(code.alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("n")).select("code", S.error_status(F.col("code")).cast("long").alias("status"), "n")


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by first bytes, of contents made from parts."""
    k = F.col("p_partkey")
    head = F.when(k % 5 == 0, "junk%PDF-1.7").when(k % 5 == 1, F.lit("plain text")).otherwise("")
    content = F.when(k % 5 == 2, F.unhex(F.lit("D0CF11E0A1B11AE1"))).when(k % 5 == 3, F.unhex(F.lit("504B030400"))).when(k % 5 == 4, F.unhex(F.lit("010203"))).otherwise(F.encode(F.concat(head, "p_name"), "UTF-8"))
    return read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", S.sniffed(content).alias("kind"))


def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of pages, with offsets."""
    return S.html_text(read(spark, sf_dir, "pages", "page_id", "html"))


def canonical_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.lit("p").alias("tag"), "text")
    return S.canonical(rows).select("doc", "ord", "start", "end", F.md5("html").alias("html"))


def _packed_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations as Word files: each turn a numbered paragraph, an assistant's in a heading style; every ninth file is cut off."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    for batch in batches:
        made = []
        for doc, turns in zip(batch.column("doc").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            paragraph = lambda t: f'<w:p><w:pPr>{"<w:pStyle w:val=%sHead%s/>" % (chr(34), chr(34)) if t["role"] == "assistant" else ""}<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>{escape(t["text"] or "")}</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>'
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="Base"><w:pPr><w:outlineLvl w:val="2"/></w:pPr></w:style><w:style w:styleId="Head"><w:basedOn w:val="Base"/></w:style></w:styles>')
                z.writestr("word/numbering.xml", f'<w:numbering {w}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="2"/><w:numFmt w:val="decimal"/><w:lvlText w:val="(%1)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
                z.writestr("word/document.xml", f'<w:document {w}><w:body>{"".join(map(paragraph, turns))}</w:body></w:document>')
            content = out.getvalue()
            made.append(content if doc % 9 else content[: len(content) // 2])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(made, pa.binary())], ["doc", "content"])


def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rows = S.word_rows(turns.mapInArrow(_packed_word, "doc long, content binary"))
    return rows.select("doc", F.col("ord").cast("long").alias("ord"), F.col("start").cast("long").alias("start"), F.md5("text").alias("digest"), F.col("heading_level").cast("long").alias("heading_level"), "label", "error")


def _packed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations as Word files with lists: levels second, first, second, third in turn, so that the first paragraph has no ancestor; the first level in Roman
    numbers, the second in legal style, the third bullets. Every third file's list starts at 5."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    level = lambda k, form, text, more="": f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{form}"/>{more}<w:lvlText w:val="{text}"/></w:lvl>'
    lists = level(0, "upperRoman", "%1.") + level(1, "lowerLetter", "%1.%2", "<w:isLgl/>") + level(2, "bullet", "\uf0b7")
    numbering = f'<w:numbering {w}><w:abstractNum w:abstractNumId="3">{lists}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="3"/></w:num>'
    numbering += '<w:num w:numId="2"><w:abstractNumId w:val="3"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>'
    for batch in batches:
        made = []
        for doc, n in zip(batch.column("doc").to_pylist(), batch.column("n").to_pylist(), strict=True):
            paragraph = lambda k: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{(1, 0, 1, 2)[k % 4]}"/><w:numId w:val="{1 if doc % 3 else 2}"/></w:numPr></w:pPr></w:p>'  # noqa: E731, B023
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/numbering.xml", numbering)
                z.writestr("word/document.xml", f'<w:document {w}><w:body>{"".join(map(paragraph, range(n)))}</w:body></w:document>')
            made.append(out.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(made, pa.binary())], ["doc", "content"])


def word_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.count("*").cast("int").alias("n"))
    return S.word_rows(sizes.mapInArrow(_packed_lists, "doc long, content binary")).select("doc", F.col("ord").cast("long").alias("ord"), "label")


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from items: order lines as items, two to a visual line."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    rows = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("text"))
    k = F.col("l_linenumber") - 1
    items = rows.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page_no"), k.alias("ord"), "text", ((k % 2) * 0.5).cast("double").alias("x"), (F.floor(k / 2) * 0.1).cast("double").alias("y"), F.lit(0.49).cast("double").alias("w"), F.when(F.col("l_orderkey") % 2 == 0, 0.01).otherwise(0.09).cast("double").alias("h"))
    return S.lines_from_items(items).groupBy("text").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    word_labels, quote_events, quote_events_streamed, sent_answers, escalated_findings, saved_states, quote_event_order, events_until_done, latest_flush, tool_dispatch, loose_json, result_envelopes, clean_filenames, intake_errors, file_kinds, html_lines, canonical_offsets, item_lines, word_rows,
)}

_MESSAGES = """SELECT conv_id * 1000 + turn AS m, k % 7 = 0 AS s, k % 5 = 0 AS broken, substring(t, 1, 40) AS a, CASE WHEN k % 3 = 0 THEN substring(t, 41) ELSE substring(t, 41, 40) END AS q, CASE WHEN k % 3 = 0 THEN '' ELSE substring(t, 81) END AS z
    FROM (SELECT conv_id, turn, conv_id + turn AS k, coalesce(text, '') AS t FROM conversations)"""
_QUOTES = f"SELECT *, CASE WHEN broken THEN q || z ELSE q END AS said, length(CASE WHEN broken THEN q || z ELSE q END) > {QUOTE_LIMIT} AS over FROM ({_MESSAGES})"
_EVENTS = f"""SELECT m, 0 AS o, 'not_found' AS type, NULL AS tag, NULL AS text, NULL AS reason FROM ({_MESSAGES}) WHERE s UNION ALL SELECT m, 1, 'text', NULL, a, NULL FROM ({_MESSAGES}) WHERE a <> '' UNION ALL SELECT m, 2, 'quote_open', 'D2', NULL, NULL FROM ({_MESSAGES})
    UNION ALL SELECT m, 3, CASE WHEN broken OR over THEN 'quote_abandoned' ELSE 'quote' END, 'D2', CASE WHEN over THEN '' ELSE said END, CASE WHEN broken OR over THEN 'truncated' END FROM ({_QUOTES}) UNION ALL SELECT m, 4, 'text', NULL, z, NULL FROM ({_MESSAGES}) WHERE NOT broken AND z <> ''"""
SQL = {
    "quote_events": f"SELECT m AS msg_id, row_number() OVER (PARTITION BY m ORDER BY o) - 1 AS seq, type, tag, text, reason FROM ({_EVENTS})",
    "quote_events_streamed": f"""SELECT m AS msg_id, md5(a || CASE WHEN broken THEN '' ELSE z END) AS text, CASE WHEN s THEN 'not_found,' ELSE '' END || CASE WHEN broken OR over THEN 'quote_open,quote_abandoned' ELSE 'quote_open,quote' END AS events FROM ({_QUOTES})""",
    "sent_answers": f"""SELECT m AS msg_id, md5(CASE WHEN s THEN '' ELSE a || CASE WHEN broken THEN '' ELSE z END END) AS text, CASE WHEN s THEN 'not_found,escalated' WHEN broken OR over THEN 'quote_open,quote_abandoned,done' ELSE 'quote_open,quote,done' END AS events, true AS gapless FROM ({_QUOTES})""",
    "saved_states": "SELECT user_id AS msg_id, arg_max(props, event_id) AS content, max(event_id) AS seq FROM events GROUP BY 1",
    "quote_event_order": f"""WITH e AS (SELECT m, o, type, 0 AS h FROM ({_EVENTS}) WHERE type <> 'quote' UNION ALL SELECT m, o, 'citation', 0 FROM ({_EVENTS}) WHERE type = 'quote' UNION ALL SELECT m, o, 'mark', 1 FROM ({_EVENTS}) WHERE type = 'quote'),
        p AS (SELECT type, row_number() OVER (PARTITION BY m ORDER BY o, h) - 1 AS p FROM e) SELECT type, count(*) AS n, CAST(sum(p) AS BIGINT) AS places FROM p GROUP BY type""",
    "events_until_done": """WITH d AS (SELECT user_id AS m, min(event_id) FILTER (WHERE event_type = 'error' AND event_id % 9 = 0) AS f FROM events GROUP BY 1)
        SELECT m AS msg_id, count(*) AS n, max(event_id) AS last FROM events JOIN d ON m = user_id WHERE f IS NULL OR event_id <= f GROUP BY m""",
    "latest_flush": "SELECT user_id AS msg_id, arg_max(props, event_id) AS content, max(event_id) AS seq FROM events GROUP BY 1",
    "tool_dispatch": """WITH c AS (SELECT user_id AS r, event_id AS k, event_type AS t, CASE event_id % 6 WHEN 1 THEN NULL WHEN 2 THEN '{"q":1}' ELSE replace(props, ' ', '') END AS a FROM events),
        w AS (SELECT *, row_number() OVER (PARTITION BY r, t, coalesce(a, '') ORDER BY k) AS d, row_number() OVER (PARTITION BY r ORDER BY k) AS p FROM c)
        SELECT CASE WHEN p > 60 THEN 'over_cap' WHEN t NOT IN ('click', 'view', 'error') THEN 'unknown_tool' WHEN a IS NULL THEN 'bad_json' WHEN t <> 'view' AND k % 6 = 2 THEN 'missing_argument' WHEN d > 1 THEN 'duplicate' ELSE 'run' END AS outcome, count(*) AS n FROM w GROUP BY 1""",
    "loose_json": """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""",
    "result_envelopes": "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '… [' || (length(text) - 500) || ' more characters]' ELSE text END) AS digest FROM documents",
    "clean_filenames": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '.pdf' WHEN 1 THEN p_name || '.docx' ELSE substring(repeat(p_name, 30), 1, 200) END AS name FROM part",
    "intake_errors": """WITH c AS (SELECT CASE WHEN p_partkey = 0 THEN 'empty_document' WHEN p_partkey * 50000 > 52428800 THEN 'too_large' WHEN p_partkey % 5 = 2 THEN 'legacy_word' WHEN p_partkey % 5 > 2 THEN 'unsupported_type' END AS code FROM part)
        SELECT code, CAST(CASE code WHEN 'empty_document' THEN 400 WHEN 'too_large' THEN 413 WHEN 'legacy_word' THEN 415 WHEN 'unsupported_type' THEN 415 END AS BIGINT) AS status, count(*) AS n FROM c GROUP BY 1, 2""",
    "file_kinds": "SELECT p_partkey, (['pdf', 'text', 'ole', 'zip', 'unknown'])[p_partkey % 5 + 1] AS kind FROM part",
    "canonical_offsets": """WITH c AS (SELECT conv_id AS doc, turn AS ord, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM conversations)
        SELECT doc, ord, s AS start, s + length(text) AS "end", md5('<p data-o="' || s || '">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>') AS html FROM c""",
    "word_rows": """WITH t AS (SELECT conv_id AS doc, coalesce(text, '') AS t, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations)
        SELECT doc, k AS ord, CAST(coalesce(sum(length(t) + 1) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, md5(t) AS digest, CASE WHEN role = 'assistant' THEN 3 END AS heading_level, '(' || (k + 2) || ')' AS label, NULL AS error FROM t WHERE doc % 9 <> 0
        UNION ALL SELECT DISTINCT doc, NULL, NULL, NULL, NULL, NULL, 'damaged' FROM t WHERE doc % 9 = 0""",
    "word_labels": f"""WITH t AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id) - 1 AS k FROM conversations), b AS (SELECT doc, k, k // 4 AS b, CASE WHEN doc % 3 = 0 THEN 5 ELSE 2 END AS s FROM t)
        SELECT doc, k AS ord, CASE k % 4 WHEN 0 THEN (s - 1 + b) || CASE WHEN b = 0 THEN '.1' ELSE '.2' END WHEN 1 THEN ({[S.roman(n).upper() for n in range(1, 121)]})[s + b] || '.' WHEN 2 THEN (s + b) || '.1' ELSE '{S.BULLET}' END AS label FROM b""",
    "item_lines": """WITH i AS (SELECT l_orderkey AS d, l_linenumber AS k, min(l_returnflag || l_linestatus) AS t FROM lineitem GROUP BY 1, 2), g AS (SELECT *, lag(k) OVER (PARTITION BY d ORDER BY k) AS before FROM i),
        f AS (SELECT *, CASE WHEN before = k - 1 AND k % 2 = 0 THEN 0 ELSE 1 END AS fresh FROM g), l AS (SELECT *, sum(fresh) OVER (PARTITION BY d ORDER BY k) AS line FROM f), j AS (SELECT d, line, string_agg(CASE WHEN fresh = 0 AND d % 2 = 0 THEN ' ' || t ELSE t END, '' ORDER BY k) AS text FROM l GROUP BY 1, 2)
        SELECT text, count(*) AS n FROM j GROUP BY text""",
}
