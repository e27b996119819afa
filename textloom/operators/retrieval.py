"""Keyword retrieval: postings, ranked legs, fusion, budgeted choice, outlines, question routing.

chunks are rows (doc, ord, text, tokens); questions rows (question_id, text). Every ranking ends in (doc, ord), so no tie is left
to chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed values of routing and fusion.
RRF_K, LEG_LIMIT, PHRASE_LIMIT, FUSED_LIMIT, NEARLY = 60, 20, 10, 60, 0.97
OVERVIEW_WORDS = ("summary", "summarize", "summarise", "overview", "highlight", "highlights", "important", "key", "main", "gist", "outline", "essentials", "basics", "parties")
FILLER = (
    "the a an and or of to in for on by with is are was were be been this that these those what which who how does do did can could should would may might must shall will there it its as at from into "
    "about any all me my i you your we our us please tell give show explain describe know want need help hi hello hey thanks thank ok okay more some something anything thing things stuff document documents "
    "contract contracts agreement agreements doc file pdf word overall briefly quick quickly short points terms parts bits whats dont doesnt isnt lets"
).split()
OVERVIEW = (
    r"(?i)\b(summar(y|ise|ize)|overview|outline|gist|tl;?dr|highlights?|important|key (terms|points|provisions|clauses|things)|main (terms|points|provisions|things)|red flags|"
    r"what (is|'s) (this|it|the (document|contract|agreement))( about)?|what does (this|it|the (document|contract|agreement)) (do|cover|say)( overall)?|tell me (abou?t?|more)|(who|what) (are|is) the parties|"
    r"explain (this|it|the (document|contract|agreement)))\b"
)
EXHAUSTIVE = r"(?i)\b(is there|are there|does (it|the \w+) (contain|include|have|mention|say anything)|any\b|all\b|every|each|list|how many|whether|anywhere|at all)\b"


def question_terms(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.explode(X.search_terms(F.col("text"))).alias("term"))


def postings(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc, ord, term, tf) of words of three ASCII letters or digits and more, stopwords left out. With terms (term), only
    theirs: other words are dropped before anything is shuffled. What is left is dealt by document, so that counts of a chunk, here and in the legs, need no
    other shuffle; into all shuffle partitions, as few bytes of postings become many rows in a task's memory."""
    rows = chunks.select("doc", "ord", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), 0)).alias("term"))
    rows = rows.where(~F.col("term").isin(*X.STOPWORDS))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc")
    return rows.groupBy("doc", "ord", "term").agg(F.count("*").alias("tf"))


def _ranked(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("rank") <= limit)


def keyword_leg(index: DataFrame, questions: DataFrame, limit: int = LEG_LIMIT) -> DataFrame:
    """(question_id, doc, ord, rank): chunks by distinct terms matched, then by their occurrences."""
    hits = index.join(question_terms(questions), "term").groupBy("question_id", "doc", "ord").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf"))
    return _ranked(hits, [F.col("matched").desc(), F.col("tf").desc(), F.col("doc"), F.col("ord")], limit).select("question_id", "doc", "ord", "rank")


def precise_leg(index: DataFrame, questions: DataFrame, limit: int = LEG_LIMIT) -> DataFrame:
    """Chunks that have all terms of the question."""
    terms = questions.select("question_id", X.search_terms(F.col("text")).alias("terms"))
    hits = index.join(terms.select("question_id", F.size("terms").alias("n"), F.explode("terms").alias("term")), "term")
    hits = hits.groupBy("question_id", "doc", "ord", "n").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf")).where("matched = n")
    return _ranked(hits, [F.col("tf").desc(), F.col("doc"), F.col("ord")], limit).select("question_id", "doc", "ord", "rank")


def filled(first: DataFrame, then: DataFrame, limit: int = LEG_LIMIT) -> DataFrame:
    """The first leg, filled up from the second without repeating a chunk."""
    return filled_legs(first.withColumn("leg", F.lit(0)).unionByName(then.withColumn("leg", F.lit(1))), limit)


def filled_legs(both: DataFrame, limit: int = LEG_LIMIT) -> DataFrame:
    """``filled`` of legs in one frame (question_id, leg, doc, ord, rank)."""
    best = both.groupBy("question_id", "doc", "ord").agg(F.min(F.struct("leg", "rank")).alias("at"))
    return _ranked(best, [F.col("at")], limit).select("question_id", "doc", "ord", "rank")


def phrase_leg(chunks: DataFrame, phrases: DataFrame, limit: int = PHRASE_LIMIT) -> DataFrame:
    """Chunks that hold a phrase (question_id, phrase) letter by letter in any case, in text order. The equality key is the phrase's first word
    (of three letters or more) that something else of the phrase stands before and behind: a text may cut words at the phrase's ends short, but not that one. For phrases without one it is the words between blanks that hold the
    phrase's longest piece between blanks: these are looked up among the distinct words of all chunks, so that only those are cut into runs of
    characters. Phrases of under three characters, or of blanks, find nothing."""
    words = F.regexp_extract_all(F.lower("phrase"), F.lit("(?<=[^a-z0-9])[a-z0-9]{3,}(?=[^a-z0-9])"), 0)
    keyed = phrases.withColumn("low", F.lower("phrase")).withColumn("word", F.get(words, F.lit(0)))
    body = chunks.select("doc", "ord", F.lower("text").alias("body"))
    # Keys are exploded without the texts; those where a key was met are read again.
    at = body.select("doc", "ord", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("[a-z0-9]{3,}"), 0))).alias("key"))
    met = at.join(keyed.where("word is not null").select(F.col("word").alias("key"), "question_id", "low"), "key")
    longest = F.expr("aggregate(split(low, ' '), '', (a, x) -> if(length(x) > length(a), x, a))")
    short = keyed.where("word is null and length(low) >= 3").select("question_id", "low", longest.alias("piece")).where("piece <> ''").withColumn("key", F.substring("piece", 1, 3))
    parts = body.select("doc", "ord", F.explode(F.array_distinct(F.split("body", " "))).alias("part"))
    runs = F.array_distinct(F.expr("flatten(transform(sequence(1, length(part)), i -> transform(sequence(1, 3), n -> substring(part, i, n))))"))
    holding = parts.select("part").distinct().where("part <> ''").select("part", F.explode(runs).alias("key")).join(short, "key").where(F.contains("part", "piece")).select("part", "question_id", "low").distinct()
    met = met.select("doc", "ord", "question_id", "low").unionByName(parts.join(holding, "part").select("doc", "ord", "question_id", "low")).distinct()
    rows = met.join(body, ["doc", "ord"]).where(F.contains("body", "low")).select("question_id", "doc", "ord").distinct()
    return _ranked(rows, [F.col("doc"), F.col("ord")], limit)


def section_leg(chunks: DataFrame, sections: DataFrame, refs: DataFrame, per_section: int = 6, most_sections: int = 6) -> DataFrame:
    """Chunks (doc, ord, start, end) that overlap sections named by a question (question_id, doc, number) or their children."""
    from . import ranges as R

    base = refs.withColumn("key", F.col("number"))
    named = sections.withColumn("prefixes", F.transform(F.sequence(F.lit(1), F.size(F.split("number", r"\."))), lambda i: F.array_join(F.slice(F.split("number", r"\."), F.lit(1), i), ".")))
    named = named.select("doc", F.col("ord").alias("section"), "start", "end", F.explode("prefixes").alias("key"))
    hit = named.join(base.select("question_id", "doc", "key"), ["doc", "key"]).select("question_id", "doc", "section", "start", "end").distinct()
    hit = hit.withColumn("k", F.row_number().over(Window.partitionBy("question_id", "doc").orderBy("section"))).where(F.col("k") <= most_sections)
    rows = R.overlap_join(hit.select("question_id", "doc", "section", "start", "end"), chunks.select("doc", "ord", "start", "end"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("question_id", "doc", "section").orderBy("r_ord"))).where(F.col("k") <= per_section)
    first = rows.groupBy("question_id", "doc", F.col("r_ord").alias("ord")).agg(F.min(F.struct("section", "k")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("doc", "at"))).drop("at")


def fused(legs: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """(question_id, doc, ord, score, rank): reciprocal rank fusion; equal scores by the first leg and rank seen."""
    rows = None
    for n, (leg, weight) in enumerate(legs):
        part = leg.select("question_id", "doc", "ord", (F.lit(weight) / (F.lit(float(k)) + F.col("rank"))).alias("s"), F.struct(F.lit(n).alias("leg"), F.col("rank")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("question_id", "doc", "ord").agg(F.round(F.sum("s"), 9).alias("score"), F.min("at").alias("at"))
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "at", "doc", "ord")
    return best.select("question_id", "doc", "ord", "score", F.row_number().over(w).alias("rank"))


def within_budget(ranked: DataFrame, tokens: DataFrame, budget: int, limit: int | None = FUSED_LIMIT, nearly: float | None = NEARLY) -> DataFrame:
    """(question_id, doc, ord, tokens, place): in rank order what still fits is taken, what does not is passed over. Choosing ends at ``nearly``
    of the budget, or, with None, goes on to the last rank. One fold over a question's ranks, at most ``limit`` of them unless that is None."""
    rows = (ranked if limit is None else ranked.where(F.col("rank") <= limit)).join(tokens.select("doc", "ord", "tokens"), ["doc", "ord"])
    rows = rows.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc", "ord", "tokens"))).alias("r"))
    over = "false" if nearly is None else f"a.used + x.tokens >= {budget} * {nearly}"
    fold = f"""
        aggregate(r, named_struct('used', 0L, 'over', false, 'kept', cast(array() as array<int>)), (a, x) -> if(
            a.over or a.used + x.tokens > {budget}, a,
            named_struct('used', a.used + x.tokens, 'over', {over}, 'kept', array_append(a.kept, x.rank))), a -> a.kept)
    """
    rows = rows.select("question_id", "r", F.expr(fold).alias("kept")).select("question_id", F.posexplode(F.expr("filter(r, x -> array_contains(kept, x.rank))")).alias("place", "x"))
    return rows.select("question_id", "x.doc", "x.ord", "x.tokens", "place")


def with_neighbours(chosen: DataFrame, chunks: DataFrame, top: int = 3, budget: int | None = None) -> DataFrame:
    """(question_id, doc, ord): the chosen chunks and those before and after the first ``top``, where they exist. With a budget of tokens
    (chosen and chunks then have tokens) a neighbour comes only if there is room left, those of better places first."""
    sides = F.array(F.col("ord") - 1, F.col("ord") + 1)
    near = chosen.where(F.col("place") < top).select("question_id", "doc", "place", F.posexplode(sides).alias("side", "ord"))
    near = near.groupBy("question_id", "doc", "ord").agg(F.min(F.struct("place", "side")).alias("at"))
    near = near.join(chosen.select("question_id", "doc", "ord"), ["question_id", "doc", "ord"], "left_anti")
    if budget is None:
        near = near.join(chunks.select("doc", "ord"), ["doc", "ord"], "left_semi")
        return chosen.select("question_id", "doc", "ord").unionByName(near.select("question_id", "doc", "ord"))
    used = chosen.groupBy("question_id").agg(F.sum("tokens").alias("used"))
    near = near.join(chunks.select("doc", "ord", "tokens"), ["doc", "ord"]).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("at", "doc", "ord", "tokens"))).alias("n"))
    fold = f"""
        aggregate(n, named_struct('used', used, 'kept', cast(array() as array<struct<doc:bigint,ord:bigint>>)), (a, x) -> if(
            a.used + x.tokens > {budget}, a, named_struct('used', a.used + x.tokens, 'kept', array_append(a.kept, named_struct('doc', cast(x.doc as bigint), 'ord', cast(x.ord as bigint))))), a -> a.kept)
    """
    near = near.join(used, "question_id").select("question_id", F.explode(F.expr(fold)).alias("x")).select("question_id", "x.doc", "x.ord")
    return chosen.select("question_id", "doc", "ord").unionByName(near)


def excerpts(chosen: DataFrame, chunks: DataFrame, docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(question_id, doc, place, start, end, heading, text, percent): chosen chunks (question_id, doc, ord) in text order, those that touch or overlap merged,
    each under the section that holds its start; percent of the document that a question's excerpts are, one at least.

    chunks (doc, ord, start, end), docs (doc, text), sections (doc, start, end, level, ord, number, title).
    """
    from . import ranges as R

    spans = chosen.select("question_id", "doc", "ord").join(chunks.select("doc", "ord", "start", "end"), ["doc", "ord"])
    merged = R.merge(spans.select(F.struct("question_id", F.col("doc").alias("d")).alias("doc"), "start", "end")).select("doc.question_id", F.col("doc.d").alias("doc"), "start", "end")
    place = F.row_number().over(Window.partitionBy("question_id", "doc").orderBy("start"))
    rows = merged.withColumn("place", place)
    points = rows.select("doc", F.struct("question_id", "place").alias("id"), F.col("start").alias("pos"))
    inner = R.containing(points, sections.select("doc", "start", "end", "level", "ord", "number", "title"))
    label = F.when(F.col("number").isNotNull(), F.concat_ws(" ", F.concat(F.lit("§"), "number"), "title")).otherwise(F.col("title"))
    inner = inner.groupBy("doc", "id").agg(F.max_by(label, F.struct("level", "ord")).alias("label")).select("doc", "id.question_id", "id.place", "label")
    shown = rows.groupBy("question_id", "doc").agg(F.sum(F.col("end") - F.col("start")).alias("shown"))
    rows = rows.join(inner, ["doc", "question_id", "place"], "left").join(shown, ["question_id", "doc"]).join(docs.select("doc", F.col("text").alias("body")), "doc")
    percent = F.greatest(F.lit(1), F.round(100 * F.col("shown") / F.greatest(F.lit(1), F.length("body")))).cast("long")
    body = F.substring("body", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    heading = F.coalesce(F.concat(F.lit("── "), "label", F.lit(" ──")), F.lit("──"))
    from .scan import clean_slice

    return rows.select("question_id", "doc", "place", "start", "end", heading.alias("heading"), clean_slice(body).alias("text"), percent.alias("percent"))


def outline(sections: DataFrame, budget: int) -> DataFrame:
    """(doc, levels, hidden, outline): sections' numbers and titles, indented; the deepest levels are left out until it fits
    the token budget, and the text says how many are not shown. At level 1 lines are cut instead."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.when(F.col("number").isNotNull(), F.concat("number", F.lit(" "))).otherwise(""), F.col("title"))
    rows = sections.where("title <> 'Preamble'").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("ord", "level", line.alias("line")))).alias("s"))
    fits = f"""
        array_max(filter(sequence(1, 6), m -> m = 1 or ceil(length(array_join(transform(filter(s, x -> x.level <= m), x -> x.line), '\\n')) / 4) <= {budget}))
    """
    rows = rows.select("doc", "s", F.expr(fits).alias("levels")).select("doc", "levels", F.expr("size(s)").alias("n"), F.expr("transform(filter(s, x -> x.level <= levels), x -> x.line)").alias("lines"))
    cut = f"""
        aggregate(lines, named_struct('used', 0L, 'kept', cast(array() as array<string>), 'done', false), (a, l) -> if(
            a.done or a.used + ceil(length(l) / 4) + 1 > {budget}, named_struct('used', a.used, 'kept', a.kept, 'done', true),
            named_struct('used', a.used + ceil(length(l) / 4) + 1, 'kept', array_append(a.kept, l), 'done', false)), a -> a.kept)
    """
    long = F.ceil(F.length(F.array_join("lines", "\n")) / 4) > budget
    shown = F.when(long, F.expr(cut)).otherwise(F.col("lines"))
    return rows.select("doc", "levels", (F.col("n") - F.size(shown)).alias("hidden"), F.array_join(shown, "\n").alias("outline"))


def content_words(question: Column) -> Column:
    joined = F.regexp_replace(F.lower(question), r"([a-z])[^a-z0-9\s]+([a-z])", "$1$2")
    return F.filter(F.regexp_extract_all(joined, F.lit("[a-z0-9]{3,}"), 0), lambda w: ~w.isin(*FILLER))


def overview_word(word: Column) -> Column:
    """An overview word, or a slip away from one: two edits for words of eight letters and more, else one."""
    near = [(word == k) | ((F.length(word) >= 5) & (F.levenshtein(word, F.lit(k)) <= (2 if len(k) >= 8 else 1))) for k in OVERVIEW_WORDS]
    out = near[0]
    for n in near[1:]:
        out = out | n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word) of three letters and more of all texts."""
    return docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0))).alias("word")).distinct()


def _pieces(word: Column) -> Column:
    """The word in three pieces of about equal length, as (number of the piece, where it starts, text)."""
    n = F.length(word)
    cut = lambda k: F.floor(n * k / 3).cast("int")
    piece = lambda k: F.struct(F.lit(k).alias("k"), cut(k).alias("at"), F.substring(word, cut(k) + 1, cut(k + 1) - cut(k)).alias("text"))
    return F.array(*[piece(k) for k in range(3)])


def _runs(word: Column) -> Column:
    """All runs of letters of a word that may be one of the three pieces of another within two edits: (text, where it starts)."""
    n = F.length(word)
    # Pieces of words of length n - 2 to n + 2 are of floor((n - 2) / 3) to ceil((n + 2) / 3) letters.
    widths = F.sequence(F.greatest(F.lit(1), F.floor((n - 2) / 3).cast("int")), F.ceil((n + 2) / 3).cast("int"))
    every = F.transform(widths, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(n - w, F.lit(0))), lambda i: F.struct(i.alias("at"), F.substring(word, i + 1, w).alias("text"))))
    return F.array_distinct(F.flatten(every))


def specific_words(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, specific): a word of the vocabulary narrows a search; so does one far from it; a short unknown word or a slip
    (one edit, two from seven letters on) does not. Two edits leave one of a word's three pieces as it is, moved by two letters at most: slips
    meet their word over such a piece, an equality join that adds three rows for each word of the vocabulary, and are then measured."""
    words = words.select("word").distinct()
    known = words.join(vocab, "word", "left_semi").withColumn("specific", F.lit(True))
    unknown = words.join(vocab, "word", "left_anti")
    asked = unknown.where(F.length("word") >= 4).select("word", F.when(F.length("word") >= 7, 2).otherwise(1).alias("k"), F.explode(_runs(F.col("word"))).alias("r"))
    held = vocab.select(F.col("word").alias("near"), F.explode(_pieces(F.col("word"))).alias("p")).select("near", F.col("p.at").alias("from"), F.col("p.text").alias("piece"))
    met = asked.select("word", "k", F.col("r.at").alias("at"), F.col("r.text").alias("piece")).join(held, "piece").where((F.abs(F.col("at") - F.col("from")) <= F.col("k")) & (F.abs(F.length("word") - F.length("near")) <= F.col("k")))
    slips = met.where(F.levenshtein("word", "near") <= F.col("k")).select("word").distinct()
    rest = unknown.join(slips.withColumn("slip", F.lit(True)), "word", "left").select("word", (F.col("slip").isNull() & (F.length("word") >= 4)).alias("specific"))
    return known.unionByName(rest)


def overview_questions(questions: DataFrame, specific: DataFrame) -> DataFrame:
    """(question_id, overview): asks for the whole rather than for something that could be searched."""
    rows = questions.withColumn("words", content_words(F.col("text")))
    each = rows.select("question_id", F.explode("words").alias("word")).join(specific, "word", "left")
    each = each.groupBy("question_id").agg(F.bool_or(overview_word(F.col("word"))).alias("asks"), F.count_if(~overview_word(F.col("word")) & F.coalesce("specific", F.lit(True))).alias("n_specific"), F.bool_or(F.coalesce("specific", F.lit(True))).alias("any"))
    rows = rows.join(each, "question_id", "left")
    n = F.size("words")
    wide = (n == 0) | ((F.col("text").rlike(OVERVIEW) | F.coalesce("asks", F.lit(False))) & (F.col("n_specific") == 0)) | ((n == 1) & ~F.coalesce("any", F.lit(True)))
    return rows.select("question_id", (~F.col("text").rlike(r"(?i)(clause|section|article|§)\s*\d") & F.coalesce(wide, F.lit(False))).alias("overview"))


def places_of(texts: DataFrame, needle: str, most: int = 15, around: int = 120) -> DataFrame:
    """(doc, n, place, start, context): the first ``most`` places of a needle in spaced texts (doc, text), with what stands around; n counts up to 1000."""
    rows = texts.select("doc", "text", F.split("text", f"(?={re_quoted(needle)})").alias("parts"))
    ends = F.expr("transform(sequence(1, least(size(parts), 16)), k -> aggregate(slice(parts, 1, k), 0, (a, x) -> a + length(x)))")
    rows = rows.select("doc", "text", F.least(F.lit(1000), F.size(F.filter("parts", lambda x: x.startswith(needle)))).alias("n"), F.concat(F.array(F.lit(0)), ends).alias("at"), "parts")
    starts = F.slice(F.filter(F.transform(F.slice("parts", 1, most + 1), lambda x, k: F.when(x.startswith(needle), F.get(F.col("at"), k))), lambda x: x.isNotNull()), 1, most)
    rows = rows.select("doc", "text", "n", F.posexplode(starts).alias("place", "start"))
    lo = F.greatest(F.lit(0), F.col("start") - around)
    return rows.select("doc", "n", "place", "start", F.substring("text", lo + 1, F.col("start") + len(needle) + around - lo).alias("context"))


def re_quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "") + "\\E"


def did_you_mean(asked: DataFrame, sections: DataFrame, limit: int = 3) -> DataFrame:
    """(ask_id, number, title, place): up to three sections of the asked document, those whose title holds the query first, then by edits from
    their number, half an edit less for the same leading number. asked: (ask_id, doc, query)."""
    rows = asked.join(sections.where("number is not null"), "doc")
    inside = F.contains(F.lower("title"), F.lower("query"))
    same = F.substring_index("number", ".", 1) == F.substring_index("query", ".", 1)
    rows = rows.withColumn("far", F.levenshtein("number", "query") - F.when(same, 0.5).otherwise(0.0))
    w = Window.partitionBy("ask_id").orderBy(inside.desc(), "far", "ord")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("ask_id", "number", "title", "place")


def answer_mode(fits: Column, overview: Column, exhaustive: Column, n_hits: Column, not_found: Column) -> Column:
    """How a question is answered: everything if it fits, else an overview, a scan, or excerpts; nothing found leads to a scan."""
    return F.when(fits, "full").when(overview, "overview").when(exhaustive, "scan").when((n_hits == 0) | not_found, "scan").otherwise("excerpts")
