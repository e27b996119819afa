"""Queries that SQL cannot express, on whole small tables against plain Python."""

import json
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from textloom.functions import matching as M
from textloom.operators import compare as G
from textloom.operators import retrieval as R
from textloom.operators import scan as N
from textloom.operators import structure as S
from textloom.plans import compare_queries, registry, verification_queries

TESTED = set()


def query(name):
    TESTED.add(name)
    return registry.QUERIES[name]


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect() if r["text"] is not None}


def parts_of(text):
    """Starts of parts: line starts 2000 characters or more after the last."""
    at, out = 0, [0]
    for line in text.split("\n"):
        if at - out[-1] >= 2000:
            out.append(at)
        at += len(line) + 1
    return out


def test_html_lines(spark, small):
    rows = query("html_lines")(spark, small).collect()
    by_page = defaultdict(list)
    for r in rows:
        by_page[r["page_id"]].append(r)
    source = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert set(by_page) <= set(source) and len(by_page) >= 0.9 * len(source)
    for page, own in by_page.items():
        own.sort(key=lambda r: r["ord"])
        whole = "\n".join(r["text"] for r in own)
        assert all(whole[r["start"] : r["end"]] == r["text"] for r in own)
        # Every word that stands between tags of the article is there, in order.
        article = re.sub(r"<[^>]*>", " ", source[page].split("<article>")[1].split("</article>")[0]).replace("&amp;", "&")
        words = re.sub(r"\s+", " ", whole)
        assert all(w in words for w in article.split()[:50])


def test_chunks_windows_and_overviews(spark, small, texts):
    chunks = defaultdict(list)
    for r in query("document_chunks")(spark, small).collect():
        chunks[r["doc"]].append(r)
    assert set(chunks) == {d for d, t in texts.items() if t.strip()}
    for doc, own in chunks.items():
        own.sort(key=lambda r: r["ord"])
        text, starts = texts[doc], parts_of(texts[doc])
        assert [r["ord"] for r in own] == list(range(len(own)))
        covered = 0
        for r in own:
            part = max(k for k, s in enumerate(starts) if s <= r["start"])
            end = [*starts[1:], len(text)][part]
            assert r["section_ord"] == part and r["end"] <= end and r["tokens"] <= S.CHUNK_TOKENS
            assert r["text"] == text[r["start"] : r["end"]].strip() and r["search_text"] == f"Part {part + 1} — {r['text']}"
            # Nothing but blanks is left out; what two chunks share is about the overlap.
            assert not text[covered : r["start"]].strip() and covered - r["start"] <= S.OVERLAP_TOKENS * 4 + 1
            covered = r["end"]
        assert not text[covered:].strip()
    windows = defaultdict(list)
    for r in query("scan_windows")(spark, small).collect():
        windows[r["doc"]].append((r["start"], r["end"]))
    for doc, own in chunks.items():
        want, i = [], 0
        while i < len(own):
            j, used = i, 0
            while j < len(own) and (j == i or used + own[j]["tokens"] <= 1500):
                used += own[j]["tokens"]
                j += 1
            want.append((0 if i == 0 else own[i]["start"], len(texts[doc]) if j == len(own) else own[j - 1]["end"]))
            if j == len(own):
                break
            i = max(i + 1, j - 1)
        assert sorted(windows[doc]) == want, doc
    shown = defaultdict(list)
    for r in query("overviews")(spark, small).collect():
        shown[r["doc"]].append((r["start"], r["end"], r["percent"]))
    for doc, own in shown.items():
        own.sort()
        assert own[0][0] == 0 and own[0][1] >= min(1200, len(texts[doc])) and all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False))
        assert {p for _, _, p in own} == {max(1, int(100 * sum(e - s for s, e, _ in own) / len(texts[doc]) + 0.5))}
        # The first lines of the first part are in it.
        assert any(s <= 0 and e >= min(350, len(texts[doc])) for s, e, _ in own)


def test_outlines(spark, small):
    sections = defaultdict(list)
    tree = registry.QUERIES["section_tree"](spark, small).collect()
    numbers = {(r["doc"], r["k"]): r["number"] for r in heads(spark, small)}
    for r in sorted(tree, key=lambda r: (r["doc"], r["ord"])):
        number = numbers[r["doc"], r["ord"]]
        sections[r["doc"]].append((r["level"], "  " * (r["level"] - 1) + (f"{number} " if number is not None else "") + r["title"]))
    import hashlib

    for r in query("outlines")(spark, small).collect():
        own = sections[r["doc"]]
        fits = [m for m in range(1, 7) if m == 1 or -(-len("\n".join(t for v, t in own if v <= m)) // 4) <= 110]
        lines = [t for v, t in own if v <= max(fits)]
        if -(-len("\n".join(lines)) // 4) > 110:
            used, kept = 0, []
            for line in lines:
                used += -(-len(line) // 4) + 1
                if used > 110:
                    break
                kept.append(line)
            lines = kept
        assert (r["levels"], r["hidden"], r["digest"]) == (max(fits), len(own) - len(lines), hashlib.md5("\n".join(lines).encode()).hexdigest())


def heads(spark, small):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from textloom.plans.structure_queries import _numbered_lines

    rows = S.headings(_numbered_lines(spark, small))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("start")) - 1).collect()


def test_word_headings(spark, small):
    from textloom.plans.structure_queries import _numbered_lines

    lines = {(r["doc"], r["ord"]): r["text"] for r in _numbered_lines(spark, small).collect()}
    plain = {(r["doc"], r["ord"]): r for r in heads(spark, small)}
    got = {(r["doc"], r["ord"]): r for r in query("word_headings")(spark, small).collect()}
    for key, text in lines.items():
        k, label = key[1], None
        if k % 3 == 0:
            label = f"{k % 4 + 1}.{k % 5}."
        elif k % 11 == 1:
            label = "(a)"
        level = k % 3 + 1 if k % 7 == 0 else None
        if k % 13 == 5:
            want = False
        elif label is not None:
            want = label != "(a)"
        elif level is not None:
            want = True
        else:
            own = plain.get(key)
            want = own is not None and (own["kind"] == "caps" or len(text.split()) <= 15 or k % 2 == 0)
        assert (key in got) == want, (key, text)
        if key in got and label not in (None, "(a)"):
            assert got[key]["number"] == label.rstrip(".") and got[key]["level"] == 2
            assert k % 2 or got[key]["title"] == "Bold words"
        elif key in got and level is not None:
            assert got[key]["level"] == level


def test_quotes_through_all_tiers(spark, small, texts):
    rows = query("quote_tiers")(spark, small).collect()
    asked = {r["quote_id"]: r for r in verification_queries._mutated(spark, small).collect()}
    docs = {d: M.Document(texts[d]) for d in {r["doc_id"] for r in rows}}
    assert {r["quote_id"] for r in rows} == set(asked)
    for r in rows:
        v = M.verify(docs[r["doc_id"]], asked[r["quote_id"]]["text"])
        assert (r["status"], r["method"], r["n_found"], r["start"]) == (v.status, v.method, len(v.occurrences), v.occurrences[0][0] if v.occurrences else None)
    kinds = defaultdict(Counter)
    for r in rows:
        kinds[r["quote_id"].split(":")[0]][r["status"]] += 1
    assert set(kinds["same"]) == set(kinds["spacing"]) == set(kinds["elided"]) == {"verified"} and set(kinds["changed"]) == {"unverified"}


def test_attribution(spark, small, texts):
    rows = query("attributed_quotes")(spark, small).collect()
    found = {(r["item_id"], r["doc_id"]) for r in registry.QUERIES["verified_passages"](spark, small).collect()}
    told = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    assert {r["quote_id"] for r in rows} == {i for i, _ in found}
    for r in rows:
        if r["status"] == "verified":
            assert M.verify(M.Document(texts[r["doc_id"]]), told[r["quote_id"]]).status == "verified"
        if r["status"] == "misattributed":
            assert r["found_in"] != r["doc_id"] and M.exists_exactly(M.Document(texts[r["found_in"]]), told[r["quote_id"]])
            assert r["doc_id"] not in texts or not M.exists_exactly(M.Document(texts[r["doc_id"]]), told[r["quote_id"]])
    assert {"verified"} <= {r["status"] for r in rows}


def test_recovered_citations(spark, small, texts):
    want = {}
    for d, t in texts.items():
        answer = "So “" + t[10:90] + "” it is, not “these are five other words”."
        for pos, m in enumerate(re.finditer("[“\"]([^“”\"]{25,800})[”\"]", answer)):
            if len(m.group(1).split()) >= 5 and (v := M.verify(M.Document(t), m.group(1))).status != "unverified":
                want[d, pos] = (v.status, v.method)
    got = {(r["answer_id"], r["pos"]): (r["status"], r["method"]) for r in query("recovered_citations")(spark, small).collect()}
    assert got == want and len(want) > 20


def test_boxes(spark, small, texts):
    rows = {r["doc"]: r for r in query("highlight_boxes")(spark, small).collect()}
    assert set(rows) == {d for d, t in texts.items() if len(t) > 200}
    for doc, r in rows.items():
        lo, hi = doc % 50, doc % 50 + 45
        by_line = defaultdict(list)
        for i in range(12):
            a, b = max(lo, i * 10), min(hi, i * 10 + 9)
            if a < b:
                by_line[i // 4].append((0.1 + i % 4 * 0.2 + 0.195 / 9 * (a - i * 10), 0.195 / 9 * (b - a)))
        want = []
        for line, spans in sorted(by_line.items()):
            x, right = min(s[0] for s in spans), max(s[0] + s[1] for s in spans)
            ar = 800 / 600
            want.append((x - 0.15 * 0.02 * ar, 0.1 + line * 0.05 - 0.15 * 0.02, right - x + 0.3 * 0.02 * ar, 0.02 * 1.3))
        rects = json.loads(r["rects"])
        assert len(rects) == len(want) == r["n_rects"]
        for got, w in zip(rects, want, strict=True):
            assert all(abs(got[k] - v) < 2e-4 for k, v in zip("xywh", w, strict=True)), (doc, got, w)


def test_scans_find_what_the_extractor_gives(spark, small, texts):
    windows = defaultdict(list)
    for r in registry.QUERIES["scan_windows"](spark, small).collect():
        windows[r["doc"]].append((r["start"], r["end"]))
    items = [r["text"] for r in sorted(spark.read.parquet(f"{small}/benchmark.parquet").collect(), key=lambda r: r["item_id"])]
    for r in query("scan_findings")(spark, small).collect():
        question, text = items[r["doc"] % len(items)][:60], texts[r["doc"]]
        quotes = [q for s, e in sorted(windows[r["doc"]]) for q in N.sentence_picker(question, text[s:e])[: N.MOST_FINDINGS]]
        verdicts = [M.verify(M.Document(text), q) for q in quotes]
        places = {v.occurrences[v.primary] for v in verdicts if v.status != "unverified"}
        assert (r["n_windows"], r["n_failed"], r["n_discarded"], r["n_findings"]) == (len(windows[r["doc"]]), 0, sum(v.status == "unverified" for v in verdicts), len(places))


@pytest.fixture(scope="module")
def versions(spark, small):
    """Units of each document by position, and the pairs."""
    from textloom.plans.structure_queries import text_lines

    units = defaultdict(dict)
    for r in G.paragraph_units(text_lines(spark, small)).collect():
        units[r["doc"]][r["idx"]] = r
    return units, [(r["a"], r["b"]) for r in registry.QUERIES["version_pairs"](spark, small).collect()]


def test_alignment_and_what_is_made_of_it(spark, small, versions):
    units, pairs = versions
    rows = defaultdict(list)
    for r in query("unit_alignment")(spark, small).collect():
        rows[r["a"], r["b"]].append(r)
    assert set(rows) == {p for p in pairs if units[p[0]] or units[p[1]]}
    counts = defaultdict(Counter)
    for (a, b), own in rows.items():
        # Every unit is in exactly one row, and the right document's order is kept.
        assert sorted(r["a_idx"] for r in own if r["a_idx"] is not None) == sorted(units[a]) and sorted(r["b_idx"] for r in own if r["b_idx"] is not None) == sorted(units[b])
        own.sort(key=lambda r: r["place"])
        assert [r["b_idx"] for r in own if r["b_idx"] is not None] == sorted(units[b])
        for r in own:
            x, y = units[a].get(r["a_idx"]), units[b].get(r["b_idx"])
            assert (x is None) == (r["type"] == "added") and (y is None) == (r["type"] == "removed")
            if x and y:
                assert r["text_changed"] == (x["spaced"] != y["spaced"]) and (r["type"] != "unchanged" or not r["text_changed"])
                assert x["compact"] == y["compact"] or G._likeness(G._Unit(x.asDict()), G._Unit(y.asDict())) >= G.MATCH_FLOOR
            counts[b][r["type"]] += 1
        # As many equal texts as the two multisets share are put together.
        same = Counter(u["compact"] for u in units[a].values()) & Counter(u["compact"] for u in units[b].values())
        assert sum(same.values()) <= sum(1 for r in own if r["a_idx"] is not None and r["b_idx"] is not None and units[a][r["a_idx"]]["compact"] == units[b][r["b_idx"]]["compact"])
    for r in query("change_counts")(spark, small).collect():
        assert {t: r[t] for t in ("modified", "added", "removed", "moved", "unchanged")} == {t: counts[r["b"]][t] for t in ("modified", "added", "removed", "moved", "unchanged")}
        assert sum(r[s] for s in G.SEVERITIES) == sum(n for t, n in counts[r["b"]].items() if t != "unchanged")
    for r in query("unit_similarity")(spark, small).collect():
        x, y = units[r["a"]].get(r["a_idx"]), units[r["b"]].get(r["b_idx"])
        if x is None or y is None:
            assert r["similarity"] is None
        else:
            assert abs(r["similarity"] - G._likeness(G._Unit(x.asDict()), G._Unit(y.asDict()))) < 2e-6
    red = {(r["a"], r["b"], r["b_idx"]): r for r in query("word_redlines")(spark, small).collect()}
    modified = {(a, b, r["b_idx"]): r for (a, b), own in rows.items() for r in own if r["type"] == "modified"}
    assert set(red) == set(modified)
    for (a, b, j), r in list(red.items())[:200]:
        before, after = units[a][modified[a, b, j]["a_idx"]]["text"], units[b][j]["text"]
        hunks = G.redline(before, after)
        assert "".join(t for op, t in hunks if op != "del") == after and len(hunks) == r["n_hunks"]
        # What is common and what is gone give the old text, up to the white space of common parts.
        assert "".join("".join(t for op, t in hunks if op != "ins").split()) == "".join(before.split())


def test_sparse_likeness_is_enough(versions):
    units, pairs = versions
    for a, b in pairs[:30]:
        left, right = ([G._Unit(u.asDict()) for _, u in sorted(units[d].items())][:25] for d in (a, b))
        told = G._likenesses(left, right)
        for i, u in enumerate(left):
            for j, v in enumerate(right):
                like = G._likeness(u, v)
                assert told[i, j] == like or (told[i, j] == 0 and like < G.MATCH_FLOOR)


def test_drafts_and_what_is_visible(spark, small, versions):
    drafts = [r.asDict() for r in query("draft_comparisons")(spark, small).collect()]
    aligned = Counter((r["a"], r["b"], r["type"]) for r in registry.QUERIES["unit_alignment"](spark, small).collect())
    assert Counter((r["a"], r["b"], r["type"]) for r in drafts) == aligned
    for r in drafts:
        assert r["severity"] in G.SEVERITIES and (r["type"] != "unchanged" or r["severity"] == "cosmetic")
        assert r["type"] not in ("added", "removed") or (r["severity"] != "cosmetic" and r["summary"].startswith(("New clause added: ", "Clause removed: ")))
    shown = defaultdict(list)
    for r in query("visible_changes")(spark, small).collect():
        shown[r["a"], r["b"]].append(r)
    want = defaultdict(list)
    for r in drafts:
        if r["type"] != "unchanged" and r["severity"] != "cosmetic":
            want[r["a"], r["b"]].append((-G.SEVERITIES.index(r["severity"]), r["place"], r["title"]))
    assert {k: [x[2] for x in sorted(v)] for k, v in want.items()} == {k: [r["title"] for r in sorted(v, key=lambda r: r["shown_at"])] for k, v in shown.items()}


def test_detected_sections_and_analysis(spark, small, texts):
    rows = query("detected_sections")(spark, small).collect()
    assert {r["structured"] for r in rows if r["doc"] % 3 == 0} <= {False} and any(r["structured"] for r in rows)
    assert all(r["n_sections"] >= 1 and (r["structured"] or not r["leads"]) for r in rows)
    told = {r["doc"]: r for r in query("analyzed_documents")(spark, small).collect()}
    chunks = Counter(r["doc"] for r in registry.QUERIES["document_chunks"](spark, small).collect())
    for doc, text in texts.items():
        r = told[doc]
        assert r["tokens"] == -(-len(text) // 4)
        if not r["structured"]:
            assert r["warnings"] == "no_structure_detected" and r["n_chunks"] == chunks[doc] and r["n_clauses"] == 0
            assert r["n_sections"] == (len(parts_of(text)) if text else 0)


def test_analysis_of_a_contract(spark):
    lines = ["Master agreement", "made by two sides on this day.", "1. Term of Agreement", "It lasts a year.", "2. Payment", "The fees are due.", "2.1 Late Payment", "Interest runs.", "3. Governing Law", "It is the law of the sea.", "4. Miscellaneous", "Either side may terminate at will.", ""]
    text = "\n".join(lines)
    at, rows = 0, []
    for k, line in enumerate(lines):
        rows.append((1, k, at, at + len(line), line))
        at += len(line) + 1
    docs = spark.createDataFrame([(1, text, []), (2, "", []), (3, None, [])], "doc long, text string, furniture array<struct<start:int,end:int>>")
    frame = spark.createDataFrame(rows, "doc long, ord int, start int, end int, text string")
    sections, chunks, clauses, told = S.analyzed(docs, frame)
    got = [(r["number"], r["title"], r["level"], r["parent"]) for r in sections.orderBy("ord").collect()]
    assert got == [(None, "Preamble", 1, None), ("1", "Term of Agreement", 1, None), ("2", "Payment", 1, None), ("2.1", "Late Payment", 2, 2), ("3", "Governing Law", 1, None), ("4", "Miscellaneous", 1, None)]
    assert {(r["ord"], r["type"], r["confidence"]) for r in clauses.collect()} == {(1, "term_and_renewal", 0.8), (2, "payment", 0.8), (3, "payment", 0.8), (4, "governing_law", 0.8), (5, "termination", 0.4)}
    rows = {r["doc"]: r for r in told.collect()}
    assert rows[1]["structured"] and rows[1]["n_sections"] == 6 and rows[1]["warnings"] == [] and rows[1]["n_chunks"] == chunks.count()
    assert [(rows[d]["structured"], rows[d]["n_sections"], rows[d]["tokens"]) for d in (2, 3)] == [(False, 0, 0)] * 2
    # With pages a document without structure is organised by page, and unreadable pages are told.
    pages = spark.createDataFrame([(1, 1, 0, 20, "Master agreement mad", False), (1, 2, 20, len(text), "\ufffd" * 40, True)], "doc long, page_no int, start int, end int, text string, has_image boolean")
    plain = frame.where("ord < 2")
    by_page = S.analyzed(docs, plain, pages)
    assert [(r["title"], r["start"], r["end"]) for r in by_page[0].orderBy("ord").collect()] == [("Page 1", 0, 20), ("Page 2", 20, len(text))]
    assert by_page[3].where("doc = 1").first()["unreadable"] == [2] and by_page[3].where("doc = 1").first()["warnings"] == ["partial_scan", "no_structure_detected"]


def test_split_units(spark, small, texts):
    """Sections of three lines, split at line starts once they are too long, and paragraphs where sections are few."""
    import hashlib

    from textloom.plans.structure_queries import text_lines

    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    want, few = set(), []
    for doc, text in texts.items():
        starts = [0, *(m.end() for m in re.finditer("\n", text))][::3]
        if doc % 2 or len(starts) < 5:
            few.append(doc)
            continue
        idx = 0
        for k, s in enumerate(starts):
            e = starts[k + 1] if k + 1 < len(starts) else len(text)
            body = re.sub(r"[ \t]+", " ", text[s:e]).strip(" ")
            words = re.findall(r"[^ \t\n\x0b\f\r]+", body)
            if len(words) < 4 or (sum(x.strip(" ") != "" for x in body.split("\n")) == 1 and len(words) <= 12 and not re.search(r"[.;:]\Z", body)):
                continue
            cuts, last = [0], 0
            for at in [m.end() for m in re.finditer("\n", body)] if len(body) > 4 * 120 else []:
                if -(-(at - 1 - cuts[-1]) // 4) > 120 and last > cuts[-1]:
                    cuts.append(last)
                last = at
            for part, lo in enumerate(cuts):
                hi = cuts[part + 1] if part + 1 < len(cuts) else len(body)
                title = f"Lines {k + 1}" + (f" (part {part + 1})" if len(cuts) > 1 else "")
                shown = body[lo:hi].strip(" \n") if len(body) > 4 * 120 else body
                want.add((doc, idx, str(k + 1), title, digest(shown), s + lo, e if part + 1 == len(cuts) else s + hi))
                idx += 1
    rows = query("split_units")(spark, small).collect()
    plain = G.paragraph_units(text_lines(spark, small)).collect()
    want |= {(r["doc"], r["idx"], r["number"], r["title"], digest(r["text"]), r["start"], r["end"]) for r in plain if r["doc"] in set(few)}
    got = [tuple(r[c] for c in ("doc", "idx", "number", "title", "digest", "start", "end")) for r in rows]
    assert len(got) == len(set(got)) and set(got) == want and any("(part 2)" in x[3] for x in got) and few


def test_answers_as_text(spark):
    """Marks become numbers or links; words that leave a sentence open bring the quote, cut and escaped; unknown marks."""
    from textloom.operators import verification as V

    content = "It is made ⟦c1⟧. Known ⟦c2⟧, as ⟦c3⟧; by ⟦c4⟧ ⟦c1⟧ within ⟦c1⟧ then: ⟦c9⟧"
    answers = spark.createDataFrame([(1, content), (2, ""), (3, "no marks"), (4, None)], "answer_id long, content string")
    cited = [(1, "c1", "p", "verified", "a*b"), (1, "c2", "q", "verified_close", "two"), (1, "c3", "r", "verified", "x" * 300), (1, "c4", "p", "unverified", "four")]
    citations = spark.createDataFrame(cited, "answer_id long, citation_id string, passage string, status string, display string")
    plain = {r["answer_id"]: r["content"] for r in V.plain_answers(answers, citations).collect()}
    assert plain == {1: "It is made  [1]. Known  [2], as  [3]; by  [unverified]  [1] within  [1] then: ", 2: "", 3: "no marks", 4: None}
    told = {r["answer_id"]: r["content"] for r in V.markdown_answers(answers, citations).collect()}
    link = lambda k: f" [c{k}](#cite-c{k})"
    first = " *“a\\*b”*" + link(1)
    assert told == {1: f"It is made {first}. Known {link(2)}, as  *“{'x' * 237}…”*{link(3)}; by {link(4)} {link(1)} within {link(1)} then: {link(9)}", 2: "", 3: "no marks", 4: None}


def test_displayed_is_the_matchers_own(spark):
    """The column and the matcher's function give the same words, over furniture that overlaps, touches or lies outside."""
    import random

    from textloom.operators import verification as V

    rng, rows, want = random.Random(5), [], {}
    for k in range(300):
        text = "".join(rng.choice("ab é-\n\t X9\u00a0") for _ in range(rng.randint(0, 60)))
        lo = rng.randint(0, len(text))
        hi = rng.randint(lo, len(text))
        skip, at = [], 0
        for _ in range(rng.randint(0, 4)):
            s = at + rng.randint(0, 12)
            at = s + rng.randint(1, 10)
            skip.append((s, at))
        want[k] = M.display(M.Document(text, tuple(skip)), (lo, hi))
        rows.append((k, text, lo, hi, [{"start": s, "end": e} for s, e in skip]))
    frame = spark.createDataFrame(rows, "k int, text string, start int, end int, furniture array<struct<start:int,end:int>>")
    assert {r["k"]: r["d"] for r in frame.select("k", V.displayed().alias("d")).collect()} == want


def test_excerpts_merge_and_neighbours_need_room(spark):
    text = "Aa aa aa.  \nBb bb bb. Cc cc cc. Dd dd dd."
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    chunks = spark.createDataFrame([(1, 0, 0, 12, 3), (1, 1, 12, 22, 3), (1, 2, 22, 32, 3), (1, 3, 32, 41, 3)], "doc long, ord long, start int, end int, tokens long")
    sections = spark.createDataFrame([(1, 0, 0, 22, 1, "1", "First"), (1, 1, 22, 41, 1, None, "Rest")], "doc long, ord int, start int, end int, level int, number string, title string")
    chosen = spark.createDataFrame([(7, 1, 0, 3, 0), (7, 1, 1, 3, 1), (7, 1, 3, 3, 2)], "question_id long, doc long, ord long, tokens long, place int")
    got = R.excerpts(chosen, chunks, docs, sections).orderBy("place").collect()
    assert [(r["start"], r["end"], r["heading"], r["text"], r["percent"]) for r in got] == [(0, 22, "── §1 First ──", "Aa aa aa.\nBb bb bb.", 76), (32, 41, "── Rest ──", "Dd dd dd.", 76)]
    first = chosen.where("place = 0")
    assert {r["ord"] for r in R.with_neighbours(first, chunks).collect()} == {0, 1}
    assert {r["ord"] for r in R.with_neighbours(first, chunks, budget=5).collect()} == {0} and {r["ord"] for r in R.with_neighbours(first, chunks, budget=6).collect()} == {0, 1}


def test_classifiers_raise_and_never_lower(spark):
    rows = spark.createDataFrame([("c1", "minor", "by rules", "a", "b"), ("c2", "critical", "by rules", "a", "b"), ("c3", "major", "by rules", "x", "y")], "change_id string, severity string, summary string, before string, after string")

    def classify(changes):
        if any(c["before"] == "x" for c in changes):
            raise RuntimeError("away")
        return [("major", " told ") if c["change_id"] == "c1" else ("minor", "") for c in changes]

    got = {r["change_id"]: (r["severity"], r["summary"], r["by"]) for r in G.classified(rows.repartition(1), classify, batch=1).collect()}
    assert got == {"c1": ("major", "told", "classifier"), "c2": ("critical", "by rules", "classifier"), "c3": ("major", "by rules", "rules")}


def test_two_legs_fill_up(spark, small):
    """The precise leg's first twenty by density, then the loose leg's that are not among them, twenty in all."""
    from textloom.operators import fulltext as T
    from textloom.plans import fulltext_queries as Q

    def first(questions):
        found = defaultdict(list)
        for r in T.matches(Q._index(spark, small), T.queries(questions)).collect():
            found[r["question_id"]].append((-round(r["rank"], 9), r["doc"], r["ord"]))
        return {q: [x[1:] for x in sorted(rows)[:20]] for q, rows in found.items()}

    asked = Q._grammar(spark, small)
    precise, loose = first(asked), first(T.either_words(asked))
    want = {q: (precise.get(q, []) + [x for x in loose.get(q, []) if x not in precise.get(q, [])])[:20] for q in precise.keys() | loose.keys()}
    got = defaultdict(list)
    for r in sorted(query("two_leg_search")(spark, small).collect(), key=lambda r: r["rank"]):
        got[r["question_id"]].append((r["doc"], r["ord"]))
    assert got == want and any(len(precise.get(q, [])) < len(v) for q, v in want.items())


@pytest.mark.parametrize("name", ["phrase_search", "compact_passages", "highlight_boxes", "fused_search"])
def test_no_nested_loops(spark, small, name):
    plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


#: Queries that another file tests against plain Python.
ELSEWHERE = {"escalated_findings": "test_answers.py", "page_offsets": "test_tables_and_markup.py"}


def test_every_query_is_tested():
    for name, file in ELSEWHERE.items():
        assert f"{name}(spark, small)" in (Path(__file__).parent / file).read_text()
    assert TESTED | ELSEWHERE.keys() >= set(registry.QUERIES) - set(registry.SQL)
