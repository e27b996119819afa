"""Tables rewritten in part, markup with offsets, list labels."""

import pytest

from textloom.sources import files, tables


def test_rewrite_touches_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(k, n, f"{k}:{n}") for k in range(200) for n in range(3)], "doc_id long, n int, text string")
    tables.write_partitioned(rows, path, "doc_id", 16)
    files_of = lambda: {p.parent.name: sorted(x.name for x in p.parent.glob("*.parquet")) for p in (tmp_path / "table").glob("key_bucket=*/*.parquet")}
    before = files_of()
    fresh = spark.createDataFrame([(7, 0, "new"), (7, 1, "new"), (9, 0, "new"), (5000, 0, "added")], "doc_id long, n int, text string")
    for _ in range(2):
        tables.rewrite_documents(spark, path, fresh, "doc_id", 16)
    want = {(k, n, f"{k}:{n}") for k in range(200) for n in range(3) if k not in (7, 9)} | {(7, 0, "new"), (7, 1, "new"), (9, 0, "new"), (5000, 0, "added")}
    got = [tuple(r) for r in spark.read.parquet(path).select("doc_id", "n", "text").collect()]
    assert len(got) == len(want) and set(got) == want
    changed = {b for b, names in files_of().items() if before.get(b) != names}
    assert 0 < len(changed) <= 3
    tables.rewrite_documents(spark, path, fresh.limit(0), "doc_id", 16)
    assert spark.read.parquet(path).count() == len(want)


def test_every_offset_leads_to_its_character(spark):
    odd = "a & b < c > \"d\" 'e' &amp; &#39; é漢👍🏽 \t <span data-o=\"3\"> \n end"
    rows = [(1, 0, "h1", "1.", "Heads & <tails>"), (1, 1, "p", files.BULLET, odd), (1, 2, "p", None, None), (1, 3, "p", None, "  "), (1, 4, "p", "(a)", None), (1, 5, "p", "", odd), (2, 0, "p", None, "x")]
    made = files.rendered(spark.createDataFrame(rows, "doc long, ord int, tag string, label string, text string"))
    paragraphs = {(r["doc"], r["ord"]): r for r in made.collect()}
    assert sorted(paragraphs) == [(1, 0), (1, 1), (1, 4), (1, 5), (2, 0)]
    text = {d: "\n".join(r["text"] for (doc, _), r in sorted(paragraphs.items()) if doc == d) for d in (1, 2)}
    assert text[1] == f"1. Heads & <tails>\n{odd}\n(a) \n{odd}"
    seen = {1: set(), 2: set()}
    for s in files.spans_of(made).collect():
        assert text[s["doc"]][s["start"] : s["start"] + s["length"]] == s["shown"]
        at = set(range(s["start"], s["start"] + s["length"]))
        assert not at & seen[s["doc"]]
        seen[s["doc"]] |= at
    for d, t in text.items():
        ends = {r["end"] for (doc, _), r in paragraphs.items() if doc == d}
        assert seen[d] == set(range(len(t))) - ends
    assert "&quot;d&quot; &#39;e&#39; &amp;amp; &amp;#39;" in paragraphs[1, 1]["html"] and files.BULLET not in text[1]


def test_pages_markup_is_whole(spark, small):
    from textloom.plans.bookkeeping_queries import page_offsets

    want = {}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        blocks = [t for _, t in files.html_blocks(r["html"] or "")]
        if blocks:
            starts, at = [], 0
            for t in blocks:
                starts.append(at)
                at += len(t) + 1
            want[r["page_id"]] = (len(blocks), sum(map(len, blocks)), sum(starts), 0)
    assert {r["doc"]: (r["n_spans"], r["n_chars"], r["starts"], r["n_wrong"]) for r in page_offsets(spark, small).collect()} == want


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def lists(*levels, overrides=""):
    body = "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="{start}"/><w:numFmt w:val="{form}"/>{more}<w:lvlText w:val="{text}"/></w:lvl>' for k, (start, form, text, more) in enumerate(levels))
    return files.Numbering(f'<w:numbering {W}><w:abstractNum w:abstractNumId="0">{body}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="0"/>{overrides}</w:num></w:numbering>'.encode())


@pytest.mark.parametrize(
    "levels, overrides, paragraphs, labels",
    [
        # An ancestor that has not come stands at its start, and counts on from there.
        ([(1, "decimal", "%1.", ""), (1, "decimal", "%1.%2", "")], "", [("1", 1), ("1", 0), ("1", 1)], ["1.1", "2.", "2.1"]),
        ([(3, "decimal", "%1.", ""), (1, "lowerLetter", "(%2)", ""), (1, "bullet", "", "")], "", [("1", 2), ("1", 1), ("1", 0)], ["•", "(b)", "4."]),
        ([(1, "upperRoman", "%1.", ""), (1, "decimal", "%1.%2", "<w:isLgl/>")], "", [("1", 0), ("1", 1), ("1", 1)], ["I.", "1.1", "1.2"]),
        ([(1, "upperRoman", "%1.", ""), (1, "decimal", "%1.%2", '<w:isLgl w:val="0"/>')], "", [("1", 0), ("1", 1)], ["I.", "I.1"]),
        # An override holds from the list's first use, at whatever level that is, and clears what is deeper.
        ([(1, "decimal", "%1.", ""), (1, "decimal", "%1.%2", "")], '<w:lvlOverride w:ilvl="0"><w:startOverride w:val="7"/></w:lvlOverride>', [("1", 0), ("1", 1), ("2", 1), ("2", 0), ("1", 0)], ["1.", "1.1", "6.1", "7.", "8."]),
        ([(1, "none", "%1", ""), (1, "bullet", "o", "")], "", [("1", 0), ("0", 0), ("9", 0), (None, 0), ("1", 5)], [None] * 5),
    ],
)
def test_labels(levels, overrides, paragraphs, labels):
    numbering = lists(*levels, overrides=overrides)
    assert [numbering.label(n, k) for n, k in paragraphs] == labels
