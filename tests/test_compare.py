"""Alignment puts every unit in one place; redlines keep both texts."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import compare as G
from textloom.operators import structure as S

WORDS = "crate vendor buyer order cash term breach office open late hand over total week rate year".split()


def unit(k, text, number=None):
    return {"idx": k, "number": number, "title": text[:20], "spaced": text, "compact": text.replace(" ", "")}


def test_buckets_partition():
    rng = random.Random(3)
    for _ in range(40):
        texts = [" ".join(rng.choices(WORDS, k=rng.randint(4, 9))) for _ in range(rng.randint(0, 9))]
        other = [t if rng.random() < 0.5 else t.replace("crate", "box") for t in texts if rng.random() < 0.8]
        rng.shuffle(other)
        placed = G.align([unit(k, t) for k, t in enumerate(texts)], [unit(k, t) for k, t in enumerate(other)])
        assert sorted(p[0] for p in placed if p[0] is not None) == list(range(len(texts)))
        assert [p[1] for p in placed if p[1] is not None] == list(range(len(other)))


def test_kinds():
    a = ["one two three four five", "the vendor shall pay the buyer in cash on time", "six seven eight nine ten", "gone with the wind and rain"]
    b = ["six seven eight nine ten", "one two three four five", "the vendor shall pay the buyer in kind on time", "all new words stand here now"]
    got = {(p[0], p[1]): p[2] for p in G.align([unit(k, t) for k, t in enumerate(a)], [unit(k, t) for k, t in enumerate(b)])}
    assert sorted(got.values()) == ["added", "modified", "moved", "removed", "unchanged"]
    assert got[(1, 2)] == "modified" and got[(3, None)] == "removed" and got[(None, 3)] == "added"


def test_redline_keeps_both_sides():
    rng = random.Random(5)
    for _ in range(60):
        a = " ".join(rng.choices(WORDS, k=rng.randint(0, 14)))
        b = " ".join(w if rng.random() < 0.7 else "zebra" for w in a.split())
        hunks = G.redline(a, b)
        assert "".join(t for op, t in hunks if op != "ins").strip() == a or not any(op != "eq" for op, _ in hunks)
        assert "".join(t for op, t in hunks if op != "del") == b


@pytest.mark.parametrize(("a", "b"), [("kitten", "sitting"), ("", "abc"), ("same", "same"), ("ab", "")])
def test_edit_distance(a, b):
    slow = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            slow[i][j] = min(slow[i - 1][j] + 1, slow[i][j - 1] + 1, slow[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert G.edit_distance(a, b) == slow[-1][-1]


def test_chunks_cover_and_stay_small():
    rng = random.Random(9)
    text = "\n".join(" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) + "." for _ in range(60)) + "x" * 9000
    cuts = sorted({0, *rng.sample(range(len(text)), 6)})
    sections = [{"ord": k, "parent": None if k % 2 == 0 else k - 1, "start": s} for k, s in enumerate(cuts)]
    got = S.chunk_ranges(text, sections, [])
    assert all(S.estimate(text[lo:hi]) <= 760 for _, lo, hi in got)
    seen = set()
    for _, lo, hi in got:
        seen.update(range(lo, hi))
    assert len(seen) == len(text)


def test_word_numbering():
    xml = b"""<w:numbering xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:abstractNum w:abstractNumId="0">
      <w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerRoman"/><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum>
      <w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num></w:numbering>"""
    from textloom.sources.files import Numbering

    n = Numbering(xml)
    assert [n.label("5", k) for k in (0, 1, 1, 0, 1)] == ["1.", "1.i", "1.ii", "2.", "2.i"]
    assert n.label("9", 0) is None


def test_unit_similarity_takes_every_unit(spark, small):
    from textloom.plans.compare_queries import paragraph_units, unit_similarity, version_pairs

    digests = {(r["doc"], r["idx"]): r["digest"] for r in paragraph_units(spark, small).collect()}
    pairs = [(r["a"], r["b"]) for r in version_pairs(spark, small).collect()]
    rows = unit_similarity(spark, small).collect()
    assert max(k for d, k in digests if d in {x for p in pairs for x in p}) >= 2
    for n, end in enumerate(("a", "b")):
        assert sorted((r["a"], r["b"], r[f"{end}_idx"]) for r in rows if r[f"{end}_idx"] is not None) == sorted((*p, k) for p in pairs for d, k in digests if d == p[n])
    for r in rows:
        both = r["a_idx"] is not None and r["b_idx"] is not None
        assert both == (r["similarity"] is not None)
        assert not both or digests[r["a"], r["a_idx"]] != digests[r["b"], r["b_idx"]] or r["similarity"] > 0.9


def test_long_units_are_split_and_few_sections_give_paragraphs(spark):
    from textloom.operators import compare as G

    long = "\n".join(f"line {k} says that crates are sent on to the buyer" for k in range(60))
    texts = [(1, "".join(f"{k}. Head {k}\nThis is what section {k} has to say.\n" for k in range(1, 5)) + "5. Long\n" + long), (2, "Only a preamble stands here.\nAnd a second paragraph of it.")]
    sections = [(1, k, str(k + 1), f"Head {k + 1}", texts[0][1].index(f"{k + 1}. "), 0) for k in range(5)] + [(2, 0, None, "Preamble", 0, 0)]
    lines = []
    for doc, text in texts:
        at = 0
        for k, line in enumerate(text.split("\n")):
            lines.append((doc, k, at, at + len(line), line))
            at += len(line) + 1
    frames = spark.createDataFrame(sections, "doc long, ord int, number string, title string, start int, end int"), spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(lines, "doc long, ord int, start int, end int, text string")
    rows = sorted(G.comparison_units(*frames, most=200).collect(), key=lambda r: (r["doc"], r["idx"]))
    assert [r["text"] for r in rows if r["doc"] == 2] == texts[1][1].split("\n")
    first = [r for r in rows if r["doc"] == 1]
    assert [r["title"] for r in first[:4]] == ["Head 1", "Head 2", "Head 3", "Head 4"] and all(r["title"].startswith("Head 5 (part ") for r in first[4:])
    assert [r["idx"] for r in first] == list(range(len(first))) and len(first) > 6
    # Parts are as long as they can be, break at line starts and leave nothing out.
    whole = "5. Long\n" + long
    s, last, want = 0, 0, []
    for i, c in enumerate(whole):
        if c == "\n":
            if -(-(i - s) // 4) > 200 and last > s:
                want.append(whole[s:last].strip())
                s = last
            last = i + 1
    assert [r["text"] for r in first[4:]] == [*want, whole[s:].strip()]


@pytest.mark.parametrize("blanks", [0, 1, 4, 5, 6, 40])
def test_numbers_of_clauses_are_no_facts_however_many_blanks(spark, blanks):
    gap = " " * blanks
    rows = spark.createDataFrame([(f"see §{gap}30 and 7 crates", f"see §{gap}31 and 9 crates")], "a string, b string")
    assert [tuple(f[:3]) for f in rows.select(G.changed_facts(F.col("a"), F.col("b")).alias("f")).first()["f"]] == [("number", "7", "9")]
