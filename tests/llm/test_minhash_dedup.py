import random

import pytest

from textloom.llm import minhash_dedup as D
from textloom.llm._components import components

from .helpers import awkward, documents, prose


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split() if (text or "").isascii() else None
    if w is None:
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 75 * len(x | y):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return ordered((i, len(s), i if not s else least.get(root(k)), not s or i == least.get(root(k))) for k, (i, s) in enumerate(sets))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def found(docs):
    return ordered((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in D.deduplicate(docs).collect())


def edited(rng, text, share):
    return " ".join(rng.choice(("zebra", "otter", w + "x")) if rng.random() < share else w for w in text.split())


def test_like_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = prose(rng, rng.randint(3, 240))
        for share in (0, 0, 0.004, 0.02, 0.03, 0.05, 0.2):
            rows.append((len(rows) * 3 + 1, edited(rng, base, share)))
    assert found(documents(spark, [(i, t, None, None) for i, t in rows])) == brute(rows)


@pytest.mark.parametrize("share", [0.01, 0.03])
def test_one_large_group_in_blocks(spark, monkeypatch, share):
    """A group of near copies over several blocks; the blocks' size changes nothing."""
    rng = random.Random(5)
    base = prose(rng, 200)
    rows = [(i, edited(rng, base, share)) for i in range(160)]
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    want = brute(rows)
    monkeypatch.setattr(D, "BLOCK", 24)
    assert found(docs) == want


def test_groups_that_stay_apart_from_their_pivot(spark, monkeypatch):
    """Chains in which the ends are far from each other, several of them in one candidate group."""
    rng = random.Random(6)
    words, rows = prose(rng, 300).split(), []
    for k in range(90):
        words[(7 * k) % 300] = f"step{k}"
        rows.append((k + 5, " ".join(words)))
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    monkeypatch.setattr(D, "BLOCK", 16)
    assert found(docs) == brute(rows)


def test_null_ids_and_shared_names(spark, monkeypatch):
    rng = random.Random(9)
    base, other = prose(rng, 200), prose(rng, 150)
    rows = [(None, base), (1, base.replace("crate", "box", 1)), (None, other), (None, other), (None, None), (4, prose(rng, 90)), (None, prose(rng, 80))]
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    assert found(docs) == brute(rows)
    # The second half of a digest tells sets of one name apart.
    node = D._node
    monkeypatch.setattr(D, "_node", lambda s: (node(s)[0] % 2, node(s)[1]))
    rows = [(i, t) for i, t in rows if i is not None] + [(9, base), (10, other), (11, other)]
    assert found(documents(spark, [(i, t, None, None) for i, t in rows])) == brute(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs) == brute(rows)
    assert found(docs.limit(0)) == []


def test_components_of_a_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}
