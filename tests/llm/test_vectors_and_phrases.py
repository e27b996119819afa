"""Near-duplicate vectors, collocations and centroid clusters against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from textloom.llm import centroid_clusters, collocations, embedding_dedup

from .helpers import awkward, documents

VECTORS = "vec_id long, embedding array<float>, label int, c long, v string, size int, dims int, cluster int, a long"


def vectors(spark, rows):
    """rows of (id, vector); further columns have names that operators use themselves."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 1, 2, "x", 3, 4, 5, 6) for i, v in rows], VECTORS)


def unit(x):
    return x / np.linalg.norm(x)


def turned(rng, v, cosine):
    t = rng.standard_normal(len(v))
    t -= (t @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * unit(t)


def brute_links(rows, threshold=0.9):
    ok = [k for k, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(np.float32(x) for x in v)]
    near = {k: set() for k in range(len(rows))}
    for x, a in enumerate(ok):
        for b in ok[x + 1 :]:
            p, q = (np.array([np.float32(y) for y in rows[k][1]], np.float64) for k in (a, b))
            if len(p) == len(q) and unit(p / abs(p).max()) @ unit(q / abs(q).max()) >= threshold:
                near[a].add(b)
                near[b].add(a)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in near:
            low = min([label[a], *(label[b] for b in near[a])])
            changed |= low != label[a]
            label[a] = low
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[x][0] for x in range(len(rows)) if label[x] == label[k] and rows[x][0] is not None]
        out.append((i, len(near[k]), min(ids, default=None), i == min(ids, default=None)))
    return Counter(out)


def links_of(df):
    return Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.withColumnRenamed("id", "vec_id").collect())


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 16])
def test_links_are_those_of_brute_force(spark, monkeypatch, block):
    """Pairs on both sides of the threshold, a group of near copies, exact copies, and what cannot be compared. A small block deals long lists out."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(120):
        v = unit(rng.standard_normal(64))
        rows += [(3 * k, v), (3 * k + 1, 3.5 * turned(rng, v, rng.uniform(0.86, 0.99)))]
    centre = unit(rng.standard_normal(64))
    rows += [(1000 + k, turned(rng, centre, 0.97)) for k in range(80)]
    rows += [(2000 + k % 30, centre) for k in range(60)]
    rows += [(4000, None), (4001, []), (4002, np.zeros(64)), (4003, [None] * 64), (4004, [math.nan] * 64), (4005, [math.inf] * 64), (4006, [1.0]), (4007, [2.0]), (4008, [-1.0]), (None, centre), (4009, [1e30] * 3), (4010, [1e-30] * 3)]
    got = links_of(embedding_dedup.near_duplicates(vectors(spark, rows)))
    assert got == Counter({(i, n, c, k if i is not None else False): x for (i, n, c, k), x in brute_links(rows).items()})


def test_no_vectors(spark):
    for rows in ([], [(1, None), (None, [0.0])]):
        assert embedding_dedup.near_duplicates(vectors(spark, rows)).count() == len(rows)


@pytest.mark.parametrize("dims", [2, 16, 64, 300])
def test_calibrated_recall_holds_for_other_pairs(dims):
    size = embedding_dedup.book_size(100_000, dims)
    k, count = embedding_dedup.calibrated(dims, size, 0.9)
    rng = np.random.default_rng(77)
    a = np.array([unit(rng.standard_normal(dims)) for _ in range(500)])
    b = np.array([turned(rng, v, 0.9) for v in a])
    (d, p), (e, q) = (embedding_dedup.largest(x, size, k) for x in (a, b))
    met = ((d[:, :, None] == e[:, None, :]) & (abs(p[:, :, None] - q[:, None, :]) <= embedding_dedup.window(0.9))).sum((1, 2))
    assert (met >= count).mean() >= 0.99


def test_largest_projections_are_those_of_all_directions():
    rng = np.random.default_rng(3)
    a = np.array([unit(rng.standard_normal(8)) for _ in range(20)])
    one, two = embedding_dedup.books(8, 10)
    every = ((a @ one)[:, :, None] + (a @ two)[:, None, :]).reshape(20, 100)
    dirs, proj = embedding_dedup.largest(a, 10, 16)
    assert (np.sort(every, axis=1)[:, -16:] == pytest.approx(np.sort(proj, axis=1), abs=1e-6)) and all(set(d) == set(np.argsort(-x)[:16]) for d, x in zip(dirs, every, strict=True))


def brute_phrases(rows, limit=2000):
    f = {}
    for lang, text in rows:
        counts = f.setdefault(lang or "und", Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        n, found = sum(x for p, x in counts.items() if len(p) == 1), []
        triples = [(p, x) for p, x in counts.items() if len(p) == 3 and x >= 10]
        longer = Counter()
        for p, x in triples:
            for q in (p[:2], p[1:]):
                longer[q] = max(longer[q], x)
        for p, a in counts.items():
            if len(p) > 1 and a >= 10 and not 100 * longer[p] >= 50 * a:
                score, _, lf, rf = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), lf, rf))
        out |= {(lang, k + 1, p.decode(), -a, lf, rf, n, -s) for k, (s, a, p, lf, rf) in enumerate(sorted(found)[:limit])}
    return out


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_phrases_are_those_of_brute_force(spark, coalesced):
    """With partitions left apart, heads and their phrases lie in different runs."""
    rng = random.Random(4)
    few = "the of and crate vendor É漢".split()
    made = [(k, "".join(rng.choice(few) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", " The "]) for _ in range(rng.randrange(1, 200))), rng.choice(["en", "de", None, "und"]), "a") for k in range(60)]
    made += [(100 + k, "new york city hall", "en", "a") for k in range(15)]
    docs = documents(spark, made).unionByName(awkward(spark)).cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        got = {tuple(r) for r in collocations.ranked(collocations.mine(docs)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    assert got == brute_phrases(rows) and len(got) > 100
    assert {tuple(r) for r in collocations.ranked(collocations.mine(docs), limit=7, shares=3).collect()} == brute_phrases(rows, 7)


def test_no_documents_no_phrases(spark):
    assert collocations.ranked(collocations.mine(documents(spark, []))).count() == 0
    assert collocations.ranked(collocations.mine(documents(spark, [(1, None, None, None), (2, ". ! \n", "en", "a")]))).count() == 0


def test_long_texts_are_cut_between_pieces(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("ab Z\t.\n漢") for _ in range(5000))
    whole = [w for part in collocations.segments(text) for w in part]
    monkeypatch.setattr(collocations, "SEGMENT", 40)
    parts = list(collocations.segments(text))
    assert len(parts) > 20 and [w for p in parts for w in p] == whole and all(p[-1:] == [b"."] for p in parts[:-1])


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centroids = [q for _, q in seeds[:k]]
    apart = lambda q, c: sum((x - y) ** 2 for x, y in zip(q, c, strict=True))
    nearest = lambda q: min((apart(q, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        told = [nearest(q)[1] for _, q in kept]
        for n in range(len(centroids)):
            mine = [q for (_, q), t in zip(kept, told, strict=True) if t == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    told = [nearest(q) for _, q in kept]
    each = Counter()
    for d, n in told:
        each[n] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, n, d, each[n], sum(each.values()), names[n]) for (i, _), (d, n) in zip(kept, told, strict=True))


@pytest.mark.parametrize("n, spread", [(5, 1.0), (300, 0.3), (300, 100.0)])
def test_clusters_are_those_of_exact_integers(spark, n, spread):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((6, 64)) * spread
    rows = [(k % (n - 2), centres[k % 6] + rng.standard_normal(64) * 0.2) for k in range(n)]
    rows += [(7000, rows[0][1]), (7001, rows[0][1]), (None, rows[1][1]), (1, None), (2, [1.0] * 63), (3, [math.nan] + [0.0] * 63), (4, [None] + [0.0] * 63), (5, [math.inf] + [0.0] * 63), (6, np.zeros(64))]
    got = centroid_clusters.cluster(vectors(spark, rows))
    assert Counter((r["id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got.collect()) == brute_clusters(rows)


def test_no_vectors_no_clusters(spark):
    assert centroid_clusters.cluster(vectors(spark, [(1, None), (2, [1.0])])).count() == 0
    assert centroid_clusters.cluster(vectors(spark, [(1, [200_000.0] + [0.0] * 63)])).count() == 0


def test_bounds_hold_and_leave_out(spark):
    """Lower and upper bounds enclose the true distances; apart groups leave one centroid for most vectors."""
    rng = np.random.default_rng(8)
    groups = np.floor(rng.standard_normal((8, 64)) * 500)
    q = np.concatenate([g + np.floor(rng.standard_normal((50, 64)) * 20) for g in groups]).astype(np.int64)
    simplex = centroid_clusters.Simplex(q[::25])
    apex, centres = simplex.apex(q.astype(np.float64)), simplex.apex(groups)
    flat = ((apex[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(2)
    true = ((q[:, None] - groups[None]) ** 2).sum(2)
    assert (flat + (apex[:, -1:] - centres[:, -1]) ** 2 <= true * (1 + 1e-9) + 1e-3).all() and (flat + (apex[:, -1:] + centres[:, -1]) ** 2 >= true * (1 - 1e-9) - 1e-3).all()
    assert centroid_clusters.candidates(apex, centres).sum(1).mean() < 1.5
