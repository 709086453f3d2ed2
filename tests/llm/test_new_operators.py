"""Manifest, neighbours and divergence on small fixtures: brute force, odd rows, empty and crowded tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import divergence, manifest, neighbours

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, rank int, n string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- manifest ----------------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    i, text, lang, source, n = row
    said = [None if v is None else str(v) for v in (i, source, lang, None if n is None else n + more, text)]
    return digest(*["-" if v is None else f"{len(v.encode())}:{v}" for v in said])


def plain_tree(nodes):
    """The root of nodes, and the (left, right) siblings on each node's way up."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(k, min(k + manifest.FANOUT, len(nodes))) for k in range(0, len(nodes), manifest.FANOUT)]
        for run in runs:
            for k in run:
                for o in owners[k]:
                    paths[o].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        nodes, owners = [digest(*[nodes[k] for k in run]) for run in runs], [[o for k in run for o in owners[k]] for run in runs]
    return nodes[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]])
    root, tops = plain_tree([trees[g][0] for g in order])
    out = Counter()
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = plain_leaf(r, 1 if tampered else 0)
            for left, right in path + top:
                h = digest(left, h, right)
            out[r[0], plain_leaf(r), trees[g][0], root, digest(*[x for p in path + top for x in p]), h, h == root] += 1
    return out


def manifest_rows(docs):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in manifest.manifest(docs).collect())


def test_manifest(spark):
    rng = random.Random(3)
    ids = [*range(-5, 150), 1 << 62, -(1 << 63), (1 << 63) - 1, *[rng.randrange(1 << 40) for _ in range(40)]]
    rows = [(i, rng.choice(["", "é" * 9, "a b", None, "x" * 5000]), rng.choice(["en", "en", "de", None, "", "zh"]), rng.choice([None, "s"]), rng.choice([None, 3, -1])) for i in ids]
    rows += [(7, "again", "en", None, 1)] * 3 + [(7, "other", "en", None, 1), (None, "a", "en", None, 1), (None, None, None, None, None), (1, "lone", "lone", "s", 4)]
    want = plain_manifest(rows)
    assert manifest_rows(docs_of(spark, rows)) == want
    assert {v for *_, v in want} == {True, False}


def test_manifest_crowded_id(spark, monkeypatch):
    """An id with most of the rows: its bucket goes on with digits of the leaves."""
    monkeypatch.setattr(manifest, "BUCKET_ROWS", 20)
    rows = [(9, f"text {i % 90}", "en", "s", i % 3) for i in range(200)] + [(i, "t", "en", "s", 1) for i in range(40)]
    assert manifest_rows(docs_of(spark, rows)) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 129])
def test_manifest_sizes(spark, n):
    rows = [(i * 1000, "t", "en", "s", 1) for i in range(n)]
    assert manifest_rows(docs_of(spark, rows)) == plain_manifest(rows)


def test_manifest_wider_fanout(spark, monkeypatch):
    monkeypatch.setattr(manifest, "FANOUT", 3)
    monkeypatch.setattr(manifest, "CHUNK_DIGITS", 2)
    rows = [(i, "t", ["en", "de", None, "fr"][i % 4], "s", 1) for i in range(95)]
    assert manifest_rows(docs_of(spark, rows)) == plain_manifest(rows)


def test_manifest_empty(nothing):
    assert manifest.manifest(nothing).count() == 0


# --- divergence --------------------------------------------------------------------------------------------------


def plain_divergence(rows):
    groups, lang_docs, lang_n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        found = ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang, source].update(found)
        lang_docs[lang].update(set(found))
        lang_n[lang].update(found)
    out = set()
    for (lang, source), own in groups.items():
        kept = [t for t, d in lang_docs[lang].items() if d >= 10]
        total = {s: sum(c[t] for t in kept) for (g, s), c in groups.items() if g == lang}

        def share(count, n, v=len(kept)):
            return 1 + 1_000_000_000 * (count + 2) // (n + 2 * v)

        def rank(part, values, most=math.inf, at=(lang, source)):
            for k, (item, value) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode())), 1):
                if k <= most:
                    out.add((*at, part, item, value, k))

        pairs = {}
        for (g, other), theirs in groups.items():
            if g == lang and other != source:
                pq = [(share(own[t], total[source]), share(theirs[t], total[other])) for t in kept]
                pairs[other] = sum((p - q) ** 2 // (p + q) for p, q in pq)
        rank("pair", pairs)
        n, terms = sum(lang_n[lang][t] for t in kept), {}
        for t in kept:
            p, q = share(own[t], total[source]), share(lang_n[lang][t], n)
            if own[t] and p > q:
                terms[t] = (p - q) ** 2 // (p + q)
        rank("term", terms, 10)
    return out


@pytest.mark.parametrize("block", [2, 128])
def test_divergence(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD_TERMS", 40)
    rng = random.Random(8)
    rows = []
    for i in range(500):
        vocabulary = ["The", "the", "été", "Été", "naïve", "x", *[f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]]
        text = None if i % 41 == 0 else " ".join(rng.choice(vocabulary[: rng.randrange(3, 66)]) + rng.choice(["", "1", ",", "\x00"]) for _ in range(rng.randrange(30)))
        rows.append((rng.randrange(50), text, rng.choice(["en", "en", "de", None, ""]), rng.choice([None, "", "a", "b", "hot", "hot", "é", "z"]), 1))
    rows += [(1, "rare words only", "rare", s, 1) for s in ("a", "b", None)] + [(2, None, "en", "silent", 1), (3, "x", "lonely", "a", 1)]
    got = divergence.divergence(docs_of(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_divergence(rows)


def test_divergence_share_is_exact(spark):
    cases = [(0, 1, 1), (9 * 10**15, 9 * 10**15, 1), (8_999_999_999_999_999, 9 * 10**15, 77), (123, 10**15 + 7, 10**6)]
    rows = spark.createDataFrame(cases, "n long, total long, v long").select("*", divergence.share("n", "total", "v").alias("p")).collect()
    assert [r.p for r in rows] == [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in cases]


def test_divergence_empty(nothing):
    assert divergence.divergence(nothing).count() == 0


# --- neighbours --------------------------------------------------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(v), 3, "x") for i, v in rows], "vec_id long, embedding array<float>, dim int, query string")


def plain_neighbours(rows, nearest=20):
    out = {}
    sound = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    for i, v in sound:
        if i % 20 == 0:
            best = {}
            for j, w in sound:
                if j != i and len(w) == len(v):
                    score = 0.0
                    for a, b in zip(w, v, strict=True):
                        score += a * b
                    best[j] = max(best.get(j, -math.inf), score)
            for k, (j, score) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:nearest], 1):
                out[i, k] = (j, score)
    return out


def random_vectors(seed, n, dim, scale=False):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) + 2 * rng.normal(size=(8, dim))[rng.integers(8, size=n)]
    v /= np.linalg.norm(v, axis=1)[:, None]
    return (v * rng.lognormal(0, 0.6, size=(n, 1)) if scale else v).astype(np.float32)


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_recall(spark, scale):
    rows = list(enumerate(random_vectors(1, 3000, 24, scale).tolist()))
    got, want = neighbours.nearest_neighbours(vectors_of(spark, rows)).collect(), plain_neighbours(rows)
    assert len(got) == len(want)
    found, true = Counter((r.query_id, r.vec_id) for r in got), {(q, j) for (q, _), (j, _) in want.items()}
    assert max(found.values()) == 1
    assert sum(k in true for k in found) / len(true) >= 0.97
    vector = dict(rows)
    for r in got[:300]:
        assert r.score == pytest.approx(sum(a * b for a, b in zip(vector[r.query_id], vector[r.vec_id], strict=True)), rel=1e-12)


def test_neighbours_odd_rows(spark):
    """Copies by the hundred, ties, vectors of other lengths and unusable ones: as brute force has it."""
    some = random_vectors(2, 60, 6).tolist()
    rows = [(i, some[i % 60]) for i in range(90)] + [(1000 + i, some[0]) for i in range(300)] + [(1020, some[0])]
    rows += [(None, some[3]), (200, None), (220, []), (240, [0.0] * 6), (260, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (280, [math.nan] * 6), (300, [math.inf] * 6)]
    rows += [(400 + i, [1.0, float(i)]) for i in range(5)] + [(500, [1.0])]
    got = neighbours.nearest_neighbours(vectors_of(spark, rows)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted((*k, *v) for k, v in plain_neighbours(rows).items())


def test_neighbours_repeated_id(spark):
    """Both rows of an id ask, neither finds the other, and who finds both gets the better."""
    got = neighbours.nearest_neighbours(vectors_of(spark, [(40, [1.0, 0.0]), (40, [0.0, 1.0]), (60, [3.0, 1.0]), (1, [1.0, 1.0])])).collect()
    assert sorted(tuple(r) for r in got) == [(40, 1, 1, 1.0), (40, 1, 60, 3.0), (40, 2, 1, 1.0), (40, 2, 60, 1.0), (60, 1, 1, 4.0), (60, 2, 40, 3.0)]


def test_neighbours_every_node_is_reached():
    """Also where points stand in far clusters, or in one line."""
    rng = np.random.default_rng(4)
    far = np.concatenate([rng.normal(size=(150, 5)) * 0.01 + 10 * k for k in range(5)])
    for points in (far, np.arange(1, 700)[:, None] * np.ones((1, 3)), rng.normal(size=(1, 4))):
        assert neighbours.Graph(points).build()._reached().all()


def test_neighbours_empty(spark):
    assert neighbours.nearest_neighbours(vectors_of(spark, [])).count() == 0
    assert neighbours.nearest_neighbours(vectors_of(spark, [(20, [1.0, 2.0])])).count() == 0
