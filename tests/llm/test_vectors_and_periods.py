"""Whitening, periodic runs and vector near-duplicates against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import periodic
from tidegauge.llm.periodic import local_runs, periodic_runs, stretches, tiles_of
from tidegauge.llm.vector_dedup import _links, near_duplicate_vectors
from tidegauge.llm.whitening import leading, whitened

VECTORS = "vec_id long, embedding array<double>, n_links string, component int, v string, node int, usable boolean"


def vector_frame(spark, pairs):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1, "y", 2, True) for i, v in pairs], VECTORS)


@pytest.fixture(scope="module")
def awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    return vector_frame(
        spark,
        [
            (0, [1, 0, 0]), (1, [1, 0, 0]), (1, [1, 0, 0]), (2, [0.99, 0.05, 0]), (2, [0, 1, 0]), (3, [0, 0, 0]), (4, None),
            (5, [nan, 1, 0]), (6, [inf, 0, 0]), (7, [None, 1, 2]), (8, []), (9, [1, 0]), (10, [2, 0.01]), (None, [0, 1, 0]),
            (None, None), (11, [1e300, 0, 0]), (12, [-1, 0, 0]), (13, [5e-324, 0, 0]), (14, [0, 0.02, -3]), (15, [0.3, -0.7, 1.9]),
        ],
    )


# Near-duplicates of vectors


def brute_links(pairs, threshold=0.95):
    """(id, links, component, kept) of every row, by all pairs."""
    n, units = len(pairs), []
    for _, v in pairs:
        ok = v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        a = np.array(v, float) / np.abs(v).max() if ok else None
        units.append(a / np.linalg.norm(a) if ok else None)
    linked = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(n)]
    out = []
    for i, (own, _) in enumerate(pairs):
        seen, open_ = {i}, [i]
        while open_:
            for j in linked[open_.pop()]:
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        least = min((pairs[j][0] for j in seen if pairs[j][0] is not None), default=None)
        out.append((own, len(linked[i]), least, own is not None and own == least))
    return sorted(out, key=str)


def found_links(df, **settings):
    return sorted((tuple(r) for r in near_duplicate_vectors(df, **settings).collect()), key=str)


def test_links_of_awkward_vectors(spark, awkward_vectors):
    pairs = [(r.vec_id, r.embedding) for r in awkward_vectors.collect()]
    assert found_links(awkward_vectors) == brute_links(pairs)
    assert found_links(awkward_vectors.limit(0)) == []


def grown(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = base[rng.integers(0, n // 4, n)] + spread * rng.standard_normal((n, dim))
    return [(i, v) for i, v in enumerate(np.concatenate([base, near]).tolist())]


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 40}, {"cell_rows": 40, "tile_bytes": 8 * 16 * 5}, {"cell_rows": 10, "slack": None}])
def test_links_equal_those_of_all_pairs(spark, settings):
    pairs = grown(1, 300, 16, 0.2)
    pairs += [(1000 + i, pairs[3][1]) for i in range(40)]  # a hot vector
    assert found_links(vector_frame(spark, pairs), **settings) == brute_links(pairs)


def test_recall_over_many_cells_is_almost_one(spark):
    pairs = grown(2, 1500, 64, 0.03 * 8)
    want, have = (sum(r[1] for r in rows) for rows in (brute_links(pairs), found_links(vector_frame(spark, pairs), cell_rows=20)))
    assert want > 1000 and have >= 0.995 * want


def test_scores_at_the_threshold_are_decided_in_double_precision():
    a = np.array([[1.0, 0.0]])
    b = np.array([[0.95, (1 - 0.95**2) ** 0.5], [0.95 - 1e-9, 0.3], [0.95 + 1e-9, 0.3]])
    assert next(_links(a, b, 0.95))[1].tolist() == [[True, False, True]]


# Whitening


def brute_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    z = (fit - fit[0]).astype(float)
    mean = z.mean(axis=0)
    values, turn = np.linalg.eigh((z - mean).T @ (z - mean) / len(fit))
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    trace = ((z - mean) ** 2).sum() / len(fit)
    sums = [int(s) for s in fit.sum(axis=0)]
    deviation = [sum((len(fit) * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return len(fit), deviation, ((x - fit[0]).astype(float) - mean) @ turn / np.sqrt(values), values / trace


@pytest.mark.parametrize("dim,guard", [(40, 4), (10, 16), (24, 2)])
def test_whitening_equals_the_full_decomposition(spark, dim, guard):
    rng = np.random.default_rng(dim)
    vectors = (rng.standard_normal((300, dim)) * np.linspace(3, 0.5, dim)).tolist()
    vectors += vectors[:50]
    df = vector_frame(spark, list(enumerate(vectors)))
    rows = whitened(df, k=6, guard=guard).collect()
    n, deviation, want, explained = brute_whitening(vectors, 6)
    got = np.zeros((len(vectors), 6))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.deviation_exact == str(r.deviation)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
    assert len(rows) == 6 * len(vectors)
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-8


def test_subspace_iteration_separates_close_eigenvalues():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    values = np.linspace(1.0, 1.4, 60)
    matrix = turn * values @ turn.T
    got, vectors, residual = leading(lambda b: matrix @ b, 60, 5, guard=5)
    assert np.allclose(got, values[::-1][:5], atol=1e-13) and residual < 1e-12
    assert np.allclose(np.abs(np.sum(vectors * turn[:, ::-1][:, :5], axis=0)), 1, atol=1e-11)


def test_whitening_of_awkward_vectors(spark, awkward_vectors):
    rows = whitened(awkward_vectors).collect()
    own = [r for r in rows if r.vec_id in (9, 10)]  # of two numbers: two vectors, one direction that varies
    assert sorted((r.vec_id, r.component, r.n) for r in own) == [(9, 1, 2), (10, 1, 2)]
    assert sorted({r.vec_id for r in rows} - {None}) == [0, 1, 2, 3, 9, 10, 12, 13, 14, 15]
    assert sum(r.vec_id is None for r in rows) == 3 and sum(r.vec_id == 1 for r in rows) == 6
    assert whitened(awkward_vectors.limit(0)).collect() == []
    assert whitened(awkward_vectors.where("vec_id <= 1")).collect() == []  # nothing varies
    far = whitened(vector_frame(spark, [(1, [1e16]), (2, [-1e16]), (3, [0])])).collect()
    assert [r.deviation for r in far if r.vec_id == 1] == [None] and all(int(r.deviation_exact) > 2**63 for r in far if r.vec_id == 1)


# Periodic runs


def brute_runs(w, least=24):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            a, z = i, j + q
            if z - a >= max(least, 3 * q) and not any(w[a : z - r] == w[a + r : z] for r in range(1, q)):
                out.append((a, z - a, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    w = []
    for _ in range(rng.randint(0, 6)):
        few = rng.choice([1, 3, 50])
        if rng.random() < 0.4:
            w += [rng.randint(0, few) for _ in range(rng.randint(0, 60))]
        else:
            p = rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 31, 32, 33, 40])
            cycle = [rng.randint(0, few) for _ in range(p)]
            w += (cycle * 8)[: rng.randint(p, 7 * p)]
    return w


def test_runs_of_whole_texts_equal_brute_force():
    rng = random.Random(4)
    texts = [random_words(rng) for _ in range(150)]
    assert local_runs([np.array(t, np.int32) for t in texts]) == [brute_runs(t) for t in texts]


def test_a_lying_hash_changes_nothing(monkeypatch):
    rng = random.Random(5)
    texts = [np.array(random_words(rng), np.int32) for _ in range(40)]
    want = local_runs(texts)
    equal = periodic._Hashes.equal
    monkeypatch.setattr(periodic._Hashes, "equal", lambda self, i, j, size: equal(self, i, j, size) | (size % 5 == 1))
    assert local_runs(texts) == want


def test_tiles_hold_every_fragment_that_a_run_needs():
    rng = random.Random(6)
    for _ in range(60):
        w = np.array(random_words(rng), np.int32)
        pieces = set()
        for _, own, lo, hi, a, z in tiles_of(len(w), 8):
            pieces |= {(x + lo, y + lo, q) for x, y, q in stretches(w[lo:hi], own, (a - lo, z - lo), lo, (lo > 0, hi < len(w))).tolist()}
        for start, length, q in brute_runs(w.tolist()):
            covered = start
            for x, y, _ in sorted(p for p in pieces if p[2] == q):
                if x <= max(start, covered - q):
                    covered = max(covered, y)
            assert covered >= start + length


def brute_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [x for i, x in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (told, " ".join(kept))]
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests, n)


def test_periodic_runs_of_documents_equal_brute_force(documents):
    some = documents.where("length(text) < 2500")
    want = sorted((brute_row(r.doc_id, r.text) for r in some.collect()), key=str)
    assert sum(r[1] for r in want) > 10
    for settings in ({}, {"local_bytes": 300, "tile_words": 32}):
        assert sorted((tuple(r) for r in periodic_runs(some, **settings).collect()), key=str) == want


def test_periodic_runs_of_awkward_rows(awkward, empty):
    awkward = awkward.withColumn("doc_id", F.expr("if(doc_id = 6, 7, doc_id)"))  # 6 would be rewritten
    rows = {(r.doc_id, r.n_words): r for r in periodic_runs(awkward).collect()}
    assert periodic_runs(awkward).count() == awkward.count() and periodic_runs(empty).count() == 0
    assert rows[7, 80_000].n_runs == 1 and (rows[7, 80_000].start, rows[7, 80_000].period) == (0, 4)
    assert rows[7, 80_000].collapsed_sha256 == hashlib.sha256(b"alpha beta gamma delta").hexdigest()
    nothing = hashlib.sha256(b"").hexdigest()
    assert all((r.n_runs, r.start, r.runs_sha256, r.collapsed_sha256) == (0, None, nothing, nothing) for k, r in rows.items() if k[1] == 0)
    assert periodic_runs(awkward, keep=["doc_id", "score", "fp"]).columns[:3] == ["doc_id", "score", "fp"]
