"""Vector codes against plain Python, the curve and the shortlists against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from quire.llm import vector_codes as vc


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """(codes by row number, codebooks) in plain Python integers."""
    good = [(k, i, lab, [math.floor(1024 * x) for x in v]) for k, (i, v, lab) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(good, key=lambda g: (g[1] is None, g[1] or 0, np.array(g[3], "<i4").tobytes()))
    first = [g for g in first if len(g[3]) % parts == 0]
    if not first:
        return {}, []
    size = len(first[0][3])
    first = [g for g in first if len(g[3]) == size]
    good = [g for g in good if len(g[3]) == size]
    w = size // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(g[3], p) for g in first[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, p: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        held = {}
        for g in good:
            for p in range(parts):
                held.setdefault((p, near(cut(g[3], p), p)[1]), []).append(cut(g[3], p))
        for (p, e), xs in held.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = {}
    for k, i, lab, x in good:
        found = [near(cut(x, p), p) for p in range(parts)]
        out[k] = (i, lab, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found))
    return out, books


def check(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, row int")
    want, books = brute_codes(rows, **sizes)
    coded, found = vc.vector_codes(df, **sizes)
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in coded.collect()), key=str) == sorted(want.values(), key=str)
    assert found is None and not books or found.entries.tolist() == books
    return df, coded, found, want


def test_codes_match_brute_force(spark, monkeypatch):
    dice = random.Random(5)
    rows = [(i, [dice.gauss(0, 0.3) for _ in range(8)], i % 3 or None) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(150)]  # a hot vector
    rows += [(5, rows[3][1], 2), (5, rows[4][1], 2), (6, rows[6][1], 0), (6, rows[6][1], 0), (None, rows[9][1], None), (None, rows[1][1], 7)]
    rows += [(-1, None, 1), (-2, [], 1), (-3, [0.1] * 7, 1), (-4, [0.1, None] * 4, 1), (-5, [float("nan")] * 8, 1), (-6, [float("inf")] * 8, 1), (400, [0.5] * 12, 1)]
    monkeypatch.setattr(vc, "BLOCK", 16)
    df, coded, books, want = check(spark, rows, entries=16)
    out = vc.decode(coded, books).collect()
    assert all(np.allclose(r.approximation, np.concatenate([books.entries[p, int(r.code[2 * p : 2 * p + 2], 16)] for p in range(4)]) / 1024) for r in out)
    digest = hashlib.sha256(",".join(str(x) for p in brute_codes(rows)[1] for e in p for x in e).encode()).hexdigest()
    totals = {}
    for _, lab, _, error in brute_codes(rows)[0].values():
        totals[lab] = totals.get(lab, 0) + error
    labels = {}
    for i, _, lab in rows:
        labels.setdefault(i, set()).add(lab)
    result = vc.coded_vectors(df).collect()
    assert {r.codebooks_sha256 for r in result} == {digest} and len(result) == len(want)
    assert all(r.label_error in {totals[x] for x in labels[r.vec_id] if x in totals} for r in result)


def test_few_and_no_vectors(spark):
    check(spark, [(i, [0.25 * i] * 4, None) for i in range(3)])
    check(spark, [(1, [0.5, -0.5, 0.0, 1e-9], 1)] * 3, parts=2, entries=2)
    df, coded, books, _ = check(spark, [(1, None, 1), (2, [0.1] * 3, 1)])
    assert books is None and coded.count() == 0 and vc.coded_vectors(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="cannot be summed exactly"):
        vc.vector_codes(spark.createDataFrame([(1, [1e9] * 4, 1)], "vec_id long, embedding array<double>, label int"))


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = vc.curve_keys(cells, bits)
        walk = cells[np.argsort(keys)]
        assert len(np.unique(keys)) == len(cells) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_hold_every_nearest_entry():
    dice = np.random.default_rng(3)
    for _ in range(200):
        x = dice.integers(-50, 50, (20, 3)) // dice.integers(1, 20)
        entries = dice.integers(-60, 60, (40, 3)) // dice.integers(1, 20)
        near = vc.shortlist(x.min(axis=0), x.max(axis=0), x.sum(axis=0) // len(x), entries)
        far = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        best, error = vc.nearest(x, entries[near])
        assert near[best].tolist() == far.argmin(axis=1).tolist() and error.tolist() == far.min(axis=1).tolist()
    # parts of one small neighbourhood among scattered entries
    entries = dice.integers(-500, 500, (256, 8))
    x = entries[17] + dice.integers(-3, 4, (50, 8))
    assert vc.shortlist(x.min(axis=0), x.max(axis=0), x.sum(axis=0) // 50, entries).tolist() == [17]
    big = np.array([[1 << 24, -(1 << 24)]] * 2)
    assert vc.nearest(big, big - 1)[1].tolist() == [2, 2]
