"""First contacts against brute force on roots, touching cases, and odd rows."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticework.functions import contacts, roots
from latticework.operators import collision

NAMES = [f"{w}{k}{i}" for w in "se" for k in range(4) for i in range(3)]
SCHEMA = "id long, " + ", ".join(f"{n} double" for n in NAMES)


def points(w):
    return [[F.col(f"{w}{k}{i}") for i in range(3)] for k in range(4)]


def run(spark, rows, face):
    df = spark.createDataFrame([(i, *map(float, np.ravel(r))) for i, r in enumerate(rows)], SCHEMA).repartition(4)
    f = collision.vertex_face if face else collision.edge_edge
    return {r.id: r for r in f(df, points("s"), points("e"), "hit").collect()}


def brute(row, face):
    """(meets, margin, time) by numpy's roots of the volume and solving for the place at each."""
    s, e = np.reshape(row, (2, 4, 3)).astype(float)
    poly = np.poly1d([0.0])
    x = [[np.poly1d([e[k, i] - e[0, i] - s[k, i] + s[0, i], s[k, i] - s[0, i]]) for i in range(3)] for k in (1, 2, 3)]
    for i, j, k in itertools.permutations(range(3)):
        sign = float(np.linalg.det(np.eye(3)[[i, j, k]]))
        poly = poly + x[0][i] * x[1][j] * x[2][k] * sign
    best = None
    for t in poly.roots:
        if abs(t.imag) > 1e-9:
            continue
        p = s + t.real * (e - s)
        if face:
            uv = np.linalg.lstsq(np.array([p[2] - p[1], p[3] - p[1]]).T, p[0] - p[1], rcond=None)[0]
            inner = min(uv[0], uv[1], 1 - uv.sum())
        else:
            uv = np.linalg.lstsq(np.array([p[1] - p[0], p[2] - p[3]]).T, p[2] - p[0], rcond=None)[0]
            inner = min(*uv, *(1 - uv))
        margin = min(inner, t.real, 1 - t.real)
        best = max(best or (-np.inf, 0.0), (margin, t.real))
    return best or (-1.0, 0.0)


@pytest.mark.parametrize("face", [True, False])
def test_contacts_against_brute_force(spark, face):
    rows = np.random.default_rng(5 + face).normal(size=(400, 24))
    got, hits = run(spark, rows, face), 0
    for i, row in enumerate(rows):
        margin, _ = brute(row, face)
        if abs(margin) > 1e-6:
            assert got[i].hit == (margin > 0), (i, margin)
            hits += got[i].hit
        if got[i].hit:
            p = row.reshape(2, 4, 3)
            p = p[0] + got[i].hit_at * (p[1] - p[0])
            assert abs(np.dot(p[1] - p[0], np.cross(p[2] - p[0], p[3] - p[0]))) < 1e-9
    assert hits > 10


O, X, Y = [0, 0, 0], [1, 0, 0], [0, 1, 0]


def test_touching_and_degenerate(spark):
    down = lambda x, y, z0=1, z1=-1: ([x, y, z0], [x, y, z1])
    face = lambda v, tri=(O, X, Y), after=None: [[v[0], *tri], [v[1], *(after or tri)]]
    third = 1 / 3
    cases = [
        (face(down(0.25, 0.25)), 0.5), (face(down(0, 0)), 0.5), (face(down(0.5, 0.5)), 0.5), (face(down(0.5, np.nextafter(0.5, 1))), None),
        (face(down(0.25, 0.25, 1, 0)), 1.0), (face(down(0.25, 0.25, 1, 5e-324)), None), (face(down(0.25, 0.25, 0, 1)), 0.0),
        (face(([-1, 0.25, 0], [1, 0.25, 0])), 0.5), (face(([-1, 2, 0], [1, 2, 0])), None), (face(([0.5, 0.25, 0], [0.5, 0.25, 0])), 0.0),
        (face(([1, 1, 1], [1, 1, -1]), (O, [1, 1, 0], [2, 2, 0])), 0.5), (face(([1, 2, 1], [1, 2, -1]), (O, [1, 1, 0], [2, 2, 0])), None),
        (face(([0, 0, 1], [0, 0, -1]), (O, O, O)), 0.5), (face(([third, 0, 1], [third, 0, -2]), (O, X, Y)), third),
        (face(([2e200, 2e200, 1e201], [2e200, 2e200, -1e201]), (O, [1e201, 0, 0], [0, 1e201, 0])), 0.5),
    ]
    got = run(spark, [c for c, _ in cases], True)
    for i, (_, want) in enumerate(cases):
        assert got[i].hit == (want is not None), i
        assert want is None or abs(got[i].hit_at - want) < 1e-15, i
    edges = [
        ([[O, X, [0.5, -1, 1], [0.5, 1, 1]], [O, X, [0.5, -1, -1], [0.5, 1, -1]]], 0.5), ([[O, X, [0, 1, 0], [1, 1, 0]], [O, X, [0, -1, 0], [1, -1, 0]]], 0.5),
        ([[O, X, [1, -1, 1], [1, 1, 1]], [O, X, [1, -1, -3], [1, 1, -3]]], 0.25), ([[O, X, [2, -1, 1], [2, 1, 1]], [O, X, [2, -1, -1], [2, 1, -1]]], None),
        ([[O, O, [-1, 0, 1], [1, 0, 1]], [O, O, [-1, 0, -1], [1, 0, -1]]], 0.5), ([[O, X, [3, 0, 0], [2, 0, 0]], [O, X, [3, 0, 0], [1, 0, 0]]], 1.0),
    ]
    got = run(spark, [c for c, _ in edges], False)
    for i, (_, want) in enumerate(edges):
        assert got[i].hit == (want is not None), i
        assert want is None or abs(got[i].hit_at - want) < 1e-15, i


def test_odd_rows(spark):
    row = [0.25, 0.25, 1.0, *O, *X, *Y, 0.25, 0.25, -1.0, *O, *X, *Y]
    rows = [(1, *map(float, row), 7), (1, *map(float, row), 7), (2, None, *map(float, row[1:]), 7), (3, float("nan"), *map(float, row[1:]), 7), (4, float("inf"), *map(float, row[1:]), 7)]
    df = spark.createDataFrame(rows, SCHEMA + ", hit int")
    out = collision.vertex_face(df, points("s"), points("e"), "hit")
    assert out.columns == ["id", *NAMES, "hit", "hit_at"]
    assert sorted((r.id, r.hit, r.hit_at) for r in out.collect()) == [(1, True, 0.5), (1, True, 0.5), (2, None, None), (3, None, None), (4, None, None)]
    assert collision.edge_edge(df.limit(0), points("s"), points("e"), "hit").count() == 0


def test_roots():
    p = roots.times(roots.times([-1, 3], [-1, 3]), [-2, 0, 9])  # a double root at 1/3, one at sqrt(2) / 3
    found = roots.in_unit_range(p)
    assert [round(x.place(), 12) for x in found] == [round(1 / 3, 12), round(2**0.5 / 3, 12)]
    assert [x.sign([-1, 3]) for x in found] == [0, 1] and [x.sign([-2, 0, 9]) for x in found] == [-1, 0]


def grid_rows(face, n=400):
    """Rows on a coarse grid, where ties are common, some of them in one plane throughout."""
    rows = np.random.default_rng(8 + face).integers(-2, 3, (n, 2, 4, 3)).astype(float)
    rows[::8, :, :, 2] = 0
    rows[4::8, :, 1] = rows[4::8, :, 0]
    return rows.reshape(n, 24)


def check_batches(face):
    rows = grid_rows(face)
    times, decided = contacts.first_contacts(rows, face)
    assert decided.mean() > 0.7 and np.isfinite(times[decided]).sum() > 20
    for k in np.flatnonzero(decided):
        want = collision._first_contact(rows[k].tolist(), face)
        assert np.isnan(times[k]) if want is None else abs(times[k] - want) <= 2**-52, k
    odd = np.array([rows[0] / 3, rows[0] * 2.0**40])
    assert not contacts.first_contacts(odd, face)[1].any()  # these stay with the exact helper


def test_batches_of_edges_agree_with_the_exact_helper():
    check_batches(False)
    half = [*O, *X, 1, 1, 0, 0, 1, 1, *X, 1, 1, 0, 0, 1, 1, *O]  # parallel at the half of the time, when no fraction of the volume's root tells
    assert contacts.first_contacts(np.array([half], float), False)[1].all()


def test_batches_of_faces_agree_with_the_exact_helper():
    check_batches(True)


def test_filter_runs_once_for_all_rows_left(spark, monkeypatch):
    calls = []
    own = collision._may_meet
    monkeypatch.setattr(collision, "_may_meet", lambda x, face: calls.append(len(x)) or own(x, face))
    flat = [1.0, 1, 0, 0, 0, 0, 4, 0, 0, 0, 4, 0, 2, 1, 0, 0, 0, 0, 4, 0, 0, 0, 4, 0]
    free = [0.1 + k for k in range(24)]
    rows = pd.Series([flat, None, free] * 3000)
    out = collision._decided(True).func(rows)
    assert len(calls) == 1
    assert (out[::3] == 0).all() and out[1::3].isna().all()
