"""Searches around places grow with the places, not with how closely they lie."""

import random

from wayloom.operators import spatial


def test_shares_follow_the_points():
    assert spatial.shares_of(2_000) == []
    assert spatial.shares_of(2_001) == [0.5]
    assert spatial.shares_of(600_000) == [1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2]


def test_pairs_of_a_search_follow_its_places(frame, monkeypatch):
    joined, met = spatial.radius_join, []

    def counted(left, right, radius, **more):
        out = joined(left, right, radius, **more)
        met.append((out.count(), left.count(), more["parts"]))
        return out

    monkeypatch.setattr(spatial, "radius_join", counted)
    monkeypatch.setattr(spatial, "AT_ONCE", 40)
    monkeypatch.setattr(spatial, "PLACES_A_TASK", 100)
    rng = random.Random(4)
    pts = [(i, rng.random() * 100, rng.random() * 100) for i in range(1500)]
    got = {(r.src, r["rank"]): r.dst for r in spatial.nearest_neighbours(frame(pts, "pid bigint, x double, y double"), 2, 96.0).collect()}
    for i, x, y in rng.sample(pts, 40):
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in pts if j != i)[:2]
        assert [got[i, 1], got[i, 2]] == [j for _, j in near]
    assert all(parts == 15 for _, _, parts in met)
    # factors of four and more between radii: over 100 pairs a place
    assert sum(n for n, _, _ in met) < 80 * len(pts), met
