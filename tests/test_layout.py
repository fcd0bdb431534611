"""Places of a graph's notes against plain versions."""

import math
import random
from collections import deque

import numpy as np
import pytest

from quillstone.operators import graph as G
from quillstone.operators import layout as L
from quillstone.operators.ranks import exact_median, prefix_sums

RNG = random.Random(8)
NODES = [f"n{i:03}" for i in range(90)]
PAIRS = sorted({(a, b) for a, b in (RNG.sample(NODES[:80], 2) for _ in range(95))} | {("n081", "n082"), ("n082", "n083"), ("n000", "n000")})


def plain_hops(start):
    near = {}
    for a, b in PAIRS:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in near.get(x, ()):
            if y not in out:
                out[y] = out[x] + 1
                queue.append(y)
    return out


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(PAIRS, "src string, dst string").cache()


def test_distances_of_forty_pivots_are_those_of_plain_searches(spark, edges):
    table, pivots = L.pivot_table(edges)
    assert len(pivots) == len(set(pivots)) == 40
    want = [plain_hops(p) for p in pivots]
    rows = {r.path: r for r in table.collect()}
    assert set(rows) == {x for p in PAIRS for x in p}
    for path, r in rows.items():
        assert [r[f"d{k}"] for k in range(40)] == [w.get(path) for w in want]
    best = {r.path: r.degree for r in G.degrees(edges).collect()}
    assert best[pivots[0]] == max(best.values()) and {"n081", "n082", "n083"} & set(pivots)
    assert {(r.path, r.pivot, r.hop) for r in L.pivot_distances(G.both_ways(edges), ["n001", "n082"], hops=2).collect()} == {(p, i, h) for i, s in enumerate(("n001", "n082")) for p, h in plain_hops(s).items() if h <= 2}


def test_pivot_scaling_matches_a_plain_one(spark, edges):
    table, pivots = L.pivot_table(edges, 4)
    rows = sorted(table.collect(), key=lambda r: r.path)
    d = np.array([[np.nan if r[f"d{k}"] is None else r[f"d{k}"] for k in range(4)] for r in rows])
    s = np.where(np.isnan(d), np.nanmax(d) + 1, d) ** 2
    c = -0.5 * (s - s.mean(1, keepdims=True) - s.mean(0) + s.mean())
    vectors = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    got = {r.path: (r.x, r.y) for r in L.pivot_layout(edges, 4).collect()}
    for axis in (0, 1):
        own, want = np.array([got[r.path][axis] for r in rows]), c @ vectors[:, axis]
        assert np.allclose(own, want, atol=1e-6) or np.allclose(own, -want, atol=1e-6)
    assert L.pivot_layout(edges.limit(0)).count() == 0


def test_leaves_take_no_part_in_the_search_and_are_as_far_as_a_plain_one_says(spark, monkeypatch):
    near, pairs = {}, [(f"z{i}", f"h{i % 3}") for i in range(60)] + [("h0", "h1"), ("h1", "h2"), ("a0", "h2"), ("a0", "h2"), ("p1", "p0"), ("q0", "q0")]
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def plain(start, hops):
        out, front = {start: 0}, {start}
        for k in range(1, hops + 1):
            front = {y for x in front for y in near[x]} - set(out)
            out |= dict.fromkeys(front, k)
        return out

    sizes, write = [], L.written
    monkeypatch.setattr(L, "written", lambda df, name: (sizes.append((name, write(df, name).count())), write(df, name))[1])
    table, pivots = L.pivot_table(spark.createDataFrame(pairs, "src string, dst string"), 7, 2, (1, 6))
    # Notes that are neither leaves nor the second of two: h0 to h2, p0, q0.
    assert max(n for name, n in sizes if name.startswith(("hop", "seen", "core"))) == 5
    assert pivots[0] == "h2" and len(set(pivots)) == 7 and any(p.startswith("z") for p in pivots)
    rows = {r.path: r for r in table.collect()}
    assert set(rows) == set(near)
    want = [plain(p, 2) for p in pivots]
    for path, r in rows.items():
        assert [r[f"d{k}"] for k in range(7)] == [w.get(path) for w in want]


def plain_equalised(at):
    out, comps = {}, {c for c, _ in at}
    for c in comps:
        own = {p: xy for (k, p), xy in at.items() if k == c}
        cx, cy = (sum(v[i] for v in own.values()) / len(own) for i in (0, 1))
        order = sorted(own, key=lambda p: (math.hypot(own[p][0] - cx, own[p][1] - cy), p))
        for q, p in enumerate(order):
            x, y = own[p][0] - cx, own[p][1] - cy
            k = math.sqrt(len(own) / math.pi) * 1.25 * math.sqrt((q + 0.5) / len(own)) / math.hypot(x, y) if (x, y) != (0, 0) else 0
            out[c, p] = (x * k, y * k)
    return out


def plain_smoothed(at, rounds):
    near = {}
    for a, b in PAIRS:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    at = plain_equalised(at)
    for _ in range(rounds):
        by = {p: xy for (_, p), xy in at.items()}
        half = {}
        for (c, p), xy in at.items():
            others = [by[o] for o in near.get(p, []) if o in by]
            half[c, p] = tuple((v + (sum(o[i] for o in others) / len(others) if others else v)) / 2 for i, v in enumerate(xy))
        at = plain_equalised(half)
    return at


def plain_fanned(at):
    cells = {}
    for (c, p), (x, y) in at.items():
        cells.setdefault((c, math.floor(x), math.floor(y)), []).append(p)
    out = dict(at)
    for (c, _, _), ps in cells.items():
        if len(ps) > 1:
            mx, my = (sum(at[c, p][i] for p in ps) / len(ps) for i in (0, 1))
            for k, p in enumerate(sorted(ps)):
                r, a = 0.55 * math.sqrt(k + 0.5), k * math.pi * (3 - math.sqrt(5))
                out[c, p] = (mx + math.cos(a) * r, my + math.sin(a) * r)
    return out


def plain_spread(at, rounds):
    at = plain_fanned(at)
    links = {(a, b) for a, b in PAIRS if a != b} | {(b, a) for a, b in PAIRS if a != b}
    for k in range(rounds):
        move = {p: [0.0, 0.0] for _, p in at}
        for (c, p), (x, y) in at.items():
            for (e, o), (ox, oy) in at.items():
                d = math.hypot(x - ox, y - oy)
                if c == e and o != p and d < 1:
                    f = (1 - d) / d * 0.25
                    move[p][0] += (x - ox) * f
                    move[p][1] += (y - oy) * f
        by = {p: xy for (_, p), xy in at.items()}
        for a, b in links:
            if a in by and b in by:
                dx, dy = by[b][0] - by[a][0], by[b][1] - by[a][1]
                d = math.hypot(dx, dy) or 1e-6
                f = (d - 1.5) / d * 0.02
                move[a][0] += dx * f
                move[a][1] += dy * f
        at = {(c, p): tuple(v + max(-2, min(2, m)) * (1 - k / rounds) for v, m in zip(xy, move[p], strict=True)) for (c, p), xy in at.items()}
    return at


def close(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6)


def test_smoothing_and_collisions_match_plain_versions(spark, edges):
    rng = random.Random(3)
    at = {("b" if i > 80 else "a", p): (rng.uniform(-9, 9), rng.uniform(-9, 9)) for i, p in enumerate(NODES)}
    frame = lambda a: spark.createDataFrame([(*k, float(x), float(y)) for k, (x, y) in a.items()], "component string, path string, x double, y double")
    places = lambda df: {(r.component, r.path): (r.x, r.y) for r in df.collect()}
    close(places(L.smoothed(frame(at), edges, 2)), plain_smoothed(at, 2))
    close(places(L.fanned_out(frame({k: (x / 4, y / 4) for k, (x, y) in at.items()}))), plain_fanned({k: (x / 4, y / 4) for k, (x, y) in at.items()}))
    close(places(L.spread_out(frame(at), edges, 3)), plain_spread(at, 3))


def test_notes_of_one_place_part_and_a_dense_cell_is_bounded(spark):
    rows = [("a", f"p{i:04}", 0.5, 0.5) for i in range(400)]
    pushed = L.pushes(spark.createDataFrame(rows, "component string, path string, x double, y double"))
    got = {r.path: (r.px, r.py) for r in pushed.collect()}
    assert len(got) == 400 and len(set(got.values())) == 400
    lone = spark.createDataFrame([("a", f"p{i}", 0.4 * i, 0.0) for i in range(12)], "component string, path string, x double, y double")
    done = L.spread_out(lone, spark.createDataFrame([], "src string, dst string"), 12)
    at = [(r.x, r.y) for r in done.collect()]
    assert min(math.dist(a, b) for i, a in enumerate(at) for b in at[:i]) > 0.8


def test_islands_do_not_meet(spark):
    rng = random.Random(5)
    rows = [(f"c{i}", rng.choice([1, 1, 1, 2, 5, 30, 200]), f"f{i % 4}") for i in range(300)]
    done = L.packed(spark.createDataFrame(rows, "component string, n long, folder string").repartition(5)).collect()
    assert len(done) == 300
    for i, a in enumerate(done):
        for b in done[:i]:
            assert math.dist((a.x, a.y), (b.x, b.y)) >= a.r + b.r - 1e-6
    assert L.packed(spark.createDataFrame([], "component string, n long, folder string")).count() == 0


def test_sums_before_and_medians_of_two_values(spark, monkeypatch):
    from quillstone.operators import ranks

    rows = [(i % 7, i, float(i % 5)) for i in range(200)]
    got = {(r.a, r.b): r.before for r in prefix_sums(spark.createDataFrame(rows, "a int, b int, v double").repartition(4), G.F.col("v"), G.F.col("a"), G.F.desc("b")).collect()}
    total = 0.0
    for a, b, v in sorted(rows, key=lambda r: (r[0], -r[1])):
        assert got[a, b] == total
        total += v
    monkeypatch.setattr(ranks, "SORTED", 50)
    two = spark.range(1000).selectExpr("if(id % 2 = 0, 1.0d, 2.0d) AS v")
    assert exact_median(two, G.F.col("v")) == 1.5
    assert exact_median(spark.range(999).selectExpr("if(id % 3 = 0, 1.0d, 2.0d) AS v"), G.F.col("v")) == 2.0


def test_notes_of_a_dense_cell_all_push_each_other(spark, monkeypatch):
    """As a plain search of all pairs says, with cells whole and in parts, near a corner of four cells and in two components."""
    rng = random.Random(9)
    at = {("ab"[i % 2], f"p{i:03}"): (rng.gauss(0, 0.4), rng.gauss(0, 0.4)) for i in range(300)}
    want = {}
    for (c, p), (x, y) in at.items():
        near = [(x - ox, y - oy, math.hypot(x - ox, y - oy)) for (e, o), (ox, oy) in at.items() if c == e and o != p]
        want[p] = tuple(sum(v[i] * (1 - v[2]) / v[2] * 0.25 for v in near if v[2] < 1) for i in (0, 1))
    frame = spark.createDataFrame([(*k, x, y) for k, (x, y) in at.items()], "component string, path string, x double, y double")
    for part in (4_000, 11):
        monkeypatch.setattr(L, "PART", part)
        for same in (True, False):
            close({r.path: (r.px, r.py) for r in L.pushes(frame, same).collect()}, want)
