"""detect_lines against plain Python, step by step, on random drawings of several colours and tiles."""

import math
import random

import pytest

from linework.operators.components import connected_components, least_labels, local_components
from linework.params import Params
from linework.plans.lines import detect_lines

COLOURS = (255, 65280, 16711680)


def classes(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def chord(points):
    pts = sorted(set(points))
    return min((-(a[0] - b[0]) ** 2 - (a[1] - b[1]) ** 2, a, b) for i, a in enumerate(pts) for b in pts[i:])[1:]


def ends(s):
    return [(s["x1"], s["y1"]), (s["x2"], s["y2"])]


def owners(items):
    out = {}
    for i, s in items.items():
        for p in ends(s):
            out[p] = max(out.get(p, -1), i)
    return out


def near(s, own, eps):
    return [own[(x + dx, y + dy)] for x, y in ends(s) for dx in range(-eps, eps + 1) for dy in range(-eps, eps + 1) if (x + dx, y + dy) in own]


def strokes(px):
    """Strokes of one tile, pixels {(row, col): rgb}, trimmed."""
    edge = {p: v for p, v in px.items() if any(px.get((p[0] + a, p[1] + b)) != v for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))}

    def run(p, step):
        while edge.get((p[0] - step[0], p[1] - step[1])) == edge[p]:
            p = (p[0] - step[0], p[1] - step[1])
        q = p
        while edge.get((q[0] + step[0], q[1] + step[1])) == edge[p]:
            q = (q[0] + step[0], q[1] + step[1])
        return p, q

    tall, wide = {run(p, (1, 0)) for p in edge}, {run(p, (0, 1)) for p in edge}
    found = [(0, a[1], a[0], a, b) for a, b in tall if a != b] + [(1, *a, a, b) for a, b in wide if a != b] + [(2, *a, a, b) for a, b in tall & wide if a == b]
    out = []
    for rank, major, minor, (r1, c1), (r2, c2) in found:
        v = edge[(r1, c1)]
        pos = edge.get((r1 - 1, c1 - 1)) == v or edge.get((r2 + 1, c2 + 1)) == v
        neg = edge.get((r2 + 1, c1 - 1)) == v or edge.get((r1 - 1, c2 + 1)) == v
        for copy, a, b in ((0, True, False), (1, False, True)) if pos and neg else ((-1, pos, neg),):
            out.append((rank, major, minor, copy, {"x1": c1, "y1": r1, "x2": c2, "y2": r2, "k1": c2 - c1, "k2": r2 - r1, "rgb": v, "volume": max(c2 - c1, r2 - r1) + 1, "dirs": (a, b)}))
    items = {i: s[4] for i, s in enumerate(sorted(out, key=lambda s: s[:4]))}
    inner = {(s["x1"] + (k if s["k1"] else 0), s["y1"] + (0 if s["k1"] else k)) for s in items.values() for k in range(1, s["volume"] - 1)}
    for s in items.values():
        dot, upright = not s["k1"] and not s["k2"], not s["k1"]
        if (s["x1"], s["y1"]) in inner:
            s["x2"] -= dot
            s["x1"] += not upright
            s["y1"] += upright and not dot
        elif (s["x2"], s["y2"]) in inner:
            s["x2"] -= dot or not upright
            s["y2"] -= upright and not dot
    return items


def turned(a, b):
    return a["k1"] + b["k2"] != 0 and b["k1"] + a["k2"] != 0


def slope(x1, y1, x2, y2):
    return math.inf if x1 == x2 else (y2 - y1) / (x2 - x1)


def intercept(x1, y1, x2, y2):
    return math.inf if x1 == x2 else y1 - slope(x1, y1, x2, y2) * x1


def tile_lines(px, long_run=10, leftover=6):
    items = strokes(px)
    own = owners(items)
    links = {(i, d) for i, s in items.items() for d in near(s, own, 1) if d != i}
    alike = lambda a, b: a["rgb"] == b["rgb"] and a["dirs"] == b["dirs"] and (a["volume"] == 1 or turned(a, b))
    first = classes(items, [(i, d) for i, d in links if 1 <= items[i]["volume"] <= 5 and items[i]["volume"] == items[d]["volume"] and alike(items[i], items[d])])
    size = lambda of, i: sum(v == of[i] for v in of.values())
    taken = {i for i in items if size(first, i) >= long_run}
    rest = [i for i in items if i not in taken]
    second = classes(rest, [(i, d) for i, d in links if i not in taken and d not in taken and abs(items[i]["volume"] - items[d]["volume"]) <= 1 and alike(items[i], items[d])])
    alone = [i for i in rest if size(second, i) == 1 and items[i]["volume"] <= leftover]
    groups = {}
    for i in items:
        if i not in alone:
            groups.setdefault((1, first[i]) if i in taken else (2, second[i]), []).append(i)
    lines = {}
    for n, key in enumerate(sorted(groups)):
        (x1, y1), (x2, y2) = chord([p for i in groups[key] for p in ends(items[i])])
        lines[n] = {"x1": x1, "y1": y1, "x2": x2, "y2": y2, "rgb": items[groups[key][0]]["rgb"]}
    own, extra, edges = owners(lines), {}, []
    for i in alone:
        hits = [n for n in near(items[i], own, 1) if lines[n]["rgb"] == items[i]["rgb"]]
        if len(hits) == 1:
            extra.setdefault(hits[0], []).append(i)
        for a in set(hits) if len(hits) > 1 else ():
            for b in set(hits) - {a}:
                (one, two) = ((lines[p]["x1"], lines[p]["y1"], lines[q]["x2"], lines[q]["y2"]) for p, q in ((a, b), (b, a)))
                if abs(slope(*one) - slope(*two)) < 1 and abs(intercept(*one) - intercept(*two)) < 1 and 1 <= abs(slope(*one)) <= 999:
                    edges.append((a, b))
    final = classes(lines, edges)
    out = []
    for f in set(final.values()):
        members = [n for n in lines if final[n] == f]
        points = [p for n in members for p in ends(lines[n])] + [p for n in members for i in extra.get(n, ()) for p in ends(items[i])]
        out.append((*chord(points), lines[f]["rgb"]))
    return out


def brute_lines(px, tile, radius=3, angle=1.0):
    tiles = {}
    for (r, c), v in px.items():
        tiles.setdefault((r // tile, c // tile), {})[(r % tile, c % tile)] = v
    found = []
    for (i, j), own in tiles.items():
        found += [(i, j, x1 + j * tile, y1 + i * tile, x2 + j * tile, y2 + i * tile, v) for (x1, y1), (x2, y2), v in tile_lines(own)]
    lines = {n: dict(zip(("x1", "y1", "x2", "y2", "rgb"), f[2:])) for n, f in enumerate(sorted(found))}
    lines = {n: s for n, s in lines.items() if (s["x2"] - s["x1"]) ** 2 + (s["y2"] - s["y1"]) ** 2 > 9}
    own, edges = owners(lines), []
    for i, a in lines.items():
        for d in set(near(a, own, radius)) - {i}:
            b = lines[d]
            s, t = (slope(*(q[k] for k in ("x1", "y1", "x2", "y2"))) for q in (a, b))
            m, n = (99999999999 if math.isinf(v) else v for v in (s, t))
            between = 90 if m * n == -1 else math.degrees(math.atan(abs((m - n) / (1 + m * n))))
            apart = any(max(a[f"{z}1"], a[f"{z}2"]) < min(b[f"{z}1"], b[f"{z}2"]) or max(b[f"{z}1"], b[f"{z}2"]) < min(a[f"{z}1"], a[f"{z}2"]) for z in "xy")
            straight = a["x1"] == b["x1"] if math.isinf(s) else a["y1"] == b["y1"] if s == 0 else True
            if a["rgb"] == b["rgb"] and between < angle and apart and straight:
                edges.append((i, d))
    of = classes(lines, edges)
    return sorted((*(v for p in chord([p for n in lines if of[n] == f for p in ends(lines[n])]) for v in p), lines[f]["rgb"]) for f in set(of.values()))


def drawing(rng, size, n):
    px = {}
    for _ in range(n):
        r, c, v = rng.randrange(size), rng.randrange(size), rng.choice(COLOURS)
        a, b = rng.choice([(0, 1), (1, 0), (1, 1), (1, -1), (1, 2), (2, 1)])
        for k in range(rng.randrange(1, 26)):
            for w in range(max(a, abs(b)) if a and b else 1):
                p = (r + a * k + (w if a > 1 else 0), c + b * k + (w if abs(b) > 1 else 0))
                if 0 <= p[0] < size and 0 <= p[1] < size:
                    px[p] = v
    for _ in range(n // 3):
        r, c, v = rng.randrange(size), rng.randrange(size), rng.choice(COLOURS)
        px |= {(r + a, c + b): v for a in range(rng.randrange(1, 5)) for b in range(rng.randrange(1, 5)) if r + a < size and c + b < size}
    return px


@pytest.mark.parametrize("tile", [16, 64])
def test_lines_against_plain_python(spark, tile):
    rng = random.Random(tile)
    drawings = {i: drawing(rng, 40, rng.randrange(2, 22)) for i in range(30)}
    rows = [(i, r, c, v) for i, px in drawings.items() for (r, c), v in px.items()]
    rng.shuffle(rows)
    got = {i: [] for i in drawings}
    for r in detect_lines(spark.createDataFrame(rows, "image_id long, row long, col long, rgb int"), Params(tile=tile)).collect():
        got[r["image_id"]].append((r["x1"], r["y1"], r["x2"], r["y2"], r["rgb"]))
    merged = 0
    for i, px in drawings.items():
        assert sorted(got[i]) == brute_lines(px, tile), i
        merged += len(got[i])
    assert merged > 100


def test_local_components_are_the_components(spark):
    rng = random.Random(3)
    rows = [(t, rng.randrange(60), rng.randrange(60)) for t in range(5) for _ in range(40)]
    df = spark.createDataFrame(rows, "t long, src long, dst long")
    got = {(r["t"], r["node"]): r["component"] for r in local_components(df, ["t"]).collect()}
    for t in range(5):
        want = {r["node"]: r["component"] for r in connected_components(df.where(f"t = {t}")).collect()}
        assert {n: c for (k, n), c in got.items() if k == t} == want
    for chunk in (1, 7, 45):  # stars take the place of edges ever so often
        assert {((r["t"], r["node"]), r["component"]) for r in local_components(df, ["t"], chunk).collect()} == set(got.items())
    assert local_components(df.limit(0), ["t"]).count() == 0
    import numpy as np

    assert least_labels(4, np.array([3, 2]), np.array([2, 1])).tolist() == [0, 1, 1, 1]
