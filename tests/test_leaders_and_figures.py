"""Leaders, outlines, symbols and risers against plain walkers and loops."""

import collections
import math
import random

from plumbline.operators import figures as G
from plumbline.operators import leaders as L


def scene(rng):
    """(blocks, starts, strokes): labels of 20 by 5, lines that leave them in a few steps, some shared, branching or too short."""
    blocks, starts, strokes = {}, [], {}
    for b in range(rng.randint(2, 7)):
        x, y = 20.0 * rng.randint(0, 9), rng.choice([0.0, 5.0, 40.0, 80.0, 120.0])
        if any(v[:2] == (x, y) for v in blocks.values()):
            continue
        blocks[b] = (x, y, x + 20, y + 5, 5.0, rng.random() < 0.8)
        kind = rng.choice(["underline_end", "box_corner", "bbox_corner"])
        starts += [(b, x, y, kind), (b, x + 20, y, kind)] + ([(b, x + 20, y, "bbox_corner")] if rng.random() < 0.3 else [])
    n = 0
    for b in list(blocks) * 2:
        x, y = blocks[b][0] + rng.choice([0, 20]) + rng.choice([0, 0, 1]), blocks[b][1] - rng.choice([0, 0, 1])
        for _ in range(rng.randint(1, 10)):
            dx, dy = rng.choice([(7, 0), (0, -9), (-11, 0), (0, 8), (1, -1), (13, 5)])
            strokes[f"s{n:03}"] = ((x, y, x + dx, y + dy) if rng.random() < 0.5 else (x + dx, y + dy, x, y))
            n, x, y = n + 1, x + dx, y + dy
        if rng.random() < 0.4:  # ends at another label
            t = rng.choice(list(blocks))
            strokes[f"s{n:03}"] = (x, y, blocks[t][0], blocks[t][1])
            n += 1
    return blocks, starts, {k: tuple(map(float, v)) for k, v in strokes.items() if v[:2] != v[2:]}


def inside(block, p):
    m = 0.3 * block[4]
    return block[0] - m <= p[0] <= block[2] + m and block[1] - m <= p[1] <= block[3] + m


def plain_claims(blocks, starts, strokes):
    found = collections.defaultdict(dict)
    for s, v in strokes.items():
        for end in (0, 1):
            e, f = (v[:2], v[2:]) if end == 0 else (v[2:], v[:2])
            for b, x, y, kind in starts:
                d = math.hypot(x - e[0], y - e[1])
                if d <= 0.35 * blocks[b][4]:
                    k = L.STARTS[kind]
                    rank = (int(inside(blocks[b], f)), int(k >= 2), int(not blocks[b][5]), math.floor(d * 10 + 0.5) / 10, k)
                    c = ((blocks[b][0] + blocks[b][2]) / 2, (blocks[b][1] + blocks[b][3]) / 2)
                    leaves = (e[0] - c[0]) * (f[0] - e[0]) + (e[1] - c[1]) * (f[1] - e[1]) > 0
                    if b not in found[s] or (k, rank, end) < found[s][b][0]:
                        found[s][b] = ((k, rank, end), rank, end, leaves)
    out = {}
    for s, per in found.items():
        best = min(v[1] for v in per.values())
        top = {b: v for b, v in per.items() if v[1] == best}
        away = {b: v for b, v in top.items() if v[3]}
        if len(top) > 1 and len(away) == 1:
            top = away
        for b, v in top.items():
            out[s, b] = ("CLAIMED" if len(top) == 1 else "AMBIGUOUS", v[1], v[2])
    return out


def plain_leaders(blocks, strokes, claims):
    """One leader after the other, strongest first."""
    at = collections.defaultdict(list)
    for s, v in strokes.items():
        at[v[:2]].append(s)
        at[v[2:]].append(s)
    used, out = set(), {}
    for (s, b), (state, rank, end) in sorted(claims.items(), key=lambda t: (t[1][1], t[0][1], t[0][0])):
        if state != "CLAIMED" or s in used:
            continue
        v = strokes[s]
        path, here, reason = [s], v[2:] if end == 0 else v[:2], None
        while reason is None:
            next_ = [x for x in at[here] if x != path[-1]]
            if len(path) >= 8:
                reason = "longest"
            elif len(next_) > 1:
                reason = "branch"
            elif not next_:
                reason = "end"
            elif next_[0] in path:
                reason = "loop"
            elif next_[0] in used:
                reason = "taken"
            else:
                path.append(next_[0])
                w = strokes[next_[0]]
                here = w[2:] if w[:2] == here else w[:2]
        length = sum(math.hypot(strokes[x][2] - strokes[x][0], strokes[x][3] - strokes[x][1]) for x in path)
        if length >= 0.8 * blocks[b][4] and not inside(blocks[b], here):
            used |= set(path)
            out[s] = (b, tuple(path), here, round(length, 3))
    return out


def test_leaders_equal_a_plain_walker(spark):
    rng = random.Random(12)
    scenes = [scene(rng) for _ in range(40)]
    strokes = [(k, "pen", f"{k}:{s}", *v) for k, (_, _, x) in enumerate(scenes) for s, v in x.items()]
    blocks = [(k, b, *v) for k, (x, _, _) in enumerate(scenes) for b, v in x.items()]
    starts = [(k, b, float(x), float(y), kind) for k, (_, s, _) in enumerate(scenes) for b, x, y, kind in s]
    found, claims = L.discover(
        spark.createDataFrame(blocks, "sheet int, block int, x0 double, y0 double, x1 double, y1 double, height double, says boolean"),
        spark.createDataFrame(rng.sample(starts, len(starts)), "sheet int, block int, x double, y double, kind string"),
        spark.createDataFrame(rng.sample(strokes, len(strokes)), "sheet int, pen string, id string, x0 double, y0 double, x1 double, y1 double"), 20.0,
    )
    got, have = claims.collect(), found.collect()
    reasons = collections.Counter()
    for k, (blocks, starts, strokes) in enumerate(scenes):
        strokes = {f"{k}:{s}": v for s, v in strokes.items()}
        want = plain_claims(blocks, starts, strokes)
        assert {(r.stroke, r.block): (r.state, tuple(r.rank), r.end) for r in got if r.sheet == k} == want
        mine = {r.leader: (r.block, tuple(r.path), (r.x, r.y), r.length) for r in have if r.sheet == k}
        assert mine == plain_leaders(blocks, strokes, want), k
        reasons.update(r.reason for r in have if r.sheet == k)
    assert {"CLAIMED", "AMBIGUOUS"} == {r.state for r in got} and {"end", "branch", "longest", "taken"} <= set(reasons), reasons


def test_outlines_and_recurring_gaps(spark):
    rng = random.Random(3)
    rows = []
    for fam in range(6):
        for i in range(40):
            y, x, n = rng.choice([0.0, 40.0, 80.0, 120.0]) + rng.choice([0, 0.5, 0.8, 1.1, 2.5]), rng.choice([0.0, 100.0, 5.0]), rng.choice([6.0, 60.0, 50.0])
            line = (x, y, x + n, y) if i % 3 else (y, x, y, x + n)
            rows.append((fam, fam * 100 + i, *line, rng.choice([0.4, 0.7]), rng.choice(["CONFIRMED", "CONFIRMED", "UNOWNED"])))
    want, gaps = {}, collections.defaultdict(list)
    for fam in range(6):
        own = [r for r in rows if r[0] == fam]
        pen = max(r[6] for r in own)
        for r in own:
            n = math.hypot(r[4] - r[2], r[5] - r[3])
            if r[7] != "CONFIRMED" or n < 10:
                continue
            for q in sorted(own, key=lambda q: q[1]):
                m = math.hypot(q[4] - q[2], q[5] - q[3])
                flat, flat_q = r[3] == r[5], q[3] == q[5]
                if q[1] == r[1] or m < 0.8 * n or flat != flat_q:
                    continue
                gap = round(abs((q[3] - r[3]) if flat else (q[2] - r[2])), 6)
                k = 2 if flat else 3
                shared = min(r[k + 2], q[k + 2]) - max(r[k], q[k])
                if 1e-6 < gap <= min(n / 20, 2 * pen) and shared >= 0.8 * n:
                    want[r[1]] = (q[1], gap)
                    gaps[fam].append(gap)
                    break
    bands = {}
    for fam, v in gaps.items():
        clusters = []
        for g in sorted(v):
            if clusters and g <= clusters[-1][0] * 1.15:
                clusters[-1].append(g)
            else:
                clusters.append([g])
        bands[fam] = [(c[len(c) // 2], max(c[-1] - c[len(c) // 2], c[len(c) // 2] - c[0])) for c in clusters if len(c) >= 4 and len(c) >= 0.1 * len(v)]
    df = spark.createDataFrame(rows, "fam int, id int, x0 double, y0 double, x1 double, y1 double, width double, state string")
    got = G.outlines(df, ["fam"], 20.0).collect()
    assert {r.id: (r.twin, r.gap) for r in got} == want and len(want) > 30
    assert all(r.recurs == any(abs(r.gap - mid) <= slack for mid, slack in bands[r.fam]) for r in got) and {r.recurs for r in got} == {True, False}
    after = G.demoted(df, ["fam"], 20.0).collect()
    assert len(after) == len(rows) and {r.id for r in after if r.reason} == set(want) and all(r.state == "AMBIGUOUS" for r in after if r.reason)


def test_figures_and_points_in_symbols(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        x, y = 300.0 * (k % 4), 300.0 * (k // 4)
        if k % 3 == 0:  # a radiator: twenty strokes in a small box
            rows += [(1, "a", len(rows) + i, x + i, y, x + i, y + 20) for i in range(20)]
        elif k % 3 == 1:  # a run of pieces
            rows += [(1, "a", len(rows) + i, x + 22.0 * i, y, x + 22.0 * i + 20, y) for i in range(6)]
        else:
            rows += [(1, "a", len(rows) + i, x + rng.randint(0, 9), y + rng.randint(0, 9), x + rng.randint(0, 9), y + rng.randint(0, 9)) for i in range(5)]
    df = spark.createDataFrame([(s, p, i, float(a), float(b), float(c), float(d)) for s, p, i, a, b, c, d in rows], "sheet int, pen string, id int, x0 double, y0 double, x1 double, y1 double")
    box = {r[2]: (min(r[3], r[5]), min(r[4], r[6]), max(r[3], r[5]), max(r[4], r[6])) for r in rows}
    where = {i: i for i in box}

    def top(i):
        while where[i] != i:
            i = where[i]
        return i

    for i, a in box.items():
        for j, b in box.items():
            if a[0] - 3 <= b[2] and b[0] <= a[2] + 3 and a[1] - 3 <= b[3] and b[1] <= a[3] + 3:
                i2, j2 = sorted((top(i), top(j)))
                where[j2] = i2
    want = {}
    for f in {top(i) for i in box}:
        own = [r for r in rows if top(r[2]) == f]
        ink = sum(math.hypot(r[5] - r[3], r[6] - r[4]) for r in own)
        d = math.hypot(max(box[r[2]][2] for r in own) - min(box[r[2]][0] for r in own), max(box[r[2]][3] for r in own) - min(box[r[2]][1] for r in own))
        want[f] = (len(own), round(ink, 3), ink >= 40 and 1e-6 < d <= 200 and ink >= 6 * d)
    got = G.figures(df, ["sheet", "pen"], 30.0)
    assert {r.figure: (r.strokes, r.ink, r.is_figure) for r in got.collect()} == want and {v[2] for v in want.values()} == {True, False}
    points = spark.createDataFrame([(1, "p1", "b", 5.0, 5.0), (1, "p2", "a", 5.0, 5.0), (1, "p3", "b", 19.9, 20.9), (1, "p4", "b", 25.0, 5.0)], "sheet int, point string, pen string, x double, y double")
    assert {r.point: r.symbols for r in G.covering(points, got.where("is_figure"), ["sheet"], 30.0).collect()} == {"p1": [0], "p3": [0]}


def test_risers(spark):
    mark = lambda i, x, y, size, layer="m": (1, i, layer, x - size / 2, y - size / 2, x + size / 2, y + size / 2)
    marks = [mark("a", 0, 0, 6), mark("b", 1, 1, 3), mark("c", 2.5, 2.5, 6), mark("d", 100, 0, 6), mark("e", 200, 0, 6), mark("f", 300, 0, 6), mark("g", 400, 0, 20), mark("h", 500, 0, 6, "other"), mark("i", 600, 0, 6), mark("j", 700, 0, 3)]
    labels = [("l1", "KV|20", 3, 8.0, 0.0), ("l2", "VV|20", 1, 100.0, 14.0), ("l3", "VS|32", 1, 100.0, -14.0), ("l4", "VS|32", 1, 250.0, 0.0)]
    pipes = [("p1", "KV|25", 150.0, 2.0, 197.0, 2.0), ("p2", "KV|25", 203.0, 1.0, 260.0, 1.0), ("p3", "KV|25", 303.0, 0.0, 320.0, 0.0), ("p4", "VV|15", 300.0, 3.5, 300.0, 50.0), ("p5", "KV|25", 480.0, 0.0, 520.0, 0.0), ("p6", "KV|25", 680.0, 0.0, 720.0, 0.0)]
    got = G.risers(
        spark.createDataFrame(marks, "sheet int, id string, layer string, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame([(1, *x) for x in labels], "sheet int, label string, designation string, times int, x double, y double"),
        spark.createDataFrame([(1, *x) for x in pipes], "sheet int, id string, designation string, x0 double, y0 double, x1 double, y1 double"), ["sheet"], 30.0,
    ).collect()
    assert {r.riser: (r.marks, r.designation, r.source, r.times) for r in got} == {
        "a": (3, "KV|20", "label", 3), "d": (1, None, "ambiguous", 1), "e": (1, "KV|25", "pipe", 1), "f": (1, None, None, 1), "h": (1, None, None, 1), "i": (1, None, None, 1), "j": (1, None, None, 1),
    }
