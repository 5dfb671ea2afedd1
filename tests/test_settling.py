"""Bundles and run pairing, against plain sequential versions."""

import itertools
import random

from pyspark.sql import functions as F

from plumbline.operators import bundles, pairing


def snapshot_rounds(cases, pinned):
    d = {}
    for pieces, systems in cases:
        for p in pieces:
            d[p] = d[p] & set(systems) if p in d else set(systems)
    for p, s in pinned.items():
        if p in d:
            d[p] &= s
    while True:
        new = {}
        for p, own in d.items():
            struck, forced = set(), set()
            for pieces, systems in cases:
                if p in pieces:
                    struck |= {s for s in own for q in pieces if q != p and d[q] == {s}}
                    forced |= {s for s in own if len(own) > 1 and all(s not in d[q] for q in pieces if q != p)}
            new[p] = set() if len(forced) > 1 else (own - struck) & forced if forced else own - struck
        if new == d:
            return d
        d = new


def test_bundle_domains(spark):
    rng = random.Random(1)
    for trial in range(3):
        cases, pinned, rows, names = [], {}, [], []
        for sheet in range(25):  # sheets do not touch, so one call settles many cases
            pieces = [f"{trial}-{sheet}-{i}" for i in range(rng.randint(2, 6))]
            truth = {p: f"S{i}" for i, p in enumerate(rng.sample(pieces, len(pieces)))}
            for _ in range(rng.randint(1, 5)):
                some = rng.sample(pieces, rng.randint(1, len(pieces)))
                systems = sorted({truth[p] for p in some} | ({"S9"} if rng.random() < 0.15 else set()))
                cases.append((some, systems))
            if rng.random() < 0.5:
                p = rng.choice(pieces)
                pinned[p] = {truth[p] if rng.random() < 0.9 else "S8"}
        for k, (pieces, systems) in enumerate(cases):
            rows += [(k, p) for p in pieces]
            names += [(k, s) for s in systems]
        want = snapshot_rounds(cases, pinned)
        for _ in range(2):
            rng.shuffle(rows)
            rng.shuffle(names)
            got = bundles.domains(spark.createDataFrame(rows + rows[:3] + [(0, None)], "bundle int, piece string"), spark.createDataFrame(names, "bundle int, system string"), spark.createDataFrame([(p, s) for p, x in pinned.items() for s in x] or [("none", "S0")], "piece string, system string"))
            assert {r.piece: set(r.systems) for r in got.collect()} == want
        assert {r.state for r in got.collect()} == {"SETTLED", "OPEN", "CONTRADICTED"}
        for sheet in range(25):  # no assignment that the labels allow is ever lost
            own = sorted({p for pieces, _ in cases for p in pieces if p.startswith(f"{trial}-{sheet}-")})
            here = [c for c in cases if c[0][0].startswith(f"{trial}-{sheet}-")]
            if any(len(s) > len(p) for p, s in here) or any(p in pinned for p in own):
                continue
            for values in itertools.product(*[sorted(set().union(*(s for p, s in here if x in p))) for x in own]):
                a = dict(zip(own, values))
                if all(len({a[p] for p in pieces}) == len(pieces) and all(a[p] in systems for p in pieces) for pieces, systems in here):
                    assert all(a[p] in want[p] for p in own)


def sequential(ref, ours):
    """Closest pairs first over all pairs, then sums, then ranks."""
    out, f, o = [], dict(ref), dict(ours)
    for _, i, j in sorted((abs(f[i] - o[j]), i, j) for i in f for j in o if pairing.same(f[i], o[j])):
        if i in f and j in o:
            out.append(("SAME_RUN", (i,), (j,)))
            del f[i], o[j]
    order = lambda x: sorted(x.items(), key=lambda t: (-t[1], t[0]))
    for j, m in order(o):
        pick = pairing.combination(m, order(f))
        if pick:
            out.append(("MERGED", tuple(pick), (j,)))
            del o[j]
            for i in pick:
                del f[i]
    for i, m in order(f):
        pick = pairing.combination(m, order(o))
        if pick:
            out.append(("SPLIT", (i,), tuple(pick)))
            del f[i]
            for j in pick:
                del o[j]
    for a, b in itertools.zip_longest(order(f), order(o)):
        kind = "MISSING_RUN" if b is None else "EXTRA_RUN" if a is None else "SHORT_RUN" if b[1] < a[1] else "LONG_RUN"
        out.append((kind, () if a is None else (a[0],), () if b is None else (b[0],)))
    return sorted(out)


def test_run_pairing_equals_a_sequential_one(spark):
    rng = random.Random(2)
    sides, want = ([], []), {}
    for key in range(60):
        ref = {i: round(rng.choice([rng.uniform(0.05, 3), rng.uniform(1, 40), float(rng.randint(1, 9))]), rng.choice([0, 1, 2])) for i in range(rng.randint(0, 14))}
        ours = {100 + j: round(m * rng.choice([1, 1, rng.uniform(0.8, 1.2)]), 2) for j, m in enumerate(rng.sample(sorted(ref.values()), len(ref) * 2 // 3))}
        for m in list(ref.values())[: rng.randint(0, 2)]:
            ours[200 + len(ours)] = round(m * 0.6, 2)
            ours[200 + len(ours)] = round(m * 0.4, 2)
        if len(ref) > 4 and rng.random() < 0.5:
            ours[300] = sum(list(ref.values())[:3])
        sides[0].extend((key, i, m) for i, m in ref.items())
        sides[1].extend((key, j, m) for j, m in ours.items())
        want[key] = sequential(ref, ours)
    frames = [spark.createDataFrame(rng.sample(s, len(s)), "name int, id int, m double") for s in sides]
    got = pairing.pair_runs(*frames, ["name"]).collect()
    for key in range(60):
        assert sorted((r.kind, tuple(r.reference), tuple(r.ours)) for r in got if r.name == key) == want[key], key
    assert {r.kind for r in got} == {"SAME_RUN", "MERGED", "SPLIT", "SHORT_RUN", "LONG_RUN", "MISSING_RUN", "EXTRA_RUN"}
    lengths = {(s, k, i): m for s in (0, 1) for k, i, m in sides[s]}
    assert all(r.ours_m == round(sum(lengths[1, r.name, j] for j in r.ours), 2) for r in got)
    assert pairing.pair_runs(frames[0].limit(0), frames[1].limit(0), ["name"]).count() == 0
