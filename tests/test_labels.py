"""Designations, vocabularies, legends, other readings and scales, against plain versions."""

import collections
import random
import re

import pytest

from plumbline.operators import labels as B

A = "A-ZÅÄÖ"


def code(w):
    m = re.match(r"^(\d{1,2})[xX](.+)$", w)
    return bool(re.fullmatch(r"[A-Za-zÅÄÖØ0-9\-/+.,:()\[\]]{2,24}", w)) and any(c.isalpha() for c in w) and any(c in "0123456789" for c in w) and (m.group(2) if m else w)[0].isalpha()


def strip(w):
    m = re.match(r"^(\d{1,2})[xX](.+)$", w)
    return (int(m.group(1)), m.group(2)) if m and code(m.group(2)) and re.search("[-/]", m.group(2)) else (1, w)


def separated(w):
    return bool(re.search("[-/]", w) or re.fullmatch(rf"[{A}]{{1,4}}\d{{1,4}}[{A}]{{0,3}}", w))


def role(t):
    words, packed = t.split(" "), t.replace(" ", "")
    if not t:
        return "text"
    m = re.match(r"(\d{1,4})(.*)$", packed)
    if re.fullmatch(r"\d{1,4}", t) or m and int(m.group(1)) in B.NOMINAL_SIZES and (len(m.group(2)) <= 4 and not re.search(r"\d", m.group(2)) or re.fullmatch(rf"[^A-Za-z0-9]?(?![Xx]\d)[{A}a-zåäö]{{1,2}}\d{{1,3}}[)\]]?", m.group(2))):
        return "dn"
    if re.fullmatch(rf"([{A}]{{1,4}})\s*([+\-]\s*\d+[.,]?\d*|\d+[.,]\d+)", packed) or len(words) == 2 and re.fullmatch(rf"[{A}]{{1,4}}", words[0]) and re.fullmatch(r"[+\-]?\d+[.,]?\d*", words[1]):
        return "elevation"
    named = code(words[0]) and separated(words[0])
    if len(words) == 1 and (named or strip(words[0])[0] > 1):
        return "designation"
    if len(words) > 1 and named and all(re.fullmatch(rf"[(\[]?[{A}]{{1,3}}[)\]]?|\d{{1,4}}", w) for w in words[1:]):
        return "designation"
    if len(words) > 1 and all(code(strip(w)[1]) and separated(strip(w)[1]) for w in words):
        return "designation"
    return "note"


def plain(rows):
    out, blocks = [], collections.defaultdict(list)
    for sheet, block, row, text, x0, x1 in rows:
        if text is not None:
            blocks[sheet, block].append((row, re.sub(" +", " ", text).strip(), x0, x1))
    for (sheet, block), own in blocks.items():
        own.sort()
        for i, (row, text, x0, x1) in enumerate(own):
            if role(text) != "designation":
                continue
            words = [w.rstrip(",;") or w for w in text.split(" ")]
            several = len(words) > 1 and all(code(strip(w)[1]) for w in words)
            picked = list(enumerate(words)) if several or len(words) == 1 else [(k, w) for k, w in enumerate(words) if code(w)][:1]
            for k, w in picked:
                n, rest = strip(w)
                start = len(" ".join(words[:k])) + (k > 0)
                span = (x0 + (x1 - x0) * start / len(text), x0 + (x1 - x0) * (start + len(w)) / len(text))
                pat = re.sub("[^\\W\\d_]+", "A", re.sub(r"\d+", "9", rest))
                out.append([sheet, block, row, k, rest, n, pat, [t for t in re.split(r"[\-/+.,:()\[\]]+", rest) if t], several, span, own[i + 1 : i + 3]])
    fam = collections.defaultdict(list)
    for d in out:
        fam[d[0], d[6]].append(d[7])
    result = []
    for sheet, block, row, k, text, n, pat, toks, several, span, below in out:
        members, cands = fam[sheet, pat], []
        for i in range(1, max(map(len, members))):
            nums = [int(t[i]) for t in members if i < len(t) and t[i].isdigit()]
            good = sum(v in B.NOMINAL_SIZES for v in nums)
            if nums and len(nums) >= 0.8 * len(members) and good >= 0.6 * len(nums):
                cands.append((good / len(nums), i))
        best = [i for s, i in cands if s == max(cands)[0]]
        at = best[0] if len(best) == 1 else None
        nums = [(i, t) for i, t in enumerate(toks) if t.isdigit()]
        dn = src = where = None
        if at is not None and at < len(toks) and toks[at].isdigit() and 6 <= int(toks[at]) <= 1200:
            dn, src = int(toks[at]), "inline"
        elif len(members) <= 2 and len(nums) == 1 and nums[0][0] > 0 and int(nums[0][1]) in B.NOMINAL_SIZES:
            dn, src = int(nums[0][1]), "inline"
        elif not (at is None and any(i > 0 for i, _ in nums)):
            for r, t, a, b in below:
                if role(t) == "designation":
                    break
                m = re.match(r"\d{1,4}", t)
                if role(t) == "dn" and 6 <= int(m.group()) <= 1200 and (not several or min(span[1], b) - max(span[0], a) > 0):
                    dn, src, where = int(m.group()), "row", r
                    break
        result.append((sheet, block, row, k, text, n, pat, toks[0] if toks else "", dn, src, where))
    return sorted(result, key=repr)


def test_designations(spark):
    rng = random.Random(1)
    texts = ["KV1-20", "KV1-22", "VV12-32", "VS/40", "3xKV1-20", "12xVS", "KV1-20, VV1-22", "KV1-20 (L)", "KV-A VV-B1 VS-C2", "20", "25 (L)", "22-F60", "600X300", "VG+1,67", "CL 4000", "note here", "", None, "KV1", "S1-P2", "S1-P7", "S1-P2 110", "AB-1-20", "AB-2-25", "QQ-77", "7", "1300", "  VS2   ", "KV1-", "ÅÄ1-15", "a1", "KV1-20,"]
    rows = []
    for sheet in range(8):
        for block in range(25):
            rows += [(sheet, block, i, rng.choice(texts), float(rng.choice([0, 0, 30])), float(rng.choice([40, 60, 100]))) for i in range(rng.randint(1, 5))]
    got = B.designations(spark.createDataFrame(rng.sample(rows, len(rows)), "sheet int, block int, row int, text string, x0 double, x1 double"))
    want = plain(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert collections.Counter(r[9] for r in want)["row"] > 10 and collections.Counter(r[9] for r in want)["inline"] > 10


def test_vocabulary_names_characters(spark):
    rng = random.Random(2)
    layers = [(f, "|".join(rng.choice(["V-52BB", "KV1", "a12", "12", "abc", "X1Y2", "KV2", "KW1"]) + "-" + "".join(rng.choice("AB12") for _ in range(rng.randint(2, 4))) for _ in range(5))) for f in range(6)]
    known = {f: {t for t in re.split("[^A-Z0-9]+", s.upper()) if len(t) >= 3 and re.search("[A-Z]", t) and re.search("[0-9]", t)} for f, s in layers}
    words = []
    for f in range(6):
        for _ in range(60):
            w = rng.choice(sorted(known[f]))
            k = rng.randrange(len(w))
            words.append((f, w[:k] + "?" + w[k + 1 :] if rng.random() < 0.9 else "??" + w[2:], f"g{rng.randint(0, 14)}" if rng.random() < 0.3 else f"g{w[k]}"))
    votes = collections.defaultdict(set)
    for f, w, g in words:
        k = w.index("?")
        found = {t[k] for t in known[f] if len(t) == len(w) and all(a == b for i, (a, b) in enumerate(zip(t, w)) if i != k)}
        if w.count("?") == 1 and len(w) >= 4 and len(found) == 1:
            votes[f, g] |= found
    k = B.vocabulary(spark.createDataFrame(layers, "file int, layer string"), ["file"], "layer")
    assert {(r.file, r.word) for r in k.collect()} == {(f, w) for f, s in known.items() for w in s}
    got = B.named_from_vocabulary(spark.createDataFrame(words, "file int, word string, family string"), k, ["file"]).collect()
    assert {(r.file, r.family): r.char for r in got} == {key: next(iter(v)) for key, v in votes.items() if len(v) == 1} and len(got) > 3


def test_legend_pairs(spark):
    rng = random.Random(3)
    rows = []
    for s in range(5):
        for i in range(40):
            x, y = rng.choice([0.0, 30.0, 60.0, 200.0]), rng.choice([0, 10, 20, 30, 40, 50]) + rng.choice([0.0, 0.0, 1.5, 4.0, 6.0])
            rows.append((s, i, rng.choice(["KV1", "VS", "cold water", "KV2 hot water", "17", "DN: size", "LONGERTHANTWELVE", "rör", ""]), x, y, x + rng.choice([10.0, 25.0]), y + rng.choice([5.0, 10.0])))
    want = {}
    for s, i, t, x0, y0, x1, y1 in rows:
        if not t:
            continue
        m = re.match(rf"^([{A}]{{1,4}}[0-9]{{0,3}}[{A}]{{0,2}})\s*(?:[=:\-]\s*|\s{{1,}})([^\W\d_].*)$", t)
        h = max(y1 - y0, 1.0)
        if m:
            want[s, i] = (m.group(1), m.group(2), None)
        elif len(t) <= 12 and " " not in t:
            near = [(max(o[3] - x1, 0.0), o[1], o[2]) for o in rows if o[0] == s and o[1] != i and o[2] and o[3] > x1 - 0.1 and abs(o[4] - y0) <= 0.6 * h and max(o[3] - x1, 0.0) <= 12 * h]
            if near and re.search(r"[^\W\d_]", min(near)[2]):
                want[s, i] = (t, min(near)[2], min(near)[1])
    got = B.legend_pairs(spark.createDataFrame(rows, "sheet int, id int, text string, x0 double, y0 double, x1 double, y1 double"), ["sheet"]).collect()
    assert {(r.sheet, r.id): (r.code, r.description, r.other) for r in got} == want and len(got) == len(want)


def test_aligned_words(spark):
    words = [(1, 1, "K?1-20", 0.0, 0.0, 60.0, 10.0), (1, 2, "???", 0.0, 0.0, 30.0, 10.0), (1, 3, "VS?", 100.0, 0.0, 130.0, 10.0), (1, 4, "V?1", 200.0, 0.0, 230.0, 10.0), (1, 5, "X?", 300.0, 0.0, 320.0, 10.0)]
    others = [(1, "kv1-20", 0.9, 2.0, 0.0, 62.0, 10.0), (1, "KV2-20", 0.9, 0.0, 0.0, 60.0, 10.0), (1, "KW1-20", 0.99, 30.0, 0.0, 90.0, 10.0), (1, "VS1", 0.5, 100.0, 0.0, 130.0, 10.0), (1, "VV1", 0.8, 200.0, 0.0, 230.0, 10.0), (1, "VS1", 0.9, 200.0, 0.0, 230.0, 10.0), (1, "XY", 0.9, 315.0, 0.0, 335.0, 10.0)]
    got = B.aligned(spark.createDataFrame(words, "sheet int, id int, word string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(others, "sheet int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"), ["sheet"], 40.0)
    assert {r.id: (r.filled, r.other) for r in got.collect()} == {1: ("KV1-20", "kv1-20"), 4: ("VS1", "VS1")}


def test_scales(spark):
    pt = B.MM_PER_PT / 1000
    rows = [(1, "SKALA 1:50"), (2, "1:5O"), (2, "see 1:100 in the other set of drawings"), (3, "1:50"), (4, "1:50 (1:100)"), (6, "1:2"), (7, "1:20"), (8, None)]
    bar = lambda s, step, values, unit="": [(s, 1, 100.0 + step * i, f"{v}{unit}") for i, v in enumerate(values)]
    bars = bar(1, 1 / (50 * pt), range(6)) + bar(3, 1 / (100 * pt), range(4)) + bar(5, 20.0, [0, 500, 1000], "mm") + bar(6, 20.0, [0, 1, 3]) + bar(7, 20.0, [0, 1]) + bar(8, 10.0, [0, 10, 20]) + [(8, 1, 140.0, "cm")]
    got = B.scales(spark.createDataFrame([(s,) for s in range(1, 10)], "sheet int"), spark.createDataFrame(rows, "sheet int, text string"), spark.createDataFrame(bars, "sheet int, line int, x double, text string"), ["sheet"])
    have = {r.sheet: (r.scale_state, r.m_per_pt, r.ratios) for r in got.collect()}
    want = {1: ("VERIFIED", 50 * pt, [50]), 2: ("TEXT_ONLY", 50 * pt, [50]), 3: ("CONFLICT", 100 * pt, [50]), 4: ("CONFLICT", None, [50, 100]), 5: ("BAR_ONLY", 0.025, []), 6: ("NONE", None, []), 7: ("TEXT_ONLY", 20 * pt, [20]), 8: ("BAR_ONLY", 0.01, []), 9: ("NONE", None, [])}
    assert {k: v[0] for k, v in have.items()} == {k: v[0] for k, v in want.items()}
    for k, v in want.items():
        assert have[k][2] == v[2] and (have[k][1] == v[1] if v[1] is None else have[k][1] == pytest.approx(v[1]))
