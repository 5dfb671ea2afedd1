import hashlib
import random
import re

from plumbline.llm import pii

#: The plain patterns, tried by Python's own matcher.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m[0])]


TEXTS = [
    None, "", "a@b.c", "a@b.c_x@d.e mail a.b@c-d.e.f.", "a@b.c@d.e", "@x.y a@b", "é ü 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "card 4111 1111 1111 1111, 4111-1111-1111-1112; 4111111111111111",
    "+1 (017) 555-7713 and +49 30 12 34 56 78 9 10 11 12 13 + +1+12345678", "1" * 30000, "a" * 30000 + "@", "x." * 10000 + "@y", "+1" + " " * 20000, "😀 a@b.co 😀 1.1.1.1",
]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "a@b.c", "x"), (3, TEXTS[3], "x"), (None, "c@d.e", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted(((r.doc_id, r.base_sha256) for r in pii.digest(pii.detect(df)).collect()), key=str)
    assert got == sorted(((i, hashlib.sha256(",".join(brute(t)).encode()).hexdigest()) for i, t, _ in rows), key=str)


def test_context_finds_what_the_patterns_miss(spark):
    seeds = [(i, f"please write to contact: user{i % 10}{i}@mail.example.com today or later") for i in range(60)]
    texts = [*seeds, (100, "do write to contact: user77@localhost today"), (101, "in room 42 there were 17 people")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.detect(df)).collect()}
    assert got[101] == "" and got[100] == "email:21:37"


def test_empty(spark):
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.co, 1.2.3.4 end", "x"), (2, None, "y"), (3, "clean", "z"), (None, "+1 555 123 4567 é", "w")], "doc_id long, text string, kind string")
    got = {r.doc_id: (r.text, r.kind) for r in pii.redacted(df).collect()}
    assert got == {1: ("é <email>, <ip> end", "x"), 2: (None, "y"), 3: ("clean", "z"), None: ("<phone> é", "w")}


def test_planted_identifiers_are_found_and_plain_words_are_not(spark):
    """Identifiers that no fixed pattern matches, one for ten seeds, planted after words that seeds taught; precision and recall of the added spans."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, want = [], set()
    for i in range(330):
        lead, tail = " ".join(word() for _ in range(rng.randint(0, 8))), " ".join(word() for _ in range(4))
        if i % 3 < 2 and i % 15 != 1:
            rows.append((i, f"{lead} mail me at: {word()}{i}@mail.example.com {tail}"))
        elif i % 15 == 1:
            hidden = f"{word()}{i}(at)example"
            text = f"{lead} mail me at: {hidden} {tail}"
            rows.append((i, text))
            want.add((i, "email", text.index(hidden), text.index(hidden) + len(hidden)))
        else:
            rows.append((i, f"{lead} it was {word()} {i} times {tail}"))
    for i in range(330, 340):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        text = f'{word()} token = "{value}" {word()}'
        rows.append((i, text))
        want.add((i, "secret", text.index(value), text.index(value) + 40))
    got = {(r.doc_id, s.kind, s.start, s.end) for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans if not s.base}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


SHAPES = [("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "9")]


def plain_bootstrap(texts):
    """(doc, kind, start, end) of added spans, with sets and loops; ASCII texts with single spaces."""
    words = {}  # (doc, k) -> (bare, start, patterns)
    for doc, text in texts:
        glued = re.sub(r"(?<=[0-9)]) (?=\(?[0-9])", "\ue000", text)
        at, own = 0, []
        for w in glued.split(" "):
            lead = len(re.match(r"^[^A-Za-z0-9+]*", w).group())
            bare = re.sub(r"^[^A-Za-z0-9+]+", "", w)
            bare = re.sub(r"(?<=[A-Za-z0-9+])[^A-Za-z0-9]+$", "", bare)
            shape = bare
            for pat, x in SHAPES:
                shape = re.sub(pat, x, shape)
            own.append((bare, at + lead, re.sub("[0-9]+", "9", w).lower(), shape))
            at += len(w) + 1
        for k, (bare, start, _, shape) in enumerate(own):
            if len(bare) < pii.LEAST_LENGTH:
                continue
            p = set()
            if k >= 2:
                p.add(("two", own[k - 2][2], own[k - 1][2]))
            if k >= 1:
                p.add(("before", own[k - 1][2], shape))
                if own[k - 1][2].endswith((":", "=")):
                    p.add(("label", own[k - 1][2]))
            if k + 1 < len(own):
                p.add(("after", own[k + 1][2], shape))
            before = " ".join(x[2] for x in own[max(0, k - 2) : k])
            value = bare.replace("\ue000", " ")
            kind = next((n for n, q in PLAIN.items() if re.fullmatch(q, value) and good(n, value)), None)
            if kind is None and re.search("[0-9@]", bare) and re.match(pii.SECRET_VALUE, bare) and re.search(pii.NAMES_SECRET, before):
                kind = "secret"
            words[doc, k] = (bare, start, p, kind)
    known = {b: (k, 1.0) for b, _, _, k in words.values() if k}
    seeds = dict(known)
    graph = {}
    for b, _, p, _ in words.values():
        for x in p:
            graph.setdefault(x, set()).add(b)

    def patterns():
        out = {}
        for p, members in graph.items():
            sums = {}
            for b in members & known.keys():
                k, sc = known[b]
                sums.setdefault(k, []).append(sc)
            if sums:
                s, n, k = max((sum(v), len(v), k) for k, v in sums.items())
                if s / len(members) >= pii.LEAST_SCORE and n >= pii.LEAST_SEEDS:
                    out[p] = (k, s / len(members))
        return out

    while True:
        miss = {}
        for p, (k, sc) in patterns().items():
            for b in graph[p] - seeds.keys():
                miss[b, k] = miss.get((b, k), 1.0) * max(1 - sc, 1e-6)
        new = {}
        for (b, k), m in miss.items():
            new[b] = max(new.get(b, (0, "")), (int((1 - m) * 100 + 1e-6), k))
        new = seeds | {b: (k, sc / 100) for b, (sc, k) in new.items() if sc / 100 >= pii.LEAST_INSTANCE}
        if new == known:
            break
        known = new
    fine = {p for p, (k, _) in patterns().items() if k == "secret"}
    return {(doc, known[b][0], start, start + len(b)) for (doc, _), (b, start, p, kind) in words.items() if b in known and (b not in seeds or kind == "secret" and any(b in graph[x] for x in fine))}


def test_bootstrap_equals_a_plain_one_over_many_stages(spark):
    """Each stage's values stand in the next stage's context, so that every round teaches one more; noise must stay out."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    mails = [f"{word()}{i}@mail.example.com" for i in range(30)]
    stages = [mails[:3]] + [[f"{word()}.{s}{i}" for i in range(3)] for s in range(1, 8)]
    rows = [f"{word()} {word()} {m} {word()}" for m in mails]
    for s in range(1, 8):  # seventeen known ones, three that the stage before teaches, four new ones: good only when those three are known
        rows += [f"{word()} {word()} stage{'abcdefgh'[s]} has: {v} {word()}" for v in rng.sample(mails[3:], 17) + stages[s - 1] + stages[s]]
        rows += [f"{word()} {word()} stage{'abcdefgh'[s]} has: {word()}-{s} {word()}"]
    rows += [f"{word()} seen in: {word()}{i} {word()}" for i in range(40)] + [f"{word()} token = {'%040x' % rng.getrandbits(160)} {word()}" for _ in range(6)]
    rows += [f"{word()} token = short-one {word()}", f"{word()} passphrase: {'%040x' % rng.getrandbits(160)} {word()}", f"{word()} stagea has: 12 (34) 56 {word()}", f"{word()} a1 stageb has: x {word()}"]
    texts = list(enumerate(rng.sample(rows, len(rows))))
    want = plain_bootstrap(texts)
    got = {(r.doc_id, s.kind, s.start, s.end) for r in pii.detect(spark.createDataFrame(texts, "doc_id long, text string")).collect() for s in r.spans if not s.base}
    assert got == want
    assert {v for s in stages[1:] for v in s} <= {texts[d][1][a:b] for d, _, a, b in got} and {k for _, k, _, _ in got} == {"email", "secret"}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "to a@b.co now", "x", 1, 2)], "doc_id long, text string, cuts string, cut_id int, _t int")
    assert [tuple(r) for r in pii.redacted(df).collect()] == [(1, "to <email> now", "x", 1, 2)]


def test_patterns_are_set_aside_without_a_trace(spark, monkeypatch):
    """The plain bootstrap's spans too if every pattern that is not good yet is set aside in each round."""
    monkeypatch.setattr(pii, "SHARES", (3, 1))
    test_bootstrap_equals_a_plain_one_over_many_stages(spark)


def test_a_common_pattern_is_not_read_to_its_end(spark, monkeypatch):
    """Five addresses and a thousand words stand in one context: its instances do not enter the graph; a secret known elsewhere teaches still."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    secrets = ["%040x" % rng.getrandbits(160) for _ in range(5)]
    rows = [f"{word()} it was {word()} {word()}" for _ in range(1000)] + [f"{word()} it was {word()}{i}@mail.example.com {word()}" for i in range(5)]
    rows += [f"{word()} token = {v} {word()}" for v in secrets] + [f"{word()} now with: {v} {word()}" for v in secrets] + [f"{word()} now with: {word()}-x {word()}"]
    rows += [f"{word()} now with: {word()}{i}@mail.example.com {word()}" for i in range(4)]
    texts = list(enumerate(rows))
    sizes = []
    keep = pii.stored

    def counted(df, name):
        out = keep(df, name)
        if name == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(pii, "stored", counted)
    got = {(r.doc_id, s.kind, s.start, s.end) for r in pii.detect(spark.createDataFrame(texts, "doc_id long, text string")).collect() for s in r.spans if not s.base}
    assert got == plain_bootstrap(texts)
    assert sum(sizes) < 200
