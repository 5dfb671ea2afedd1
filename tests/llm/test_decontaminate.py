import random

from plumbline.llm import decontaminate as D

ITEMS = [
    (1, "A train leaves Paris at 9 with 40 km to go and Alice takes the train from Paris home. How many km remain?"),
    (2, "too short"),
    (3, "what colour is the sky"),
    (4, None),
]
DOCS = [
    (10, "Some lead text here. " + ITEMS[0][1] + " And more text after."),
    (11, "Well. A train leaves Rome at 7 with 55 miles to go and Bob takes the train from Rome home. How many miles remain? Fine."),
    (12, "Well. A train leaves Rome at 7 with 55 miles to go and Bob takes the train from Oslo home. How many miles remain?"),
    (13, "A completely different text about trains and many other things that nobody asked about at all."),
    (14, None),
    (15, ""),
    (16, "They asked: what colour is the sky? Blue."),
    (None, ITEMS[0][1]),
    (10, "Some lead text here. " + ITEMS[0][1] + " And more text after."),
]


def test_leaks(spark):
    docs = spark.createDataFrame([(a, b, "x") for a, b in DOCS], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.share for r in D.leaks(docs, bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 1), (16, 3)}
    assert got[10, 1] == 1 and got[11, 1] > 0.9 and 0.5 <= got[12, 1] < got[11, 1]  # Paris became two cities: its slots no longer count
    assert sorted(r.doc_id or 0 for r in D.cleaned(docs, bench).collect()) == [0, 13, 14, 15]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.leaks(none, bench).count() == 0
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert D.leaks(docs, bench.limit(0)).count() == 0


def test_every_place_and_every_template(spark):
    item8 = "which river flows past the old stone mill"
    item15 = "every morning the baker carries fresh loaves across the narrow wooden bridge before sunrise begins"
    title = "The Great Northern Railway Of Canada"
    sums = "12 km + 30 km is 42 km"
    parts = "first mix flour with warm water then let it rest overnight before you bake it slowly at low heat"
    run = "red green blue yellow orange purple brown black white grey pink gold silver " + " ".join(f"w{chr(97 + i)}x" for i in range(20))
    bench = spark.createDataFrame([(1, item8), (2, item15), (3, title), (4, sums), (5, parts), (6, run)], "item_id long, text string")
    rows = [(i, "so " * i + item8) for i in range(8)]
    rows += [(20, "well " + item15.replace("across", "over"))]
    rows += [(30, "We saw it. " + title + " was there"), (40, "so: " + sums)]
    rows += [(50, "now " + parts.replace("then let", "then please do let").replace("you bake", "you carefully must bake")), (60, "zz " + " ".join(run.split()[:13]) + " and nothing more of it")]
    rows += [(70, "the morning was fresh and the bridge was old")]
    got = {(r.doc_id, r.item_id): r.share for r in D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(i, 1) for i in range(8)} | {(20, 2), (30, 3), (40, 4), (50, 5), (60, 6)}
    assert got[20, 2] == 14 / 15 and got[50, 5] == 1 and got[60, 6] < 0.5


def test_short_items_of_many_slots(spark):
    bench = spark.createDataFrame([(1, "add 3 then 4 minus 5 gives")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so add 6 then 8 minus 9 gives it")], "doc_id long, text string")
    assert [(r.doc_id, r.share) for r in D.leaks(docs, bench).collect()] == [(1, 1.0)]


def test_items_of_every_length_at_every_place(spark):
    """Every item copied word for word, and with other numbers, names and units, is found wherever it stands."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    items, rows, want, number = [], [], set(), 0
    for n in [*range(D.LEAST_TOKENS, 20), 30, 45, 60]:
        parts = [word() for _ in range(n)]
        for i in range(2, n - 1, 5):
            parts[i] = rng.choice(["{num}", "{name}", "{num} {unit}"]) if n >= 10 else parts[i]
        fill = lambda k, parts=parts: " ".join(parts).replace("{num}", str(17 + k)).replace("{name}", ["Berlin", "Oslo"][k]).replace("{unit}", ["km", "miles"][k])
        items.append((n, fill(0)))
        for lead in range(6):
            for k in range(2):
                number += 1
                rows.append((number, " ".join([word() for _ in range(lead)] + [fill(k)] + [word() for _ in range(3)])))
                want.add((number, n))
    for _ in range(30):
        number += 1
        rows.append((number, " ".join(word() for _ in range(40))))
    got = D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "what colour is the sky", "x"), (None, None, "y")], "doc_id long, text string, leaked string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [tuple(r) for r in D.cleaned(docs, bench).collect()] == [(None, None, "y")]
