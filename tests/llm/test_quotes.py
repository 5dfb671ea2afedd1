import random
import re

from plumbline.llm import quotes

ROWS = [
    (1, 0, "user", "How do I join two large tables in Spark? I tried a loop. It was slow.", 9),
    (1, 1, "assistant", "> I tried a loop. It was slow.\nUse a join on the key instead of a loop.", 9),
    (1, 2, "user", "Bob wrote:\n> > I tried a loop. It was slow.\n> Use a join on the key instead of a loop.\nThank you very much for this.", 9),
    (1, 3, "user", "> How do I join two large\n> tables in Spark?\nI would like to know too.", 9),
    (2, 0, "user", "> Thank you very much for this.\nYou are welcome, any time.", 9),
    (2, 1, "user", None, 9),
    (None, 2, "user", "no conversation", 9),
    (3, 0, "user", "", 9),
    (3, 0, "user", "", 9),
]


def test_links_levels_and_order(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, depth int")
    got = {(r.conv_id, r.turn): r for r in quotes.link(df).collect()}
    assert sum(1 for _ in quotes.link(df).collect()) == len(ROWS)
    reply = {k: (r.reply_conv, r.reply_turn) for k, r in got.items() if r.reply_turn is not None}
    assert reply == {(1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 0), (2, 0): (1, 2)}
    assert got[1, 2].text == "Thank you very much for this." and got[1, 2].depth == 2
    assert got[2, 0].thread_conv == 1 and got[2, 0].depth == 3
    assert [k for k, r in sorted(got.items(), key=lambda x: (x[1].thread_conv or 0, x[1].thread_turn, x[1].depth, x[0][0] or 0, x[0][1])) if r.thread_conv == 1] == [(1, 0), (1, 1), (1, 3), (1, 2), (2, 0)]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.link(df).count() == 0


def test_copies_and_short_quotes(spark):
    said = "The old bridge was closed for repairs in May."
    rows = [(1, 0, "user", said), (3, 0, "user", "> " + said + "\nIs it open again?"), (4, 0, "user", said), (5, 0, "user", said), (6, 0, "user", "> " + said + "\nNot yet."), (None, 0, "user", said)]
    rows += [(7, 0, "user", "Yes, Tuesday works."), (7, 1, "assistant", "Or Monday?"), (7, 2, "user", "> Yes, Tuesday works.\nThen Tuesday."), (8, 0, "user", "> Yes, Tuesday works.\nWhich one?")]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in got if r.reply_turn is not None} == {(3, 0): (1, 0), (6, 0): (1, 0), (7, 2): (7, 0)}


def linked_by_hand(rows):
    """A plain linker over whole quoted passages of one level each: the latest earlier message of the conversation, else the first message of all that said it."""
    said = {}
    for conv, turn, text in rows:
        own = "\n".join(x for x in text.split("\n") if not x.startswith(">"))
        for piece in {own, *own.split("\n")}:
            said.setdefault(norm(piece), []).append((conv, turn))
    out = {}
    for conv, turn, text in rows:
        quoted = [x for x in text.split("\n") if x.startswith(">")]
        if quoted:
            h = norm(" ".join(re.sub(r"^(> ?)+", "", x) for x in quoted))
            near = [x for x in said.get(h, []) if x[0] == conv and x[1] < turn]
            far = min(said.get(h, [(conv, turn)]))
            if near:
                out[conv, turn] = max(near)
            elif far[0] < conv and len(h.split()) >= quotes.LEAST_WORDS:
                out[conv, turn] = far
    return out


def norm(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def test_links_equal_a_plain_linker(spark):
    rng = random.Random(5)
    rows, base = [], 10**13
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            text = " ".join(rng.choice("red green blue gold tall small house river bird".split()) for _ in range(rng.randint(4, 7)))
            if rows and rng.random() < 0.6:
                of = rng.choice(rows if rng.random() < 0.4 else rows[-4:])
                lines = [x for x in of[2].split("\n") if not x.startswith(">")]
                text = "\n".join("> " * rng.randint(1, 1) + x for x in lines) + "\n" + text
            rows.append((base + conv if conv % 3 else conv - 20, turn, text))
    rows.sort()
    want = linked_by_hand(rows)
    got = quotes.link(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows) and len(want) > 40
    assert {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in got if r.reply_turn is not None} == want
    for r in got:
        at, steps = (r.conv_id, r.turn), 0
        while at in want:
            at, steps = want[at], steps + 1
        assert (r.thread_conv, r.thread_turn, r.depth) == (*at, steps)
