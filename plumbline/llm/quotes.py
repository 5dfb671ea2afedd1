"""Quotation linking: which message answers which, found from what it quotes.

Quote marks give each line its level. Runs of lines of one level are passages; a passage and each of its sentences
are normalised to lower-case words and hashed. Unquoted text gives the same hashes, so one join on (conversation, hash)
finds the latest earlier message that said it; what its own conversation does not have is looked up among all
messages, where the first that said it counts and later copies are taken for the same text. Parents are then followed by pointer doubling to give
each message its place in reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm._shared import stored

#: Words that a quoted passage or sentence needs to say which other conversation it is from; within its own any will do.
LEAST_WORDS = 4
MARK = r"^[ \t]*(?:>[ \t]?)+"
#: Verbs of the line that introduces a quotation, in the languages of the tables.
SAYS = r"(?i)\b(wrote|writes|said|schrieb|a écrit|escribió)\b[^\n]*:[ \t]*$"
SENTENCE = r"(?<=[.!?])[ \t\n]+"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[^>]", ""))


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _hashes(texts: Column) -> Column:
    """Array of (hash, length, has enough words to be looked up elsewhere) of the texts with any words, each once."""
    kept = F.filter(F.array_distinct(F.transform(texts, _norm)), lambda t: t != "")
    return F.transform(kept, lambda t: F.struct(F.xxhash64(t).alias("h"), F.length(t).alias("n"), (F.size(F.split(t, " ")) >= LEAST_WORDS).alias("enough")))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds the message's own text, without quoted lines and the lines that introduce them, and `lines` of its quotes (position, level, content)."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    m = messages.withColumn("_all", F.transform(lines, lambda x, i: F.struct(i.alias("pos"), _level(x).alias("level"), F.regexp_replace(x, MARK, "").alias("content"))))
    introduces = lambda x: (x["content"].rlike(SAYS)) & (F.coalesce(F.try_element_at("_all", x["pos"] + 2)["level"], F.lit(0)) > x["level"])
    quoted = F.coalesce(F.col("text"), F.lit("")).contains(">")
    own = F.array_join(F.transform(F.filter("_all", lambda x: (x["level"] == 0) & ~introduces(x)), lambda x: x["content"]), "\n")
    return m.withColumn("own", F.when(quoted, F.trim(own)).otherwise(F.coalesce(F.col("text"), F.lit("")))).withColumn("quotes", F.when(quoted, F.filter("_all", lambda x: x["level"] > 0)).otherwise(F.array().cast(m.schema["_all"].dataType))).drop("_all")


def _passages(m: DataFrame) -> DataFrame:
    """(conv_id, turn, level, h, n, enough): hashes of each passage and of its sentences."""
    x = m.where(F.size("quotes") > 0).select("conv_id", "turn", F.xxhash64("text").alias("_t"), F.explode("quotes").alias("q")).distinct().select("conv_id", "turn", "_t", "q.*")
    by = W.partitionBy("conv_id", "turn", "_t").orderBy("pos")
    first = (F.lag("pos").over(by).isNull()) | (F.lag("pos").over(by) != F.col("pos") - 1) | (F.lag("level").over(by) != F.col("level")) | (F.trim("content") == "")
    x = x.withColumn("_first", first.cast("int")).withColumn("run", F.sum("_first").over(by))
    x = x.groupBy("conv_id", "turn", "_t", "run").agg(F.min("level").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda s: s["content"]), " ").alias("passage"))
    return x.select("conv_id", "turn", "level", F.explode(_hashes(F.concat(F.array("passage"), F.split("passage", SENTENCE)))).alias("k")).select("conv_id", "turn", "level", "k.*").groupBy("conv_id", "turn", "h").agg(F.min("level").alias("level"), F.max("n").alias("n"), F.bool_or("enough").alias("enough"))


def links(m: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_conv, reply_turn, n_linked): the message that each quoting message answers.

    Of several, the one quoted at the lowest level, with most characters, and the latest. It comes earlier: by turn in
    the same conversation, by a smaller conv_id in another. A text that several conversations have is from the first.
    """
    q = stored(_passages(m), "quoted")
    texts = F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", r"\n"), F.split("own", SENTENCE))
    said = m.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode(_hashes(texts)).alias("k")).select("conv_id", "turn", "k.h", "k.enough")
    here = said.join(q.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").select("conv_id", "turn", "h").distinct()
    # The latest earlier message with the hash in the same conversation: an as-of join over one sorted pass.
    both = q.withColumn("is_said", F.lit(0)).unionByName(here.withColumn("is_said", F.lit(1)), allowMissingColumns=True)
    before = W.partitionBy("conv_id", "h").orderBy("turn", "is_said").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = both.withColumn("reply_turn", F.last(F.when(F.col("is_said") == 1, F.col("turn")), True).over(before)).where("is_said = 0")
    # Summed before it is shuffled, so that a text of many copies is no large group.
    first = said.where("enough").groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("o")).select("h", F.col("o.conv_id").alias("o_conv"), F.col("o.turn").alias("o_turn"))
    far = near.where("reply_turn IS NULL AND enough").join(first, "h").where("o_conv < conv_id").select("conv_id", "turn", "level", "n", F.col("o_conv").alias("reply_conv"), F.col("o_turn").alias("reply_turn"))
    found = near.where("reply_turn IS NOT NULL").select("conv_id", "turn", "level", "n", F.col("conv_id").alias("reply_conv"), "reply_turn").unionByName(far)
    per = found.groupBy("conv_id", "turn", "reply_conv", "reply_turn").agg(F.min("level").alias("level"), F.sum("n").alias("n"), F.count("*").alias("k"))
    best = F.max(F.struct((-F.col("level")).alias("l"), "n", (F.col("reply_conv") == F.col("conv_id")).alias("same"), "reply_conv", "reply_turn")).alias("b")
    return per.groupBy("conv_id", "turn").agg(best, F.sum("k").alias("n_linked")).select("conv_id", "turn", "b.reply_conv", "b.reply_turn", "n_linked")


def _roots(found: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth): the first message of the thread and the steps from it, by pointer doubling over linked messages only.

    A row holds one pointer whatever its depth, and the rounds grow with the logarithm of the longest thread.
    """
    key = lambda c, t: F.struct(F.col(c).cast("long").alias("conv"), F.col(t).cast("long").alias("turn"))
    x = found.select("conv_id", "turn", key("reply_conv", "reply_turn").alias("root"), F.lit(1).cast("long").alias("depth"))
    while True:
        x = stored(x, "roots")
        up = x.select(key("conv_id", "turn").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        j = stored(x.join(up, "root", "left"), "doubled")
        if j.where("root2 IS NOT NULL").isEmpty():
            return j.select("conv_id", "turn", "root", "depth")
        x = j.select("conv_id", "turn", F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotes, n_quoted_lines, reply_conv, reply_turn (null: answers none), n_linked, thread_conv, thread_turn, depth.

    (thread_conv, thread_turn) is the thread's first message; ordered by it, then by (depth, conv_id, turn), each
    message comes after the one that it answers, and (reply_conv, reply_turn) says which that is. Ids are whole numbers of
    any size and sign. Null and empty texts say nothing; messages with a null conversation or turn keep their row and
    answer none. Repeated rows stay and share the link of their (conv_id, turn). An empty table gives an empty result.
    Only the four named columns are read, so others cannot clash. Very long messages are read whole. DataFrame functions only.

    Calling this runs the doubling rounds, whose steps are written to the shared folder.
    """
    m = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    m = parsed(m)
    found = stored(links(m), "replies")
    if found.isEmpty():
        tree = found.select("*", F.lit(None).cast("struct<conv:bigint,turn:bigint>").alias("root"), F.lit(None).cast("long").alias("depth"))
    else:
        tree = found.join(_roots(found), ["conv_id", "turn"], "left")
    return m.join(tree, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.size("quotes").cast("long").alias("n_quoted_lines"), "reply_conv", "reply_turn",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("root.conv", F.col("conv_id").cast("long")).alias("thread_conv"),
        F.coalesce("root.turn", F.col("turn").cast("long")).alias("thread_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
    )
